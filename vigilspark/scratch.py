"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}  # application -> the folder that stands in where none is named


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset: a temporary folder if driver and executors are one
    process, else a folder in the warehouse, which must not be a machine's own disk."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='vigilspark-')}"
        else:
            place = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            if re.match(r"file:|/", place):
                raise ValueError("on a cluster spark.checkpoint.dir has to name a folder that all machines share")
            _OWN[app] = f"{place}/vigilspark-scratch"
    return _OWN[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _delete_at_exit(spark: SparkSession, path: str, pid: int) -> None:
    if os.getpid() == pid and spark.sparkContext._jsc is not None:
        _delete(spark, path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/vigilspark-{label}-{uuid.uuid4().hex}"
    atexit.register(_delete_at_exit, spark, path, os.getpid())
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut by files that outlive executors. The files go
    when the driver ends, or earlier through drop()."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    if path := getattr(df, "_scratch_path", None):
        _delete(df.sparkSession, path)
