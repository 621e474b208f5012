"""Raw log files: text and gzip files, tar archives, routing of paths to parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.sources.datasources import register

#: Path fragment -> parser, the first that a path holds; file names that are never text logs.
ROUTES = [("auth.log", "auth_log"), ("secure", "auth_log"), ("syslog", "syslog"), ("access.log", "web_access"), ("error.log", "web_error"), ("ebpf", "ebpf")]
SKIPPED = ["wtmp", "btmp", "lastlog", "faillog"]


def read_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, line_no (order within a file's split), line; .gz files are decompressed by Spark; directories are walked."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def read_tar(spark: SparkSession, path: str) -> DataFrame:
    """archive, path (inside it), line_no, line of the regular files of tar archives: a task for each member of a plain
    archive, one for a compressed one; what a truncated archive still has. path: see datasources."""
    register(spark)
    return spark.read.format("vigil_tar").load(path)


def route(path: Column) -> Column:
    """Parser for a path, null to skip."""
    name = F.element_at(F.split(path, "/"), -1)
    out = F.when(name.isin(SKIPPED) | path.contains("/journal/") | path.startswith("journal/"), F.lit(None).cast("string"))
    for fragment, parser in ROUTES:
        out = out.when(path.contains(fragment), parser)
    return out.when(path.contains("apache2/") & name.contains("_access.log"), "web_access").when(path.contains("apache2/") & name.contains("_error.log"), "web_error")
