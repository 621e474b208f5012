"""SQLite event databases, plain or compressed by zstd, read by ranges of their row numbers and turned into a store."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.sources.datasources import register
from vigilspark.sources.store import CAMPAIGN_SCHEMA, EVENT_SCHEMA, EventStore

#: Row numbers of a task, rows of a batch.
RANGE, ROWS = 200_000, 10_000


def _opened(path: str) -> sqlite3.Connection:
    from urllib.parse import quote

    return sqlite3.connect(f"file:{quote(os.path.abspath(path))}?mode=ro", uri=True)


def read_table(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A table's columns of schema (times as text); tasks read a range of row numbers each, in batches.

    path has to be a file that driver and executors both open, on a folder that they share. Columns that the table
    lacks are null. A .zst file is read by one task."""
    if path.endswith(".zst"):
        register(spark)
        text = ", ".join(f"{n} {'string' if k.startswith('timestamp') else k}" for n, k in (c.split() for c in schema.split(", ")))
        return spark.read.format("vigil_sqlite").option("table", table).schema(text).load(path)
    fields = [c.split() for c in schema.split(", ")]
    db = _opened(path)
    held = {r[1] for r in db.execute(f'pragma table_info("{table}")')}
    if not held:
        db.close()
        raise ValueError(f"no table {table!r} in {path}")
    low, high = db.execute(f'select min(rowid), max(rowid) from "{table}"').fetchone()
    db.close()
    out_schema = ", ".join(f"{n} {'string' if kind.startswith('timestamp') else kind}" for n, kind in fields)
    if low is None:
        return spark.createDataFrame([], out_schema)
    wanted = ", ".join(f'"{n}"' if n in held else f'null as "{n}"' for n, _ in fields)
    whole = [n for n, kind in fields if kind in ("int", "long")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = _opened(path)
        for batch in batches:
            for start in batch["id"].tolist():
                rows = source.execute(f'select {wanted} from "{table}" where rowid >= ? and rowid < ?', (start, start + RANGE))
                while got := rows.fetchmany(ROWS):
                    pdf = pd.DataFrame(got, columns=[n for n, _ in fields], dtype=object)
                    yield pdf.assign(**{n: pdf[n].astype("Int64") for n in whole})
        source.close()

    starts = spark.range(low, high + 1, RANGE, numPartitions=max(1, min(100_000, (high - low) // RANGE + 1)))
    return starts.mapInPandas(run, out_schema)


def _utc(text: Column) -> Column:
    """ISO times as UTC without zone; those without an offset are UTC, malformed ones null."""
    zoned = F.convert_timezone(F.current_timezone(), F.lit("UTC"), text.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), zoned).otherwise(text.try_cast("timestamp_ntz"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "events", EVENT_SCHEMA).withColumn("timestamp", _utc(F.col("timestamp")))


def read_campaigns(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "campaigns", CAMPAIGN_SCHEMA).withColumns({c: _utc(F.col(c)) for c in ("start_time", "end_time")})


def convert(spark: SparkSession, path: str, store: str) -> EventStore:
    """A new store with the database's events and campaigns. A .zst file is unpacked by the task that reads it."""
    out = EventStore(spark, store, "w")
    out.append(read_events(spark, path))
    out.append_campaigns(read_campaigns(spark, path))
    return out
