"""Figures with state on a stream, over several micro-batches and a restart, against the batch operators."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vigilspark.operators import parse as P
from vigilspark.operators import windows as W
from vigilspark.streaming import live

T0 = datetime(2026, 1, 1)


def streamed(spark, df, tmp_path, schema, cuts, order, apply):
    """Rows of the stream's result; df comes in one file for each cut, and the query stops and starts again half way."""
    live.use_state_store(spark)
    (tmp_path / "in").mkdir()
    for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        df.filter((F.col(order) >= low) & (F.col(order) < high)).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03d}"))
        if k in (len(cuts) // 2, len(cuts) - 2):
            rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
            q = apply(rows).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
            assert q.awaitTermination(60)
    return spark.read.parquet(str(tmp_path / "out"))


def test_addresses_of_pids(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"f{rng.randrange(2)}", k, rng.choice([None, 1, 2, 3]), ip := rng.choice([None, None, "1.1.1.1", "2.2.2.2"]), rng.choice([None, f"s{k}"]) if ip else None) for k in range(120)]
    schema = "path string, line_no long, pid int, src_ip string, session_id string"
    df = spark.createDataFrame(rows, schema)
    got = streamed(spark, df, tmp_path, schema, [0, 30, 60, 90, 120], "line_no", live.live_addresses)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, P.enrich_by_pid(df).select(*df.columns).collect()), key=repr)


def test_failures_of_addresses(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, T0 + timedelta(seconds=20 * k + rng.randrange(15)), "auth_log", rng.choice(["Invalid user x from 1.1.1.1", "Invalid user x from 2.2.2.2", "Accepted"])) for k in range(120)]
    schema = "id long, timestamp timestamp_ntz, source string, raw_line string"
    df = spark.createDataFrame(rows, schema)
    columns = ["id", "failed_ip", "failures", "action"]
    got = streamed(spark, df, tmp_path, schema, [0, 30, 60, 90, 120], "id", live.live_failures)
    want = W.failed_logins_within(df)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())) and got.count() > 50
