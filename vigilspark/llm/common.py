"""What the training-data operators share: tables, scratch tables in the shared folder, link graphs."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.scratch import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _delete_at_exit(spark: SparkSession, path: str, pid: int) -> None:
    if os.getpid() == pid and spark.sparkContext._jsc is not None:
        _delete(spark, path)


def materialize(df: DataFrame, label: str, sweep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut by files that outlive executors.

    The files go when the driver ends, or earlier through drop(). With sweep the driver's collector runs, at which Spark
    deletes the shuffle files of what was just written; else they stay until it happens to run."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vigilspark-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete_at_exit, spark, path, os.getpid())
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if sweep:
        spark.sparkContext._jvm.System.gc()
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    if path := getattr(df, "_scratch_path", None):
        _delete(df.sparkSession, path)


def fold_of(id_column: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % n


def first_rows(rows: DataFrame, limit: int) -> DataFrame:
    """Of rows(id, y, text) at most limit, the first by a hash of the id, then id, y and a hash of the text; equal rows
    are one. Only keys are ranked; texts are read again for the few rows that stay."""
    keyed = rows.withColumn("_t", F.xxhash64("text"))
    keys = keyed.select("id", "y", "_t").distinct().orderBy(F.xxhash64("id"), "id", "y", "_t").limit(limit)
    return keyed.join(F.broadcast(keys), ["id", "y", "_t"]).dropDuplicates(["id", "y", "_t"]).drop("_t")  # limit keys of three numbers


def per_batch(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """Map Arrow batches; start() runs once in each task and returns the function of a batch."""
    out_schema = pa.schema(df.sparkSession.createDataFrame([], schema).toArrow().schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            got = work(batch)
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out_schema], schema=out_schema)

    return df.mapInArrow(run, schema)


def per_group(df: DataFrame, keys: list[str], schema: str, work: Callable[[dict], dict | None], parts: int | None = None) -> DataFrame:
    """work(columns of a group: numpy arrays of numbers, lists of others) -> columns of the group's result, or None.

    Rows are dealt by the keys (numbers, not null) and sorted; a task goes through its groups one after the other and
    holds a group and a batch, so many small groups cost little each. parts: tasks, where groups are few and large."""
    out_schema = pa.schema(df.sparkSession.createDataFrame([], schema).toArrow().schema)

    def columns(batch: pa.RecordBatch) -> dict:
        return {n: c.to_numpy(zero_copy_only=False) if pa.types.is_integer(c.type) or pa.types.is_floating(c.type) else c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)}

    def joined(parts: list[dict]) -> dict:
        if len(parts) == 1:
            return parts[0]
        return {n: np.concatenate([p[n] for p in parts]) if isinstance(v, np.ndarray) else [x for p in parts for x in p[n]] for n, v in parts[0].items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []  # pieces of the group that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            cols, made = columns(batch), []
            by = [cols[k] for k in keys]
            edges = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in by])) + 1
            if held and any(held[-1][k][-1] != c[0] for k, c in zip(keys, by, strict=True)):
                made.append(work(joined(held)))
                held = []
            starts = [0, *edges.tolist()]
            for low, high in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                held.append({n: c[low:high] for n, c in cols.items()})
                if high < batch.num_rows:
                    made.append(work(joined(held)))
                    held = []
            if made := [m for m in made if m]:
                yield table(made)
        if held and (last := work(joined(held))):
            yield table([last])

    def table(made: list[dict]) -> pa.RecordBatch:
        whole = joined(made)
        return pa.RecordBatch.from_arrays([pa.array(whole[f.name], f.type) for f in out_schema], schema=out_schema)

    dealt = df.repartition(*keys) if parts is None else df.repartition(parts, *keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, schema)


class Forest:
    """Union-find over arbitrary long ids in which the smallest id of a tree is its root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _forest_of_each_task(edges: DataFrame) -> DataFrame:
    """Replace the links that a task holds by stars with the same connectivity: at most one link for each vertex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
        pairs = [(x, forest.root(x)) for x in list(forest.up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        for k in range(0, len(pairs), 100_000):
            part = np.array(pairs[k : k + 100_000], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(vertex, component) of each vertex that has a link; component is the smallest vertex reachable.

    Each task first shrinks its links to a forest, then rounds of large-star and small-star follow until no link
    changes; each round is written to the shared folder. Least neighbours are pre-aggregated before their shuffle; they
    meet the links in merge joins of two plain shuffles, which Spark splits where a hub has more links than others.
    Nulls and self-links are ignored; repeated links count once; no links give an empty table."""
    e = edges.select(F.col(edges.columns[0]).cast("long").alias("u"), F.col(edges.columns[1]).cast("long").alias("v"))
    e = materialize(_forest_of_each_task(e.filter("u is not null and v is not null and u <> v")), "links")
    previous = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "low")
        large = materialize(both.filter("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        small_low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        turned = large.join(small_low.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = materialize(turned.filter("u <> v").distinct(), "links")
        # Equal sets of links have equal counts and equal sums of two independent 64-bit hashes.
        sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(38,0)")), F.lit(0)) for seed in (1, 2)]
        seen = tuple(after.agg(F.count(F.lit(1)), *sums).first())
        for old in (e, low, large, small_low):
            drop(old)
        e = after
        if seen == previous or not seen[0]:
            break
        previous = seen
    else:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    tops = e.select(F.col("v").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("component"))
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).distinct().unionByName(tops).groupBy("vertex").agg(F.min("component").alias("component"))


def keep_rows(df: DataFrame, column: str, start: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows, whole, for whose column start()'s function says true; no shuffle, no join back."""
    schema = df.schema
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = start()
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, schema)
