"""Composition of long timelines: cycled benign pools, scheduled and transplanted attack sessions, merged by time."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilspark.operators.prepare import enrich_kernel, sampled
from vigilspark.operators.windows import in_sequence, seconds_between
from vigilspark.sources.store import EVENT_SCHEMA, EventStore

EVENT_COLUMNS = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]


@dataclass(frozen=True)
class CompositionConfig:
    duration_s: float
    seed: int = 42
    per_day: float = 3.0
    distribution: dict[str, float] | None = None
    ebpf_rate: float = 1.0
    benign: str | None = None
    attacks: str | None = None
    output: str | None = None

    @classmethod
    def from_yaml(cls, text: str, folder: str = "") -> CompositionConfig:
        """The stores named in the text, if any, are taken from folder where their paths are relative."""
        import yaml

        s = (yaml.safe_load(text) or {}).get("stream")
        if not s:
            raise ValueError("missing key: stream")
        attacks = s.get("attacks", {})
        weights = {k: float(v) for k, v in attacks.get("distribution", {}).items()}
        total = sum(weights.values())
        rate = float(s.get("benign", {}).get("ebpf_sample_rate", 1.0))
        if total <= 0 or not 0 < rate <= 1:
            raise ValueError("weights must add up to more than 0 and the sample rate must be in (0, 1]")
        named = [(s.get(part) or {}).get("db") for part in ("benign", "attacks", "output")]
        paths = [p if p is None or "://" in p else os.path.join(folder, p) for p in named]
        return cls(parse_duration(str(s["duration"])), int(s.get("seed", 42)), float(attacks.get("campaigns_per_day", 3)), {k: v / total for k, v in weights.items()}, rate, *paths)


def parse_duration(text: str) -> float:
    if not (m := re.fullmatch(r"(\d+(?:\.\d+)?)\s*([dhms])", text.strip())):
        raise ValueError(f"not a duration: {text!r}")
    return float(m[1]) * {"d": 86400, "h": 3600, "m": 60, "s": 1}[m[2]]


def source_spans(benign: DataFrame) -> DataFrame:
    """source, t_min, span (1 if none), n."""
    spans = benign.groupBy("source").agg(F.min("timestamp").alias("t_min"), F.max("timestamp").alias("t_max"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    span = seconds_between(F.col("t_min"), F.col("t_max"))
    return spans.select("source", "t_min", F.when(span <= 0, 1.0).otherwise(span).alias("span"), "n", "first_id")


def cycled(benign: DataFrame, duration_s: float) -> DataFrame:
    """Every source's rows again and again, a second apart, while they fall into the duration: adds cycle, elapsed."""
    d = benign.join(F.broadcast(source_spans(benign).select("source", "t_min", "span")), "source")  # one row a source
    d = d.withColumn("rel", seconds_between(F.col("t_min"), F.col("timestamp"))).filter(F.col("rel") <= duration_s)
    cycles = F.floor((F.lit(duration_s) - F.col("rel")) / (F.col("span") + 1)).cast("int")
    return d.withColumn("cycle", F.explode(F.sequence(F.lit(0), cycles))).withColumn("elapsed", F.col("cycle") * (F.col("span") + 1) + F.col("rel")).drop("t_min", "span", "rel")


def cycle_counts(benign: DataFrame, duration_s: float) -> DataFrame:
    """source, rows that cycled() would make, without making them."""
    d = benign.join(F.broadcast(source_spans(benign).select("source", "t_min", "span")), "source").withColumn("rel", seconds_between(F.col("t_min"), F.col("timestamp"))).filter(F.col("rel") <= duration_s)
    return d.groupBy("source").agg(F.sum(F.floor((F.lit(duration_s) - F.col("rel")) / (F.col("span") + 1)) + 1).alias("n"))


def schedule(config: CompositionConfig, pool_sizes: dict[str, int], skipped: bool = False) -> list[tuple[int, str, float, int, int]]:
    """(campaign, type, offset, first pool place, size): Poisson arrivals with weighted types, then for each type that has a
    pool a third of it from a drawn place. With skipped, campaigns whose type has no pool are listed with size 0. Drawn on the driver: a few rows for each simulated day."""
    rng, draw = np.random.default_rng(config.seed), np.random.default_rng(config.seed + 1)
    types, t, out = list(config.distribution or {}), 0.0, []  # drawn in the config's order
    weights = np.array([config.distribution[k] for k in types]) if types else np.array([])
    while types and config.per_day > 0:
        t += float(rng.exponential(1.0 / (config.per_day / 86400.0)))
        if t >= config.duration_s:
            break
        kind = types[int(rng.choice(len(types), p=weights / weights.sum()))]
        n = pool_sizes.get(kind, 0)
        size = min(n, max(1, n // 3))
        if n or skipped:
            out.append((len(out), kind, t, int(draw.integers(0, n - size + 1)) if n else 0, size))
    return out


def transplanted(pools: DataFrame, planned: DataFrame) -> DataFrame:
    """Pool rows of each planned session, shifted so that the session's first row stands at its offset: adds campaign, elapsed."""
    p = pools.select("*").join(F.broadcast(planned.withColumnRenamed("attack_type", "pool")), "pool").filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("size")))
    first = F.min("timestamp").over(Window.partitionBy("campaign"))
    return p.withColumn("elapsed", F.col("offset_s") + seconds_between(first, F.col("timestamp"))).drop("start", "size", "offset_s")


def merged(benign: DataFrame, attacks: DataFrame, start: str) -> DataFrame:
    """One timeline: rows in order of time, then benign sources as first seen, attacks last, then place. All columns of an
    event stay; id is the one that a row had before."""
    kept = [c for c in EVENT_COLUMNS if c != "timestamp" and c in benign.columns and c in attacks.columns]
    columns = [*kept, "elapsed", "gen", "place"]
    order = benign.groupBy("source").agg(F.min("id").alias("gen"))
    b = benign.join(F.broadcast(order), "source").withColumn("place", F.struct(F.col("cycle").cast("long").alias("a"), F.col("id").cast("long").alias("b")))
    a = attacks.withColumn("gen", F.lit(2**62)).withColumn("place", F.struct(F.col("campaign").cast("long").alias("a"), F.col("pos").cast("long").alias("b")))
    both = b.select(*columns).unionByName(a.select(*columns))
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("elapsed").cast("decimal(18,6)"))
    return both.withColumn("timestamp", F.lit(start).cast("timestamp_ntz") + shift)


def sequenced(timeline: DataFrame) -> DataFrame:
    """merged() rows with ids 1, 2, ... in their order; the id that a row had before is source_id."""
    return in_sequence(timeline.withColumnRenamed("id", "source_id"), "timestamp", "gen", "place")


def campaigns_of(events: DataFrame) -> DataFrame:
    """A campaign for each campaign_id of attack rows: from its first to its last row, with all of its types."""
    bad = events.filter("is_malicious = 1 and campaign_id is not null")
    types = F.array_join(F.array_sort(F.collect_set("attack_type")), ",")  # attack types are a small fixed set
    found = bad.groupBy(F.col("campaign_id").alias("id")).agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), types.alias("attack_type"))
    none = F.lit(None).cast("string")
    return found.select("id", F.col("id").alias("name"), "start_time", "end_time", "attack_type", none.alias("mitre_tactics"), F.lit("composed").alias("description"), none.alias("parameters"))


def _planned(spark: SparkSession, benign: DataFrame, attack_pools: DataFrame, config: CompositionConfig) -> tuple[DataFrame, DataFrame, list, dict[str, int]]:
    """Benign rows to cycle, transplanted rows (kernel rows with their campaign's address), what was scheduled, its types."""
    sizes = {r["pool"]: r["n"] for r in attack_pools.groupBy("pool").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a type
    drawn = schedule(config, sizes, skipped=True)
    types = {k: sum(c[1] == k and c[4] > 0 for c in drawn) for k in dict.fromkeys(c[1] for c in drawn if c[4] > 0)}
    plan = spark.createDataFrame([c for c in drawn if c[4] > 0], "campaign long, attack_type string, offset_s double, start long, size long")
    rows = sampled(benign.withColumn("timestamp_text", F.col("timestamp").cast("string")), config.ebpf_rate).drop("timestamp_text")
    return rows, transplanted(enrich_kernel(attack_pools), plan), drawn, types


def _meta(config: CompositionConfig, benign_db: str, attack_db: str) -> dict[str, str]:
    return {"seed": str(config.seed), "duration_seconds": str(config.duration_s), "campaigns_per_day": str(config.per_day), "distribution": json.dumps(config.distribution), "benign_db": benign_db, "attack_db": attack_db, "composed_at": datetime.now(timezone.utc).isoformat()}


def _stats(events: DataFrame, config: CompositionConfig, drawn: list, types: dict[str, int]) -> dict[str, object]:
    r = events.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_malicious") == 1).alias("attack")).first()
    return {"total": r["total"], "attack": r["attack"], "benign": r["total"] - r["attack"], "campaigns": len(drawn), "days": config.duration_s / 86400, "types": types}


def compose(spark: SparkSession, benign: DataFrame, attack_pools: DataFrame, config: CompositionConfig, start: str, path: str, benign_db: str = "", attack_db: str = "") -> dict[str, object]:
    """Write the composed timeline as one table, ordered within and across files, beside it its meta keys, and give its
    statistics; compose_store() writes a store.

    campaigns counts all that were scheduled, types those that had a pool, by type."""
    rows, attacks, drawn, types = _planned(spark, benign, attack_pools, config)
    sequenced(merged(cycled(rows, config.duration_s), attacks, start)).write.mode("overwrite").parquet(path)
    spark.createDataFrame(sorted(_meta(config, benign_db, attack_db).items()), "key string, value string").write.mode("overwrite").parquet(f"{path.rstrip('/')}-meta")
    return _stats(spark.read.parquet(path), config, drawn, types)


def compose_store(spark: SparkSession, benign: DataFrame, attack_pools: DataFrame, config: CompositionConfig, path: str, start: str | None = None, benign_db: str = "", attack_db: str = "") -> dict[str, object]:
    """Write the composed timeline as an event store: events with all their columns and ids 1, 2, ... in order of time,
    campaigns, meta, and an index of the files. start: where the timeline begins, by default at the first benign row.
    Gives the statistics of compose()."""
    if start is None and (first := benign.agg(F.min("timestamp")).first()[0]) is not None:
        start = first.isoformat(sep=" ")
    rows, attacks, drawn, types = _planned(spark, benign, attack_pools, config)
    store = EventStore(spark, path, "w")
    timeline = merged(cycled(rows, config.duration_s), attacks, start or "1970-01-01 00:00:00")
    store.append(store_rows(sequenced(timeline)))
    store.append_campaigns(campaigns_of(store.events()))
    store.write_meta(_meta(config, benign_db, attack_db))
    store.write_index()
    return _stats(store.events(), config, drawn, types)


def store_rows(events: DataFrame) -> DataFrame:
    """The store's columns, missing ones null, sorted by source and id within each range, as the store's folders want them."""
    fields = [c.split() for c in EVENT_SCHEMA.split(", ")]
    have = set(events.columns)
    whole = events.select(*[(F.col(n) if n in have else F.lit(None)).cast(kind).alias(n) for n, kind in fields])
    return whole.sortWithinPartitions("source", "id")
