"""The event table as Parquet: scans, appends, ranges, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.operators.windows import numbered

EVENT_SCHEMA = (
    "id long, timestamp timestamp_ntz, source string, raw_line string, parsed string, is_malicious int, campaign_id string, "
    "attack_type string, attack_stage string, severity int, session_id string, src_ip string, username string, service string"
)
CAMPAIGN_SCHEMA = "id string, name string, start_time timestamp_ntz, end_time timestamp_ntz, attack_type string, mitre_tactics string, description string, parameters string"


class EventStore:
    """A folder of Parquet tables: events (partitioned by source), campaigns, meta. mode 'w' starts anew."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "r") -> None:
        if mode not in ("r", "a", "w"):
            raise ValueError(f"mode must be r, a or w, not {mode!r}")
        self.spark, self.path, self.mode = spark, path.rstrip("/"), mode
        if mode == "w":
            spark.createDataFrame([], EVENT_SCHEMA).write.mode("overwrite").partitionBy("source").parquet(f"{self.path}/events")
            spark.createDataFrame([], CAMPAIGN_SCHEMA).write.mode("overwrite").parquet(f"{self.path}/campaigns")

    def _writable(self) -> None:
        if self.mode == "r":
            raise PermissionError("the store is open for reading only")

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENT_SCHEMA).parquet(f"{self.path}/events")

    def campaigns(self) -> DataFrame:
        return self.spark.read.schema(CAMPAIGN_SCHEMA).parquet(f"{self.path}/campaigns").orderBy("start_time", "id")

    def append(self, events: DataFrame) -> None:
        """events in EVENT_SCHEMA without order; ids are given by the caller (see resequenced)."""
        self._writable()
        events.withColumn("parsed", with_event_type(F.col("parsed"), F.col("event_type"))).drop("event_type").write.mode("append").partitionBy("source").parquet(f"{self.path}/events") if "event_type" in events.columns else events.write.mode("append").partitionBy("source").parquet(f"{self.path}/events")

    def append_campaigns(self, campaigns: DataFrame) -> None:
        """campaigns in CAMPAIGN_SCHEMA; parameters given as a struct or a map are written as JSON, empty ones as null."""
        self._writable()
        if isinstance(kind := campaigns.schema["parameters"].dataType, (T.StructType, T.MapType)):
            text = F.to_json("parameters")
            none = F.size("parameters") == 0 if isinstance(kind, T.MapType) else text == "{}"
            campaigns = campaigns.withColumn("parameters", F.when(none, None).otherwise(text))
        campaigns.write.mode("append").parquet(f"{self.path}/campaigns")

    def write_index(self) -> None:
        """A small table of each file's least and greatest id and number of rows; read_page() opens only files that it
        names. To be written anew after append()."""
        self._writable()
        files = self.events().groupBy(F.col("_metadata.file_path").alias("path"), "source").agg(F.min("id").alias("least"), F.max("id").alias("greatest"), F.count(F.lit(1)).alias("n"))
        files.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index")

    def read_page(self, after: int = 0, limit: int = 1000, sources: list[str] | None = None) -> DataFrame:
        """The next rows by id after a cursor, as page() gives them, from the files that can hold them: those whose least id is
        not beyond the id at which limit rows are sure. The index has a row for each file; files appended after
        write_index() are not seen."""
        index = self.spark.read.parquet(f"{self.path}/index")
        known = [r.asDict() for r in (index if sources is None else index.filter(F.col("source").isin(sources))).filter(F.col("greatest") > after).orderBy("greatest", "path").collect()]
        # Files wholly beyond the cursor, the one that ends first taken first, give limit rows up to some id.
        sure, end = 0, None
        for f in known:
            sure += f["n"] if f["least"] > after else 0
            if sure >= limit:
                end = f["greatest"]
                break
        wanted = [f["path"] for f in known if end is None or f["least"] <= end]
        if not wanted:
            return self.events().limit(0)
        rows = self.spark.read.schema(EVENT_SCHEMA).option("basePath", f"{self.path}/events").parquet(*wanted)
        return page(rows if end is None else rows.filter(F.col("id") <= end), after, limit, sources)

    def write_meta(self, meta: dict[str, str]) -> None:
        self._writable()
        self.spark.createDataFrame(sorted(meta.items()), "key string, value string").write.mode("overwrite").parquet(f"{self.path}/meta")

    def meta(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.spark.read.parquet(f"{self.path}/meta").collect()}


def with_event_type(parsed: Column, event_type: Column) -> Column:
    """JSON text with event_type set where it is missing; null and empty objects become the one field."""
    missing = F.get_json_object(parsed, "$.event_type").isNull() & event_type.isNotNull()
    text = F.regexp_extract(F.to_json(F.struct(event_type.alias("e"))), r'^\{"e":(.*)\}$', 1)  # with its quotation marks, escaped
    field = F.concat(F.lit('"event_type": '), text, F.lit("}"))
    body = F.regexp_replace(parsed, r"\s*\}\s*$", "")
    return F.when(missing & (parsed.isNull() | parsed.rlike(r"^\s*\{\s*\}\s*$")), F.concat(F.lit("{"), field)).when(missing, F.concat(body, F.lit(", "), field)).otherwise(parsed)


def union_of(stores: list[EventStore]) -> DataFrame:
    """The events of several stores under new ids in order of time, with store (its place in the list) beside them."""
    from functools import reduce

    from vigilspark.operators.prepare import resequenced

    rows = reduce(DataFrame.unionByName, [s.events().withColumn("store", F.lit(k)) for k, s in enumerate(stores)])
    return resequenced(rows, ("timestamp", "store", "id")).drop("id").withColumnRenamed("new_id", "id")


def page(events: DataFrame, after: int = 0, limit: int = 1000, sources: list[str] | None = None) -> DataFrame:
    """The next rows by id after a cursor; both predicates reach the scan."""
    rows = events.filter(F.col("id") > after)
    return (rows.filter(F.col("source").isin(sources)) if sources is not None else rows).orderBy("id").limit(limit)


def remaining(events: DataFrame, after: int = 0) -> DataFrame:
    return events.filter(F.col("id") > after).agg(F.count(F.lit(1)).alias("n"))


def time_range(events: DataFrame) -> DataFrame:
    return events.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def distinct_sources(events: DataFrame) -> DataFrame:
    return events.select("source").distinct().orderBy("source")


def attack_pools(events: DataFrame) -> DataFrame:
    """Malicious rows with their pool (attack type, 'unknown' if missing) and place in it by time."""
    rows = events.filter("is_malicious = 1").withColumn("pool", F.coalesce(F.nullif("attack_type", F.lit("")), F.lit("unknown")))
    return numbered(rows, "pos", keys=("pool",)).withColumn("pos", F.col("pos") - 1)
