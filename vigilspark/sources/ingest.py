"""Building a clean event table: ingest figures, rows carried over as benign, build report, and batches handed to a caller."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vigilspark.functions.encode import true_risk
from vigilspark.operators import parse as P
from vigilspark.operators.prepare import filter_rule, resequenced
from vigilspark.operators.windows import observations
from vigilspark.sources.files import read_lines, route


EVENT = "struct<ts:timestamp_ntz,source:string,event_type:string,src_ip:string,username:string,session_id:string,service:string,pid:int,fields:map<string,string>>"


def parsed_lines(lines: DataFrame, reference_time: str) -> DataFrame:
    """lines(path, line_no, line, parser) -> the same rows with timestamp, source, event_type, src_ip, username, session_id,
    service, pid, fields; all null (but path, line_no, line, parser) where the parser refuses a line."""
    none = lambda kind="string": F.lit(None).cast(kind)

    def event(ok, ts, source, kind, ip=None, user=None, session=None, service=None, pid=None, **fields):  # noqa: ANN001, ANN003, ANN202
        found = [c for k, v in fields.items() for c in (F.lit(k), v.cast("string"))]
        extra = F.map_filter(F.create_map(*found), lambda _, v: v.isNotNull()) if found else F.create_map().cast("map<string,string>")
        parts = {"ts": ts, "source": source, "event_type": kind, "src_ip": ip, "username": user, "session_id": session, "service": service, "pid": pid if pid is not None else none("int"), "fields": extra}
        return F.when(ok, F.struct(*[(none() if v is None else v).alias(k) for k, v in parts.items()]).cast(EVENT))

    d = lines.withColumn("_h", F.when(F.col("parser").isin("auth_log", "syslog"), P.syslog_header(F.col("line"), reference_time)))
    parsed = {"auth_log": P.auth_log(F.col("_h")), "syslog": P.syslog_event(F.col("_h"))} | {name: P.get(name)(F.col("line")) for name in ("web_access", "web_error", "journal", "ebpf")}
    for name, column in parsed.items():
        d = d.withColumn(f"_{name}", F.when(F.col("parser") == name, column))
    h, a, w, e, j, k, lit = F.col("_h"), F.col("_auth_log"), F.col("_web_access"), F.col("_web_error"), F.col("_journal"), F.col("_ebpf"), F.lit
    made = F.coalesce(
        event(a.isNotNull(), h["ts"], lit("auth_log"), a["event_type"], a["src_ip"], a["username"], a["session_id"], lit("sshd"), h["pid"], pattern=a["pattern"], port=a["port"], auth_method=a["auth_method"], preauth=F.when(a["preauth"], True), max_attempts_exceeded=F.when(a["max_attempts_exceeded"], True)),
        event(F.col("_syslog").isNotNull(), h["ts"], lit("syslog"), F.col("_syslog"), service=h["service"], pid=h["pid"], message=h["message"], sudo_user=P.sudo(h)["sudo_user"]),
        event(w.isNotNull(), w["ts"], lit("web_access"), w["event_type"], w["src_ip"], w["username"], w["session_id"], method=w["method"], path=w["path"], status=w["status"], size=w["size"], referer=w["referer"], user_agent=w["user_agent"]),
        event(e.isNotNull(), e["ts"], lit("web_error"), e["event_type"], e["src_ip"], session=e["session_id"], pid=e["pid"], module=e["module"], level=e["level"], message=e["message"], client_port=e["client_port"]),
        event(j.isNotNull(), j["ts"], lit("journal"), j["event_type"], pid=j["pid"], message=j["message"], priority=j["priority"]),
        F.when(k.isNotNull(), F.struct(k["ts"], k["source"], k["event_type"], k["src_ip"], none(), none(), none(), none("int"), k["fields"]).cast(EVENT)),
    )
    d = d.withColumn("_e", made)
    out = d.select("path", "line_no", "line", "parser", F.col("_e.ts").alias("timestamp"), *[f"_e.{c}" for c in ("source", "event_type", "src_ip", "username", "session_id", "service", "pid", "fields")])
    # Rows without a pid get a number of their own, so that they neither meet in one window nor lend each other addresses.
    # The split is by parser: a filter on parsed columns would be pushed down and parse each line anew for itself.
    looks = F.col("parser") == "auth_log"
    auth = P.enrich_by_pid(out.filter(looks).withColumn("pid", F.coalesce(F.col("pid").cast("long"), -1 - F.col("line_no"))))
    return auth.withColumn("pid", F.when(F.col("pid") >= 0, F.col("pid")).cast("int")).unionByName(out.filter(~looks))


def import_logs(spark: SparkSession, path: str, reference_time: str, source_host: str | None = None) -> DataFrame:
    """Benign events of all log files below path, each by its name's parser; refused lines keep a null source, so that
    ingest_stats() can count them. Blank lines and files without a parser are left away."""
    lines = read_lines(spark, path).withColumn("parser", route(F.col("path"))).filter("parser is not null and trim(line) <> ''")
    rows = parsed_lines(lines, reference_time)
    fields = F.col("fields") if source_host is None else F.map_concat("fields", F.create_map(F.lit("source_host"), F.lit(source_host)))
    parsed = F.to_json(F.map_concat(fields, F.create_map(F.lit("event_type"), F.col("event_type"))))
    return as_benign(rows.withColumn("parsed", F.when(F.col("source").isNotNull(), parsed)).withColumn("source_host", F.lit(source_host)).withColumnRenamed("line", "raw_line").drop("fields"))


def ingest_stats(lines: DataFrame, host: str = "source_host") -> DataFrame:
    """lines(host, path, source, raw_line; a null source was not parsed) -> host, files, parsed, filtered, kept, errors."""
    rated = lines.withColumn("_rule", filter_rule(F.col("source"), F.col("raw_line")))
    parsed, hit = F.col("source").isNotNull(), F.col("_rule").isNotNull()
    return rated.groupBy(host).agg(
        F.count_distinct("path").alias("files"), F.count_if(parsed).alias("parsed"), F.count_if(parsed & hit).alias("filtered"),
        F.count_if(parsed & ~hit).alias("kept"), F.count_if(~parsed).alias("errors"),
    )


def as_benign(events: DataFrame) -> DataFrame:
    """The rows with benign labels, whatever they had: for baselines and rows carried over from other stores."""
    labels = {"is_malicious": (0, "int"), "severity": (0, "int")} | dict.fromkeys(("campaign_id", "attack_type", "attack_stage"), (None, "string"))
    return events.withColumns({name: F.lit(value).cast(kind) for name, (value, kind) in labels.items()})


def build_report(events: DataFrame) -> DataFrame:
    """One row of figures and a row for each source: scope, n, malicious, first, last; a digest of the rows that does not
    depend on their order stands where a file's checksum would."""
    digest = F.sum(F.xxhash64("id", "timestamp", "source", "raw_line").cast("decimal(38,0)")).alias("digest")
    figures = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_malicious") == 1).alias("malicious"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), digest]
    by_source = events.groupBy(F.col("source").alias("scope")).agg(*figures)
    return by_source.unionByName(events.agg(*figures).withColumn("scope", F.lit("all")))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of the files below path, taken on the executors; each below 2 GiB, Spark's binary reader's limit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_report(spark: SparkSession, store: str, path: str, **more: object) -> dict:
    """JSON report of a store's events at path/report, the digests of their files at path/files; gives the report. more is added to it."""
    figures = [r.asDict() for r in build_report(spark.read.parquet(f"{store}/events")).collect()]  # one row a source
    total = next(r for r in figures if r["scope"] == "all")
    counts = {r["scope"]: r["n"] for r in figures if r["scope"] != "all"}
    report = {"build_date": datetime.now(timezone.utc).isoformat(), **more, "final_counts": counts, "total_events": total["n"], "digest": str(total["digest"])}
    file_digests(spark, f"{store}/events").write.mode("overwrite").json(f"{path}/files")
    spark.createDataFrame([(json.dumps(report, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")
    return report


def with_batch(events: DataFrame, size: int = 1000) -> DataFrame:
    """Rows with their batch (from 0) in order of time and id; the last batch may be shorter."""
    if size < 1:
        raise ValueError("a batch has one row at least")
    return resequenced(events).withColumn("batch", F.floor((F.col("new_id") - 1) / size)).drop("new_id")


def iter_rows(events: DataFrame, limit: int | None = None) -> Iterator[Row]:
    """Rows in order of time and id, a partition at a time on the driver."""
    ordered = events.orderBy("timestamp", "id")
    yield from (ordered if limit is None else ordered.limit(limit)).toLocalIterator()


def iter_steps(events: DataFrame, limit: int | None = None, **view: object) -> Iterator[tuple[dict, dict]]:
    """(observation, truth) of each row in order of time and id; view goes to observations()."""
    labelled = events.withColumn("true_risk", true_risk(F.col("is_malicious"), F.col("attack_stage")))
    for row in iter_rows(observations(labelled, **view), limit):
        seen = {k: row[k] for k in row.__fields__ if k.startswith(("tail_", "ring_"))}
        yield seen, {"is_malicious": row["is_malicious"] == 1} | {k: row[k] for k in ("attack_type", "attack_stage", "campaign_id", "true_risk")}


def iter_paced(rows: Iterator[Row], speed: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[Row]:
    """The rows, each as long after the one before as their times lie apart, speed times faster."""
    before = None
    for row in rows:
        if before is not None and row["timestamp"] > before:
            sleep((row["timestamp"] - before).total_seconds() / speed)
        before = row["timestamp"]
        yield row


def iter_batches(events: DataFrame, size: int = 1000, loop: bool = False) -> Iterator[list[Row]]:
    """Lists of size rows in order of time and id, the last one of a pass shorter; loop starts again at the end, unless there are no rows."""
    if size < 1:
        raise ValueError("a batch has one row at least")
    while True:
        held, any_row = [], False
        for row in iter_rows(events):
            any_row = True
            held.append(row)
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held
        if not loop or not any_row:
            return
