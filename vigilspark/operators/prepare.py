"""Preparation: malicious-content filter, scrubbing, interval labels, enrichment, migration, sampling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark import domains as D
from vigilspark.functions.encode import mapped
from vigilspark.operators.windows import numbered
from vigilspark.sources.store import with_event_type


def first_rule(text: Column, rules: dict[str, list[str]]) -> Column:
    """Name of the first rule of which the text holds a word, null without one. The words of all rules are one automaton,
    built once in each task, which goes through a text once however many words there are. Empty words are in every text."""
    names = list(rules)
    place: dict[str, int] = {}
    for k, words in enumerate(rules.values()):
        for w in words:
            place.setdefault(w, k)
    always = place.pop("", len(names))

    @F.arrow_udf("string")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w, k in place.items():
            machine.add_word(w, k)
        machine.make_automaton()
        for texts in batches:
            out: list[str | None] = []
            for t in texts.to_pylist():
                least = len(names) if t is None else always
                if t and place:
                    least = min(least, min((k for _, k in machine.iter(t)), default=least))
                out.append(names[least] if least < len(names) else None)
            yield pa.array(out, pa.string())

    return found(text)


#: Words from which one automaton is used instead of a search for each word.
MANY_WORDS = 64


def filter_rule(source: Column, line: Column, web: dict[str, list[str]] = D.WEB_FILTERS, auth: dict[str, list[str]] = D.AUTH_FILTERS) -> Column:
    """Name of the first rule whose words the line holds, without case (words are in lower case); null keeps the row. The
    words are one constant array, so that the expression stays small wherever it is repeated."""

    def first(rules: dict[str, list[str]]) -> Column:
        if sum(map(len, rules.values())) > MANY_WORDS:
            return first_rule(F.lower(line), rules)
        words = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(w).alias("word")) for name, ws in rules.items() for w in ws])
        return F.get(F.transform(F.array(F.lower(line)), lambda low: F.get(F.filter(words, lambda w: F.contains(low, w["word"])), F.lit(0))["rule"]), F.lit(0))

    return F.when(source.isin("web_access", "web_error"), first(web)).when(source == "auth_log", first(auth))


def malicious_addresses(events: DataFrame) -> DataFrame:
    return events.filter(filter_rule(F.col("source"), F.col("raw_line")).isNotNull() & F.col("src_ip").isNotNull()).select("src_ip").distinct()


def without_addresses(events: DataFrame, addresses: DataFrame) -> DataFrame:
    """Kernel rows carried over: network rows from the addresses go, rows without an address stay."""
    kernel = events.filter(F.col("source").startswith("ebpf_"))
    network = kernel.filter("source = 'ebpf_network'").join(addresses, "src_ip", "left_anti").select(*events.columns)
    return kernel.filter("source <> 'ebpf_network'").unionByName(network)


@dataclass(frozen=True)
class ScrubConfig:
    """replacements: (old, new), matched without case; hostname_regexes: (pattern, replacement, label); verify_patterns."""

    replacements: list[tuple[str, str]] = field(default_factory=list)
    hostname_regexes: list[tuple[str, str, str]] = field(default_factory=list)
    verify_patterns: list[str] = field(default_factory=list)

    @classmethod
    def from_json(cls, text: str) -> ScrubConfig:
        import json

        raw = json.loads(text)
        return cls([tuple(r) for r in raw.get("replacements", [])], [(r["pattern"], r["replacement"], r["label"]) for r in raw.get("hostname_regexes", [])], list(raw.get("verify_patterns", [])))


def _literal(text: str) -> str:
    return "(?i)" + "".join("\\" + c if not c.isalnum() and c != " " else c for c in text)


def scrubbed(text: Column, config: ScrubConfig) -> Column:
    for old, new in config.replacements:
        text = F.regexp_replace(text, _literal(old), new.replace("\\", "\\\\").replace("$", "\\$"))
    for pattern, replacement, _ in config.hostname_regexes:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def replaced(text: Column, replacements: list[tuple[str, str]]) -> Column:
    """Case-sensitive replacement in order, as for carried-over kernel rows."""
    for old, new in replacements:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def scrub_counts(events: DataFrame, config: ScrubConfig) -> DataFrame:
    """rule, n: rows whose raw line each rule changes, in order."""
    line, hits = F.col("raw_line"), []
    for old, new in config.replacements:
        hits.append((old, line.rlike(_literal(old))))
        line = F.regexp_replace(line, _literal(old), new)
    for pattern, replacement, label in config.hostname_regexes:
        hits.append((label, line.rlike(pattern)))
        line = F.regexp_replace(line, pattern, replacement)
    counted = events.agg(*[F.count_if(h).alias(f"c{k}") for k, (_, h) in enumerate(hits)])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"c{k}").alias("n")) for k, (n, _) in enumerate(hits)])).alias("r")).select("r.*")


def label_by_windows(events: DataFrame, windows: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """Label rows by closed time windows and address sets (windows: idx, start_time, end_time, source_ips, attack_type,
    attack_stage, severity); the first window that fits counts, a row without address fits by time alone. Any number of
    windows; events have to be a deterministic scan, which is read twice. Sets too large for an array, or found in a table,
    come as addresses (idx, src_ip), beside those in source_ips.

    A window's level is the binary order of its length in seconds, and time is cut into bins as long as that, so that a
    window lies in two bins at most. Windows are dealt by level, bin and each of their addresses, and once more for rows
    without an address; events are dealt by their bin at each level that there is. Both meet in an equi-join."""
    us = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c))
    w = windows.select("idx", us("start_time").alias("_low"), us("end_time").alias("_high"), "source_ips").filter("_low <= _high")
    w = w.withColumn("_level", F.ceil(F.log2((F.col("_high") - F.col("_low")) / 1e6 + 1)).cast("int"))
    bin_of = lambda t: F.floor(t / (F.pow(F.lit(2.0), F.col("_level")) * 1e6))
    listed = F.filter(F.array_distinct(F.coalesce("source_ips", F.array().cast("array<string>"))), lambda x: x.isNotNull())
    named = F.transform(listed, lambda a: F.struct(F.lit(False).alias("any"), a.alias("ip")))
    binned = w.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of(F.col("_low")), bin_of(F.col("_high"))))))
    dealt = binned.select("idx", "_low", "_high", "_level", "_bin", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("any"), F.lit("").alias("ip"))), named)).alias("_to"))
    dealt = dealt.select("idx", "_low", "_high", "_level", "_bin", F.col("_to.any").alias("_any"), F.col("_to.ip").alias("_ip"))
    if addresses is not None:
        more = binned.join(addresses.filter("src_ip is not null").select("idx", F.col("src_ip").alias("_ip")), "idx")
        dealt = dealt.unionByName(more.select("idx", "_low", "_high", "_level", "_bin", F.lit(False).alias("_any"), "_ip"))
    levels = [r["_level"] for r in w.select("_level").distinct().collect()]  # 64 rows at most
    rows = events.withColumn("_row", F.monotonically_increasing_id())
    asks = rows.select("_row", us("timestamp").alias("_us"), F.col("src_ip").isNull().alias("_any"), F.coalesce("src_ip", F.lit("")).alias("_ip"))
    asks = asks.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", bin_of(F.col("_us")))
    met = asks.join(dealt, ["_level", "_bin", "_any", "_ip"]).filter("_us >= _low and _us <= _high")
    first = met.groupBy("_row").agg(F.min("idx").alias("idx")).join(windows.select("idx", *[F.col(c).alias(f"_{c}") for c in ("attack_type", "attack_stage", "severity")]), "idx").drop("idx")
    joined = rows.join(first.withColumn("_hit", F.lit(1)), "_row", "left")
    labels = {"is_malicious": F.coalesce("_hit", F.lit(0)), "attack_type": F.col("_attack_type"), "attack_stage": F.col("_attack_stage"), "severity": F.coalesce("_severity", F.lit(0))}
    return joined.withColumns(labels).drop("_row", "_hit", "_attack_type", "_attack_stage", "_severity")


def escalate_by_audit(events: DataFrame, audit: DataFrame) -> DataFrame:
    """Malicious rows whose second an audit record shares get severity 3 at least."""
    seconds = audit.select(F.col("ts").alias("timestamp")).distinct().withColumn("_seen", F.lit(True))
    bad = F.coalesce(F.col("is_malicious") == 1, F.lit(False))  # only these rows are dealt by time
    joined = events.filter(bad).join(seconds, "timestamp", "left")
    raised = joined.withColumn("severity", F.when(F.col("_seen"), F.greatest("severity", F.lit(3))).otherwise(F.col("severity")))
    return raised.select(*events.columns).unionByName(events.filter(~bad))


def dominant_address(events: DataFrame) -> DataFrame:
    """attack_type, campaign_id, src_ip: the most frequent address of a campaign's log rows, of equals the first seen."""
    logs = events.filter("is_malicious = 1 and not startswith(source, 'ebpf_') and src_ip is not null and src_ip not in ('', '0.0.0.0')")
    counted = logs.groupBy("attack_type", "campaign_id", "src_ip").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return counted.groupBy("attack_type", "campaign_id").agg(F.max_by("src_ip", F.struct("n", -F.col("first"))).alias("src_ip"), F.max("n").alias("n"))


def enrich_kernel(events: DataFrame) -> DataFrame:
    """Kernel rows of attacks without an address take their campaign's dominant one, and a session named after both."""
    top = dominant_address(events).select("attack_type", "campaign_id", F.col("src_ip").alias("_ip"))
    lacks = F.coalesce(F.col("source").startswith("ebpf_") & (F.col("is_malicious") == 1) & F.coalesce("src_ip", F.lit("")).isin("", "0.0.0.0"), F.lit(False))
    # Only rows that lack an address are joined: the others have null keys, which would meet in one task.
    joined = events.filter(lacks).join(top, ["attack_type", "campaign_id"], "left")
    session = F.concat("_ip", F.lit(":ebpf_"), F.right("campaign_id", F.lit(8)))
    filled = joined.withColumn("session_id", F.when(F.col("_ip").isNotNull(), session).otherwise(F.col("session_id"))).withColumn("src_ip", F.coalesce("_ip", "src_ip"))
    return filled.select(*events.columns).unionByName(events.filter(~lacks))


def backfill(events: DataFrame) -> DataFrame:
    """Fill address and session of sshd rows that lack both from the last row of their pid that has both."""
    pid = F.nullif(F.regexp_extract("raw_line", r"sshd\[(\d+)\]", 1), F.lit(""))
    rows = events.withColumn("_pid", F.when(F.col("source") == "auth_log", pid))
    last = rows.filter("_pid is not null and src_ip <> '' and session_id <> ''").groupBy("_pid").agg(F.max_by(F.struct("src_ip", "session_id"), "id").alias("_v"))
    lacks = F.col("src_ip").isNull() & F.col("session_id").isNull() & F.col("_pid").isNotNull()
    filled = rows.filter(lacks).join(last, "_pid", "left").withColumns({"src_ip": F.col("_v.src_ip"), "session_id": F.col("_v.session_id")})
    return filled.select(*events.columns).unionByName(rows.filter(~lacks).select(*events.columns))


def with_event_types(events: DataFrame) -> DataFrame:
    """Give parsed JSON that lacks it an event type: sshd rows by their pattern, web rows by their source."""
    pattern = F.get_json_object("parsed", "$.pattern")
    kinds = {name: kind for name, _, kind, _ in D.AUTH_PATTERNS}
    web = F.when(F.col("source") == "web_error", "http_error").when(F.col("source") == "web_access", "http_request")
    kind = F.when(F.col("source") == "auth_log", mapped(pattern, kinds, None)).otherwise(web)
    return events.withColumn("parsed", F.when(F.col("parsed").isNotNull(), with_event_type(F.col("parsed"), kind)))


def label_stats(labelled: DataFrame) -> DataFrame:
    """total, malicious, benign, audit_confirmed (attacks of severity 3 or more) of labelled rows."""
    bad = F.col("is_malicious") == 1
    return labelled.agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("malicious"), F.count_if(F.col("is_malicious") == 0).alias("benign"), F.count_if(bad & (F.col("severity") >= 3)).alias("audit_confirmed"))


def sampled(events: DataFrame, rate: float, time_text: str = "timestamp_text") -> DataFrame:
    """Keep kernel rows whose sha256 of time text, source and line, as a number modulo 1000, is below rate x 1000."""
    if rate >= 1:
        return events
    digest = F.sha2(F.concat_ws("|", time_text, "source", "raw_line"), 256)
    words = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(8)]
    rest = F.lit(0).cast("bigint")
    for w in words:
        rest = (rest * (2**32 % 1000) + w) % 1000
    return events.filter(~F.col("source").startswith("ebpf_") | (rest < int(rate * 1000)))


def in_window(events: DataFrame, start: str, end: str, buffer_s: int = 0, bsd_offset_s: int = 0) -> DataFrame:
    """Rows from start - buffer to end + buffer; sources that log local time are read with their host's offset and
    come back in UTC."""
    local = F.col("source").isin("auth_log", "syslog")
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.when(local, bsd_offset_s).otherwise(0).cast("decimal(18,6)"))
    utc = events.withColumn("timestamp", F.col("timestamp") - shift)
    lo, hi = F.lit(start).cast("timestamp_ntz") - F.expr(f"interval {buffer_s} seconds"), F.lit(end).cast("timestamp_ntz") + F.expr(f"interval {buffer_s} seconds")
    return utc.filter((F.col("timestamp") >= lo) & (F.col("timestamp") <= hi))


def resequenced(events: DataFrame, order: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    """Ids 1, 2, ... by time, then id; rows without a time first."""
    return numbered(events, "new_id", order)
