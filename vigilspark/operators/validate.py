"""Label checks and build verifications. Each gives one row: name, status, n_bad."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.functions.encode import true_risk

#: What lines of a type look like (spot check), and what clean data must not hold.
SPOT_PATTERNS = {
    "brute_force": [r"(?i)Failed password", r"(?i)Invalid user", r"(?i)res=failed", r"(?i)authentication failure", r"(?i)Connection closed.*preauth", r"(?i)Disconnected from"],
    "credential_stuffing": [r"(?i)Failed password", r"(?i)Invalid user", r"(?i)res=failed", r"(?i)authentication failure", r"(?i)Accepted password", r"(?i)Connection closed.*preauth", r"(?i)Disconnected from", r"(?i)systemd", r"(?i)session opened", r"(?i)pam_unix"],
    "web_exploit": [r"\$\{jndi:", r"(?i)jndi:ldap://", r"(?i)python-requests", r"(?i)/\?x="],
    "discovery": [r"(?i)systemd", r"(?i)session opened", r"(?i)Accepted password", r"(?i)pam_unix", r"(?i)SYN", r"(?i)connection"],
    "execution": [r"(?i)Accepted password", r"(?i)session opened", r"(?i)Started User", r"(?i)pam_unix", r"(?i)New session", r"(?i)_AUDIT_TYPE", r"(?i)_CMDLINE", r"(?i)EXECVE", r"(?i)session_finalize", r"(?i)User Runtime Directory", r"(?i)user-\d+\.slice", r"(?i)research_exploit", r"(?i)\"MESSAGE\"", r"(?i)session-\d+\.scope"],
}
ATTACK_STRINGS = ["Failed password", "Invalid user", "${jndi:", "UNION+SELECT", "../../../", "wp-login.php"]


def _row(df: DataFrame, name: str, bad: Column, failed: str = "FAIL", total: Column | None = None) -> DataFrame:
    n = df.agg(bad.cast("bigint").alias("n_bad"), (F.count(F.lit(1)) if total is None else total).alias("t"))
    status = F.when(F.col("t") == 0, "SKIP") if total is not None else F.when(F.lit(False), "")
    return n.select(F.lit(name).alias("name"), status.when(F.col("n_bad") > 0, failed).otherwise("PASS").alias("status"), "n_bad")


def label_consistency(events: DataFrame) -> DataFrame:
    bad = ((F.col("is_malicious") == 1) & (F.col("attack_type").isNull() | F.col("attack_stage").isNull() | F.col("severity").isNull())) | ((F.col("is_malicious") == 0) & (F.col("attack_type").isNotNull() | F.col("attack_stage").isNotNull()))
    return _row(events, "label_consistency", F.count_if(bad))


def spot_check(events: DataFrame, per_type: int = 50, seed: int = 42) -> DataFrame:
    """A seeded sample of lines of each type against its patterns; below 60 % fails, below 80 % warns."""
    sample = seeded_sample(events.filter(F.col("attack_type").isin(*SPOT_PATTERNS)), per_type, seed)
    hit = reduce(lambda a, b: a | b, [(F.col("attack_type") == t) & F.col("raw_line").rlike("|".join(f"(?:{p})" for p in ps)) for t, ps in SPOT_PATTERNS.items()])
    by_type = sample.groupBy("attack_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
    rated = by_type.agg(F.min(F.col("hits") / F.col("n")).alias("worst"), F.sum(F.col("n") - F.col("hits")).alias("n_bad"))
    return rated.select(F.lit("spot_check").alias("name"), F.when(F.col("worst").isNull(), "SKIP").when(F.col("worst") < 0.6, "FAIL").when(F.col("worst") < 0.8, "WARN").otherwise("PASS").alias("status"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"))


def campaign_boundaries(events: DataFrame, campaigns: DataFrame) -> DataFrame:
    c = campaigns.select(F.col("id").alias("campaign_id"), "start_time", "end_time")
    outside = (F.col("timestamp") < F.col("start_time")) | (F.col("end_time").isNotNull() & (F.col("timestamp") > F.col("end_time")))
    bad = events.join(c, "campaign_id").filter(outside)
    n = campaigns.agg(F.count(F.lit(1)).alias("t"))
    return bad.agg(F.count(F.lit(1)).alias("n_bad")).join(n).select(F.lit("campaign_boundaries").alias("name"), F.when(F.col("t") == 0, "SKIP").when(F.col("n_bad") > 0, "FAIL").otherwise("PASS").alias("status"), "n_bad")


def campaign_types(events: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Types outside their campaign's comma list, and campaigns that do not exist."""
    c = campaigns.select(F.col("id").alias("campaign_id"), F.transform(F.split("attack_type", ","), lambda t: F.trim(t)).alias("types"))
    joined = events.filter("is_malicious = 1 and campaign_id is not null").join(c, "campaign_id", "left")
    return _row(joined, "campaign_types", F.count_if(F.col("types").isNull() | ~F.coalesce(F.array_contains("types", F.col("attack_type")), F.lit(False))))


def target_consistency(truth: DataFrame, sample: int = 10_000) -> DataFrame:
    rows = truth.orderBy("id").limit(sample)
    bad = ((F.col("is_malicious") == 1) & (F.col("attack_type").isNull() | F.col("attack_stage").isNull())) | ((F.coalesce("is_malicious", F.lit(0)) == 0) & (F.col("attack_type").isNotNull() | F.col("attack_stage").isNotNull())) | ~F.col("true_risk").between(0, 10)
    return _row(rows, "target_consistency", F.count_if(bad))


def attack_distribution(events: DataFrame, expected: dict[str, float]) -> DataFrame:
    """Share of each expected type: missing fails, outside half to double (1 at most) warns."""
    total = sum(expected.values())
    counts = events.filter("is_malicious = 1").groupBy("attack_type").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
    want = events.sparkSession.createDataFrame([(k, v / total) for k, v in expected.items()], "attack_type string, want double")
    j = want.join(counts, "attack_type", "left").select("attack_type", F.coalesce("n", F.lit(0)).alias("n"), F.round("share", 6).alias("share"), F.when(F.col("n").isNull(), "FAIL").when((F.col("share") < F.col("want") / 2) | (F.col("share") > F.least(F.lit(1.0), F.col("want") * 2)), "WARN").otherwise("PASS").alias("status"))
    return j


def temporal_order(events: DataFrame, name: str = "temporal_order", failed: str = "FAIL", width: int = 1 << 20) -> DataFrame:
    """Rows earlier than their predecessor by id. Ids are dealt into ranges of width, and a range's first row meets the last one
    of the range before through a small table, so no window holds all rows."""
    part = events.withColumn("_p", F.floor(F.col("id") / width))
    w = Window.partitionBy("_p").orderBy("id")
    inside = part.select("_p", "timestamp", F.lag("timestamp").over(w).alias("before")).agg(F.count_if(F.col("timestamp") < F.col("before")).alias("n"))
    edges = part.groupBy("_p").agg(F.min_by("timestamp", "id").alias("first"), F.max_by("timestamp", "id").alias("last")).withColumn("before", F.lag("last").over(Window.orderBy("_p")))
    across = edges.agg(F.count_if(F.col("first") < F.col("before")).alias("n"))
    return inside.unionByName(across).agg(F.sum("n").alias("n_bad")).select(F.lit(name).alias("name"), F.when(F.col("n_bad") > 0, failed).otherwise("PASS").alias("status"), "n_bad")


def no_unlabelled(events: DataFrame) -> DataFrame:
    return _row(events, "no_unlabelled", F.count_if(F.col("is_malicious").isNull()))


def mixed_sessions(events: DataFrame) -> DataFrame:
    """Sessions with both labels; unlabelled rows do not count."""
    return events.filter("session_id is not null").groupBy("session_id").agg(F.count_if(F.col("is_malicious") == 1).alias("malicious"), F.count_if(F.col("is_malicious") == 0).alias("benign")).filter("malicious > 0 and benign > 0")


def session_coherence(events: DataFrame) -> DataFrame:
    return _row(mixed_sessions(events), "session_coherence", F.count(F.lit(1)))


def strings_absent(events: DataFrame, patterns: list[str], name: str, failed: str = "FAIL", columns: tuple[str, ...] = ("raw_line", "parsed")) -> DataFrame:
    """Rows of which one of the columns holds a pattern, without ASCII case."""
    hit = F.lit(False)
    for p in patterns:
        like = "%" + p.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        for c in columns:
            hit = hit | F.coalesce(F.col(c).ilike(like), F.lit(False))
    return _row(events, name, F.count_if(hit)) if patterns else _row(events.limit(0), name, F.lit(0).cast("bigint") + F.count(F.lit(1)), total=F.count(F.lit(1)))


def all_benign(events: DataFrame) -> DataFrame:
    return _row(events, "all_benign", F.count_if(F.col("is_malicious") != 0))


def source_distribution(events: DataFrame) -> DataFrame:
    """Never fails: names the sources."""
    n = events.agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("detail"))
    return n.select(F.lit("source_distribution").alias("name"), F.lit("PASS").alias("status"), "detail")


def event_count(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).cast("string").alias("detail")).select(F.lit("event_count").alias("name"), F.lit("PASS").alias("status"), "detail")


def strings_left(events: DataFrame, patterns: list[str]) -> DataFrame:
    """A row for each string that a scrub should have removed: how many rows still hold it, all counted in one scan; warns only."""
    held = [F.count_if(F.contains(F.lower("raw_line"), F.lit(p.lower())) | F.coalesce(F.contains(F.lower("parsed"), F.lit(p.lower())), F.lit(False))).alias(f"n{k}") for k, p in enumerate(patterns)]
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"n{k}").alias("n_bad")) for k, p in enumerate(patterns)]))
    return events.agg(*held).select(rows.alias("r")).select("r.pattern", F.when(F.col("r.n_bad") > 0, "WARN").otherwise("PASS").alias("status"), "r.n_bad")


def seeded_sample(events: DataFrame, per_type: int = 50, seed: int = 42) -> DataFrame:
    """per_type malicious rows of each type, the first by a seeded digest of the id: the same rows on every run."""
    order = Window.partitionBy("attack_type").orderBy(F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))), 256))
    return events.filter("is_malicious = 1").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_type)


#: Checks of the event table by name.
CHECKS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "label_consistency": label_consistency, "spot_check": spot_check, "temporal_order": temporal_order,
    "no_unlabelled": no_unlabelled, "session_coherence": session_coherence, "all_benign": all_benign,
    "no_attack_content": lambda e: strings_absent(e, ATTACK_STRINGS, "no_attack_content", columns=("raw_line",)),
    "target_consistency": lambda e: target_consistency(e.withColumn("true_risk", true_risk(F.col("is_malicious"), F.col("attack_stage")))),
    "build_order": lambda e: temporal_order(e, "build_order", "WARN"),
    "source_distribution": lambda e: _as_report(source_distribution(e)), "event_count": lambda e: _as_report(event_count(e)),
}
#: Checks that need the campaigns, the expected shares of types or the strings that a scrub removes.
CAMPAIGN_CHECKS = {"campaign_boundaries": campaign_boundaries, "campaign_types": campaign_types}


def _as_report(row: DataFrame) -> DataFrame:
    return row.select("name", "status", F.lit(0).cast("bigint").alias("n_bad"))


def _worst(rows: DataFrame, name: str) -> DataFrame:
    """One report row of several: the worst status, how many are not passed."""
    rank = F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0))
    r = rows.agg(rank.alias("rank"), F.count_if(F.col("status") != "PASS").alias("n_bad"))
    return r.select(F.lit(name).alias("name"), F.when(F.col("rank") == 2, "FAIL").when(F.col("rank") == 1, "WARN").otherwise("PASS").alias("status"), "n_bad")


def available(campaigns: bool = True, expected: bool = True, scrubbed: bool = True) -> list[str]:
    return [*CHECKS, *(CAMPAIGN_CHECKS if campaigns else ()), *(["attack_distribution"] if expected else ()), *(["pii_absent", "scrub_left"] if scrubbed else ())]


def run_checks(events: DataFrame, names: list[str] | None = None, campaigns: DataFrame | None = None, expected: dict[str, float] | None = None, scrubbed: list[str] | None = None) -> DataFrame:
    """One report row (name, status, n_bad) for each check; without names all whose inputs are given."""
    known = available()
    if unknown := [n for n in names or () if n not in known]:
        raise ValueError(f"no check {unknown[0]!r}; there are {known}")

    def one(name: str) -> DataFrame:
        if name in CHECKS:
            return CHECKS[name](events)
        needed = {"attack_distribution": expected, "pii_absent": scrubbed, "scrub_left": scrubbed}.get(name, campaigns)
        if needed is None:
            raise ValueError(f"check {name!r} lacks its input")
        if name in CAMPAIGN_CHECKS:
            return CAMPAIGN_CHECKS[name](events, campaigns)
        if name == "attack_distribution":
            return _worst(attack_distribution(events, expected), name)
        return strings_absent(events, scrubbed, name) if name == "pii_absent" else _worst(strings_left(events, scrubbed), name)

    wanted = names or available(campaigns is not None, expected is not None, scrubbed is not None)
    return reduce(DataFrame.unionByName, [one(n) for n in wanted])
