"""Composed stores, interval labels, process depth, rings and running figures that no task holds whole."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigilspark import queries as Q
from vigilspark.functions import encode as E
from vigilspark.operators import prepare as R
from vigilspark.operators import windows as W
from vigilspark.plans import compose as C
from vigilspark.plans.campaign import campaign_errors
from vigilspark.sources.store import EVENT_SCHEMA, EventStore, attack_pools, page

T0 = datetime(2026, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def ev(spark, sf_dir):
    from vigilspark.adapter import event_view

    return event_view(spark, sf_dir)


def test_composed_stores_open_page_and_validate(spark, ev, tmp_path):
    from vigilspark.operators.validate import run_checks

    config = C.CompositionConfig(40 * 86400.0, distribution={"web_exploit": 0.5, "execution": 0.3, "missing": 0.2})
    attacks = ev.withColumn("src_ip", F.when(~F.col("source").startswith("ebpf_"), F.col("src_ip"))).withColumn("attack_type", F.when(F.col("is_malicious") == 1, "web_exploit"))
    made = C.compose_store(spark, ev.filter("is_malicious = 0"), attack_pools(attacks), config, str(tmp_path / "c"), benign_db="b")
    store = EventStore(spark, str(tmp_path / "c"))
    rows = store.events().orderBy("id").collect()
    assert set(store.events().columns) == {c.split()[0] for c in EVENT_SCHEMA.split(", ")}
    assert [r["id"] for r in rows] == list(range(1, made["total"] + 1)) and all(a["timestamp"] <= b["timestamp"] for a, b in zip(rows, rows[1:], strict=False))
    assert min(r["timestamp"] for r in rows) == ev.filter("is_malicious = 0").agg(F.min("timestamp")).first()[0]
    assert {r["session_id"] is None for r in rows} == {False} and any(r["parsed"] for r in rows)
    kernel = [r for r in rows if r["is_malicious"] and r["source"].startswith("ebpf_")]
    assert any(r["session_id"] == f"{r['src_ip']}:ebpf_{r['campaign_id'][-8:]}" for r in kernel) and made["attack"] == sum(r["is_malicious"] for r in rows)
    assert store.meta()["benign_db"] == "b" and store.campaigns().count() == len({r["campaign_id"] for r in rows if r["is_malicious"]})
    checks = {r["name"]: r["status"] for r in run_checks(store.events(), None, store.campaigns()).collect()}
    assert [checks[k] for k in ("temporal_order", "build_order", "campaign_boundaries", "campaign_types", "no_unlabelled")] == ["PASS"] * 5
    assert C.compose_store(spark, ev.filter("is_malicious = 0").limit(0), attack_pools(ev), config, str(tmp_path / "d"))["benign"] == 0


def test_ties_of_a_composition_go_by_source_then_place(spark):
    """Two sources and an attack at the same instants."""
    row = lambda i, source, s: (i, T0 + timedelta(seconds=s), source, f"l{i}")
    columns = "id long, timestamp timestamp_ntz, source string, raw_line string"
    benign = spark.createDataFrame([row(5, "b", 0), row(3, "a", 0), row(4, "a", 0), row(6, "b", 2), row(7, "a", 2)], columns)
    attack = spark.createDataFrame([(*row(9, "a", 50), "x", 0), (*row(8, "b", 50), "x", 1)], columns + ", pool string, pos long").withColumn("attack_type", F.lit("x"))
    plan = spark.createDataFrame([(0, "x", 3.0, 0, 2)], "campaign long, attack_type string, offset_s double, start long, size long")
    out = C.sequenced(C.merged(C.cycled(benign, 5.0), C.transplanted(attack, plan), "2026-02-01 00:00:00")).orderBy("id").collect()
    assert [(r["id"], r["source_id"], r["elapsed"]) for r in out] == [(k + 1, *x) for k, x in enumerate([(3, 0), (4, 0), (5, 0), (7, 2), (6, 2), (3, 3), (4, 3), (5, 3), (9, 3), (8, 3), (7, 5), (6, 5)])]


def test_pages_open_few_files(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"), "w")
    rows = spark.range(1, 20_001).selectExpr("id", "case id % 3 when 0 then 'syslog' else 'auth_log' end as source", "concat('l', id) as raw_line")
    store.append(C.store_rows(rows.repartitionByRange(40, "id")))
    store.write_index()
    assert store.events().inputFiles().__len__() == 80
    for after, limit, sources in [(0, 100, None), (9_990, 700, None), (9_990, 700, ["syslog"]), (19_999, 5, None), (20_000, 5, None), (-3, 1, ["none"])]:
        got = store.read_page(after, limit, sources)
        assert [r["id"] for r in got.collect()] == [r["id"] for r in page(store.events(), after, limit, sources).collect()]
        assert len(got.inputFiles()) <= 2 * (limit // 333 + 2)


def labelled(events, windows):
    out = {}
    for i, t, ip in events:
        fits = [w for w in windows if t is not None and w[1] is not None and w[2] is not None and w[1] <= t <= w[2] and (ip is None or ip in (w[3] or []))]
        w = min(fits, default=None, key=lambda w: w[0])
        out[i] = (0, None, None, 0) if w is None else (1, w[4], w[5], w[6] or 0)
    return out


WINDOWS = "idx int, start_time timestamp_ntz, end_time timestamp_ntz, source_ips array<string>, attack_type string, attack_stage string, severity int"


def test_interval_labels_against_plain_loops(spark):
    rng = random.Random(4)
    ips = [f"10.0.0.{k}" for k in range(9)]
    windows = []
    for k in range(120):
        a = T0 + timedelta(seconds=rng.randrange(-90_000, 90_000))
        length = rng.choice([-5, 0, 1, 59, 3600, 40_000])
        windows.append((k, rng.choice([a, a, a, None]), rng.choice([a + timedelta(seconds=length)] * 9 + [None]), rng.choice([ips[:3], [ips[k % 9], None, ips[k % 9]], [], None]), f"t{k}", "s", rng.choice([None, 2])))
    events = [(k, None if k % 50 == 0 else T0 + timedelta(microseconds=rng.randrange(-90_000, 90_000) * 1_000_000 + rng.choice([0, 1])), rng.choice([None, *ips])) for k in range(600)]
    d = spark.createDataFrame(events, "id long, timestamp timestamp_ntz, src_ip string")
    out = R.label_by_windows(d, spark.createDataFrame(windows, WINDOWS))
    assert "NestedLoop" not in plan_of(out) and "Cartesian" not in plan_of(out)
    assert {r["id"]: (r["is_malicious"], r["attack_type"], r["attack_stage"], r["severity"]) for r in out.collect()} == labelled(events, windows)
    none = R.label_by_windows(d, spark.createDataFrame([], WINDOWS))
    assert none.filter("is_malicious = 0 and severity = 0 and attack_type is null").count() == 600


def test_interval_labels_of_many_users(spark, tmp_path):
    """Phases take every second and every third user, beyond the first 150 and beyond one number of the address."""
    made = spark.range(6000).selectExpr("id as event_id", "timestamp_ntz'2024-01-02 00:00:00' + make_dt_interval(0, 0, cast(2 * id as int), 0) as ts", "id * 31 % 1500 as user_id", "'view' as event_type", "1.0D as value", "'{}' as props")
    made.write.parquet(str(tmp_path / "events.parquet"))
    want, d = {}, datetime(2024, 1, 2)
    for k in range(6000):
        t, user = d + timedelta(minutes=2 * k), k * 31 % 1500
        first = datetime(2024, 1, 3) <= t <= datetime(2024, 1, 5, 12) and (k % 11 == 0 or user % 2 == 0)
        second = datetime(2024, 1, 5) <= t <= datetime(2024, 1, 9) and (k % 11 == 0 or user % 3 == 0)
        want[k] = (1, "brute_force", "initial_access", 2) if first else (1, "web_exploit", "execution", 1) if second else (0, None, None, 0)
    assert {r["id"]: tuple(r)[1:] for r in Q.queries()["label_interval_join"](spark, str(tmp_path)).collect()} == want


def test_a_million_windows(spark):
    """Window k lasts a minute from minute k of the timeline, for address k % 100."""
    minute = lambda c: F.expr(f"timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, {c}, 0)")
    windows = spark.range(1_000_000).select(F.col("id").cast("int").alias("idx"), minute("cast(id as int)").alias("start_time"), minute("cast(id + 1 as int)").alias("end_time"), F.array(F.concat(F.lit("a"), (F.col("id") % 100).cast("string"))).alias("source_ips"), F.lit("t").alias("attack_type"), F.lit("s").alias("attack_stage"), F.lit(1).alias("severity"))
    events = spark.range(0, 2_000_000, 7).select("id", F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, cast(id div 2 as int), 30)").alias("timestamp"), F.concat(F.lit("a"), (F.floor(F.col("id") / 2) % 100 + F.col("id") % 2).cast("string")).alias("src_ip"))
    out = R.label_by_windows(events, windows)
    assert "NestedLoop" not in plan_of(out)
    assert out.filter("is_malicious <> 1 - id % 2").count() == 0 and out.count() == events.count()


def depths(rows):
    depth, out = {}, {}
    for stream, i, pid, ppid in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        d = depth.get((stream, ppid), 0) + 1 if ppid else 0
        if pid is not None:
            depth[stream, pid] = d
        out[stream, i] = d
    return out


@pytest.mark.parametrize("width", [3, 1 << 16])
def test_process_depth_against_plain_loops(spark, width):
    """Trees, a chain of 300, a pid that is its own parent, a parent of most rows, missing pids, a null stream."""
    rng, rows = random.Random(8), []
    for stream in (0, 1, None):
        for i in range(500):
            chain = stream == 1
            pid = i + 1 if chain and i < 300 else rng.choice([None, 7, rng.randrange(1, 30)])
            rows.append((stream, i, pid, i if chain and i < 300 else rng.choice([1, 1, 1, 0, None, 99, pid, rng.randrange(1, 30)])))
    d = spark.createDataFrame(rows, "stream_id int, id int, pid int, ppid int").repartition(3)
    out = W.process_depth(d, width=width)
    assert out.columns == ["stream_id", "id", "pid", "ppid", "depth"] and "Pandas" not in plan_of(out)
    assert {(r["stream_id"], r["id"]): r["depth"] for r in out.collect()} == depths(rows)


def test_running_figures_of_a_hot_session(spark):
    """Nine rows in ten have no session and no address; ranges of 16 ids give what one range gives."""
    rng = random.Random(9)
    rows = [(k, T0 + timedelta(seconds=rng.randrange(90)), None if k % 10 else "s", None if k % 10 > 1 else f"10.0.{k % 3}.{k % 7}", rng.choice(["u", "v", None]), rng.choice([*W.EVENT_COUNTERS, "else", None])) for k in range(800)]
    d = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, session_id string, src_ip string, username string, event_type string").repartition(3)
    rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    cut = W.session_features(d, 16)
    assert rounded(cut) == rounded(W.session_features(d))
    last = {r["id"]: r for r in cut.collect()}[799]
    hot = [r for r in rows if r[2] is None and r[3] is None]
    assert last["key"] == "unknown" and last["f00"] == len(hot) and last["f10"] == 2 and last["f11"] == 0 and last["f02"] == sum(r[5] == "auth_failure" for r in hot)


@pytest.mark.parametrize("bins", [1, 8])
def test_failed_logins_against_plain_loops(spark, bins):
    rng, rows = random.Random(3), []
    for k in range(400):
        ip = rng.choice(["1.1.1.1"] * 9 + ["2.2.2.2"])
        line = rng.choice([f"h sshd[1]: Failed password for invalid user x from {ip} port 1 ssh2", "h sshd[1]: Accepted password for x from 1.1.1.1 port 1 ssh2", f"h sshd[1]: Invalid user x from {ip}"])
        rows.append((k, None if k % 40 == 0 else T0 + timedelta(microseconds=rng.randrange(-3000, 3000) * 1_000_000), rng.choice(["auth_log", "auth_log", "syslog"]), line))
    d = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, source string, raw_line string")
    failed = [(i, t, line.split("from ")[1].split()[0]) for i, t, source, line in rows if t is not None and source == "auth_log" and "Accepted" not in line]
    want = {i: sum(ip == ip2 and timedelta(0) <= t - t2 <= timedelta(seconds=300) for _, t2, ip2 in failed) for i, t, ip in failed}
    got = {r["id"]: (r["failures"], r["action"]) for r in W.failed_logins_within(d).collect()}
    assert got == {i: (n, 3 if n >= 5 else 1 if n >= 2 else 0) for i, n in want.items()}
    keyed = spark.createDataFrame(failed, "id long, timestamp timestamp_ntz, ip string")
    assert {r["id"]: r["n"] for r in W.within_seconds(keyed, "ip", 300, "n", bins=bins).collect()} == want


@pytest.mark.parametrize(("width", "size"), [(7, 5), (1 << 16, 4096)])
def test_tails_and_observations_by_ranges(spark, width, size):
    """Ranges of a few rows give what plain loops give: rare channels, null lines, a null stream."""
    from vigilspark.domains import CHANNEL_OF_SOURCE
    from vigilspark.functions.encode import channel

    rng = random.Random(6)
    sources = [*list(CHANNEL_OF_SOURCE)[:3], "auth_log"]
    rows = [(k, rng.choice([1, 2, None]), rng.choice(sources) if k % 97 else "web_access", None if k % 13 == 0 else f"line {k} \u00e9" * rng.randrange(3)) for k in range(400)]
    d = spark.createDataFrame(rows, "id long, stream_id int, source string, raw_line string").repartition(3)
    named = {r["source"]: r["channel"] for r in d.select("source", channel(F.col("source")).alias("channel")).distinct().collect()}
    got = {r["id"]: r for r in W.text_tail(d, 4, 30, width=width).collect()}
    seen = {r["id"]: r for r in W.observations(d, 4, 30, width=width, size=size).collect()}
    lines = {}
    for k, stream, source, line in rows:
        lines.setdefault((stream, named[source]), []).append(line)
        tail = lambda c: "\n".join(x for x in lines.get((stream, c), [])[-4:] if x is not None)[-30:]  # noqa: B023, E731
        assert (got[k]["tail"], got[k]["raw_line"], got[k]["stream_id"]) == (tail(named[source]), line, stream)
        assert all(seen[k][f"tail_{c}"] == tail(c) for c in set(CHANNEL_OF_SOURCE.values()))
    assert W.text_tail(d, 1, 9).count() == W.observations(d, 1, 9).count() == 400
    assert set(W.text_tail(d).columns) == {*d.columns, "channel", "tail"}


def test_observations_join_lines_once_for_a_range(spark, ev):
    """No row joins its own lines or counts characters of plain text: both grow with rows times the tail's length."""
    plan = plan_of(W.observations(ev.select("id", "stream_id", "source", "raw_line")))
    above, below = plan.split("Generate explode(_rows", 1)
    assert "array_join" not in above and "array_join" in below


def test_tails_with_their_number_of_characters(spark):
    """Counted in characters, cut inside a line or not, with and without characters of several bytes."""
    for word in ("line", "l\u00efn\u20ac"):
        d = spark.range(40).select("id", F.lit(1).alias("stream_id"), F.lit("syslog").alias("source"), F.concat(F.lit(word), F.col("id").cast("string")).alias("raw_line"))
        got = {r["id"]: (r["tail"], r["n"]) for r in W.text_tail(d, 5, 23, count="n").collect()}
        for k in range(40):
            tail = "\n".join(f"{word}{j}" for j in range(max(0, k - 4), k + 1))[-23:]
            assert got[k] == (tail, len(tail))


def plain_murmur3(raw, h):
    turned = lambda x, n: (x << n | x >> 32 - n) % 2**32
    mixed = lambda k: turned(k * 0xCC9E2D51 % 2**32, 15) * 0x1B873593 % 2**32
    whole = len(raw) // 4 * 4
    for k in range(0, whole, 4):
        h = (turned(h ^ mixed(int.from_bytes(raw[k : k + 4], "little")), 13) * 5 + 0xE6546B64) % 2**32
    h ^= mixed(int.from_bytes(raw[whole:], "little")) ^ len(raw)
    h = (h ^ h >> 16) * 0x85EBCA6B % 2**32
    h = (h ^ h >> 13) * 0xC2B2AE35 % 2**32
    return h ^ h >> 16


def test_batches_of_hashes(spark):
    rng = random.Random(12)
    texts = ["", "a", "é", "abcd", "x" * 4000, *("".join(rng.choice("ab\u00e9\u6f22 ") for _ in range(rng.randrange(40))) for _ in range(500))]
    for column in (pa.array(texts), pa.array(["skip", *texts, "skip"]).slice(1, len(texts)), pa.array([], pa.string())):
        for seed in (0, 42, 2**31 + 5):
            assert E.murmur3_batch(column, seed).tolist() == [plain_murmur3(t.encode(), seed) for t in column.to_pylist()]
    d = spark.createDataFrame([(None,), ("",), ("abc",)], "t string")
    assert [r[0] for r in d.select(E.murmur3(F.col("t"), 7)).collect()] == [None, plain_murmur3(b"", 7), plain_murmur3(b"abc", 7)]


def test_hashed_features_of_a_batch(spark):
    lists = [["a", "b", "a"], [], None, ["b"], ["a_b", "c", "a", "b"]]
    want = np.zeros((5, 8))
    for row, tokens in zip(want, lists, strict=True):
        tokens = tokens or []
        for t in tokens + [f"{a}_{b}" for a, b in zip(tokens, tokens[1:], strict=False)]:
            row[plain_murmur3(t.encode(), 42) % 8] += 1 - 2 * (plain_murmur3(t.encode(), 7) % 2)
        row /= np.linalg.norm(row) or 1
    for column in (pa.array(lists), pa.array([["z"], *lists]).slice(1)):
        assert np.allclose(E.hashed_features(column, 8, (42, 7)), want)
    got = spark.createDataFrame([("a b",), (None,), ("",)], "t string").select(E.feature_hash(F.col("t"), 8).alias("v")).collect()
    assert [len(r["v"]) for r in got] == [8, 8, 8] and not any(got[1]["v"] + got[2]["v"])


def test_many_words_in_one_pass(spark):
    """The automaton finds what the search for each word finds, first rule first, with few words and with a thousand."""
    rng = random.Random(7)
    few = {"b": ["ab", "b\u00e9"], "a": ["a", "abc"], "none": ["zz"]}
    many = {f"r{j}": ["".join(rng.choice("abc") for _ in range(rng.randint(2, 7))) for _ in range(100)] for j in range(10)}
    rows = [("web_access", None), ("syslog", "ab"), ("auth_log", "")] + [(rng.choice(["web_access", "auth_log"]), "".join(rng.choice("AaBbc\u00e9 ") for _ in range(rng.randrange(9)))) for _ in range(300)]
    d = spark.createDataFrame(rows, "source string, raw_line string")
    for rules in (few, many):
        want = [None if s == "syslog" or t is None else next((n for n, ws in rules.items() if any(w in t.lower() for w in ws)), None) for s, t in rows]
        got = d.select(R.filter_rule(F.col("source"), F.col("raw_line"), rules, rules).alias("a"), R.first_rule(F.lower("raw_line"), rules).alias("b"), "source").collect()
        assert [r["a"] for r in got] == want and [r["b"] for r in got if r["source"] != "syslog"] == [w for w, (s, _) in zip(want, rows, strict=True) if s != "syslog"]
    assert [r[0] for r in d.limit(3).select(R.first_rule(F.col("raw_line"), {"all": [""]})).collect()] == [None, "all", "all"]


def test_rings_stacks_and_gaps_of_a_hot_stream(spark):
    """A stream with nine tenths of the rows, one without a name, rows without a value or a time, and gaps in the ids."""
    rng = random.Random(3)
    ids = sorted(rng.sample(range(40_000), 6_000))
    rows = [(i, rng.choices(["hot", "cold", None], [90, 8, 2])[0], None if rng.random() < 0.02 else T0 + timedelta(seconds=i * 7 % 1000), None if rng.random() < 0.05 else [float(i % 9), float(i % 4)], "x") for i in ids]
    d = spark.createDataFrame(rows, "id long, stream string, timestamp timestamp_ntz, row array<float>, seg string").repartition(5)
    values, before, rings, stacks, gaps = {}, {}, {}, {}, {}
    for i, stream, time, value, _ in rows:
        kept = values.setdefault(stream, [])
        kept.append(value)
        held = [v for v in kept[-50:] if v is not None]
        rings[i] = held + [[0.0, 0.0]] * (50 - len(held))
        held = [v for v in kept[-4:] if v is not None]
        stacks[i] = [0.0] * (8 - 2 * len(held)) + [x for v in held for x in v]
        last = before.get(stream)
        gaps[i] = (time - last).total_seconds() if time and last else 0.0
        before[stream] = time
    got = W.ring(d, "row", 2, 50, "stream", width=1000)
    assert {r["id"]: r["ring"] for r in got.collect()} == rings
    assert {r["id"]: r["stack"] for r in W.window_stack(d.withColumn("row", F.col("row").cast("array<double>")), "row", 2, 4, "stream", width=1000).collect()} == stacks
    assert {r["id"]: r["dt_seconds"] for r in W.with_gap(d, "stream", width=1000).collect()} == gaps
    assert got.columns == [*d.columns, "ring"] and W.with_gap(d, "stream").columns == [*d.columns, "dt_seconds"]
    for made in (got, W.with_gap(d, "stream")):
        windows = [line for line in plan_of(made).splitlines() if "Window [" in line]
        assert windows and all("_seg#" in line or "_p#" in line for line in windows)
    assert W.ring(d.limit(0), "row", 2, 50, "stream").count() == W.with_gap(d.limit(0), "stream").count() == 0


def test_decoded_fields(spark):
    texts = ['{"a": 1, "b": "x", "c": null, "d": {"e": [1]}}', "{}", "", None, "{'a': 1}", '{"a": 1', '{"a": 1} x', '{"a": 1} {"b": 2}', '{"a": 1}, {"b": 2}', "[1]", "7", '{"a": 1, "a": 2}']
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", E.decoded(F.col("t")).alias("f")).orderBy("k").select("f").collect()]
    assert got == [{"a": "1", "b": "x", "c": None, "d": '{"e":[1]}'}, *[{}] * (len(texts) - 1)]


PHASE = {"name": "p", "module": "m", "mitre_technique": "T1", "mitre_tactic": "t", "attack_type": "brute_force", "attack_stage": "initial_access", "severity": 2, "ip_source": {"strategy": "aliased", "count": 1, "subnet": "10.0.0.0/24"}, "timing": {"duration_seconds": 60}}


@pytest.mark.parametrize(
    ("change", "wrong"),
    [
        ({}, []),
        ({"attack_type": "x"}, ["unknown attack_type: 'x'"]),
        ({"attack_stage": "x"}, ["unknown attack_stage: 'x'"]),
        ({"severity": 4}, ["severity must be between 0 and 3"]),
        ({"severity": "high"}, ["severity must be between 0 and 3"]),
        ({"ip_source": {"strategy": "x", "count": 0}}, ["missing key: subnet", "unknown strategy: 'x'", "count must be 1 or more"]),
        ({"ip_source": 3, "timing": 4}, ["ip_source must be a mapping", "timing must be a mapping"]),
        ({"timing": {"profile": "x"}}, ["missing key: duration_seconds", "unknown profile: 'x'"]),
        ({"timing": {"duration_seconds": 1, "profile": "accelerating"}}, []),
        ({"timing": {"duration_seconds": 1, "profile": "custom"}}, ["no profile 'custom' without phases; there are ['accelerating', 'constant', 'decelerating']"]),
        ({"timing": {"duration_seconds": 1, "profile": "custom", "profile_params": {"phases": [{"label": "a", "fraction": 2, "jitter_ms": [5, 1]}, {"label": "b"}]}}}, ["segment 0: fraction must be above 0 and at most 1", "segment 0: jitter_ms must be a low and a high number", "segment 1: missing key: fraction", "segment 1: missing key: jitter_ms"]),
        ({"timing": {"duration_seconds": 1, "profile": "custom", "profile_params": {"phases": [{"label": "a", "fraction": 0.5, "jitter_ms": [1, 5]}]}}}, ["the segments' shares must add up to 1"]),
    ],
)
def test_campaign_phases(change, wrong):
    text = json.dumps({"campaign": {"name": "a", "target": {"host": "h"}, "phases": [PHASE | change], "collection": {"log_sources": [{"name": "l", "remote_path": "/x"}]}}})
    assert campaign_errors(text) == [f"phase 0: {e}" for e in wrong]


def test_campaign_files_with_missing_parts():
    phase = {k: v for k, v in PHASE.items() if k not in ("severity", "timing")}
    text = json.dumps({"campaign": {"name": "a", "target": {"host": "h"}, "phases": [phase, 3], "collection": {"log_sources": [{}]}}})
    assert campaign_errors(text) == ["phase 0: missing key: severity", "phase 0: missing key: timing", "phase 1: must be a mapping", "log source 0: missing key: name", "log source 0: remote_path or remote_command is needed"]
