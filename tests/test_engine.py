import os

import duckdb
import pytest
from pyspark.sql import functions as F

from vigilspark import queries as Q
from vigilspark.functions import encode as E
from vigilspark.operators import parse as P
from vigilspark.operators import windows as W
from vigilspark.plans.compose import CompositionConfig, parse_duration, schedule
from vigilspark.plans.campaign import campaign_errors
from vigilspark.sources import ingest
from vigilspark.sources.store import EVENT_SCHEMA, EventStore, page
from vigilspark.streaming import live, replay

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_agrees_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{sf_dir}/events.parquet'")
    got = Q.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.sql(Q.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want.project(",".join(columns)).fetchall())


def test_whole_queries_against_brute_force(spark, sf_dir):
    """Queries that the SQL covers as well, against plain loops over every row."""
    from vigilspark.adapter import event_view

    rows = [r.asDict() for r in event_view(spark, sf_dir).orderBy("id").collect()]
    run = lambda name: Q.queries()[name](spark, sf_dir).collect()
    assert {(r["id"], r["type"], r["key"]) for r in run("parse_audit")} == {(r["id"], "SYSCALL", f"key{r['id'] % 3}") for r in rows}
    last, want = {}, {}
    for r in rows:
        t, trace = last.get(r["stream_id"], (r["timestamp"], 0.0))
        trace = trace * 0.95 ** ((r["timestamp"] - t).total_seconds() / 1e3) + r["value"]
        last[r["stream_id"]], want[r["id"]] = (r["timestamp"], trace), trace
    got = {r["id"]: r["trace"] for r in run("decay_trace")}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)
    pools, cycles = {}, {}
    for r in rows:
        if r["is_malicious"] == 0:
            pools.setdefault(r["source"], []).append(r)
    for source, pool in pools.items():
        first, end = min(r["timestamp"] for r in pool), max(r["timestamp"] for r in pool)
        step = ((end - first).total_seconds() or 1.0) + 1
        for r in pool:
            at, k = (r["timestamp"] - first).total_seconds(), 0
            while at + k * step <= 40 * 86400:
                cycles[r["id"], source, k] = at + k * step
                k += 1
    made = {(r["id"], r["source"], r["cycle"]): r["elapsed"] for r in run("cycle_rows")}
    assert made.keys() == cycles.keys() and all(made[k] == pytest.approx(cycles[k], abs=1e-5) for k in made)
    counts = {s: sum(k[1] == s for k in cycles) for s in pools}
    assert {r["source"]: r["n"] for r in run("cycle_counts")} == counts
    merged = {r["source"]: r for r in run("compose_merge") if r["is_malicious"] == 0}
    assert {s: r["n"] for s, r in merged.items()} == counts
    assert all(r["last_s"] == pytest.approx(max(v for k, v in cycles.items() if k[1] == s), abs=1e-5) for s, r in merged.items())


def test_windows_of_full_size(spark, tmp_path):
    """500 lines cut at 50,000 characters, 50 rows; lines are made long enough that the cut binds."""
    import hashlib

    from vigilspark.adapter import event_view

    made = spark.range(1300).selectExpr("3 * id + 1 as event_id", "timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as ts", "13132900 + id % 2 as user_id", "'view' as event_type", "1.0D as value", "'{}' as props")
    made.write.parquet(str(tmp_path / "events.parquet"))
    rows = [r.asDict() for r in event_view(spark, str(tmp_path)).withColumn("channel", E.channel(F.col("source"))).orderBy("id").collect()]
    lines, numbers, tails, rings, stacks = {}, {}, {}, {}, {}
    for r in rows:
        lines.setdefault((r["stream_id"], r["channel"]), []).append(r["raw_line"])
        tail = "\n".join(lines[r["stream_id"], r["channel"]][-500:])[-50_000:]
        tails[r["id"]] = (len(tail), hashlib.md5(tail.encode()).hexdigest())
        last = numbers.setdefault(r["stream_id"], [])
        last.append(str(r["id"] % 100))
        rings[r["id"]] = ",".join(last[-50:] + ["0"] * (50 - len(last)))
        stacks[r["id"]] = ",".join(["0"] * (50 - len(last)) + last[-50:])
    assert max(n for n, _ in tails.values()) == 50_000
    assert {r["id"]: (r["n"], r["digest"]) for r in Q.queries()["text_tail"](spark, str(tmp_path)).collect()} == tails
    assert {r["id"]: r["ring"] for r in Q.queries()["struct_ring"](spark, str(tmp_path)).collect()} == rings
    assert {r["id"]: r["stack"] for r in Q.queries()["window_stack"](spark, str(tmp_path)).collect()} == stacks


@pytest.mark.parametrize(("text", "seed", "want"), [("test", 0, 0xBA6BD213), ("Hello, world!", 0, 0xC0363E43), ("Hello, world!", 0x9747B28C, 0x24884CBA), ("wget", 1, 54516641), ("/tmp/payload.sh", 2, 2533371248)])
def test_murmur3_vectors(text, seed, want):
    assert E.murmur3_numpy(text, seed) == want


def test_bsd_header_rolls_back_a_year(spark):
    lines = spark.createDataFrame([("Dec 31 23:59:59 h sshd[12]: Failed password for invalid user bob from 1.2.3.4 port 5 ssh2",), ("Jan  2 00:00:01 h cron: x",), ("nonsense",)], "line string")
    rows = lines.select(P.syslog_header(F.col("line"), "2026-03-01 00:00:00").alias("h")).select("h", P.auth_log(F.col("h")).alias("a")).collect()
    assert rows[0]["h"]["ts"].year == 2025 and rows[1]["h"]["ts"].year == 2026 and rows[2]["h"] is None
    assert (rows[0]["a"]["event_type"], rows[0]["a"]["username"], rows[0]["a"]["src_ip"], rows[0]["a"]["port"]) == ("auth_failure", "bob", "1.2.3.4", "5")


def test_ebpf_last_key_wins_and_colonless_dst(spark):
    r = spark.createDataFrame([("2026-01-01T00:00:00.1Z connect pid=1 pid=2 dst=9.9.9.9",)], "l string").select(P.ebpf(F.col("l")).alias("p")).first()["p"]
    assert r["fields"]["pid"] == "2" and r["src_ip"] == "9.9.9.9" and r["source"] == "ebpf_network"


def test_registry():
    assert "auth_log" in P.available()
    with pytest.raises(KeyError):
        P.get("none")


def events(spark, labels, ip="10.9.9.9", source="auth_log"):
    rows = [(1, k, source, ip, "line", m, "initial_access" if m else None, k) for k, m in enumerate(labels)]
    return spark.createDataFrame(rows, "stream_id long, id long, source string, src_ip string, raw_line string, is_malicious int, attack_stage string, s int").withColumn("timestamp", F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)"))


def test_block_then_unblock_under_deny_log(spark):
    def policy(row, seen=[]):  # noqa: B006
        return (3 if row["id"] == 0 else 4), 0.0

    got = replay.closed_loop(events(spark, [1] * 4), policy, deny_log=True).orderBy("step").collect()
    assert got[0]["denied"] and got[0]["reward"] == pytest.approx(0.1)
    assert got[1]["reward"] == pytest.approx(-0.5)


def test_block_drops_until_the_end(spark):
    got = replay.closed_loop(events(spark, [1] * 5), lambda row: (3, 0.0)).collect()
    assert len(got) == 1 and got[0]["event_id"] is None and got[0]["dropped"] == 4 and got[0]["reward"] == pytest.approx(-1.0 + 0.4)


def test_block_ttl(spark):
    got = replay.closed_loop(events(spark, [0] * 5), lambda row: (3 if row["id"] == 0 else 0, 0.0), ttl_s=3.0).orderBy("step").collect()
    assert got[0]["event_id"] == 3 and got[0]["dropped"] == 2


def test_passing_closed_loop_equals_open_loop(spark, sf_dir):
    from vigilspark.adapter import event_view

    ev = event_view(spark, sf_dir)
    closed = replay.closed_loop(ev, lambda row: (1, 0.0)).agg(F.sum("reward"), F.count("*")).first()
    opened = replay.open_loop(ev.withColumn("action", F.lit(1))).agg(F.sum("reward"), F.count("*")).first()
    assert closed[1] == opened[1] and closed[0] == pytest.approx(opened[0])


def test_traces_and_numbers_across_parts(spark):
    """Traces over many id ranges equal those over one; null streams and ids count; numbers go by time within keys."""
    rows = [(k if k != 7 else None, [None, "a", "b"][k % 3], [float(k % 5), 1.0], (k % 4) / 2.0) for k in range(60)]
    d = spark.createDataFrame(rows, "id long, stream_id string, row array<double>, dt_seconds double")
    got = {width: {r["id"]: r["trace"] for r in W.decaying_trace(d, "row", decay=0.9, width=width).collect()} for width in (4, 1 << 16)}
    want = {}
    for s in (None, "a", "b"):
        state = None
        for i, _, x, dt in sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is None, r[0] or 0)):
            state = x if state is None else [a * 0.9**dt + b for a, b in zip(state, x, strict=True)]
            want[i] = state
    for made in got.values():
        assert made.keys() == want.keys() and all(made[k] == pytest.approx(want[k]) for k in want)
    times = spark.range(40).selectExpr("id", "id % 2 as key", "case when id <> 5 then timestamp_ntz'1969-12-31 23:58:00' + make_dt_interval(0, 0, 0, (id * 37) % 40 * 20) end as timestamp")
    held = [r.asDict() for r in times.collect()]
    for keys in ((), ("key",)):
        made = {r["id"]: r["n"] for r in W.numbered(times, "n", keys=keys).collect()}
        for r in held:
            group = sorted((x for x in held if not keys or x["key"] == r["key"]), key=lambda x: (x["timestamp"] is not None, str(x["timestamp"]), x["id"]))
            assert made[r["id"]] == group.index(r) + 1


def test_observations_of_every_channel(spark):
    """All channels as of each row, kernel rows as rings, against plain lists; (observation, truth) pairs by time."""
    from vigilspark import domains as D
    from vigilspark.sources.ingest import iter_steps

    rows = [(k, k % 2, D.SOURCES[k * k % 7 + k % 2], f"line {k}", k % 3 % 2) for k in range(50)]
    d = spark.createDataFrame(rows, "id long, stream_id long, source string, raw_line string, is_malicious int").selectExpr("*", "timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as timestamp", "'recon' as attack_stage", "'discovery' as attack_type", "'c' as campaign_id", "1 as severity")
    number = F.array_repeat(F.col("id").cast("float"), 8)
    kernel = F.when(F.col("source").startswith("ebpf"), F.slice(number, 1, F.when(F.col("source") == "ebpf_process", 8).when(F.col("source") == "ebpf_network", 7).otherwise(6)))
    made = list(iter_steps(d.withColumn("row", kernel), lines=3, chars=14, row="row", rows=2))
    held: dict = {}
    for (seen, truth), (k, s, source, line, bad) in zip(made, rows, strict=True):
        held.setdefault((s, D.CHANNEL_OF_SOURCE[source]), []).append((k, line))
        for c in set(D.CHANNEL_OF_SOURCE.values()):
            last = held.get((s, c), [])
            if n := D.KERNEL_COLUMNS.get(c):
                assert seen[f"ring_{c}"] == [[float(i)] * n for i, _ in last[-2:]] + [[0.0] * n] * (2 - len(last[-2:]))
            else:
                assert seen[f"tail_{c}"] == "\n".join(x for _, x in last[-3:])[-14:]
        assert truth["is_malicious"] == bad and truth["true_risk"] == 3.0 * bad


def test_process_depth(spark):
    d = spark.createDataFrame([(1, 0, 1, None), (1, 1, 2, 1), (1, 2, 3, 2), (1, 3, 2, None), (1, 4, 4, 2), (1, 5, 5, 77)], "stream_id int, id int, pid int, ppid int")
    assert [r["depth"] for r in W.process_depth(d).orderBy("id").collect()] == [0, 1, 2, 0, 1, 1]


def test_schedule_is_deterministic_and_poisson():
    c = CompositionConfig(parse_duration("200d"), 7, 3.0, {"a": 0.5, "b": 0.5})
    plan = schedule(c, {"a": 10, "b": 1})
    assert plan == schedule(c, {"a": 10, "b": 1}) and 500 < len(plan) < 700
    assert all(p[3] + p[4] <= {"a": 10, "b": 1}[p[1]] for p in plan)


def test_store_round_trip(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"), "w")
    store.append(spark.createDataFrame([(2, None, "auth_log", "x", None, 1, None, None, None, None, None, None, None, None), (1, None, "syslog", "y", None, 0, None, None, None, None, None, None, None, None)], EVENT_SCHEMA))
    store.write_meta({"seed": "42"})
    again = EventStore(spark, str(tmp_path / "s"))
    assert [r["id"] for r in page(again.events()).collect()] == [1, 2] and again.meta() == {"seed": "42"}
    with pytest.raises(PermissionError):
        again.write_meta({})


def test_live_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("2026-01-01T00:00:00.1Z open pid=1\n2026-01-01T00:10:00.1Z connect pid=1 dst=1.1.1.1:2\nbad\n")
    q = live.hourly_counts(live.kernel_lines(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["source"], r["n"]) for r in spark.sql("select * from hourly").collect()} == {("ebpf_file", 1), ("ebpf_network", 1)}


def test_the_rest_works_without_llm(tmp_path):
    """A copy of the repository without the training-data folders imports, and keeps every other query."""
    import shutil
    import subprocess
    import sys

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True)
    assert got.stdout.split() == [str(len(Q.queries())), "False", "True"]


def test_bad_numbers_do_not_stop_a_job(spark):
    lines = spark.createDataFrame([("2026-01-01T00:00:00Z h sshd[99999999999]: hi",), ("[Mon Jan 05 10:00:00.1 2026] [core:error] [pid 99999999999] [client 1.2.3.4:99999999999] m",)], "line string")
    a, b = lines.select(P.syslog_header(F.col("line"), "2026-03-01 00:00:00")["pid"].alias("pid"), P.web_error(F.col("line")).alias("w")).collect()
    assert a["pid"] is None and b["w"]["pid"] is None and b["w"]["client_port"] is None and b["w"]["session_id"] == "1.2.3.4"


def test_event_types_are_escaped(spark):
    import json

    from vigilspark.sources.store import with_event_type

    d = spark.createDataFrame([(None, 'a"b'), ("{}", "c\\d"), ('{"k": 1}', "e")], "p string, t string")
    assert [json.loads(r[0])["event_type"] for r in d.select(with_event_type(F.col("p"), F.col("t"))).collect()] == ['a"b', "c\\d", "e"]


def murmur3(raw: bytes, seed: int) -> int:
    """Written from the published algorithm, with plain integers."""
    h = seed
    blocks = [int.from_bytes(raw[k : k + 4], "little") for k in range(0, len(raw) - len(raw) % 4, 4)]
    rotate = lambda x, n: (x << n | x >> 32 - n) % 2**32
    mix = lambda k: rotate(k * 0xCC9E2D51 % 2**32, 15) * 0x1B873593 % 2**32
    for k in blocks:
        h = (rotate(h ^ mix(k), 13) * 5 + 0xE6546B64) % 2**32
    if tail := raw[len(blocks) * 4 :]:
        h ^= mix(int.from_bytes(tail, "little"))
    h ^= len(raw)
    h = (h ^ h >> 16) * 0x85EBCA6B % 2**32
    h = (h ^ h >> 13) * 0xC2B2AE35 % 2**32
    return h ^ h >> 16


def test_kernel_rows_and_feature_hash_against_brute_force(spark, sf_dir):
    import math
    import re

    from vigilspark import domains as D
    from vigilspark.adapter import event_view

    rows = [r.asDict() for r in event_view(spark, sf_dir).orderBy("id").collect()]
    last, want = {}, {}
    for r in rows:
        if not r["source"].startswith("ebpf"):
            continue
        key = r["stream_id"], r["source"]
        gap = math.log1p((r["timestamp"] - last.get(key, r["timestamp"])).total_seconds())
        last[key] = r["timestamp"]
        call = r["raw_line"].split()[1]
        f = dict(re.findall(r"(\w+)=(\S*)", r["raw_line"]))
        h = lambda k, seed: float(murmur3(f[k].rpartition(":")[0 if k == "dst" else 2].encode(), seed)) if k in f else 0.0  # noqa: B023, E731
        n = lambda k: float(f.get(k, 0))  # noqa: B023, E731
        number = D.SYSCALLS.index(call) + 1.0
        if r["source"] == "ebpf_process":
            want[r["id"]] = [gap, n("pid"), n("ppid"), n("uid"), number, h("comm", 0), h("parent_comm", 0), 0.0]
        elif r["source"] == "ebpf_network":
            want[r["id"]] = [gap, n("pid"), n("uid"), number, h("dst", 1), float(f["dst"].rpartition(":")[2]), h("comm", 0)]
        else:
            want[r["id"]] = [gap, n("pid"), n("uid"), number, 65.0, h("path", 2)]
    got = {r["id"]: r["row"] for r in Q.queries()["kernel_rows"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)
    hashed = {r["id"]: r["v"] for r in Q.queries()["feature_hash"](spark, sf_dir).collect()}
    for r in rows:
        words = [w for w in re.split(r"""[\s\[\]():=,"'{}]+""", r["raw_line"]) if w]
        v = [0.0] * 256
        for t in words + [f"{a}_{b}" for a, b in zip(words, words[1:])]:
            v[murmur3(t.encode(), 42) % 256] += 1 if murmur3(t.encode(), 7) % 2 == 0 else -1
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        assert hashed[r["id"]] == pytest.approx([x / norm for x in v], abs=1e-6)


def test_closed_loop_against_plain_loops(spark, sf_dir):
    """Without throttling there is nothing random: a plain loop over each stream gives the same steps, info and totals."""
    from vigilspark import domains as D
    from vigilspark.adapter import event_view

    def choose(row):
        return D.BLOCK if "Failed password" in row["raw_line"] else D.UNBLOCK if row["id"] % 7 == 0 else D.ALERT

    ev = event_view(spark, sf_dir)
    steps = replay.closed_loop(ev, lambda row: (choose(row), 0.0), reset_row=True, ttl_s=3600.0)
    got = {(r["stream_id"], r["step"]): r for r in steps.collect()}
    streams, total = {}, 0.0
    for r in ev.orderBy("id").collect():
        streams.setdefault(r["stream_id"], []).append(r)
    for stream, rows in streams.items():
        assert got[stream, -1]["event_id"] == rows[0]["id"] and got[stream, -1]["action"] is None
        banned, at, step, lost = {}, 0, 0, 0
        while at < len(rows):
            action, ip = choose(rows[at]), rows[at]["src_ip"]
            if ip and action == D.BLOCK:
                banned[ip] = rows[at]["timestamp"]
            if ip and action == D.UNBLOCK:
                banned.pop(ip, None)
            nxt, late = at + 1, 0.0
            while nxt < len(rows) and rows[nxt]["src_ip"] in banned:
                if (rows[nxt]["timestamp"] - banned[rows[nxt]["src_ip"]]).total_seconds() >= 3600:
                    del banned[rows[nxt]["src_ip"]]
                    break
                lost, late, nxt = lost + 1, late + {1: 0.1, 0: -0.5, None: 0.0}[rows[nxt]["is_malicious"]], nxt + 1
            bad = nxt < len(rows) and rows[nxt]["is_malicious"] == 1
            reward = (D.REWARD_ON_ATTACK if bad else D.REWARD_ON_BENIGN)[action] + late
            r = got.pop((stream, step))
            assert (r["event_id"], r["dropped"], r["truncated"], r["blocked"]) == (rows[nxt]["id"] if nxt < len(rows) else None, lost, nxt >= len(rows), sorted(banned)) and r["reward"] == pytest.approx(reward)
            at, step, total = nxt, step + 1, total + reward
    assert all(k[1] == -1 for k in got)
    assert replay.totals(steps).first()["total_reward"] == pytest.approx(total)


def test_closed_loop_reads_streams_by_batches(spark, monkeypatch):
    """A stream goes through its task in batches, not as one group; where batches end changes nothing."""
    rows = [(None if k % 3 == 2 else k % 3, 599 - k, "auth_log", None if k % 11 == 0 else f"10.0.0.{k % 17}", "line", None if k % 13 == 0 else k % 2, "recon" if k % 2 else None, 600 - k) for k in range(600)]
    d = spark.createDataFrame(rows, "stream_id long, id long, source string, src_ip string, raw_line string, is_malicious int, attack_stage string, s int").withColumn("timestamp", F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)"))
    loop = lambda: replay.closed_loop(d, lambda row: ((0, 2, 3, 4)[row["id"] % 4], 0.0), reset_row=True, seed=1, ttl_s=20.0, deny_log=True)
    whole = loop()
    assert "FlatMapGroupsInPandas" not in whole._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (str(r["stream_id"]), r["step"])
    want = sorted(whole.collect(), key=key)
    assert {r["stream_id"] for r in want} == {None, 0, 1} and max(len(r["blocked"]) for r in want) > 3 and max(len(r["throttled"]) for r in want) > 1
    assert all(r["blocked"] == sorted(set(r["blocked"])) and r["throttled"] == sorted(set(r["throttled"])) for r in want)
    for name, value in (("BATCH_STEPS", 5), ("BATCH_LISTED", 3)):
        monkeypatch.setattr(replay, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(loop().collect(), key=key) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_totals_read_the_loop_once(spark):
    """Totals and confusion figures come from one pass over the steps; they need no lists of addresses."""
    d = events(spark, [1, 0, 1, 1, 0, None])
    with_lists, without = (replay.closed_loop(d, replay.random_policy(7), lists=lists, seed=1) for lists in (True, False))
    assert set(with_lists.columns) - set(without.columns) == {"blocked", "throttled"}
    plan = replay.totals(without)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroupsInPandas" not in plan and "Join" not in plan
    assert replay.totals(without).first() == replay.totals(with_lists).first()


def test_loops_of_queries_shuffle_no_lines(spark, sf_dir):
    """what the policies read of a line is made a column before the shuffle; the steps are those of a policy that reads lines."""
    from vigilspark import domains as D
    from vigilspark.adapter import event_view

    def policy(row):
        bad = "Failed password" in row["raw_line"] or "jndi" in row["raw_line"]
        return (D.BLOCK if bad else D.THROTTLE if "UNION" in row["raw_line"] else D.PASS), 5.0 if bad else 0.0

    ev = event_view(spark, sf_dir)
    with_lines = replay.closed_loop(ev, policy, reset_row=True, seed=42, ttl_s=86400.0, deny_log=True)
    made = {name: Q.queries()[name](spark, sf_dir) for name in ("replay_closed_loop", "replay_totals")}
    for d, lines in ((with_lines, 1), *((d, 0) for d in made.values())):
        node = d._jdf.queryExecution().optimizedPlan()
        while node.nodeName() != "RepartitionByExpression":
            node = node.children().head()
        assert node.output().mkString(",").count("raw_line") == lines
    key = lambda r: (r["stream_id"], r["step"])
    want = sorted(with_lines.collect(), key=key)
    assert {r["action"] for r in want} == {None, D.PASS, D.THROTTLE, D.BLOCK} and any(r["blocked"] for r in want) and any(r["throttled"] for r in want)
    assert made["replay_closed_loop"].columns == with_lines.columns and sorted(made["replay_closed_loop"].collect(), key=key) == want
    assert made["replay_totals"].first().asDict() == pytest.approx(replay.totals(replay.closed_loop(ev, replay.random_policy(), seed=42)).first().asDict())


def test_checks_by_name_and_command_line(spark, tmp_path, capsys):
    from vigilspark import __main__ as cli
    from vigilspark.operators.validate import available, run_checks

    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "auth.log").write_text("Jan  2 00:00:01 h sshd[12]: Accepted password for bob from 1.2.3.4 port 5 ssh2\nnonsense\n")
    assert cli.main(["import", str(tmp_path / "logs"), str(tmp_path / "s"), "--reference-time", "2026-03-01 00:00:00"]) == 0
    assert cli.main(["validate", str(tmp_path / "s")]) == 0 and "no_unlabelled" in capsys.readouterr().out
    store = EventStore(spark, str(tmp_path / "s"))
    rows = run_checks(store.events(), None, store.campaigns(), {"brute_force": 1}, ["bob"]).collect()
    assert {r["name"] for r in rows} == set(available()) and {r["name"] for r in rows if r["status"] == "FAIL"} == {"attack_distribution", "pii_absent"}
    with pytest.raises(ValueError):
        run_checks(store.events(), ["none"])


def test_compose_writes_meta_and_counts_types(spark, sf_dir, tmp_path):
    from vigilspark.adapter import event_view
    from vigilspark.plans.compose import compose
    from vigilspark.sources.store import attack_pools

    ev = event_view(spark, sf_dir)
    config = CompositionConfig(10 * 86400.0, distribution={"web_exploit": 0.5, "missing": 0.5})
    made = compose(spark, ev.filter("is_malicious = 0"), attack_pools(ev), config, "2026-01-01 00:00:00", str(tmp_path / "c"), "b", "a")
    out = spark.read.parquet(str(tmp_path / "c"))
    assert made["total"] == out.count() and made["campaigns"] > sum(made["types"].values()) == made["types"]["web_exploit"]
    assert {r["key"] for r in spark.read.parquet(str(tmp_path / "c-meta")).collect()} == {"seed", "duration_seconds", "campaigns_per_day", "distribution", "benign_db", "attack_db", "composed_at"}


def test_loops_pace_and_unions(spark, tmp_path):
    import itertools

    e, waits = events(spark, [0] * 3), []
    assert [[r["id"] for r in b] for b in itertools.islice(ingest.iter_batches(e, 2, loop=True), 4)] == [[0, 1], [2], [0, 1], [2]]
    assert len(list(ingest.iter_paced(ingest.iter_rows(e), 2.0, waits.append))) == 3 and waits == [0.5, 0.5]
    stores = [EventStore(spark, str(tmp_path / n), "w") for n in "ab"]
    columns = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]
    row = dict.fromkeys(columns)
    for k, s in enumerate(stores):
        s.append(spark.createDataFrame([tuple((row | {"id": 1, "source": "syslog", "raw_line": str(k)}).values())], EVENT_SCHEMA).withColumn("timestamp", F.expr(f"timestamp_ntz'2026-01-01 00:00:0{1 - k}'")))
    from vigilspark.sources.store import union_of

    assert [(r["id"], r["raw_line"]) for r in union_of(stores).orderBy("id").collect()] == [(1, "1"), (2, "0")]


def test_batches_in_order_of_time(spark):
    e = events(spark, [0] * 7)
    assert [[r["id"] for r in b] for b in ingest.iter_batches(e, 3)] == [[0, 1, 2], [3, 4, 5], [6]]
    assert [r["id"] for r in ingest.iter_rows(e, 2)] == [0, 1] and list(ingest.iter_batches(e.limit(0))) == []
    with pytest.raises(ValueError):
        next(ingest.iter_batches(e, 0))


def test_campaign_errors():
    good = "campaign: {name: a, target: {host: h}, phases: []}"
    assert campaign_errors(good) == []
    assert campaign_errors("campaign: {name: a, target: {}}") == ["missing key: phases", "missing key: host"]
    assert campaign_errors("[1]") == ["missing key: campaign"] and campaign_errors("a: [")[0].startswith("not YAML")


def test_import_logs(spark, tmp_path):
    import gzip

    (tmp_path / "web").mkdir()
    (tmp_path / "auth.log").write_text(
        "Jan  2 00:00:01 h sshd[12]: Failed password for invalid user bob from 1.2.3.4 port 5 ssh2\n"
        "Jan  2 00:00:02 h sshd[12]: pam_unix(sshd:session): session opened for user bob by (uid=0)\n\nnonsense\n"
    )
    with gzip.open(tmp_path / "web" / "access.log.1.gz", "wt") as f:
        f.write('9.9.9.9 - - [02/Jan/2026:10:00:00 +0000] "GET /x HTTP/1.1" 404 12 "-" "UA"\n')
    (tmp_path / "ebpf.txt").write_text("2026-01-02T00:00:00.5Z connect pid=1 src=7.7.7.7:80\n")
    (tmp_path / "wtmp").write_text("binary\n")
    made = ingest.import_logs(spark, str(tmp_path), "2026-03-01 00:00:00", "h1")
    rows = {r["raw_line"][:28]: r for r in made.collect()}
    assert len(rows) == 5 and all(r["is_malicious"] == 0 for r in rows.values())
    assert (rows["Jan  2 00:00:02 h sshd[12]: "]["src_ip"], rows["Jan  2 00:00:02 h sshd[12]: "]["session_id"]) == ("1.2.3.4", "1.2.3.4:5")
    web = next(r for r in rows.values() if r["source"] == "web_access")
    assert web["event_type"] == "http_error" and '"source_host":"h1"' in web["parsed"] and '"status":"404"' in web["parsed"]
    assert rows["nonsense"]["source"] is None and any(r["source"] == "ebpf_network" and r["src_ip"] == "7.7.7.7" for r in rows.values())
    stats = ingest.ingest_stats(made).first()
    assert (stats["files"], stats["parsed"], stats["errors"]) == (3, 4, 1)


def test_sqlite_databases_become_stores(spark, tmp_path):
    """Plain and zstd-compressed databases; offsets become UTC, gaps in the row numbers and null labels are kept."""
    import sqlite3
    from datetime import datetime

    import zstandard

    from vigilspark import __main__ as cli
    from vigilspark.sources import database

    db = sqlite3.connect(tmp_path / "e.db")
    db.execute("create table events (id integer primary key, timestamp text, source text, raw_line text, parsed text, is_malicious integer, campaign_id text, attack_type text, attack_stage text, severity integer, session_id text, src_ip text, username text, service text)")
    db.execute("create table campaigns (id text primary key, name text, start_time text, end_time text, attack_type text, mitre_tactics text, description text, parameters text)")
    last = 2 * database.RANGE + 7
    rows = [(1, "2026-01-01T02:00:00+02:00", None), (2, "2026-01-01T00:00:01.5", 1), (last, "not a time", 0)]
    db.executemany("insert into events (id, timestamp, source, raw_line, is_malicious) values (?, ?, 'syslog', 'é', ?)", rows)
    db.execute("insert into campaigns values ('c', 'n', '2026-01-01T00:00:00Z', null, 'recon', null, null, '{\"k\": 1}')")
    db.commit()
    db.close()
    (tmp_path / "e.db.zst").write_bytes(zstandard.compress((tmp_path / "e.db").read_bytes()))
    for name in ("e.db", "e.db.zst"):
        made = database.convert(spark, str(tmp_path / name), str(tmp_path / "s"))
        got = [(r["id"], r["timestamp"], r["is_malicious"], r["raw_line"]) for r in made.events().orderBy("id").collect()]
        assert got == [(1, datetime(2026, 1, 1), None, "é"), (2, datetime(2026, 1, 1, 0, 0, 1, 500_000), 1, "é"), (last, None, 0, "é")]
        assert made.campaigns().first()["start_time"] == datetime(2026, 1, 1)
    assert sorted(p.name for p in tmp_path.glob("e.*")) == ["e.db", "e.db.zst"]
    assert cli.main(["convert", str(tmp_path / "e.db"), str(tmp_path / "t")]) == 0
    with pytest.raises(ValueError):
        database.read_table(spark, str(tmp_path / "e.db"), "none", "id long")


def test_reports_with_digests_of_files(spark, tmp_path):
    import hashlib
    import json

    store = EventStore(spark, str(tmp_path / "s"), "w")
    store.append(spark.createDataFrame([(k, None, "syslog", "x", None, 0, None, None, None, None, None, None, None, None) for k in range(3)], EVENT_SCHEMA))
    made = ingest.write_report(spark, store.path, str(tmp_path / "r"), git_sha="abc")
    assert json.loads(spark.read.text(str(tmp_path / "r" / "report")).first()[0]) == made and made["final_counts"] == {"syslog": 3} and made["git_sha"] == "abc"
    for r in spark.read.json(str(tmp_path / "r" / "files")).collect():
        assert hashlib.sha256(open(r["path"].removeprefix("file:"), "rb").read()).hexdigest() == r["sha256"]


def test_pairs_integers_and_parameters(spark, tmp_path):
    d = spark.createDataFrame([("2026-01-01T00:00:00.1Z open a=1 b=x=y a=2 c= d=-3 e=99999999999999999999",), ("2026-01-01T00:00:00Z open x",), ("bad",), (None,)], "l string").select(P.ebpf(F.col("l")).alias("p")).select("p", P.integers(F.col("p.fields")).alias("n"))
    a, b, c, e = d.collect()
    assert a["p"]["fields"] == {"a": "2", "b": "x=y", "c": "", "d": "-3", "e": "99999999999999999999"} and a["n"] == {"a": 2, "d": -3}
    assert b["p"]["fields"] == {} and c["p"] is None and e["p"] is None
    r = spark.createDataFrame([('type=SYSCALL msg=audit(01/02/2026 03:04:05.1:7): key="k k" key=z',), (None,)], "l string").select(P.audit_record(F.col("l")).alias("p")).collect()
    assert r[0]["p"]["fields"]["key"] == "z" and r[0]["p"]["type"] == "SYSCALL" and r[0]["p"]["ts"].day == 2 and r[1]["p"]["fields"] is None
    store = EventStore(spark, str(tmp_path / "s"), "w")
    rows = spark.sql("select id, 'n' as name, timestamp_ntz'2026-01-01 00:00:00' as start_time, cast(null as timestamp_ntz) as end_time, 'recon' as attack_type, cast(null as string) as mitre_tactics, cast(null as string) as description, parameters from values ('a', map('k', 1)), ('b', map()) as t(id, parameters)")
    store.append_campaigns(rows)
    assert [r["parameters"] for r in store.campaigns().collect()] == ['{"k":1}', None]


def test_composition_names_its_stores():
    text = "stream: {duration: 2d, benign: {db: b}, attacks: {db: /x/a, distribution: {recon: 2}}, output: {db: 's3://o/c'}}"
    c = CompositionConfig.from_yaml(text, "/conf")
    assert (c.benign, c.attacks, c.output, c.seed, c.per_day, c.distribution) == ("/conf/b", "/x/a", "s3://o/c", 42, 3.0, {"recon": 1.0})
    with pytest.raises(ValueError):
        CompositionConfig.from_yaml("a: 1")
