"""The retention matrix, importance resampling and deleted interpolation against plain loops."""

import collections
import hashlib
import math
import random
import re
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest

from vigilspark.llm import embedding_dedup, interpolation, resample, retention

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, segment string, bits string"
CLIENTS = "client_id long, segment string, us string"
EPOCH = datetime(1970, 1, 1)


def us(t):
    return (t - EPOCH) // timedelta(microseconds=1)


def matrix(clicks, clients, cut=datetime(2024, 2, 15), cohort_days=1, period_days=1):
    day, known = 86_400_000_000, {0: [], 1: []}
    for row in {repr(c[:7]): c for c in clicks}.values():
        number, ts, arrived, client, kind, value = row[:6]
        if ts is None or client is None:
            continue
        h = zlib.crc32(str(number).encode()) if number is not None else 1
        cents = math.floor(100 * value + 0.5) if value is not None and math.isfinite(value) else 0
        known[1].append((client, us(ts), kind, cents))
        if arrived is not None and arrived + timedelta(days=h % 100 if h % 3 == 0 else 0) < cut:
            known[0].append((client, us(ts), kind, cents))
    start = {s: {} for s in known}
    for s, rows in known.items():
        for client, t, kind, _ in rows:
            if kind == "signup":
                start[s][client] = min(t, start[s].get(client, t))
    cohort = {s: {c: t // day // cohort_days for c, t in x.items()} for s, x in start.items()}
    segment = {}
    for c, name in clients:
        if name is not None:
            segment[c] = min(name, segment.get(c, name))
    cells = collections.defaultdict(lambda: [set(), 0])
    for s, rows in known.items():
        for client, t, _, cents in rows:
            if client in start[s] and t >= start[s][client]:
                cell = cells[s, segment.get(client, ""), cohort[s][client], (t - start[s][client]) // (day * period_days)]
                cell[0].add(client)
                cell[1] += cents
    moved = {c for c in cohort[0] if c in cohort[1] and cohort[0][c] != cohort[1][c]}
    return sorted((*k, len(u), sum(zlib.crc32(str(c).encode()) for c in u), len(u & moved), cents) for k, (u, cents) in cells.items())


def shop(n, clients, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        t = datetime(2024, 1, 1) + timedelta(microseconds=rng.randrange(100 * 86_400_000_000))
        client = None if rng.random() < 0.02 else 7 if rng.random() < 0.3 else rng.randrange(clients)
        kind = rng.choice(["view", "click", "purchase", None]) if rng.random() < 0.7 else "signup"
        rows.append((rng.choice([k, k, None]), None if rng.random() < 0.02 else t, None if rng.random() < 0.05 else t + timedelta(seconds=rng.randrange(9)), client, kind, rng.choice([None, float("nan"), float("inf"), -0.005, 1.115, 99.5]), rng.choice([None, "", "{}"]), "x", "y"))
    return rows + rng.sample(rows, n // 10)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("state", "segment", "cohort", "period", "users", "users_crc32", "moved", "cents").collect())


@pytest.mark.parametrize(("held", "dense", "days"), [(400_000, 4096, (1, 1)), (50, 4096, (7, 2)), (50, 3, (30, 30))])
def test_retention_against_plain_loops(spark, monkeypatch, held, dense, days):
    """Also with few rows held at once and several cohorts that share a page."""
    monkeypatch.setattr(retention, "HELD", held)
    clicks = shop(1500, 60)
    clients = [(c, ["a", "b", None][c % 3], "z") for c in range(0, 50)] + [(4, "aa", "z"), (None, "n", "z")]
    got = retention.retention(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(clients, CLIENTS), cohort_days=days[0], period_days=days[1])
    assert as_rows(got) == matrix(clicks, [c[:2] for c in clients], cohort_days=days[0], period_days=days[1])


def test_retention_of_dense_cells(spark):
    """So many clients in a cell that its bitmap becomes bits."""
    t = datetime(2024, 1, 5, 3)
    clicks = [(k, t + timedelta(days=d), t, k, "signup" if not d else "view", 1.0, None, "x", "y") for k in range(9000) for d in ((0, 3) if k % 3 else (0,))]
    clients = [(k, "s" if k % 50 else "few", "z") for k in range(9000)]
    got = retention.retention(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(clients, CLIENTS))
    assert as_rows(got) == matrix(clicks, [c[:2] for c in clients])


def test_bitmaps():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 65536, n)) for n in (0, 1, 50, 4095, 6000, 60_000, 10)]
    edges = np.cumsum([0, *map(len, sets)])
    column = retention.packed(edges, np.concatenate(sets))
    assert {len(x) for x in column.to_pylist()} >= {8192, 2, 0}
    group = np.array([0, 0, 1, 1, 1, 2, 2])
    merged = retention.union_of(group, 3, column).to_pylist()
    for g in range(3):
        want = np.unique(np.concatenate([s for s, k in zip(sets, group, strict=True) if k == g]))
        rows, places, dense = retention.unpacked(retention.packed(np.array([0, len(want)]), want))
        assert merged[g] == retention.packed(np.array([0, len(want)]), want)[0].as_py()
        assert (dense and np.flatnonzero(np.unpackbits(dense[0], bitorder="little")).tolist() or places.tolist()) == want.tolist()


def test_retention_pages_overflow_into_more(spark, monkeypatch):
    monkeypatch.setattr(retention, "PAGE", 16)
    monkeypatch.setattr(retention, "FILL", 16)
    rows = spark.range(500).withColumnRenamed("id", "k")
    got = retention.with_dense_ids(rows, "k").collect()
    assert len({(r["chunk"], r["at"]) for r in got}) == 500


def test_retention_empty_tables(spark):
    none, few = spark.createDataFrame([], CLICKS), spark.createDataFrame(shop(60, 5), CLICKS)
    assert as_rows(retention.retention(none, spark.createDataFrame([], CLIENTS))) == []
    assert {r[1] for r in as_rows(retention.retention(few, spark.createDataFrame([], CLIENTS)))} == {""}


DOCS = "doc_id long, text string, row long, n_words string, score string"


def texts(n=120, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeÉü0") for _ in range(rng.randint(1, 5))) for _ in range(80)]
    out = [(k, rng.choice([" ", ", ", "\t", "\x0b\n"]).join(rng.choice(vocabulary[: 10 + k % 70]) for _ in range(rng.choice([0, 1, 5, 19, 20, 21, 60])))) for k in range(n)]
    return [*out, (500, None), (501, ""), (502, " .. \n"), (503, "A b " * 20_000), (503, "A b " * 20_000), (504, "ÀB É x 漢字 \U0001d54f"), (None, "one two " * 15), (None, None)]


def resampled(docs, target, percent=25, least=20, seed=7):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
        return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = collections.Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = collections.Counter(bucket(f) for x in target for f in features(x)[1])
    sa, ta, rows = sum(s.values()), sum(t.values()), []
    for i, text in docs:
        n, f = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sa + 10_000) / ((s[b] + 1.0) * (ta + 10_000)))) for b in map(bucket, f)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    enough = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(enough[: percent * len(enough) // 100])}
    return sorted(repr((*r[:4], rank.get(id(r)))) for r in rows)


def test_resample_against_plain_loops(spark):
    docs, target = texts(), [("a b c " * 9,), (None,), ("É ü",)]
    d = spark.createDataFrame([(i, t, 1, "w", "s") for i, t in docs], DOCS).repartition(5)
    t = spark.createDataFrame(target, "text string")
    for percent in (25, 100):
        got = resample.resample(d, t, percent=percent)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(repr(tuple(r)) for r in got.collect()) == resampled(docs, [x for x, in target], percent)


def test_resample_longer_runs_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d", 1, "w", "s"), (2, "", 1, "w", "s")], DOCS)
    none = spark.createDataFrame([], "text string")
    assert {r["doc_id"]: r["n_features"] for r in resample.resample(d, none, longest=3).collect()} == {1: 9, 2: 0}
    assert resample.resample(spark.createDataFrame([], DOCS), none).collect() == []


def interpolated(docs, order):
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP)), None]
    crc = lambda i: zlib.crc32(str(i).encode())
    train = {k for k, (i, _) in enumerate(docs) if i is not None and crc(i) % 10}
    deleted = {k for k in train if crc(docs[k][0]) // 10 % 10 == 0}
    tokens = [split(t) for _, t in docs]

    def grams(w, j):
        return [("^", *w[: j + 1])[-n:] if j + 1 < n else tuple(w[j + 1 - n : j + 1]) for n in range(1, order + 1)]

    def model(rows):
        c, texts = collections.Counter(), 0
        for k in rows:
            texts += 1
            for j in range(len(tokens[k])):
                # a run that reaches over the text's head starts with one mark, and so is a run of its own length there
                c.update((n, g) for n, g in enumerate(grams(tokens[k], j), 1))
        return c, texts, sum(len(tokens[k]) for k in rows)

    def rated(w, j, c, texts, total, size):
        p = [1 / (size + 1)]
        h = total
        for n, g in enumerate(grams(w, j), 1):
            if n > 1:
                h = texts if j == 0 else c[n - 1, grams(w, j - 1)[n - 2]]
            p.append(c[n, g] / h if h else p[-1])
        return (math.floor(math.log2(h)) + 1 if h else 0), p

    full, kept = model(train), model(train - deleted)
    size = len({w for k in train for w in tokens[k]})
    data = [rated(tokens[k], j, *kept, size) for k in deleted for j in range(len(tokens[k]))]
    weights = {b: [1 / (order + 1)] * (order + 1) for b in range(60)}
    for _ in range(interpolation.ROUNDS):
        sums = {b: [0.0] * (order + 1) for b in weights}
        for b, p in data:
            every = sum(x * y for x, y in zip(weights[b], p, strict=True))
            for n in range(order + 1):
                sums[b][n] += weights[b][n] * p[n] / every
        prior = [sum(s[n] for s in sums.values()) + 1 for n in range(order + 1)]
        prior = [x / sum(prior) for x in prior]
        after = {b: [(s[n] + prior[n]) / (sum(s) + 1) for n in range(order + 1)] for b, s in sums.items()}
        moved = max(abs(x - y) for b in after for x, y in zip(after[b], weights[b], strict=True))
        weights = after
        if moved < 1e-3:
            break
    out = []
    for k, (i, _) in enumerate(docs):
        w, (c, _, total) = tokens[k], full
        score = sum(math.log10(sum(x * y for x, y in zip(weights[b], p, strict=True))) for b, p in (rated(w, j, *full, size) for j in range(len(w))))
        base = sum(math.log10((c[1, (t,)] + 0.1) / (total + 0.1 * (size + 1))) for t in w)
        out.append((i is None, i or 0, i is not None and crc(i) % 10 == 0, len(w), sum(c[1, (t,)] > 0 for t in w), total, base, score))
    return sorted(out)


@pytest.mark.parametrize(("order", "block"), [(1, 12 << 20), (2, 12 << 20), (2, 300), (3, 300)])
def test_interpolation_against_plain_loops(spark, monkeypatch, order, block):
    monkeypatch.setattr(interpolation, "BLOCK", block)
    docs = texts(250)
    frame = spark.createDataFrame([(i, t, 1, "w", "s") for i, t in docs], DOCS)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in interpolation.score_documents(frame, order).collect())
    want = interpolated(docs, order)
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert np.allclose([g[6:] for g in got], [w[6:] for w in want], rtol=1e-9)


def test_interpolation_probabilities_add_up(spark):
    """After any history the words of the vocabulary and one unknown word share all of the probability."""
    docs = [(k, " ".join(random.Random(k).choices("a b c d".split(), k=12))) for k in range(60)]
    counted, m = interpolation.train(spark.createDataFrame(docs, "doc_id long, text string"), 3)
    seen = collections.Counter(g for k, t in docs if zlib.crc32(str(k).encode()) % 10 for g in (lambda w: [*((x,) for x in w), *zip(w, w[1:]), *zip(w, w[1:], w[2:])])([*t.split(), "$"]))
    for u, v in (("a", "b"), ("c", "zz"), ("zz", "a")):
        c = [np.array([seen[u,], seen[v,], seen[w,]]) for w in "abcd$?"], [np.array([0, seen[u, v], seen[v, w]]) for w in "abcd$?"], [np.array([0, 0, seen[u, v, w]]) for w in "abcd$?"]
        total = 0.0
        for one, two, three in zip(*c, strict=True):
            bucket, p = interpolation.estimates([one, two, three], np.array([3]), m["tokens"], m["texts"], m["size"])
            total += float(p[:, 2] @ m["weights"][bucket[2]])
        assert abs(total - 1) < 1e-9


def test_interpolation_of_no_rows_and_without_training(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert interpolation.score_documents(frame).collect() == []
    held = [k for k in range(99) if zlib.crc32(str(k).encode()) % 10 == 0][:3]
    rows = interpolation.score_documents(spark.createDataFrame([(k, "a b") for k in held], "doc_id long, text string")).collect()
    assert all((r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) == (3, 0, 0, 0.0) for r in rows) and len(rows) == 3


def test_interpolation_tokens():
    long = "w" * (3 << 20)
    for docs in (["", " ", "a", " A a\x0b", "b\x1fb é", long + " " + long + "x", ""], [""], [" \t"]):
        raw = [d.encode() for d in docs]
        keys, counts = interpolation.tokens(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
        words = [w for d in docs for w in [*re.findall(r"[^\x20\x09-\x0D]+", d.translate(UP)), None]]
        assert counts.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", d)) + 1 for d in docs]
        assert len(set(zip(words, keys.tolist(), strict=True))) == len(set(words)) == len(set(keys.tolist()))


def _anisotropic(n: int, dim: int, mean: float, seed: int) -> np.ndarray:
    """Unit vectors with a mean cosine of about mean, a tenth of them within cosines of 0.93 to 1 of one before."""
    r = np.random.default_rng(seed)
    axis = embedding_dedup._unit(r.normal(size=(1, dim)))
    x = embedding_dedup._unit(np.sqrt(mean) * axis + np.sqrt(1 - mean) * r.normal(size=(n, dim)) / np.sqrt(dim))
    near = r.choice(n, n // 10, replace=False)
    of = r.choice(n, n // 10)
    noise = r.normal(size=(n // 10, dim))
    noise -= (noise * x[of]).sum(axis=1, keepdims=True) * x[of]
    c = r.uniform(0.935, 0.99, size=(n // 10, 1))
    x[near] = embedding_dedup._unit(c * x[of] + np.sqrt(1 - c**2) * embedding_dedup._unit(noise))
    return x


@pytest.mark.parametrize("mean", [0.0, 0.5, 0.7, 0.75, 0.8, 0.9])
def test_embeddings_with_a_common_mean(spark, mean):
    x = _anisotropic(4000, 64, mean, 3)
    links = x @ x.T >= 0.93
    np.fill_diagonal(links, False)
    rows = [(k, v.tolist(), "a") for k, v in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(4)).collect()}
    true = links.sum(axis=1)
    assert all(got[k] <= true[k] for k in got)
    assert sum(got.values()) >= 0.99 * true.sum() > 0


@pytest.mark.parametrize("dim", [64, 256])
@pytest.mark.parametrize("mean", [0.0, 0.5, 0.7, 0.75, 0.8, 0.9])
def test_settings_at_the_most_pivots(mean, dim):
    """Partners of vectors outside the sample, at a cosine just above the threshold, with the pivots that the largest labels have."""
    x = _anisotropic(6048, dim, mean, 7)
    pivots, own, _ = embedding_dedup.settings(x[:2048], ["a"] * 2048, 2048, 0.93)
    setting, q = own["a"], x[2048:]
    noise = np.random.default_rng(8).normal(size=q.shape)
    noise -= (noise * q).sum(axis=1, keepdims=True) * q
    y = embedding_dedup._unit(0.94 * q + np.sqrt(1 - 0.94**2) * embedding_dedup._unit(noise))
    if not setting.pivots:
        assert mean >= 0.8 and setting == embedding_dedup.ONE_LIST
        return
    a, b = (embedding_dedup.nearest_pivots(v, pivots[: setting.pivots], setting.nearest) for v in (q, y))
    shared = np.array([len(set(i) & set(j)) for i, j in zip(a.tolist(), b.tolist(), strict=True)])
    assert ((shared >= setting.shared) | (a[:, 0] == b[:, 0])).mean() >= 0.99


def test_settings_belong_to_labels():
    """An isotropic label keeps few lists a vector although another one has a common mean; labels that the sample hardly knows share a setting."""
    x = np.concatenate([_anisotropic(1000, 64, 0.0, 1), _anisotropic(1000, 64, 0.8, 2), _anisotropic(20, 64, 0.0, 4)])
    _, own, rest = embedding_dedup.settings(x, ["a"] * 1000 + ["b"] * 1000 + ["c"] * 20, 283, 0.93)
    assert set(own) == {"a", "b"} and own["a"].nearest == embedding_dedup.NEAREST
    assert own["b"] != own["a"] and rest.nearest >= 1


def test_settings_of_tiny_samples():
    for x in (np.ones((1, 1)), np.array([[1.0], [-1.0]]), np.eye(3), np.repeat([[1.0, 0.0]], 5, axis=0)):
        pivots, own, rest = embedding_dedup.settings(embedding_dedup._unit(x), ["a"] * len(x), 64, 0.93)
        assert not own and (rest == embedding_dedup.ONE_LIST or rest.pivots <= len(pivots))
