"""Embedding near-dedup by a pivot-permutation index.

Equal vectors are one class with a count. Every class is described by its NEAREST reference points (pivots) in order of
nearness. Each of them is an inverted list of the classes that it describes. Two classes are retrieved if they share
SHARED pivots or more, or have the same pivot in first place; what is retrieved is verified by cosine in double
precision. A pair is judged in one list only: that of the common first pivot, else that of the least shared pivot.

Pivots come from a bounded sample of SAMPLE classes, the first by a hash of the id: 2 sqrt(n) of them, 64 at least, without
those whose cosine to a pivot kept before is too high, so that a dense group has one pivot or few, which all its members
share in first place. What is too high lies above the median cosine of a label's vectors, so a common mean doesn't thin all
pivots out. Lengths of vectors without a sampled pivot use directions made by rule. Every vector is indexed.

NEAREST and SHARED are where the search for a label's setting begins. Each sampled vector gets partners made at a cosine of
exactly the threshold, one in a random direction and one towards another vector of its label; of more pivots, more nearest
ones and fewer shared ones the setting with the least work is taken that retrieves RECALL of these partners. Where none
does with less work than all pairs, the label is a single list: all its pairs are judged, with quadratic work.

Lists of more than BLOCK classes are dealt into blocks, and each pair of blocks is a task's unit, so no list is gathered
in one task. Classes of one first pivot that fill blocks of their own are judged against each other in that pivot's list and nowhere else.
Links leave a unit as counts for each class and as a forest with the same connectivity, not as pairs. The work is quadratic in a
list; lists hold 8 / pivots of a label's classes on average, so beyond 1,000,000 classes, where pivots stay at 2048, it grows
with the square of a label.

Defined results: vectors that are null, zero or hold null or non-finite components, and those with a null label, link
with nothing (n_links 0, a component of their own); a null id links with nothing, has a null component and is not kept;
vectors of different lengths do not link; rows with repeated ids are vectors of their own; very long vectors are read
whole; no rows give no rows; other columns, whatever their names, are ignored."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.llm.common import components, materialize

THRESHOLD = 0.93
NEAREST = 8
SHARED = 2
APART = 0.8
BLOCK = 512
#: Classes that pivots and trials come from, at most.
SAMPLE = 2048
#: Share of the trial pairs that a setting has to retrieve.
RECALL = 0.99
#: Numbers of nearest pivots that are tried, and how many times 2 sqrt(n) pivots.
DEPTHS = (8, 12, 16, 24, 32)
WIDER = (1, 2, 4)
#: Sampled vectors of a label from which it gets a setting of its own; the others share one.
OWN = 64
#: Directions for a length of which the sample has no vector.
BY_RULE = 64


def _usable(v: Column) -> Column:
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & sound & F.exists(v, lambda x: x != 0)


def _unit(m: np.ndarray) -> np.ndarray:
    scaled = m / np.abs(m).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _thinned(m: np.ndarray, apart: float) -> np.ndarray:
    """Places of the unit vectors m without those near to one kept before."""
    near, keep = m @ m.T >= apart, []
    for k in range(len(m)):
        if not near[k, keep].any():
            keep.append(k)
    return np.array(keep, dtype=np.int64)


def _directions(dim: int) -> np.ndarray:
    return _unit(np.random.default_rng(dim).normal(size=(BY_RULE, dim)))


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """Numbers of the nearest pivots of each unit vector, nearest first."""
    return _top(unit @ pivots.T, nearest)


def _top(likeness: np.ndarray, nearest: int) -> np.ndarray:
    far = -likeness
    k = min(nearest, far.shape[1])
    top = np.argpartition(far, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(np.take_along_axis(far, top, axis=1), axis=1, kind="stable"), axis=1).astype(np.int32)


def _incidence(pivots: object, count: int) -> np.ndarray:
    out = np.zeros((len(pivots), count), dtype=np.float32)
    for k, p in enumerate(pivots):
        out[k, p] = 1
    return out


class Setting(NamedTuple):
    """How a label is indexed: by its nearest of so many pivots; pairs need so many in common. No pivots: one list."""

    pivots: int
    nearest: int
    shared: int


ONE_LIST = Setting(0, 1, 1)


def _partners(x: np.ndarray, toward: np.ndarray, mean: np.ndarray, threshold: float, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors whose cosine to x is the threshold: in a random direction, and between x and another vector, about the
    mean. Null rows where the other vector is as near as that itself."""
    noise = random.normal(size=x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    around = _unit(threshold * x + math.sqrt(1 - threshold**2) * _unit(noise)) if x.shape[1] > 1 else np.full_like(x, np.nan)
    low, high = np.zeros((len(x), 1)), np.ones((len(x), 1))
    for _ in range(40):
        c = (low + high) / 2
        y = mean + c * (x - mean) + np.sqrt(1 - c**2) * (toward - mean)
        near = (x * y).sum(axis=1, keepdims=True) >= threshold * np.linalg.norm(y, axis=1, keepdims=True)
        low, high = np.where(near, low, c), np.where(near, c, high)
    y = np.where((x * toward).sum(axis=1, keepdims=True) >= threshold, np.nan, y)
    return around, y / np.linalg.norm(y, axis=1, keepdims=True)


def settings(unit: np.ndarray, labels: list[str], base: int, threshold: float) -> tuple[np.ndarray, dict[str, Setting], Setting]:
    """Pivots of a sample of unit vectors of one length, a setting for each label that the sample knows well, one for the others."""
    random = np.random.default_rng(unit.shape[1])
    names, of = np.unique(np.array(labels, dtype=object).astype(str), return_inverse=True)
    like = unit @ unit.T
    same = of[:, None] == of[None, :]
    np.fill_diagonal(same, False)
    typical = float(np.median(like[same])) if same.any() else 0.0
    kept = _thinned(unit, max(APART, (typical + threshold) / 2) if typical < threshold else APART)
    pivots = unit[kept]
    # Trials: partners of every sampled vector. It and the vector that its partner leans to are no pivots of this trial.
    other = np.array([random.choice(np.flatnonzero(same[k])) if same[k].any() else k for k in range(len(unit))])
    means = np.stack([unit[of == k].mean(axis=0) if (of == k).sum() >= OWN else unit.mean(axis=0) for k in range(len(names))])[of]
    place = np.full(len(unit), -1)
    place[kept] = np.arange(len(kept))
    made = _partners(unit, unit[other], means, threshold, random)

    def masked(likeness: np.ndarray, rows: np.ndarray) -> np.ndarray:
        for own in (place[rows], place[other[rows]]):
            likeness[np.flatnonzero(own >= 0), own[own >= 0]] = -2
        return likeness

    trials = []
    for y in made:
        rows = np.flatnonzero(~np.isnan(y).any(axis=1))
        trials.append((rows, masked(unit[rows] @ pivots.T, rows), masked(y[rows] @ pivots.T, rows)))
    owners = {n: np.flatnonzero(of == k) for k, n in enumerate(names) if (of == k).sum() >= OWN}
    groups = {**owners, None: np.arange(len(unit))}
    best: dict = {g: (1.0, ONE_LIST) for g in groups}
    settled: set = set()
    for count in sorted({min(w * base, len(pivots)) for w in WIDER}):
        tops = [(rows, _top(x[:, :count], max(DEPTHS)), _top(y[:, :count], max(DEPTHS))) for rows, x, y in trials]
        plain = _top(unit @ pivots[:count].T, max(DEPTHS))
        for nearest in (d for d in DEPTHS if d <= count):
            shared = [(rows, (_incidence(x[:, :nearest], count) * _incidence(y[:, :nearest], count)).sum(axis=1), x[:, 0] == y[:, 0]) for rows, x, y in tops]
            held = _incidence(plain[:, :nearest], count)
            for group, members in groups.items():
                if group in settled:
                    continue
                mine = held[members]
                work = float(np.where(plain[members, None, 0] == plain[None, members, 0], 1, mine @ mine.T).mean())
                for need in (SHARED, 1):
                    if work >= best[group][0]:
                        continue
                    shares = [((n >= need) | first)[inside] for rows, n, first in shared if (inside := np.isin(rows, members)).any()]
                    if shares and min(s.mean() for s in shares) >= RECALL:
                        best[group] = (work, Setting(count, nearest, need))
                        if (nearest, need) == (NEAREST, SHARED):
                            settled.add(group)
    return pivots, {g: s for g, (_, s) in best.items() if g is not None}, best[None][1]


def describe(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """classes(cid, label, v, n) -> cid, label, dim, n, first, pivots (in order of nearness), need (pivots that a pair has to
    share), raw (float64 bytes)."""
    base = min(SAMPLE, max(64, math.ceil(2 * math.sqrt(classes.count()))))
    by_dim: dict[int, list] = {}
    for r in classes.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("label", "v").collect():  # the bounded sample
        by_dim.setdefault(len(r["v"]), []).append(r)
    made = {d: settings(_unit(np.array([r["v"] for r in rows], dtype=np.float64)), [r["label"] for r in rows], base, threshold) for d, rows in by_dim.items()}
    shared = classes.sparkSession.sparkContext.broadcast(made)  # SAMPLE vectors at most

    def run(batches: object) -> object:
        known = shared.value
        for batch in batches:
            lengths = pa.compute.list_value_length(batch.column("v")).to_numpy()
            names = np.array(batch.column("label").to_pylist(), dtype=object)
            for dim, name in sorted(set(zip(lengths.tolist(), names.tolist(), strict=True))):
                part = batch.take(pa.array(np.flatnonzero((lengths == dim) & (names == name))))
                m = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                pivots, own, rest = known[dim] if dim in known else (_directions(dim), {}, Setting(BY_RULE, NEAREST, SHARED))
                setting = own.get(name, rest)
                top = nearest_pivots(_unit(m), pivots[: setting.pivots], setting.nearest) if setting.pivots else np.zeros((len(m), 1), dtype=np.int32)
                number = lambda k: pa.array(np.full(len(m), k, dtype=np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [part.column("cid"), part.column("label"), number(dim), part.column("n"), pa.array(top[:, 0]), pa.array(top.tolist(), pa.list_(pa.int32())), number(setting.shared), pa.array([r.tobytes() for r in m], pa.binary())],
                    names=["cid", "label", "dim", "n", "first", "pivots", "need", "raw"],
                )

    return classes.select("cid", "label", "v", "n").mapInArrow(run, "cid long, label string, dim int, n long, first int, pivots array<int>, need int, raw binary")


LIST = ["label", "dim", "pivot"]


def _blocks(posts: DataFrame) -> DataFrame:
    """How the classes of a list's first pivots are dealt: LIST, first, blocks low..high-1, all (of the list). First pivots
    with half a block or more of the list have blocks of their own, the others share blocks 0..pool-1."""
    sizes = posts.groupBy(*LIST, "first").agg(F.count(F.lit(1)).alias("m")).withColumn("own", F.when(F.col("m") >= BLOCK // 2, F.ceil(F.col("m") / BLOCK)).otherwise(0).cast("int"))
    whole = sizes.groupBy(*LIST).agg(F.sum("m").alias("rows"), F.ceil(F.sum(F.when(F.col("own") == 0, F.col("m")).otherwise(0)) / BLOCK).cast("int").alias("pool"), F.sum("own").cast("int").alias("owned")).filter("rows > 1")
    before = F.coalesce(F.sum("own").over(Window.partitionBy(*LIST).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    placed = sizes.withColumn("before", before).join(whole, LIST)
    low = F.when(F.col("own") > 0, F.col("pool") + F.col("before")).otherwise(0)
    return placed.select(*LIST, "first", low.alias("low"), F.when(F.col("own") > 0, low + F.col("own")).otherwise(F.col("pool")).alias("high"), (F.col("own") > 0).alias("alone"), (F.col("pool") + F.col("owned")).alias("all"))


def units(index: DataFrame) -> DataFrame:
    """The index's rows, once for each pair of blocks (i, j) of a list in which they are to be judged."""
    posts = index.withColumn("pivot", F.explode("pivots"))
    dealt = posts.join(_blocks(posts.select(*LIST, "first")), [*LIST, "first"])
    dealt = dealt.withColumn("b", F.col("low") + F.pmod(F.xxhash64("cid"), F.col("high") - F.col("low")).cast("int"))
    elsewhere = F.col("alone") & (F.col("first") != F.col("pivot"))  # its own kind is judged in the first pivot's list
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda k: ~elsewhere | (k < F.col("low")) | (k >= F.col("high")))
    pairs = F.transform(others, lambda k: F.struct(F.least(k, F.col("b")).alias("i"), F.greatest(k, F.col("b")).alias("j"), (F.col("b") > k).cast("int").alias("side")))
    return dealt.withColumn("unit", F.explode(pairs)).select(*LIST, "unit.i", "unit.j", "unit.side", "cid", "n", "first", "pivots", "need", "raw")


def _stars(linked: np.ndarray, a_id: np.ndarray, b_id: np.ndarray) -> list[tuple[int, int]]:
    """(id, least id) for the ids of each connected part; each row of linked is read once."""
    todo, out = linked.any(axis=1), []
    while todo.any():
        rows = np.zeros(len(todo), dtype=bool)
        cols = np.zeros(linked.shape[1], dtype=bool)
        front = np.array([todo.argmax()])
        while len(front):
            rows[front] = True
            todo[front] = False
            new = linked[front].any(axis=0) & ~cols
            cols |= new
            front = np.flatnonzero(linked[:, new].any(axis=1) & todo)
        ids = np.unique(np.concatenate((a_id[rows], b_id[cols])))
        out += [(int(x), int(ids[0])) for x in ids[1:]]
    return out


def judge(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between the two sides of a unit: rows (u, null, n) count a class's linked vectors, rows (u, v, null) connect."""
    pivot, same = int(pdf["pivot"].iat[0]), bool((pdf["i"] == pdf["j"]).iat[0])
    left, right = (pdf, pdf) if same else (pdf[pdf["side"] == 0], pdf[pdf["side"] == 1])
    empty = pd.DataFrame({"u": [], "v": [], "n": []})
    if not len(left) or not len(right):
        return empty
    # Retrieval: pivots that both sides' classes share, counted by a product of their incidences.
    names = np.unique(np.concatenate(list(pdf["pivots"])))
    a, b = (_incidence([np.searchsorted(names, p) for p in side["pivots"]], len(names)) for side in (left, right))
    lower = names < pivot
    first_a, first_b = left["first"].to_numpy(), right["first"].to_numpy()
    alike = first_a[:, None] == first_b[None, :]
    found = np.where(alike, (first_a == pivot)[:, None], (a @ b.T >= int(pdf["need"].iat[0])) & (a[:, lower] @ b[:, lower].T == 0))
    if same:
        np.fill_diagonal(found, False)
    if not found.any():
        return empty
    # Verification.
    vectors = [_unit(np.stack([np.frombuffer(x) for x in side["raw"]])) for side in (left, right)]
    linked = found & (vectors[0] @ vectors[1].T >= threshold)
    a_id, b_id = left["cid"].to_numpy(), right["cid"].to_numpy()
    ends = _stars(linked, a_id, b_id)
    sums = [(a_id, linked @ right["n"].to_numpy())] + ([] if same else [(b_id, left["n"].to_numpy() @ linked)])
    ids, n = np.concatenate([s[0] for s in sums]), np.concatenate([s[1] for s in sums])
    u = [*ids[n > 0].tolist(), *(e[0] for e in ends)]
    return pd.DataFrame({"u": pd.Series(u, dtype="int64"), "v": pd.Series([None] * int((n > 0).sum()) + [e[1] for e in ends], dtype="Int64"), "n": pd.Series([*n[n > 0].tolist(), *([None] * len(ends))], dtype="Int64")})


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    sound = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("v")), F.lit(False))
    # Copies meet by a key of 128 bits; the vectors are grouped once, summed before the shuffle.
    key = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit("second"), "v").alias("k2")]
    classes = v.filter(sound).groupBy("label", "v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cid"), "label", *key, "least", "n", "v"), "classes")
    index = materialize(describe(classes, threshold), "pivots")
    found = materialize(units(index).groupBy(*LIST, "i", "j").applyInPandas(lambda pdf: judge(pdf, threshold), "u long, v long, n long"), "links")
    counts = found.filter("n is not null").groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("links"))
    groups = components(found.filter("v is not null").select("u", "v")).select(F.col("vertex").alias("cid"), "component")
    rated = classes.select("cid", "label", "k1", "k2", "least", "n").join(counts, "cid", "left").join(groups, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    rated = materialize(rated, "rated")
    top = rated.groupBy("component").agg(F.min("least").alias("component_id"))
    of_key = rated.join(top, "component").select("label", "k1", "k2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    rows = v.filter(sound).select("id", "label", *key).join(of_key, ["label", "k1", "k2"]).select("id", "n_links", "component_id")
    alone = v.filter(~sound).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = rows.unionByName(alone)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
