"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence, cut by size-derived bounds. Exact.

A document's row of the incidence matrix is the set of its distinct runs of five words (64-bit hashes). Documents with
equal sets are one class and one row. Two classes link when 100 |a & b| >= 80 |a | b|, so of a set of n n-grams only the
n - ceil(0.8 n) + 1 first ones in a global order can meet a partner's: the classes of one such n-gram are a block of rows.
The order is rarest first, by a sketch of all documents' n-gram counts (SKETCH cells whatever the input; any function of
the n-gram gives a valid order, the sketch only makes the blocks short), then by hash.

All links come from one product, _product(): a unit holds two sides of rows, overlap counts accumulate over blocks of
columns, and a row stops when no partner can reach the overlap that the sizes ask for. Units are made twice:
- of neighbours in the blocks (by size), in rounds of about one pair for each component: a row against its neighbours;
- of every block that then still holds several components, whatever its length, rows against rows, part against part.
  Blocks with the same members count once, a pair is judged in the first block that it shares, and only rows with a
  partner there, in another component, that sizes and places allow ship their sets.
So a group of near copies costs a chain, not its square, and no link between components is lost.

Defined results: null and blank texts have 0 n-grams and link with nothing; equal sets share a component; repeated rows
each give a row; a null id gives a row with a null component; ties of size go by key and change no result; very long
texts are one set, read whole; no rows give no rows; other columns are ignored. Sets are named by 64-bit digests; should
two different sets share one (seen by a second digest), the join fails rather than merge them."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.llm.common import Forest, components, drop, materialize, per_batch, per_group

WORDS = 5
SKETCH_LOG2, CHUNK_LOG2 = 22, 17
#: Bits of the id filter: 16 for each id wanted, within these bounds; beyond them more rows ship in vain.
BLOOM_LOG2 = (16, 28)
#: Rows of a side of a product's unit; columns of a row that are counted before sizes are looked at again.
PART, COLUMNS = 256, 1024
#: Earlier blocks of a row that tell where its pairs are judged; pairs that share none of these may be judged again.
BEFORE = 256
#: Tables of counts or bits that meet in one task.
FAN = 16
_FOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def ngrams(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams; A-Z are lower-cased, words end at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    span = min(WORDS, len(w))
    h = np.full(len(w) - span + 1, span, dtype=np.uint64)
    for k in range(span):
        h = h * _FOLD + w[k : len(w) - span + 1 + k]
        h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(32)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def set_key(h: np.ndarray, seed: int = 0) -> int:
    """Signed 64-bit digest of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h) + seed)).astype(np.int64))


def prefix_size(n: np.ndarray | int) -> np.ndarray | int:
    return n - (80 * n + 99) // 100 + 1


def least_overlap(a: object, b: object) -> object:
    """Least |a & b| at which sets of sizes a and b link: 100 o >= 80 (a + b - o)."""
    return (80 * (a + b) + 179) // 180


def _first_pass(docs: DataFrame) -> DataFrame:
    """kind 'doc': id, n, key, second (another digest) of every row; kind 'cells': partial counts of a chunk of the sketch."""
    schema = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("second", pa.int64()), ("cells", pa.binary())])

    def run(batches: object) -> object:
        sketch = np.zeros(1 << SKETCH_LOG2, dtype=np.int64)
        shift = np.uint64(64 - SKETCH_LOG2)

        def count(pending: list) -> None:
            np.add(sketch, np.bincount((np.concatenate(pending) >> shift).astype(np.int64), minlength=len(sketch)), out=sketch)

        for batch in batches:
            ids, sizes, keys, seconds, pending, held = batch.column(0).to_pylist(), [], [], [], [], 0
            for text in batch.column(1).to_pylist():
                h = ngrams(text)
                sizes.append(len(h))
                keys.append(set_key(h))
                seconds.append(set_key(h, 1 << 32))
                pending.append(h)
                held += len(h)
                if held > 1_000_000:
                    count(pending)
                    pending, held = [], 0
            if held:
                count(pending)
            yield pa.RecordBatch.from_arrays([pa.array(["doc"] * len(ids)), *(pa.array(x, pa.int64()) for x in (ids, sizes, keys, seconds)), pa.nulls(len(ids), pa.binary())], schema=schema)
        for k in range(0, len(sketch), 1 << CHUNK_LOG2):
            if (part := sketch[k : k + (1 << CHUNK_LOG2)]).any():
                yield pa.RecordBatch.from_arrays([pa.array(["cells"]), pa.array([k], pa.int64()), *[pa.nulls(1, pa.int64())] * 3, pa.array([_pressed(part)])], schema=schema)

    return docs.mapInArrow(run, "kind string, id long, n long, key long, second long, cells binary")


def _pressed(part: np.ndarray) -> bytes:
    """Most cells of a task's table are 0."""
    return zlib.compress(part.tobytes(), 1)


def _loosened(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), dtype=kind)


def _merged(parts: DataFrame, kind: str, both: np.ufunc) -> DataFrame:
    """parts(at, cells: pressed numbers of a kind) -> one row for each place, by a tree in which about FAN rows meet."""
    import pandas as pd

    def run(key: tuple, pdf: object) -> object:
        out = _loosened(pdf["cells"].iat[0], kind).copy()
        for b in pdf["cells"].iloc[1:]:
            both(out, _loosened(b, kind), out=out)
        return pd.DataFrame({"at": [key[0]], "cells": [_pressed(out)]})

    parts = materialize(parts, "cells")
    most = parts.groupBy("at").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while most > 1:
        salts = -(-most // FAN)
        salted = parts.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)) if salts > 1 else F.lit(0))
        after = materialize(salted.groupBy("at", "salt").applyInPandas(run, "at long, cells binary"), "cells")
        drop(parts)
        parts, most = after, salts if salts < most else 1
    return parts


def _levels(cells: DataFrame) -> np.ndarray:
    """The sketch's cells as steps of 2^(1/4): SKETCH bytes, whatever the input."""
    out = np.zeros(1 << SKETCH_LOG2, dtype=np.uint8)

    def start() -> object:
        def work(batch: pa.RecordBatch) -> dict:
            levels = [np.minimum(255, 4 * np.log2(_loosened(b, "int64") + 1)).astype(np.uint8).tobytes() for b in batch.column("cells").to_pylist()]
            return {"at": batch.column("at"), "levels": levels}

        return work

    for r in per_batch(_merged(cells, "int64", np.add), "at long, levels binary", start).collect():
        out[r["at"] : r["at"] + (1 << CHUNK_LOG2)] = np.frombuffer(r["levels"], dtype=np.uint8)
    return out


def _entries(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """gram, key, place (size << 32 | position in the order) of each document's leading n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def start() -> object:
        rank, shift = shared.value, np.uint64(64 - SKETCH_LOG2)

        def work(batch: pa.RecordBatch) -> dict:
            grams, keys, places = [], [], []
            for text in batch.column(0).to_pylist():
                h = ngrams(text)
                if n := len(h):
                    p = prefix_size(n)
                    level = rank[(h >> shift).astype(np.int64)]
                    if p < n:
                        near = np.flatnonzero(level <= np.partition(level, p - 1)[p - 1])  # the rest can't lead
                        first = near[np.lexsort((h[near], level[near]))][:p]
                    else:
                        first = np.lexsort((h, level))
                    grams.append(h[first].astype(np.int64))
                    keys.append(np.full(p, set_key(h), dtype=np.int64))
                    places.append((n << 32) + np.arange(p, dtype=np.int64))
            join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
            return {"gram": join(grams), "key": join(keys), "place": join(places)}

        return work

    return per_batch(docs.select("text"), "gram long, key long, place long", start)


def _blocks(entries: DataFrame) -> DataFrame:
    """Entries of n-grams that several classes lead with, each with its predecessor in the block (by size, then key)."""
    schema = pa.schema([(c, pa.int64()) for c in ("gram", "key", "place", "prev_key", "prev_place")])

    def run(batches: object) -> object:
        held = np.zeros((5, 0), dtype=np.int64)  # the last row so far, whose successor isn't known
        known = np.zeros(0, dtype=bool)  # whether a predecessor was found
        def out(rows: np.ndarray, has: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[k]) if k < 3 else pa.array(rows[k], mask=~has) for k in range(5)], schema=schema)

        for batch in batches:
            new = np.stack([batch.column(k).to_numpy() for k in (0, 1, 2)])
            rows = np.concatenate((held[:3], new), axis=1)
            fresh = np.concatenate(([True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)))  # copies of a class stand together
            rows = rows[:, fresh]
            with_prev = np.concatenate((rows, np.zeros((2, rows.shape[1]), dtype=np.int64)))
            has = np.zeros(rows.shape[1], dtype=bool)
            has[1:] = rows[0, 1:] == rows[0, :-1]
            with_prev[3, 1:], with_prev[4, 1:] = rows[1, :-1], rows[2, :-1]
            if held.shape[1]:
                with_prev[3:, 0], has[0] = held[3:, 0], known[0]
            several = has.copy()
            several[:-1] |= has[1:]
            send = several[:-1]
            if send.any():
                yield out(with_prev[:, :-1][:, send], has[:-1][send])
            held, known = with_prev[:, -1:], has[-1:]
        if known.any():
            yield out(held, known)

    dealt = entries.repartition("gram").sortWithinPartitions("gram", "place", "key")
    return dealt.mapInArrow(run, "gram long, key long, place long, prev_key long, prev_place long")


def _allowed(a_place: str, b_place: str) -> F.Column:
    """The size bound, and the overlap that both places still allow. Safe for a pair's first common n-gram."""
    a_n, b_n = F.shiftright(a_place, 32), F.shiftright(b_place, 32)
    a_at, b_at = F.col(a_place).bitwiseAND(0xFFFFFFFF), F.col(b_place).bitwiseAND(0xFFFFFFFF)
    # Before the first common n-gram nothing is shared; after it, what both have left can be.
    most = F.least(a_n - a_at, b_n - b_at)
    return (100 * F.least(a_n, b_n) >= 80 * F.greatest(a_n, b_n)) & (most * 180 >= 80 * (a_n + b_n))


def _bloom_bits(n: int) -> int:
    return min(max((16 * n).bit_length(), BLOOM_LOG2[0]), BLOOM_LOG2[1])


def _bloom_places(ids: np.ndarray, log2: int) -> list[np.ndarray]:
    h = ids.astype(np.uint64) * _FOLD
    return [((h * m) >> np.uint64(64 - log2)).astype(np.int64) for m in (np.uint64(1), _MIX, np.uint64(0xA0761D6478BD642F))]


def _bloom(ids: DataFrame) -> np.ndarray:
    """Bits of the ids; a false hit only costs a row that a join drops."""
    log2 = _bloom_bits(ids.count())
    chunk = min(1 << 16, 1 << (log2 - 3))

    def run(batches: object) -> object:
        bits = np.zeros(1 << (log2 - 3), dtype=np.uint8)
        for batch in batches:
            for at in _bloom_places(batch.column(0).to_numpy(), log2):
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for k in range(0, len(bits), chunk):
            if (part := bits[k : k + chunk]).any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([_pressed(part)])], names=["at", "cells"])

    out = np.zeros(1 << (log2 - 3), dtype=np.uint8)
    for r in _merged(ids.mapInArrow(run, "at long, cells binary"), "uint8", np.bitwise_or).collect():
        out[r["at"] : r["at"] + chunk] = _loosened(r["cells"], "uint8")
    return out


def _sets(docs: DataFrame, keys: DataFrame, classes: DataFrame, keep: bool) -> DataFrame:
    """key, grams (sorted 64-bit hashes) of the classes whose keys are given, read again from their documents' texts
    without a shuffle; written if they are kept for several joins. False hits of the filter come as well, and a class comes once for each row of its id: joins drop them."""
    wanted = materialize(keys.select("key").distinct().join(classes.select("key", "id"), "key").select("id"), "wanted")
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(wanted))

    def start() -> object:
        bits = shared.value
        log2 = int(len(bits)).bit_length() + 2

        def work(batch: pa.RecordBatch) -> dict:
            ids = batch.column("id").fill_null(-1).to_numpy()
            hit = np.ones(len(ids), dtype=bool)
            for at in _bloom_places(ids, log2):
                hit &= (bits[at >> 3] >> (at & 7) & 1).astype(bool)
            some = batch.take(pa.array(np.flatnonzero(hit)))
            found = [ngrams(t) for t in some.column("text").to_pylist()]
            return {"key": [set_key(h) for h in found], "grams": [h.tobytes() for h in found]}

        return work

    sets = per_batch(docs.select("id", "text"), "key long, grams binary", start)
    return materialize(sets, "ngrams") if keep else sets


def overlaps(left: list[np.ndarray], right: list[np.ndarray], open_pairs: np.ndarray) -> np.ndarray:
    """Rows of left times the transpose of right: overlap counts of the open pairs that link, 0 elsewhere.

    The right side is held by columns. A left row adds the rows of its columns, COLUMNS at a time; when no open partner
    can still reach the overlap that both sizes ask for, the row is given up."""
    grams = np.concatenate(right)
    order = np.argsort(grams, kind="stable")
    columns, rows = grams[order], np.repeat(np.arange(len(right)), [len(x) for x in right])[order]
    sizes = np.array([len(x) for x in right], dtype=np.int64)
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for i, x in enumerate(left):
        least = least_overlap(len(x), sizes)
        counts, alive = np.zeros(len(right), dtype=np.int64), open_pairs[i] & (np.minimum(len(x), sizes) >= least)
        for at in range(0, len(x), COLUMNS):
            alive &= counts + (len(x) - at) >= least
            if not alive.any():
                break
            part = x[at : at + COLUMNS]
            low, high = np.searchsorted(columns, part, "left"), np.searchsorted(columns, part, "right")
            n = high - low
            places = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            counts += np.bincount(rows[places], minlength=len(right))
        else:
            out[i] = np.where(alive & (counts >= least), counts, 0)
    return out


UNIT = ["gram", "i", "j"]


def _open_pairs(left: dict, right: dict) -> np.ndarray:
    """Pairs of different components that the sizes, and the overlap that both places still allow, do not rule out."""
    (na, at_a), (nb, at_b) = ((side["place"] >> 32, side["place"] & 0xFFFFFFFF) for side in (left, right))
    most = np.minimum((na - at_a)[:, None], (nb - at_b)[None, :])
    fits = 100 * np.minimum(na[:, None], nb[None, :]) >= 80 * np.maximum(na[:, None], nb[None, :])
    return fits & (most * 180 >= 80 * (na[:, None] + nb[None, :])) & (left["component"][:, None] != right["component"][None, :])


def _taken(cols: dict, rows: np.ndarray) -> dict:
    return {n: c[rows] if isinstance(c, np.ndarray) else [c[k] for k in rows.tolist()] for n, c in cols.items()}


def _sides(unit: dict) -> tuple[dict, dict, np.ndarray, np.ndarray]:
    """Both sides of a unit, without repeated classes, and their places in it."""
    _, first = np.unique(np.stack((unit["side"], unit["key"])), axis=1, return_index=True)
    if unit["i"][0] == unit["j"][0]:
        side = _taken(unit, first)
        return side, side, first, first
    a, b = first[unit["side"][first] == 0], first[unit["side"][first] == 1]
    return _taken(unit, a), _taken(unit, b), a, b


def _shared_before(a: list, b: list) -> np.ndarray:
    """Whether the rows share an earlier block."""
    names = np.intersect1d(np.array([x for r in a for x in r], dtype=np.int64), np.array([x for r in b for x in r], dtype=np.int64))
    if not len(names):
        return np.zeros((len(a), len(b)), dtype=bool)

    def incidence(rows: list) -> np.ndarray:
        out = np.zeros((len(rows), len(names)), dtype=np.float32)
        for k, r in enumerate(rows):
            place = np.minimum(np.searchsorted(names, np.array(r, dtype=np.int64)), len(names) - 1)
            out[k, place[names[place] == r]] = 1
        return out

    return incidence(a) @ incidence(b).T > 0


def _with_partners(unit: dict) -> dict | None:
    """The rows of a unit that have an open pair which is to be judged here."""
    left, right, at_left, at_right = _sides(unit)
    if not len(at_left) or not len(at_right):
        return None
    pairs = _open_pairs(left, right)
    if pairs.any():
        pairs &= ~_shared_before(left["before"], right["before"])
    rows = np.unique(np.concatenate((at_left[pairs.any(axis=1)], at_right[pairs.any(axis=0)])))
    return {n: c for n, c in _taken(unit, rows).items() if n != "before"} if len(rows) else None


def _product(unit: dict) -> dict | None:
    """Links between the two sides of a unit, as a forest."""
    left, right, at_left, at_right = _sides(unit)
    if not len(at_left) or not len(at_right):
        return None
    sets = [[np.frombuffer(g, dtype=np.uint64) for g in side["grams"]] for side in (left, right)]
    forest = Forest()
    a, b = np.nonzero(overlaps(*sets, _open_pairs(left, right)))
    for x, y in zip(left["key"][a].tolist(), right["key"][b].tolist(), strict=True):
        forest.join(x, y)
    ends = [e for e in ((x, forest.root(x)) for x in list(forest.up)) if e[0] != e[1]]
    return {"a": [e[0] for e in ends], "b": [e[1] for e in ends]} if ends else None


def _links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows(UNIT, side, key, component, place) -> links a, b of the units' products."""
    return materialize(per_group(rows.join(sets, "key"), UNIT, "a long, b long", _product), "links", sweep=True)


def _rows_of_pairs(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Units of the pairs (a, b): a row a against its partners, PART of them at most on average."""
    of_a = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    dealt = pairs.select("a", "b").join(of_a, "a").withColumn("i", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    both = dealt.select(F.col("a").alias("gram"), "i", F.lit(0).alias("side"), F.col("a").alias("key")).distinct().unionByName(dealt.select(F.col("a").alias("gram"), "i", F.lit(1).alias("side"), F.col("b").alias("key")))
    # Whole rows: place 0; each row is a component of its own.
    return both.join(sizes, "key").select("gram", "i", F.lit(-1).alias("j"), "side", "key", F.col("key").alias("component"), F.shiftleft("n", 32).alias("place"))


def _rows_of_blocks(blocks: DataFrame) -> DataFrame:
    """Units of the blocks (gram, key, component, place) that hold several components: rows are dealt into parts, and each
    pair of parts is a unit."""
    members = blocks.groupBy("gram").agg(*[F.sum(F.xxhash64(F.lit(k), "key").cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)], F.count(F.lit(1)).alias("m"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    # Blocks with the same members are one; a member's place is its first in any of them.
    named = members.withColumn("block", F.min("gram").over(Window.partitionBy("s1", "s2", "m"))).select("gram", "block", F.ceil(F.col("m") / PART).cast("int").alias("parts"))
    once = blocks.join(named, "gram").groupBy(F.col("block").alias("gram"), "key").agg(F.min("place").alias("place"), F.min("component").alias("component"), F.min("parts").alias("parts"))
    before = Window.partitionBy("key").orderBy("place", "gram").rowsBetween(-BEFORE, -1)
    once = materialize(once, "open", sweep=True).withColumn("before", F.collect_list("gram").over(before))
    dealt = once.withColumn("b", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    units = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("b")).alias("i"), F.greatest(k, F.col("b")).alias("j"), (F.col("b") > k).cast("int").alias("side")))
    rows = dealt.withColumn("unit", F.explode(units)).select("gram", "unit.i", "unit.j", "unit.side", "key", "component", "place", "before")
    return materialize(per_group(rows, UNIT, "gram long, i int, j int, side int, key long, component long, place long", _with_partners), "rows", sweep=True)


def _linked_neighbours(chain: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links among neighbours (a, b, times) that give the components of all their links.

    While there are more open pairs than classes, a round judges one pair for each component, the one that most blocks
    have; judged pairs and those within a component then leave. So near copies, whose order differs from block to block,
    cost a few pairs for each class instead of one for each two neighbours. What is left is judged at once. Each round
    halves the components that have open pairs, or takes their only ones."""
    keys = chain.select(F.col("a").alias("key")).unionByName(chain.select(F.col("b").alias("key"))).distinct()
    ends, links = keys.count(), None
    open_pairs = chain.select("a", "b", "times", F.col("a").alias("ca"), F.col("b").alias("cb"))
    sets = _sets(docs, keys, classes, keep=open_pairs.count() > ends)
    while True:
        last = open_pairs.count() <= ends
        todo = open_pairs.select("a", "b")
        if not last:
            sides = open_pairs.select(F.col("ca").alias("c"), "times", "a", "b").unionByName(open_pairs.select(F.col("cb").alias("c"), "times", "a", "b"))
            best = sides.groupBy("c").agg(F.max(F.struct("times", "a", "b")).alias("best"))
            todo = materialize(best.select("best.a", "best.b").distinct(), "pairs")
        more = _links(_rows_of_pairs(todo, classes.select("key", "n")), sets)
        links = more if links is None else materialize(links.unionByName(more), "links")
        if last:
            drop(sets)
            return links
        of = materialize(components(links), "components")
        rest = open_pairs.select("a", "b", "times").join(todo, ["a", "b"], "left_anti")
        for side in ("a", "b"):
            rest = rest.join(of.select(F.col("vertex").alias(side), F.col("component").alias(f"c{side}")), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
        open_pairs = materialize(rest.filter("ca <> cb").select("a", "b", "times", "ca", "cb"), "pairs")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    first = materialize(_first_pass(docs), "sets")
    rows = first.filter("kind = 'doc'").select("id", "n", "key", "second")
    entries = _entries(docs, _levels(first.filter("kind = 'cells'").select(F.col("id").alias("at"), "cells")))
    blocks = materialize(_blocks(entries), "blocks", sweep=True)
    classes = materialize(rows.filter("n > 0 and id is not null").groupBy("key").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("second").alias("low"), F.max("second").alias("high")), "classes")
    if classes.filter("low <> high").limit(1).count():
        raise RuntimeError("two different sets share a 64-bit digest")

    near = blocks.filter("prev_key is not null").filter(_allowed("prev_place", "place"))
    chain = materialize(near.groupBy(F.least("key", "prev_key").alias("a"), F.greatest("key", "prev_key").alias("b")).agg(F.count(F.lit(1)).alias("times")), "pairs", sweep=True)
    links = _linked_neighbours(chain, docs, classes)
    found = components(links).select(F.col("vertex").alias("key"), "component")

    placed = blocks.select("gram", "key", "place").join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))
    placed = materialize(placed, "placed", sweep=True)
    drop(blocks)
    rest = _rows_of_blocks(placed)
    drop(placed)
    more = _links(rest, _sets(docs, rest, classes, keep=False))
    both = components(links.unionByName(more)).select(F.col("vertex").alias("key"), F.col("component").alias("joined"))

    # A component's number is the least id among its classes.
    groups = classes.select("key", "id").join(both, "key", "left").withColumn("joined", F.coalesce("joined", "key"))
    least = groups.groupBy("joined").agg(F.min("id").alias("component_id"))
    of_class = groups.join(least, "joined").select("key", "component_id")
    out = rows.join(of_class, "key", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id"))
