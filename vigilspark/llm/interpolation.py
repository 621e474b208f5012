"""Language-model scores by deleted interpolation of n-gram maximum-likelihood estimates.

A token's probability after its history is

    l0(b) / (V + 1)  +  l1(b) c(w) / N  +  l2(b) c(v w) / c(v)  + ...

with weights l for the bucket b of the history's frequency: its binary order of magnitude, 0 for an unseen one. The
weights are learned by expectation-maximisation on held-out counts: of the training documents, those of one fold in
FOLDS are deleted from the counts, and their tokens are rated by the counts of the rest. Scores then use the counts of
all training documents.

Words are 64-bit hashes of their lower-cased bytes; n-grams are hashes of hashes. A task turns its texts into blocks of
BLOCK bytes. A block asks for the counts of its different n-grams: their sorted hashes, with the block's own counts, are
dealt by ranges of hashes into buckets. A bucket adds the counts up over all blocks and answers each block in the order
of its question. The answers meet the block's tokens (numbers into its list of words) by the block's number, so that no
text and no n-gram of one document is shuffled, and a frequent word or n-gram is one entry in each block. What meets is
written once: the counts of every token. Each round of EM reads those of the deleted fold and brings the driver one sum
for each bucket and order.

The documents have to be a deterministic scan (such as a Parquet table): its tasks are run twice and have to cut the same
blocks; a block that differs fails.

Defined results: null texts are empty; a text without words has one token, the end; null ids are neither learned from nor
held out; rows with repeated ids are documents of their own; without training documents every token has the probability
1 / (V + 1) with V = 0; no rows give no rows; very long texts are read whole (a text is never cut between blocks); other
columns, whatever their names, are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.common import materialize, per_group

ORDER = 2
FOLDS = 10
BLOCK = 12 << 20
#: Bytes of text for each bucket of hashes.
BUCKET_BYTES = 16 << 20
ROUNDS = 15
#: Orders of magnitude of a history's count.
SIZES = 48

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_ODD = np.uint64(0xD6E8FEB86659FD93)
#: Keys of the end token and of the history before the first token.
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n at least."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, 1 << 20)
        pair = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            pair.append(np.multiply.accumulate(out))
        _POWERS[0] = (pair[0], pair[1])
    return _POWERS[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(32))


def tokens(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of all texts (bytes data between edges), each text's last one END, and tokens of each text."""
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[edges] = True
    change = np.ones(len(data) + 1, dtype=bool)  # before each byte, and after the last
    change[1:-1] = inside[1:] != inside[:-1]
    change |= first
    start, stop = np.flatnonzero(inside & change[:-1]), np.flatnonzero(inside & change[1:]) + 1
    keys = np.empty(len(start), dtype=np.uint64)
    low = 0
    while low < len(start):  # a megabyte at a time; a longer word by itself
        high = max(low + 1, int(np.searchsorted(stop, start[low] + (1 << 20), side="right")))
        a, b = int(start[low]), int(stop[high - 1])
        up, down = _powers(b - a)
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_VALUE[data[a:b]] * up[: b - a], dtype=np.uint64)))
        keys[low:high] = (sums[stop[low:high] - a] - sums[start[low:high] - a]) * down[start[low:high] - a]
        low = high
    words = np.diff(np.searchsorted(start, edges))
    ends = np.cumsum(words + 1) - 1
    out = np.full(len(start) + len(words), END, dtype=np.uint64)
    place = np.ones(len(out), dtype=bool)
    place[ends] = False
    out[place] = _mixed(keys)
    return out, words + 1


def histories(keys: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the runs of 1 to order tokens that end at each token; runs start anew in each text, after BEGIN."""
    heads = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
    out = [keys]
    for _ in range(order - 1):
        before = np.roll(out[-1], 1)
        before[heads] = BEGIN
        out.append(_mixed(before * np.uint64(_BASE) + keys))
    return out


def planes(x: np.ndarray) -> bytes:
    """How many bytes the largest number takes, then all lowest bytes, all second ones, ...: what is alike stands together."""
    width = (int(x.max(initial=1)).bit_length() + 7) // 8
    return bytes([width]) + np.ascontiguousarray(x, dtype=np.uint64).view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    rows = np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((rows.shape[1], 8), dtype=np.uint8)
    out[:, : raw[0]] = rows.T
    return out.view(np.uint64).reshape(-1)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(number, documents, keys of their tokens, tokens of each) of texts of BLOCK bytes or one longer one; see folded()."""
    number = None
    for batch in batches:
        if number is None and batch.num_rows:
            number = batch.column(4)[0].as_py() << 32
        text = batch.column(3).fill_null("").cast(pa.large_string())
        edges = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
        low = 0
        while low < len(text):
            high = max(low + 1, int(np.searchsorted(edges, edges[low] + BLOCK, side="right")) - 1)
            keys, counts = tokens(data[edges[low] : edges[high]], edges[low : high + 1] - edges[low])
            yield number, batch.slice(low, high - low), keys, counts
            number += 1
            low = high


QUESTION = "ord int, bucket int, block long, keys binary, kept binary, deleted binary"


def questions(docs: DataFrame, order: int, buckets: int) -> DataFrame:
    """The different n-grams of each block, with the block's own counts in the fold that is deleted and in the others."""
    schema = pa.schema([("ord", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("kept", pa.binary()), ("deleted", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest = np.array([(k << 64) // buckets for k in range(buckets)], dtype=np.uint64)  # key of each bucket
        for number, documents, keys, counts in blocks(batches):
            fold = documents.column(2).fill_null(-1).to_numpy()
            of_token, rows = np.repeat(fold, counts), []
            for k, grams in enumerate(histories(keys, counts, order), 1):
                names, place = np.unique(grams, return_inverse=True)
                kept, deleted = (np.bincount(place[of_token == f], minlength=len(names)) for f in (1, 0))
                edges = [*np.searchsorted(names, lowest).tolist(), len(names)]
                rows += [(k, b, number, planes(np.diff(names[i:j], prepend=np.uint64(0))), planes(kept[i:j]), planes(deleted[i:j])) for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, QUESTION)


def answer(group: dict) -> dict:
    """Counts over all blocks of the n-grams that each block asked for, without the deleted fold only where the block's part
    of that fold has them; own: n-grams of the training documents of which
    this block is the one that counts them as different words."""
    keys = [np.cumsum(from_planes(x), dtype=np.uint64) for x in group["keys"]]
    sizes = [len(x) for x in keys]
    names, place = np.unique(np.concatenate(keys), return_inverse=True)
    kept, deleted = (np.bincount(place, np.concatenate([from_planes(x) for x in group[c]]), len(names)).astype(np.int64) for c in ("kept", "deleted"))
    first = np.full(len(names), len(sizes))
    np.minimum.at(first, place, np.repeat(np.arange(len(sizes)), sizes))
    own = np.bincount(first[kept + deleted > 0], minlength=len(sizes))
    edges = np.cumsum([0, *sizes])
    part = lambda x, k: x[place[edges[k] : edges[k + 1]]]
    every = range(len(sizes))
    return {"ord": group["ord"], "bucket": group["bucket"], "block": group["block"], "own": own, "kept": [planes(part(kept, k)[from_planes(group["deleted"][k]) > 0]) for k in every], "whole": [planes(part(kept + deleted, k)) for k in every]}


ANSWER = "ord int, bucket int, block long, own long, kept binary, whole binary"
#: A block's texts as numbers into its sorted list of words; ord is 0.
TOKENS = "ord int, bucket int, block long, own long, kept binary, whole binary, doc_id array<long>, held_out array<boolean>, fold array<int>, counts array<int>, words binary, places binary"


def token_lists(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("ord", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("own", pa.int64()), ("kept", pa.binary()), ("whole", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("fold", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("words", pa.binary()), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, documents, keys, counts in blocks(batches):
            names, place = np.unique(keys, return_inverse=True)
            row = [0, 0, number, 0, None, None, *(documents.column(k).to_pylist() for k in range(3)), counts.tolist(), planes(np.diff(names, prepend=np.uint64(0))), planes(place)]
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, TOKENS)


#: whole: counts of each token's n-grams, order by order; kept: the same without the deleted fold, of that fold's tokens.
COUNTED = "block long, own long, doc_id array<long>, held_out array<boolean>, fold array<int>, counts array<int>, whole array<binary>, kept array<binary>"


def meet(group: dict, order: int) -> dict:
    at = int(np.flatnonzero(group["ord"] == 0)[0])
    counts = np.array(group["counts"][at], dtype=np.int64)
    keys = np.cumsum(from_planes(group["words"][at]), dtype=np.uint64)[from_planes(group["places"][at])]
    fold = np.array([-1 if x is None else x for x in group["fold"][at]])
    deleted = np.repeat(fold == 0, counts)
    whole, kept = [], []
    for k, grams in enumerate(histories(keys, counts, order), 1):
        rows = np.flatnonzero(group["ord"] == k)
        rows = rows[np.argsort(group["bucket"][rows])]
        names, place = np.unique(grams, return_inverse=True)
        used = np.bincount(place[deleted], minlength=len(names)) > 0
        for name, out, asked, wanted in (("whole", whole, np.ones_like(used), slice(None)), ("kept", kept, used, deleted)):
            found = np.concatenate([from_planes(group[name][r]) for r in rows])
            if len(found) != asked.sum():
                raise RuntimeError("the documents are not a deterministic scan: a block has other n-grams than before")
            counted = np.zeros(len(names), dtype=np.uint64)
            counted[asked] = found
            out.append(planes(counted[place][wanted]))
    own = int(group["own"][group["ord"] == 1].sum())
    return {"block": np.array([group["block"][at]]), "own": np.array([own]), **{c: [group[c][at]] for c in ("doc_id", "held_out", "fold", "counts")}, "whole": [whole], "kept": [kept]}


def estimates(counts: list[np.ndarray], lengths: np.ndarray, total: int, texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token's history, and its probability by each order (0: all alike), a row for each order."""
    heads = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    p = np.full((len(counts) + 1, len(counts[0])), 1.0 / (size + 1))
    history = np.full(len(counts[0]), float(total))
    for k, c in enumerate(counts):
        if k:  # every token of a training text but the end is followed by one, so a history's count is that of its followers
            history = np.roll(counts[k - 1], 1).astype(np.float64)
            history[heads] = texts
        # An order whose history is unseen says what the order below says.
        p[k + 1] = np.divide(c, history, out=p[k].copy(), where=history > 0)
    return np.where(history > 0, np.floor(np.log2(np.maximum(history, 1))) + 1, 0).astype(np.int64), p


def _rated(batch: pa.RecordBatch, k: int, name: str, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    lengths = np.array(batch.column("counts")[k].as_py(), dtype=np.int64)
    if name == "kept":
        lengths = lengths[np.array([x == 0 for x in batch.column("fold")[k].as_py()], dtype=bool)]
    raw = batch.column(name)[k].as_py()
    return [from_planes(raw[j]).astype(np.int64) for j in range(order)], lengths


def learn(counted: DataFrame, order: int, kept_tokens: int, kept_texts: int, size: int) -> np.ndarray:
    """Weights, a row for each bucket: EM over the deleted fold. Each round brings the driver SIZES x (order + 1) sums for
    each task's batch; buckets without tokens take the sums of all."""
    weights = np.full((SIZES, order + 1), 1.0 / (order + 1))
    rows = counted.select("counts", "fold", "kept")
    for _ in range(ROUNDS):
        now = weights

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            sums, seen = np.zeros((SIZES, order + 1)), 0.0
            for batch in batches:
                for k in range(batch.num_rows):
                    counts, lengths = _rated(batch, k, "kept", order)
                    if not len(counts[0]):
                        continue
                    bucket, p = estimates(counts, lengths, kept_tokens, kept_texts, size)
                    share = p * now[bucket].T
                    every = share.sum(axis=0)
                    seen += float(np.log(every).sum())
                    share /= every
                    for j in range(order + 1):
                        sums[:, j] += np.bincount(bucket, share[j], SIZES)
            yield pa.RecordBatch.from_arrays([pa.array([sums.ravel().tolist()], pa.list_(pa.float64())), pa.array([seen])], names=["sums", "seen"])

        parts = rows.mapInArrow(run, "sums array<double>, seen double").select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()  # SIZES x (order + 1) rows
        sums = np.zeros(SIZES * (order + 1))
        sums[[r["k"] for r in parts]] = [r["x"] for r in parts]
        sums = sums.reshape(SIZES, order + 1)
        # A prior of one token for each bucket, spread as in all buckets, keeps every weight above 0.
        prior = (sums.sum(axis=0) + 1) / (sums.sum() + order + 1)
        after = (sums + prior) / (sums.sum(axis=1, keepdims=True) + 1)
        moved = float(np.abs(after - weights).max())
        weights = after
        if moved < 1e-3:
            break
    return weights


SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(counted: DataFrame, weights: np.ndarray, order: int, total: int, texts: int, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                counts, lengths = _rated(batch, k, "whole", order)
                bucket, p = estimates(counts, lengths, total, texts, size)
                logs = np.log10((p * weights[bucket].T).sum(axis=0))
                base = np.log10((counts[0] + 0.1) / (total + 0.1 * (size + 1)))
                heads = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
                sums = [np.add.reduceat(x, heads) for x in ((counts[0] > 0).astype(np.int64), base, logs)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[k].values, batch.column("held_out")[k].values, pa.array(lengths), *map(pa.array, sums)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return counted.select("doc_id", "held_out", "counts", "whole").mapInArrow(run, SCORE)


def folded(docs: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 10 is 0), fold, text, part of the scan. fold is null for what isn't learned
    from, 0 for what is deleted while weights are learned, else 1."""
    crc = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    deleted = F.floor(crc / 10) % FOLDS == 0
    fold = F.when(crc % 10 != 0, F.when(deleted, 0).otherwise(1)).cast("int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc % 10 == 0, F.lit(False)).alias("held_out"), fold.alias("fold"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("part"))


def train(docs: DataFrame, order: int = ORDER) -> tuple[DataFrame, dict]:
    """The counts of every token of docs(doc_id, text), written, and the model's figures and weights."""
    d = folded(docs)
    n_bytes = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(16, math.ceil(n_bytes / BUCKET_BYTES))
    answers = per_group(questions(d, order, buckets), ["ord", "bucket"], ANSWER, answer, parts=order * buckets)
    met = answers.unionByName(token_lists(d), allowMissingColumns=True)
    counted = materialize(per_group(met, ["block"], COUNTED, lambda g: meet(g, order), parts=max(8, math.ceil(2 * n_bytes / BLOCK))), "counted")
    each = counted.select("own", F.explode(F.arrays_zip("fold", "counts")).alias("d")).groupBy("d.fold").agg(F.sum("d.counts").alias("n"), F.count(F.lit(1)).alias("texts"))
    by_fold = {r["fold"]: (r["n"], r["texts"]) for r in each.collect()}  # three rows at most
    kept, deleted = by_fold.get(1, (0, 0)), by_fold.get(0, (0, 0))
    size = counted.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]
    weights = learn(counted, order, *kept, size)
    return counted, {"order": order, "tokens": kept[0] + deleted[0], "texts": kept[1] + deleted[1], "size": size, "weights": weights}


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    counted, m = train(docs, order)
    out = score(counted, m["weights"], m["order"], m["tokens"], m["texts"], m["size"])
    return out.withColumn("train_tokens", F.lit(m["tokens"]).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
