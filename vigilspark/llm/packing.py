"""Best-fit packing: vector bins with token, document-count and attention-cost capacities.

Each text is tokenised and ends with SEPARATOR. A document of n ids gives floor(n / tokens) full pieces and, first, a
piece of the rest. Full pieces fill a sequence each. The shorter pieces are packed by vector best-fit in decreasing
length: an item goes to a bin where it fits under every capacity, chosen by least weighted residual norm (or by
greatest weighted dot-product of demand and residual). With the contract's capacities tokens alone bind; pack() takes
tighter ones, and `packing_bounded` registers some that bind.

Items of one length are alike, so the packing is planned over the histogram of lengths: bins with equal residuals are
a class with a count, and one step deals a run of equal items over a run of equal bins: a bin that an item has entered
is filled on with items of that length. The histogram
has `tokens` rows and the plan a few rows for each length and class, whatever the number of documents. Items get their
place in the plan by a distributed rank in their length: counts by (length, block) and a prefix sum over blocks.

Defined results: null texts are empty (one piece: the separator); rows with repeated ids are packed apart, each with
its own pieces; null ids stay null; very long texts, long runs of white space among them, are cut
whole; equally good bins are taken by least residual; no rows give no rows; other columns are ignored; sequences are gapless from
offset 0."""

from __future__ import annotations

import functools
import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.llm.common import materialize, per_batch

SEPARATOR = 2
TOKENS = 1024
#: With these, tokens alone bind: as few sequences as can be. Tighter ones bind as well.
DOCUMENTS, ATTENTION = 1024, 1024 * 1024
#: Pieces of a block at most on average, and blocks at least, among which equal lengths are ranked.
BLOCK_ROWS, BLOCKS = 1 << 16, 256


@functools.cache
def encoder(json_path: str) -> object:
    """ids(texts) as the tokenizers file gives them (special tokens' strings included), by the same merges as ranks."""
    import json

    import tiktoken

    with open(json_path, encoding="utf-8") as f:
        spec = json.load(f)
    from_char = _byte_of_char()
    ranks = {bytes(from_char[c] for c in token): n for token, n in spec["model"]["vocab"].items() if all(c in from_char for c in token)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    for t in special:
        ranks.pop(t.encode(), None)
    coder = tiktoken.Encoding("byte-level", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)
    has = tuple(special)
    apart = re.compile("(" + "|".join(map(re.escape, has)) + ")")

    def ordinary(text: str) -> list[int]:
        if len(text) < 1000 or not _LONG_RUN.search(text):
            return coder.encode_ordinary(text)
        # A run is one piece, but for its last character if something follows.
        out, at = [], 0
        for run in _LONG_RUN.finditer(text):
            until = run.end() - (run.end() < len(text))
            out += coder.encode_ordinary(text[at : run.start()]) if at < run.start() else []
            out += coder._encode_single_piece(text[run.start() : until])
            at = until
        return out + (coder.encode_ordinary(text[at:]) if at < len(text) else [])

    def encode(text: str) -> list[int]:
        if any(t in text for t in has):
            return [i for part in apart.split(text) for i in ([special[part]] if part in special else ordinary(part) if part else [])]
        return ordinary(text)

    encode.ordinary = ordinary  # special tokens' strings as ordinary text
    return encode


#: White space as the cuts below have it; runs so long overflow the matcher's stack there and are cut by hand.
_LONG_RUN = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


#: Fixed value: how byte-level BPE cuts a text before its merges.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others as code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def pieces(docs: DataFrame, json_path: str, tokens: int = TOKENS) -> DataFrame:
    """Pieces of at most `tokens` ids: doc_id, row (distinct for each row), piece, start, length, ids_crc32 of every piece of every document."""

    def start() -> object:
        encode = encoder(json_path)

        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "row", "piece", "start", "length", "ids_crc32")}
            for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                ids = np.array([*(encode(text) if text else ()), SEPARATOR], dtype="<u4").tobytes()
                at, n = 0, len(ids) // 4
                for k in range(-(-n // tokens)):
                    length = (n % tokens or tokens) if k == 0 else tokens
                    for name, value in zip(out, (doc, row, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])), strict=True):
                        out[name].append(value)
                    at += length
            return out

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    return per_batch(rows, "doc_id long, row long, piece int, start long, length long, ids_crc32 long", start)


class Step(NamedTuple):
    """Items first..first+items-1 of a length go to bins bin.., each bin taking `each` of them, from offset on."""

    length: int
    first: int
    items: int
    each: int
    bin: int
    offset: int


def plan(histogram: dict[int, int], tokens: int, documents: int, attention: int, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> tuple[list[Step], int]:
    """Vector best-fit of histogram[length] items of each length; attention cost of an item is its length squared.

    A class of bins is (residual tokens, documents, attention) -> runs of (first bin, count)."""
    classes: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    steps: list[Step] = []
    bins = 0
    whole = (tokens, documents, attention)

    def badness(left: tuple[int, int, int], need: tuple[int, int, int]) -> float:
        if rule == "dot":
            return -sum(w * a / c * b / c for w, a, b, c in zip(weights, left, need, whole, strict=True))
        return sum(w * ((a - b) / c) ** 2 for w, a, b, c in zip(weights, left, need, whole, strict=True))

    for length in sorted(histogram, reverse=True):
        need, left, first = (length, 1, length * length), histogram[length], 0
        if any(n > c for n, c in zip(need, whole, strict=True)):
            raise ValueError(f"an item of {length} tokens exceeds a bin's capacities {whole}")
        while left:
            fits = [c for c in classes if c[0] >= length and c[1] >= 1 and c[2] >= need[2]]
            best = min(fits, key=lambda c: (badness(c, need), c)) if fits else whole
            most = min(best[0] // length, best[1], best[2] // need[2])
            if rule == "dot" and fits:
                most = 1  # the next item may prefer another bin
            if best in classes:
                at, count = classes[best].pop()
                if not classes[best]:
                    del classes[best]
            else:
                at, count = bins, -(-left // most)
                bins += count
            for each, of in ((most, min(count, left // most)), (left % most, 1 if left // most < count and left % most else 0)):
                if not of or not each:
                    continue
                steps.append(Step(length, first, each * of, each, at, tokens - best[0]))
                rest = (best[0] - each * length, best[1] - each, best[2] - each * need[2])
                classes.setdefault(rest, []).append((at, of))
                first, at, count = first + each * of, at + of, count - of
            left = histogram[length] - first
            if count:
                classes.setdefault(best, []).append((at, count))
    return steps, bins


def pack(docs: DataFrame, json_path: str, tokens: int = TOKENS, documents: int = DOCUMENTS, attention: int = ATTENTION, rule: str = "norm", piece: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; piece: longest piece, a sequence's tokens if not given."""
    spark = docs.sparkSession
    every = materialize(pieces(docs, json_path, piece or tokens), "pieces")
    if piece is not None and piece > tokens:
        raise ValueError("a piece is longer than a sequence")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # A full piece is a sequence by itself: no rank, no shuffle; its number is negative.
    full = every.filter(F.col("length") == tokens).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    blocks = max(BLOCKS, -(-every.count() // BLOCK_ROWS))
    cut = every.filter(F.col("length") < tokens).withColumn("block", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(blocks)).cast("int"))
    counts = materialize(cut.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")), "lengths")  # at most tokens x blocks rows
    # At most `tokens` rows: one for each length.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps, _ = plan(histogram, tokens, documents, attention, rule)
    dealt = spark.createDataFrame(steps, "length long, first long, items long, each long, bin long, offset long")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).select("length", "block", "before")
    # A block's first rank of a length cuts the plan's runs further: no row meets a run of another block.
    runs = before.join(counts, ["length", "block"]).join(F.broadcast(dealt), "length").filter((F.col("first") < F.col("before") + F.col("n")) & (F.col("first") + F.col("items") > F.col("before")))
    runs = runs.groupBy("length", "block").agg(F.first("before").alias("before"), F.array_sort(F.collect_list(F.struct("first", "items", "each", "bin", "offset"))).alias("runs"))
    rank = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "row", "piece")) - 1
    placed = cut.withColumn("k", rank).join(runs, ["length", "block"]).withColumn("k", F.col("k") + F.col("before"))
    placed = placed.withColumn("run", F.filter("runs", lambda r: (r["first"] <= F.col("k")) & (F.col("k") < r["first"] + r["items"]))[0])
    within = F.col("k") - F.col("run.first")
    return full.unionByName(placed.select(
        *columns,
        (F.col("run.bin") + F.floor(within / F.col("run.each"))).cast("long").alias("sequence_id"),
        (F.col("run.offset") + F.pmod(within, F.col("run.each")) * F.col("length")).cast("long").alias("offset"),
    ))
