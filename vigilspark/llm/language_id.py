"""Language ID by rank-order profiles: a document's most frequent n-grams against each language's, by out-of-place distance.

Letters are lower-cased and mapped to a learned alphabet (all letters of the sample, of whatever script; letters
that it lacks share one symbol); runs of other characters are one boundary symbol. N-grams of 1 to 3 symbols are counted over the whole
text; the TOP most frequent, ties by code, form a profile. The distance adds, over the document's profile, how far
each n-gram stands from its place in the language's profile, TOP where the language lacks it.

Learned from at most PER_LANGUAGE rows of each language, the first by a hash of the id (a stated bound, not a prefix of
the table). Each language's n-gram counts are summed on the executors; the driver gets TOP rows a language.

Defined results: null texts and texts without letters get `und` and score 0; very long texts are read whole; a null id
gives a row with a null id; rows that share an id that is chosen are all learned from; ties between languages go to the first
by name; without any learnable row every text gets `und`; repeated rows each give a row; no rows give no rows;
columns other than id, text and language are ignored."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.llm.common import fold_of, materialize, per_batch

TOP = 300
PER_LANGUAGE = 1000
#: Code spaces up to this are counted in dense arrays.
DENSE = 1 << 19
UNDETERMINED = "und"


class Profiles(NamedTuple):
    letters: np.ndarray  # code points, most frequent first
    languages: list[str]
    known: np.ndarray  # codes of all profiles, sorted
    ranks: np.ndarray  # language x place in known -> place in the profile, TOP where absent; a last column for other codes


@functools.cache
def _letter_table() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Grams:
    """N-gram codes of texts over an alphabet: boundary 0, letters from 1, other letters last."""

    def __init__(self, letters: np.ndarray) -> None:
        self.bits = int(len(letters) + 1).bit_length()
        self.size = 1 << 3 * self.bits
        self.symbol = np.where(_letter_table(), len(letters) + 1, 0).astype(np.int32 if self.bits < 10 else np.int64)
        self.symbol[letters] = np.arange(1, len(letters) + 1)

    def codes(self, text: str) -> np.ndarray | None:
        """Codes of all n-grams; None if there is no letter."""
        s = self.symbol[_points(text)]
        if not s.any():
            return None
        s = np.concatenate(([0], s, [0]))
        s = s[(s != 0) | np.concatenate(([True], s[:-1] != 0))]
        # A code's order shows in its high symbols: longer ones carry an offset of their own.
        two = (s[:-1] << self.bits) | s[1:]
        three = (two[:-1] << self.bits) | s[2:]
        n = 1 << self.bits
        return np.concatenate((s[s > 0], n + two, n + n * n + three))

    @property
    def space(self) -> int:
        return (1 << self.bits) + (1 << 2 * self.bits) + self.size

    def top(self, codes: np.ndarray) -> np.ndarray:
        """The most frequent codes, most frequent first, ties by code."""
        if len(codes) > 4000 and self.space <= DENSE:
            counts = np.bincount(codes, minlength=self.space)
            found = np.flatnonzero(counts)
            counts = counts[found]
        else:
            found, counts = np.unique(codes, return_counts=True)
        if len(found) > TOP:
            least = np.partition(counts, len(counts) - TOP)[len(counts) - TOP]
            keep = counts >= least
            found, counts = found[keep], counts[keep]
        return found[np.lexsort((found, -counts))][:TOP]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their counts over all parts."""
    found, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return found, np.bincount(place, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of the rows given (the caller leaves held-out rows away)."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    # Ids alone are ranked, and of them only those in the least buckets of hashes that hold PER_LANGUAGE rows of a language
    # between them, as summed counts say; texts join on the few that are chosen.
    hashed = known.select("id", "lang", F.shiftright(F.xxhash64("id"), 52).alias("bucket"))
    sizes = hashed.groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("lang").orderBy("bucket")) - F.col("n")).filter(F.col("before") < PER_LANGUAGE)
    cuts = before.groupBy("lang").agg(F.max("bucket").alias("cut"))  # a row for each language, as the profiles have
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    near = hashed.join(F.broadcast(cuts), "lang").filter(F.col("bucket") <= F.col("cut"))
    chosen = near.select("id", "lang").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= PER_LANGUAGE).select("id", "lang").distinct()
    sample = materialize(known.join(F.broadcast(chosen), ["id", "lang"]).select("text", "lang"), "sample")  # PER_LANGUAGE ids a language

    def letters_of() -> object:
        is_letter = _letter_table()

        def work(batch: pa.RecordBatch) -> dict:
            total = np.zeros(sys.maxunicode + 1, dtype=np.int64)
            for text in batch.column("text").to_pylist():
                total += np.bincount(_points(text), minlength=len(total)) if len(text) > 100_000 else 0
                if len(text) <= 100_000:
                    c, n = np.unique(_points(text), return_counts=True)
                    total[c] += n
            found = np.flatnonzero((total > 0) & is_letter)
            return {"point": found, "n": total[found]}

        return work

    # The alphabet: one row for each letter that occurs.
    alphabet = per_batch(sample.select("text"), "point long, n long", letters_of).groupBy("point").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "point")
    letters = np.array([r["point"] for r in alphabet.collect()], dtype=np.int64)

    def counts_of() -> object:
        grams = Grams(letters)

        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if (codes := grams.codes(text)) is not None:
                    c, n = np.unique(codes, return_counts=True)
                    out.setdefault(lang, []).append((c, n))
            found = {lang: _summed(parts) for lang, parts in out.items()}
            return {"lang": [lang for lang, (c, _) in found.items() for _ in c], "code": [int(x) for c, _ in found.values() for x in c], "n": [int(x) for _, n in found.values() for x in n]}

        return work

    counted = per_batch(sample, "lang string, code long, n long", counts_of).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("k") <= TOP).collect()
    languages = sorted({r["lang"] for r in ranked})
    known = np.unique(np.array([r["code"] for r in ranked], dtype=np.int64))
    ranks = np.full((len(languages), len(known) + 1), TOP, dtype=np.int16)
    for r in ranked:
        ranks[languages.index(r["lang"]), np.searchsorted(known, r["code"])] = r["k"] - 1
    return Profiles(letters, languages, known, ranks)


def predictor(profiles: Profiles) -> Callable[[str | None], tuple[str, float]]:
    """The function from a text to its language and score: 1 less the distance's share of the largest possible one."""
    letters, languages, known, ranks = profiles
    grams = Grams(letters)
    places = np.arange(TOP, dtype=np.int32)

    def one(text: str | None) -> tuple[str, float]:
        codes = grams.codes(text) if text and languages else None
        if codes is None:
            return UNDETERMINED, 0.0
        top = grams.top(codes)
        at = np.searchsorted(known, top)
        at[known[np.minimum(at, len(known) - 1)] != top] = len(known)
        far = np.abs(ranks[:, at] - places[: len(top)])
        far[ranks[:, at] == TOP] = TOP
        total = far.sum(axis=1)
        best = int(total.argmin())
        return languages[best], max(0.0, 1.0 - float(total[best]) / (TOP * len(top)))

    return one


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # TOP places a language

    def start() -> object:
        one = predictor(shared.value)

        def work(batch: pa.RecordBatch) -> dict:
            found = [one(text) for text in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

        return work

    return per_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id long, lang_pred string, score double", start)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows whose crc32(doc_id as text) mod 5 is 0 are held out of learning."""
    profiles = learn(docs.filter(fold_of("doc_id", 5) != 0))
    return predict(docs, profiles).select("doc_id", (F.coalesce(fold_of("doc_id", 5), F.lit(0)) == 0).alias("held_out"), "lang_pred", "score")
