"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

DataFrame functions only. A text's shingles are its distinct runs of WORDS words (lower-cased, split at white space;
with fewer words the whole sequence, with none no shingle). Every shingle is hashed once; the hash's top bits name one
of BINS bins and each bin keeps its least hash. An empty bin copies a filled one chosen by a hash sequence of its own
(probe after probe, and past PROBES the filled bin of least priority), which is the optimal densification's random
choice. Each bin then keeps BITS low-order bits, written as hexadecimal digits.

Likeness of two fingerprints: the share of equal bins, corrected for chance agreement C = 2^-BITS as (share - C) / (1 - C),
held to 0..1.

Defined results: null text is empty; texts without words have the fingerprint of all `ff` and are like each other (1)
and unlike every other (0); equal texts have equal fingerprints; repeated rows and repeated ids each give their row;
very long texts are read whole; a null id is
edited with nothing and near_next is 0; no rows give no rows; other columns, whatever their names, are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.common import materialize

WORDS, BINS_LOG2, BITS, PROBES = 5, 7, 8, 12
BINS = 1 << BINS_LOG2
EMPTY = "ff" * BINS
#: Children of one level of next_row(); any ids are dealt into groups of at most this many.
FAN_LOG2 = 12


def shingle_hashes(words: Column) -> Column:
    """One hash for each run of WORDS words; words must be a column of its own, or it would be computed anew each time."""
    runs = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (WORDS - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WORDS)]),
    )
    return F.when(F.size(words) >= WORDS, runs).when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BINS_LOG2).cast("int")


def _densified(bins: Column) -> Column:
    """bins: array of BINS least hashes or nulls, a column of its own with one filled bin at least."""

    def priority(j: Column, m: Column) -> Column:
        return F.xxhash64(j, m, F.lit(-1))

    def filled(j: Column) -> Column:
        probes = [F.get(bins, F.pmod(F.xxhash64(j, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
        rest = F.array_min(F.filter(F.transform(bins, lambda v, m: F.when(v.isNotNull(), F.struct(priority(j, m).alias("p"), v.alias("v")))), lambda s: s.isNotNull()))["v"]
        return F.coalesce(*probes, rest)

    return F.transform(bins, lambda v, j: F.when(v.isNotNull(), v).otherwise(filled(j)))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the fingerprint of column text as column out."""
    d = df.withColumn("__w", words_of(F.coalesce(F.col(text), F.lit(""))))
    d = d.withColumn("__h", F.sort_array(shingle_hashes(F.col("__w")))).drop("__w")
    # Signed order starts at the upper half of the bins, but hashes of a bin still stand together, least first.
    least = F.filter("__h", lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(F.col("__h"), i - 1))))
    d = d.withColumn("__least", F.transform(least, lambda h: F.struct(_bin(h).alias("key"), h.alias("value")))).drop("__h")
    d = d.withColumn("__map", F.map_from_entries("__least")).drop("__least")
    d = d.withColumn("__bins", F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.element_at(F.col("__map"), j)))
    low = F.array_join(F.transform(_densified(F.col("__bins")), lambda v: F.lpad(F.lower(F.hex(v.bitwiseAND((1 << BITS) - 1))), BITS // 4, "0")), "")
    return d.withColumn(out, F.when(F.size("__map") > 0, low).otherwise(EMPTY)).drop("__map", "__bins")


def likeness(a: Column, b: Column) -> Column:
    """a and b: fingerprints as written by with_fingerprint()."""
    width = BITS // 4
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(BINS - 1)),
        F.lit(0),
        lambda n, j: n + (F.substr(a, j * width + 1, F.lit(width)) == F.substr(b, j * width + 1, F.lit(width))).cast("int"),
    )
    chance = 2.0**-BITS
    corrected = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same / F.lit(float(BINS)) - chance) / (1 - chance)))
    none = (a == EMPTY) | (b == EMPTY)
    return F.when(a == b, F.lit(1.0)).when(none, F.lit(0.0)).otherwise(corrected)


def next_ids(ids: DataFrame) -> DataFrame:
    """ids(id) -> id, next_id over the distinct ids; the last one's next is the first.

    A tree of windows, never one window over all: ids are dealt into groups of at most 2^FAN_LOG2 children by their
    high bits, each group finds its members' successors, and a group's last member takes the least id of the next
    group, found in the same way one level up."""
    level = ids.select("id").distinct().withColumn("low", F.col("id"))
    levels: list[DataFrame] = []
    shift = 0
    while shift < 64:
        shift = min(64, shift + FAN_LOG2)
        group = F.shiftright("id", shift) if shift < 64 else F.lit(0).cast("long")
        levels.append(level.withColumn("grp", group))
        level = levels[-1].groupBy("grp").agg(F.min("low").alias("low")).withColumnRenamed("grp", "id")
    after = None  # group -> least id after that group
    for members in reversed(levels):
        inner = members.withColumn("nxt", F.expr("lead(low) over (partition by grp order by id)"))
        if after is None:  # the top group holds everything, 16 members at most: its last one goes back to the first
            inner = inner.withColumn("nxt", F.coalesce("nxt", F.expr("min(low) over (partition by grp)")))
        else:
            inner = inner.join(after, "grp").withColumn("nxt", F.coalesce("nxt", "after")).drop("after")
        after = inner.select(F.col("id").alias("grp"), F.col("nxt").alias("after"))
    return after.select(F.col("grp").alias("id"), F.col("after").alias("next_id"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> id, text, next_prefix, n_chars and edited, where the last floor(n/4) code points of a text give way to
    the first as many (or all) of the next document by ascending id. Of rows that share an id, the next document is
    the one whose text has the least 64-bit hash (of equal hashes the least prefix); a null id takes no part and is edited with nothing."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    known = d.filter("id is not null")
    sizes = known.groupBy("id").agg(F.max(F.length("text").cast("long")).alias("most"))
    order = next_ids(sizes)
    # What each document must lend: the first floor(n/4) code points for the longest text before it.
    lend = order.join(sizes, "id").select(F.col("next_id"), F.col("id").alias("for_id"), F.floor(F.col("most") / 4).cast("int").alias("want"))
    # Texts are dealt by id once: both joins below read that same exchange, and only prefixes are dealt again.
    lent = known.join(lend, known["id"] == lend["next_id"]).select("for_id", "next_id", "text_hash", F.substr("text", F.lit(1), F.col("want")).alias("next_prefix"))
    lent = lent.groupBy("for_id").agg(F.min(F.struct("text_hash", "next_prefix", "next_id")).alias("lent"))
    both = known.join(lent, known["id"] == lent["for_id"], "left").select("id", "text", known["text_hash"], "lent.next_prefix", "lent.next_id")
    both = both.unionByName(d.filter("id is null").select("id", "text", "text_hash", F.lit("").alias("next_prefix"), F.lit(None).cast("long").alias("next_id")))
    both = both.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substr(F.coalesce("next_prefix", F.lit("")), F.lit(1), cut))
    return both.withColumn("edited", edited).drop("next_prefix")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprints of every text, of its edited text, and how like they and the next document's are."""
    d = edited_pairs(docs, id_col, text_col).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    d = with_fingerprint(with_fingerprint(d, "text", "fingerprint").drop("text"), "edited", "edited_fingerprint").drop("edited")
    d = materialize(d, "fingerprints")  # small rows without texts, read twice below
    nexts = d.groupBy(F.col("id").alias("nid")).agg(F.min_by("fingerprint", F.struct("text_hash", "fingerprint")).alias("next_fingerprint"))
    out = d.join(nexts, d["next_id"] == nexts["nid"], "left")
    return out.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        F.coalesce(likeness(F.col("fingerprint"), F.col("next_fingerprint")), F.lit(0.0)).alias("near_next"),
    )
