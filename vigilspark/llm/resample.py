"""Importance resampling towards a target distribution, in DataFrame functions alone.

Word n-grams of every text become an array of hashed buckets (crc32 modulo BUCKETS), which is written once. Exploded, the
arrays give the bucket counts of the corpus and of the target texts; a gain for each bucket is the logarithm of the ratio
of its smoothed shares. The table of gains has BUCKETS rows, whatever the input, and is broadcast; a document's weight is
the mean gain of its features. Noise drawn from a hash of the id (Gumbel) turns the weights into a sample without
replacement: the documents with the highest scores are drawn. Scores are sorted by range over all tasks; a rank is the
place in its partition plus the rows of the partitions before it.

Defined results: null texts have no features; a document without features has weight 0; null ids are hashed as an empty
text and come last among equal scores; rows with repeated ids are documents of their own (equal id and score: in any
order); no rows give no rows; an empty target gives gains towards the uniform distribution; very long texts are read
whole; other columns, whatever their names, are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.llm.common import materialize

BUCKETS = 10_000
#: What words are made of, after A-Z have been lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), F.lit(WORD), F.lit(0))


def runs(w: Column, longest: int) -> list[Column]:
    """Arrays of the runs of 1, 2, ... longest words, joined by a space."""
    out = [w]
    for k in range(2, longest + 1):
        n = F.greatest(F.size(w) - (k - 1), F.lit(0))
        out.append(F.zip_with(F.slice(out[-1], F.lit(1), n), F.slice(w, F.lit(k), n), lambda a, b: F.concat(a, F.lit(" "), b)))
    return out


def hashed(docs: DataFrame, buckets: int, longest: int, *keep: str) -> DataFrame:
    """keep, n_words, buckets: the hashed n-grams of each text, repeats included."""
    bucket = lambda x: (F.crc32(x.cast("binary")) % buckets).cast("int")
    d = docs.select(*keep, words(F.col("text")).alias("_w"))
    return d.select(*keep, F.size("_w").alias("n_words"), F.concat(*[F.transform(r, bucket) for r in runs(F.col("_w"), longest)]).alias("buckets"))


def _counts(grams: DataFrame, name: str) -> DataFrame:
    return grams.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain for all buckets, from tables with hashed n-grams."""
    total = lambda d: d.agg(F.coalesce(F.sum(F.size("buckets")), F.lit(0))).first()[0]
    s_all, t_all = total(corpus), total(target)
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(_counts(corpus, "s"), "bucket", "left").join(_counts(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1.0) * F.lit(float(s_all + buckets)) / ((s + 1.0) * F.lit(float(t_all + buckets)))
    return both.select("bucket", F.floor(1000.0 * F.ln(ratio)).alias("gain"))


def scored(corpus: DataFrame, table: DataFrame, seed: int) -> DataFrame:
    """corpus(row, doc_id, n_words, buckets) -> row, doc_id, n_words, n_features, weight, score."""
    rows = corpus.select("row", "doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), F.explode_outer("buckets").alias("bucket"))
    # The gains are as many as there are buckets. A document's features are in one task, which sums them before the shuffle.
    summed = rows.join(F.broadcast(table), "bucket", "left").groupBy("row", "doc_id", "n_words", "n_features").agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    weight = F.expr("case when n_features = 0 then 0 else (total - pmod(total, n_features)) div n_features end")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    return summed.withColumn("weight", weight).select("row", "doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with place: 1, 2, 3, ... in the order, from the partitions of a distributed sort."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt, "sorted")  # the place in a partition is fixed by what was written
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("place", place).select(*rows.columns, "place")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, longest: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those that are not drawn.

    docs need doc_id and text, target needs text."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())
    corpus = materialize(hashed(named, buckets, longest, "row", "doc_id"), "features")
    aim = materialize(hashed(target.select("text"), buckets, longest), "target")
    rated = materialize(scored(corpus, gains(corpus, aim, buckets), seed), "scores")
    enough = F.col("n_words") >= least_words
    drawn = rated.filter(enough).count() * percent // 100
    first = ranked(rated.filter(enough), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc())
    columns = ["doc_id", "n_features", "weight", "score"]
    out = first.select(*columns, F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    return out.unionByName(rated.filter(~enough).select(*columns, F.lit(None).cast("long").alias("rank")))
