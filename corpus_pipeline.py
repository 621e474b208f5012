"""Corpus pipeline: reject toxic documents, reject documents of no known language, keep one document of each group of
near duplicates, pack what is left into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.llm import language_id, ngram_join, packing, toxicity
from vigilspark.llm.common import fold_of, keep_rows, materialize, table
from vigilspark.llm.queries import tokenizer_path

TOXIC_FROM = 0.7
#: Least similarity to a language's profile; random letters and codes stay below.
LANGUAGE_FROM = 0.15


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below TOXIC_FROM; null texts stay. Learned from the labelled rows that are not held out."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(fold_of("doc_id", 3) != 1))
    shared = spark.sparkContext.broadcast(lexicon)

    def start() -> object:
        scorer = toxicity.Scorer(shared.value)
        return lambda texts: [scorer.score(t) < TOXIC_FROM for t in texts]

    return keep_rows(docs, "text", start)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted language; texts that are null, without letters or unlike every profile go.

    Where no language could be learned, all texts with letters stay."""
    profiles = language_id.learn(docs.filter(fold_of("doc_id", 5) != 0))
    shared = spark.sparkContext.broadcast(profiles)

    def start() -> object:
        predict = language_id.predictor(shared.value)
        if not shared.value.languages:
            grams = language_id.Grams(shared.value.letters)
            return lambda texts: [bool(t) and grams.codes(t) is not None for t in texts]

        def keep(texts: list) -> list[bool]:
            found = [predict(t) for t in texts]
            return [lang != language_id.UNDETERMINED and score >= LANGUAGE_FROM for lang, score in found]

        return keep

    return keep_rows(docs, "text", start)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group, null ids last; rows are grouped by text, whatever ids they share."""
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = ngram_join.join(rows, "_row").select(F.col("doc_id").alias("_row"), "component_id")
    ranked = groups.join(rows.select("_row", "doc_id"), "_row").select("component_id", F.struct(F.col("doc_id").isNull(), "doc_id", "_row").alias("place"))
    kept = ranked.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place._row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", one_of_each_group),
    ("best-fit packing", pack_sequences),
]

#: Learned models, component search and tokenisers have no SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
