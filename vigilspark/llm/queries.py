"""Queries and SQL of the training-data operators, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.llm.common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilspark.llm.pieces import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilspark.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilspark.llm import chat_format as chat

    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat.digest(chat.format_parts(turns.unionByName(probe).withColumn("parts", chat.text_parts(F.col("text")))))


OP3_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g as (
  select conv_id, count(*) as n_turns,
    coalesce(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text), '') as all_text,
    coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as loss,
    sum(6 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) + 1 + length(replace(replace(text, '\', '\b'), '<', '\l')) + 8) as formatted_chars
  from t group by conv_id)
select conv_id, n_turns, sha256(all_text) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256,
  cast(formatted_chars as bigint) as formatted_chars, cast(0 as bigint) as n_attachments from g
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilspark.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilspark.llm.ngram_join import join

    return join(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilspark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def packing_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of 512 tokens at most, in sequences whose document count and attention cost bind as well."""
    from vigilspark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), documents=8, attention=400_000, piece=512)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilspark.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilspark.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilspark.llm.token_counts import count_documents

    return count_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilspark.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op11_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilspark.llm.retention import retention

    return retention(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "clients"))


def _crc32_sql(byte_list: str) -> str:
    """crc32 of a list of bytes (ubigint), bit by bit."""
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]), lambda a, z: xor(a >> 1, (a & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, {byte_list}), lambda c, b: {step}), 4294967295::ubigint)"


def _crc32_of_number(c: str) -> str:
    return _crc32_sql(f"list_transform(string_split({c}::varchar, ''), lambda x: ascii(x)::ubigint)")


OP11_SQL = f"""
with c as (select distinct click_id, ts, arrived_at, client_id, kind, value, props from clicks where ts is not null and client_id is not null),
h as (select *, {_crc32_of_number("click_id")} as h from c),
k as (select client_id, epoch_us(ts) as us, kind, coalesce(case when abs(value) < 9e16 then floor(100 * value + 0.5)::bigint end, 0) as cents,
  coalesce(epoch_us(arrived_at) + case when h % 3 = 0 then (h % 100)::bigint else 0 end * 86400000000 < epoch_us(timestamp '2024-02-15 00:00:00'), false) as early from h),
s as (select client_id, min(us) filter (early) as s0, min(us) as s1 from k where kind = 'signup' group by 1),
g as (select client_id, min(segment) as segment from clients group by 1),
t as (select s.client_id, s0, s1, coalesce(segment, '') as segment, {_crc32_of_number("s.client_id")} as crc,
  coalesce(floor(s0 / 86400000000.0) <> floor(s1 / 86400000000.0), false) as moved from s left join g on s.client_id = g.client_id),
e as (select 0 as state, t.*, s0 as start, us, cents from k join t using (client_id) where early and us >= s0
  union all select 1, t.*, s1, us, cents from k join t using (client_id) where us >= s1),
r as (select state, segment, floor(start / 86400000000.0)::bigint as cohort, (us - start) // 86400000000 as period, client_id, any_value(crc) as crc, any_value(moved) as moved, sum(cents) as cents from e group by 1, 2, 3, 4, 5)
select state, segment, cohort, period, count(*) as users, sum(crc)::bigint as users_crc32, count(*) filter (moved) as moved, sum(cents)::bigint as cents from r group by 1, 2, 3, 4
"""


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilspark.llm.resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UTF8 = "list_transform(range(length(hex(f)) // 2), lambda i: ('0x' || substring(hex(f), 2 * i + 1, 2))::ubigint)"


def _grams_sql(rows: str) -> str:
    """w (words) and g (runs of one and two words) of rows' texts."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"select *, w || list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2]) as g from (select *, {words} as w from {rows})"


OP12_SQL = f"""
with d as (select *, row_number() over () as r from ({_grams_sql("documents")})),
m as ({_grams_sql("benchmark")}),
f as (select r, unnest(g) as f from d), x as (select unnest(g) as f from m),
b as (select f, ({_crc32_sql(_UTF8)} % 10000)::int as bucket from (select f from f union select f from x)),
s as (select bucket, count(*) as s from f join b using (f) group by 1), t as (select bucket, count(*) as t from x join b using (f) group by 1),
n as (select (select count(*) from f) as sa, (select count(*) from x) as ta),
q as (select bucket, floor(1000.0 * ln((coalesce(t, 0) + 1)::double * (sa + 10000)::double / ((s + 1)::double * (ta + 10000)::double)))::bigint as gain from s left join t using (bucket), n),
w as (select r, count(*) as n, sum(gain) as total from f join b using (f) join q using (bucket) group by 1),
v as (select doc_id, len(w) as words, coalesce(n, 0) as n_features, coalesce(floor(total / n), 0)::bigint as weight, ('0x' || substring(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from d left join w using (r)),
z as (select *, weight + floor(-1000.0 * ln(-ln((h + 0.5) / 4294967296.0)))::bigint as score from v),
k as (select *, row_number() over (partition by words >= 20 order by score desc, doc_id) as place, count(*) filter (words >= 20) over () as enough from z)
select doc_id, n_features::bigint as n_features, weight, score, case when words >= 20 and place <= 25 * enough // 100 then place end as rank from k
"""


def op13_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilspark.llm.interpolation import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if (k.startswith("op") or k == "packing_bounded") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": OP3_SQL, "op11_retention": OP11_SQL, "op12_resample": OP12_SQL}
