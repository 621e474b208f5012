"""Token counts of flat token files: a separator scan.

A token file is a run of little-endian ids of `width` bytes, documents one after the other, each closed by the
end-of-document id, without any index. It is read in blocks; each block is searched for the id in one vectorised
comparison; documents that cross block boundaries are stitched by a prefix scan over blocks: the running maximum of
the last separator's place. The scan has two levels (blocks in spans of SPAN, then spans), so no window holds
all blocks of a large file.

Blocks come from a table (file_id, block, payload) or from files through Spark's binary reader, cut into blocks there.

Defined results: ids after a file's last separator form one open document (closed = false); adjacent separators
give documents of 0 tokens (the separator itself isn't counted); empty files and tables give no rows; null payloads are
empty; null texts are empty documents of 0 tokens; very long texts and long runs of white space are encoded whole;
repeated rows and null ids are documents of their own; a payload that isn't a whole number of ids fails."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilspark.llm.common import materialize, per_batch
from vigilspark.llm.packing import encoder

BLOCK_IDS = 1 << 16
SPAN = 1024
END_OF_DOCUMENT = 50256


def file_blocks(spark: SparkSession, path: str, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of all files under path (each below 2 GiB, the binary reader's limit): file_id, block, payload."""
    files = spark.read.format("binaryFile").load(path)
    size = block_ids * width
    cut = files.filter("length > 0").select(F.col("path").alias("file_id"), "content", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("block"))
    return cut.select("file_id", "block", F.substring("content", F.col("block").cast("int") * size + 1, F.lit(size)).alias("payload"))


def token_blocks(docs: DataFrame, json_path: str, block_ids: int = BLOCK_IDS, end: int = END_OF_DOCUMENT) -> DataFrame:
    """Write documents as flat token files of 16-bit ids, one for each task: kind 'block' rows hold blocks cut without
    regard to documents (file_id, seq, payload), kind 'doc' rows say which document stands where (file_id, seq, doc_id).

    Texts are encoded as ordinary text, so the end token's string inside a text gives no separator."""
    schema = pa.schema([("kind", pa.string()), ("file_id", pa.string()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("payload", pa.binary())])

    def run(batches: object) -> object:
        from pyspark import TaskContext

        encode = encoder(json_path).ordinary
        file_id, held, held_n, block, seq = f"part-{TaskContext.get().partitionId():06d}", [], 0, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text), end] if text else [end], dtype="<u2")
                held.append(ids)
                held_n += len(ids)
                out.append(("doc", file_id, seq, doc, None))
                seq += 1
                if held_n >= block_ids:
                    flat = np.concatenate(held)
                    for k in range(held_n // block_ids):
                        out.append(("block", file_id, block, None, flat[k * block_ids : (k + 1) * block_ids].tobytes()))
                        block += 1
                    held = [flat[held_n // block_ids * block_ids :]]
                    held_n = len(held[0])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * 5, schema, strict=True)], schema=schema)
        if held_n:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(("block", file_id, block, None, np.concatenate(held).tobytes()), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "kind string, file_id string, seq long, doc_id long, payload binary")


def scan(blocks: DataFrame, end: int = END_OF_DOCUMENT, width: int = 2) -> DataFrame:
    """file_id, doc_index (from 0), token_start, n_tokens, closed of every document of the files."""

    def start() -> object:
        kind = np.dtype(f"<u{width}")

        def work(batch: pa.RecordBatch) -> dict:
            ends, sizes = [], []
            for payload in batch.column("payload").to_pylist():
                ids = np.frombuffer(payload or b"", dtype=kind)
                ends.append(np.flatnonzero(ids == end).tolist())
                sizes.append(len(ids))
            return {"file_id": batch.column("file_id"), "block": batch.column("block"), "ids": sizes, "ends": ends}

        return work

    found = materialize(per_batch(blocks.select("file_id", F.col("block").cast("long").alias("block"), "payload"), "file_id string, block long, ids long, ends array<int>", start), "separators")
    marks = found.select("file_id", "block", F.floor(F.col("block") / SPAN).alias("span"), "ids", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    # Blocks of a file may differ in size: places come from a prefix sum as well.
    spans = marks.groupBy("file_id", "span").agg(F.sum("ids").alias("ids"), F.sum("n").alias("n"))
    by_span, by_block = Window.partitionBy("file_id").orderBy("span"), Window.partitionBy("file_id", "span").orderBy("block")
    spans = spans.select("file_id", "span", (F.sum("ids").over(by_span) - F.col("ids")).alias("ids_before"), (F.sum("n").over(by_span) - F.col("n")).alias("n_before"))
    placed = marks.join(spans, ["file_id", "span"])
    placed = placed.withColumn("at", F.col("ids_before") + F.sum("ids").over(by_block) - F.col("ids")).withColumn("docs_before", F.col("n_before") + F.sum("n").over(by_block) - F.col("n"))
    placed = placed.withColumn("last_at", F.col("at") + F.col("last")).select("file_id", "span", "block", "at", "docs_before", "last_at", (F.col("at") + F.col("ids")).alias("until"))
    span_last = placed.groupBy("file_id", "span").agg(F.max("last_at").alias("m")).withColumn("carried", F.max("m").over(by_span.rowsBetween(Window.unboundedPreceding, -1))).select("file_id", "span", "carried")
    opened = F.coalesce(F.greatest(F.max("last_at").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.col("carried")), F.lit(-1)) + 1
    stitched = placed.join(span_last, ["file_id", "span"]).withColumn("opened", opened)
    # The ends arrays join last: windows carry numbers only.
    whole = stitched.join(found.select("file_id", "block", "ends"), ["file_id", "block"])
    each = whole.select("file_id", "docs_before", "at", "opened", "ends", F.posexplode("ends").alias("k", "e"))
    closed = each.select(
        "file_id",
        (F.col("docs_before") + F.col("k")).alias("doc_index"),
        F.when(F.col("k") == 0, F.col("opened")).otherwise(F.col("at") + F.get("ends", F.col("k") - 1) + 1).alias("token_start"),
        (F.col("at") + F.col("e")).alias("end_at"),
    ).select("file_id", "doc_index", "token_start", (F.col("end_at") - F.col("token_start")).alias("n_tokens"), F.lit(True).alias("closed"))
    tails = placed.groupBy("file_id").agg(F.max("until").alias("until"), (F.coalesce(F.max("last_at"), F.lit(-1)) + 1).alias("token_start"))
    index = marks.groupBy("file_id").agg(F.sum("n").alias("doc_index"))
    left = tails.filter("until > token_start").join(index, "file_id").select("file_id", "doc_index", "token_start", (F.col("until") - F.col("token_start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(left)


def count_documents(docs: DataFrame, json_path: str) -> DataFrame:
    """Token counts of documents, taken from the flat files that they are written to: doc_id, file_id, doc_index,
    token_start, n_tokens."""
    written = materialize(token_blocks(docs, json_path), "tokens")
    blocks = written.filter("kind = 'block'").select("file_id", F.col("seq").alias("block"), "payload")
    names = written.filter("kind = 'doc'").select("file_id", F.col("seq").alias("doc_index"), "doc_id")
    return scan(blocks).join(names, ["file_id", "doc_index"]).select("doc_id", "file_id", "doc_index", "token_start", "n_tokens")
