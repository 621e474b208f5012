"""Cohort retention matrix from bitmap cells, for two states of knowledge about the same events.

Clients with a start get dense ids: they are dealt into pages of PAGE ids by a hash and numbered within their page, so no
sort or count holds them all; 64 pages make a chunk of 65,536 ids. A cell (state, segment, cohort, period) is a set of
compressed bitmaps, one for each chunk: a sorted array of 16-bit places below DENSE ids, else 8,192 bytes of bits. Tasks
make the bitmaps of what they read, an exchange by cell and chunk merges them with OR. The merged bitmaps then meet the
clients of their state, cohort and chunk: the population count gives users, the intersection with those who have a start
in the other state but not in the same cohort gives moved, and looking up the bits gives the sum of crc32.

A client with any share of the clicks is one bit in few cells after the first task; the join that gives clicks their
start is one that Spark splits where a key is hot. Nothing that grows goes to the driver or is broadcast.

Defined results: rows equal in the seven columns of clicks count once (NaN equals NaN); rows with a null ts or client_id
are dropped; a null click_id isn't delayed; a null arrived_at is known in state 1 only; of repeated clients the least
segment counts; null segments and missing clients are ''; values that are null, NaN or infinite add no cents; empty tables
give no rows; other columns, whatever their names, are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.common import drop, materialize

PAGE, FILL = 1024, 800
CHUNK, DENSE = 1 << 16, 4096
DAY_US = 86_400_000_000
#: Rows that a task holds before it turns them into bitmaps.
HELD = 400_000
CELL = ["state", "segment", "cohort", "period"]
BITMAP = "state int, segment string, cohort long, period long, chunk long, bits binary, cents long"


def _us(c: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)


def _floored(c: Column, n: int) -> Column:
    """c / n, rounded down, in whole numbers."""
    return F.call_function("div", c - F.pmod(c, F.lit(n)), F.lit(n)).cast("long")


def known_clicks(clicks: DataFrame, cut: str) -> DataFrame:
    """client_id, us, early (known in state 0), kind, cents of each click once."""
    columns = {"click_id": "long", "client_id": "long", "ts": "timestamp_ntz", "arrived_at": "timestamp_ntz", "kind": "string", "value": "double", "props": "string"}
    c = clicks.select(*[F.col(k).cast(t).alias(k) for k, t in columns.items()]).filter("ts is not null and client_id is not null")
    # Long texts meet as two independent 64-bit hashes beside the other columns.
    c = c.select(*list(columns)[:-1], F.xxhash64("props").alias("p1"), F.xxhash64(F.lit("second"), "props").alias("p2")).distinct()
    h = F.crc32(F.col("click_id").cast("string").cast("binary"))
    late = F.when(h % 3 == 0, h % 100 * F.lit(DAY_US)).otherwise(0)
    finite = F.abs("value") < 9e16
    cents = F.when(finite, F.floor(100 * F.col("value") + 0.5)).otherwise(0)
    early = F.coalesce(_us(F.col("arrived_at")) + late < _us(F.lit(cut).cast("timestamp_ntz")), F.lit(False))
    return c.select("client_id", _us(F.col("ts")).alias("us"), early.alias("early"), "kind", F.coalesce(cents, F.lit(0)).alias("cents"))


def starts(known: DataFrame, clients: DataFrame) -> DataFrame:
    """client_id, segment, start0, start1: least known time of a signup in each state."""
    first = known.filter("kind = 'signup'").groupBy("client_id").agg(F.min(F.when(F.col("early"), F.col("us"))).alias("start0"), F.min("us").alias("start1"))
    segments = clients.select(F.col("client_id").cast("long").alias("client_id"), F.col("segment").cast("string").alias("segment")).groupBy("client_id").agg(F.min("segment").alias("segment"))
    return first.hint("merge").join(segments.hint("merge"), "client_id", "left").withColumn("segment", F.coalesce("segment", F.lit("")))


def with_dense_ids(rows: DataFrame, key: str) -> DataFrame:
    """rows (one for each key, materialized) with chunk and at (0 to 65,535). Pages are dealt by hash for FILL of PAGE
    ids; should one overflow, all are dealt anew into more."""
    from pyspark.sql import Window

    pages = max(1, -(-rows.count() // FILL))
    page = lambda n: F.pmod(F.xxhash64(key), F.lit(n))
    while (rows.groupBy(page(pages).alias("p")).count().agg(F.max("count")).first()[0] or 0) > PAGE:
        pages = pages * 5 // 4 + 1
    place = F.row_number().over(Window.partitionBy("_page").orderBy(key)) - 1 + F.col("_page") * PAGE
    numbered = rows.withColumn("_page", page(pages)).withColumn("_id", place.cast("long"))
    return numbered.select(*rows.columns, F.shiftright("_id", 16).alias("chunk"), F.col("_id").bitwiseAND(F.lit(CHUNK - 1)).cast("int").alias("at"))


def packed(edges: np.ndarray, places: np.ndarray) -> pa.Array:
    """Bitmaps of the sorted places between the edges."""
    sizes = np.diff(edges)
    if not (sizes >= DENSE).any():
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((2 * edges).astype(np.int32).tobytes()), pa.py_buffer(places.astype("<u2").tobytes())])
    return pa.array([_bits(places[a:b]) if b - a >= DENSE else places[a:b].astype("<u2").tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())


def _bits(places: np.ndarray) -> bytes:
    out = np.zeros(CHUNK, dtype=bool)
    out[places] = True
    return np.packbits(out, bitorder="little").tobytes()


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """(row, place) of the bitmaps that are arrays; row -> bytes of those that are bits."""
    lengths = pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    full = lengths == CHUNK // 8
    dense = {int(k): np.frombuffer(column[int(k)].as_buffer(), dtype=np.uint8) for k in np.flatnonzero(full)}
    sparse = column.filter(pa.array(~full)) if dense else column
    first, last = np.frombuffer(sparse.buffers()[1], dtype=np.int32)[[sparse.offset, sparse.offset + len(sparse)]] if len(sparse) else (0, 0)
    places = np.frombuffer(sparse.buffers()[2], dtype="<u2", offset=int(first), count=int(last - first) // 2) if last > first else np.zeros(0, dtype="<u2")
    rows = np.flatnonzero(~full)
    return np.repeat(rows, lengths[rows] // 2), places.astype(np.int64), dense


def _edges(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the keys of a sorted table change: 0, ..., its length."""
    change = np.zeros(max(t.num_rows - 1, 0), dtype=bool)
    for k in keys:
        c = t.column(k).combine_chunks()
        c = (c.dictionary_encode().indices if pa.types.is_string(c.type) else c).to_numpy(zero_copy_only=False)
        change |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1, [t.num_rows]))


def _made(t: pa.Table, edges: np.ndarray, bits: pa.Array) -> pa.RecordBatch:
    cents = np.add.reduceat(t.column("cents").to_numpy(), edges[:-1])
    keys = [t.column(k).combine_chunks().take(pa.array(edges[:-1])) for k in [*CELL, "chunk"]]
    return pa.RecordBatch.from_arrays([*keys, bits, pa.array(cents)], names=[*CELL, "chunk", "bits", "cents"])


def make_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the rows that a task reads, HELD rows at a time."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys = [*CELL, "chunk", "at"]
        t = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([("cents", "sum")]).sort_by([(k, "ascending") for k in keys])
        t = t.append_column("cents", t.column("cents_sum"))
        edges = _edges(t, keys[:-1])
        return _made(t, edges, packed(edges, t.column("at").to_numpy()))

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD:
            yield flush(held)
            held, n = [], 0
    if n:
        yield flush(held)


def union_of(group: np.ndarray, n: int, column: pa.Array) -> pa.Array:
    """OR of the bitmaps of each of n groups; group says where each one belongs."""
    rows, places, dense = unpacked(column)
    if dense:
        full: dict[int, np.ndarray] = {}
        for k, b in dense.items():
            full[int(group[k])] = full[int(group[k])] | b if int(group[k]) in full else b
        into = np.zeros(n, dtype=bool)
        into[list(full)] = True
        mixed = into[group[rows]]
        for g in full:
            more = places[mixed & (group[rows] == g)]
            full[g] = full[g] | np.frombuffer(_bits(more), dtype=np.uint8)
        rows, places = rows[~mixed], places[~mixed]
    keys = np.unique(group[rows] << 16 | places)
    edges = np.searchsorted(keys, np.arange(n + 1, dtype=np.int64) << 16)
    out = packed(edges, keys & (CHUNK - 1))
    return out if not dense else pa.array([full[k].tobytes() if k in full else x for k, x in enumerate(out.to_pylist())], pa.binary())


def merge_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bitmap for each cell and chunk, of rows sorted by them."""

    def merged(t: pa.Table) -> pa.RecordBatch:
        edges = _edges(t, [*CELL, "chunk"])
        group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        return _made(t, edges, union_of(group, len(edges) - 1, t.column("bits").combine_chunks()))

    held = None  # the rows of the cell that the last batch ended in
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        last = int(_edges(t, [*CELL, "chunk"])[-2])
        if last:
            yield merged(t.slice(0, last).combine_chunks())
        held = t.slice(last)
    if held is not None and held.num_rows:
        yield merged(held.combine_chunks())


FIGURES = "state int, segment string, cohort long, period long, users long, users_crc32 long, moved long, cents long"


def count_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures of each bitmap. Rows are sorted by state, cohort, chunk; of each, the clients (bits is null) come first."""
    at, crc, other, same = None, np.zeros(CHUNK, dtype=np.int64), np.zeros(CHUNK, dtype=bool), np.zeros(CHUNK, dtype=bool)
    for batch in batches:
        t = pa.Table.from_batches([batch])
        edges = _edges(t, ["state", "cohort", "chunk"])
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = t.slice(low, high - low).combine_chunks()
            here = tuple(part.column(k)[0].as_py() for k in ("state", "cohort", "chunk"))
            if here != at:
                at = here
                crc[:], other[:], same[:] = 0, False, False
            client = part.column("bits").is_null().to_numpy(zero_copy_only=False) if part.num_rows else np.zeros(0, dtype=bool)
            n = int(client.sum())
            if n:
                c = part.slice(0, n)
                places = c.column("at").to_numpy()
                crc[places], other[places], same[places] = c.column("crc").to_numpy(), c.column("other").to_numpy(zero_copy_only=False), c.column("same").to_numpy(zero_copy_only=False)
            cells = part.slice(n)
            if not cells.num_rows:
                continue
            # Who has a start in the other state, but in another cohort.
            moved = other & ~same
            rows, places, dense = unpacked(cells.column("bits").combine_chunks())
            users, sums, gone = (np.zeros(cells.num_rows, dtype=np.int64) for _ in range(3))
            np.add.at(users, rows, 1)
            np.add.at(sums, rows, crc[places])
            np.add.at(gone, rows, moved[places].astype(np.int64))
            if dense:
                moved_bits = np.packbits(moved, bitorder="little")
                for k, bits in dense.items():
                    users[k], gone[k] = int(np.bitwise_count(bits).sum()), int(np.bitwise_count(bits & moved_bits).sum())
                    sums[k] = int(crc[np.unpackbits(bits, bitorder="little").view(bool)].sum())
            keys = [cells.column(k).combine_chunks() for k in CELL]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(users), pa.array(sums), pa.array(gone), cells.column("cents").combine_chunks()], names=[*CELL, "users", "users_crc32", "moved", "cents"])


def retention(clicks: DataFrame, clients: DataFrame, cut: str = "2024-02-15 00:00:00", cohort_days: int = 1, period_days: int = 1) -> DataFrame:
    """state, segment, cohort, period, users, users_crc32, moved, cents of every cell that has users."""
    known = known_clicks(clicks, cut)
    first = materialize(starts(known_clicks(clicks.filter("kind = 'signup'"), cut), clients), "starts")
    dense = materialize(with_dense_ids(first, "client_id"), "dense")
    drop(first)
    cohort = lambda us: _floored(_floored(us, DAY_US), cohort_days)
    joined = known.join(dense.hint("merge"), "client_id")
    states = F.filter(
        F.array(F.struct(F.lit(0).alias("state"), F.col("start0").alias("start"), F.col("early").alias("known")), F.struct(F.lit(1).alias("state"), F.col("start1").alias("start"), F.lit(True).alias("known"))),
        lambda s: s["known"] & s["start"].isNotNull() & (F.col("us") >= s["start"]),
    )
    each = joined.select("us", "cents", "segment", "chunk", "at", F.explode(states).alias("s")).select("s.state", "segment", cohort(F.col("s.start")).alias("cohort"), _floored(F.col("us") - F.col("s.start"), DAY_US * period_days).alias("period"), "chunk", "at", "cents")
    cells = each.mapInArrow(make_bitmaps, BITMAP).repartition(*CELL, "chunk").sortWithinPartitions(*CELL, "chunk").mapInArrow(merge_bitmaps, BITMAP)
    pair = F.array(F.struct(F.lit(0).alias("state"), F.col("start0").alias("start"), F.col("start1").alias("elsewhere")), F.struct(F.lit(1).alias("state"), F.col("start1").alias("start"), F.col("start0").alias("elsewhere")))
    members = dense.select("client_id", "chunk", "at", F.explode(pair).alias("s")).filter("s.start is not null")
    members = members.select(
        "s.state", cohort(F.col("s.start")).alias("cohort"), "chunk", "at", F.crc32(F.col("client_id").cast("string").cast("binary")).alias("crc"),
        F.col("s.elsewhere").isNotNull().alias("other"), F.coalesce(cohort(F.col("s.elsewhere")) == cohort(F.col("s.start")), F.lit(False)).alias("same"),
    )
    met = cells.unionByName(members, allowMissingColumns=True)
    figures = met.repartition("state", "cohort", "chunk").sortWithinPartitions("state", "cohort", "chunk", F.col("bits").isNotNull()).mapInArrow(count_bits, FIGURES)
    sums = [F.sum(k).alias(k) for k in ("users", "users_crc32", "moved", "cents")]
    return figures.groupBy(*CELL).agg(*sums)
