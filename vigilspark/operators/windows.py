"""Ordered analytics within streams: gaps, rings, running session features, decaying traces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.domains import CHANNEL_OF_SOURCE, KERNEL_COLUMNS
from vigilspark.functions.encode import channel, cyclic, failure_address
from vigilspark.scratch import drop, materialize


def seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def numbered(rows: DataFrame, out: str, order: tuple[str, ...] = ("timestamp", "id"), keys: tuple[str, ...] = ()) -> DataFrame:
    """out: 1, 2, ... within the keys (not null) by the order's columns, the first of them a time; null times come first. Rows are
    dealt by minute, and minutes get their first number from a prefix sum over their counts, so no task holds all rows of a key."""
    dealt = rows.withColumn("_minute", F.coalesce(F.timestamp_diff("MINUTE", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(order[0])), F.lit(-(2**62))))
    sizes = dealt.groupBy(*keys, "_minute").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_minute")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy(*keys, "_minute").orderBy(*order))
    return dealt.join(before, [*keys, "_minute"]).withColumn(out, F.col("_before") + place).select(*rows.columns, out)


#: Ids of a range: what a task holds of a key at most, wherever a key is cut into ranges.
WIDTH = 1 << 16


def _part(order: str, width: int) -> Column:
    """Number of the id's range; null ids come first."""
    return F.coalesce(F.floor(F.col(order) / width), F.lit(-(2**62)))


def _joined(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null; keys of other go."""
    renamed = other.withColumnsRenamed({k: f"_k{j}" for j, k in enumerate(keys)})
    on = [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)]
    return rows.join(renamed, on, "left").drop(*[f"_k{j}" for j in range(len(keys))])


def running_sums(rows: DataFrame, keys: list[str], sums: dict[str, Column], order: tuple[str, ...] = ("id",), width: int = WIDTH) -> DataFrame:
    """Sums over the rows of the same keys up to each row, itself included: a segmented prefix scan. Rows are dealt by keys
    and ranges of width ids; each range's totals, added up, are what the next one starts with, so that no task holds more
    of a key than a range and the totals of its ranges. Values have to be numbers, not null."""
    names = list(sums)
    d = rows.withColumns({"_p": _part(order[0], width)} | {f"_x{j}": c for j, c in enumerate(sums.values())})
    totals = d.groupBy(*keys, "_p").agg(*[F.sum(f"_x{j}").alias(f"_t{j}") for j in range(len(names))])
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_p", *[F.coalesce(F.sum(f"_t{j}").over(before), F.lit(0)).alias(f"_b{j}") for j in range(len(names))])
    here = Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _joined(d, starts, [*keys, "_p"])
    return out.withColumns({n: F.col(f"_b{j}") + F.sum(f"_x{j}").over(here) for j, n in enumerate(names)}).select(*rows.columns, *names)


def latest_before(rows: DataFrame, keys: list[str], value: str, out: str, order: tuple[str, ...] = ("id",), width: int = WIDTH) -> DataFrame:
    """The latest value that isn't null among the rows of the same keys before each row, by ranges as running_sums()."""
    d = rows.withColumn("_p", _part(order[0], width))
    last = d.filter(F.col(value).isNotNull()).groupBy(*keys, "_p").agg(F.max_by(value, F.struct(*order)).alias("_l"))
    # Ranges without a value are no rows of last, so each range looks up the latest one before it.
    ranges = d.select(*keys, "_p").distinct()
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = _joined(ranges, last, [*keys, "_p"]).select(*keys, "_p", F.last("_l", ignorenulls=True).over(before).alias("_b"))
    here = Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return _joined(d, starts, [*keys, "_p"]).withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(here), "_b")).select(*rows.columns, out)


def in_sequence(rows: DataFrame, *order: str, out: str = "id") -> DataFrame:
    """out: 1, 2, ... by the order's columns, from a distributed sort. Rows are dealt by range, sorted and written; a
    second pass counts each range and adds the counts of those before it. Comes back in ranges, sorted within each."""
    dealt = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "sequence")
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.drop(out).withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(out, place).drop("_part", "_before", "_at")


def with_gap(events: DataFrame, *keys: str, out: str = "dt_seconds", width: int = WIDTH) -> DataFrame:
    """Seconds since the row before in the keys' stream, which is looked up over ranges of ids; 0 for the first, and next to a
    row without a time."""
    d = latest_before(events.withColumn("_time", F.struct("timestamp")), list(keys), "_time", "_before", width=width)
    return d.withColumn(out, F.coalesce(seconds_between(F.col("_before.timestamp"), F.col("timestamp")), F.lit(0.0))).drop("_time", "_before")


def _in_order(rows: str) -> Column:
    """An array of structs by their field q, whatever else they hold."""
    return F.array_sort(rows, lambda a, b: F.when(a["q"] < b["q"], -1).when(a["q"] > b["q"], 1).otherwise(0))


def _last(values: Column, place: Column, n: int) -> Column:
    """The n values that end at the place (from 1); fewer at the head, none where the place is below 1."""
    return F.slice(values, F.greatest(place - n + 1, F.lit(1)).cast("int"), F.greatest(F.least(place, F.lit(n)), F.lit(0)).cast("int"))


def _taken() -> Column:
    """Bytes of a line with its end; null lines take none."""
    return F.coalesce(F.octet_length("raw_line") + 1, F.lit(0)).cast("long")


def _text(entries: str) -> tuple[Column, Column, Column]:
    """The bytes of the entries' lines (structs with line and b, the bytes as of the line), where each of these ends, and
    the bytes before the first of them."""
    first = F.get(entries, F.lit(0))
    zero = F.coalesce(first["b"] - F.coalesce(F.octet_length(first["line"]) + 1, F.lit(0)), F.lit(0))
    return F.array_join(F.col(f"{entries}.line"), "\n"), F.col(f"{entries}.b"), zero


def _plain(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def _cut(text: str, plain: str, ends: str, zero: str, at: Column, b: Column, lines: int, chars: int) -> Column:
    """What the last lines up to the one at the place (from 0; below: none) take of the text's bytes; b: bytes as of it."""
    end = b - F.col(zero) - 1  # without the end of the last line
    start = F.coalesce(F.get(ends, (at - lines).cast("int")), F.col(zero)) - F.col(zero)
    start = F.when(F.col(plain), F.greatest(start, end - chars)).otherwise(start)  # a character is a byte there
    return F.substring(text, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int")).cast("string")


def _shortened(tail: str, plain: str, chars: int) -> Column:
    """The last chars of what _cut() gives. Characters are counted only where they may differ from bytes: a count goes
    through the whole text, as slowly as three digests of it."""
    return F.when(F.col(plain) | (F.octet_length(tail) <= chars), F.col(tail)).otherwise(F.right(tail, F.lit(chars)))


def text_tail(events: DataFrame, lines: int = 500, chars: int = 50_000, stream: str = "stream_id", width: int = WIDTH, count: str | None = None) -> DataFrame:
    """The last lines of the row's channel as of the row, joined, the last chars of them; with count, a column of this name
    for the tail's number of characters.

    Rows are numbered in their stream and channel and dealt into segments of that order; the last lines - 1 rows of a
    segment also go to the next one. A segment's lines are one text, of which each row reads the bytes from the end of the
    line before its first one to the end of its own."""
    size = max(4 * lines, 1024)
    d = materialize(events.withColumn("channel", channel(F.col("source"))).withColumn("_row", F.monotonically_increasing_id()), "tails")
    keys = [stream, "channel"]
    d = running_sums(d, keys, {"_q": F.lit(1).cast("long"), "_b": _taken()}, ("id", "_row"), width)
    seg, at = F.floor((F.col("_q") - 1) / size), F.pmod(F.col("_q") - 1, F.lit(size))
    to = lambda k, own: F.struct((seg + k).alias("seg"), F.lit(own).alias("own"))
    payload = F.struct(*[c for c in d.columns if c not in (*keys, "_q", "_b", "_row", "raw_line")]).alias("rest")
    dealt = d.withColumn("_to", F.explode(F.when(at > size - lines, F.array(to(0, True), to(1, False))).otherwise(F.array(to(0, True)))))
    one = F.struct(F.col("_q").alias("q"), F.col("_b").alias("b"), F.col("_to.own").alias("own"), F.col("raw_line").alias("line"), F.when(F.col("_to.own"), payload).alias("rest"))
    held = dealt.groupBy(*keys, F.col("_to.seg").alias("_seg")).agg(F.collect_list(one).alias("_rows")).withColumn("_rows", _in_order("_rows"))
    text, ends, zero = _text("_rows")
    held = held.select(*keys, "_rows", text.alias("_text"), ends.alias("_ends"), zero.alias("_zero"))
    held = held.select(*keys, "_rows", "_ends", "_zero", _plain(F.col("_text")).alias("_plain"), F.col("_text").cast("binary").alias("_bytes"))
    each = held.select(*keys, "_ends", "_zero", "_plain", "_bytes", F.posexplode("_rows").alias("_at", "_r")).filter("_r.own")
    cut = _cut("_bytes", "_plain", "_ends", "_zero", F.col("_at"), F.col("_r.b"), lines, chars)
    each = each.select(*[F.col(c) if c in keys else F.col("_r.line").alias(c) if c == "raw_line" else F.col(f"_r.rest.{c}") for c in [*events.columns, "channel"]], "_plain", cut.alias("tail"))
    each = each.withColumn("tail", _shortened("tail", "_plain", chars))
    if count:
        each = each.withColumn(count, F.when(F.col("_plain"), F.octet_length("tail")).otherwise(F.length("tail")))
    return each.drop("_plain")


def _with_last(events: DataFrame, value: str, n: int, keys: list[str], width: int) -> DataFrame:
    """_kept: the last n values (not null) of the keys' stream as of each row. Rows are numbered in their stream and dealt into
    segments of that order; the last n - 1 rows of a segment also go to the next one, so no task holds a stream."""
    size = max(4 * n, 1024)
    d = running_sums(events, keys, {"_q": F.lit(1).cast("long")}, width=width)
    seg, at = F.floor((F.col("_q") - 1) / size), F.pmod(F.col("_q") - 1, F.lit(size))
    to = lambda k, own: F.struct((seg + k).alias("_seg"), F.lit(own).alias("_own"))
    dealt = d.withColumn("_to", F.explode(F.when(at > size - n, F.array(to(0, True), to(1, False))).otherwise(F.array(to(0, True))))).select("*", "_to.*")
    w = Window.partitionBy(*keys, "_seg").orderBy("_q").rowsBetween(-(n - 1), 0)
    return dealt.withColumn("_kept", F.collect_list(value).over(w)).filter("_own").select(*events.columns, "_kept")


def ring(events: DataFrame, row: str, columns: int, rows: int = 50, *keys: str, width: int = WIDTH) -> DataFrame:
    """Snapshot of the last rows (arrays of numbers), oldest first, zeros at the end until full."""
    zero = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), columns), rows - F.size("_kept"))
    return _with_last(events, row, rows, list(keys), width).withColumn("ring", F.concat("_kept", zero)).drop("_kept")


def observations(events: DataFrame, lines: int = 500, chars: int = 50_000, row: str | None = None, rows: int = 50, stream: str = "stream_id", width: int = WIDTH, size: int = 4096) -> DataFrame:
    """What an observer sees as of each row: the tail of every channel, tail_<channel>, empty before its first line. With row, a
    column of numbers of the kernel rows, kernel channels give ring_<channel> instead, zeros where they had no row yet.

    Rows know how many of each channel their stream has had so far. A stream is cut into ranges of size rows; each range
    also gets the rows of each channel that stand before it and that its first rows can still see, found by their number.
    A range keeps one text for each channel, of which each row reads the bytes up to the last line that it counts, and for
    rings an array."""
    rings = KERNEL_COLUMNS if row is not None else {}
    channels = list(dict.fromkeys(CHANNEL_OF_SOURCE.values()))
    seen = lambda c: rows if c in rings else lines
    d = materialize(events.withColumn("channel", channel(F.col("source"))).withColumn("_row", F.monotonically_increasing_id()), "observed")
    n = {c: f"_n{k}" for k, c in enumerate(channels)}
    b = {c: f"_b{k}" for k, c in enumerate(channels) if c not in rings}
    sums = {n[c]: (F.col("channel") == c).cast("long") for c in channels} | {b[c]: F.when(F.col("channel") == c, _taken()).otherwise(F.lit(0).cast("long")) for c in b}
    d = running_sums(d, [stream], sums, ("id", "_row"), width)
    counts = sum((F.col(x) for x in n.values()), F.lit(0))
    d = materialize(d.withColumn("_p", F.floor((counts - 1) / size)), "numbered")
    q = F.coalesce(*[F.when(F.col("channel") == c, F.col(n[c])) for c in channels])
    value = {"b": F.coalesce(*[F.when(F.col("channel") == c, F.col(b[c])) for c in b]), "line": F.col("raw_line")} | ({"numbers": F.col(row)} if rings else {})
    entry = F.struct(q.alias("q"), "channel", *[v.alias(k) for k, v in value.items()])
    own = d.select(stream, "_p", entry.alias("_e"), F.struct(*[c for c in d.columns if c not in (stream, "_p")]).alias("_own"))
    # Of each channel, the numbers that a range's first rows can see: those that end before its own.
    before = d.groupBy(stream, "_p").agg(*[F.min(F.col(n[c]) - (F.col("channel") == c).cast("long")).alias(n[c]) for c in channels])
    of = lambda c: lambda k: F.struct(F.lit(c).alias("channel"), k.alias("q"))
    numbers = F.concat(*[F.when(F.col(n[c]) > 0, F.transform(F.sequence(F.greatest(F.col(n[c]) - (seen(c) - 1), F.lit(1)), F.col(n[c])), of(c))).otherwise(F.array().cast("array<struct<channel:string,q:bigint>>")) for c in channels])
    asked = before.select(stream, F.col("_p").alias("_to"), F.explode(numbers).alias("_a")).select(stream, "_to", F.col("_a.channel").alias("channel"), F.col("_a.q").alias("_q"))
    halo = _joined(asked, d.select(stream, "channel", q.alias("_q"), entry.alias("_e")), [stream, "channel", "_q"]).select(stream, F.col("_to").alias("_p"), "_e", F.lit(None).cast(own.schema["_own"].dataType).alias("_own"))
    held = own.unionByName(halo).groupBy(stream, "_p").agg(F.collect_list("_own").alias("_rows"), *[F.collect_list(F.when(F.col("_e.channel") == c, F.col("_e"))).alias(f"_c{k}") for k, c in enumerate(channels)])
    held = held.withColumns({f"_c{k}": _in_order(f"_c{k}") for k in range(len(channels))})
    held = held.select(stream, "_rows", *[F.coalesce(F.get(F.col(f"_c{k}"), F.lit(0))["q"], F.lit(1)).alias(f"_q{k}") for k in range(len(channels))], *[x for k, c in enumerate(channels) for x in ([F.col(f"_c{k}.numbers").alias(f"_v{k}")] if c in rings else [v.alias(f"_{name}{k}") for name, v in zip(("text", "ends", "zero"), _text(f"_c{k}"))])])
    texts = [k for k, c in enumerate(channels) if c not in rings]
    held = held.withColumns({f"_plain{k}": _plain(F.col(f"_text{k}")) for k in texts} | {f"_bytes{k}": F.col(f"_text{k}").cast("binary") for k in texts}).drop(*[f"_text{k}" for k in texts])
    each = held.select(*[c for c in held.columns if c != "_rows"], F.explode("_rows").alias("_r"))
    place = {c: F.col(f"_r.{n[c]}") - F.col(f"_q{k}") + 1 for k, c in enumerate(channels)}
    cuts = {f"_cut{k}": _cut(f"_bytes{k}", f"_plain{k}", f"_ends{k}", f"_zero{k}", place[channels[k]] - 1, F.col(f"_r.{b[channels[k]]}"), lines, chars) for k in texts}
    each = each.withColumns(cuts)
    out = []
    for k, c in enumerate(channels):
        if c in rings:
            zeros = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), rings[c]), rows)
            out.append(F.slice(F.concat(F.filter(_last(F.col(f"_v{k}"), place[c], rows), lambda x: x.isNotNull()), zeros), 1, rows).alias(f"ring_{c}"))
        else:
            out.append(_shortened(f"_cut{k}", f"_plain{k}", chars).alias(f"tail_{c}"))
    return each.select(*[F.col(c) if c == stream else F.col(f"_r.{c}") for c in [*events.columns, "channel"]], *out)


def window_stack(events: DataFrame, row: str, columns: int, size: int, *keys: str, width: int = WIDTH) -> DataFrame:
    """The last size observations flattened, zeros in front until there are enough."""
    zero = F.array_repeat(F.lit(0.0).cast("double"), columns * (size - F.size("_kept")))
    return _with_last(events, row, size, list(keys), width).withColumn("stack", F.concat(zero, F.flatten("_kept"))).drop("_kept")


def decaying_trace(events: DataFrame, row: str, gap: str = "dt_seconds", decay: float = 0.95, stream: str = "stream_id", width: int = 1 << 16) -> DataFrame:
    """t = t * decay^gap + x along each stream. Ids are dealt into ranges of width; each range's end without what came before,
    and the seconds it spans, give what the next one starts with, so that no task holds a stream."""
    part = events.withColumn("_p", F.coalesce(F.floor(F.col("id") / width), F.lit(2**62)))  # null ids come last
    keys, columns = [stream, "_p"], events.columns
    kind = T.ArrayType(T.DoubleType())

    def along(pdf: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
        state, out = None, []
        for x, dt in zip(pdf[row], pdf[gap], strict=True):
            x = np.asarray(x, dtype=float)
            state = x if state is None else state * decay**dt + x
            out.append(state)
        return out, np.cumsum(pdf[gap].to_numpy(dtype=float))

    def end(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, spans = along(pdf.sort_values("id"))
        return pd.DataFrame({stream: [key[0]], "_p": [key[1]], "_end": [out[-1]], "_span": [spans[-1]]})

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, before = pdf.sort_values("_p"), None, []
        for x, span in zip(pdf["_end"], pdf["_span"], strict=True):
            before.append(state)
            state = np.asarray(x) if state is None else state * decay**span + np.asarray(x)
        return pdf[keys].assign(_before=before)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        out, spans = along(pdf)
        before = pdf["_before"].iloc[0]
        if before is not None:
            out = [x + np.asarray(before) * decay**s for x, s in zip(out, spans, strict=True)]
        return pdf[columns].assign(trace=out)

    key = T.StructType([events.schema[stream], T.StructField("_p", T.LongType())])
    ends = part.select(*keys, "id", row, gap).groupBy(*keys).applyInPandas(end, T.StructType([*key.fields, T.StructField("_end", kind), T.StructField("_span", T.DoubleType())]))
    starts = ends.groupBy(stream).applyInPandas(carry, T.StructType([*key.fields, T.StructField("_before", kind)]))
    renamed = starts.select(F.col(stream).alias("_s"), F.col("_p").alias("_q"), "_before")
    joined = part.join(renamed, F.col(stream).eqNullSafe(F.col("_s")) & (F.col("_p") == F.col("_q"))).drop("_s", "_q")
    return joined.groupBy(*keys).applyInPandas(run, T.StructType([*events.schema.fields, T.StructField("trace", kind)]))


def within_seconds(rows: DataFrame, key: str, seconds: int, out: str, time: str = "timestamp", bins: int = 8) -> DataFrame:
    """Rows of the same key in the seconds up to each row, those of its own microsecond included. Rows are dealt by key and
    bin of bins x seconds; those of a bin's last seconds also go to the next one, so no task holds a key."""
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(time))
    size = bins * seconds * 1_000_000
    b = F.floor(F.col("_us") / size)
    late = F.pmod(F.col("_us"), F.lit(size)) >= size - seconds * 1_000_000
    to = F.when(late, F.array(F.struct(b.alias("b"), F.lit(True).alias("own")), F.struct((b + 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(b.alias("b"), F.lit(True).alias("own"))))
    d = rows.withColumn("_us", us).withColumn("_to", F.explode(to))
    w = Window.partitionBy(key, "_to.b").orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    return d.withColumn(out, F.count(F.lit(1)).over(w)).filter("_to.own").drop("_us", "_to")


def failures_within(events: DataFrame, seconds: int = 300, threshold: int = 5) -> DataFrame:
    """Rows of the row's address in the seconds before it, and the action they call for."""
    return with_action(within_seconds(events, "src_ip", seconds, "failures"), threshold)


def failed_logins_within(events: DataFrame, seconds: int = 300, threshold: int = 5) -> DataFrame:
    """Failed logins in raw_line: failed_ip, failures of that address in the seconds before it, itself included, action.
    Other rows, those without an address and those without a time, count nowhere and are left away."""
    found = F.filter(F.array(failure_address(F.col("raw_line"))), lambda ip: ip.isNotNull())  # exploded, it is taken once; a filter would take it anew
    failed = events.filter("source = 'auth_log' and timestamp is not null").withColumn("failed_ip", F.explode(found))
    return with_action(within_seconds(failed, "failed_ip", seconds, "failures"), threshold)


def with_action(rows: DataFrame, threshold: int) -> DataFrame:
    return rows.withColumn("action", F.when(F.col("failures") >= threshold, 3).when(F.col("failures") >= threshold // 2, 1).otherwise(0))


EVENT_COUNTERS = ["auth_success", "auth_failure", "auth_invalid_user", "connection", "session_open", "session_close", "http_request", "http_error"]


def session_features(events: DataFrame, width: int = WIDTH) -> DataFrame:
    """Twenty running numbers of the row's session (session_id, else src_ip, else 'unknown'), f00 to f19. A session of any
    size is cut into ranges of width ids, whose counts, first occurrences and entropy sums are added up."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    d = events.withColumn("key", F.when(has("session_id"), F.col("session_id")).when(has("src_ip"), F.col("src_ip")).otherwise("unknown"))
    d = d.withColumn("subnet", F.when(has("src_ip"), F.substring_index("src_ip", ".", 3)))
    # No window holds a key, an address or a user whole: they are cut into ranges of ids.
    d = d.select("id", "key", "subnet", "username", "src_ip", "event_type", "timestamp", F.monotonically_increasing_id().alias("_row"))
    d = materialize(d, "sessions")
    order = ("id", "_row")
    in_net = running_sums(d.filter("subnet is not null").select("key", "subnet", *order), ["key", "subnet"], {"_c": F.lit(1)}, order, width)
    clog = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(0.0)
    c = F.col("_c").cast("double")
    marks = in_net.select("_row", (clog(c) - clog(c - 1)).alias("_inc"))
    for name, column in (("_u", "username"), ("_i", "src_ip")):  # rows where a user or an address is new to the key
        new = d.filter(has(column)).groupBy("key", column).agg(F.min(F.struct(*order)).alias("_m")).select(F.col("_m._row").alias("_row"), F.lit(1).alias(name))
        marks = marks.join(new, "_row", "full")
    start = d.groupBy("key").agg(F.min_by("timestamp", F.struct(*order)).alias("_start"))
    d = d.join(marks, "_row", "left").join(start, "key").withColumns({"_inc": F.coalesce("_inc", F.lit(0.0)), "_u": F.coalesce("_u", F.lit(0)), "_i": F.coalesce("_i", F.lit(0))})
    is_kind = lambda *kinds: F.coalesce(F.col("event_type").isin(*kinds), F.lit(False)).cast("int")
    counts = [F.lit(1), *[is_kind(k) for k in EVENT_COUNTERS], 1 - is_kind(*EVENT_COUNTERS)]
    sums = {f"_f{k:02d}": c for k, c in enumerate(counts)} | {"_users": F.col("_u"), "_addresses": F.col("_i"), "_n": F.col("subnet").isNotNull().cast("int"), "_sum": F.col("_inc")}
    d = running_sums(d, ["key"], sums, order, width)
    d = d.withColumns({f"f{k:02d}": F.col(f"_f{k:02d}").cast("double") for k in range(len(counts))})
    span = seconds_between(F.col("_start"), F.col("timestamp"))
    hour, dow = F.hour("timestamp") + F.minute("timestamp") / 60.0, F.weekday("timestamp").cast("double")
    more = {
        "f10": F.col("_users").cast("double"), "f11": F.col("_addresses").cast("double"),
        "f12": F.when(F.col("_n") > 0, F.greatest(F.lit(0.0), F.log2(F.col("_n").cast("double")) - F.col("_sum") / F.col("_n"))).otherwise(0.0),
        "f13": F.col("f02") / F.greatest(F.col("f01") + F.col("f02"), F.lit(1.0)),
        "f14": span, "f15": F.when(F.col("f00") > 1, span / (F.col("f00") - 1)).otherwise(0.0),
    }
    more |= dict(zip(("f16", "f17"), cyclic(hour, 24.0), strict=True)) | dict(zip(("f18", "f19"), cyclic(dow, 7.0), strict=True))
    return d.withColumns(more).select("id", "key", *[f"f{k:02d}" for k in range(20)])


def process_depth(events: DataFrame, stream: str = "stream_id", width: int = WIDTH) -> DataFrame:
    """Depth in the process tree: the parent's latest depth plus 1 (unknown parents count as 0), without parent 0;
    every process row sets its pid's depth anew.

    Each row's parent is the latest row before it that carries the parent's pid, found by ranges. Links are then
    doubled: a row that points to another takes that one's pointer and adds its distance, so that a tree of depth d takes
    log2(d) joins. Rounds are written; rows that have arrived at a root take no further part."""
    rows = materialize(events.withColumn("_row", F.monotonically_increasing_id()), "processes")
    keys = rows.select(F.col(stream).alias("_s"), "id", "_row", F.col("pid").cast("long").alias("pid"), F.nullif(F.col("ppid").cast("long"), F.lit(0)).alias("ppid"))
    sets = keys.filter("pid is not null").select("_s", F.col("pid").alias("_key"), "id", "_row", F.lit(1).alias("_kind"), F.col("_row").alias("_value"))
    asks = keys.filter("ppid is not null").select("_s", F.col("ppid").alias("_key"), "id", "_row", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_value"))
    found = latest_before(sets.unionByName(asks), ["_s", "_key"], "_value", "up", ("id", "_row", "_kind"), width).filter("_kind = 0")
    links = materialize(found.select("_row", "up", F.lit(1).alias("depth")), "parents")
    # Rows without a parent are no links: who points to one has arrived.
    while not (moving := links.filter("up is not null")).isEmpty():
        above = links.select(F.col("_row").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        step = moving.join(above, "up", "left").select("_row", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"))
        after = materialize(step.unionByName(links.filter("up is null")), "parents")
        drop(links)
        links = after
    return rows.join(links.select("_row", "depth"), "_row", "left").select(*events.columns, F.coalesce("depth", F.lit(0)).cast("int").alias("depth"))
