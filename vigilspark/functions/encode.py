"""Scalar encoders of kernel events, features and targets. Column expressions, but for murmur3 (numpy on Arrow batches)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilspark import domains as D

COMM, ADDRESS, PATH = 0, 1, 2  # hash seeds


def mapped(key: Column, values: dict[str, object], default: object) -> Column:
    out = F.lit(default)
    for k, v in reversed(list(values.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def decoded(parsed: Column) -> Column:
    """The fields of a JSON object as texts; no fields for null, bad text, repeated keys or JSON that is no object."""
    # A parser stops behind the first value, so that what follows shows only inside brackets.
    alone = F.concat(F.lit("["), parsed, F.lit("]"))
    sound = F.is_valid_utf8(parsed) & F.rlike(parsed, F.lit(r"\}\s*$")) & F.try_parse_json(alone).isNotNull() & (F.json_array_length(alone) == 1)
    fields = F.from_json(F.when(sound, parsed), "map<string,string>")
    return F.coalesce(fields, F.create_map().cast("map<string,string>"))


def channel(source: Column) -> Column:
    return mapped(source, D.CHANNEL_OF_SOURCE, "syslog")


def true_risk(is_malicious: Column, stage: Column) -> Column:
    return F.when(is_malicious == 1, mapped(stage, D.RISK_OF_STAGE, 0.0)).otherwise(0.0)


def syscall_number(name: Column) -> Column:
    return mapped(name, {n: k + 1 for k, n in enumerate(D.SYSCALLS)}, 0)


def syscall_source(name: Column) -> Column:
    return mapped(name, D.SOURCE_OF_SYSCALL, "ebpf_process")


def flag_bits(flags: Column) -> Column:
    """Bits of names joined by |; unknown names and null give 0."""
    return F.coalesce(F.aggregate(F.split(flags, r"\|"), F.lit(0), lambda a, f: a.bitwiseOR(mapped(F.trim(f), D.FLAG_BITS, 0))), F.lit(0))


def flag_names(flags: Column) -> Column:
    """Names of an open-flag integer: the access mode first, then bits in order of value."""
    mode = F.when(flags.bitwiseAND(3) == 1, "O_WRONLY").when(flags.bitwiseAND(3) == 2, "O_RDWR").otherwise("O_RDONLY")
    rest = F.array(*[F.when(flags.bitwiseAND(b) != 0, n) for n, b in D.FLAG_BITS.items() if b > 2])
    return F.array_join(F.concat(F.array(mode), F.filter(rest, lambda n: n.isNotNull())), "|")


def address(value: Column) -> Column:
    """Text before the last colon; the whole text without one."""
    return F.when(value.contains(":"), F.regexp_extract(value, r"^(.*):([^:]*)$", 1)).otherwise(value)


def port(value: Column) -> Column:
    return F.coalesce(F.when(value.contains(":"), F.try_to_number(F.nullif(F.regexp_extract(value, r":(\d{1,9})$", 1), F.lit("")), F.lit("999999999"))).cast("int"), F.lit(0))


def log_delta(dt: Column) -> Column:
    return F.log1p(F.greatest(F.lit(0.0), dt))


def murmur3_numpy(text: str, seed: int) -> int:
    """murmur3 x86 32-bit of UTF-8 text, unsigned."""
    return int(murmur3_batch(pa.array([text]), seed)[0])


def murmur3_batch(texts: pa.Array, seed: int) -> np.ndarray:
    """murmur3 x86 32-bit of the UTF-8 of each text (none null), unsigned, all at once: in round k the k-th four bytes of
    every text that has them are mixed in, longest texts first, so that those of a round stand together."""
    texts = texts.cast(pa.large_string())
    edges = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    data = np.concatenate((raw[edges[0] : edges[-1]], np.zeros(4, dtype=np.uint8))).astype(np.uint32)
    size = np.diff(edges)
    order = np.argsort(-size, kind="stable")
    start, size = (edges[:-1] - edges[0])[order], size[order]
    u = np.uint32
    turned = lambda x, n: (x << u(n)) | (x >> u(32 - n))
    mixed = lambda k: turned(k * u(0xCC9E2D51), 15) * u(0x1B873593)
    four = lambda at: data[at] | data[at + 1] << u(8) | data[at + 2] << u(16) | data[at + 3] << u(24)
    h, whole = np.full(len(size), seed, dtype=u), size // 4
    for k in range(int(whole[0]) if len(whole) else 0):
        n = int(np.searchsorted(-whole, -k, side="left"))  # texts with more than k whole rounds
        h[:n] = turned(h[:n] ^ mixed(four(start[:n] + 4 * k)), 13) * u(5) + u(0xE6546B64)
    rest = size % 4
    keep = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], dtype=u)[rest]
    h ^= mixed(four(start + 4 * whole) & keep) ^ size.astype(u)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> u(shift)) * u(factor)
    out = np.empty_like(h)
    out[order] = h ^ h >> u(16)
    return out


def murmur3(text: Column, seed: int) -> Column:
    """Unsigned 32-bit hash as long; null gives null. A batch is hashed as a whole."""

    @F.arrow_udf("long")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array(murmur3_batch(texts.fill_null(""), seed).astype(np.int64), mask=texts.is_null().to_numpy(zero_copy_only=False))

    return hashed(text)


def one_hot(value: Column, names: list[str], otherwise: str | None = None) -> list[Column]:
    known = F.when(value.isin(names), value).otherwise(F.lit(otherwise))
    return [F.when(known == n, 1.0).otherwise(0.0) for n in names]


def cyclic(value: Column, period: float) -> list[Column]:
    angle = value * F.lit(2 * np.pi / period)
    return [F.sin(angle), F.cos(angle)]


def event_vector(source: Column, event_type: Column, ts: Column, src_ip: Column, username: Column) -> Column:
    """24 numbers: source and type one-hot, hour and weekday on the circle, whether address and user are known."""
    have = lambda c: F.when(F.coalesce(c, F.lit("")) != "", 1.0).otherwise(0.0)
    parts = [*one_hot(source, D.VECTOR_SOURCES), *one_hot(event_type, D.VECTOR_EVENTS, "other"), *cyclic(F.hour(ts) + F.minute(ts) / 60.0, 24.0), *cyclic(F.weekday(ts).cast("double"), 7.0), have(src_ip), have(username)]
    return F.array(*parts).cast("array<float>")


def targets(is_malicious: Column, attack_type: Column, stage: Column, severity: Column, session_value: Column, scale: float = 100.0) -> Column:
    """Five heads; NaN where unknown."""
    index = lambda c, names: mapped(c, {n: k / (len(names) - 1) for k, n in enumerate(names)}, None)
    heads = [is_malicious.cast("double"), index(attack_type, D.ATTACK_TYPES), index(stage, D.ATTACK_STAGES), severity / float(D.MAX_SEVERITY), session_value / scale]
    return F.array(*[F.coalesce(h, F.lit(float("nan"))) for h in heads]).cast("array<float>")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"""[\s\[\]():=,"'{}]+"""), lambda t: t != "")


def hashed_features(lists: pa.Array, dim: int, seeds: tuple[int, int]) -> np.ndarray:
    """A row for each list of tokens: signed counts of its uni- and bigrams by bucket, of unit length; zeros for no tokens.
    All tokens of the batch are hashed at once; pairs are joined where both tokens are of one list."""
    tokens = lists.flatten()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    pairs = np.flatnonzero(row[1:] == row[:-1])
    joined = pc.binary_join_element_wise(tokens.take(pa.array(pairs)), tokens.take(pa.array(pairs + 1)), "_")
    out = np.zeros((len(lists), dim))
    for texts, of in ((tokens, row), (joined, row[pairs])):
        place = murmur3_batch(texts, seeds[0]) % dim
        np.add.at(out, (of, place), 1.0 - 2.0 * (murmur3_batch(texts, seeds[1]) % 2))
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def feature_hash(text: Column, dim: int = 1024, seeds: tuple[int, int] = (42, 7)) -> Column:
    """Signed hashing of token uni- and bigrams into dim buckets, unit length; zeros for no tokens."""

    @F.arrow_udf("array<float>")
    def hashed(lists: pa.Array) -> pa.Array:
        parts = [hashed_features(lists.slice(k, 1024), dim, seeds).astype(np.float32) for k in range(0, len(lists), 1024)]
        whole = np.concatenate(parts) if parts else np.zeros((0, dim), dtype=np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1, dtype=np.int32) * dim), pa.array(whole.ravel()))

    return hashed(tokens(text))


def duration_seconds(text: Column) -> Column:
    n = F.try_to_number(F.nullif(F.regexp_extract(text, r"^(\d+(?:\.\d+)?)\s*[dhms]$", 1), F.lit("")), F.lit("999999999.999999")).cast("double")
    unit = F.regexp_extract(text, r"([dhms])$", 1)
    return n * mapped(unit, {"d": 86400.0, "h": 3600.0, "m": 60.0, "s": 1.0}, None)


def utc_offset_seconds(text: Column) -> Column:
    sign = F.when(F.substring(text, 1, 1) == "-", -1).otherwise(1)
    return sign * (F.substring(text, 2, 2).cast("int") * 3600 + F.substring(text, 4, 2).cast("int") * 60)


def keyword_score(source: Column, line: Column) -> Column:
    """Sum of the weights of the rules of the line's channel that match."""
    out = F.lit(0)
    where = channel(source)
    for name, rules in D.KEYWORD_RULES.items():
        total = F.lit(0)
        for pattern, weight in rules:
            total = total + F.when(line.rlike(pattern), weight).otherwise(0)
        out = F.when(where == name, total).otherwise(out)
    return out


def failure_address(line: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, group in reversed(D.FAILURE_PATTERNS):
        out = F.when(line.rlike(pattern), F.regexp_extract(line, pattern, group)).otherwise(out)
    return out


def keyword_action(score: Column, src_ip: Column) -> Column:
    return F.when((score >= 5) & src_ip.isNotNull(), D.BLOCK).when(score >= 2, D.ALERT).otherwise(D.PASS)


def action_reward(action: Column, is_malicious: Column) -> Column:
    table = lambda rewards: mapped(action, {k: v for k, v in rewards.items()}, 0.0)
    return F.when(is_malicious == 1, table(D.REWARD_ON_ATTACK)).otherwise(table(D.REWARD_ON_BENIGN))
