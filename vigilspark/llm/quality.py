"""Quality classifier: Naive Bayes support vectors, fitted by dual coordinate descent.

Indicators say which n-grams a whole text holds: runs of 1 to 3 character classes (letters, one class for capitals,
for digits, for bytes beyond ASCII, and a class for each punctuation mark) and runs of 1 to 2 token shapes (length,
all capitals, equal to the token before, last character). Each indicator is scaled by its log-count ratio
between the classes; an L2-regularised hinge-loss model is fitted to the scaled indicators, and its margins are turned
into scores by a logistic curve fitted to them.

Learned from at most TRAIN_ROWS labelled rows, the first by a hash of the id (the stated bound). Only indices of
indicators come to the driver, 4 bytes for each indicator that a row holds: at most TRAIN_ROWS x FEATURES x 4 bytes, which rows
of very many different indicators approach and ordinary texts don't.

Defined results: null texts count as empty; empty texts get the model's bias score; without labels of both classes
every score is the share of class 1 (0.5 without any); repeated rows each give a row, repeated equal rows of the sample count as
one; equal texts get equal scores; very long texts are read whole; null labels are ignored; no rows give no rows; other columns are ignored."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.common import first_rows, fold_of, per_batch

TRAIN_ROWS = 8000
SMOOTH, COST, EPOCHS = 1.0, 0.1, 12
CHAR_BITS, SHAPE_BITS = 6, 8
CHARS = 1 << CHAR_BITS
SHAPES = 1 << SHAPE_BITS
FEATURES = CHARS + CHARS**2 + CHARS**3 + SHAPES + SHAPES**2


class Model(NamedTuple):
    weights: np.ndarray  # scaled weight and squared ratio of each indicator
    bias: float
    slope: float
    shift: float


def _classes() -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    table[[9, 11, 12, 13, 32]] = 1
    table[10] = 2
    table[48:58] = 3
    table[65:91] = 4
    table[128:] = 5
    table[97:123] = 6 + np.arange(26)
    table[marks] = 32 + np.arange(len(marks))
    return table


class Indicators:
    def __init__(self) -> None:
        self.classes = _classes()
        self.flags = np.zeros(FEATURES, dtype=bool)
        self.mix = np.random.default_rng(7).integers(1, 1 << 62, 64, dtype=np.int64)
        last = np.zeros(256, dtype=np.int64)
        last[48:58] = 1
        for k, group in enumerate((b".", b",", b";:", b"!?", b"|")):
            last[list(group)] = 2 + k
        last[[c for c in range(33, 127) if not chr(c).isalnum() and last[c] == 0]] = 7
        self.last = last

    def of(self, text: str) -> np.ndarray:
        """Sorted indices of the indicators that hold."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        flags, base = self.flags, 0
        if len(raw):
            c = self.classes[raw]
            flags[c] = True
            base = CHARS
            two = c[:-1] << CHAR_BITS | c[1:]
            flags[base + two] = True
            base += CHARS**2
            flags[base + (two[:-1] << CHAR_BITS | c[2:])] = True
            shapes = self.shapes(raw, c)
            base += CHARS**3
            flags[base + shapes] = True
            base += SHAPES
            flags[base + (shapes[:-1] << SHAPE_BITS | shapes[1:])] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        return found.astype(np.int32)

    def shapes(self, raw: np.ndarray, c: np.ndarray) -> np.ndarray:
        solid = (c != 1) & (c != 2)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return np.zeros(0, dtype=np.int64)
        where = np.arange(len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw)))) if start[0] == 0 else None
        if where is None:
            where = np.zeros(len(raw), dtype=np.int64)
            where[start[0] :] = np.arange(start[0], len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw))))
        mixed = np.add.reduceat(np.where(solid, (raw.astype(np.int64) + 1) * self.mix[where & 63], 0), start)
        again = np.concatenate(([False], mixed[1:] == mixed[:-1]))
        capitals = np.add.reduceat((c == 4).astype(np.int64), start)
        small = np.add.reduceat(((c >= 6) & (c < 32)).astype(np.int64), start)
        size = np.minimum(end - start, 15) // 2
        return size << 5 | ((capitals > 0) & (small == 0)).astype(np.int64) << 4 | again.astype(np.int64) << 3 | self.last[raw[end - 1]]


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 3) -> Model:
    """Log-count ratios, then max(0, 1 - y w.x) + L2 by dual coordinate descent over the rows, in a seeded order."""
    n, positive = len(labels), labels == 1
    if not n or positive.all() or not positive.any():
        share = float(positive.mean()) if n else 0.5
        return Model(np.zeros((2, FEATURES), dtype=np.float32), 0.0, 0.0, float(np.log((share * n + 0.5 + 1e-9) / (n - share * n + 0.5 + 1e-9))))
    counts = np.zeros((2, FEATURES))
    for row, y in zip(rows, positive, strict=True):
        counts[int(y), row] += 1
    rates = (counts + SMOOTH) / (np.array([[(~positive).sum()], [positive.sum()]]) + 2 * SMOOTH)
    ratio = np.log(rates[1] / rates[0])
    y = np.where(positive, 1.0, -1.0)
    # The rarer class weighs as much as the other in all.
    cost = COST * np.where(positive, n / (2 * positive.sum()), n / (2 * (~positive).sum()))
    scaled = [ratio[row] for row in rows]
    norm = np.array([float(s @ s) for s in scaled]) + 1.0
    scale = 1.0 / np.sqrt(norm)  # rows of unit length: long texts weigh as much as short ones
    w, b, alpha, rng = np.zeros(FEATURES), 0.0, np.zeros(n), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(n):
            x = scaled[i] * scale[i]
            gradient = y[i] * (float(w[rows[i]] @ x) + b * scale[i]) - 1.0
            fresh = min(max(alpha[i] - gradient, 0.0), cost[i] * 10)
            if step := (fresh - alpha[i]) * y[i]:
                w[rows[i]] += step * x
                b += step * scale[i]
                alpha[i] = fresh
    margins = np.array([(float(w[r] @ s) + b) * k for r, s, k in zip(rows, scaled, scale, strict=True)])
    slope, shift = _logistic(margins, positive.astype(float))
    return Model(np.stack([w * ratio, ratio * ratio]).astype(np.float32), b, slope, shift)


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve that turns margins into the probability of class 1, with smoothed targets."""
    up, down = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * m * m).sum() + 1e-3, (q * m).sum()], [(q * m).sum(), q.sum()]])
        d = np.linalg.solve(h, g)
        a, b = a - float(np.clip(d[0], -5, 5)), b - float(np.clip(d[1], -5, 5))
        if abs(d).max() < 1e-8:
            break
    return a, b


def margin(model: Model, row: np.ndarray) -> float:
    both = model.weights[:, row].sum(axis=1, dtype=np.float64)
    return float((both[0] + model.bias) / np.sqrt(both[1] + 1.0))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Model of the labelled rows given (the caller leaves held-out rows away)."""
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    chosen = marked.orderBy(F.xxhash64("id"), "id", "y").limit(TRAIN_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    joined = first_rows(texts.join(F.broadcast(chosen), "id"), TRAIN_ROWS)  # TRAIN_ROWS rows of two numbers

    def start() -> object:
        indicators = Indicators()

        def work(batch: pa.RecordBatch) -> dict:
            return {"id": batch.column("id"), "y": batch.column("y"), "row": [indicators.of(t).tobytes() for t in batch.column("text").to_pylist()]}

        return work

    got = per_batch(joined.select("id", "y", "text"), "id long, y int, row binary", start).toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    return fit([np.frombuffer(b, dtype=np.int32) for b in got.column("row").to_pylist()], np.array(got.column("y").to_pylist(), dtype=np.int64))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of class 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights

    def start() -> object:
        indicators, m = Indicators(), shared.value

        def one(text: str | None) -> float:
            x = m.slope * margin(m, indicators.of(text or "")) + m.shift
            return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))

        return lambda batch: {"doc_id": batch.column("doc_id"), "score": [one(t) for t in batch.column("text").to_pylist()]}

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, score double", start)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose crc32(doc_id as text) mod 5 is 0 are held out of learning."""
    model = learn(docs, labels.filter(fold_of("doc_id", 5) != 0))
    return predict(docs, model).select("doc_id", (F.coalesce(fold_of("doc_id", 5), F.lit(0)) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
