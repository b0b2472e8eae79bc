"""Quality classifier: naive Bayes support vectors.

Features are n-gram indicators: words and pairs of words, their shapes (letter case, digits,
signs) and pairs of shapes. Each is scaled by its log-count ratio between the classes; a linear hinge-loss model is
then fitted by dual coordinate descent, and its margin mapped to a probability on scores from
held-out halves of the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

BITS = 18
#: The fit takes at most so many labelled rows, those with the least hash of their id. Their feature
#: lists are all that reaches the driver.
TRAIN_ROWS = 6_000
SMOOTH, COST, EPOCHS = 1.0, 1.0, 12
CUT = 0.3

_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else 32 if c in (9, 10, 11, 12, 13, 32) else c for c in range(256))


def _squeeze(shape: bytes) -> bytes:
    for c in (b"a", b"A", b"0"):
        for n in (16, 4, 2, 2):
            shape = shape.replace(c * n, c)
    return shape


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) & np.uint64((1 << BITS) - 1)


def features(text: str | None) -> np.ndarray:
    """Ascending distinct hashed features of a whole text; none for a text without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int32)
    h = np.fromiter(map(crc32, words), np.uint64, n)
    shapes = _squeeze(data.translate(_SHAPE)).split()
    g = np.fromiter(map(crc32, shapes), np.uint64, len(shapes))
    k = np.uint64(1 << 32)
    parts = [h + k, g + k * np.uint64(2), h[:-1] * np.uint64(31) + h[1:] + k * np.uint64(64), g[:-1] * np.uint64(31) + g[1:] + k * np.uint64(128)]
    return np.unique(_mix(np.concatenate(parts))).astype(np.int32)


@dataclass
class Model:
    weight: np.ndarray  # of a feature: log-count ratio times hinge weight
    square: np.ndarray  # square of its ratio, for the length of a text's vector
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, f: np.ndarray) -> float:
        return float(self.weight[f].sum() / max(1e-9, self.square[f].sum()) ** 0.5 + self.bias) if len(f) else self.bias

    def score(self, f: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(f) + self.shift, -30, 30))))


def ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.full((2, 1 << BITS), SMOOTH)
    for f, y in zip(rows, labels):
        counts[int(y), f] += 1
    p, q = counts[1] / counts[1].sum(), counts[0] / counts[0].sum()
    return np.log(p / q)


def descend(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """L1 hinge loss with L2 penalty in the dual, one coordinate at a time; classes weigh alike."""
    y = np.where(labels > 0, 1.0, -1.0)
    share = np.array([max(1, (labels == 0).sum()), max(1, (labels == 1).sum())])
    top = COST * len(y) / (2 * share[labels.astype(int)])
    x = [ratio[f] / max(1e-9, float((ratio[f] ** 2).sum())) ** 0.5 for f in rows]
    q = np.array([float((v * v).sum()) + 1 for v in x])
    w, b, a = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            f, v = rows[i], x[i]
            grad = y[i] * (float(w[f] @ v) + b) - 1
            new = min(max(a[i] - grad / q[i], 0.0), top[i])
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[f] += step * v
                b += step
                a[i] = new
    return w, b


def fit(rows: list[np.ndarray], labels: list[int]) -> Model:
    """A model of the rows; of one class only, a constant near it."""
    y = np.array(labels, np.int64)
    zero = np.zeros(1 << BITS)
    if not len(y) or y.min() == y.max():
        return Model(zero, zero, 0.0, 1.0, 0.0 if not len(y) else 3.0 if y[0] else -3.0)

    def model(pick: np.ndarray) -> Model:
        own, t = [rows[i] for i in pick], y[pick]
        r = ratios(own, t)
        w, b = descend(own, t, r)
        return Model(w * r, r * r, b)

    margins = np.zeros(len(y))
    half = np.arange(len(y)) % 2
    for k in (0, 1):
        pick = np.flatnonzero(half != k)
        if y[pick].min() != y[pick].max():
            m = model(pick)
            margins[half == k] = [m.margin(rows[i]) for i in np.flatnonzero(half == k)]
    out = model(np.arange(len(y)))
    out.slope, out.shift = platt(margins, y)
    return out


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic map of margins by damped Newton steps; the slope stays positive."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t = np.where(y > 0, hi, lo)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, w = p - t, p * (1 - p) + 1e-9
        grad = np.array([(g * margins).sum(), g.sum()])
        hess = np.array([[(w * margins * margins).sum() + 1e-6, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


def held_out(id_col: Column) -> Column:
    """Rows that no fit may see: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents that are not held out. Null labels and ids are skipped;
    of several labels of one id the least counts, of several texts of one id the one with the least
    features. Empty tables give a constant model. Further columns are ignored."""
    given = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).filter(~held_out(F.col(id_col)))
    given = given.groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    # Bounded: at most ``rows`` pairs of numbers.
    pick = F.broadcast(materialise(given.orderBy(F.xxhash64("id"), "id").limit(rows), "sample"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t).tobytes() for t in b.column(2).to_pylist()], pa.binary())], names=["id", "y", "f"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(pick, "id").select("id", "y", "text")
    kind = docs.schema[id_col].dataType.simpleString()
    made = texts.mapInArrow(run, f"id {kind}, y int, f binary").groupBy("id", "y").agg(F.min("f").alias("f"))
    got = sorted(((r["id"], r["y"], bytes(r["f"])) for r in materialise(made, "features").collect()), key=lambda r: r[0])  # at most ``rows``
    return fit([np.frombuffer(f, np.int32) for _, _, f in got], [y for _, y, _ in got])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row; only the text is looked at. Null is an empty
    text, scored by the bias; repeated rows and null ids keep their rows; an empty table stays empty."""
    small = Model(model.weight.astype(np.float32), model.square.astype(np.float32), model.bias, model.slope, model.shift)
    sent = docs.sparkSession.sparkContext.broadcast(small.__dict__)  # two floats for each of 2**BITS features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**sent.value)
        for b in batches:
            s = [round(m.score(features(t)), 9) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= CUT) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` by a model of ``labels``; rows as in ``scored``, labels as in ``train``."""
    return scored(docs, train(docs, labels))
