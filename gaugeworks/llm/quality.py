"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features are indicators of byte n-grams (1 to 4, hashed) and of how often words repeat.
Each is scaled by the log ratio of its counts in the two classes, and a linear
hinge-loss model is fitted on the scaled indicators by dual coordinate descent."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PASS_CHARS, id_and_text, values

#: Hashed n-grams; after them come the steps of the two repetition shares.
BITS, STEPS = 18, 10
DIM = (1 << BITS) + 2 * STEPS
#: Labelled rows of each class that the model is fitted on, at most: those of least hash of doc_id.
PER_CLASS = 2000
THRESHOLD = 0.3
_MULTIPLY = (0, 0, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def features(text: str, seen: np.ndarray) -> np.ndarray:
    """Sorted indices of the indicators of ``text``; ``seen`` is a zeroed buffer of DIM flags, zeroed again."""
    raw = text.encode("utf-8", "replace")
    for at in range(0, len(raw), PASS_CHARS):
        b = np.frombuffer(raw[at : at + PASS_CHARS + 3], dtype=np.uint8)
        seen[b] = True
        gram = b.astype(np.uint32)
        for n in range(2, 5):
            if len(b) < n:
                break
            gram = (gram[:-1] << np.uint32(8)) | b[n - 1 :]
            seen[(gram * np.uint32(_MULTIPLY[n])) >> np.uint32(32 - BITS)] = True
    words = raw.split()
    if len(words) > 1:
        again = sum(map(operator.eq, words, words[1:])) / (len(words) - 1)
        fresh = len(set(words)) / len(words)
        seen[(1 << BITS) + min(STEPS - 1, int(again * STEPS))] = True
        seen[(1 << BITS) + STEPS + min(STEPS - 1, int(fresh * STEPS))] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


@dataclass
class Model:
    """score = sigmoid(slope * margin + shift); margin = weights of the indicators / root of their number + bias."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        margin = self.bias + (float(self.weights[found].sum()) / len(found) ** 0.5 if len(found) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))


def constant(share: float) -> Model:
    """What stands in for a model where the labels hold one class alone, or none."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(np.zeros(DIM, dtype=np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 12, alpha: float = 1.0, keep: float = 0.25) -> Model:
    """NB-SVM by dual coordinate descent for the L1 hinge loss.

    rows: indices of indicators; labels: 0 or 1. alpha: smoothing of counts. keep: the
    share of the fitted weights against their mean size. Classes weigh alike. A fifth of the
    rows is left out of the descent; on it the sigmoid is fitted."""
    y = np.where(labels > 0, 1.0, -1.0)
    if len(set(y)) < 2 or min((y > 0).sum(), (y < 0).sum()) < 5:
        return constant((float((y > 0).sum()) + 0.5) / (len(y) + 1) if len(y) else 0.5)
    rng = np.random.default_rng(0)
    out = np.zeros(len(y), dtype=bool)
    for side in (1.0, -1.0):
        own = rng.permutation(np.flatnonzero(y == side))
        out[own[: max(1, len(own) // 5)]] = True
    train = np.flatnonzero(~out)
    ratio = count_ratios(rows, y, train, alpha)
    root = np.array([max(1, len(r)) ** 0.5 for r in rows])
    upper = {s: cost * len(train) / (2 * max(1, (y[train] == s).sum())) for s in (1.0, -1.0)}
    w, bias, _ = descend(rows, y, train, ratio, root, upper, epochs, rng)
    mean = np.abs(w).mean()
    weights = (ratio * ((1 - keep) * mean + keep * w)).astype(np.float32)
    bias *= keep
    model = Model(weights, bias, 1.0, 0.0)
    held = np.flatnonzero(out)
    margin = np.array([bias + (weights[rows[k]].sum() / root[k] if len(rows[k]) else 0.0) for k in held])
    model.slope, model.shift = _sigmoid(margin, y[held])
    return model


def count_ratios(rows: list[np.ndarray], y: np.ndarray, train: np.ndarray, alpha: float) -> np.ndarray:
    """For each indicator the log of its share among the counts of class 1, less that of class -1, both smoothed by ``alpha``."""
    count = {side: np.full(DIM, alpha) for side in (1.0, -1.0)}
    for k in train:
        count[y[k]][rows[k]] += 1
    return np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())


def descend(
    rows: list[np.ndarray], y: np.ndarray, train: np.ndarray, ratio: np.ndarray, root: np.ndarray, upper: dict[float, float], epochs: int, rng: np.random.Generator
) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, bias, dual): the L1 hinge loss' dual, one row's variable after another set to its best value between 0 and its
    class's ``upper`` bound. A row's values are its indicators' ratios over its root; the bias is a value of one."""
    w, bias, dual = np.zeros(DIM), 0.0, np.zeros(len(y))
    square = np.array([(ratio[r] ** 2).sum() / n**2 + 1.0 if len(r) else 1.0 for r, n in zip(rows, root)])
    for _ in range(epochs):
        for k in rng.permutation(train):
            r = rows[k]
            x = ratio[r] / root[k]
            slope = y[k] * (w[r] @ x + bias) - 1
            now = min(max(dual[k] - slope / square[k], 0.0), upper[y[k]])
            if now != dual[k]:
                step = (now - dual[k]) * y[k]
                w[r] += step * x
                bias += step
                dual[k] = now
    return w, bias, dual


def _sigmoid(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps on smoothed targets, the classes weighing alike."""
    n = {1.0: (y > 0).sum(), -1.0: (y < 0).sum()}
    target = np.where(y > 0, (n[1.0] + 1) / (n[1.0] + 2), 1 / (n[-1.0] + 2))
    weight = np.where(y > 0, 0.5 / n[1.0], 0.5 / n[-1.0])
    size = float(np.abs(margin).mean()) or 1.0
    x = np.stack([margin / size, np.ones_like(margin)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-4 * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
    return float(beta[0] / size), float(beta[1])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def train_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model fitted on labelled rows outside fold 0: of each class the ``per_class`` of
    least hash of doc_id, or all if there are fewer. Labels other than 0 and 1 and null ids are left out;
    of repeated labels the least counts, of rows that share a doc_id the one of least hash of its text (ties: the least text)."""
    docs = id_and_text(docs, id_col, text_col)
    known = labels.where("quality in (0, 1) and doc_id is not null").where(fold(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    drawn = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    # 2 x per_class ids at most.
    both = F.broadcast(drawn[0].unionAll(drawn[1]))
    rows = docs.join(both, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one"))
    rows = rows.select("doc_id", "quality", F.col("one.text").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("quality", T.IntegerType()), T.StructField("flags", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIM, dtype=bool)
        for batch in batches:
            flags = []
            for text in values(batch.column(2)):
                found = features(text, seen)
                seen[found] = True
                packed = np.packbits(seen).tobytes()
                seen[found] = False
                sparse = found.astype("<u4").tobytes()
                flags.append(b"s" + sparse if len(sparse) < len(packed) else b"p" + packed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(flags, pa.binary())], schema.names)

    table = rows.mapInArrow(run, schema).toArrow().sort_by("doc_id")  # bounded by per_class; 32 KB a row at most
    def unpack(x: bytes) -> np.ndarray:
        return np.frombuffer(x, "<u4", offset=1) if x[:1] == b"s" else np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8, offset=1), count=DIM)).astype(np.uint32)

    return fit([unpack(x) for x in values(table.column("flags"))], table.column("quality").to_numpy())


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a column quality_score (0 to 1), all rows and columns kept. Null or empty text: no indicators, the score of
    the bias alone. A column of that name is replaced; null ids and repeated rows are scored like others; empty table: no rows."""
    base = docs.drop("quality_score")
    schema = T.StructType([*base.schema.fields, T.StructField("quality_score", T.DoubleType())])
    at = base.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, own = np.zeros(DIM, dtype=bool), held.value
        for batch in batches:
            scores = [own.score(features(t or "", seen)) for t in values(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], schema.names)

    return base.mapInArrow(run, schema)
