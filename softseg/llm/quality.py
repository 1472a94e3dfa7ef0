"""Quality classifier: a linear support vector machine on naive Bayes features.

A text becomes the set of its byte bigrams and trigrams and of its word
six-grams, of which the pattern of equal words is kept.  Each indicator is
scaled by the log-count ratio of the classes (naive Bayes), the vector is
brought to unit length, and a linear model with hinge loss is fitted by dual
coordinate descent.  A sigmoid fitted on rows that the model did not see turns
margins into scores.

The model is fitted on a bounded sample of the labelled rows (``SAMPLE_ROWS``,
chosen by a hash of the id); scoring reads every whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .rows import packed, unpacked

#: Labelled rows used for fitting; its features are what the driver collects.
SAMPLE_ROWS = 6_000
BITS = 16
#: Words of an n-gram of which only the pattern of equal words is kept.
GRAM = 6
N_FEATURES = (1 << (BITS + 1)) + math.factorial(GRAM)
#: Bytes looked at in one go; longer texts are read in overlapping pieces.
PIECE = 1 << 20
THRESHOLD = 0.3
ALPHA, COST, EPOCHS, BETA = 1.0, 1.0, 60, 0.75


def features(text: str | None, seen: np.ndarray) -> np.ndarray:
    """Distinct feature numbers of a whole text; ``seen`` is a zeroed scratch array of N_FEATURES flags."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, max(len(raw) - 1, 0), PIECE):
        c = raw[at : at + PIECE + 2].astype(np.uint32)
        two = (c[:-1] << 8) | c[1:]
        seen[two + (1 << BITS)] = True
        if len(c) > 2:
            seen[(((two[:-1] << np.uint32(8)) | c[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = True
    seen[patterns(text or "") + (1 << (BITS + 1))] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def patterns(text: str) -> np.ndarray:
    """For every six words in a row, which of them are equal: the place of each one's first equal, as a mixed-radix number.

    Texts of fewer words have none.
    """
    words = np.fromiter(map(hash, text.split()), np.int64)
    n = max(len(words) - GRAM + 1, 0)
    code = np.zeros(n, np.int64)
    for j in range(1, GRAM):
        first = np.full(n, j)
        for i in range(j - 1, -1, -1):
            first[words[i : i + n] == words[j : j + n]] = i
        code = code * (j + 1) + first
    return code


@dataclass(frozen=True)
class Model:
    """``ratio``: class log-count ratios; ``weight``: of each scaled feature; sigmoid(slope * margin + shift)."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        r = self.ratio[found]
        norm = float(np.sqrt(r @ r)) or 1.0
        return float(r @ self.weight[found]) / norm + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -60, 60))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = {}
    for sign in (1, -1):
        own = [r for r, v in zip(rows, y) if v == sign]
        n = np.bincount(np.concatenate(own) if own else np.zeros(0, int), minlength=N_FEATURES) + ALPHA
        counts[sign] = n / n.sum()
    return np.log(counts[1] / counts[-1]).astype(np.float32)


def dual_coordinate_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, seed: int = 9, epochs: int = EPOCHS) -> tuple[np.ndarray, float, np.ndarray]:
    """Hinge-loss SVM with bias: weights, bias and the dual variables.

    A dual variable lies between 0 and the cost of its class, which is
    inverse to the class's share.  Descent ends when no projected gradient of
    an epoch exceeds 1e-3.
    """
    values = []
    for r in rows:
        v = ratio[r]
        values.append(v / (np.sqrt(v @ v) or 1.0))
    most = {s: COST * len(y) / (2 * max(1, int((y == s).sum()))) for s in (1, -1)}
    w, bias, alpha = np.zeros(N_FEATURES, np.float32), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            x, at, yi, c = values[i], rows[i], y[i], most[y[i]]
            grad = yi * (float(x @ w[at]) + bias) - 1
            if (alpha[i] <= 0 and grad >= 0) or (alpha[i] >= c and grad <= 0):
                continue
            largest = max(largest, abs(grad))
            new = min(max(alpha[i] - grad / (float(x @ x) + 1), 0.0), c)
            step = (new - alpha[i]) * yi
            w[at] += np.float32(step) * x
            bias += step
            alpha[i] = new
        if largest < 1e-3:
            break
    return w, bias, alpha


def sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the margin, with smoothed targets, by Newton's method."""
    n1, n0 = float((y > 0).sum()), float((y <= 0).sum())
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    beta, x = np.array([1.0, 0.0]), np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -60, 60)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - goal) + 1e-3 * beta)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit_model(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit on 0/1 labels; every fourth row only serves the sigmoid.  Without both labels, scores are the share of ones."""
    y = np.where(np.asarray(labels) > 0, 1, -1)
    if len(set(y.tolist())) < 2 or len(y) < 8:
        share = (float((y > 0).sum()) + 1) / (len(y) + 2)
        zero = np.zeros(N_FEATURES, np.float32)
        return Model(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    train = [r for r, h in zip(rows, held) if not h]
    ratio = log_count_ratio(train, y[~held])
    w, bias, _ = dual_coordinate_descent(train, ratio, y[~held])
    mean = float(np.abs(w).sum() / max(1, np.count_nonzero(w)))
    w = np.where(ratio != 0, (1 - BETA) * mean + BETA * w, 0).astype(np.float32)
    test = [(r, v) for r, v, h in zip(rows, y, held) if h or not held.any()]
    model = Model(ratio, w, bias, 1.0, 0.0)
    slope, shift = sigmoid_fit(np.array([model.margin(r) for r, _ in test]), np.array([v for _, v in test]))
    return Model(ratio, w, bias, slope, shift)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on up to ``sample_rows`` labelled rows for which ``usable`` (of the id) holds.

    Labels that are null or contradict each other for one id are not used; an
    id that repeats in ``docs`` counts once for each of its texts.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_label"))
    known = known.filter(F.col("_label").isNotNull() & F.col("_id").isNotNull())
    if usable is not None:
        known = known.filter(usable)
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).filter("_label = _most")
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows).select("_id", "_label")
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    # An id may repeat: what is bounded are the distinct pairs of id and text, by hashes, before any text is fetched.
    sample = texts.join(F.broadcast(chosen), "_id").withColumn("_digest", F.xxhash64("_text"))
    picked = sample.select(F.xxhash64("_id").alias("h"), "_id", "_digest").distinct().orderBy("h", "_id", "_digest").limit(sample_rows)
    sample = sample.join(F.broadcast(picked.drop("h")), ["_id", "_digest"], "left_semi").groupBy("_id", "_label", "_digest").agg(F.first("_text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(N_FEATURES, bool)
        for batch in batches:
            packed = [_packed(features(t.as_py(), seen)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["id", "label", "found"])

    rows = sample.select("_id", "_label", "_text").mapInArrow(run, f"id {sample.schema['_id'].dataType.simpleString()}, label int, found binary")
    got = rows.select(F.xxhash64("id").alias("h"), "id", "label", "found").toPandas().sort_values(["h", "id", "found"])
    return fit_model([_unpacked(f) for f in got["found"]], got["label"].to_numpy())


def _packed(found: np.ndarray) -> bytes:
    """Feature numbers, or one bit for each feature where that is less; their lengths tell which."""
    if 4 * len(found) < N_FEATURES // 8:
        return found.astype("<i4").tobytes()
    bits = np.zeros(N_FEATURES, bool)
    bits[found] = True
    return np.packbits(bits).tobytes() + b"\0" * (3 - (len(bits) // 8 + 2) % 4)


def _unpacked(raw: bytes) -> np.ndarray:
    if len(raw) % 4 == 0:
        return np.frombuffer(raw, "<i4")
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))[:N_FEATURES]).astype("<i4")


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """Rows whose last column is a text, with the score in its place."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    fields = rows.schema.fields[:-1]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(N_FEATURES, bool)
        for batch in batches:
            scores = [held.value.score(features(t.as_py(), seen)) for t in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores, pa.float64())], names=[*names, "score"])

    return rows.mapInArrow(run, StructType([*fields, StructField("score", DoubleType())]))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` (0 to 1) instead of the text; null texts score as empty ones.

    An input column named ``score`` is replaced.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "score")]
    return _scored(docs.select(*rest, F.col(f"`{text_col}`").cast("string").alias(text_col)), model)


def keep_good(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``, all columns, in one pass over the texts.

    Null texts are judged as empty ones, rows that repeat are judged alike; an
    empty table or labels without rows reject nothing that the threshold spares.
    """
    model = train(docs, labels, usable, id_col, text_col)
    rows = packed(docs, text=F.col(f"`{text_col}`").cast("string"))
    return unpacked(_scored(rows, model).filter(F.col("score") >= threshold))
