"""Quality classifier: hashed word n-grams, logistic regression trained with FTRL-proximal.

Tokens are runs of letters (any byte of 128 or more counts as a letter), runs of digits and
runs of one other visible byte class.  Features are hashed token uni- and bigrams, uni- and
bigrams of token shapes (upper, title, lower, digits, the mark itself), and a feature for a
token that repeats its predecessor.  A text is the mean of its features; its score is the
sigmoid of a sparse dot product of that mean with the weights.

Training reads at most ``MAX_TRAIN_ROWS`` labelled rows (those with the smallest hash of
their id) and runs per-coordinate follow-the-regularised-leader steps in numpy.  The
weights are ``2**BITS`` floats, which is the size of what is broadcast.

Defined cases: null and empty texts have no features and score the bias alone.  Null labels
are ignored; a repeated label of one id counts once, the smallest value.  Without labelled
rows every score is 0.5.  Rows are scored one by one, so repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracefold.llm.words import U, join_hashes, mix, pieces, prefix_hashes, run_hashes, runs

BITS = 18
MAX_TRAIN_ROWS = 6000
EPOCHS = 4
SCALE = 40.0

_KIND = np.full(256, 4, np.uint8)  # other visible bytes
_KIND[[0, *range(9, 14), 32]] = 0
_KIND[48:58] = 2
for _a, _b in ((65, 91), (97, 123), (128, 256)):
    _KIND[_a:_b] = 1
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature indices of all texts, and where each text's features start."""
    starts, ends = runs(data, offsets, _KIND[data])
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), first * 0
    token = run_hashes(prefix_hashes(data), starts, ends)
    kind = _KIND[data[starts]]
    uppers = np.r_[0, np.cumsum(_UPPER[data])]
    upper = uppers[ends] - uppers[starts]
    shape = np.where(
        kind == 1,
        np.where(upper == 0, 1, np.where((upper == 1) & _UPPER[data[starts]] & (ends - starts > 1), 2, 3)),
        np.where(kind == 2, 4, 5),
    ).astype(U)
    shape = np.where(shape == 5, mix(data[starts].astype(U) + U(1000) * np.minimum(ends - starts, 3).astype(U)), shape)
    inner = np.ones(len(token), bool)
    inner[first[:-1][first[:-1] < len(token)]] = False
    pair = np.r_[U(0), join_hashes(token, 2)] if len(token) > 1 else np.zeros(1, U)
    shape_pair = np.r_[U(0), join_hashes(shape, 2)] if len(token) > 1 else np.zeros(1, U)
    again = np.r_[False, token[1:] == token[:-1]]
    alone = np.full(len(token), 7, U)
    columns = np.stack([
        mix(token + U(1)),
        mix(shape + U(2) * U(1 << 40)),
        mix(np.where(inner, pair, alone) + U(3)),
        mix(np.where(inner, shape_pair, alone) + U(4) * U(1 << 40)),
        mix(np.where(inner & again, U(5), U(6)) + U(1 << 50)),
    ], axis=1)
    return (columns.reshape(-1) >> U(64 - BITS)).astype(np.int64), first * columns.shape[1]


def _means(index: np.ndarray, begin: np.ndarray, weights: np.ndarray) -> np.ndarray:
    sums = np.r_[0.0, np.cumsum(weights[index], dtype=np.float64)]
    count = np.diff(begin)
    return np.where(count > 0, (sums[begin[1:]] - sums[begin[:-1]]) / np.maximum(count, 1), 0.0)


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], alpha=0.3, beta=1.0, l1=1e-4, l2=1e-4,
          epochs=EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias from (indices, values, label) rows, in the given order."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(epochs):
        for index, value, label in rows:
            at = np.r_[index, size]
            x = np.r_[value, 1.0]
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (sigmoid(w @ x) - label) * x
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w[:-1].astype(np.float32), float(w[-1])


def _training_rows(batches):
    for batch in batches:
        for a, _, data, offsets in pieces(batch.column(1)):
            index, begin = features(data, offsets)
            for d, (p, q) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
                found, count = np.unique(index[p:q], return_counts=True)
                value = (count / max(q - p, 1)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a + d, 1), pa.array([found.astype(np.int32).tobytes()]),
                    pa.array([value.tobytes()]), batch.column(2).slice(a + d, 1),
                ], names=["doc_id", "index", "value", "label"])


def training_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents, chosen by id hash."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & usable)
        .groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(chosen), "doc_id"  # at most ``rows`` narrow rows
    )


def fit(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int = MAX_TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Train on labelled rows for which ``usable`` (an expression on doc_id) holds."""
    sample = training_sample(docs, labels, "quality", usable, max_rows)
    rows = sample.mapInArrow(_training_rows, "doc_id long, index binary, value binary, label int").collect()
    rows.sort(key=lambda r: (int(mix(np.array([r.doc_id], np.int64).view(U))[0]), bytes(r["index"])))
    return train([
        (np.frombuffer(r["index"], np.int32), np.frombuffer(r["value"], np.float32) * SCALE, r["label"]) for r in rows
    ])


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs`` with ``score`` and ``predicted`` (replaced where they exist)."""
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    at = kept.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(*[f"`{c}`" for c in kept])

    def run(batches: Iterator[pa.RecordBatch]):
        weights, bias = shared.value
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(at)):
                index, begin = features(data, offsets)
                scores = sigmoid(_means(index, begin, weights) * SCALE + bias)
                # Piece by piece, so that the texts do not stand a second time whole on their way back.
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                    names=[*kept, "score", "predicted"],
                )

    schema = base.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema
    return base.mapInArrow(run, schema)
