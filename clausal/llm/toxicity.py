"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between of a text,
lower-cased and hashed to 2**BITS coordinates. Training sees one document after the other:
each coordinate has a rate of its own that falls with the gradients it has seen, and the
L1 term keeps most weights at exactly zero. The weights left are few; they are bounded
by 2**BITS, are sent to the driver and broadcast for scoring.

The model is fitted on a sample of at most `train_rows` labelled rows with at most
`train_features` features in all, drawn by a hash of the id; scoring covers every row.

Defined results: a null or empty text has no features and scores by the bias; labels other
than 0 and 1 are ignored and of several labels of a document the highest counts; without
any label all scores are 0; repeated rows score alike; a very long text is scored whole, and
learned from if it fits in `train_features`; an empty table gives no rows; other columns
pass through unless an output column has their name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausal.llm.common import slices

_TOKENS = re.compile(r"[^\W_]+")

BITS = 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - BITS)


class Features:
    """Hashed n-grams of texts; remembers the hashes of words."""

    def __init__(self, cache: int = 100_000):
        self.cache, self.known = cache, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """The coordinates of a text, with repeats: of the words, then of pairs, then of skip-grams."""
        words = _TOKENS.findall((text or "").lower())
        known = self.known
        if len(known) > self.cache:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        pair = (h[:-1] * _M1 + h[1:]) * _M2
        skip = (h[:-2] * _M2 + h[2:]) * _M1
        return (np.concatenate([h * _M1, pair, skip]) >> _SHIFT).astype(np.int32)


def fit(examples: list[tuple[np.ndarray, int]], alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over (distinct coordinates, label) in the given order; coordinate 2**BITS is the bias.

    Returns the coordinates with a weight other than zero, and the weights.
    """
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weights(at: np.ndarray) -> np.ndarray:
        za = z[at]
        shrink = np.where(at == bias, 0.0, l1)
        return np.where(np.abs(za) <= shrink, 0.0, -(za - np.sign(za) * shrink) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for x, y in examples:
            at = np.append(x, bias)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            was = n[at]
            z[at] += g - (np.sqrt(was + g * g) - np.sqrt(was)) / alpha * w
            n[at] = was + g * g
    every = np.arange(bias + 1)
    w = weights(every)
    return every[w != 0], w[w != 0]


def trained(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, train_features: int = 60_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights of the model for (doc_id, toxic) labels."""
    order = F.xxhash64("doc_id")
    chosen = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(order, "doc_id").limit(train_rows)  # at most train_rows ids: bounded, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(order.alias("at"), "doc_id", "toxic", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for part in slices(batches):
            found = [np.unique(features(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"at": part.column("at"), "doc_id": part.column("doc_id"), "toxic": part.column("toxic"), "features": pa.array(found, pa.list_(pa.int32()))})

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, left = [], train_features
        for batch in batches:
            values = batch.column("features")
            for i, y in enumerate(batch.column("toxic").to_pylist()):
                x = values[i].values.to_numpy()
                left -= len(x)
                if left < 0:
                    break
                examples.append((x, y))
        if examples:
            at, w = fit(examples)
            yield pa.RecordBatch.from_pydict({"at": pa.array(at.astype(np.int32)), "weight": pa.array(w)})

    features = rows.mapInArrow(extract, "at long, doc_id long, toxic int, features array<int>")
    model = features.repartition(1).sortWithinPartitions("at", "doc_id", "features").mapInArrow(train, "at int, weight double").toPandas()
    return model["at"].to_numpy(), model["weight"].to_numpy()


def score(docs: DataFrame, at: np.ndarray, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """All columns of docs with score (0 to 1) and predicted (1 from the threshold on)."""
    model = docs.sparkSession.sparkContext.broadcast((at, weights))
    columns = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = model.value
        dense = np.zeros((1 << BITS) + 1)
        dense[at] = w
        bias, features = dense[-1], Features()
        for part in slices(batches):
            scores = []
            for text in part.column("text").to_pylist():
                x = features(text)
                x = np.unique(x[dense[x] != 0])
                scores.append(1.0 / (1.0 + np.exp(-np.clip(dense[x].sum() + bias, -35, 35))) if len(at) else 0.0)
            out = {f.name: part.column(f.name) for f in columns}
            yield pa.RecordBatch.from_pydict(out | {"score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= threshold) for s in scores], pa.int32())})

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    return docs.select(*[f.name for f in columns]).mapInArrow(run, f"{ddl}, score double, predicted int")


def held_out(column: str = "doc_id") -> F.Column:
    """Whether a document's labels are never learned from: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """Fits on the labels that aren't held out and scores every row."""
    return score(docs, *trained(docs, labels.filter(~held_out()), **bounds))
