"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

Features of a text are hashed one- and two-word sequences of its words and of
the words' shapes (letters, capitals, digits and signs, position by position),
and one for any word that follows itself; each counts by its share of the text,
shrunk for texts of a few words.  A document's score is the sigmoid of one
sparse dot product with a weight table that is broadcast; its size is fixed by
``BITS``.

Training reads at most ``MOST_LABELLED`` labelled documents, chosen by a hash of
their ids among those of the learning folds; one task streams through them.

Cases: null and empty texts have no features and get the bias alone; texts of
any length count whole; repeated rows get equal scores; label rows without a
document, with null or other labels than 0 and 1 teach nothing; without labels
all scores are 0.5; a null doc_id is neither held out nor learned from; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .text import CHUNK_BYTES, Words, mix

#: Weight table: 2 ** BITS numbers.
BITS = 18
#: Labelled documents that training reads at most, and how often.
MOST_LABELLED, EPOCHS = 8_000, 3
#: Updates: step size, smoothing, L1 and L2; features are scaled by SCALE.
ALPHA, BETA, L1, L2, SCALE = 0.3, 1.0, 0.002, 1e-4, 12.0
#: Added to a text's number of features.
SHRINK = 16
FOLDS, HELD_OUT = 3, 1

#: Bytes by kind: lower case and anything beyond ASCII, capitals, digits; signs stay.
_SHAPES = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts in a row, and where each text's begin (one more than texts)."""
    found, owner = [], []
    for salt, words in ((1, Words(texts)), (3, Words([t.translate(_SHAPES) for t in texts]))):
        h = words.hashes * np.uint64(2 * salt + 1)
        doc = np.repeat(np.arange(len(texts)), np.diff(words.first))
        found.append(mix(h) >> np.uint64(64 - bits))
        owner.append(doc)
        pair = doc[1:] == doc[:-1]
        same = pair & (h[1:] == h[:-1])
        found.append(np.full(int(same.sum()) * (salt == 1), salt, np.uint64))
        owner.append(doc[1:][same] if salt == 1 else doc[:0])
        found.append(mix((h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:])[pair]) >> np.uint64(64 - bits))
        owner.append(doc[1:][pair])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(texts) + 1))


class Ftrl:
    """Follow the regularised leader, per coordinate, for the logistic loss."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.prior = self.bias = 0.0
        self.bias_z = self.bias_n = 0.0

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x + self.prior + self.bias, -35, 35)))
        g = (p - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        b = p - label
        self.bias_z += b - (np.sqrt(self.bias_n + b * b) - np.sqrt(self.bias_n)) / ALPHA * self.bias
        self.bias_n += b * b
        self.bias = -self.bias_z / ((BETA + np.sqrt(self.bias_n)) / ALPHA + L2)


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    examples = []
    for batch in batches:
        labels = batch.column("label").to_pylist()
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        for i, t in enumerate(texts):
            f, _ = features([t])
            at, count = np.unique(f, return_counts=True)
            examples.append((at.astype(np.int32), (SCALE * count / (SHRINK + len(f))).astype(np.float32), labels[i]))
    model = Ftrl()
    ones = sum(e[2] for e in examples)
    model.prior = float(np.log((ones + 1) / (len(examples) - ones + 1)))
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(examples)):
            model.learn(*examples[i])
    yield pa.RecordBatch.from_pydict({"weights": [model.weights().astype(np.float32).tobytes()], "bias": [float(model.prior + model.bias)]})


def fold(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def train(documents: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = MOST_LABELLED) -> tuple[np.ndarray, float]:
    """Weights and bias, learned from the labels outside the held-out fold."""
    y = labels.select(F.col("doc_id").alias("labelled_id"), F.col(label_col).cast("int").alias("label"))
    y = y.filter(F.col("label").isin(0, 1) & (fold("labelled_id") != HELD_OUT))
    y = y.orderBy(F.xxhash64("labelled_id"), "label").limit(most)
    d = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = d.join(F.broadcast(y), F.col("doc_id") == F.col("labelled_id")).select(F.xxhash64("labelled_id").alias("h"), "label", "text")
    got = rows.repartition(1).sortWithinPartitions("h", "label", "text").select("label", "text").mapInArrow(_learned, "weights binary, bias double").first()
    if got is None:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(got["weights"], np.float32), got["bias"]


def scorer(spark, weights: np.ndarray, bias: float):
    """A function of a text column: the probability of label 1."""
    held = spark.sparkContext.broadcast((weights, bias))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w, b = held.value
        out = np.empty(len(texts))
        rows, size, begin = [], 0, 0
        for i, t in enumerate(texts):
            rows.append(bytes(t) if t is not None else b"")
            size += len(rows[-1])
            if size >= CHUNK_BYTES or i == len(texts) - 1:
                at, first = features(rows)
                total = np.concatenate(([0.0], np.cumsum(w[at], dtype=np.float64)))
                count = np.diff(first)
                dot = (total[first[1:]] - total[first[:-1]]) * SCALE / (SHRINK + count)
                out[begin : i + 1] = 1 / (1 + np.exp(-np.clip(dot + b, -35, 35)))
                rows, size, begin = [], 0, i + 1
        return pd.Series(out)

    return lambda column: score(F.coalesce(F.col(column), F.lit("")).cast("binary"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents scored 0.5 or more, with their own columns."""
    score = scorer(documents.sparkSession, *train(documents, labels))
    return documents.filter(score("text") >= 0.5)


def op5_quality_classifier(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    score = scorer(documents.sparkSession, *train(documents, labels))
    scored = documents.select("doc_id", "text").withColumn("score", score("text"))
    held_out = F.coalesce(fold() == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
