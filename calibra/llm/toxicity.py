"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are indicators of lower-cased word unigrams, bigrams and skip-grams (one or two words
left out), hashed to 2**BITS coordinates. FTRL-proximal keeps a learning rate for every
coordinate and sets most weights to exactly zero (L1), so the model is a short list of
(coordinate, weight), at most 2**BITS long, that is broadcast for scoring.

The learning rate, L1 penalty and number of epochs have the least log loss of four-fold
cross-validation inside the training rows (README); the held-out fold took no part in it.

Whole texts are scored, long ones slice by slice. A null or empty text has no features and gets the score of the bias.
Repeated rows are scored alike; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .tables import held_out, learned, table, training_rows

BITS = 20
STEPS = ((0,), (0, 1), (0, 2), (0, 3))


def block_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate) of every n-gram occurrence in a block."""
    _, _, doc, h = K.words(data, offs, K.ALNUM, lower=True)
    at, ids = [], []
    for steps in STEPS:
        a, g = K.grams(h, doc, steps)
        at.append(doc[a])
        ids.append((g >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(at), np.concatenate(ids)


def distinct_features(data: np.ndarray, offs: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate), distinct; a long document is taken in slices, so memory is bounded by the coordinates.

    known: flags of the coordinates asked for; the others are left out.
    """
    if len(data) <= 4 * K.BLOCK or len(offs) > 2:
        doc, ids = block_features(data, offs)
        return K.unique_pairs(doc, ids) if known is None else K.unique_pairs(doc[known[ids]], ids[known[ids]])
    seen = np.zeros(1 << BITS, bool)
    for part in K.slices(data, K.ALNUM, STEPS[-1][-1]):
        seen[block_features(part, np.array([0, len(part)]))[1]] = True
    ids = np.flatnonzero(seen if known is None else seen & known).astype(np.int32)
    return np.zeros(len(ids), np.int64), ids


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal (McMahan et al. 2013) for indicator features."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 16.0
    l2: float = 0.01
    epochs: int = 10
    size: int = 1 << BITS

    def fit(self, rows: list[tuple[int, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
        """Bias, coordinates and weights; rows are visited in the order given, again in each epoch."""
        z, n = np.zeros(self.size + 1), np.zeros(self.size + 1)

        def weights(i: np.ndarray) -> np.ndarray:
            zi = z[i]
            l1 = np.where(i == self.size, 0.0, self.l1)  # the bias, last, is not shrunk
            w = -(zi - np.sign(zi) * l1) / ((self.beta + np.sqrt(n[i])) / self.alpha + self.l2)
            return np.where(np.abs(zi) <= l1, 0.0, w)

        for _ in range(self.epochs):
            for label, ids in rows:
                i = np.append(ids, self.size)
                w = weights(i)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
                sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / self.alpha
                z[i] += g - sigma * w
                n[i] += g * g
        every = weights(np.arange(self.size + 1))
        kept = np.flatnonzero(every[:-1])
        return float(every[-1]), kept.astype(np.int32), every[kept].astype(np.float32)


@dataclass
class ToxicityModel:
    bias: float
    ids: np.ndarray
    weights: np.ndarray

    def block_scores(self, data: np.ndarray, offs: np.ndarray, dense: np.ndarray) -> np.ndarray:
        doc, ids = distinct_features(data, offs, dense != 0)
        total = self.bias + np.bincount(doc, dense[ids], minlength=len(offs) - 1)
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", max_train_docs: int = 10000) -> ToxicityModel:
    """Learns from at most max_train_docs labelled documents outside the held-out fold, with at most MAX_IDS n-grams in all.

    Features are made on the executors; the driver gets the bounded list of coordinates.
    Without labelled rows the model scores everything 0.5.
    """
    rows = learned(training_rows(docs, labels, target, max_train_docs), distinct_features)
    return ToxicityModel(*Ftrl().fit(rows))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score in 0..1, predicted (score >= 0.5) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.claim(__name__)
        model = shared.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[model.ids] = model.weights
        for batch in batches:
            parts = [model.block_scores(data, offs, dense) for _, _, data, offs in K.blocks(*K.flatten(batch.column("text")))]
            scores = pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), scores], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
