"""Quality classifier: naive Bayes support vectors (Wang and Manning 2012).

N-gram indicators are scaled by class log-count ratios; a linear hinge-loss model over them is
fitted by dual coordinate descent (Hsieh et al. 2008), and its margin is turned into a
probability by a sigmoid fitted on rows the support vectors have not seen.

The n-grams are word unigrams and bigrams (lower-cased) and one- to three-grams of word shapes.
A shape writes capitals as A, other letters as a, digits as 0, keeps punctuation, and squeezes
runs, so "THND!!" has the shape "A!". Repetition is part of the shape alphabet: a word that
repeats the word before it, or a trigram seen earlier in the document, adds a mark of its own,
with counts in powers of two.

Whole texts are scored. A null or empty text has no n-grams and gets the sigmoid of the bias.
Columns other than doc_id and text are ignored; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .tables import held_out, learned, numbered, table, training_rows

BITS = 20
_byte = np.arange(256)
_SHAPE = np.where((_byte >= 65) & (_byte <= 90), 65, np.where(((_byte >= 97) & (_byte <= 122)) | (_byte >= 128), 97, np.where((_byte >= 48) & (_byte <= 57), 48, _byte))).astype(np.uint8)


def shapes(data: np.ndarray) -> np.ndarray:
    """The shape letter of every byte; Latin-1 capitals count as capitals."""
    out = _SHAPE[data]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E))
    out[upper] = out[upper + 1] = 65
    return out


def _grams(data: np.ndarray, offs: np.ndarray) -> tuple[list, list, tuple]:
    """Documents and hashes of the n-grams of a block, and its words: documents, hashes and documents and hashes of its trigrams."""
    starts, ends, doc, h = K.words(data, offs, K.NONSPACE, lower=True)
    shape = shapes(data)
    keep = K.NONSPACE[data]
    first = np.zeros(len(data), bool)
    first[starts] = True
    keep[1:] &= first[1:] | (shape[1:] != shape[:-1])
    place = np.concatenate([[0], np.cumsum(keep, dtype=np.int32)]) if len(data) < 1 << 31 else np.concatenate([[0], np.cumsum(keep)])
    squeezed = K.span_hashes(shape[keep], place[starts].astype(np.int64), place[ends].astype(np.int64))
    at, grams = [doc], [h]
    a, g = K.grams(h, doc, (0, 1))
    at.append(doc[a])
    grams.append(K.mix(g + np.uint64(1)))
    for steps in ((0,), (0, 1), (0, 1, 2)):
        a, g = K.grams(squeezed, doc, steps)
        at.append(doc[a])
        grams.append(K.mix(g + np.uint64(2)))
    a, g = K.grams(h, doc, (0, 1, 2))
    return at, grams, (doc, h, doc[a], g)


def _marks(again: np.ndarray, repeats: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the marks of repetition, from counts by document."""
    docs = np.flatnonzero(size > 0)
    grams = []
    for kind, count in ((3, again), (4, repeats), (5, 16 * repeats // np.maximum(size, 1))):
        level = np.ceil(np.log2(count + 1)).astype(np.uint64)
        grams.append(K.mix(K.mix(level[docs] + np.uint64(1)) + np.uint64(kind)))
    return np.tile(docs, 3), np.concatenate(grams)


def _coordinates(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - BITS)).astype(np.int32)


def block_features(data: np.ndarray, offs: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate), distinct, of all n-grams and marks of a block; a long document is taken in slices.

    known: flags of the coordinates asked for; the others are left out.
    """
    n = len(offs) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    if len(data) > 4 * K.BLOCK and n == 1:
        doc, ids = _long_features(data)
        return (doc, ids) if known is None else (doc[known[ids]], ids[known[ids]])
    at, grams, (doc, h, tri_doc, tri) = _grams(data, offs)
    again = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
    repeats = np.bincount(tri_doc, minlength=n) - np.bincount(K.unique_pairs(tri_doc, tri)[0], minlength=n)
    docs, marks = _marks(np.bincount(doc[again], minlength=n), repeats, np.bincount(doc, minlength=n))
    doc, ids = np.concatenate([*at, docs]), _coordinates(np.concatenate([*grams, marks]))
    return K.unique_pairs(doc, ids) if known is None else K.unique_pairs(doc[known[ids]], ids[known[ids]])


def _long_features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one document: memory is bounded by its coordinates and distinct trigrams."""
    held, trigrams, fresh = np.zeros(1 << BITS, bool), np.zeros(0, np.uint64), []
    again = total = size = 0
    for k, part in enumerate(K.slices(data, K.NONSPACE, 2)):
        _, grams, (_, h, _, tri) = _grams(part, np.array([0, len(part)]))
        held[_coordinates(np.concatenate(grams))] = True
        seen = 2 if k else 0  # words of the slice before
        size += len(h) - seen
        total += len(tri)
        again += int((h[1:] == h[:-1])[max(seen - 1, 0) :].sum())
        fresh.append(tri)
        if sum(map(len, fresh)) > K.PIECE:
            trigrams, fresh = np.unique(np.concatenate([trigrams, *fresh])), []
    trigrams = np.unique(np.concatenate([trigrams, *fresh]))
    _, marks = _marks(np.array([again]), np.array([total - len(trigrams)]), np.array([size]))
    held[_coordinates(marks)] = True
    ids = np.flatnonzero(held).astype(np.int32)
    return np.zeros(len(ids), np.int64), ids


def log_count_ratios(rows: list[tuple[int, np.ndarray]], size: int, smooth: float, least: int) -> np.ndarray:
    """log of (class 1 share / class 0 share) of each coordinate; 0 where fewer than `least` documents have it."""
    count = np.zeros((2, size))
    for label, ids in rows:
        count[label, ids] += 1
    seen = count.sum(axis=0) >= least
    p = count + smooth
    ratio = np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum())
    return np.where(seen, ratio, 0.0)


def dual_coordinate_descent(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, size: int, epochs: int, seed: int) -> np.ndarray:
    """Weights of the L1-loss linear support vector machine; the last coordinate is the bias."""
    w, alpha, rng = np.zeros(size), np.zeros(len(x)), np.random.default_rng(seed)
    norm = np.array([v @ v for _, v in x])
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            if norm[i] == 0:
                continue
            ids, v = x[i]
            slope = y[i] * (w[ids] @ v) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w[ids] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
    return w


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid with the least log loss, by Newton steps on Platt's smoothed targets."""
    pos, neg = (label == 1).sum(), (label == 0).sum()
    if not len(label):
        return 1.0, 0.0
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        d = np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(d * margin * margin).sum() + 1e-3, (d * margin).sum()], [(d * margin).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(max(a, 1e-3)), float(b)


@dataclass
class QualityModel:
    """Coordinates, their ratios and weights (at most 2**BITS each), bias and sigmoid."""

    ids: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        r, w = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
        r[self.ids], w[self.ids] = self.ratios, self.weights
        return r, w

    def block_scores(self, data: np.ndarray, offs: np.ndarray, dense: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        r, w = dense
        n = len(offs) - 1
        doc, ids = block_features(data, offs, r != 0)
        x = r[ids].astype(np.float64)
        norm = np.sqrt(np.bincount(doc, x * x, minlength=n))
        margin = np.bincount(doc, x * w[ids], minlength=n) / np.maximum(norm, 1e-12) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -35, 35)))


def fit_rows(rows: list[tuple[int, np.ndarray]], cost: float = 1.0, epochs: int = 15, smooth: float = 1.0, least: int = 3) -> QualityModel:
    size = 1 << BITS
    cut = len(rows) * 4 // 5
    train, rest = rows[:cut], rows[cut:]
    ratio = log_count_ratios(train, size, smooth, least) if train else np.zeros(size)

    def scaled(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = ids[ratio[ids] != 0]
        v = ratio[ids]
        v = v / max(np.sqrt(v @ v), 1e-12)
        return np.append(ids, size), np.append(v, 1.0)

    y = np.array([label for label, _ in train])
    share = np.bincount(y, minlength=2) / max(len(y), 1) if len(y) else np.ones(2)
    weigh = cost * 0.5 / np.maximum(share, 1e-3)  # both classes weigh the same
    x = [scaled(ids) for _, ids in train]
    w = dual_coordinate_descent(x, np.where(y == 1, 1.0, -1.0), weigh[y] if len(y) else np.zeros(0), size + 1, epochs, 7)
    margin = np.array([w[i] @ v for i, v in (scaled(ids) for _, ids in rest)])
    slope, offset = platt(margin, np.array([label for label, _ in rest]))
    kept = np.flatnonzero(ratio)
    return QualityModel(kept.astype(np.int32), ratio[kept].astype(np.float32), w[kept].astype(np.float32), float(w[size]), slope, offset)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", max_train_docs: int = 8000) -> QualityModel:
    """Learns from at most max_train_docs labelled documents outside the held-out fold, with at most MAX_IDS n-grams in all.

    N-grams are made on the executors; the driver gets the bounded list of coordinates.
    Without labelled rows the model scores everything 0.5.
    """
    return fit_rows(learned(training_rows(docs, labels, target, max_train_docs), block_features))


def _with_scores(docs: DataFrame, model: QualityModel, schema, finish) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.claim(__name__)
        model = shared.value
        dense = model.dense()
        for batch in batches:
            parts = [model.block_scores(data, offs, dense) for _, _, data, offs in K.blocks(*K.flatten(batch.column("text")))]
            yield finish(batch, np.concatenate([np.zeros(0), *parts]))
        K.trim()

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score in 0..1, predicted (score >= threshold) of every row."""

    def finish(batch: pa.RecordBatch, scores: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = _with_scores(rows, model, f"doc_id {kind}, held_out boolean, score double", finish)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The rows, with all their columns, that the classifier does not reject."""
    rows = numbered(docs)
    return _with_scores(rows, model, rows.schema, lambda batch, scores: K.passthrough(batch, scores >= threshold)).toDF(*docs.columns)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
