"""Quality rules: gradient-boosted trees over document statistics.

Every document gets exact counts (words, word characters, symbols, repeated lines, words in
repeated three-word windows) and ratios made from them. A small gradient-boosted ensemble over
the ratios is fitted with monotonic constraints (more symbols, repetition or capitals never
raises the score), then flattened into numpy node arrays, so that scoring a block is a handful
of array lookups for each tree level.

Whole texts are used. A null or empty text has no words, fails the base rules and is not kept.
Columns other than doc_id and text are ignored; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernels as K
from .quality import shapes
from .tables import table, training_rows

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios and the sign the score must have in each: -1 never rises, 0 free.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_word_share": -1,
    "upper_share": -1, "digit_share": 0, "bang_share": -1, "bar_share": -1, "same_as_previous": -1,
    "distinct_share": 0, "stop_share": 0, "words_per_line": 0, "marked_word_share": -1,
}
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_ALPHA = K.ALNUM & ~_DIGIT


def statistics(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (int64) and FEATURES (float64) of each document of a block, in columns."""
    n = len(offs) - 1
    starts, ends, doc, h = K.words(data, offs, K.NONSPACE)

    def total(flag: np.ndarray) -> np.ndarray:
        if n == 1:
            return np.array([np.count_nonzero(flag)])
        places = np.concatenate([[0], np.cumsum(flag)])
        return places[offs[1:]] - places[offs[:-1]]

    def per_doc(docs: np.ndarray) -> np.ndarray:
        return np.bincount(docs, minlength=n)

    n_words = per_doc(doc)
    inside = K.NONSPACE[data]
    word_chars = total(inside & ((data & 0xC0) != 0x80))
    n_symbols = total(_SYMBOL[data])

    line_starts, line_ends, line_doc = K.runs(data != 0x0A, offs)
    line_hash = K.span_hashes(data, line_starts, line_ends)
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    lines = line_doc[filled]
    n_dup = per_doc(lines) - per_doc(K.unique_pairs(lines, line_hash[filled])[0])

    at, g = K.grams(h, doc, (0, 1, 2))
    marked = np.zeros(len(h), bool)
    if len(at):
        order = np.lexsort((g, doc[at])) if n > 1 else np.argsort(g)
        g, d = g[order], doc[at[order]]
        same = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] = same
        twice[:-1] |= same
        twice = at[order[twice]]
        del order, g, d
        for k in range(3):
            marked[twice + k] = True
    n_repeat = per_doc(doc[marked])

    counts = np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat]).astype(np.int64)
    shape = shapes(data) if len(data) else data
    letters = np.maximum(total(_ALPHA[data]), 1)
    words = np.maximum(n_words, 1)
    chars = np.maximum(word_chars, 1)
    same = doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])] if len(h) else doc
    last = data[ends - 1] if len(ends) else data
    ratios = np.stack([
        np.log1p(n_words), word_chars / words, n_symbols / words, n_dup / np.maximum(per_doc(lines), 1), n_repeat / words,
        total(shape == 65) / letters, total(_DIGIT[data]) / chars, total(data == 0x21) / words, total(data == 0x7C) / words, per_doc(same) / words,
        per_doc(K.unique_pairs(doc, h)[0]) / words, total(data == 0x2E) / words, n_words / np.maximum(per_doc(lines), 1), per_doc(doc[_SYMBOL[last]]) / words,
    ])
    return counts, ratios


def base_failed(counts: np.ndarray) -> np.ndarray:
    n_words, n_repeat = counts[0], counts[4]
    return (n_words < 50) | (100 * n_repeat > 50 * n_words)


@dataclass
class Trees:
    """An ensemble as flat node arrays: a leaf points at itself, so `depth` steps reach every leaf."""

    bias: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        """x: features by row. Goes left where the feature is <= the threshold."""
        node = np.broadcast_to(self.roots, (x.shape[0], len(self.roots))).copy()
        row = np.arange(x.shape[0])[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-np.clip(self.bias + self.value[node].sum(axis=1), -35, 35)))


def boost(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, l2: float = 1.0) -> Trees:
    """Logistic boosting on binned features with second-order gains.

    A split on a feature of sign s is taken only if the leaf values on its two sides are ordered
    by s; the midpoint then bounds everything below (left and right), which keeps every tree,
    and so their sum, monotonic in that feature.
    """
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], axis=1) if n else np.zeros((0, m), int)
    rate_pos = min(max(y.mean() if n else 0.5, 1e-6), 1 - 1e-6)
    bias = float(np.log(rate_pos / (1 - rate_pos))) if n and 0 < y.mean() < 1 else 0.0
    out: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots, total = [], np.full(n, bias)

    def node(lo: float, hi: float, g: float, h: float) -> int:
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", len(out["left"])), ("right", len(out["left"]))):
            out[k].append(v)
        out["value"].append(rate * float(np.clip(-g / (h + l2), lo, hi)))
        return len(out["left"]) - 1

    def grow(rows: np.ndarray, level: int, lo: float, hi: float) -> int:
        g, h = grad[rows], hess[rows]
        here = node(lo, hi, g.sum(), h.sum())
        if level == depth or len(rows) < 2 * least:
            return here
        best, choice = 1e-6, None
        for j in range(m):
            k = len(edges[j])
            if not k:
                continue
            c = code[rows, j]
            gl, hl, nl = (np.cumsum(np.bincount(c, w, minlength=k + 1))[:-1] for w in (g, h, np.ones(len(c))))
            gr, hr, nr = g.sum() - gl, h.sum() - hl, len(rows) - nl
            wl, wr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
            score = lambda w, a, b: -(a * w + 0.5 * (b + l2) * w * w)
            w0 = float(np.clip(-g.sum() / (h.sum() + l2), lo, hi))
            gain = score(wl, gl, hl) + score(wr, gr, hr) - score(w0, g.sum(), h.sum())
            gain[(nl < least) | (nr < least) | (signs[j] * (wr - wl) < 0)] = -1
            at = int(np.argmax(gain))
            if gain[at] > best:
                best, choice = gain[at], (j, at, wl[at], wr[at])
        if choice is None:
            return here
        j, at, wl, wr = choice
        mid, left = (wl + wr) / 2, code[rows, j] <= at
        bounds = {1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid)), 0: ((lo, hi), (lo, hi))}[int(signs[j])]
        out["feature"][here], out["threshold"][here], out["value"][here] = j, edges[j][at], 0.0
        out["left"][here] = grow(rows[left], level + 1, *bounds[0])
        out["right"][here] = grow(rows[~left], level + 1, *bounds[1])
        return here

    def flat() -> Trees:
        kinds = {"feature": np.int32, "threshold": float, "left": np.int32, "right": np.int32, "value": float}
        return Trees(bias, depth, np.array(roots, np.int32), *(np.array(out[k], kinds[k]) for k in out))

    for _ in range(trees if n and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        first = len(out["value"])
        roots.append(grow(np.arange(n), 0, -np.inf, np.inf))
        place = np.full(n, first)
        feature, threshold, left, right, value = (np.array(out[k]) for k in out)
        for _ in range(depth):
            place = np.where(x[np.arange(n), feature[place]] <= threshold[place], left[place], right[place])
        total = total + value[place]
    return flat()


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", max_train_docs: int = 20000) -> Trees:
    """Learns from at most max_train_docs labelled documents outside the held-out fold.

    The driver gets a bounded table of statistics, no texts. Without labels of both kinds the
    verdict is that of the base rules.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.claim("rules")
        for batch in batches:
            parts = [statistics(data, offs)[1] for _, _, data, offs in K.blocks(*K.flatten(batch.column("text")))]
            x = np.concatenate([np.zeros((len(FEATURES), 0)), *parts], axis=1)
            rows = [r.tobytes() for r in np.ascontiguousarray(x.T)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.binary())], ["label", "x"])

    got = training_rows(docs, labels, target, max_train_docs).mapInArrow(run, "label int, x binary").toArrow()
    pairs = sorted(zip(got["x"].to_pylist(), got["label"].to_pylist(), strict=True))
    x = np.frombuffer(b"".join(b for b, _ in pairs), np.float64).reshape(len(pairs), len(FEATURES))
    return boost(x, np.array([y for _, y in pairs], float), np.array(list(FEATURES.values())))


def judge(docs: DataFrame, model: Trees, threshold: float = 0.3) -> DataFrame:
    """doc_id, the counts, base_failed, score and kept (base rules passed and score >= threshold) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.claim("rules")
        model = shared.value
        for batch in batches:
            counts, scores = [np.zeros((len(COUNTS), 0), np.int64)], [np.zeros(0)]
            for _, _, data, offs in K.blocks(*K.flatten(batch.column("text"))):
                c, x = statistics(data, offs)
                counts.append(c)
                scores.append(model.probability(x.T))
            c, p = np.concatenate(counts, axis=1), np.concatenate(scores)
            failed = base_failed(c)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(v) for v in c), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))],
                ["doc_id", *COUNTS, "base_failed", "score", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, score double, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))


def op2_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2_rules that SQL can express: counts and base rules."""
    return op2_rules(spark, sf_dir).select("doc_id", *COUNTS, "base_failed")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
       CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
       len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)
"""
