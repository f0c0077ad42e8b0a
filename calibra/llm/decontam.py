r"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. A benchmark item's windows are its
runs of WINDOW consecutive words, or the whole item if it is shorter. A text's fingerprints are
the least GRAM-gram hash of every WINDOW - GRAM + 1 consecutive GRAM-grams (Schleimer et al.
2003), so a document and an item that share WINDOW words share a fingerprint. Documents' and
items' fingerprints are joined, and each hit is extended to the windows around it, which are
looked up whole. Items shorter than WINDOW are looked up at their own length (winnowing with
a window of one).

A benchmark of at most `max_words` words is one broadcast index. Beyond that nothing that grows
with the benchmark is broadcast: a filter of BLOOM_BITS bits tells which of a document's
fingerprints may be in the benchmark, and the windows around those, few, are joined with the
table of the benchmark's windows by a shuffle. Both ways give the same rows.

A null text has no words and an item of null text no windows; a null item_id is left out of the
item list, its words still count as hit. Repeated documents are judged each for itself and
repeated items count once. Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .tables import numbered, saved, table

WINDOW = 13
GRAM = 6
MAX_WORDS = 2_000_000
BLOOM_BITS = 27


def winnow(grams: np.ndarray, at: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    """Places (indices into at) of the least hash of every `span` consecutive grams of one document.

    at: the word positions of the grams; doc: the document of every word.
    """
    n = len(at) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    first = np.flatnonzero((at[span - 1 :] - at[:n] == span - 1) & (doc[at[:n]] == doc[at[span - 1 :]]))
    best = first.copy()
    for k in range(1, span):
        better = grams[first + k] < grams[best]
        best[better] = first[better] + k
    keep = np.zeros(len(at), bool)
    keep[best] = True
    return np.flatnonzero(keep)


def _among(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x in sorted_values, -1 where absent."""
    if not len(sorted_values):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[at] == x, at, -1)


@dataclass
class Index:
    """Fingerprints, and by length the sorted window hashes with the items of each (CSR)."""

    fingerprints: np.ndarray
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    names: list[str | None]

    @staticmethod
    def build(names: list, texts: list[str | None], window: int, gram: int) -> Index:
        found: dict[int, list] = {}
        prints = [np.zeros(0, np.uint64)]
        base = 0
        for _, _, data, offs in K.blocks(*K.flatten(pa.array(texts, pa.string()))):
            _, _, doc, h = K.words(data, offs, K.ALNUM, lower=True)
            size = np.bincount(doc, minlength=len(offs) - 1)
            for n in np.unique(np.minimum(size, window)):
                if n:
                    at, g = K.rolling(h, doc, int(n))
                    ours = (size[doc[at]] >= window) if n == window else (size[doc[at]] == n)
                    found.setdefault(int(n), []).append((g[ours], doc[at][ours] + base))
            at, g = K.rolling(h, doc, gram)
            prints.append(g[winnow(g, at, doc, window - gram + 1)])
            base += len(offs) - 1
        windows = {}
        for n, parts in found.items():
            g, item = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            g, item = K.unique_pairs(g, item)
            hashes, starts = np.unique(g, return_index=True)
            windows[n] = (hashes, np.append(starts, len(g)), item)
        return Index(np.unique(np.concatenate(prints)), windows, [None if x is None else str(x) for x in names])

    def apply(self, doc: np.ndarray, h: np.ndarray, hit: np.ndarray, items: dict[int, set[str]], window: int, gram: int) -> None:
        """Marks hit words and adds the names of the items each document holds."""
        for n, (hashes, starts, item) in self.windows.items():
            at, g = K.rolling(h, doc, n)
            if n == window:
                grams_at, grams = K.rolling(h, doc, gram)
                prints = winnow(grams, grams_at, doc, window - gram + 1)
                found = grams_at[prints[_among(self.fingerprints, grams[prints]) >= 0]]
                near = np.zeros(len(h) + 1, np.int64)  # windows that hold a found fingerprint
                np.add.at(near, np.maximum(found - (window - gram), 0), 1)
                np.add.at(near, found + 1, -1)
                close = np.cumsum(near)[at] > 0
                at, g = at[close], g[close]
            place = _among(hashes, g)
            at, place = at[place >= 0], place[place >= 0]
            for k in range(n):
                hit[at + k] = True
            for d, p in zip(*K.unique_pairs(doc[at], place), strict=True):
                names = items.setdefault(int(d), set())
                names.update(x for x in (self.names[i] for i in item[starts[p] : starts[p + 1]]) if x is not None)


def index(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, max_words: int = MAX_WORDS):
    """The broadcast index of all items, or None if they hold more than about max_words words."""
    rows = benchmark.select("item_id", "text").distinct()
    bound = F.length("text") / 2 + 1  # a word and what parts it from the next are two characters at least
    if (rows.agg(F.sum(bound)).first()[0] or 0) > max_words:
        return None
    got = rows.toArrow().sort_by("item_id")
    return benchmark.sparkSession.sparkContext.broadcast(Index.build(got["item_id"].to_pylist(), got["text"].to_pylist(), window, gram))


def _judged(docs: DataFrame, shared, window: int, gram: int, schema, finish) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.claim("decontam")
        for batch in batches:
            n_words, n_hit, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for _, _, data, offs in K.blocks(*K.flatten(batch.column("text"))):
                _, _, doc, h = K.words(data, offs, K.ALNUM, lower=True)
                hit, items = np.zeros(len(h), bool), {}
                shared.value.apply(doc, h, hit, items, window, gram)
                n_words.append(np.bincount(doc, minlength=len(offs) - 1))
                n_hit.append(np.bincount(doc[hit], minlength=len(offs) - 1))
                names += [sorted(items.get(i, ())) for i in range(len(offs) - 1)]
            words, hits = np.concatenate(n_words), np.concatenate(n_hit)
            yield finish(batch, words, hits, names, (hits > 0) & (20 * hits >= words))
        K.trim()

    return docs.mapInArrow(run, schema)


# ---- benchmarks beyond one index ----------------------------------------------------------
def _windows(doc: np.ndarray, h: np.ndarray, size: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, word position, hash) of the items' own windows in a block."""
    for n in np.unique(np.minimum(size, window)):
        if n:
            at, g = K.rolling(h, doc, int(n))
            ours = (size[doc[at]] >= window) if n == window else (size[doc[at]] == n)
            yield int(n), at[ours], g[ours]


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """n, h and item of every window of every item."""
    schema = pa.schema([("n", pa.int32()), ("h", pa.int64()), ("item", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.array([None if x is None else str(x) for x in batch.column("item_id").to_pylist()], pa.string())
            for first, _, data, offs in K.blocks(*K.flatten(batch.column("text"))):
                _, _, doc, h = K.words(data, offs, K.ALNUM, lower=True)
                for n, at, g in _windows(doc, h, np.bincount(doc, minlength=len(offs) - 1), window):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), n, np.int32)), pa.array(g.astype(np.int64)), names.take(pa.array(doc[at] + first))], schema=schema)

    return benchmark.select("item_id", "text").mapInArrow(run, "n int, h long, item string").distinct()


def print_filter(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = BLOOM_BITS) -> tuple[np.ndarray, list[int]]:
    """Flags of the low bits of all items' fingerprints, of fixed size whatever the benchmark's, and the lengths of items shorter than a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, short = np.zeros(1 << bits, bool), set()
        for batch in batches:
            for _, _, data, offs in K.blocks(*K.flatten(batch.column("text"))):
                _, _, doc, h = K.words(data, offs, K.ALNUM, lower=True)
                at, g = K.rolling(h, doc, gram)
                flags[(g[winnow(g, at, doc, window - gram + 1)] & np.uint64(len(flags) - 1)).astype(np.int64)] = True
                for n, _, own in _windows(doc, h, np.bincount(doc, minlength=len(offs) - 1), window):
                    if n < window:
                        short.add(n)
                        flags[(own & np.uint64(len(flags) - 1)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(flags).tobytes()], pa.binary()), pa.array([sorted(short)], pa.list_(pa.int32()))], ["flags", "short"])

    parts = benchmark.select("text").repartition(16).mapInArrow(run, "flags binary, short array<int>")
    flags, short = np.zeros((1 << bits) // 8, np.uint8), set()
    for row in parts.toLocalIterator():  # sixteen parts of fixed size, one at a time
        flags |= np.frombuffer(row["flags"], np.uint8)
        short.update(row["short"])
    return flags, sorted(short)


def _key(docs: DataFrame) -> list:
    return [F.xxhash64(F.lit(k), F.isnull("doc_id"), "doc_id", F.isnull("text"), "text").alias(f"u{k}") for k in (1, 2)]  # equal rows have equal results


def joined_hits(docs: DataFrame, benchmark: DataFrame, window: int, gram: int, bits: int = BLOOM_BITS) -> DataFrame:
    """u1, u2 (a hash of doc_id and text), n_words, n_hit and items of the documents that hold a window."""
    windows = saved(item_windows(benchmark, window), "benchmark-windows")
    shared = docs.sparkSession.sparkContext.broadcast(print_filter(benchmark, window, gram, bits))
    schema = pa.schema([("u1", pa.int64()), ("u2", pa.int64()), ("n_words", pa.int64()), ("n", pa.int32()), ("at", pa.int64()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.claim("decontam")
        flags, short = shared.value
        mask = np.uint64(8 * len(flags) - 1)

        def may(g: np.ndarray) -> np.ndarray:
            low = (g & mask).astype(np.int64)
            return flags[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1 > 0

        for batch in batches:
            for first, _, data, offs in K.blocks(*K.flatten(batch.column("text"))):
                _, _, doc, h = K.words(data, offs, K.ALNUM, lower=True)
                size = np.bincount(doc, minlength=len(offs) - 1)
                begin = np.concatenate([[0], np.cumsum(size)])[:-1]
                for n in (*short, window):
                    at, g = K.rolling(h, doc, n)
                    if n < window:
                        keep = may(g)
                    else:
                        grams_at, grams = K.rolling(h, doc, gram)
                        prints = winnow(grams, grams_at, doc, window - gram + 1)
                        found = grams_at[prints[may(grams[prints])]]
                        near = np.zeros(len(h) + 1, np.int64)  # windows that hold such a fingerprint
                        np.add.at(near, np.maximum(found - (window - gram), 0), 1)
                        np.add.at(near, found + 1, -1)
                        keep = np.cumsum(near)[at] > 0
                    at, g = at[keep], g[keep]
                    rows = pa.array(doc[at] + first)
                    columns = [batch.column("u1").take(rows), batch.column("u2").take(rows), pa.array(size[doc[at]]), pa.array(np.full(len(at), n, np.int32)), pa.array(at - begin[doc[at]]), pa.array(g.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
        K.trim()

    asked = docs.select("text", *_key(docs)).mapInArrow(run, "u1 long, u2 long, n_words long, n int, at long, h long").distinct()
    asked = saved(asked, "windows-asked")
    places = asked.join(windows.select("n", "h").distinct(), ["n", "h"], "left_semi")
    spans = places.groupBy("u1", "u2", "n_words").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("spans"))  # bounded by the document's words
    start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("upto"))
    step = lambda a, x: F.struct((a["hit"] + F.greatest(x["at"] + x["n"] - F.greatest(a["upto"], x["at"]), F.lit(0))).cast("long").alias("hit"), F.greatest(a["upto"], x["at"] + x["n"]).cast("long").alias("upto"))
    counts = spans.select("u1", "u2", "n_words", F.aggregate("spans", start, step)["hit"].alias("n_hit"))
    named = asked.select("u1", "u2", "n", "h").distinct().join(windows.where("item IS NOT NULL"), ["n", "h"])
    items = named.groupBy("u1", "u2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    return counts.join(items, ["u1", "u2"], "left").withColumn("items", F.coalesce("items", none))


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of numbered() and u1, u2."""
    names = numbered(docs).columns
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), *_key(docs))


def _word_counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0, np.int64)]
            for _, _, data, offs in K.blocks(*K.flatten(batch.column("text"))):
                parts.append(np.bincount(K.runs(K.ALNUM[data], offs)[2], minlength=len(offs) - 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("u1"), batch.column("u2"), pa.array(np.concatenate(parts))], ["doc_id", "u1", "u2", "n_words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *_key(docs)).mapInArrow(run, f"doc_id {kind}, u1 long, u2 long, n_words long")


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted names) and contaminated of every row."""

    def finish(batch, words, hits, names, bad):
        columns = [batch.column("doc_id"), pa.array(words), pa.array(hits), pa.array(names, pa.list_(pa.string())), pa.array(bad)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "items", "contaminated"])

    shared = index(benchmark, window, gram, max_words)
    if shared is None:
        found = saved(joined_hits(docs, benchmark, window, gram).drop("n_words"), "benchmark-hits")
        hits, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
        rows = _word_counts(docs).join(found, ["u1", "u2"], "left")
        return rows.select("doc_id", "n_words", hits.alias("n_hit"), items.alias("items"), ((hits > 0) & (20 * hits >= F.col("n_words"))).alias("contaminated"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, items array<string>, contaminated boolean"
    return _judged(docs.select("doc_id", "text"), shared, window, gram, schema, finish)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, max_words: int = MAX_WORDS) -> DataFrame:
    """The rows, with all their columns, that are not contaminated."""
    finish = lambda batch, words, hits, names, bad: K.passthrough(batch, ~bad)
    shared = index(benchmark, window, gram, max_words)
    rows = numbered(docs)
    if shared is None:
        bad = saved(joined_hits(docs, benchmark, window, gram).where("n_hit > 0 AND 20 * n_hit >= n_words").select("u1", "u2"), "contaminated")
        return _keyed(docs).join(bad, ["u1", "u2"], "left_anti").select(*rows.columns).toDF(*docs.columns)
    return _judged(rows, shared, window, gram, rows.schema, finish).toDF(*docs.columns)


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    named = F.sha2(F.concat_ws(",", "items"), 256)
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), named.alias("items_sha256"), "contaminated")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM (SELECT item_id, w, CAST(least(len(w), 13) AS BIGINT) AS size FROM b WHERE len(w) > 0))
), dw AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), m AS (
  SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
