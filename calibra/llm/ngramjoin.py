r"""N-gram Jaccard join: a distributed prefix-tree join over sets of word shingles.

1. Every text becomes the sorted set of its distinct shingles in one global order: those of rare
   words first, by levels of how often their words would meet by chance; then, whatever their words,
   frequent shingles, by levels of their counted frequency; then by hash. Any order gives the same
   links; this one keeps passages that many documents share out of the prefixes, and shingles of common words, which
   unrelated documents share the more often the more documents there are.
2. Documents with equal sets form a class; the smallest doc_id represents it.
3. Linked sets share several tokens among the first n - ceil(percent n / 100) + 1 + n / SLACK of
   each (`sure` tells how many at least). For every such token the smallest document that has it
   is the pivot, and its documents may meet in the pivot's shard. A document that shares fewer
   prefix tokens than any partner would need is done, and a document leaves the shards where it
   shares least, as long as what both documents of a pair give up is less than what they share;
   so each pair that may be linked still meets. A shard with many documents or tokens is dealt
   over blocks, the pivot going to each.
4. In each block a trie over the sets finds all links (trie.join). Pairs in different blocks of
   a shard need a second look only if one of them is not linked with the pivot and, by the
   triangle inequality, the other is near enough; those few are joined in pairs of blocks.
5. Links are pairs of a block's component with its smallest member, never all pairs of a group;
   components over all blocks come from min-label rounds with pointer jumping.

doc_id is an integer. A document without words (or null text) has the empty set, is linked with nothing and is a
component of its own. Rows with a null doc_id have a null component and no links. Rows of one
doc_id count as one document: their sets' links are pooled. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import kernels as K
from . import trie
from .tables import discard, saved, table

SHINGLE = 4
PERCENT = 85
#: A prefix has n / SLACK tokens more than one shared token needs. More (a smaller number) lets fewer documents that
#: share but a passage meet, for longer prefixes; the links are the same with any.
SLACK = 12
BLOCK_DOCS = 256
BLOCK_TOKENS = 1_000_000
BROADCAST_PLACES = 500_000
#: Scans of the texts at most, each with BROADCAST_PLACES broadcast places.
ROUNDS = 32
#: Ids of dropped copies (some 24 bytes each) that are broadcast.
BROADCAST_COPIES = 2_000_000
_HASH_BITS = 58
#: Levels of a shingle that is not frequent; frequent ones have those from here to 31.
_CHANCE_LEVELS = 16
#: Words are counted in this many cells by their hashes.
_CELL_BITS = 16


def block_shingles(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, 58-bit shingle hash) of every shingle; a shorter document is one shingle."""
    _, _, doc, h = K.words(data, offs, K.NONSPACE, lower=True)
    return _shingles(doc, h, len(offs) - 1, width)[:2]


def _shingles(doc: np.ndarray, h: np.ndarray, docs: int, width: int, rarity: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, 58-bit hash, sum of its words' rarity) of every shingle of words with hashes h."""
    size = np.bincount(doc, minlength=docs)
    found = [], [], []
    for k in range(width, 0, -1):
        if k < width and not (size == k).any():
            continue
        at, g = K.grams(h, doc, tuple(range(k)))
        if k < width:
            ours = size[doc[at]] == k
            at, g = at[ours], g[ours]
        rare = np.zeros(len(at), np.int32)
        for i in range(k if rarity is not None else 0):
            rare += rarity[_cells(h)[at + i]]
        for out, x in zip(found, (doc[at], g >> np.uint64(64 - _HASH_BITS), rare), strict=True):
            out.append(x)
    return tuple(map(np.concatenate, found))


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _CELL_BITS)).astype(np.int64)


class Order:
    """The global order: a token is (level << 58) | hash.

    Frequent shingles have levels from 16, by their counts. The level of any other follows from the number of
    documents in which its words would follow each other by chance: 0 for a 256th or less, 15 for 64 or more.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, cells: np.ndarray | None = None, words: int = 0) -> None:
        """cells: words counted in each cell, 0 where they are few."""
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.levels = np.clip(_CHANCE_LEVELS - 5 + np.log2(np.maximum(counts[order], 1)), _CHANCE_LEVELS, 31).astype(np.int64)
        cells = np.zeros(1 << _CELL_BITS, np.int64) if cells is None else cells
        words = max(words, 1)
        rest = max(words - int(cells.sum()), 1) / len(cells)
        #: Sixteenths of bits by which a word is rare; whole numbers, so that sums do not depend on their order.
        self.rarity = np.round(-16 * np.log2(np.minimum(np.maximum(cells, rest) / words, 1))).astype(np.int32)
        self.bits = 16 * np.log2(words)

    def tokens(self, hashes: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """rare: the sums of their words' rarity."""
        level = np.clip((self.bits - rare) / 16 + 9, 0, _CHANCE_LEVELS - 1).astype(np.int64)
        out = hashes.astype(np.int64)
        if len(self.hashes) and len(out):
            at = np.minimum(np.searchsorted(self.hashes, out), len(self.hashes) - 1)
            hit = self.hashes[at] == out
            level[hit] = self.levels[at[hit]]
        return out | level << _HASH_BITS


def _sets(batch: pa.RecordBatch, width: int, order: Order) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block of a batch: all tokens, by document and in order, and where each document's begin."""
    for _, _, data, offs in K.blocks(*K.flatten(batch.column("text"))):
        _, _, doc, h = K.words(data, offs, K.NONSPACE, lower=True)
        doc, h, rare = _shingles(doc, h, len(offs) - 1, width, order.rarity)
        doc, token = K.unique_pairs(doc, order.tokens(h, rare))
        yield token, np.searchsorted(doc, np.arange(len(offs)))


def _merged(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def global_order(docs: DataFrame, width: int, held: int = 500_000, least: int = 4) -> Order:
    """Counts the documents of every shingle and orders the frequent ones last.

    A task keeps at most about 2 * held counters and forgets those of 1 when there are more; it
    reports shingles it has seen in `least` documents. Frequent is a shingle with a millionth of
    all (document, shingle) pairs and 50 documents at least, so there are at most a million.
    Words are counted in cells of their hashes; a task reports cells with 2^-15 of its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.claim("ngramjoin")
        hashes, counts, total = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        fresh, waiting = [], 0
        cells = np.zeros(1 << _CELL_BITS, np.int64)

        def fold() -> None:
            nonlocal hashes, counts, fresh, waiting
            new = np.concatenate([hashes, *fresh])
            hashes, counts = _merged(new, np.concatenate([counts, np.ones(len(new) - len(hashes), np.int64)]))
            fresh, waiting = [], 0
            if len(hashes) > held:
                hashes, counts = hashes[counts > 1], counts[counts > 1]

        for batch in batches:
            for _, _, data, offs in K.blocks(*K.flatten(batch.column("text"))):
                _, _, doc, h = K.words(data, offs, K.NONSPACE, lower=True)
                cells += np.bincount(_cells(h), minlength=len(cells))
                _, h = K.unique_pairs(*_shingles(doc, h, len(offs) - 1, width)[:2])
                fresh.append(h.astype(np.int64))
                waiting += len(h)
                total += len(h)
                if waiting > held:
                    fold()
        fold()
        kept, words = counts >= least, cells.sum()
        common = np.flatnonzero((cells << 15 >= words) & (cells > 0))
        tokens = np.concatenate([hashes[kept], [-1, -2], -3 - common])
        yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.concatenate([counts[kept], [total, words], cells[common]]))], ["token", "n"])
        K.trim()

    counted = saved(docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "shingle-counts")
    known = counted.where("token < 0").toArrow()  # two sums and a cell's each
    known = dict(zip(known["token"].to_pylist(), known["n"].to_pylist(), strict=True))
    total, words = known.pop(-1, 0), known.pop(-2, 0)
    cells = np.zeros(1 << _CELL_BITS, np.int64)
    cells[[-3 - t for t in known]] = list(known.values())
    got = counted.where((F.col("token") >= 0) & (F.col("n") >= max(50, total // 1_000_000))).toArrow()
    return Order(got["token"].to_numpy().astype(np.int64), got["n"].to_numpy().astype(np.int64), cells, words)


def outlines(docs: DataFrame, shared, width: int, percent: int) -> DataFrame:
    """doc_id, n (tokens), s1 and s2 (a 128-bit hash of the set) and prefix of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.claim("ngramjoin")
        order = shared.value
        for batch in batches:
            n, s1, s2, heads, lengths = [], [], [], [], []
            for token, cut in _sets(batch, width, order):
                size = np.diff(cut)
                k = token.astype(np.uint64)
                for out, salt in ((s1, 0x5851F42D4C957F2D), (s2, 0x14057B7EF767814F)):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(k ^ np.uint64(salt)), dtype=np.uint64)])
                    out.append((total[cut[1:]] - total[cut[:-1]]).astype(np.int64))
                head = np.minimum(size, size - -(-percent * size // 100) + 1 + size // SLACK)
                flat = np.arange(head.sum()) + np.repeat(cut[:-1] - (np.cumsum(head) - head), head)
                n.append(size)
                heads.append(token[flat])
                lengths.append(head)
            flat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
            offsets = np.concatenate([[0], np.cumsum(flat(lengths))]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat(heads)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(flat(n)), pa.array(flat(s1)), pa.array(flat(s2)), prefix], ["doc_id", "n", "s1", "s2", "prefix"])
        K.trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, s1 long, s2 long, prefix array<long>")


def sure(n: Column, percent: int) -> Column:
    """Prefix tokens that a document of n tokens shares with any document linked with it, at least.

    A pair's common tokens come after at most n - overlap others in each set, so the first of
    them up to the shorter prefix's surplus lie in both prefixes; the least partner has
    ceil(percent n / 100) tokens.
    """
    return 1 + F.floor(F.ceil(percent * n / 100) / SLACK)


def shards(reps: DataFrame, percent: int) -> DataFrame:
    """doc, pivot, block, blocks: the blocks each representative goes to.

    Shingles that are not frequent are counted in one window each; the frequent ones, few and
    known, are counted ahead of the shuffle and joined back, which may split a large one.
    """
    tokens = reps.select("doc", F.explode("prefix").alias("token"))
    frequent = F.lit(_CHANCE_LEVELS << _HASH_BITS)
    same = Window.partitionBy("token")
    rare = tokens.where(F.col("token") < frequent).select("doc", F.min("doc").over(same).alias("pivot"), F.count("*").over(same).alias("held")).where("held > 1")
    often = tokens.where(F.col("token") >= frequent)
    pivots = often.groupBy("token").agg(F.min("doc").alias("pivot"), F.count("*").alias("held")).where("held > 1").select("token", "pivot")
    both = rare.select("doc", "pivot").unionByName(often.join(pivots, "token").select("doc", "pivot"))
    shared = both.groupBy("doc", "pivot").agg(F.count("*").alias("shared")).join(reps.select("doc", "n"), "doc")
    own = Window.partitionBy("doc")
    upto = own.orderBy(F.col("pivot") == F.col("doc"), "shared", "pivot").rowsBetween(Window.unboundedPreceding, 0)
    shared = shared.withColumn("total", F.sum("shared").over(own)).withColumn("upto", F.sum("shared").over(upto))
    needs = sure(F.col("n"), percent)
    edges = saved(shared.where((F.col("total") >= needs) & (F.col("pivot") != F.col("doc")) & (2 * F.col("upto") > needs - 1)).select("doc", "n", "pivot"), "shard-edges")
    load = edges.groupBy("pivot").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    load = load.select("pivot", blocks.alias("blocks"))
    members = edges.join(load, "pivot").select("doc", "pivot", "blocks", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block"))
    pivot = load.select(F.col("pivot").alias("doc"), "pivot", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return members.unionByName(pivot)


def placed_sets(docs: DataFrame, places: DataFrame, shared, width: int, few: bool = True) -> DataFrame:
    """doc, tokens (int64 bytes in order) and the fields of `place`, a row for each of a document's places.

    `few` places (see block_rounds) are broadcast, so that only texts with a place leave the scan;
    others make the texts be dealt out by document.
    """
    listed = places.groupBy("doc").agg(F.collect_list("place").alias("places"))
    listed = F.broadcast(listed) if few else listed
    fields = places.schema["place"].dataType.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.claim("ngramjoin")
        order = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                held = []
                for token, cut in _sets(batch, width, order):
                    held += [token[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                lists = batch.column("places")
                rows = pc.list_parent_indices(lists)
                flat = pc.list_flatten(lists)
                for i in range(0, len(rows), 1000):
                    part = rows.slice(i, 1000)
                    columns = [batch.column("doc").take(part), pa.array([held[k] for k in part.to_pylist()], pa.binary())]
                    columns += [pc.struct_field(flat.slice(i, 1000), f) for f in fields]
                    yield pa.RecordBatch.from_arrays(columns, ["doc", "tokens", *fields])
        K.trim()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in places.schema["place"].dataType.fields)
    text = docs.select(F.col("doc_id").alias("doc"), "text").join(listed, "doc")
    return text.mapInArrow(run, f"doc {places.schema['doc'].dataType.simpleString()}, tokens binary, {kinds}")


def block_links(sets: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """kind 0: a is the least document of b's component in a block. For shards of several blocks also
    kind 1 (linked with the pivot a) or 2 (not linked), and the least distance of b from a."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids = rows["doc"].to_numpy()
        order = np.argsort(ids, kind="stable")
        held = rows["tokens"].combine_chunks().take(pa.array(order))
        ids = ids[order]
        tokens = [np.frombuffer(t.as_buffer(), np.int64) for t in held]
        pivot = int(np.searchsorted(ids, key[0].as_py())) if "blocks" in rows.column_names else 0
        label, low, high = trie.join(tokens, percent, min(pivot, len(ids) - 1))
        first = {}
        least = np.array([ids[first.setdefault(v, i)] for i, v in enumerate(label)])
        own = least != ids
        kind, a, b, d = [np.zeros(own.sum(), np.int32)], [least[own]], [ids[own]], [np.zeros(own.sum())]
        if "blocks" in rows.column_names and rows["blocks"][0].as_py() > 1:
            far = high > 1 - percent / 100 + 1e-9
            kind.append(np.where(far, 2, 1).astype(np.int32))
            a.append(np.full(len(ids), key[0].as_py()))
            b.append(ids)
            d.append(low)
        return pa.table({"kind": np.concatenate(kind), "a": np.concatenate(a), "b": np.concatenate(b), "d": np.concatenate(d)})

    return sets.groupBy(*keys).applyInArrow(run, "kind int, a long, b long, d double")


def block_rounds(docs: DataFrame, places: DataFrame, shared, width: int, percent: int, keys: list[str], name: str) -> DataFrame:
    """block_links() of all blocks, in rounds of about BROADCAST_PLACES places (some 30 MB).

    A block is whole in one round. A round scans the texts, and its sets are off the disk before the
    next begins. Beyond ROUNDS rounds the texts are dealt out by document, once for all blocks.
    """
    n = places.count()
    few = n <= BROADCAST_PLACES * ROUNDS
    rounds = -(-n // BROADCAST_PLACES) if few and n else 1
    turn = F.pmod(F.xxhash64(*(F.col(f"place.{k}") for k in keys)), F.lit(rounds))
    done = [saved(block_links(placed_sets(docs, places.where(turn == k) if rounds > 1 else places, shared, width, few), keys, percent), name) for k in range(rounds)]
    return reduce(DataFrame.unionByName, done)


def second_look(found: DataFrame, percent: int) -> DataFrame:
    """Places in pairs of blocks for the documents of dealt-out shards that may be linked across blocks."""
    far = found.where("kind = 2").groupBy("a").agg(F.min("d").alias("nearest"))
    rest = found.where("kind > 0 AND a != b").join(far, "a").where((F.col("kind") == 2) | (F.col("d") >= F.col("nearest") - (1 - percent / 100) - 1e-9)).select("a", "b").distinct()
    count = rest.groupBy("a").agg(F.ceil(F.count("*") / (BLOCK_DOCS // 2)).cast("int").alias("parts"))
    dealt = rest.join(count, "a").withColumn("own", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    other = dealt.select(F.col("b").alias("doc"), "a", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return other.select("doc", F.struct(F.col("a").alias("pivot"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("place"))


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for all nodes of the links (a, b)."""
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        best = labels.join(seen, "node").select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        step = saved(best.join(jump, "next").select("node", F.least("next", "far").alias("component"), (F.least("next", "far") < F.col("component")).alias("moved")), "labels")
        labels = step.select("node", "component")
        if step.where("moved").isEmpty():
            return labels


def similar(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row. doc_id is of an integer type."""
    spark = docs.sparkSession
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be of an integer type; number the documents first")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = spark.sparkContext.broadcast(global_order(docs, width))
    full = saved(outlines(docs, shared, width, percent), "shingle-outlines")
    classes = saved(full.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc"), F.first("prefix").alias("prefix")), "shingle-classes")
    rows = saved(full.drop("prefix"), "shingle-rows")
    discard(full)
    place = saved(shards(classes.select("doc", "n", "prefix"), percent).select("doc", F.struct("pivot", "block", "blocks").alias("place")), "places")
    ids = saved(classes.select("n", "s1", "s2", "doc"), "class-ids")
    discard(classes)  # the prefixes, a third of the input
    found = block_rounds(docs, place, shared, width, percent, ["pivot", "block"], "links-in-blocks")
    links = found.where("kind = 0").select("a", "b")
    again = saved(second_look(found, percent), "places-across-blocks")
    if not again.isEmpty():
        more = block_rounds(docs, again, shared, width, percent, ["pivot", "i", "j"], "links-across-blocks")
        links = links.unionByName(more.select("a", "b"))
    pooled = rows.where("n > 0 AND doc_id IS NOT NULL").join(ids, ["n", "s1", "s2"]).where("doc_id != doc").select(F.col("doc").alias("a"), F.col("doc_id").alias("b"))
    clusters = components(links.unionByName(pooled))
    return rows.select("doc_id", F.col("n").alias("n_shingles")).join(clusters.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row, with all its columns, of each group of linked documents: that of the least doc_id.

    Rows without a doc_id take part under a name made from their text, above all real ids. Of
    rows that are equal in doc_id and text one stays. Texts without words are linked with nothing and all stay.
    """
    names = docs.columns
    own = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62))
    rows = docs.select(own.alias("doc_id"), F.col("text").alias("text"), F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))).alias("row"))
    found = saved(similar(rows.select("doc_id", "text"), width, percent), "components")
    copies = saved(found.where("component_id != doc_id").select("doc_id").distinct(), "copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_COPIES else copies  # else all texts would be shuffled
    kept = rows.join(copies, "doc_id", "left_anti")
    twice = saved(found.where("n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeats")
    if not twice.isEmpty():
        some = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id", F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).agg(F.first("row").alias("row"))
        kept = kept.join(twice, "doc_id", "left_anti").select("row").unionByName(some.select("row"))
    return kept.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)))


def op9_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM p JOIN n AS x ON a = x.doc_id JOIN n AS y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON r = a
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least_id AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS least_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
