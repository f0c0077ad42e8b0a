from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from calibra.llm import decontam, ngramjoin, trie

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- n-gram Jaccard join ------------------------------------------------------------------
def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def brute_components(rows, width=4, percent=85):
    """rows: (doc_id, text); one set for each row, rows of a doc_id pooled."""
    sets = [(d, shingles(t, width)) for d, t in rows if d is not None]
    label = {d: d for d, _ in sets}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and label[a] != label[b] and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((label[a], label[b]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    return {(d, len(shingles(t, width)), label.get(d)) for d, t in rows}


def near_copies(rng, n, vocabulary=40):
    """Families of texts that differ in a few words, of all sizes, with borderline cases."""
    out = []
    while len(out) < n:
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 9, 12, 30, 80, 150]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                k = rng.randrange(len(copy))
                copy[k : k + rng.randint(0, 1)] = [f"n{rng.randrange(1000)}"] * rng.randint(0, 2)
            out.append(" ".join(copy))
    return out[:n]


@pytest.mark.parametrize("seed, blocks", [(1, None), (2, (3, 50)), (3, (2, 10_000))])
def test_components_against_brute_force(spark, monkeypatch, seed, blocks):
    if blocks:  # shards are dealt over blocks and looked at twice
        monkeypatch.setattr(ngramjoin, "BLOCK_DOCS", blocks[0])
        monkeypatch.setattr(ngramjoin, "BLOCK_TOKENS", blocks[1])
        monkeypatch.setattr(ngramjoin, "BROADCAST_PLACES", 0)
    rows = list(enumerate(near_copies(random.Random(seed), 150, vocabulary=[40, 6, 400][seed - 1])))
    got = ngramjoin.similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute_components(rows)


def shuffle_files(spark):
    root = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {str(f) for folder in root.localDirsString() for f in Path(folder).rglob("shuffle_*.data")}


def test_documents_that_share_but_a_fifth_do_not_meet(spark, monkeypatch):
    rng = random.Random(9)
    words = lambda n: [f"{rng.getrandbits(40):x}" for _ in range(n)]
    passages = [words(100) for _ in range(10)]
    rows = [(i, " ".join([*words(200), *passages[i // 2], *words(200)])) for i in range(20)]
    rows += [(20 + i, rows[i][1].replace("a", "b", 5)) for i in range(4)]
    met, shards = [], ngramjoin.shards

    def noted(*args):
        out = shards(*args)
        met.append({r["doc"] for r in out.collect()})
        return out

    monkeypatch.setattr(ngramjoin, "shards", noted)
    got = ngramjoin.similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute_components(rows)
    assert met == [{0, 1, 2, 3, 20, 21, 22, 23}]


def test_shingles_of_rare_words_come_first():
    common, rare = np.uint64(1 << 60), np.uint64(2 << 60)
    cells = np.zeros(1 << 16, np.int64)
    cells[int(common) >> 48] = 500_000
    order = ngramjoin.Order(np.array([7]), np.array([900]), cells, 1_000_000)
    doc = np.zeros(8, np.int64)
    _, h, rarity = ngramjoin._shingles(doc, np.array([common] * 4 + [rare] * 4), 1, 4, order.rarity)
    token = order.tokens(h, rarity)
    assert (np.diff(token >> 58) <= 0).all() and token[0] >> 58 == 15 and token[-1] >> 58 == 0
    assert order.tokens(np.array([7], np.uint64), np.zeros(1, np.int32))[0] >> 58 >= 16  # frequent ones last


def test_many_places_are_joined_in_rounds_that_leave_no_shuffle(spark, monkeypatch):
    rows = list(enumerate(near_copies(random.Random(4), 150)))
    plans, links = [], ngramjoin.block_links

    def noted(sets, *args):
        plans.append(sets._jdf.queryExecution().executedPlan().toString())
        return links(sets, *args)

    monkeypatch.setattr(ngramjoin, "block_links", noted)
    monkeypatch.setattr(ngramjoin, "BLOCK_DOCS", 3)  # a second look too
    monkeypatch.setattr(ngramjoin, "BROADCAST_PLACES", 20)
    before = shuffle_files(spark)
    got = ngramjoin.similar(spark.createDataFrame(rows, "doc_id long, text string"))
    left = shuffle_files(spark) - before
    assert {tuple(r) for r in got.collect()} == brute_components(rows)
    assert len(plans) > 3 and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)  # no text is shuffled
    assert not left


def test_dropping_copies_shuffles_no_text(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")  # as for ids beyond it
    try:
        got = ngramjoin.one_of_each(spark.createDataFrame(list(enumerate(["a b c d e f"] * 3 + ["x y"])), "doc_id long, text string"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["doc_id"] for r in got.collect()) == [0, 3]
    finally:
        spark.conf.set(name, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_chain_of_copies_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK_DOCS", 4)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([f"x{k}" for k in range(3 * i)] + base[3 * i :])) for i in range(30)]
    got = {tuple(r) for r in ngramjoin.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_the_stage_links_five_word_copies(spark, sf):
    base = [f"w{i}" for i in range(1000)]
    copy = [f"x{i}" if i % 47 == 23 else w for i, w in enumerate(base)]  # 21 words: J5 0.81, J4 0.845
    pairs = [(0, " ".join(base)), (1, " ".join(copy))]
    assert {c for _, _, c in brute_components(pairs)} == {0, 1} and {c for _, _, c in brute_components(pairs, 5, 80)} == {0}
    rows = pairs + list(enumerate(near_copies(random.Random(4), 150), 2))
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute_components(rows, 5, 80)})


def test_odd_documents(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = ngramjoin.similar(odd).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((d, len(shingles(t, 4)), next(c for i, _, c in brute_components(rows) if i == d))) for d, t in rows)
    kept = ngramjoin.one_of_each(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {None} | {c for d, _, c in brute_components(rows) if d is not None}
    assert ngramjoin.similar(nothing).count() == 0


sets = st.lists(st.lists(st.integers(0, 25), min_size=1, max_size=20, unique=True), min_size=1, max_size=15)


@settings(max_examples=200, deadline=None)
@given(sets, st.lists(st.integers(0, 30), min_size=1, max_size=20, unique=True), st.sampled_from([50, 80, 85, 100]))
def test_trie_overlaps(groups, probe, percent):
    held = [np.array(sorted(g), np.int64) for g in groups]
    exact, bound = trie.Trie.build(held).overlaps(np.array(sorted(probe), np.int64), percent)
    for s, e, b in zip(held, exact, bound, strict=True):
        shared = len(set(s.tolist()) & set(probe))
        assert shared <= b
        assert e in (-1, shared)
        if 100 * shared >= percent * (len(s) + len(probe) - shared):
            assert e == shared


@settings(max_examples=200, deadline=None)
@given(sets, st.sampled_from([50, 85]), st.integers(0, 14))
def test_trie_join(groups, percent, pivot):
    held = [np.array(sorted(g), np.int64) for g in groups]
    pivot %= len(held)
    label, low, high = trie.join(held, percent, pivot)
    want = np.arange(len(held))
    for i, x in enumerate(groups):
        for j, y in enumerate(groups[:i]):
            if 100 * len({*x} & {*y}) >= percent * len({*x} | {*y}):
                want[want == want[i]] = want[j]
    assert ((label[:, None] == label) == (want[:, None] == want)).all()
    for i, x in enumerate(groups):
        d = 1 - len({*x} & {*groups[pivot]}) / len({*x} | {*groups[pivot]})
        assert low[i] - 1e-9 <= d <= high[i] + 1e-9


# ---- decontamination ----------------------------------------------------------------------
def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_hits(text, items, window=13):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        own = words(t)
        n = min(len(own), window)
        wins = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("max_words", [2_000_000, 30])
def test_hits_against_brute_force(spark, odd, max_words):
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([1, 2, 5, 12, 13, 14, 40])))) for i in range(30)]
    items += [(None, " ".join(pool[:20])), (50, None), (51, ""), (52, "!!"), (3, items[3][1]), (60, items[5][1].upper())]
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    for k in range(40):
        text = rng.choices(pool, k=rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            t = words(items[rng.randrange(30)][1])
            cut = t[: rng.randint(1, len(t))]
            at = rng.randint(0, len(text))
            text[at:at] = cut
        rows.append((1000 + k, ", ".join(text)))
    rows.append((2000, "say " + " ".join(pool[:20])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(repr((d, *brute_hits(t, items))) for d, t in rows)
    assert sorted(repr(tuple(r)) for r in decontam.judge(docs, bench, max_words=max_words).collect()) == want
    kept = decontam.clean(odd, bench, max_words=max_words)
    assert kept.columns == odd.columns
    judged = decontam.judge(odd, bench).where("NOT contaminated").select("doc_id").collect()
    assert sorted(map(repr, kept.select("doc_id").collect())) == sorted(map(repr, judged))
    kept = {d for d, t in rows if not brute_hits(t, items)[3]}
    assert {r["doc_id"] for r in decontam.clean(docs, bench).collect()} == kept


def test_winnowing_guarantee():
    rng = np.random.default_rng(4)
    for _ in range(50):
        h = rng.integers(0, 4, 60).astype(np.uint64)
        at, doc = np.arange(60), np.repeat([0, 1, 2], 20)
        kept = decontam.winnow(h, at, doc, 8)
        for d in range(3):
            for i in range(20 * d, 20 * d + 13):
                assert ((kept >= i) & (kept < i + 8)).any()


def test_no_benchmark_and_no_documents(spark, odd, nothing):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.judge(odd, empty).where("n_hit > 0 OR contaminated").isEmpty()
    assert decontam.judge(nothing, empty).count() == 0
    assert decontam.clean(odd, empty).columns == odd.columns
