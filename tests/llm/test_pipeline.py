from __future__ import annotations

import collections
import os
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from calibra.llm import decontam, licenses, linededup, ngramjoin, packing
from calibra.llm.registry import ORACLES, QUERIES
from calibra.llm.tables import saved, shared_root, table


def folders(spark):
    return os.listdir(shared_root(spark).removeprefix("file://"))


def brute_near(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    by = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    for i, j in {(i, j) for ids in by.values() for i in ids for j in ids if i < j}:
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            label[b] = a
    return {i for i in sets if root(i) == i}


def test_near_duplicates_against_brute_force(spark):
    """Five words and 80 %, not the query's four and 85 %: the copy with 21 of 1000 words changed tells them apart."""
    rng = random.Random(8)
    texts, n = {}, 0
    for size in (6, 30, 200, 1000):
        for _ in range(12):
            base = [rng.choice("abcdefghij") + str(rng.randrange(4000)) for _ in range(size)]
            for changes in (0, *rng.sample((1, 2, 3, 4, 6, 21, 22, 23), 3)):
                w = list(base)
                for k in range(min(changes, size)):
                    w[k * size // max(min(changes, size), 1)] = f"new{n}x{k}"
                texts[n] = " ".join(w)
                n += 1
    base = [f"w{i}" for i in range(1000)]
    texts[n], texts[n + 1] = " ".join(base), " ".join("other" + w if k % 47 == 20 and k < 21 * 47 else w for k, w in enumerate(base))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == brute_near(texts, 5, 80)
    assert brute_near({k: texts[k] for k in (n, n + 1)}, 5, 80) == {n} and len(brute_near({k: texts[k] for k in (n, n + 1)}, 4, 85)) == 2


def test_repeated_rows_and_rows_without_id_give_way(spark):
    long = "one two three four five six seven eight"
    rows = [(5, long, 1), (5, long, 1), (None, long, 2), (None, "nine ten eleven twelve thirteen", 3), (None, "nine ten eleven twelve thirteen", 4), (7, "other words stand here alone", 5), (7, "under one id two texts", 6), (8, "", 7), (9, None, 8), (None, "", 9), (None, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted([(5, long), (0, "nine ten eleven twelve thirteen"), (7, "other words stand here alone"), (7, "under one id two texts"), (8, ""), (9, ""), (0, ""), (0, "")])


def test_stages_keep_the_columns_and_take_effect(spark, sf):
    docs = table(spark, sf, "documents")
    columns, ids = docs.columns, set()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = saved(stage(spark, docs, sf), name)
        assert docs.columns == columns
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids <= before
    assert decontam.judge(docs, table(spark, sf, "benchmark")).where("contaminated").isEmpty()
    assert ngramjoin.similar(docs, 5, 80).where("component_id != doc_id").isEmpty()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == ids
    held = set(folders(spark))
    whole = corpus_pipeline.run(spark, sf)
    assert [f.rpartition("-")[0] for f in set(folders(spark)) - held] == ["decontamination"]  # the pieces' source alone
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in packing.unpack(whole).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, packing.END]
    assert whole.drop("sequence_id").exceptAll(pieces.drop("sequence_id")).isEmpty() and whole.count() == pieces.count()


def test_stages_stand_odd_rows(spark, sf, odd, nothing):
    extra = odd.withColumn("n_chars", F.length("text").cast("long"))
    for df in (extra, extra.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, sf)
            assert out.columns == df.columns
            df = saved(out, "odd")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    got = QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == want


def test_native_operators_run_no_python(spark, sf):
    for q in (linededup.op4_linededup, licenses.op10_licenses):
        plan = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_each_stage_begins_with_collected_executors(spark, sf):
    def collections():
        return sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())

    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        if name in ("decontamination", "packing"):  # these only plan; the others run jobs of their own before they return
            before = collections()
            assert set(stage(spark, docs, sf).columns) >= {"doc_id"}
            assert collections() > before, name
        assert stage.__wrapped__
