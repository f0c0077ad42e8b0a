from __future__ import annotations

import collections
import re

import pytest
from pyspark.sql import functions as F

from calibra.llm import licenses, linededup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute_lines(texts, least):
    count = collections.Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if count[key(x)] < least or not key(x)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("least, batches", [(2, 1), (2, 2), (3, 5), (1, 3), (100, 2), (2, 4)])
def test_lines_against_brute_force(odd, least, batches):
    rows = odd.select("doc_id", "text").collect()
    want = sorted(map(repr, ((r["doc_id"], *w) for r, w in zip(rows, brute_lines([r["text"] for r in rows], least), strict=True))))
    got = linededup.dedup_lines(odd, least, batches)
    assert [c for c in got.columns if c not in ("n_lines", "n_dropped")] == odd.columns
    assert sorted(map(repr, (tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()))) == want


def test_runs_count_over_batches_and_levels(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"line {k}" for k in range(12) if i % (k + 1) == 0)) for i in range(40)], "doc_id long, text string")
    runs = linededup.LineRuns(spark, 10, buckets=3)
    for batch in linededup.batches(docs, 7):
        runs.add(batch)
    keys = spark.createDataFrame([(f"line {k}",) for k in range(12)], "k string").select("k", F.xxhash64("k").alias("h1"))
    found = {r["k"] for r in runs.frequent().join(keys, "h1").collect()}
    runs.close()
    assert found == {f"line {k}" for k in range(12) if sum(i % (k + 1) == 0 for i in range(40)) >= 10}


def test_a_bucket_is_one_file_however_many_partitions_there_are(spark, monkeypatch):
    """A cluster may deal rows to more partitions than asked for; thousands of small files then cost memory and time."""
    frame = type(spark.range(0))
    deal, write, files = frame.repartition, linededup.LineRuns._run, []

    def noted(self, df):
        run = write(self, df)
        files.append(len(run.inputFiles()))
        return run

    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols: deal(self, max(n, 11), *cols))
    monkeypatch.setattr(linededup.LineRuns, "_run", noted)
    docs = spark.createDataFrame([(i, "\n".join(f"line {i * k % 97}" for k in range(60))) for i in range(200)], "doc_id long, text string")
    with linededup.LineRuns(spark, 10, buckets=3) as runs:
        for batch in linededup.batches(docs, 4):
            runs.add(batch)
        assert runs.anti_joins and runs.frequent().count()
    assert max(files) <= 3


def test_no_rows(nothing):
    assert linededup.dedup_lines(nothing).count() == 0
    assert licenses.scan(nothing).count() == 0


@pytest.fixture
def written(monkeypatch):
    """The executed plans of all line runs written, and the LineRuns used."""
    plans, made = [], []
    run, init = linededup.LineRuns._run, linededup.LineRuns.__init__

    def keep(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return run(self, df)

    def note(self, *args, **kw):
        made.append(self)
        init(self, *args, **kw)

    monkeypatch.setattr(linededup.LineRuns, "_run", keep)
    monkeypatch.setattr(linededup.LineRuns, "__init__", note)
    return plans, made


def test_the_query_anti_joins_settled_runs_and_compacts(spark, sf, written):
    linededup.op4_linededup(spark, "/root/testdata/sf0.01")
    plans, made = written
    anti, full = ([p for p in plans if kind in p] for kind in ("LeftAnti", "FullOuter"))
    assert len(anti) >= linededup.BATCHES - 1 and made[0].anti_joins >= linededup.BATCHES - 1
    assert full and all("SortMergeJoin" in p for p in anti + full)
    assert all("Exchange" not in p for p in full)  # runs are merged bucket by bucket
    assert any(p.count("Sort ") <= 1 for p in full)  # as sorted as they were written; one sort is the writer's
    assert all(p.count("Exchange") <= 2 for p in anti)  # the counting and the dealing to buckets; none for the settled run
    assert not made[0].paths  # all dropped


def test_runs_are_levelled(spark):
    docs = spark.createDataFrame([(i, f"own {i}\nhot\npair {i // 2}") for i in range(64)], "doc_id long, text string")
    with linededup.LineRuns(spark, 2, buckets=2) as runs:
        for k, batch in enumerate(linededup.batches(docs, 8), 1):
            runs.add(batch)
            for kind in (runs.open, runs.settled):
                assert sum(r is not None for r in kind) <= k.bit_length()  # not a run for each batch
        assert runs.frequent().count() == 1 + 32


def test_failed_counting_leaves_no_runs(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(linededup.LineRuns, "frequent", lambda self: seen.append(dict(self.paths)) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        linededup.frequent_lines(spark.createDataFrame([("a\nb",)] * 3, "text string"), 2)
    assert seen[0] and not any(spark.catalog.tableExists(name) for name in seen[0])


def brute_license(text):
    lower = (text or "").translate(LOWER)
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = pattern.findall(lower)
    places = [(i, label) for label, p in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    best, more = 0.0, set()
    for t in licenses.TEMPLATES:
        for i in range(0, len(w), t.span):
            held = set(w[i : i + 2 * t.span])
            if 100 * len(held & set(t.words)) >= licenses.THRESHOLD * len(t.words) and held.isdisjoint(t.without) and held.issuperset(t.must):
                more.add(t.label)
                best = max(best, len(held & set(t.words)) / len(t.words))
    base = {label for _, label in places}
    first = min((i for i, _ in places), default=None), max((i for i, _ in places), default=None)
    return len(w), len(places), *first, ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if places else best


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
APACHE = """ * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0"""
FAR = " ".join(["all", *["word"] * 1000, "rights", *["word"] * 1000, "reserved"])
LICENSES = [
    "Released under the MIT License.", "under the mit\nlicense under-the-MIT-license", "Licensed under the Apache License, Version 2.0 here", "apache license version 2", "xcc by nc", "CC BY-NC 4.0", "All rights reserved", "rights all\nreserved",
    "permission is granted free of charge to any person obtaining a copy of this software and associated documentation files", "this work is licensed under the gnu general public license version", None, "", "under the mit licenseé",
    MIT, "some words before " * 40 + MIT.replace("sell", "vend") + " and after" * 300, APACHE, "x " * 777 + APACHE, FAR, "released under the gpl license",
    *(t[1] for t in licenses.TEXTS), " \n".join(t[1] for t in licenses.TEXTS),
]


def test_licenses_against_brute_force(spark, odd):
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(LICENSES)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = licenses.scan(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r)[1:] == brute_license(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_wrapped_texts_are_found_and_scattered_words_are_not(spark):
    want = {MIT: "mit", "filler " * 123 + MIT + " tail" * 50: "mit", APACHE: "apache-2", FAR: "", "released under the gpl license": "", licenses.TEXTS[6][1]: "cc-by", licenses.TEXTS[8][1]: "cc-by-nc"}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(want)], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scan(docs).collect()} == dict(enumerate(want.values()))


def test_templates_are_their_own_labels():
    for t, (label, text, _) in zip(licenses.TEMPLATES, licenses.TEXTS, strict=True):
        assert t.label == label in brute_license(text)[5].split(",")
