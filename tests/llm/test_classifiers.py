from __future__ import annotations

import collections
import pathlib
import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.llm import kernels as K
from calibra.llm import quality, rules, toxicity
from calibra.llm.tables import learned, table, training_rows


@pytest.fixture(scope="module")
def big():
    return "/root/testdata/sf0.01"


def held_out_counts(result, labels, target):
    rows = result.where("held_out").join(labels.select("doc_id", target), "doc_id").groupBy(target, "predicted").count().collect()
    return {(r[target], r["predicted"]): r["count"] for r in rows}


def test_toxicity_on_held_out_rows(spark):
    """The fold took no part in learning or in choosing settings."""
    sf = "/root/testdata/sf0.1"
    got = toxicity.op1_toxicity(spark, sf)
    assert got.count() == table(spark, sf, "documents").count() and got.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    c = held_out_counts(got, table(spark, sf, "labels"), "toxic")
    assert c.get((0, 1), 0) <= 0.005 * (c.get((0, 0), 0) + c.get((0, 1), 0))  # clean documents are left alone
    assert c[(1, 1)] >= 0.65 * (c[(1, 1)] + c.get((1, 0), 0))  # recall


def test_quality_on_held_out_rows(spark, big):
    c = held_out_counts(quality.op7_quality(spark, big), table(spark, big, "labels"), "quality")
    right = c.get((0, 0), 0) + c.get((1, 1), 0)
    assert right / sum(c.values()) > 0.95
    assert c.get((1, 0), 0) <= 1


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows_have_scores(odd, labels, module):
    model = module.fit(odd, labels)
    got = module.score(odd, model).collect()
    assert len(got) == odd.count()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (0, 1, 2)} == {next(r["score"] for r in got if r["doc_id"] == 0)}


@pytest.mark.parametrize("module", [toxicity, quality])
def test_empty_tables(nothing, odd, labels, module):
    assert module.score(nothing, module.fit(nothing, labels)).count() == 0
    assert {r["score"] for r in module.score(odd, module.fit(odd, labels.limit(0))).collect()} == {0.5}


def test_accepted_keeps_all_columns(odd, labels):
    got = quality.accepted(odd, quality.fit(odd, labels.limit(0)))
    assert got.columns == odd.columns and got.count() == odd.count()


def test_training_rows_leave_out_the_held_out_fold(odd, labels):
    import zlib

    rows = training_rows(odd, labels, "toxic", 100).collect()
    ids = {i for i in range(18) if zlib.crc32(str(i).encode()) % 5}
    assert len(rows) == len(ids)  # doc_id 3 has two rows, one of which is learned
    assert training_rows(odd, labels, "toxic", 4).count() == 4


def test_learned_coordinates_are_bounded(odd, labels):
    rows = training_rows(odd, labels, "toxic", 100)
    full = learned(rows, toxicity.distinct_features)
    sizes = sorted(len(ids) for _, ids in full)
    some = learned(rows, toxicity.distinct_features, sizes[-1] - 1)
    assert 0 < len(some) < len(full) and sum(len(ids) for _, ids in some) < sizes[-1]


def naive_words(text, pattern):
    return re.findall(pattern, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_toxicity_features_against_brute_force(odd_texts):
    """Equal n-grams have equal coordinates and each document has as many as it has distinct n-grams."""
    seen = {}
    for text in odd_texts:
        w = naive_words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        want = {tuple(w[i + s] for s in steps) + steps[1:] for steps in toxicity.STEPS for i in range(len(w) - steps[-1])}
        want = {g[: 2 if len(g) > 1 else 1] for g in want}  # a skip-gram is its two words, whatever stands between
        data = np.frombuffer((text or "").encode(), np.uint8)
        ids = set(toxicity.distinct_features(data, np.array([0, len(data)]))[1].tolist())
        for g in want:
            raw = " ".join(g).encode() if len(g) == 1 else f"{g[0]} {g[1]}".encode()
            one = np.frombuffer(raw, np.uint8)
            own = toxicity.block_features(one, np.array([0, len(one)]))[1]
            seen[g] = own[len(g) - 1 if len(g) == 1 else 2]
        assert ids == {seen[g] for g in want}


def test_scores_against_brute_force(spark, odd, labels):
    """Both linear models' scores are what a plain sum over each document's coordinates gives."""
    model = toxicity.fit(odd, labels)
    weight = dict(zip(model.ids.tolist(), model.weights.tolist(), strict=True))
    got = {(r["doc_id"], r["score"]) for r in toxicity.score(odd, model).collect()}
    for doc_id, text in odd.select("doc_id", "text").collect():
        data = np.frombuffer((text or "").encode(), np.uint8)
        total = model.bias + sum(weight.get(i, 0.0) for i in set(toxicity.block_features(data, np.array([0, len(data)]))[1].tolist()))
        assert any(i == doc_id and abs(s - 1 / (1 + np.exp(-total))) < 1e-6 for i, s in got)
    model = quality.fit(odd, labels)
    ratio, weight = (dict(zip(model.ids.tolist(), v.tolist(), strict=True)) for v in (model.ratios, model.weights))
    got = {(r["doc_id"], r["score"]) for r in quality.score(odd, model).collect()}
    for doc_id, text in odd.select("doc_id", "text").collect():
        data = np.frombuffer((text or "").encode(), np.uint8)
        ids = [i for i in quality.block_features(data, np.array([0, len(data)]))[1].tolist() if i in ratio]
        norm = max(sum(ratio[i] ** 2 for i in ids) ** 0.5, 1e-12)
        total = model.slope * (sum(ratio[i] * weight[i] for i in ids) / norm + model.bias) + model.offset
        assert any(i == doc_id and abs(s - 1 / (1 + np.exp(-total))) < 1e-5 for i, s in got)


def test_quality_repetition_against_brute_force(odd_texts):
    """Marks of repetition follow from counts over the whole document."""
    for text in odd_texts:
        w = naive_words(text, r"[^\x20\x09-\x0D]+")
        again = sum(a == b for a, b in zip(w, w[1:], strict=False))
        tri = list(zip(w, w[1:], w[2:], strict=False))
        _, want = quality._marks(np.array([again]), np.array([len(tri) - len(set(tri))]), np.array([len(w)]))
        data = np.frombuffer((text or "").encode(), np.uint8)
        assert set(quality._coordinates(want).tolist()) <= set(quality.block_features(data, np.array([0, len(data)]))[1].tolist())


@pytest.mark.parametrize("features", [toxicity.distinct_features, quality.block_features])
def test_slices_of_long_texts_lose_nothing(features, odd_texts, monkeypatch):
    for text in [*odd_texts, "go go go " * 900, "a b a b c " * 500 + "x" * 3000 + " tail"]:
        data = np.frombuffer((text or "").encode(), np.uint8)
        offs = np.array([0, len(data)])
        want = features(data, offs)[1]
        with monkeypatch.context() as m:
            m.setattr(K, "BLOCK", 64)
            m.setattr(K, "slices", lambda d, t, o, cut=K.slices: cut(d, t, o, 64))
            assert np.array_equal(features(data, offs)[1], want)


LONG = """
import resource, sys
import numpy as np
from calibra.llm import kernels, quality, rules, toxicity
vocabulary = np.array([f"w{i}" for i in range(50000)])
raw = bytearray()
rng = np.random.default_rng(1)
while len(raw) < 50 << 20:
    raw += (" ".join(vocabulary[rng.integers(0, 50000, 100000)]) + "\\n").encode()
data = np.frombuffer(raw, np.uint8)
offs = np.array([0, len(data)])
{"toxicity": toxicity.distinct_features, "quality": quality.block_features, "rules": rules.statistics}[sys.argv[1]](data, offs)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""


@pytest.mark.parametrize("operator", ["toxicity", "quality", "rules"])
def test_a_text_of_50_mb_takes_less_than_a_gigabyte(operator):
    out = subprocess.run([sys.executable, "-c", LONG, operator], capture_output=True, text=True, check=True, cwd=pathlib.Path(__file__).parents[2])
    assert int(out.stdout) < 1024


def test_ftrl_keeps_few_weights():
    rng = np.random.default_rng(0)
    rows = [(int(i % 2), np.unique(np.append(rng.integers(10, 1000, 30), 1 if i % 2 else 2)).astype(np.int32)) for i in range(400)]
    bias, ids, w = toxicity.Ftrl(size=1024).fit(rows)
    by = dict(zip(ids.tolist(), w.tolist(), strict=True))
    assert by.get(1, 0) > 0 or by.get(2, 0) < 0
    assert len(ids) < 100


def test_dual_coordinate_descent_separates():
    x = [(np.array([0, 2]), np.array([1.0, 1.0])), (np.array([1, 2]), np.array([1.0, 1.0]))] * 10
    y = np.array([1.0, -1.0] * 10)
    w = quality.dual_coordinate_descent(x, y, np.ones(20), 3, 50, 1)
    assert w[0] + w[2] > 0.9 and w[1] + w[2] < -0.9


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    g = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    marked = {i + k for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


def test_rule_counts_against_brute_force(spark, odd, labels, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    text = collections.defaultdict(list)
    for r in docs.collect():
        text[r["doc_id"]].append(r["text"])
    got = rules.judge(docs, rules.fit(docs, labels)).collect()
    assert len(got) == docs.count()
    for r in got:
        want = brute_counts(text[r["doc_id"]][0])
        assert tuple(r[c] for c in rules.COUNTS) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_rules_without_rows(nothing, labels):
    assert rules.judge(nothing, rules.fit(nothing, labels)).count() == 0


def test_boosting_is_monotonic():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = ((x[:, 0] + 0.3 * rng.random(600)) < 0.6).astype(float)
    model = rules.boost(x, y, np.array([-1, 0, -1]), trees=20)
    grid = np.linspace(-0.1, 1.1, 40)
    for row in x[:30]:
        for j in (0, 2):
            at = np.repeat(row[None], 40, axis=0)
            at[:, j] = grid
            assert (np.diff(model.probability(at)) <= 1e-12).all()
    assert ((model.probability(x) > 0.5) == (y > 0.5)).mean() > 0.8
