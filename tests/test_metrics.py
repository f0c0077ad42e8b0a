from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from calibra.operators import curves, metrics, resample


def long(spark, **models):
    """model=[(y, score), ...] with ids by place."""
    rows = [(name, i, float(y), None if s is None else float(s)) for name, pairs in models.items() for i, (y, s) in enumerate(pairs)]
    return spark.createDataFrame(rows, "model string, authorization_id long, y double, score double").withColumn("mis_date", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("authorization_id") % 6 * 31).cast("int")))


def auc(pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def average_precision(pairs):
    out, p = 0.0, sum(y for y, _ in pairs)
    for t in sorted({s for _, s in pairs}, reverse=True):
        own, above = [y for y, s in pairs if s == t], [y for y, s in pairs if s >= t]
        out += sum(own) / p * sum(above) / len(above)
    return out


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(1)
    return [(int(rng.random() < 0.3), round(rng.random() * (1 if rng.random() < 0.5 else 0.6), 1)) for _ in range(120)] + [(1, 0.9), (0, 0.1)]


def test_rank_metrics_with_ties(spark, pairs):
    r = metrics.evaluate(long(spark, m=pairs)).first()
    assert r["roc_auc"] == pytest.approx(auc(pairs), abs=1e-6) and r["pr_auc"] == pytest.approx(average_precision(pairs), abs=1e-6)
    assert r["gini"] == pytest.approx(2 * auc(pairs) - 1, abs=2e-6)
    assert r["brier"] == pytest.approx(np.mean([(s - y) ** 2 for y, s in pairs]), abs=1e-6)


def test_two_level_prefix_sums_are_the_same(spark, pairs):
    df = long(spark, m=pairs, k=[(y, round(1 - s, 2)) for y, s in pairs])
    df = df.unionByName(long(spark, wide=[(i % 2, s) for i, s in enumerate((-1e300, -3.0, -1e-9, 0.0, 0.0, 1e-300, 0.2, 0.20000001, 0.2, 7.0, 1e12))]))
    rows = [(r["model"], r["score"], r["y"]) for r in df.collect()]
    for r in curves.curve(df).collect():
        own = [(s, y) for m, s, y in rows if m == r["model"]]
        up = [y for s, y in own if s >= r["score"]]
        assert (r["tp"], r["fp"], r["p"], r["n"]) == (sum(up), len(up) - sum(up), sum(y for _, y in own), sum(1 - y for _, y in own))


def test_ranks_by_score_and_id(spark, monkeypatch):
    monkeypatch.setattr(metrics, "TIE_BITS", 2)  # tied rows lie in several id ranges
    df = long(spark, m=[(i % 2, round((i * 7 % 5) / 10, 1)) for i in range(40)], k=[(i % 2, 0.5) for i in range(21)])
    order = {}
    for r in sorted(df.collect(), key=lambda r: (r["model"], -r["score"], r["authorization_id"])):
        order.setdefault(r["model"], []).append(r["authorization_id"])
    got = metrics.ranked(df).collect()
    assert len(got) == 61 and all(order[r["model"]][r["row"] - 1] == r["authorization_id"] and r["n_total"] == len(order[r["model"]]) for r in got)


def test_no_task_sorts_all_rows_of_a_model(spark, pairs):
    """Windows run by score range, or by score and id range; those by model alone are over totals that were grouped before."""
    df = long(spark, a=pairs, b=pairs)
    for out in (metrics.lift_table(df), metrics.capture_at(df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        numbered = re.findall(r"row_number\(\) windowspecdefinition\((.*?)ASC", plan)
        assert numbered and all("score#" in w and "_ids#" in w for w in numbered)
    for out in (metrics.threshold_analysis(df), metrics.delong(df, "a", "b"), metrics.evaluate(df)):
        assert "row_number()" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_midranks(spark):
    values = [3.0, 1.0, 3.0, 2.0, 3.0, -1.0]
    df = spark.createDataFrame([(i, "m", v) for i, v in enumerate(values)], "i int, model string, score double")
    got = {r["i"]: r["rank"] for r in curves.midranks(df, ["model"], "score", "rank").collect()}
    assert [got[i] for i in range(6)] == [5.0, 2.0, 5.0, 3.0, 5.0, 1.0]


def test_comparisons_of_all_metrics_and_pairs(spark, pairs):
    rng = np.random.default_rng(5)
    noisy = [(y, round(float(rng.random()), 3)) for y, _ in pairs]
    rows = resample.comparison_table(long(spark, a=pairs, b=noisy, r=[(y, 0.5) for y, _ in pairs]), ["a", "b"], ["r"], 60).collect()
    assert [r["candidate"] for r in rows] == sorted((r["candidate"] for r in rows), key=lambda c: -next(x["delta"] for x in rows if x["candidate"] == c))
    for r in rows:
        assert r["n_bootstrap"] <= 60 and r["p_adjusted"] >= r["p_value"]
        assert r["delta_lo"] <= r["delta_hi"] and r["pr_auc_delta_lo"] <= r["pr_auc_delta_hi"] and r["brier_delta_lo"] <= r["brier_delta_hi"]
        alone = {x["metric"]: x for x in resample.paired_bootstrap(long(spark, a=pairs, b=noisy, r=[(y, 0.5) for y, _ in pairs]), r["candidate"], "r", 60).collect()}
        assert (alone["brier"]["improvement_lo"], alone["pr_auc"]["p_value"]) == (r["brier_delta_lo"], r["p_bootstrap_pr_auc"])


def test_ks_of_perfect_and_constant_scores(spark):
    got = {r["model"]: r for r in metrics.evaluate(long(spark, perfect=[(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], constant=[(0, 0.5), (1, 0.5)])).collect()}
    assert got["perfect"]["ks"] == 1 and got["constant"]["ks"] == 0 and got["constant"]["roc_auc"] == 0.5


def test_single_class_and_missing_scores_give_nulls(spark):
    got = {r["model"]: r for r in metrics.evaluate(long(spark, one=[(1, 0.1), (1, 0.2)], some=[(1, None), (0, 0.2), (1, 2.5)])).collect()}
    assert got["one"]["roc_auc"] is None and got["one"]["brier"] is not None
    assert got["some"]["n"] == 2 and got["some"]["brier"] is None


def test_lift_table(spark):
    rng = random.Random(2)
    rows = [(0, rng.uniform(0.1, 0.5)) for _ in range(80)] + [(1, rng.uniform(0.4, 0.9)) for _ in range(23)]
    got = metrics.lift_table(long(spark, m=rows)).orderBy("decile").collect()
    assert [r["n_accounts"] for r in got] == [10] * 9 + [13]
    assert got[-1]["capture_rate"] == 1 and got[-1]["cum_lift"] == 1 and got[0]["lift"] > 1
    few = metrics.lift_table(long(spark, m=rows[:4] + rows[-2:])).collect()
    assert sum(r["n_accounts"] for r in few) == 6


def test_thresholds_reject_one_more_than_the_share(spark):
    rows = [(i % 2, i / 100) for i in range(100)]
    for r in metrics.threshold_analysis(long(spark, m=rows)).collect():
        assert r["n_rejected"] == math.ceil(r["reject_pct"]) + 1
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == 100


def test_delong_against_its_definition(spark, pairs):
    other = [(y, round((s * 7 + i * 0.13) % 1, 2)) for i, (y, s) in enumerate(pairs)]
    r = metrics.delong(long(spark, a=pairs, b=other), "a", "b").first()

    def parts(x):
        pos, neg = [s for y, s in x if y], [s for y, s in x if not y]
        k = lambda p, n: (p > n) + 0.5 * (p == n)
        return np.array([np.mean([k(p, n) for n in neg]) for p in pos]), np.array([np.mean([k(p, n) for p in pos]) for n in neg])

    (a1, a0), (b1, b0) = parts(pairs), parts(other)
    se = math.sqrt(np.var(a1 - b1, ddof=1) / len(a1) + np.var(a0 - b0, ddof=1) / len(a0))
    assert r["delta"] == pytest.approx(auc(pairs) - auc(other), abs=1e-6) and r["se"] == pytest.approx(se, abs=1e-6)
    assert r["z"] == pytest.approx((auc(pairs) - auc(other)) / se, abs=1e-3)


def test_identical_scores_do_not_differ(spark, pairs):
    df = long(spark, a=pairs, b=pairs)
    r = metrics.delong(df, "a", "b").first()
    assert r["delta"] == 0 and r["z"] is None
    for row in resample.paired_bootstrap(df, "a", "b", 40).collect():
        assert row["improvement"] == 0 and row["p_value"] == 1


def test_separated_scores_differ(spark):
    rng = random.Random(3)
    good = [(0, rng.uniform(0, 0.4)) for _ in range(60)] + [(1, rng.uniform(0.6, 1)) for _ in range(40)]
    bad = [(y, rng.random()) for y, _ in good]
    row = resample.paired_bootstrap(long(spark, a=good, b=bad), "a", "b", 100).where("metric = 'roc_auc'").first()
    assert row["improvement"] > 0 and row["improvement_lo"] > 0 and row["p_value"] < 0.05


def test_intervals_bracket_the_point(spark, pairs):
    r = resample.bootstrap_intervals(long(spark, m=pairs), 100).first()
    assert r["roc_auc_lo"] <= r["roc_auc"] <= r["roc_auc_hi"] and r["pr_auc_lo"] < r["pr_auc_hi"]


def test_poisson_weights_have_mean_one(spark):
    from calibra.operators.bias import hash_uniform

    r = spark.range(20000).select(resample.poisson(hash_uniform(1, "id")).alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert r[0] == pytest.approx(1, abs=0.03) and r[1] == pytest.approx(1, abs=0.06)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(0, 1)), min_size=1, max_size=6))
def test_holm(spark, ps):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
    got = {r["i"]: r["p_adjusted"] for r in metrics.holm(df, "p", tie=("i",)).collect()}
    known = sorted((p, i) for i, p in enumerate(ps) if p is not None)
    top = 0.0
    for k, (p, i) in enumerate(known):
        top = max(top, min(1.0, p * (len(known) - k)))
        assert got[i] == pytest.approx(top)
    assert all(got[i] is None for i, p in enumerate(ps) if p is None)


def test_normal_p(spark):
    for z, want in ((0.0, 1.0), (1.96, 0.0499958), (-2.5758, 0.0100002)):
        assert spark.range(1).select(metrics.normal_p(F.lit(z))).first()[0] == pytest.approx(want, abs=2e-6)


def test_drift_is_flagged(spark):
    rows = [("falling", w, 0.30 - 0.02 * w) for w in range(1, 5)] + [("steady", w, 0.30 + 0.001 * w) for w in range(1, 5)] + [("falling (calibrated)", 1, 0.5)]
    got = {r["model"]: r for r in metrics.concept_drift(spark.createDataFrame(rows, "model string, window int, pr_auc double")).collect()}
    assert set(got) == {"falling", "steady"} and got["falling"]["drifting"] and not got["steady"]["drifting"]
    assert got["falling"]["slope"] == pytest.approx(-0.02)


def test_scorecard_lets_evidence_decide_within_the_band(spark):
    board = spark.createDataFrame([("A", 0.30, 0.70, 0.1), ("B", 0.299, 0.70, 0.1), ("C", 0.1, 0.6, 0.2)], "model string, pr_auc double, roc_auc double, brier double")
    over = spark.createDataFrame([("A", 0.0), ("B", 0.0), ("C", 0.2)], "model string, auc_delta double")
    roll = spark.createDataFrame([("A", 0.2), ("B", 0.2), ("C", 0.1)], "model string, mean_pr_auc double")
    comp = spark.createDataFrame([("A", 0.02, -0.01, 0.5), ("B", 0.02, 0.01, 0.01), ("C", -0.1, -0.2, 0.9)], "candidate string, delta double, delta_lo double, p_adjusted double")
    got = {r["model"]: r for r in metrics.model_scorecard(board, over, roll, comp, ["A", "B", "C"]).collect()}
    assert got["A"]["weighted"] > got["B"]["weighted"] and got["B"]["recommended"] and not got["A"]["recommended"]
    assert got["B"]["evidence"] == "strong" and got["A"]["evidence"] == "point_only" and got["C"]["evidence"] == "none"
    assert got["C"]["generalization"] == 0.0
