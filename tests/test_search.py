"""The search over all raw columns and what is carried from it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from calibra.operators import discovery, encoders, models, search
from calibra.plans import data, models_eval, risk  # noqa: F401  these register the queries
from calibra.plans.catalog import QUERIES
from calibra.plans.data import matured_parts


def auc(pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_all_raw_columns_are_searched(spark, sf):
    board = {r["feature"]: r for r in QUERIES["D06_D07_interaction_leaderboard"](spark, sf).collect()}
    assert len(board) == 45 * 2 + 6 + 10 * 4
    rows = encoders.windowed(matured_parts(spark, sf)[0].where("target IS NOT NULL"), 5).where("window > 0 AND income_t1 != 0 AND total_amt IS NOT NULL")
    pairs = [(r["target"], r["s"]) for r in rows.select("target", (F.col("total_amt") / F.col("income_t1")).alias("s")).collect()]
    got = board["total_amt_DIV_income_t1"]
    if got["auc"] is not None:
        assert abs(got["auc"] - auc(pairs)) < 2e-6 and got["n"] == len(pairs)


def test_discovery_carries_every_family(spark, sf, monkeypatch):
    seen = {}

    def board(found, numeric, categorical, *_):
        seen["columns"] = (len(numeric), len(categorical))
        seen["last"] = found.agg(F.max("mis_date")).first()[0]
        kinds = [("tenor_X_age_t1", "product", "tenor", "age_t1"), ("house_type_x_csp", "cat_concat", "house_type", "csp"), ("BIN_tenor_x_csp", "binned_num_cat", "tenor", "csp")]
        return spark.createDataFrame([(*k, True) for k in kinds], "feature string, type string, a string, b string, selected boolean")

    def select(rows, features, *_):
        seen["features"] = list(features)
        seen["kinds"] = {c: rows.schema[c].dataType.simpleString() for c in features}
        return spark.createDataFrame([(f, i < 3) for i, f in enumerate(features)], "feature string, kept boolean")

    monkeypatch.setattr(search, "search_interactions", board)
    monkeypatch.setattr(models, "stability_selection", select)
    rows = {r["feature"]: r for r in QUERIES["D09_discovery_workflow"](spark, sf).collect()}
    assert seen["columns"] == (10, 4)
    assert seen["kinds"]["house_type_x_csp"] == seen["kinds"]["BIN_tenor_x_csp"] == "string"
    assert {r["feature"] for r in rows.values() if r["kept"]} == set(seen["features"][:3])
    assert {r["provenance"] for r in rows.values()} == {"raw", "engineered", "interaction", "frequency", "group_stat"}
    assert rows["tenor_X_age_t1"]["provenance"] == "interaction" and rows["freq_csp"]["provenance"] == "frequency"
    pruned = [r["feature"] for r in rows.values() if not r["in_candidates"]]
    assert set(rows) == set(pruned) | set(seen["features"])
    assert seen["last"] < matured_parts(spark, sf)[0].agg(F.max("mis_date")).first()[0]


def test_discovery_refuses_a_drifted_partition(spark):
    before = spark.createDataFrame([(1,), (2,)], "authorization_id long")
    discovery.unchanged(before, before)
    for after in ([(1,)], [(1,), (2,), (2,)], [(1,), (3,)]):
        with pytest.raises(ValueError, match="drifted"):
            discovery.unchanged(before, spark.createDataFrame(after, "authorization_id long"))
