from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from calibra.functions import features as fx
from calibra.operators import encoders, search
from calibra.params import Params
from calibra.sources import files


def test_ratios_of_zero_and_missing_are_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(fx.ratio(F.col("a"), F.col("b"))).collect()] == [None, None, 0.25]


def test_negative_values_are_clipped_before_the_logarithm(spark):
    df = spark.createDataFrame([(-5.0,), (None,), (0.0,)], "x double")
    assert [r[0] for r in df.select(fx.log1p_positive(F.col("x"))).collect()] == [0.0, None, 0.0]


def test_missing_flags_need_a_rate(spark):
    df = spark.range(1000).select(F.when(F.col("id") >= 5, 1.0).alias("rare"), F.when(F.col("id") >= 20, 1.0).alias("often"))
    assert fx.missing_flags(df, ["rare", "often"]) == ["often"]


def test_stored_bin_edges(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, "x"), (1.5, "x"), (2.0, "y"), (3.0, None), (None, "z")], "A double, B string")
    got = fx.add_interactions(df, [("binned_num_cat", "A", "B", (-inf, 1.5, 2.5, inf))]).collect()
    assert [r["BIN_A_x_B"] for r in got] == ["bin0_x", "bin0_x", "bin1_y", "bin2_missing", "missing_z"]


def test_existing_interactions_are_left_alone(spark):
    df = spark.createDataFrame([(2.0, 4.0, 9.0)], "a double, b double, a_X_b double")
    assert fx.add_interactions(df, [("product", "a", "b", ()), ("ratio", "a", "b", ())]).first().asDict() == {"a": 2.0, "b": 4.0, "a_X_b": 9.0, "a_DIV_b": 0.5}
    assert fx.normalize_interaction("a/b*c") == "a_DIV_b_X_c"
    with pytest.raises(ValueError):
        fx.interaction("sum", "a", "b")


def test_tiers_are_half_open(spark):
    df = spark.createDataFrame([(0.0,), (0.03,), (0.0599,), (0.2,), (1.0,), (1.5,), (-0.1,), (None,)], "p double")
    assert [r[0] for r in df.select(fx.risk_tier(F.col("p"))).collect()] == ["LOW", "MODERATE", "MODERATE", "VERY_HIGH", "VERY_HIGH", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_warnings(spark):
    df = spark.createDataFrame([(None, 5.0), (-1.0, None), (11.0, 3.0)], "a double, b double")
    got = [r[0] for r in df.select(fx.ood_warnings([("a", 0.0, 0.0, 10.0), ("b", 50.0, 0.0, 10.0)])).collect()]
    assert got == [["a: missing"], ["a: below training minimum"], ["a: above training maximum"]]


def test_leave_one_out(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 0.0), ("A", 0.0), ("B", 1.0), ("B", 1.0), ("C", 1.0)], "g string, target double")
    got = sorted((r["g"], r["target"], r["loo"]) for r in encoders.leave_one_out(df, "g").collect())
    assert got[:5] == [("A", 0.0, 0.5), ("A", 0.0, 0.5), ("A", 1.0, 0.0), ("B", 1.0, 1.0), ("B", 1.0, 1.0)]
    assert got[5][2] == pytest.approx(4 / 6)


def test_capping_and_unseen_values(spark):
    train = spark.createDataFrame([(f"v{i:02d}",) for i in range(30) for _ in range(i + 1)], "c string")
    top = encoders.fit_top_categories(train, ["c"], 20)
    other = spark.createDataFrame([("v29",), ("v00",), ("new",), (None,)], "c string")
    assert [r["c"] for r in encoders.cap_categories(other, top, ["c"]).collect()] == ["v29", "Other", "Other", "Other"]
    freq = encoders.fit_frequencies(train, ["c"])
    got = {r["c"]: r["freq_c"] for r in encoders.add_frequencies(other, freq, ["c"]).collect()}
    assert got["new"] == 0 and got[None] == 0 and got["v29"] == pytest.approx(30 / 465)


def test_group_statistics_fall_back(spark):
    train = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("z", 0.0)], "g string, x double")
    other = spark.createDataFrame([("a", 6.0), ("new", 6.0), ("z", 6.0)], "g string, x double")
    got = {r["g"]: r["x_rel_g"] for r in encoders.add_group_stats(other, train, [("x", "g")]).collect()}
    assert got == {"a": 2.0, "new": 3.0, "z": None}


def test_correlated_columns_go_once(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (2.0 * F.col("id")).alias("b"), F.when(F.col("id") > 0, (F.col("id") * 7919) % 13).cast("double").alias("c"))
    assert {r["feature"]: r["kept"] for r in encoders.prune_correlated(df, ["a", "b", "c"]).collect()} == {"a": True, "b": False, "c": True}


def regime(spark):
    """Scores rank well in the first months and badly in the last ones."""
    rows = [(i, date(2024, 1 + i // 10, 1), float(i % 2), float((i % 2) if i < 20 else 1 - i % 2) + (i % 10) / 100, "xy"[i % 2]) for i in range(60)]
    return spark.createDataFrame(rows, "authorization_id long, mis_date date, target double, s double, g string")


def test_power_is_measured_on_later_windows_only(spark):
    p = Params(min_valid=10, min_positive=5)
    rows = encoders.windowed(regime(spark), p.search_windows)
    r = search.guarded_auc(search.numeric_scores(rows, ["s"]), p).first()
    assert r["n"] == 40 and r["auc"] < 0.5
    assert search.guarded_auc(search.numeric_scores(rows, ["s"]), Params(min_valid=41)).first()["auc"] is None


def test_candidates_and_gate(spark):
    assert len(search.candidates(["a", "b", "c"], ["x", "y"])) == 3 * 2 + 1 + 6
    power = spark.createDataFrame([(f"n{i}", "numeric", 0.5, 10, i / 100) for i in range(15)] + [("c", "categorical", None, 5, None)], "feature string, kind string, auc double, n long, power double")
    got = search.gate(power).collect()
    assert len(got) == 12 and min(r["power"] for r in got) == 0.03


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.123456789, 1)], "name string, x double, n int")
    files.write_csv(df, f"file://{tmp_path}/t")
    assert files.read_csv(spark, f"file://{tmp_path}/t", "name string, x double, n int").collect() == [("a", 0.123457, 1)]
    (tmp_path / "tiers.json").write_text('{"HIGH": 1.01, "LOW": 0.1}')
    assert files.read_tiers(spark, f"file://{tmp_path}/tiers.json") == (("LOW", 0.1), ("HIGH", 1.01))
    assert files.sanitize_name("LightGBM (calibrated) v1.2") == "lightgbm_calibrated_v12"
    assert files.model_version("m", 1, ["b", "a"]) == files.model_version("m", 1, ["a", "b"]) != files.model_version("m", 2, ["a", "b"])
