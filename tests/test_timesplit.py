from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from calibra.operators import timesplit as T
from calibra.sources.applications import load_population, nan_to_null


def blocks(spark, months, each, weights=None):
    rows = [(m * each + k, date(2024, m + 1, 1), float(k % 2), "Booked", (weights or {}).get(m, [1.0] * each)[k]) for m in range(months) for k in range(each)]
    return spark.createDataFrame(rows, "authorization_id long, mis_date date, target double, status_name string, weight double")


def dates(df):
    return sorted({r["mis_date"] for r in df.collect()})


def test_calibration_takes_whole_last_blocks(spark):
    df = T.calibration_split(blocks(spark, 6, 2).drop("weight"), 0.25)
    assert dates(df.where("part = 'calibration'")) == [date(2024, 5, 1), date(2024, 6, 1)]


def test_calibration_counts_rows_of_full_weight_only(spark):
    df = T.calibration_split(blocks(spark, 4, 2, {3: [0.5, 0.5]}), 0.20)
    assert dates(df.where("part = 'calibration' AND weight = 1.0")) == [date(2024, 3, 1)]
    assert dates(df.where("part = 'calibration'")) == [date(2024, 3, 1), date(2024, 4, 1)]


def test_discovery_is_the_first_half(spark):
    df = T.discovery_split(blocks(spark, 6, 2), 0.50)
    assert dates(df.where("window = 'discovery'")) == [date(2024, m, 1) for m in (1, 2, 3)]
    with pytest.raises(ValueError):
        T.discovery_cutoff(df, 1.0)


def test_expanding_folds_share_no_dates(spark):
    df = blocks(spark, 6, 3)
    folds = T.expanding_folds(df, 4).orderBy("fold").collect()
    assert len(folds) == 4
    for a, b in zip(folds, folds[1:], strict=False):
        assert a["valid_until"] < b["valid_from"]
    assert folds[-1]["valid_until"] == date(2024, 6, 1)
    assert all(f["train_until"] == f["valid_from"] > date(2024, 1, 1) for f in folds)


def test_folds_are_limited_by_blocks(spark):
    assert T.temporal_folds(blocks(spark, 4, 2), 5).count() == 3
    with pytest.raises(ValueError):
        T.temporal_folds(blocks(spark, 2, 2))


def test_rolling_windows_larger_first(spark):
    got = T.rolling_windows(blocks(spark, 9, 1), 4, 2).orderBy("window").collect()
    assert [r["n_blocks"] for r in got] == [2, 2, 2, 1]
    assert got[0]["valid_from"] == date(2024, 3, 1)
    assert T.rolling_windows(blocks(spark, 5, 2), 4, 2).count() == 3


def test_fold_members_repeat_training_rows(spark):
    df = blocks(spark, 5, 2)
    rows = T.fold_members(df, T.rolling_windows(df, 3, 2)).groupBy("window", "role").count().collect()
    assert {(r["window"], r["role"]): r["count"] for r in rows} == {(1, "train"): 4, (1, "valid"): 2, (2, "train"): 6, (2, "valid"): 2, (3, "train"): 8, (3, "valid"): 2}


def test_population_summary_with_weights(spark):
    r = T.population_summary(blocks(spark, 2, 2, {1: [0.5, 0.5]})).first()
    assert (r["n"], r["n_pos"], r["n_booked"], r["n_pseudo"]) == (4, 2, 2, 2)


def test_empty_holdout_is_an_error(spark):
    with pytest.raises(ValueError):
        T.checked_holdouts(blocks(spark, 3, 2))


def test_population_modes(spark):
    df = blocks(spark, 2, 2).withColumn("status_name", F.when(F.col("authorization_id") == 0, "Rejected").otherwise("Booked"))
    assert load_population(df, "booked_monitoring")[1] is None
    assert [p.count() for p in load_population(df, "underwriting")] == [3, 1]
    with pytest.raises(ValueError):
        load_population(df, "other")


def test_nan_becomes_null(spark):
    df = nan_to_null(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double"))
    assert df.where("x IS NULL").count() == 2
