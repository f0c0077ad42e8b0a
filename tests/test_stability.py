from __future__ import annotations

import math
import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.operators import bias, governance, stability
from calibra.params import Params
from calibra.streaming import monitor


def values(spark, xs, model="m"):
    return spark.createDataFrame([(model, None if x is None else float(x)) for x in xs], "model string, value double")


def numpy_psi(a, b, bins=10):
    edges = np.percentile(a, np.linspace(0, 100, bins + 1))
    edges[0], edges[-1] = -np.inf, np.inf
    e, o = (np.clip(np.histogram(x, edges)[0] / len(x), 1e-6, None) for x in (a, b))
    return float(np.sum((o - e) * np.log(o / e)))


@pytest.mark.parametrize("kind", ["same", "shifted", "ties"])
def test_psi_equals_numpy(spark, kind):
    rng = np.random.default_rng(0)
    a = rng.normal(0.5, 0.1, 300).round(3) if kind != "ties" else rng.integers(0, 4, 300) / 10
    b = a if kind == "same" else rng.normal(0.8, 0.1, 200).round(3) if kind == "shifted" else rng.integers(0, 5, 200) / 10
    got = stability.psi(values(spark, a), values(spark, b)).first()["psi"]
    assert got == pytest.approx(numpy_psi(a, b), abs=1e-5)
    assert kind != "same" or got == 0


def test_constant_scores(spark):
    assert stability.psi(values(spark, [0.5] * 50), values(spark, [0.5] * 20)).first()["psi"] == pytest.approx(0, abs=1e-6)


def test_csi_unseen_category_and_order(spark):
    rng = random.Random(1)
    base = spark.createDataFrame([(rng.random(), rng.choice("ab"), 1.0) for _ in range(200)], "x double, c string, few double")
    other = spark.createDataFrame([(rng.random() + 5, rng.choice("abz"), 1.0) for _ in range(200)], "x double, c string, few double")
    got = stability.csi(base, other, ["x", "few"], ["c"]).collect()
    assert [r["feature"] for r in got] == ["x", "c"] and got[0]["band"] == "significant" and got[1]["csi"] > 0


def test_woe_sums_to_the_information_value(spark):
    rng = random.Random(2)
    rows = [(rng.random(), rng.choice(["s", "t", None]), float(rng.random() < 0.1)) for _ in range(500)]
    df = spark.createDataFrame(rows, "income double, segment string, target double")
    cells = stability.woe(df, ["income"], ["segment"]).collect()
    iv = {r["feature"]: r for r in stability.information_value(stability.woe(df, ["income"], ["segment"])).collect()}
    assert iv["income"]["iv"] == pytest.approx(sum(r["iv"] for r in cells if r["feature"] == "income"), abs=1e-6)
    assert iv["segment"]["n_bins"] == 2 and sum(r["n"] for r in cells if r["feature"] == "income") == 500


def test_unobserved_applicants_count_for_approval(spark):
    ids = range(40)
    s = spark.createDataFrame([("m", i, None if i < 20 else float(i % 2), i / 40) for i in ids], "model string, authorization_id long, y double, score double")
    apps = spark.createDataFrame([(i, 20.0 if i % 2 else 50.0) for i in ids], "authorization_id long, age_t1 double")
    got = bias.adverse_impact(s, apps).collect()
    assert sum(r["n"] for r in got) == 40 and max(r["impact_ratio"] for r in got) == 1
    assert {r["age_band"] for r in got} == {"18-24", "45-54"}


def test_band_rates_use_rows_before_the_split_only(spark):
    p = Params(split_date=date(2024, 7, 1), maturity_cutoff=date(2025, 1, 1), reject_bins=2)
    rows = [(i, date(2024, 1 + i % 3, 1), "Booked", float(i % 10 == 0), float(i)) for i in range(20)] + [(100 + i, date(2024, 8, 1), "Booked", 1.0, float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "authorization_id long, mis_date date, status_name string, target double, risk_score_rf double")
    got = bias.band_rates(df, p).collect()
    assert {r["rate"] for r in got} == {0.1} and max(r["source_max_date"] for r in got) < p.split_date
    rejected = df.withColumn("status_name", F.lit("Rejected"))
    labelled = bias.pseudo_labels(df, rejected, 10, p)
    assert labelled.where("weight != 0.5 OR target NOT IN (0, 1)").isEmpty() and 0 < labelled.count() <= 20
    assert labelled.orderBy("authorization_id").collect() == bias.pseudo_labels(df.repartition(7), rejected.repartition(3), 10, p).orderBy("authorization_id").collect()


def test_pseudo_labels_never_exceed_the_cap(spark):
    rows = spark.range(500).select(F.col("id").alias("authorization_id"))
    for seed in range(8):
        for most in (0, 1, 137, 499, 500, 900):
            got = bias.first_by_hash(rows, most, seed, ranges=16)
            assert got.count() == min(most, 500)
    order = [r[0] for r in rows.orderBy(bias.hash_uniform(3, "authorization_id")).collect()]
    assert {r[0] for r in bias.first_by_hash(rows, 137, 3, ranges=16).collect()} == set(order[:137])


def test_data_quality_counts_outliers(spark):
    df = spark.createDataFrame([(float(i), "a") for i in range(20)] + [(1000.0, "b"), (None, None)], "x double, c string")
    got = {r["feature"]: r for r in governance.data_quality(df, ["x"], ["c"]).collect()}
    assert got["x"]["n_outliers_iqr"] == 1 and got["x"]["missing_count"] == 1 and got["c"]["n_unique"] == 2


def test_streaming_counts_equal_the_table(spark, tmp_path):
    rng = random.Random(4)
    rows = [(datetime(2024, 1, 1 + k // 40, k % 24), rng.random() * 100) for k in range(200)]
    df = spark.createDataFrame(rows, "ts timestamp, value double")
    df.write.parquet(f"file://{tmp_path}/in")
    edges = [-math.inf, 25.0, 50.0, 75.0, math.inf]
    stream = monitor.binned_counts(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"), edges, window="1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("binned").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    batch = monitor.binned_counts(df, edges, window="1 day")
    assert sorted(map(tuple, spark.table("binned").collect())) == sorted(map(tuple, batch.collect()))
    psi = monitor.psi_by_window(batch, [0.25] * 4).collect()
    assert len(psi) == 5 and all(r["psi"] >= 0 and r["n"] == 40 for r in psi)
