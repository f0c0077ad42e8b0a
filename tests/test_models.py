from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from calibra.operators import metrics, models


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    out = []
    for i in range(600):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        out.append((i, date(2024, 1 + i // 60, 1), "Booked", float(rng.random() < 1 / (1 + 2.718 ** -(1.5 * x - 1))), x if i % 11 else None, z))
    return spark.createDataFrame(out, "authorization_id long, mis_date date, status_name string, target double, x double, z double").persist()


@pytest.fixture(scope="module")
def parts(rows):
    return rows.where("mis_date < date'2024-08-01'"), rows.where("mis_date >= date'2024-08-01'")


@pytest.mark.parametrize("name", sorted(models.SPECS))
def test_models_rank_better_than_chance(parts, name):
    assert metrics.evaluate(models.scored(models.SPECS[name], *parts, ["x", "z"])).first()["roc_auc"] > 0.65


def test_calibration_improves_the_brier_score(parts):
    train, test = parts
    spec = models.SPECS["Logistic Regression"]
    fitted = spec.fit(train.where("mis_date < date'2024-06-01'"), ["x", "z"])
    held = train.where("mis_date >= date'2024-06-01'")
    y = test.select("authorization_id", F.col("target").alias("y"))
    brier = lambda m: metrics.evaluate(y.join(m.score(test), "authorization_id").withColumn("model", F.lit("m"))).first()["brier"]
    raw = brier(fitted)
    assert all(brier(models.calibrate(fitted, held, kind)) < raw for kind in ("sigmoid", "isotonic"))


def test_out_of_fold_leaves_the_first_blocks_unscored(rows):
    got = models.out_of_fold(models.SPECS["Logistic Regression"], rows, 3, ["x", "z"])
    assert got.count() < rows.count() and got.select("authorization_id").distinct().count() == got.count()
    assert got.agg(F.min("mis_date")).first()[0] > date(2024, 1, 1)


def test_stacking_prepares_each_fold_once_for_all_models(parts, monkeypatch):
    calls, prepare = [], models.prepare
    monkeypatch.setattr(models, "prepare", lambda *a, **k: calls.append(1) or prepare(*a, **k))
    specs = [models.SPECS["Logistic Regression"], models.SPECS["EBM"]]
    got = models.stack(specs, *parts, 2, ["x", "z"])
    assert metrics.evaluate(got).first()["roc_auc"] > 0.65
    assert len(calls) == 3  # two folds and all training rows


def test_stability_selection_keeps_the_informative_feature(rows):
    got = {r["feature"]: r for r in models.stability_selection(rows, ["x", "z"], 2, (0.03,)).collect()}
    assert got["x"]["frequency"] == 1 and got["x"]["mean_abs"] > got["z"]["mean_abs"]


def test_nets_of_a_fold_share_their_rows_and_one_curve(mixed, monkeypatch):
    written, curves, write, curve = [], [], models._written, models.curve
    monkeypatch.setattr(models, "_written", lambda df, name: written.append(name) or write(df, name))
    monkeypatch.setattr(models, "curve", lambda *a: curves.append(1) or curve(*a))
    got = {r["feature"]: r["frequency"] for r in models.stability_selection(mixed, ["x", "c"], 2, (0.03, 1.0), (0.5,)).collect()}
    assert got == {"x": 1, "c": 1}
    assert len(written) == 4 and len(curves) == 2  # training and held rows of two folds; a curve each


def test_explanations_agree_on_the_driver(parts):
    train, test = parts
    fitted = models.SPECS["Logistic Regression"].fit(train, ["x", "z"])
    for got, col in ((models.linear_contributions(fitted, test, "lr"), "mean_abs"), (models.importance(fitted, "lr"), "importance"), (models.permutation_importance(fitted, test, "lr"), "auc_drop")):
        by = {r["feature"]: r[col] for r in got.collect()}
        assert by["x"] > by["z"]


def test_weights_and_support(rows):
    low, high = models.class_weights(rows)
    n = rows.count()
    p = rows.agg(F.sum("target")).first()[0]
    assert low == pytest.approx(n / (2 * (n - p))) and high == pytest.approx(n / (2 * p))
    assert models.class_weights(rows.withColumn("weight", F.lit(1.0))) == (1.0, 1.0) and models.pos_weight(rows) == pytest.approx((n - p) / p)
    assert models.supported(rows) and not models.supported(rows.where("target = 1"))


def test_conservative_rounds():
    assert models.conservative_rounds([120]) == 120
    assert models.conservative_rounds([]) == 1000
    assert models.conservative_rounds([100, 200, 300, None]) == 150


@pytest.fixture(scope="module")
def mixed(spark, rows):
    return rows.withColumn("c", F.when(F.col("target") == 1, F.when(F.rand(3) < 0.8, "bad").otherwise("good")).otherwise(F.when(F.rand(4) < 0.8, "good"))).persist()


def test_category_encoding_leaves_a_rows_fold_out(spark):
    from calibra.operators.encoders import fit_target_encoding

    rng = random.Random(2)
    data = [(i, rng.choice("abc"), float(rng.random() < 0.4)) for i in range(80)]
    df = spark.createDataFrame(data, "authorization_id long, c string, target double")
    fold = {r[0]: r[1] for r in df.select("authorization_id", F.pmod(F.xxhash64(F.lit("fold"), "authorization_id"), F.lit(5))).collect()}
    enc = fit_target_encoding(df, ["c"])
    assert len(set(fold.values())) == 5

    def smoothed(rows, value):
        prior = sum(y for *_, y in rows) / len(rows)
        own = [y for _, c, y in rows if c == value]
        return (sum(own) + 3 * prior) / (len(own) + 3)

    for r in enc.apply(df, 3.0, training=True).collect():
        rest = [d for d in data if fold[d[0]] != fold[r["authorization_id"]]]
        assert r["enc_c"] == pytest.approx(smoothed(rest, r["c"]))
    own = enc.apply(df, 3.0, training=True).agg(F.avg("enc_c"), F.stddev_pop("enc_c")).first()
    assert enc.spread("c", 3.0) == pytest.approx(tuple(own))
    new = spark.createDataFrame([(1, "a"), (2, "zzz"), (3, None)], "authorization_id long, c string")
    got = {r["authorization_id"]: r["enc_c"] for r in enc.apply(new, 3.0).collect()}
    assert got[1] == pytest.approx(smoothed(data, "a"))
    assert got[2] == got[3] == pytest.approx(sum(y for *_, y in data) / len(data))


def test_model_with_categories_survives_the_store(spark, mixed, tmp_path):
    train, test = mixed.where("mis_date < date'2024-08-01'"), mixed.where("mis_date >= date'2024-08-01'")
    spec = models.SPECS["Logistic Regression"]
    plain = metrics.evaluate(models.scored(spec, train, test, ["x", "z"])).first()["roc_auc"]
    fitted = spec.fit(train, ["x", "z", "c"])
    assert fitted.inputs == ["x", "z", "c"] and fitted.refit(train).inputs == fitted.inputs
    assert metrics.evaluate(models.scored(spec, train, test, ["x", "z", "c"])).first()["roc_auc"] > plain
    fitted.save(f"file://{tmp_path}/m")
    again = models.Fitted.load(spark, f"file://{tmp_path}/m", fitted.features, spec)
    assert sorted(map(tuple, again.score(test).collect())) == sorted(map(tuple, fitted.score(test).collect()))


@pytest.mark.parametrize("name", ["Logistic Regression", "LightGBM"])
def test_tuning_keeps_the_best_trial_and_stops_boosting_early(mixed, name):
    got = models.tune(models.SPECS[name], mixed, 3, 2, ["x", "z", "c"], ceiling=12, at_once=2)
    trials = got.trials.collect()
    best = [r for r in trials if r["best"]]
    assert len(trials) == 3 and len(best) == 1 and not best[0]["pruned"]
    assert best[0]["mean_pr_auc"] == max(r["mean_pr_auc"] for r in trials if not r["pruned"])
    assert all(r["folds"] == 2 for r in trials if not r["pruned"])
    if name == "LightGBM":
        assert got.spec.params["trees"] == best[0]["rounds"] <= 12


def test_tuning_fits_all_linear_trials_of_a_fold_on_one_reading(mixed, monkeypatch):
    spec, features, folds, trials = models.SPECS["Logistic Regression"], ["x", "z", "c"], 2, 4
    weighted = mixed.withColumn("weight", F.lit(0.5) + F.pmod("authorization_id", F.lit(3)))
    written, write, pruned_any = [], models._written, False
    monkeypatch.setattr(models, "_written", lambda df, name: written.append(name) or write(df, name))
    for df in (mixed, weighted):
        written.clear()
        with monkeypatch.context() as m:
            m.setattr(models.Spec, "fit", None)  # no fit of its own for a trial and fold
            got = models.tune(spec, df, trials, folds, features, at_once=1).trials.orderBy("trial").collect()
        assert len(written) == 2 * folds
        alone = []  # the trials one by one in MLlib
        for k in range(1, trials + 1):
            settings, scores, pruned = models.trial_settings(models.SPACES[spec.name], k), [], False
            made = models.replace(spec, params={"c": settings["c"]}, smooth=settings["smooth"])
            for f in models.temporal_folds(df, folds).orderBy("fold").collect():
                train = df.where(F.col("mis_date") < F.lit(f["train_until"]))
                valid = df.where((F.col("mis_date") >= F.lit(f["valid_from"])) & (F.col("mis_date") <= F.lit(f["valid_until"])))
                scores.append(metrics.evaluate(models.scored(made, train, valid, features)).first()["pr_auc"])
                means = sorted(sum(s[: len(scores)]) / len(scores) for s in alone if len(s) >= len(scores))
                if len(scores) < folds and means and sum(scores) / len(scores) < means[len(means) // 2]:
                    pruned = True
                    break
            alone.append(scores)
            assert (got[k - 1]["folds"], got[k - 1]["pruned"]) == (len(scores), pruned)
            assert got[k - 1]["mean_pr_auc"] == pytest.approx(sum(scores) / len(scores), abs=2e-5)
        pruned_any |= any(r["pruned"] for r in got)
    assert pruned_any


def test_newton_finds_the_minimum_of_mllib(mixed):
    import numpy as np

    spec = models.replace(models.SPECS["Logistic Regression"], params={"c": 0.02}, smooth=5.0)
    fitted = spec.fit(mixed, ["x", "z", "c"])
    p = models.prepare(mixed, ["x", "z", "c"])
    known = p.known(5.0)["enc_c"]
    table = (np.array(p.encoding.values("c", 5.0, True)) - known["mean"]) / known["sd"]
    ready = spec.shaped(spec.shell(mixed, p), p, mixed, "target")
    rows = ready.select(F.col("x").alias("x0"), F.col("z").alias("x1"), F.lit(0).alias("k0"), "enc_c", F.col("label").alias("y"), F.col("_weight").alias("w"))
    values = [r[0] for r in rows.select("enc_c").distinct().collect()]
    assert all(min(abs(table - v)) < 1e-9 for v in values)
    place = F.element_at(F.create_map(*(F.lit(x) for i, v in enumerate(values) for x in (v, i))), F.col("enc_c"))
    trials = {7: models.logit.Trial(1 / (0.02 * p.n), [np.array(values)]), 3: models.logit.Trial(1e-9, [np.array(values) * 0])}
    got = models.logit.fit(rows.withColumn("k0", place).drop("enc_c"), 2, trials)
    model = fitted.model.stages[-1]
    assert got[7] == pytest.approx([model.coefficients[2], *model.coefficients[:2], model.intercept], abs=1e-4)
    assert got[3][0] == 0  # a column of zeros


def test_elastic_nets_are_fitted_together_to_the_minimum_of_mllib(mixed, monkeypatch):
    spec = models.SPECS["Logistic Regression"]
    p = models.prepare(mixed, ["x", "z", "c"])
    ready = spec.shaped(spec.shell(mixed, p), p, mixed, "target").cache()
    rows = ready.select(*(F.col(c).alias(f"x{i}") for i, c in enumerate(p.columns)), F.col("label").alias("y"), F.col("_weight").alias("w"))
    grid = [(0.002, 0.8), (0.03, 0.5), (1.0, 0.2)]
    got = models.logit.fit(rows, 3, {i: models.logit.Trial((1 - l1) / (c * p.n), [], l1 / (c * p.n)) for i, (c, l1) in enumerate(grid)})
    for i, (c, l1) in enumerate(grid):
        vector, net = models.logistic(p.columns, c, l1, p.n)
        model = net.setTol(1e-10).setMaxIter(500).fit(vector.transform(ready))
        assert got[i] == pytest.approx([*model.coefficients, model.intercept], abs=1e-4)
    assert got[0][1] == 0  # noise goes
    monkeypatch.setattr(models.LogisticRegression, "fit", None, raising=False)
    assert models.stability_selection(mixed, ["x", "z", "c"], 2, (0.03, 1.0), (0.5,)).count() == 3


def test_ablations_are_fitted_side_by_side(parts, monkeypatch):
    import threading

    both, fit = threading.Barrier(2, timeout=60), models.scored
    monkeypatch.setattr(models, "scored", lambda *a: both.wait() is not None and fit(*a))  # fits one after the other break the barrier
    assert models.ablations(*parts, {"raw": ["x"], "all": ["x", "z"]}).count() == 4


def test_ablations_show_seven_variants(parts):
    sets = {"raw": ["x"], "with engineered": ["x", "z"], "with interactions": ["x", "z"], "candidates": ["x", "z"], "frozen": ["x"]}
    got = {r["variant"]: r for r in models.ablations(*parts, sets).collect()}
    assert set(got) == {*sets, "frozen, uncalibrated", "frozen, sigmoid"}
    assert got["frozen, sigmoid"]["brier"] < got["frozen, uncalibrated"]["brier"]
    assert got["frozen"]["n_features"] == 1
