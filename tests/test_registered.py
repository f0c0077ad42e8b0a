"""Queries are registered with the whole number of replicates, models, folds and trials."""

from __future__ import annotations

from calibra.operators import metrics, models, resample
from calibra.params import DEFAULT
from calibra.plans import data, models_eval, risk  # noqa: F401  these register the queries
from calibra.plans.catalog import QUERIES


def arguments(monkeypatch, module, name, query, spark, sf):
    """The arguments, defaults included, that the query gives to the operator."""
    import inspect

    real, seen = getattr(module, name), {}

    def record(*args, **kw):
        bound = inspect.signature(real).bind(*args, **kw)
        bound.apply_defaults()
        seen.update(bound.arguments)
        rows = spark.createDataFrame([], "score double, model string, y double")
        return models.Tuned(None, rows) if name == "tune" else rows

    monkeypatch.setattr(module, name, record)
    QUERIES[query](spark, sf)
    return seen


def test_replicates_and_steps(monkeypatch, spark, sf):
    for name, query in (("paired_bootstrap", "E13_paired_bootstrap"), ("comparison_table", "E14_comparison_table"), ("bootstrap_intervals", "E16_bootstrap_intervals")):
        seen = arguments(monkeypatch, resample, name, query, spark, sf)
        assert seen["replicates"] == DEFAULT.n_bootstrap == 1000
        if name == "comparison_table":
            assert len(seen["candidates"]) == 3 and len(seen["references"]) == 2
    assert arguments(monkeypatch, metrics, "ensemble_search", "E21_ensemble_search", spark, sf)["step"] == 0.05


def test_folds_grids_and_models(monkeypatch, spark, sf):
    monkeypatch.setattr(risk, "features", lambda *_: (None, None))
    monkeypatch.setattr(metrics, "evaluate", lambda rows, *_: rows)
    seen = lambda name, query: arguments(monkeypatch, models, name, query, spark, sf)
    assert seen("out_of_fold", "M06_out_of_fold")["folds"] == 5
    stack = seen("stack", "M07_stacking")
    assert stack["folds"] == 5 and len(stack["specs"]) == 5
    tuned = seen("tune", "M13_S08_tuning_trials")
    assert (tuned["trials"], tuned["folds"], tuned["features"]) == (50, 5, models.FEATURES)
    rolled = seen("rolling_validation", "E18_rolling_refit")
    assert rolled["windows"] == 4 and len(rolled["specs"]) == 5
    nets = seen("stability_selection", "D08_stability_selection")
    assert nets["folds"] == 5 and len(nets["cs"]) * len(nets["l1s"]) == 15


def test_all_features_are_permuted(monkeypatch, spark, sf):
    monkeypatch.setattr(risk, "features", lambda *_: (None, None))
    monkeypatch.setattr(models.Spec, "fit", lambda *_: None)
    assert arguments(monkeypatch, models, "permutation_importance", "M12_permutation_importance", spark, sf)["features"] is None
