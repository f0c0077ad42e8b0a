"""Closed-form scorecards and the long score table (one row for each application and model)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import BENCHMARKS, DATE, ID, STATUS, TARGET

_N = lambda c: F.coalesce(c, F.lit(0.0))


def linear_scores() -> dict[str, Column]:
    """Log-odds of three fixed scorecards over application columns: formulas, not fitted models."""
    c = F.col
    return {
        "Scorecard A": -1.6 + 0.000002 * c("total_amt") - 0.00005 * _N("income_t1") + 0.01 * (c("age_t1") - 40),
        "Scorecard B": -1.4 + 0.004 * _N("tenor") + 0.3 * c("income_t2").isNotNull().cast("double") - 0.002 * _N("max_credit_tj_av"),
        "Scorecard C": -1.5 + 0.0005 * _N("installment_amt") + 0.02 * _N("total_card_nbr") - 0.01 * (c("age_t1") - 40),
    }


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def model_scores(calibrated: bool = True) -> dict[str, Column]:
    """Probabilities rounded to six digits, so ties and thresholds do not hang on the last bit."""
    raw = linear_scores()
    out = {name: F.round(sigmoid(z), 6) for name, z in raw.items()}
    if calibrated:
        out |= {f"{name} (calibrated)": F.round(sigmoid(0.5 * z - 0.7), 6) for name, z in raw.items()}
    return out


def long_scores(apps: DataFrame, scores: dict[str, Column] | None = None, benchmarks: bool = True) -> DataFrame:
    """id, date, status, y, model, score. Benchmarks are higher for safer applicants, so they enter negated.

    One pass: the scores of a row are an array that is exploded, with no join.
    """
    scores = model_scores() if scores is None else scores
    every = scores | ({name: -F.col(c) for name, c in BENCHMARKS.items()} if benchmarks else {})
    pairs = F.array(*(F.struct(F.lit(name).alias("model"), s.cast("double").alias("score")) for name, s in every.items()))
    return apps.select(ID, DATE, STATUS, F.col(TARGET).alias("y"), F.explode(pairs).alias("p")).select(ID, DATE, STATUS, "y", "p.model", "p.score")


def wide_scores(scores: DataFrame, models: list[str] | None = None) -> DataFrame:
    """One row for each application with a score__<model> column each."""
    from ..sources.files import sanitize_name

    names = models or sorted(r[0] for r in scores.select("model").distinct().collect())
    wide = scores.groupBy(ID, DATE, STATUS, "y").pivot("model", names).agg(F.first("score"))
    return wide.select(ID, DATE, STATUS, "y", *(F.col(f"`{n}`").alias(f"score__{sanitize_name(n)}") for n in names))
