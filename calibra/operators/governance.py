"""Data quality, variable dictionary, benchmark labels and the model card."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import CATEGORICAL, DEFAULT, NUMERIC, Params
from .binning import unpivot
from .metrics import r6


def data_quality(df: DataFrame, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL) -> DataFrame:
    """One row for each feature. Outliers lie beyond 1.5 interquartile ranges of the quartiles.

    Two aggregates over the unpivoted numbers (quartiles, then outliers against them) and one
    over the categories, whatever the number of features.
    """
    num = unpivot(df, [], numeric)
    q = num.groupBy("feature").agg(F.percentile("value", 0.25).alias("q25"), F.percentile("value", 0.75).alias("q75"))
    out = num.join(F.broadcast(q), "feature")
    iqr = F.col("q75") - F.col("q25")
    wide = (F.col("value") < F.col("q25") - 1.5 * iqr) | (F.col("value") > F.col("q75") + 1.5 * iqr)
    missing = F.count_if(F.col("value").isNull())
    a = out.groupBy("feature", "q25", "q75").agg(
        F.count("*").alias("n_rows"), missing.alias("missing_count"), F.countDistinct("value").alias("n_unique"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count_if(wide).alias("n_outliers_iqr"),
    )
    a = a.select("feature", F.lit("numerical").alias("type"), "n_rows", "missing_count", r6(F.col("missing_count") / F.col("n_rows")).alias("missing_pct"), "n_unique", *(r6(c).alias(c) for c in ("mean", "std", "min", "q25", "q75", "max")), "n_outliers_iqr")
    b = unpivot(df, [], categorical, "string").groupBy("feature").agg(F.count("*").alias("n_rows"), missing.alias("missing_count"), F.countDistinct("value").alias("n_unique"))
    none = F.lit(None).cast("double")
    b = b.select("feature", F.lit("categorical").alias("type"), "n_rows", "missing_count", r6(F.col("missing_count") / F.col("n_rows")).alias("missing_pct"), "n_unique", *(none.alias(c) for c in ("mean", "std", "min", "q25", "q75", "max")), F.lit(0).cast("long").alias("n_outliers_iqr"))
    return a.unionByName(b)


def variable_dictionary(features: DataFrame, iv: DataFrame, numeric: Sequence[str], raw: Sequence[str], params: Params = DEFAULT) -> DataFrame:
    """feature (with its provenance), type, source, monotone direction and information value."""
    falling, rising = ([f for f, s in params.monotone.items() if s == sign] for sign in (-1, 1))
    direction = F.when(F.col("feature").isin(falling), "decreasing").when(F.col("feature").isin(rising), "increasing").otherwise("none")
    kind = F.when(F.col("feature").isin(list(numeric)), "numerical").otherwise("categorical")
    return features.join(F.broadcast(iv.select("feature", F.col("iv").alias("information_value"))), "feature", "left").select(
        "feature", kind.alias("type"), F.col("provenance").alias("source"), direction.alias("monotone_constraint"), "information_value",
        F.col("feature").isin(list(raw)).alias("in_raw"), F.col("feature").isin([*falling, *rising]).alias("in_monotone_map"),
    )


def benchmark_result(delta: Column, *p_values: Column) -> Column:
    """ns, win, loss or tie; the first p-value that is not null decides."""
    p = F.coalesce(*p_values)
    return F.when(p >= 0.05, "ns").when(delta > 0, "win").when(delta < 0, "loss").otherwise("tie")


def _lines(df: DataFrame, columns: Sequence[str], limit: int = 30) -> list[str]:
    rows = df.select(*columns).limit(limit).collect()  # a report table, shown in part
    total = df.count() if len(rows) == limit else len(rows)
    fmt = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(fmt(v) for v in r) + " |" for r in rows), *([f"({limit} of {total} rows)"] if total > limit else [])]


def model_card(name: str, params: Params, board: DataFrame, population: DataFrame, iv: DataFrame, stability: DataFrame, impact: DataFrame, comparisons: DataFrame, card: DataFrame, rolling: DataFrame) -> str:
    """Markdown text of ten sections, rendered from result tables and parameters."""
    sections = [
        ("Model", [f"Selected model: {name}"]),
        ("Intended use", ["Ranking of credit applications by probability of default; booked applications are the observed proxy."]),
        ("Data windows", [f"Train before {params.split_date}; selection holdout before {params.selection_date}; outcomes matured by {params.maturity_cutoff}."]),
        ("Population", _lines(population, population.columns)),
        ("Holdout performance", _lines(board, ["model", "roc_auc", "pr_auc", "ks", "brier", "n"])),
        ("Benchmark comparison", _lines(comparisons, ["candidate", "reference", "delta", "p_value", "p_adjusted"])),
        ("Selection", _lines(card, ["model", "weighted", "evidence", "recommended"])),
        ("Stability", [*_lines(stability, ["kind", "name", "value", "band"]), "", *_lines(rolling, ["model", "mean_pr_auc", "std_pr_auc"])]),
        ("Drivers", _lines(iv, ["feature", "iv", "strength"], 15)),
        ("Fairness", _lines(impact.where(F.col("model") == name), ["age_band", "approval_rate", "impact_ratio", "status"])),
    ]
    return "\n".join(f"## {i}. {title}\n\n" + "\n".join(lines) + "\n" for i, (title, lines) in enumerate(sections, 1))
