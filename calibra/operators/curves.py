"""The prefix-sum kernel: per-threshold counts of long scores, and the ranking metrics made from them.

Scores are first collapsed to distinct values, so ties are exact and the ordered step is as
short as the number of distinct scores. Prefix sums are taken in two levels, inside score ranges
and over the ranges' totals, so one huge model does not put all its scores into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("model",)


def finite(score: str = "score") -> Column:
    x = F.col(score)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def distinct_scores(scores: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, score, pos, neg over rows with a finite score and an outcome."""
    rows = scores.where(finite() & F.col("y").isNotNull())
    return rows.groupBy(*keys, "score").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum((1 - F.col("y")).cast("long")).alias("neg"))


def score_range(score: Column) -> Column:
    """A whole number that never falls as the score rises: some 256 ranges for each factor of e."""
    return F.when(score == 0, 0).otherwise(F.signum(score) * (F.floor(256 * F.ln(F.abs(score))) + 200_000)).cast("int")


def falling_sums(points: DataFrame, keys: Sequence[str], names: Sequence[str], score: str = "score") -> DataFrame:
    """Adds, for each name, <name>_upto (its sum over the key's scores at or above) and <name>_all (over the key).

    points has a row for each key and distinct score. Sums run inside score ranges and over the
    ranges' totals, so no task sorts all scores of a key.
    """
    ranged = points.withColumn("_part", score_range(F.col(score)))
    totals = ranged.groupBy(*keys, "_part").agg(*(F.sum(n).alias(n) for n in names))
    above = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    offsets = totals.select(*keys, "_part", *(F.coalesce(F.sum(n).over(above), F.lit(0)).alias(f"_{n}_above") for n in names), *(F.sum(n).over(every).alias(f"{n}_all") for n in names))
    down = Window.partitionBy(*keys, "_part").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumns({f"_{n}_in": F.sum(n).over(down) for n in names})
    out = inside.join(offsets, [*keys, "_part"]).withColumns({f"{n}_upto": F.col(f"_{n}_in") + F.col(f"_{n}_above") for n in names})
    return out.select(*points.columns, *(f"{n}_{what}" for n in names for what in ("upto", "all")))


def curve(scores: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, score, pos, neg, tp, fp (counts at or above the score), p and n (all of the key)."""
    sums = falling_sums(distinct_scores(scores, keys), keys, ["pos", "neg"])
    return sums.withColumnsRenamed({"pos_upto": "tp", "neg_upto": "fp", "pos_all": "p", "neg_all": "n"})


def midranks(rows: DataFrame, keys: Sequence[str], score: str, out: str) -> DataFrame:
    """The rows with the mean rank of their score (from 1, rising) among the key's rows, from counts of distinct scores."""
    points = rows.groupBy(*keys, score).agg(F.count("*").alias("_n"))
    sums = falling_sums(points, keys, ["_n"], score)
    rank = F.col("_n_all") - F.col("_n_upto") + (F.col("_n") + 1) / 2
    return rows.join(sums.select(*keys, score, rank.alias(out)), [*keys, score])


def ranking_metrics(points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, roc_auc, pr_auc, ks, n_rows, n_pos of a curve; null where a class is missing."""
    p, n = F.first("p"), F.first("n")
    both = (p > 0) & (n > 0)
    auc = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2)) / (p * n).cast("double")
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / p
    ks = F.max(F.abs(F.try_divide(F.col("tp"), F.col("p")) - F.try_divide(F.col("fp"), F.col("n"))))
    return points.groupBy(*keys).agg(F.when(both, auc).alias("roc_auc"), F.when(both, ap).alias("pr_auc"), F.when(both, ks).alias("ks"), (p + n).alias("n_rows"), p.alias("n_pos"))


def curve_points(scores: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, score, fpr, tpr, precision: the ROC and precision-recall curves, a row for each threshold."""
    c = curve(scores, keys)
    return c.select(*keys, "score", F.try_divide(F.col("fp"), F.col("n")).alias("fpr"), F.try_divide(F.col("tp"), F.col("p")).alias("tpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
