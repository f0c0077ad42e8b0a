"""Bootstrap comparisons. Every row draws a Poisson(1) weight for each replicate from a hash of its key,
so replicates are computed where the rows are, alike at any partitioning, and reduce to weighted curves.

Paired tests give both models of a row the same weight; block intervals give a month's rows one
weight. Classes are thus resampled to their size on average rather than exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DATE, DEFAULT, ID
from .bias import hash_uniform
from .curves import finite
from .metrics import delong, evaluate, holm, is_probability, normal_p, r6

#: Cumulative probabilities of Poisson(1) at 0, 1, ...
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)


def poisson(u: Column) -> Column:
    return sum(((u >= c).cast("int") for c in POISSON), F.lit(0))


def replicate_metrics(scores: DataFrame, replicates: int, unit: Sequence[str] = (ID,), seed: int = DEFAULT.seed) -> DataFrame:
    """model, rep, roc_auc, pr_auc, brier of each replicate; replicates without both classes give nulls."""
    rows = scores.where(finite() & F.col("y").isNotNull()).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = poisson(hash_uniform(seed, "rep", *unit))
    p = F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumn("w", w).where("w > 0").withColumn("loss", (p - F.col("y")) * (p - F.col("y")))
    points = rows.groupBy("model", "rep", "score").agg(F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum(F.col("w") * (1 - F.col("y"))).alias("neg"), F.sum(F.col("w") * F.col("loss")).alias("loss"))
    own = Window.partitionBy("model", "rep")
    down = own.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    c = points.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down)})
    P, N = F.sum("pos"), F.sum("neg")
    out = c.groupBy("model", "rep").agg(
        (F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2)) / F.nullif(P * N, F.lit(0.0))).alias("roc_auc"),
        (F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(P, F.lit(0.0))).alias("pr_auc"),
        (F.sum("loss") / (P + N)).alias("brier"),
    )
    probability = scores.groupBy("model").agg(is_probability().alias("p"))
    return out.join(F.broadcast(probability), "model").select("model", "rep", "roc_auc", "pr_auc", F.when(F.col("p"), F.col("brier")).alias("brier"))


def bootstrap_intervals(scores: DataFrame, replicates: int = DEFAULT.n_bootstrap, ci: float = 0.95, by_month: bool = True) -> DataFrame:
    """model and, for each metric, the observed value with a percentile interval."""
    unit = ("month",) if by_month else (ID,)
    rows = scores.withColumn("month", F.trunc(DATE, "month"))
    reps = replicate_metrics(rows, replicates, unit)
    lo, hi = (1 - ci) / 2, (1 + ci) / 2
    bounds = reps.groupBy("model").agg(*(f.alias(f"{m}_{n}") for m in ("roc_auc", "pr_auc", "brier") for n, f in (("lo", F.percentile(m, lo)), ("hi", F.percentile(m, hi)))))
    return evaluate(scores).select("model", "roc_auc", "pr_auc", "brier").join(bounds, "model").select("model", *(r6(f"{m}{s}").alias(f"{m}{s}") for m in ("roc_auc", "pr_auc", "brier") for s in ("", "_lo", "_hi")))


METRICS = ("roc_auc", "pr_auc", "brier")


def _long(df: DataFrame, *keys: str) -> DataFrame:
    """keys, model, metric, v, where more is better: the Brier score changes its sign."""
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), (-F.col(m) if m == "brier" else F.col(m)).alias("v")) for m in METRICS))
    return df.select(*keys, "model", F.explode(cells).alias("c")).select(*keys, "model", "c.metric", "c.v")


def paired_bootstrap(scores: DataFrame, candidates: str | Sequence[str], references: str | Sequence[str], replicates: int = DEFAULT.n_bootstrap, ci: float = 0.95) -> DataFrame:
    """candidate, reference, metric, improvement of the candidate (the other way round for Brier), its interval and p-value.

    All pairs share one set of replicates: a row has the same weight for every model.
    """
    candidates, references = ([x] if isinstance(x, str) else list(x) for x in (candidates, references))
    own = scores.where(F.col("model").isin(*candidates, *references))

    def pairs(values: DataFrame, *keys: str) -> DataFrame:
        a = values.where(F.col("model").isin(*candidates)).withColumnsRenamed({"model": "candidate", "v": "a"})
        b = values.where(F.col("model").isin(*references)).withColumnsRenamed({"model": "reference", "v": "b"})
        return a.join(b, [*keys, "metric"]).select("candidate", "reference", "metric", (F.col("a") - F.col("b")).alias("d"))

    d = pairs(_long(replicate_metrics(own, replicates), "rep"), "rep").where("d IS NOT NULL")
    k = F.count("*")
    tail = F.least((F.count_if(F.col("d") <= 0) + 1) / (k + 1), (F.count_if(F.col("d") >= 0) + 1) / (k + 1))
    stats = d.groupBy("candidate", "reference", "metric").agg(F.percentile("d", (1 - ci) / 2).alias("lo"), F.percentile("d", (1 + ci) / 2).alias("hi"), F.least(F.lit(1.0), 2 * tail).alias("p"), k.alias("n_bootstrap"))
    seen = pairs(_long(evaluate(own))).withColumnRenamed("d", "improvement")
    return seen.join(stats, ["candidate", "reference", "metric"]).select("candidate", "reference", "metric", r6("improvement").alias("improvement"), r6("lo").alias("improvement_lo"), r6("hi").alias("improvement_hi"), r6("p").alias("p_value"), "n_bootstrap")


def comparison_table(scores: DataFrame, candidates: Sequence[str], references: Sequence[str], replicates: int = DEFAULT.n_bootstrap) -> DataFrame:
    """candidate, reference, DeLong's test with Holm-adjusted p-values and the bootstrap intervals of all three metrics; largest gains first."""
    tests = None
    for r in references:
        row = delong(scores, candidates, r)
        tests = row if tests is None else tests.unionByName(row)
    named = {"roc_auc": "delta", "pr_auc": "pr_auc_delta", "brier": "brier_delta"}
    boot = paired_bootstrap(scores, candidates, references, replicates)
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    wide = [pick(m, f"improvement_{side}").alias(f"{name}_{side}") for m, name in named.items() for side in ("lo", "hi")]
    wide += [pick(m, "improvement").alias(name) for m, name in named.items() if m != "roc_auc"]
    wide += [pick(m, "p_value").alias(f"p_bootstrap_{m}") for m in named]
    boot = boot.groupBy("candidate", "reference").agg(*wide, F.max("n_bootstrap").alias("n_bootstrap"))
    out = tests.join(boot, ["candidate", "reference"]).withColumn("p_value", r6(normal_p(F.col("z"))))
    out = out.withColumn("improvement_pct_of_max", r6(100 * F.col("delta") / F.nullif(1 - F.col("auc_reference"), F.lit(0.0))))
    return holm(out, "p_value", tie=("candidate", "reference")).withColumn("p_adjusted", r6("p_adjusted")).orderBy(F.desc("delta"), "candidate", "reference")
