"""Population stability, characteristic stability, weight of evidence and information value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, TARGET
from .binning import bin_of, quantile_edges, unpivot
from .metrics import r6

FLOOR = 1e-6


def psi_term(expected: Column, actual: Column) -> Column:
    """(a - e) ln(a / e) of bin shares floored at a millionth."""
    e, a = F.greatest(expected, F.lit(FLOOR)), F.greatest(actual, F.lit(FLOOR))
    return (a - e) * F.ln(a / e)


def _binned_shares(base: DataFrame, other: DataFrame, keys: Sequence[str], edges: DataFrame) -> DataFrame:
    """keys, bin, expected, actual: every bin of the edges, empty ones with share 0."""
    keys = list(keys)
    spine = edges.select(*keys, F.explode(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0)))).alias("bin"))

    def shares(df: DataFrame, name: str) -> DataFrame:
        n = df.where("value IS NOT NULL").join(F.broadcast(edges), keys).select(*keys, bin_of("value", "edges", "left").alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("c"))
        return n.select(*keys, "bin", (F.col("c") / F.sum("c").over(Window.partitionBy(*keys))).alias(name))

    out = spine.join(shares(base, "expected"), [*keys, "bin"], "left").join(shares(other, "actual"), [*keys, "bin"], "left")
    return out.select(*keys, "bin", F.coalesce("expected", F.lit(0.0)).alias("expected"), F.coalesce("actual", F.lit(0.0)).alias("actual"))


def psi_band(psi: Column) -> Column:
    return F.when(psi < 0.10, "stable").when(psi < 0.25, "moderate").otherwise("significant")


def psi(base: DataFrame, other: DataFrame, keys: Sequence[str] = ("model",), bins: int = DEFAULT.score_bins) -> DataFrame:
    """keys, psi, band of (keys, value) rows. Edges are the base's quantiles, repeated ones kept as empty bins; bins are closed on the left."""
    edges = quantile_edges(base, keys, bins, dedupe=False)
    out = _binned_shares(base, other, keys, edges).groupBy(*keys).agg(F.sum(psi_term(F.col("expected"), F.col("actual"))).alias("psi"))
    return out.select(*keys, r6("psi").alias("psi"), psi_band(F.col("psi")).alias("band"))


def psi_timeline(base: DataFrame, other: DataFrame, period: str, bins: int = DEFAULT.score_bins) -> DataFrame:
    """model, period, n, psi of (model, value, period) rows against the base's quantile bins; the base is binned once for all periods."""
    edges = quantile_edges(base, ["model"], bins, dedupe=False)
    counted = lambda df, keys: df.where("value IS NOT NULL").join(F.broadcast(edges), "model").select(*keys, bin_of("value", "edges", "left").alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("c"))
    share = lambda df, keys, name: df.select(*keys, "bin", (F.col("c") / F.sum("c").over(Window.partitionBy(*keys))).alias(name), F.sum("c").over(Window.partitionBy(*keys)).alias("n"))
    expected = share(counted(base, ["model"]), ["model"], "expected").drop("n")
    actual = share(counted(other, ["model", period]), ["model", period], "actual")
    spine = edges.select("model", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"))
    grid = actual.select("model", period, "n").distinct().join(spine, "model").join(expected, ["model", "bin"], "left").join(actual.drop("n"), ["model", period, "bin"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return grid.groupBy("model", period, "n").agg(r6(F.sum(psi_term(zero("expected"), zero("actual")))).alias("psi"))


def csi(base: DataFrame, other: DataFrame, numeric: Sequence[str], categorical: Sequence[str], bins: int = DEFAULT.score_bins, min_rows: int = 50) -> DataFrame:
    """feature, kind, csi, band, largest first. Numeric features with too few rows or edges are left out."""
    parts = []
    if numeric:
        a, b = unpivot(base, [], numeric), unpivot(other, [], numeric)
        edges = quantile_edges(a, ["feature"], bins).where((F.col("n") >= min_rows) & (F.size("edges") >= 3))
        enough = b.where("value IS NOT NULL").groupBy("feature").agg(F.count("*").alias("m")).where(F.col("m") >= min_rows)
        edges = edges.join(enough.select("feature"), "feature")
        cells = _binned_shares(a, b, ["feature"], edges)
        parts.append(cells.groupBy("feature").agg(F.sum(psi_term(F.col("expected"), F.col("actual"))).alias("csi")).withColumn("kind", F.lit("numeric")))
    if categorical:
        own = Window.partitionBy("feature")

        def shares(df: DataFrame, name: str) -> DataFrame:
            n = unpivot(df, [], categorical, "string").where("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("c"))
            return n.select("feature", "value", (F.col("c") / F.sum("c").over(own)).alias(name))

        cells = shares(base, "expected").join(shares(other, "actual"), ["feature", "value"], "full").na.fill(0.0, ["expected", "actual"])
        parts.append(cells.groupBy("feature").agg(F.sum(psi_term(F.col("expected"), F.col("actual"))).alias("csi")).withColumn("kind", F.lit("categorical")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("feature", "kind", r6("csi").alias("csi"), psi_band(F.col("csi")).alias("band")).orderBy(F.desc("csi"), "feature")


def stability_report(base: DataFrame, other: DataFrame, features: DataFrame) -> DataFrame:
    """Scores' PSI and features' CSI in one table: kind, name, value, band."""
    scores = psi(base, other)
    return scores.select(F.lit("score").alias("kind"), F.col("model").alias("name"), F.col("psi").alias("value"), "band").unionByName(features.select("kind", F.col("feature").alias("name"), F.col("csi").alias("value"), "band"))


def drift_counts(report: DataFrame) -> DataFrame:
    return report.groupBy(F.when(F.col("kind") == "score", "score").otherwise("feature").alias("kind"), "band").agg(F.count("*").alias("n"))


def woe(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], bins: int = DEFAULT.score_bins, y: str = TARGET) -> DataFrame:
    """feature, kind, bin, n, bads, event_rate, woe, iv. Numeric bins are quantiles closed on the right; nulls are left out.

    All numeric features are one unpivoted aggregate, all categorical ones another.
    """
    rows = df.where(F.col(y).isNotNull())
    num = unpivot(rows, [y], numeric).where("value IS NOT NULL")
    edges = quantile_edges(num, ["feature"], bins).where(F.size("edges") >= 2)
    a = num.join(F.broadcast(edges.select("feature", "edges")), "feature").select("feature", F.lit("numeric").alias("kind"), bin_of("value", "edges", "right").cast("string").alias("bin"), y)
    b = unpivot(rows, [y], categorical, "string").where("value IS NOT NULL").select("feature", F.lit("categorical").alias("kind"), F.col("value").alias("bin"), y)
    cells = a.unionByName(b).groupBy("feature", "kind", "bin").agg(F.count("*").alias("n"), F.sum(y).cast("long").alias("bads"))
    own = Window.partitionBy("feature")
    bad = F.col("bads") / F.nullif(F.sum("bads").over(own), F.lit(0))
    good = (F.col("n") - F.col("bads")) / F.nullif(F.sum(F.col("n") - F.col("bads")).over(own), F.lit(0))
    w = F.ln(F.greatest(good, F.lit(FLOOR)) / F.greatest(bad, F.lit(FLOOR)))
    return cells.select("feature", "kind", "bin", "n", "bads", r6(F.col("bads") / F.col("n")).alias("event_rate"), r6(w).alias("woe"), r6((good - bad) * w).alias("iv"))


def iv_strength(iv: Column) -> Column:
    return F.when(iv < 0.02, "not useful").when(iv < 0.1, "weak").when(iv < 0.3, "medium").otherwise("strong")


def information_value(cells: DataFrame) -> DataFrame:
    out = cells.groupBy("feature", "kind").agg(r6(F.sum("iv")).alias("iv"), F.count("*").alias("n_bins"))
    return out.withColumn("strength", iv_strength(F.col("iv"))).orderBy(F.desc("iv"), "feature")
