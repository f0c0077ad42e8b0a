"""The tables behind charts and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import STATUS
from .metrics import r6

MODEL_ORDER = ["Logistic Regression", "EBM", "LightGBM", "XGBoost", "CatBoost"]


def kpi_tiles(coverage: DataFrame, board: DataFrame, model: str) -> DataFrame:
    """label, value of the headline numbers."""
    post = F.col("split") == "post_split"
    status = lambda s: F.sum(F.when(post & (F.col(STATUS) == s), F.col("n")).otherwise(0))
    counts = coverage.agg(F.sum(F.when(post, F.col("n")).otherwise(0)).alias("scored"), *(status(s).alias(s.lower()) for s in ("Booked", "Rejected", "Canceled")), F.sum(F.when(post, F.col("n_bad")).otherwise(0)).alias("observed_bads"))
    held = board.where(F.col("model") == model).agg(F.max("n").alias("holdout_rows"))
    names = ("scored", "booked", "rejected", "canceled", "holdout_rows", "observed_bads")
    cells = F.array(*(F.struct(F.lit(c).alias("label"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("value")) for c in names))
    return counts.join(F.broadcast(held), how="cross").select(F.explode(cells).alias("t")).select("t.*")


def population_bars(coverage: DataFrame, statuses: Sequence[str] = ("Booked", "Rejected", "Canceled")) -> DataFrame:
    """split, a column for each status, total."""
    wide = coverage.groupBy("split").pivot(STATUS, list(statuses)).agg(F.sum("n")).na.fill(0)
    return wide.select("split", *(F.col(s).alias(s.lower()) for s in statuses), sum((F.col(s) for s in statuses), F.lit(0)).cast("long").alias("total"))


def ordered_models(board: DataFrame, order: Sequence[str] = MODEL_ORDER) -> DataFrame:
    """Raw models in the charts' fixed order, others after them by name."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("model")), F.lit(0)), F.lit(len(order) + 1))
    own = board.where(~F.col("model").contains("(calibrated)") & ~F.col("model").contains("Ensemble"))
    return own.withColumn("position", place.cast("int")).orderBy("position", "model")


def raw_vs_calibrated(board: DataFrame) -> DataFrame:
    """model, raw and calibrated Brier scores of models that have both."""
    raw = board.where(~F.col("model").contains("(calibrated)")).select("model", F.col("brier").alias("brier_raw"))
    cal = board.where(F.col("model").contains("(calibrated)")).select(F.regexp_replace("model", r" \(calibrated\)$", "").alias("model"), F.col("brier").alias("brier_calibrated"))
    return raw.join(cal, "model").where("brier_raw IS NOT NULL").withColumn("improvement", r6(F.col("brier_raw") - F.col("brier_calibrated")))


def gains(lift: DataFrame) -> DataFrame:
    """model, share of accounts, share of bads captured: cumulative, from 0."""
    up = Window.partitionBy("model").orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    rows = lift.select("model", "decile", r6(F.sum("n_accounts").over(up) / F.sum("n_accounts").over(Window.partitionBy("model"))).alias("population"), F.col("capture_rate").alias("captured"))
    start = lift.select("model").distinct().select("model", F.lit(0).alias("decile"), F.lit(0.0).alias("population"), F.lit(0.0).alias("captured"))
    return start.unionByName(rows)


def executive_summary(board: DataFrame, capture: DataFrame) -> DataFrame:
    """The best raw model by PR-AUC with its metrics and its capture in the riskiest tenth."""
    own = board.where(~F.col("model").contains("(benchmark)") & ~F.col("model").contains("(calibrated)"))
    best = own.agg(F.max_by(F.struct("model", "roc_auc", "pr_auc", "ks"), F.struct("pr_auc", "roc_auc")).alias("b")).select("b.*")
    return best.join(capture, "model").select("model", "roc_auc", "pr_auc", "ks", F.col("capture").alias("capture_at_10"))


def top_drivers(importance: DataFrame, top: int = 10) -> DataFrame:
    """The features of largest absolute importance of each model."""
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc(F.abs("importance")), "feature"))
    return importance.withColumn("rank", rank).where(F.col("rank") <= top)


def report_facts(board: DataFrame, overfit: DataFrame, lift: DataFrame, impact: DataFrame, model: str) -> DataFrame:
    """One row of derived figures: worst peer, capture of the top two deciles, concentration, failing bands."""
    peers = overfit.where(F.col("model") != model).agg(F.max_by("model", F.struct("auc_delta", "model")).alias("worst_peer"), F.max("auc_delta").alias("worst_peer_delta"))
    own = lift.where(F.col("model") == model).agg(F.max(F.when(F.col("decile") <= 2, F.col("capture_rate"))).alias("top2_capture"), F.max(F.when(F.col("decile") == 1, F.col("lift"))).alias("top_lift"))
    bands = impact.where((F.col("model") == model) & (F.col("status") == "FAIL")).agg(F.count("*").alias("n_failing"), F.array_join(F.array_sort(F.collect_list("age_band")), ", ").alias("failing_bands"))
    best = board.where(~F.col("model").rlike("calibrated|Ensemble")).agg(F.max_by("model", F.struct("roc_auc", "model")).alias("best_auc_model"), F.max_by("model", F.struct("pr_auc", "model")).alias("best_pr_model"))
    return best.join(peers, how="cross").join(own, how="cross").join(bands, how="cross")
