"""Evaluation tables over long scores (model, y, score). Everything ranks through the curve kernel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DATE, DEFAULT, ID, Params
from .curves import curve, falling_sums, finite, ranking_metrics

_desc = lambda *c: [F.col(x).desc_nulls_last() for x in c]


def r6(x: Column | str) -> Column:
    return F.round(x, 6)


def is_probability(score: str = "score") -> Column:
    """Aggregate: all scores finite and within [0, 1]."""
    x = F.col(score)
    return F.bool_and(finite(score) & (x >= 0) & (x <= 1 + 1e-9))


def evaluate(scores: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """keys, roc_auc, gini, ks, pr_auc, n, brier. One class alone gives nulls; scores that are no probabilities have no Brier score."""
    rank = ranking_metrics(curve(scores, keys), keys)
    y, p = F.col("y"), F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))
    rows = scores.where(finite() & y.isNotNull())
    brier = rows.groupBy(*keys).agg(F.when(is_probability(), F.avg((p - y) * (p - y))).alias("brier"))
    out = rank.join(brier, list(keys))
    return out.select(*keys, r6("roc_auc").alias("roc_auc"), r6(2 * F.col("roc_auc") - 1).alias("gini"), r6("ks").alias("ks"), r6("pr_auc").alias("pr_auc"), F.col("n_rows").alias("n"), r6("brier").alias("brier"))


def leaderboard(scores: DataFrame) -> DataFrame:
    return evaluate(scores).orderBy(*_desc("pr_auc"), "model")


def official_models(board: DataFrame, reject_inference: bool = False) -> DataFrame:
    """Adds is_experimental: named so, or trained with inferred rejects and no benchmark."""
    named = F.col("model").contains("(experimental)")
    return board.withColumn("is_experimental", named | (F.lit(reject_inference) & ~F.col("model").contains("(benchmark)")))


#: Consecutive ids whose rows with one score are ordered in one task.
TIE_BITS = 16


def ranked(scores: DataFrame, keys: Sequence[str] = ("model",), order: str = "row") -> DataFrame:
    """Rows with a finite score and outcome, with their rank by falling score (ties by id) and the number of rows.

    The rank is the rows above the score, plus those of the same score in earlier id ranges, plus
    the place among the score's rows in the id range; only the last is a window over rows.
    """
    rows = scores.where(finite() & F.col("y").isNotNull()).withColumn("_ids", F.shiftright(ID, TIE_BITS))
    cells = rows.groupBy(*keys, "score", "_ids").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys, "score").orderBy("_ids").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_tied": F.sum("_n").over(Window.partitionBy(*keys, "score"))})
    sums = falling_sums(cells.groupBy(*keys, "score").agg(F.sum("_n").alias("_n")), keys, ["_n"]).select(*keys, "score", "_n_upto", "_n_all")
    cells = cells.join(sums, [*keys, "score"]).select(*keys, "score", "_ids", (F.col("_n_upto") - F.col("_tied") + F.col("_before")).alias("_ahead"), F.col("_n_all").alias("n_total"))
    place = F.row_number().over(Window.partitionBy(*keys, "score", "_ids").orderBy(ID))
    return rows.join(cells, [*keys, "score", "_ids"]).withColumn(order, place + F.col("_ahead")).drop("_ids", "_ahead")


def lift_table(scores: DataFrame, deciles: int = 10) -> DataFrame:
    """By model and decile of falling score; the last decile takes the remainder."""
    size = F.floor(F.col("n_total") / deciles)
    decile = F.when(size == 0, deciles).otherwise(F.least(F.floor((F.col("row") - 1) / F.nullif(size, F.lit(0))) + 1, F.lit(deciles))).cast("int")
    cells = ranked(scores).withColumn("decile", decile).groupBy("model", "decile").agg(F.count("*").alias("n_accounts"), F.sum("y").alias("bads"))
    up = Window.partitionBy("model").orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("model")
    cells = cells.withColumns({"cn": F.sum("n_accounts").over(up), "cb": F.sum("bads").over(up), "tn": F.sum("n_accounts").over(every), "tb": F.sum("bads").over(every)})
    rate, cum, base = F.col("bads") / F.col("n_accounts"), F.col("cb") / F.col("cn"), F.nullif(F.col("tb") / F.col("tn"), F.lit(0.0))
    zero = lambda x: r6(F.coalesce(x, F.lit(0.0)))
    return cells.select(
        "model", "decile", "n_accounts", F.col("bads").cast("long").alias("n_defaults"), r6(rate).alias("default_rate"), r6(cum).alias("cum_default_rate"),
        zero(rate / base).alias("lift"), zero(cum / base).alias("cum_lift"), zero(F.col("cb") / F.nullif(F.col("tb"), F.lit(0.0))).alias("capture_rate"),
    )


def thresholds(scores: DataFrame, pcts: Sequence[float] = DEFAULT.threshold_pcts) -> DataFrame:
    """model, reject_pct, threshold: the score of 0-based rank ceil(n pct / 100), the last one at most."""
    counts = scores.where(finite() & F.col("y").isNotNull()).groupBy("model", "score").agg(F.count("*").alias("n"))
    points = falling_sums(counts, ["model"], ["n"])
    cuts = F.array(*(F.struct(F.lit(float(p)).alias("reject_pct"), F.least(F.ceil(F.col("n_all") * p / 100), F.col("n_all") - 1).alias("at")) for p in pcts))
    here = (F.col("n_upto") - F.col("n") <= F.col("c.at")) & (F.col("c.at") < F.col("n_upto"))
    return points.withColumn("c", F.explode(cuts)).where(here).select("model", "c.reject_pct", F.col("score").alias("threshold"))


def threshold_analysis(scores: DataFrame, pcts: Sequence[float] = DEFAULT.threshold_pcts) -> DataFrame:
    """Confusion counts and rates where scores at or above a threshold are rejected."""
    cuts = thresholds(scores, pcts)
    rows = scores.where(finite() & F.col("y").isNotNull()).join(F.broadcast(cuts), "model")  # a row for each model and percentage
    bad, hit = F.col("y") == 1, F.col("score") >= F.col("threshold")
    out = rows.groupBy("model", "reject_pct", "threshold").agg(
        F.count_if(hit).alias("n_rejected"), F.count("*").alias("n_total"), F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & bad).alias("fn"), F.count_if(~hit & ~bad).alias("tn")
    )
    share = lambda a, b: r6(F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0)))
    return out.select(
        "model", "reject_pct", "threshold", "n_rejected", "n_total", "tp", "fp", "fn", "tn", share("tp", F.col("tp") + F.col("fp")).alias("precision"),
        share("tp", F.col("tp") + F.col("fn")).alias("recall"), share("fp", F.col("fp") + F.col("tn")).alias("fpr"), share("tp", F.col("tp") + F.col("fn")).alias("capture_rate"),
    )


def capture_at(scores: DataFrame, share: float = 0.10) -> DataFrame:
    """model, capture: share of the bads among the ceil(share n) highest scores."""
    top = F.col("row") <= F.ceil(F.col("n_total") * share)
    return ranked(scores).groupBy("model").agg(r6(F.sum(F.when(top, F.col("y")).otherwise(0.0)) / F.nullif(F.sum("y"), F.lit(0.0))).alias("capture"))


# ---- paired tests -------------------------------------------------------------------------
def structural_components(scores: DataFrame) -> DataFrame:
    """model, id, y, v: DeLong's components (of positives over negatives and of negatives over positives), from counts of distinct scores."""
    rows = scores.where(finite() & F.col("y").isNotNull()).select("model", ID, "y", "score")
    over_negatives = (F.col("n") - F.col("fp") + F.col("neg") / 2) / F.nullif(F.col("n"), F.lit(0))
    under_positives = (F.col("tp") - F.col("pos") / 2) / F.nullif(F.col("p"), F.lit(0))
    sums = curve(rows).select("model", "score", over_negatives.alias("_up"), under_positives.alias("_down"))
    return rows.join(sums, ["model", "score"]).select("model", ID, "y", F.when(F.col("y") == 1, F.col("_up")).otherwise(F.col("_down")).alias("v"))


def delong(scores: DataFrame, candidates: str | Sequence[str], reference: str) -> DataFrame:
    """A row for each candidate: both AUCs, their difference, its standard error and z. Null z where a class has fewer than two rows or the error is 0."""
    candidates = [candidates] if isinstance(candidates, str) else list(candidates)
    parts = structural_components(scores.where(F.col("model").isin(*candidates, reference)))
    own = F.collect_list(F.when(F.col("model") != reference, F.struct("model", "v")))  # one for each candidate
    both = parts.groupBy(ID, "y").agg(own.alias("own"), F.max(F.when(F.col("model") == reference, F.col("v"))).alias("b"))
    both = both.where("b IS NOT NULL").select("y", "b", F.explode("own").alias("c")).select(F.col("c.model").alias("candidate"), "y", F.col("c.v").alias("a"), "b")
    both = both.where("a IS NOT NULL").withColumn("d", F.col("a") - F.col("b"))
    pos, neg = F.col("y") == 1, F.col("y") == 0
    of = lambda f, c, which: f(F.when(which, F.col(c)))
    out = both.groupBy("candidate").agg(
        of(F.avg, "a", pos).alias("auc_candidate"), of(F.avg, "b", pos).alias("auc_reference"), of(F.var_samp, "d", pos).alias("vp"), of(F.var_samp, "d", neg).alias("vn"),
        F.count_if(pos).alias("m"), F.count_if(neg).alias("n"),
    )
    se = F.sqrt(F.col("vp") / F.col("m") + F.col("vn") / F.col("n"))
    delta = F.col("auc_candidate") - F.col("auc_reference")
    out = out.withColumn("se", F.when((F.col("m") >= 2) & (F.col("n") >= 2), se)).withColumn("delta", delta)
    z = F.when(F.col("se") > 1e-12, F.col("delta") / F.col("se"))
    return out.select("candidate", F.lit(reference).alias("reference"), r6("auc_candidate").alias("auc_candidate"), r6("auc_reference").alias("auc_reference"), r6("delta").alias("delta"), r6("se").alias("se"), F.round(z, 4).alias("z"))


def normal_p(z: Column) -> Column:
    """Two-sided normal p-value, by the complementary error function's rational approximation (Numerical Recipes, error below 1.2e-7)."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def holm(df: DataFrame, p: str, keys: Sequence[str] = (), out: str = "p_adjusted", tie: Sequence[str] = ()) -> DataFrame:
    """Holm-Bonferroni: running maximum of p (m - i), at most 1; null p-values stay null and do not count."""
    own = Window.partitionBy(*keys, F.col(p).isNull())
    ordered = own.orderBy(p, *tie)
    scaled = F.col(p) * (F.count(p).over(own) - F.row_number().over(ordered) + 1)
    df = df.withColumn("_scaled", scaled)
    return df.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("_scaled").over(ordered.rowsBetween(Window.unboundedPreceding, 0))))).drop("_scaled")


# ---- comparisons over time and models -----------------------------------------------------
def overfit_report(train: DataFrame, test: DataFrame, limit: float = 0.03) -> DataFrame:
    """Train and test metrics of each model with their differences; overfit if AUC or PR-AUC falls by more than the limit."""
    a = train.select("model", *(F.col(c).alias(f"train_{c}") for c in ("roc_auc", "pr_auc", "brier")))
    b = test.select("model", *(F.col(c).alias(f"test_{c}") for c in ("roc_auc", "pr_auc", "brier")))
    out = a.join(b, "model").withColumns({"auc_delta": r6(F.col("train_roc_auc") - F.col("test_roc_auc")), "pr_delta": r6(F.col("train_pr_auc") - F.col("test_pr_auc")), "brier_delta": r6(F.col("test_brier") - F.col("train_brier"))})
    return out.withColumn("overfit", (F.col("auc_delta") > limit) | (F.col("pr_delta") > limit))


def rolling_metrics(scores: DataFrame, windows: DataFrame) -> DataFrame:
    """evaluate() by window and model on the rows each window validates."""
    inside = (F.col(DATE) >= F.col("valid_from")) & (F.col(DATE) <= F.col("valid_until"))
    return evaluate(scores.join(F.broadcast(windows), inside), ("window", "model"))


def rolling_summary(rolling: DataFrame) -> DataFrame:
    aggs = [f(c).alias(f"{n}_{c}") for c in ("roc_auc", "pr_auc", "brier") for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    out = rolling.groupBy("model").agg(F.countDistinct("window").alias("n_folds"), *aggs)
    return out.select("model", "n_folds", *(F.round(c, 8).alias(c) for c in out.columns[2:]))  # four values of six digits end in the eighth


def concept_drift(rolling: DataFrame, metric: str = "pr_auc", fall: float = -0.02) -> DataFrame:
    """Slope, range and first-to-last change of a metric over windows, for models that are not calibrated variants."""
    own = rolling.where(~F.col("model").contains("(calibrated)") & F.col(metric).isNotNull())
    out = own.groupBy("model").agg(
        F.count("*").alias("k"), F.regr_slope(metric, "window").alias("fitted"), F.min_by(metric, "window").alias("first"), F.max_by(metric, "window").alias("last"), (F.max(metric) - F.min(metric)).alias("range")
    )
    change = F.col("last") - F.col("first")
    slope = F.when(F.col("k") >= 3, F.col("fitted")).when(F.col("k") == 2, change / (F.col("k") - 1))
    out = out.withColumns({"slope": r6(slope), "change": r6(change), "range": r6("range")})
    return out.select("model", F.col("k").alias("n_folds"), "slope", "change", "range", F.coalesce((F.col("slope") < 0) & (F.col("change") < fall), F.lit(False)).alias("drifting"))


def ensemble_search(scores: DataFrame, linear: str, trees: Sequence[str], step: float = 0.05) -> DataFrame:
    """tree, weight, pr_auc of every blend weight*linear + (1-weight)*tree, best first: all blends in one grouped curve."""
    wide = scores.where(F.col("model").isin(linear, *trees)).groupBy(ID, "y").pivot("model", [linear, *trees]).agg(F.first("score"))
    count = round(1 / step) + 1
    grid = F.array(*(F.struct(F.lit(t).alias("tree"), F.lit(round(k * step, 6)).alias("weight"), (k * step * F.col(f"`{linear}`") + (1 - k * step) * F.col(f"`{t}`")).alias("score")) for t in trees for k in range(count)))
    blends = wide.select("y", F.explode(grid).alias("g")).select("y", "g.*")
    return ranking_metrics(curve(blends, ("tree", "weight")), ("tree", "weight")).select("tree", "weight", r6("pr_auc").alias("pr_auc"), F.row_number().over(Window.orderBy(F.desc(r6("pr_auc")), "tree", "weight")).alias("rank"))


def min_max_score(x: str, higher: bool = True) -> Column:
    """0..100 over all candidates; 50 where missing or where all are equal."""
    every = Window.partitionBy()
    lo, hi = F.min(x).over(every), F.max(x).over(every)
    best = (F.col(x) - lo) if higher else (hi - F.col(x))
    return F.coalesce(F.when(hi > lo, best / (hi - lo) * 100), F.lit(50.0))


def model_scorecard(board: DataFrame, overfit: DataFrame, rolling: DataFrame, comparisons: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Weighted scores of candidate models and the recommended one.

    Weights: discrimination 35, calibration 15, stability 20, generalization 15, benchmark lift 15.
    Scores are rounded to one decimal before the band of two points below the best is drawn; in
    the band, the strength of the evidence against benchmarks decides first. The tables have one
    row for each model, so the windows here run over a handful of rows.
    """
    names = F.col("model").isin(*candidates)
    base = board.where(names).select("model", "pr_auc", "roc_auc", "brier")
    calibrated = board.where(F.col("model").contains(" (calibrated)")).select(F.regexp_replace("model", r" \(calibrated\)$", "").alias("model"), F.col("brier").alias("brier_calibrated"))
    cand = comparisons.where(F.col("candidate").isin(*candidates))
    strong = F.max((F.col("p_adjusted") <= 0.05) & (F.col("delta_lo") > 0))
    lifts = cand.groupBy(F.col("candidate").alias("model")).agg(F.max("delta").alias("best_lift"), F.max("delta_lo").alias("conservative_lift"), strong.alias("strong"))
    span = cand.agg(F.min("delta").alias("lift_min"), F.max("delta").alias("lift_max"))
    out = base.join(calibrated, "model", "left").join(overfit.select("model", "auc_delta"), "model", "left").join(rolling.select("model", "mean_pr_auc"), "model", "left").join(lifts, "model", "left").join(F.broadcast(span), how="cross")
    out = out.withColumn("used_brier", F.coalesce("brier_calibrated", "brier"))
    lift = F.coalesce(F.when(F.col("lift_max") > F.col("lift_min"), (F.col("best_lift") - F.col("lift_min")) / (F.col("lift_max") - F.col("lift_min")) * 100), F.lit(50.0))
    penalty = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("auc_delta") - 0.01) / 0.09 * 100))
    tier = F.when(F.col("strong"), 3).when(F.col("conservative_lift") > 0, 2).when(F.col("best_lift") > 0, 1).otherwise(0)
    parts = {"discrimination": min_max_score("pr_auc"), "calibration": min_max_score("used_brier", False), "stability": min_max_score("mean_pr_auc"), "generalization": F.coalesce(100 - penalty, F.lit(100.0)), "lift": lift}
    out = out.withColumns(parts).withColumn("tier", tier)
    weights = {"discrimination": 0.35, "calibration": 0.15, "stability": 0.20, "generalization": 0.15, "lift": 0.15}
    total = sum((w * F.col(c) for c, w in weights.items()), F.lit(0.0))
    out = out.withColumn("weighted", F.round(total, 1)).withColumns({c: F.round(c, 1) for c in weights})
    out = out.withColumn("in_band", F.col("weighted") >= F.max("weighted").over(Window.partitionBy()) - 2.0)
    order = ["tier", "conservative_lift", "generalization", "calibration", "discrimination", "stability", "weighted", "pr_auc", "roc_auc"]
    place = F.row_number().over(Window.orderBy(F.desc("in_band"), *_desc(*order), "model"))
    evidence = F.element_at(F.array(*map(F.lit, ("none", "point_only", "supported", "strong"))), F.col("tier") + 1)
    return out.select("model", *weights, "weighted", "tier", evidence.alias("evidence"), "in_band", (place == 1).alias("recommended"))


def reliability(scores: DataFrame, bins: int = 10) -> DataFrame:
    """model, bin, mean_score, observed_rate, n over quantile bins closed on the left; equal-width bins if there are fewer than three edges."""
    from .binning import bin_of, quantile_edges

    rows = scores.where(finite() & F.col("y").isNotNull())
    edges = quantile_edges(rows, ["model"], bins, "score")
    span = rows.groupBy("model").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    even = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / bins)
    edges = edges.join(span, "model").select("model", F.when(F.size("edges") < 3, F.array_distinct(even)).otherwise(F.col("edges")).alias("edges"))
    binned = rows.join(F.broadcast(edges), "model").withColumn("bin", bin_of("score", "edges", "left"))
    return binned.groupBy("model", "bin").agg(F.avg("score").alias("mean_score"), r6(F.avg("y")).alias("observed_rate"), F.count("*").alias("n"))


def histogram(scores: DataFrame, bins: int = 50) -> DataFrame:
    """model, y, bin (from 0), n, density over equal-width bins of each model's range."""
    rows = scores.where(finite() & F.col("y").isNotNull())
    span = rows.groupBy("model").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col("score") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    cells = rows.join(F.broadcast(span), "model").withColumns({"bin": F.coalesce(at, F.lit(0)).cast("int"), "width": width}).groupBy("model", "y", "bin", "width").agg(F.count("*").alias("n"))
    every = F.sum("n").over(Window.partitionBy("model", "y"))
    return cells.select("model", "y", "bin", "n", r6(F.col("n") / (every * F.nullif("width", F.lit(0.0)))).alias("density"))


def selected_model(board: DataFrame, card: DataFrame | None = None, params: Params = DEFAULT) -> DataFrame:
    """The recommended model of a scorecard, else the one with the best PR-AUC, then AUC, among those that are no benchmarks."""
    if card is not None:
        return card.where("recommended").select("model")
    own = board.where(~F.col("model").contains("(benchmark)"))
    return own.agg(F.max_by("model", F.struct("pr_auc", "roc_auc")).alias("model"))
