"""Population bias, adverse impact and reject inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DATE, DEFAULT, ID, STATUS, TARGET, Params
from ..sources.applications import matured
from .binning import bin_of, quantile_edges
from .curves import finite, midranks
from .metrics import r6, thresholds


def population_ks(scores: DataFrame, min_rows: int = 10) -> DataFrame:
    """By model: largest gap between the score distributions of booked and other applicants, with sizes and means.

    p_value is the asymptotic Kolmogorov series.
    """
    rows = scores.where(finite()).withColumn("b", (F.col(STATUS) == "Booked").cast("long"))
    points = rows.groupBy("model", "score").agg(F.sum("b").alias("pos"), F.sum(1 - F.col("b")).alias("neg"))
    up = Window.partitionBy("model").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("model")
    gap = F.abs(F.sum("pos").over(up) / F.nullif(F.sum("pos").over(every), F.lit(0)) - F.sum("neg").over(up) / F.nullif(F.sum("neg").over(every), F.lit(0)))
    ks = points.withColumn("gap", gap).groupBy("model").agg(F.max("gap").alias("ks"))
    side = lambda k: F.when(F.col("b") == k, F.col("score"))
    sizes = rows.groupBy("model").agg(F.count(side(1)).alias("n_booked"), F.count(side(0)).alias("n_other"), F.avg(side(1)).alias("mean_booked"), F.avg(side(0)).alias("mean_other"))
    out = ks.join(sizes, "model").where((F.col("n_booked") >= min_rows) & (F.col("n_other") >= min_rows))
    root = F.sqrt(F.col("n_booked") * F.col("n_other") / (F.col("n_booked") + F.col("n_other")))
    x = (root + 0.12 + 0.11 / root) * F.col("ks")
    series = sum((2 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * x * x) for k in range(1, 21)), F.lit(0.0))
    p = F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
    return out.select("model", r6("ks").alias("ks"), "n_booked", "n_other", r6("mean_booked").alias("mean_booked"), r6("mean_other").alias("mean_other"), r6(p).alias("p_value"))


def selection_correlation(scores: DataFrame, apps: DataFrame, benchmark: str = "risk_score_rf", min_rows: int = 20) -> DataFrame:
    """By model: Pearson and Spearman correlation with the negated benchmark, and a flag on the former."""
    ref = apps.select(ID, (-F.col(benchmark)).alias("ref")).where("ref IS NOT NULL")
    rows = scores.where(finite()).select(ID, "model", "score").join(ref, ID)
    rows = midranks(midranks(rows, ["model"], "score", "rank_score"), ["model"], "ref", "rank_ref")
    out = rows.groupBy("model").agg(F.count("*").alias("n"), F.corr("score", "ref").alias("pearson"), F.corr("rank_score", "rank_ref").alias("spearman")).where(F.col("n") >= min_rows)
    flag = F.when(F.abs("pearson") > 0.90, "HIGH").when(F.abs("pearson") > 0.70, "MODERATE").otherwise("LOW")
    return out.select("model", "n", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"), flag.alias("flag"))


def age_band(age: Column, edges: Sequence[int] = DEFAULT.age_edges) -> Column:
    out = F.when(age < edges[0], None)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out = out.when((age >= a) & (age < b), f"{a}-{b - 1}")
    return out


def adverse_impact(scores: DataFrame, apps: DataFrame, reject_pct: float = 10.0, min_rows: int = 10, edges: Sequence[int] = DEFAULT.age_edges) -> DataFrame:
    """By model and age band: approval rate below the rejection threshold and its ratio to the best band's.

    The observed bad rate is over rows with an outcome; the threshold is over all of them.
    """
    every = scores.where(finite())
    cut = thresholds(every.withColumn("y", F.lit(0.0)), [reject_pct])
    rows = every.join(F.broadcast(cut), "model").join(apps.select(ID, age_band(F.col("age_t1"), edges).alias("age_band")), ID).where("age_band IS NOT NULL")
    out = rows.groupBy("model", "age_band").agg(F.count("*").alias("n"), F.count_if(F.col("score") < F.col("threshold")).alias("approved"), F.avg("y").alias("observed_bad_rate")).where(F.col("n") >= min_rows)
    rate = F.col("approved") / F.col("n")
    ratio = rate / F.nullif(F.max(rate).over(Window.partitionBy("model")), F.lit(0.0))
    return out.select("model", "age_band", "n", "approved", r6(rate).alias("approval_rate"), r6("observed_bad_rate").alias("observed_bad_rate"), r6(ratio).alias("impact_ratio"), F.when(ratio < 0.80, "FAIL").otherwise("PASS").alias("status"))


# ---- reject inference ---------------------------------------------------------------------
def band_edges(booked: DataFrame, params: Params = DEFAULT, score: str = "risk_score_rf") -> DataFrame:
    """edges of the score deciles of matured booked rows before the split; an error if two are equal."""
    rows = booked.where(matured(params) & (F.col(DATE) < F.lit(params.split_date)))
    out = quantile_edges(rows.select(F.col(score).alias("value")), [], params.reject_bins, dedupe=False)
    return out


def band_rates(booked: DataFrame, params: Params = DEFAULT, score: str = "risk_score_rf") -> DataFrame:
    """band, n, bad, rate and the range of source dates, which callers check against leakage."""
    rows = booked.where(matured(params) & (F.col(DATE) < F.lit(params.split_date)) & F.col(score).isNotNull())
    edges = band_edges(booked, params, score).select("edges")
    banded = rows.join(F.broadcast(edges), how="cross").withColumn("band", bin_of(score, "edges", "right"))
    return banded.groupBy("band").agg(F.count("*").alias("n"), F.sum(TARGET).cast("long").alias("bad"), r6(F.avg(TARGET)).alias("rate"), F.min(DATE).alias("source_min_date"), F.max(DATE).alias("source_max_date"))


def reject_rates(booked: DataFrame, rejected: DataFrame, params: Params = DEFAULT, score: str = "risk_score_rf") -> DataFrame:
    """Scored pre-split rejects with their band and assumed bad rate: the band's rate times a multiplier, at most reject_max_rate."""
    edges = band_edges(booked, params, score).select("edges")
    rates = band_rates(booked, params, score).where(F.col("source_max_date") < F.lit(params.split_date)).select("band", "rate")
    rows = rejected.where((F.col(DATE) < F.lit(params.split_date)) & F.col(score).isNotNull()).join(F.broadcast(edges), how="cross").withColumn("band", bin_of(score, "edges", "right")).drop("edges")
    assumed = F.least(F.col("rate") * params.reject_multiplier, F.lit(params.reject_max_rate))
    return rows.join(F.broadcast(rates), "band").withColumn("assumed_rate", r6(assumed)).drop("rate")


def hash_uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that depends on the row alone, not on its place."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 53)) / float(1 << 53)


def first_by_hash(rows: DataFrame, most: int, seed: int, ranges: int = 1 << 12) -> DataFrame:
    """Exactly the `most` rows of least hash (ties by id), or all if there are fewer.

    Rows are counted by range of the hash; ranges that fit go through whole, and only the range
    in which the limit falls is ordered.
    """
    ranged = rows.withColumn("_u", hash_uniform(seed, ID)).withColumn("_range", F.floor(F.col("_u") * ranges).cast("int"))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    counts = counts.withColumn("_before", before).where(F.col("_before") < most)
    joined = ranged.join(F.broadcast(counts), "_range")
    whole = F.col("_before") + F.col("_n") <= most
    cut = joined.where(~whole).withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy("_u", ID)) + F.col("_before")).where(F.col("_place") <= most)
    return joined.where(whole).select(*rows.columns).unionByName(cut.select(*rows.columns))


def pseudo_labels(booked: DataFrame, rejected: DataFrame, n_booked: int, params: Params = DEFAULT) -> DataFrame:
    """At most n_booked * reject_max_ratio rejects, those first in hash order, labelled by hash, with weight reject_weight."""
    kept = first_by_hash(reject_rates(booked, rejected, params), int(n_booked * params.reject_max_ratio), params.seed)
    label = (hash_uniform(params.seed + 1, ID) < F.col("assumed_rate")).cast("double")
    return kept.withColumn(TARGET, label).withColumn("weight", F.lit(params.reject_weight))


def augment(train: DataFrame, labelled: DataFrame) -> DataFrame:
    """Booked rows with weight 1 and pseudo-labelled rejects with theirs."""
    return train.withColumn("weight", F.lit(1.0)).unionByName(labelled.select(*train.columns, "weight"))


def target_source(df: DataFrame) -> DataFrame:
    seen = F.col(TARGET).isNotNull()
    source = F.when((F.col(STATUS) == "Booked") & seen, "observed").when(F.col(STATUS) == "Booked", "immature").otherwise("unobserved")
    return df.withColumn("has_observed_target", seen).withColumn("target_source", source)


def applicant_scores(apps: DataFrame, scores: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Post-split applicants of all decisions with their scores and where their outcome comes from."""
    post = apps.where((F.col(DATE) >= F.lit(params.split_date)) & F.col(STATUS).isin(*params.decision_statuses))
    tagged = target_source(post).select(ID, DATE, STATUS, "target_source", "has_observed_target")
    return tagged.join(scores.select(ID, *(c for c in scores.columns if c.startswith("score__"))), ID).orderBy(DATE, ID)
