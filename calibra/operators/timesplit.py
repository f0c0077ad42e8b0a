"""Leakage-free splits by whole date blocks. Blocks are counted once; a split is a row of boundary dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DATE, DEFAULT, STATUS, TARGET, Params
from ..sources.applications import matured


def temporal_split(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Matured rows with split = train (before the split date) or test."""
    return df.where(matured(params)).withColumn("split", F.when(F.col(DATE) < F.lit(params.split_date), "train").otherwise("test"))


def holdout_split(test: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Test rows with holdout = selection (before the selection date) or final."""
    return test.withColumn("holdout", F.when(F.col(DATE) < F.lit(params.selection_date), "selection").otherwise("final"))


def checked_holdouts(test: DataFrame, params: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(selection, final); an error if either is empty."""
    both = holdout_split(test, params)
    parts = tuple(both.where(F.col("holdout") == name).drop("holdout") for name in ("selection", "final"))
    for name, part in zip(("selection", "final"), parts, strict=True):
        if part.isEmpty():
            raise ValueError(f"the {name} holdout has no rows")
    return parts


def date_blocks(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """date, n, cum (rows up to the date), total, block (from 1), blocks: hundreds of rows at most."""
    counts = df.groupBy(*keys, DATE).agg(F.count("*").alias("n"))
    up = Window.partitionBy(*keys).orderBy(DATE)
    every = Window.partitionBy(*keys)
    return counts.select(
        *keys, DATE, "n", F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.sum("n").over(every).alias("total"),
        F.row_number().over(up).alias("block"), F.count("*").over(every).alias("blocks"),
    )


def discovery_cutoff(df: DataFrame, fraction: float = DEFAULT.discovery_fraction) -> DataFrame:
    """discovery_end: the first date by which the fraction of all rows has come."""
    if not 0 < fraction < 1:
        raise ValueError("the discovery fraction must lie between 0 and 1")
    target = F.greatest(F.lit(1), F.ceil(F.col("total") * fraction))
    return date_blocks(df).where((F.col("blocks") >= 2) & (F.col("cum") >= target)).agg(F.min(DATE).alias("discovery_end"))


def discovery_split(df: DataFrame, fraction: float = DEFAULT.discovery_fraction) -> DataFrame:
    """Rows with window = discovery (up to the cutoff) or estimation."""
    return df.join(F.broadcast(discovery_cutoff(df, fraction)), how="cross").withColumn("window", F.when(F.col(DATE) <= F.col("discovery_end"), "discovery").otherwise("estimation")).drop("discovery_end")


def calibration_start(df: DataFrame, fraction: float = DEFAULT.calibration_fraction) -> DataFrame:
    """calibration_start: the latest date from which on at least the fraction of rows lies.

    With a `weight` column only rows of weight 1 count; all rows from the date on are calibration.
    """
    counted = df.where(F.col("weight") == 1.0) if "weight" in df.columns else df
    tail = F.col("total") - F.col("cum") + F.col("n")
    return date_blocks(counted).where(tail >= F.greatest(F.lit(1), F.ceil(F.col("total") * fraction))).agg(F.max(DATE).alias("calibration_start"))


def calibration_split(df: DataFrame, fraction: float = DEFAULT.calibration_fraction) -> DataFrame:
    return df.join(F.broadcast(calibration_start(df, fraction)), how="cross").withColumn("part", F.when(F.col(DATE) >= F.col("calibration_start"), "calibration").otherwise("fit")).drop("calibration_start")


def expanding_folds(df: DataFrame, folds: int) -> DataFrame:
    """fold, train_until (exclusive), valid_from, valid_until (inclusive) of expanding-window folds.

    Cut j lies after the block in which the rows reach the share j / (folds + 1), but at least a
    block after the cut before and early enough to leave a block for every later fold. All of
    it runs over the block table: `max(raw - j) + j` over the cuts so far is the first rule.
    """
    blocks = date_blocks(df)
    cuts = df.sparkSession.range(1, folds + 1).select(F.col("id").alias("j"))
    share = F.col("total") * F.col("j") / (folds + 1)
    raw = blocks.join(F.broadcast(cuts), how="cross").groupBy("j").agg((F.count_if(F.col("cum") < share) + 1).alias("raw"), F.first("blocks").alias("m"))
    order = Window.orderBy("j")  # as many rows as folds
    placed = raw.withColumn("cut", F.least(F.max(F.col("raw") - F.col("j")).over(order) + F.col("j"), F.col("m") - (folds - F.col("j") + 1)))
    placed = placed.withColumn("end", F.coalesce(F.lead("cut").over(order), F.col("m")))
    start = blocks.select((F.col("block") - 1).alias("cut"), F.col(DATE).alias("valid_from"))
    last = blocks.select(F.col("block").alias("end"), F.col(DATE).alias("valid_until"))
    out = placed.join(start, "cut").join(last, "end")
    return out.select((F.col("j") - 1).cast("int").alias("fold"), F.col("valid_from").alias("train_until"), "valid_from", "valid_until")


def temporal_folds(df: DataFrame, max_folds: int = DEFAULT.cv_folds) -> DataFrame:
    """Expanding folds, as many as the blocks allow; at least three blocks are needed."""
    blocks = df.select(DATE).distinct().count()
    if blocks < 3:
        raise ValueError("temporal folds need three date blocks")
    return expanding_folds(df, min(max_folds, blocks - 1))


def rolling_windows(df: DataFrame, windows: int = DEFAULT.rolling_windows, min_train_blocks: int = DEFAULT.min_train_blocks, keys: Sequence[str] = ()) -> DataFrame:
    """window (from 1), valid_from, valid_until, blocks: date blocks after the first ones in near-equal runs, larger runs first.

    Training dates of a window are all before valid_from.
    """
    rest = date_blocks(df, keys).where(F.col("block") > min_train_blocks).withColumn("i", F.col("block") - min_train_blocks - 1).withColumn("m", F.col("blocks") - min_train_blocks)
    k = F.least(F.lit(windows), F.col("m"))
    size, extra = F.floor(F.col("m") / k), F.col("m") % k
    window = F.when(F.col("i") < extra * (size + 1), F.floor(F.col("i") / (size + 1))).otherwise(extra + F.floor((F.col("i") - extra * (size + 1)) / size))
    return rest.withColumn("window", (window + 1).cast("int")).groupBy(*keys, "window").agg(F.min(DATE).alias("valid_from"), F.max(DATE).alias("valid_until"), F.count("*").alias("n_blocks"))


def fold_members(df: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows repeated for each window they train or validate (role); windows are a handful of rows, broadcast."""
    inside = (F.col(DATE) >= F.col("valid_from")) & (F.col(DATE) <= F.col("valid_until"))
    return df.join(F.broadcast(windows), F.col(DATE) <= F.col("valid_until")).withColumn("role", F.when(inside, "valid").otherwise("train"))


def population_summary(df: DataFrame) -> DataFrame:
    """n, n_pos, rate, dates; with a weight column also booked and pseudo-labelled rows."""
    y = F.col(TARGET)
    aggs = [F.count("*").alias("n"), F.count_if(y == 1).alias("n_pos"), F.round(F.avg(y), 6).alias("bad_rate"), F.min(DATE).alias("min_date"), F.max(DATE).alias("max_date")]
    if "weight" in df.columns:
        aggs += [F.count_if(F.col("weight") == 1.0).alias("n_booked"), F.count_if(F.col("weight") != 1.0).alias("n_pseudo")]
    return df.agg(*aggs)


def population_coverage(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """By split, status and group: rows, observed, bad, dates."""
    split = F.when(F.col(DATE) < F.lit(params.split_date), "pre_split").otherwise("post_split")
    group = F.when(F.col(STATUS) == "Booked", "booked").otherwise("not_booked")
    return (
        df.select(split.alias("split"), STATUS, group.alias("population_group"), TARGET, DATE)
        .groupBy("split", STATUS, "population_group")
        .agg(F.count("*").alias("n"), F.count(TARGET).alias("n_observed"), F.count_if(F.col(TARGET) == 1).alias("n_bad"), F.min(DATE).alias("min_date"), F.max(DATE).alias("max_date"))
        .orderBy("split", STATUS)
    )
