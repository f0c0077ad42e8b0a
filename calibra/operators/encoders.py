"""Encoders fitted on training rows and applied to others. A fitted encoder is a small DataFrame or a list."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DATE, DEFAULT, ID, TARGET, Params
from .binning import unpivot
from .timesplit import date_blocks, rolling_windows

#: The pairs of the group-relative statistic.
GROUP_PAIRS = [("income_t1", "csp"), ("income_t1", "product_type_3"), ("total_amt", "product_type_3"), ("max_credit_tj_av", "house_type"), ("installment_amt", "csp"), ("age_t1", "house_type")]


# ---- cardinality cap ----------------------------------------------------------------------
def fit_top_categories(train: DataFrame, columns: Sequence[str], top: int = DEFAULT.max_categories) -> DataFrame:
    """feature, value: the most frequent values of each column; ties by value. One aggregate for all columns."""
    counts = unpivot(train, [], columns, "string").where("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).select("feature", "value", "n", "rank")


def _by_feature(fitted: DataFrame, value: str = "value") -> dict[str, list]:
    rows = fitted.groupBy("feature").agg(F.sort_array(F.collect_list(value)).alias("values")).collect()
    return {r["feature"]: r["values"] for r in rows}


def cap_categories(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values outside the fitted ones, and nulls, become Other. At most `top` values a column, so they are literals."""
    kept = _by_feature(fitted)
    return df.withColumns({c: F.when(F.col(c).isin(kept.get(c, [])), F.col(c)).otherwise("Other") for c in columns})


# ---- frequency and group statistics -------------------------------------------------------
def fit_frequencies(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, value, share of the training rows where the column is not null."""
    counts = unpivot(train, [], columns, "string").where("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("feature"))).drop("n")


def add_frequencies(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """freq_<column>; 0 for values unseen in training. One lookup join for each column, broadcast when small."""
    for c in columns:
        own = fitted.where(F.col("feature") == c).select(F.col("value").alias(f"_{c}"), F.col("share").alias(f"freq_{c}"))
        df = df.join(own, F.col(c) == F.col(f"_{c}"), "left").drop(f"_{c}").withColumn(f"freq_{c}", F.coalesce(f"freq_{c}", F.lit(0.0)))
    return df


def fit_group_medians(train: DataFrame, num: str, cat: str) -> DataFrame:
    """value, med and the overall median of num; a null value stands for the overall row."""
    return train.groupBy(F.col(cat).alias("value")).agg(F.median(num).alias("med")).where("value IS NOT NULL")


def overall_median(train: DataFrame, num: str) -> float:
    """Never null nor 0: 1e-8 stands in."""
    return train.agg(F.median(num)).first()[0] or 1e-8


def add_group_stats(df: DataFrame, train: DataFrame, pairs: Sequence[tuple[str, str]] = GROUP_PAIRS) -> DataFrame:
    """<num>_rel_<cat> = num over its group's training median; unseen groups take the overall one, a median of 0 gives null."""
    overall = train.agg(*(F.median(n).alias(n) for n in dict.fromkeys(n for n, _ in pairs))).first().asDict()
    for num, cat in pairs:
        own = fit_group_medians(train, num, cat).select(F.col("value").alias("_v"), F.col("med").alias("_m"))
        med = F.coalesce("_m", F.lit(overall[num] or 1e-8))
        df = df.join(own, F.col(cat) == F.col("_v"), "left").withColumn(f"{num}_rel_{cat}", F.col(num) / F.nullif(med, F.lit(0.0))).drop("_v", "_m")
    return df


def enrich(train: DataFrame, other: DataFrame, categorical: Sequence[str], pairs: Sequence[tuple[str, str]] = GROUP_PAIRS, params: Params = DEFAULT) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Cap, frequencies and group statistics fitted on train, applied to both: (train, other, frequency and group columns)."""
    top = fit_top_categories(train, categorical, params.max_categories)
    train, other = (cap_categories(d, top, categorical) for d in (train, other))
    freq = fit_frequencies(train, categorical)
    out = [add_group_stats(add_frequencies(d, freq, categorical), train, pairs) for d in (train, other)]
    return out[0], out[1], [f"freq_{c}" for c in categorical], [f"{n}_rel_{c}" for n, c in pairs]


# ---- correlation pruning ------------------------------------------------------------------
def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r for every pair a before b, over rows where both are present: one aggregate for all pairs."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    both = lambda i, j: F.col(columns[i]).isNotNull() & F.col(columns[j]).isNotNull()
    aggs = [F.corr(F.when(both(i, j), F.col(columns[i]).cast("double")), F.when(both(i, j), F.col(columns[j]).cast("double"))).alias(f"r{i}_{j}") for i, j in pairs]
    row = df.agg(*aggs)
    cells = F.array(*(F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"r{i}_{j}").alias("r")) for i, j in pairs))
    return row.select(F.explode(cells).alias("c")).select("c.*")


def prune_correlated(df: DataFrame, columns: Sequence[str], limit: float = DEFAULT.correlation_limit) -> DataFrame:
    """feature, kept: a column goes if any earlier one, itself kept or not, correlates with it beyond the limit."""
    bad = correlations(df, columns).where(F.abs("r") > limit).select(F.col("b").alias("feature")).distinct().withColumn("hit", F.lit(True))
    every = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(columns)], "feature string, position int")
    return every.join(F.broadcast(bad), "feature", "left").select("feature", "position", F.col("hit").isNull().alias("kept"))


# ---- target encoding ----------------------------------------------------------------------
def leave_one_out(df: DataFrame, group: str, y: str = TARGET) -> DataFrame:
    """Adds loo: the mean outcome of the group's other rows; single rows take the overall mean."""
    sums = df.groupBy(F.col(group).alias("_g")).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))  # counted before rows meet, so no group is one task's
    overall = df.agg(F.avg(y).alias("_overall"))
    rest = (F.col("_s") - F.col(y)) / F.nullif(F.col("_n") - 1, F.lit(0))
    joined = df.join(sums, F.col(group).eqNullSafe(F.col("_g")), "left").join(F.broadcast(overall), how="cross")
    return joined.withColumn("loo", F.coalesce(rest, "_overall")).drop("_overall", "_g", "_s", "_n")


def mode(df: DataFrame, group: str, column: str) -> DataFrame:
    """group and the most frequent value of a column in it, the least one of several; null only where there is no value."""
    counts = df.groupBy(group, column).agg(F.count(column).alias("_n"))
    place = Window.partitionBy(group).orderBy(F.desc("_n"), F.asc_nulls_last(column))  # a row for each distinct value
    return counts.withColumn("_k", F.row_number().over(place)).where("_k = 1").select(group, F.col(column).alias("mode"))


def windowed(df: DataFrame, windows: int, min_blocks: int = DEFAULT.min_train_blocks) -> DataFrame:
    """Adds window: the rolling window the row's date validates, 0 for the first blocks."""
    spans = rolling_windows(df, windows, min_blocks).select("window", "valid_from", "valid_until")
    inside = (F.col(DATE) >= F.col("valid_from")) & (F.col(DATE) <= F.col("valid_until"))
    return df.join(F.broadcast(spans), inside, "left").withColumn("window", F.coalesce("window", F.lit(0))).drop("valid_from", "valid_until")


def temporal_target_encode(df: DataFrame, group: str, y: str = TARGET, windows: int = DEFAULT.search_windows) -> DataFrame:
    """Adds window and encoded: the group's mean outcome in all earlier windows, else the overall mean of these; null in window 0.

    The statistic is additive, so it is summed by (window, group) and prefix-summed over windows
    instead of repeating rows for every window.
    """
    rows = windowed(df.where(F.col(y).isNotNull()), windows)
    sums = rows.groupBy("window", F.col(group).alias("_g")).agg(F.sum(y).alias("s"), F.count("*").alias("n"))
    grid = sums.select("_g").distinct().join(F.broadcast(sums.select("window").distinct()), how="cross")
    before = Window.partitionBy("_g").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    named = sums.select(F.col("_g").alias("_g2"), F.col("window").alias("_w2"), "s", "n")
    dense = grid.join(named, F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("window") == F.col("_w2")), "left").select("_g", "window", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("n", F.lit(0)).alias("n"))
    means = dense.withColumn("own", F.sum("s").over(before) / F.nullif(F.sum("n").over(before), F.lit(0)))
    every = dense.groupBy("window").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    earlier = Window.orderBy("window").rowsBetween(Window.unboundedPreceding, -1)  # one row for each window
    overall = every.select(F.col("window").alias("_w"), (F.sum("s").over(earlier) / F.nullif(F.sum("n").over(earlier), F.lit(0))).alias("overall"))
    table = means.join(F.broadcast(overall), F.col("window") == F.col("_w")).select(F.col("window").alias("_w"), "_g", F.coalesce("own", "overall").alias("encoded"))
    return rows.join(table, (F.col("window") == F.col("_w")) & F.col(group).eqNullSafe(F.col("_g"))).withColumn("encoded", F.when(F.col("window") > 0, F.col("encoded"))).drop("_w", "_g")


def cross_fitted_target(df: DataFrame, column: str, y: str = TARGET, folds: int = 5, smooth: float = 10.0, order: Sequence[str] = (DATE, ID)) -> DataFrame:
    """Adds fold and encoded: smoothed mean outcome of the value in the other folds.

    Folds are runs of dates of near-equal size; sums outside a fold are the total less its own.
    """
    blocks = date_blocks(df)
    fold = F.least(F.floor((F.col("cum") - F.col("n")) * folds / F.col("total")), F.lit(folds - 1)).cast("int")
    rows = df.withColumn(column, F.coalesce(column, F.lit("missing"))).join(F.broadcast(blocks.select(DATE, fold.alias("fold"))), DATE)
    sums = rows.groupBy("fold", column).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    own = Window.partitionBy(column)
    every, every_fold = Window.partitionBy(), Window.partitionBy("fold")
    small = sums.withColumns({"ts": F.sum("s").over(own), "tn": F.sum("n").over(own), "as": F.sum("s").over(every), "an": F.sum("n").over(every), "fs": F.sum("s").over(every_fold), "fn": F.sum("n").over(every_fold)})
    prior = (F.col("as") - F.col("fs")) / F.nullif(F.col("an") - F.col("fn"), F.lit(0))
    small = small.select("fold", column, ((F.col("ts") - F.col("s") + smooth * prior) / (F.col("tn") - F.col("n") + smooth)).alias("encoded"))
    return rows.join(small, ["fold", column])


@dataclass(frozen=True)
class TargetEncoding:
    """Outcomes of capped categories by fold, small enough to be literals: max_categories + 1 values a column.

    counts has (rows' outcomes, rows) for each column, value and fold. Rows the encoding was fitted on
    are encoded without the outcomes of their own fold, all others with every fold.
    """

    counts: dict[str, dict[str, dict[int, tuple[float, int]]]]
    folds: int

    def _means(self, column: str, smooth: float, without: int | None = None) -> tuple[dict[str, float], float]:
        """Smoothed mean outcome of each value, and the overall one, over all folds but one."""
        sums = {}
        for value, parts in self.counts[column].items():
            kept = [p for fold, p in parts.items() if fold != without]
            sums[value] = (sum(s for s, _ in kept), sum(n for _, n in kept))
        prior = sum(s for s, _ in sums.values()) / max(sum(n for _, n in sums.values()), 1)
        return {v: (s + smooth * prior) / (n + smooth) for v, (s, n) in sums.items()}, prior

    def spread(self, column: str, smooth: float) -> tuple[float, float]:
        """Mean and population deviation of enc_<column> over the rows the encoding was fitted on."""
        cells = []
        for fold in range(self.folds):
            means, _ = self._means(column, smooth, fold)
            cells += [(means[v], parts[fold][1]) for v, parts in self.counts[column].items() if fold in parts]
        n = max(sum(k for _, k in cells), 1)
        mean = sum(m * k for m, k in cells) / n
        return mean, (sum((m - mean) ** 2 * k for m, k in cells) / n) ** 0.5

    def apply(self, df: DataFrame, smooth: float, training: bool = False) -> DataFrame:
        """Adds enc_<column>; values unseen and nulls count as Other, and Other itself unseen takes the overall mean."""
        out = {}
        for column in self.counts:
            known = [v for v in self.counts[column] if v != "Other"]
            value = F.when(F.col(column).isin(known), F.col(column)).otherwise("Other")
            every, prior = self._means(column, smooth)
            cells, overall = [(F.lit(v), F.lit(m)) for v, m in every.items()], F.lit(prior)
            if training:
                value, cells, rest = F.concat(_fold(self.folds).cast("string"), F.lit("|"), value), [], F.lit(prior)
                for fold in range(self.folds):
                    means, own = self._means(column, smooth, fold)
                    cells += [(F.lit(f"{fold}|{v}"), F.lit(m)) for v, m in means.items()]
                    rest = F.when(_fold(self.folds) == fold, own).otherwise(rest)
                overall = rest
            table = F.create_map(*(x for cell in cells for x in cell)) if cells else F.create_map(F.lit(""), F.lit(0.0))
            out[f"enc_{column}"] = F.coalesce(F.try_element_at(table, value), overall)
        return df.withColumns(out)

    def keys(self, training: bool = False) -> dict[str, Column]:
        """For each column the place of a row's enc_<column> in values(), whatever the smoothing."""
        out = {}
        for column, own in self.counts.items():
            places = {v: i for i, v in enumerate(own)}
            places.setdefault("Other", len(own))
            value = F.when(F.col(column).isin([v for v in own if v != "Other"]), F.col(column)).otherwise("Other")
            place = F.element_at(F.create_map(*(F.lit(x) for pair in places.items() for x in pair)), value)
            out[column] = (_fold(self.folds) * (len(own) + 1) + place if training else place).cast("int")
        return out

    def values(self, column: str, smooth: float, training: bool = False) -> list[float]:
        """What apply() gives rows at each place of keys(): the column's values and what is none of them, when training fold by fold."""
        out = []
        for without in range(self.folds) if training else (None,):
            means, prior = self._means(column, smooth, without)
            out += [*means.values(), prior]
        return out


def _fold(folds: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), F.col(ID)), F.lit(folds))


def fit_target_encoding(train: DataFrame, columns: Sequence[str], y: str = TARGET, folds: int = 5, top: int = DEFAULT.max_categories) -> TargetEncoding:
    """Two aggregates for all columns: the most frequent values, then outcomes by value and fold."""
    kept = _by_feature(fit_top_categories(train, columns, top))
    capped = train.select(_fold(folds).alias("_fold"), F.col(y).alias("_y"), *(F.when(F.col(c).isin(kept.get(c, [])), F.col(c)).otherwise("Other").alias(c) for c in columns))
    counts: dict = {c: {} for c in columns}
    for r in unpivot(capped, ["_fold", "_y"], columns, "string").groupBy("feature", "value", "_fold").agg(F.sum("_y").alias("s"), F.count("_y").alias("n")).collect():
        counts[r["feature"]].setdefault(r["value"], {})[r["_fold"]] = (r["s"] or 0.0, r["n"])
    return TargetEncoding(counts, folds)


def fit_ordinal(train: DataFrame, column: str) -> DataFrame:
    """value, code from 0 in alphabetical order."""
    values = train.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return values.withColumn("code", F.row_number().over(Window.orderBy("value")) - 1)  # distinct values of one category


def add_ordinal(df: DataFrame, fitted: DataFrame, column: str) -> DataFrame:
    own = fitted.select(F.col("value").alias("_v"), F.col("code").alias(f"code_{column}"))
    return df.join(own, F.col(column) == F.col("_v"), "left").drop("_v").withColumn(f"code_{column}", F.coalesce(f"code_{column}", F.lit(-1)))


# ---- numeric preparation ------------------------------------------------------------------
def fit_imputer_scaler(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, median, mean and population deviation after filling nulls with the median."""
    rows = unpivot(train, [], columns)
    med = rows.groupBy("feature").agg(F.median("value").alias("med"))
    filled = rows.join(F.broadcast(med), "feature").withColumn("value", F.coalesce("value", "med"))
    return filled.groupBy("feature").agg(F.first("med").alias("med"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def impute_scale(df: DataFrame, fitted: DataFrame | dict[str, dict], columns: Sequence[str]) -> DataFrame:
    """fitted: the table of fit_imputer_scaler, or its rows by feature."""
    stats = fitted if isinstance(fitted, dict) else {r["feature"]: r for r in fitted.collect()}
    return df.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(stats[c]["med"])) - stats[c]["mean"]) / (stats[c]["sd"] or 1.0) for c in columns})


def monotone_vector(columns: Sequence[str], categorical: Sequence[str] = (), params: Params = DEFAULT) -> list[int]:
    """The sign of each column, 0 where the map has none; categorical columns follow with 0."""
    return [params.monotone.get(c, 0) for c in columns] + [0] * len(categorical)


def feature_subset(train: DataFrame, other: DataFrame, columns: Sequence[str], categorical: Sequence[str], cap: bool = False, keep: Sequence[str] = (ID, DATE, TARGET)) -> tuple[DataFrame, DataFrame]:
    pick = lambda d: d.select(*dict.fromkeys([*keep, *columns]))
    train, other = pick(train), pick(other)
    if not cap:
        return train, other
    cats = [c for c in categorical if c in columns]
    top = fit_top_categories(train, cats)
    return cap_categories(train, top, cats), cap_categories(other, top, cats)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def null_safe(column: str, value: str = "missing") -> Column:
    return F.coalesce(F.col(column), F.lit(value))
