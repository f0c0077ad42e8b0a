"""The edge-binning kernel: exact quantile edges of many features at once, and bin membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot(df: DataFrame, keep: Sequence[str | Column], columns: Sequence[str], kind: str = "double", name: str = "feature", value: str = "value") -> DataFrame:
    """keep, feature, value: one row for each row and column."""
    pairs = F.array(*(F.struct(F.lit(c).alias(name), F.col(c).cast(kind).alias(value)) for c in columns))
    long = df.select(*keep, F.explode(pairs).alias("_pair"))
    return long.select(*long.columns[:-1], f"_pair.{name}", f"_pair.{value}")


def quantile_edges(rows: DataFrame, keys: Sequence[str], bins: int, value: str = "value", dedupe: bool = True) -> DataFrame:
    """keys, edges (array), n: the quantiles 0, 1/bins, ..., 1 of the values that are not null."""
    edges = F.percentile(value, F.array(*(F.lit(k / bins) for k in range(bins + 1))))
    edges = F.array_distinct(edges) if dedupe else edges
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(edges.alias("edges"), F.count("*").alias("n"))


def inner(edges: Column | str = "edges") -> Column:
    """Edges without the first and the last."""
    e = F.col(edges) if isinstance(edges, str) else edges
    return F.when(F.size(e) > 2, F.slice(e, F.lit(2), F.greatest(F.size(e) - 2, F.lit(1)))).otherwise(F.array().cast("array<double>"))


def bin_of(value: Column | str, edges: Column | str, closed: str) -> Column:
    """Bin number from 0. `left`: an edge belongs to the bin above it; `right`: to the bin below. Null for null."""
    x = F.col(value) if isinstance(value, str) else value
    below = (lambda e: e <= x) if closed == "left" else (lambda e: e < x)
    return F.when(x.isNotNull(), F.size(F.filter(inner(edges), below)))


def with_bins(rows: DataFrame, edges: DataFrame, keys: Sequence[str], closed: str, value: str = "value") -> DataFrame:
    """Rows with their key's edges and bin; edges are one row for each feature."""
    return rows.join(F.broadcast(edges), list(keys)).withColumn("bin", bin_of(value, "edges", closed))
