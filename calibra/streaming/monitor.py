"""Streaming PSI: scores in tumbling windows against frozen edges. Counts per (window, bin) are the only state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import bin_index
from ..operators.metrics import r6
from ..operators.stability import psi_term


def binned_counts(events: DataFrame, edges: Sequence[float], time: str = "ts", value: str = "value", window: str = "30 days", delay: str = "7 days") -> DataFrame:
    """window_start, bin, n. Works on a stream (late rows dropped past the watermark) and on a table alike."""
    rows = events.withWatermark(time, delay) if events.isStreaming else events
    return rows.where(F.col(value).isNotNull()).groupBy(F.window(time, window).alias("w"), bin_index(F.col(value), list(edges)[1:-1], "left").alias("bin")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "bin", "n")


def psi_by_window(counts: DataFrame, expected: Sequence[float]) -> DataFrame:
    """window_start, n, psi of counts against expected bin shares; empty bins count with share 0."""
    spine = F.explode(F.array(*(F.struct(F.lit(i).alias("bin"), F.lit(float(e)).alias("expected")) for i, e in enumerate(expected))))
    grid = counts.select("window_start").distinct().select("window_start", spine.alias("s")).select("window_start", "s.*")
    total = counts.groupBy("window_start").agg(F.sum("n").alias("total"))
    cells = grid.join(counts, ["window_start", "bin"], "left").join(total, "window_start")
    share = F.coalesce("n", F.lit(0)) / F.col("total")
    return cells.groupBy("window_start").agg(F.max("total").alias("n"), r6(F.sum(psi_term(F.col("expected"), share))).alias("psi"))
