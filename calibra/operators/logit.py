"""Many logistic regressions on the same rows at once, by Newton's method.

The regressions differ in penalty and in what their categories are encoded to. A row is read once for a
step of all of them: tasks sum each one's loss, gradient and Hessian in Arrow batches, Spark adds up
the tasks' sums, and the driver solves systems as wide as the features. The loss is MLlib's (weighted
mean log loss plus half the penalty times the squared coefficients, intercept free), and its minimum
is reached to rounding. With a penalty on absolute coefficients too, a step is the minimum of the same
quadratic with that penalty, found by coordinate descent on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_STEPS = 100
#: The last step is taken without a look at its end when it lowers the loss by less than this.
NEAR = 1e-10
#: Rows whose sums are taken at once.
BLOCK = 8192


@dataclass(frozen=True)
class Trial:
    """A penalty, for each key column the value at each key, and a penalty on absolute coefficients."""

    penalty: float
    tables: list[np.ndarray]
    lasso: float = 0.0


def _blocks(batches: Iterator[pa.RecordBatch], numeric: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], dict[str, np.ndarray]]]:
    """(numeric columns with a last column of ones, keys, the other columns) of rows: x0.., k0.., others."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            got = {n: part.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(part.schema.names)}
            keys = [got.pop(n) for n in sorted((n for n in got if n[0] == "k"), key=lambda n: int(n[1:]))]
            yield np.column_stack([*(got.pop(f"x{i}") for i in range(numeric)), np.ones(part.num_rows)]), keys, got


def _with_keys(x: np.ndarray, keys: list[np.ndarray], trial: Trial) -> np.ndarray:
    return np.column_stack([*(t[k] for t, k in zip(trial.tables, keys, strict=True)), x]) if keys else x


def _sums(rows: DataFrame, numeric: int, points: dict[int, tuple[Trial, np.ndarray]]) -> dict[int, np.ndarray]:
    """For each trial at its point: weight, loss, gradient and Hessian of the weighted log loss, summed over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: 0.0 for k in points}
        for x0, keys, other in _blocks(batches, numeric):
            y, w = other["y"], other["w"]
            for k, (trial, b) in points.items():
                x = _with_keys(x0, keys, trial)
                z = x @ b
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                hessian = x.T @ (x * (w * p * (1 - p))[:, None])
                total[k] = total[k] + np.concatenate([[w.sum(), w @ (np.logaddexp(0, z) - y * z)], x.T @ (w * (p - y)), hessian.ravel()])
        found = [k for k in total if not np.isscalar(total[k])]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([total[k] for k in found], pa.list_(pa.float64()))], ["trial", "sums"])

    parts = rows.mapInArrow(run, "trial int, sums array<double>").select("trial", F.posexplode("sums").alias("i", "v"))
    out = {k: np.zeros(2 + len(b) + len(b) ** 2) for k, (_, b) in points.items()}
    for r in parts.groupBy("trial", "i").agg(F.sum("v").alias("v")).collect():  # as many rows as the systems have cells
        out[r["trial"]][r["i"]] = r["v"]
    return out


def _lasso_step(hessian: np.ndarray, gradient: np.ndarray, b: np.ndarray, lasso: np.ndarray) -> np.ndarray:
    """What to take from b for the minimum of the quadratic around b with the penalty lasso @ abs."""
    to, slope = b.copy(), gradient.copy()
    for _ in range(10_000):
        most = 0.0
        for j in range(len(b)):
            curve = hessian[j, j]
            if curve <= 0:
                continue
            u = to[j] - slope[j] / curve
            change = np.sign(u) * max(abs(u) - lasso[j] / curve, 0.0) - to[j]
            if change:
                to[j] += change
                slope += hessian[:, j] * change
                most = max(most, curve * change * change)
        if most < 1e-16:
            break
    return b - to


def fit(rows: DataFrame, numeric: int, trials: dict[int, Trial]) -> dict[int, np.ndarray]:
    """Coefficients of each trial: key columns, numeric columns, intercept. rows: x0.. (numeric), k0.. (keys), y, w."""
    width = numeric + 1 + len(next(iter(trials.values())).tables)
    free = np.append(np.ones(width - 1), 0.0)
    best = {k: (np.inf, np.zeros(width), np.zeros(width), 1.0) for k in trials}  # loss, point, direction, length of the step under test
    tested, done = {k: np.zeros(width) for k in trials}, {}
    for _ in range(MAX_STEPS):
        sums = _sums(rows, numeric, {k: (trials[k], b) for k, b in tested.items()})
        following = {}
        for k, b in tested.items():
            total, loss, least = sums[k][0], sums[k][1], best[k][0]
            ridge = trials[k].penalty * free
            lasso = trials[k].lasso * free
            value = loss / total + ridge @ (b * b) / 2 + lasso @ abs(b)
            if not np.isfinite(value):
                raise ValueError("features, outcomes and weights must be finite, and there must be rows")
            if value <= least:
                gradient = sums[k][2 : 2 + width] / total + ridge * b
                hessian = sums[k][2 + width :].reshape(width, width) / total + np.diag(ridge)
                step = _lasso_step(hessian, gradient, b, lasso) if lasso.any() else np.linalg.lstsq(hessian, gradient, rcond=None)[0]
                best[k] = (value, b, step, 1.0)
                if gradient @ step + lasso @ (abs(b) - abs(b - step)) < NEAR:
                    done[k] = b - step
                    continue
            else:
                best[k] = (*best[k][:3], best[k][3] / 2)
            _, start, step, length = best[k]
            if length < 1e-9:  # no lower value can be told from rounding
                done[k] = start
                continue
            following[k] = start - length * step
        tested = following
        if not tested:
            break
    return done | {k: best[k][1] for k in tested}


def scores(rows: DataFrame, numeric: int, fitted: dict[int, tuple[Trial, np.ndarray]]) -> DataFrame:
    """model (the trial), y, score of rows with x0.., k0.. and y; six digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x0, keys, other in _blocks(batches, numeric):
            for k, (trial, b) in fitted.items():
                p = 1 / (1 + np.exp(-np.clip(_with_keys(x0, keys, trial) @ b, -700, 700)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), k, np.int32)), pa.array(other["y"]), pa.array(p)], ["model", "y", "score"])

    return rows.mapInArrow(run, "model int, y double, score double").withColumn("score", F.round("score", 6))
