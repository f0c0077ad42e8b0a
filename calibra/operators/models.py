"""Classifiers on MLlib: training, temporal out-of-fold scores, stacking, calibration and explanations.

Boosters and additive models that have no Spark counterpart are substituted by the nearest one:
gradient-boosted trees (two settings), a random forest, and a binned additive model (a
regularised logistic regression on one-hot quantile bins).
"""

from __future__ import annotations

import inspect
import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, QuantileDiscretizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import CATEGORICAL, DATE, DEFAULT, ID, TARGET, Params
from ..sources.files import scratch, write_table
from . import logit
from .curves import curve, ranking_metrics
from .encoders import TargetEncoding, fit_imputer_scaler, fit_target_encoding, impute_scale
from .metrics import evaluate, r6
from .timesplit import calibration_split, rolling_windows, temporal_folds

NUMERIC_FEATURES = ["total_amt", "installment_amt", "tenor", "income_t1", "max_credit_tj_av", "age_t1", "total_card_nbr", "has_codebtor", "installment_to_income", "log_total_amt"]
FEATURES = [*NUMERIC_FEATURES, *CATEGORICAL]


def class_weights(df: DataFrame, y: str = TARGET) -> tuple[float, float]:
    """(negative, positive) weights n / (2 n_class); with a weight column both are 1."""
    if "weight" in df.columns:
        return 1.0, 1.0
    row = df.agg(F.count(y).alias("n"), F.sum(y).alias("p")).first()
    p = row["p"] or 0.0
    return (row["n"] / (2 * (row["n"] - p)), row["n"] / (2 * p)) if 0 < p < row["n"] else (1.0, 1.0)


def pos_weight(df: DataFrame, y: str = TARGET) -> float:
    """Negatives per positive; 1 where rows carry weights of their own."""
    if "weight" in df.columns:
        return 1.0
    row = df.agg(F.count(y).alias("n"), F.sum(y).alias("p")).first()
    return (row["n"] - row["p"]) / row["p"] if row["p"] else 1.0


def class_support(y: str = TARGET) -> Column:
    """Aggregate: both classes, with two rows each at least."""
    return F.least(F.sum(y), F.count(y) - F.sum(y)) >= 2


def supported(df: DataFrame, y: str = TARGET) -> bool:
    return bool(df.agg(class_support(y)).first()[0])


def safe_splits(df: DataFrame, most: int = 5, y: str = TARGET) -> int:
    """Folds that leave each of them a row of both classes; an error where a class has fewer than two rows."""
    n, p = df.agg(F.count(y), F.sum(y)).first()
    least = int(min(p or 0, n - (p or 0)))
    if least < 2:
        raise ValueError("stratified folds need two rows of each class")
    return min(most, n, least)


def probability(df: DataFrame, name: str = "score") -> DataFrame:
    return df.withColumn(name, F.round(vector_to_array("probability")[1], 6))


@dataclass
class Fitted:
    """Preparation fitted on the training rows and the model; applies to any frame with the inputs."""

    features: list[str]
    stats: DataFrame
    model: PipelineModel | None
    spec: Spec | None = None
    calibrate: Callable[[DataFrame], DataFrame] | None = None
    encoding: TargetEncoding | None = None
    known: dict[str, dict] | None = None  # the rows of stats, where they need no job

    @property
    def inputs(self) -> list[str]:
        """The columns read: encoded categories under their own names."""
        own = set(self.encoding.counts) if self.encoding else set()
        return [f.removeprefix("enc_") if f.removeprefix("enc_") in own else f for f in self.features]

    def ready(self, df: DataFrame, training: bool = False) -> DataFrame:
        coded = self.encoding.apply(df, self.spec.smooth, training) if self.encoding else df
        return impute_scale(coded, self.known or self.stats, self.features)

    def refit(self, df: DataFrame, y: str = TARGET) -> Fitted:
        """A fresh model of the same kind, settings and features, prepared and fitted on other rows; nothing fitted is carried over."""
        return self.spec.fit(df, self.inputs, y)

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        out = probability(self.model.transform(self.ready(df)), name).select(ID, name)
        return self.calibrate(out) if self.calibrate else out

    def save(self, path: str) -> None:
        """The model, its imputation table and its category counts, in one folder."""
        self.model.write().overwrite().save(f"{path}/model")
        write_table(self.stats, f"{path}/stats")
        counts = [(c, v, f, float(s), n) for c, values in self.encoding.counts.items() for v, parts in values.items() for f, (s, n) in parts.items()] if self.encoding else []
        write_table(self.stats.sparkSession.createDataFrame(counts, "feature string, value string, fold int, s double, n long").coalesce(1), f"{path}/categories")

    @classmethod
    def load(cls, spark: SparkSession, path: str, features: Sequence[str], spec: Spec) -> Fitted:
        counts: dict = {}
        for r in spark.read.parquet(f"{path}/categories").collect():  # max_categories + 1 values a column, in few folds
            counts.setdefault(r["feature"], {}).setdefault(r["value"], {})[r["fold"]] = (r["s"], r["n"])
        coded = [f.removeprefix("enc_") for f in features if f.removeprefix("enc_") in counts]
        encoding = TargetEncoding({c: counts[c] for c in coded}, 5) if coded else None
        return cls(list(features), spark.read.parquet(f"{path}/stats"), PipelineModel.load(f"{path}/model"), spec, None, encoding)


@dataclass(frozen=True)
class Spec:
    """A named estimator: stages made from feature columns and hyper-parameters.

    Features of type string enter as smoothed mean outcomes, fitted on the rows fit() is given, so
    inside a fold they have seen nothing but that fold's training rows.
    """

    name: str
    make: Callable[..., list]
    params: dict = field(default_factory=dict)
    calibration: str = "isotonic"
    smooth: float = 10.0

    def takes(self, name: str) -> bool:
        return name in inspect.signature(self.make).parameters

    def fit(self, df: DataFrame, features: Sequence[str] = NUMERIC_FEATURES, y: str = TARGET, valid: DataFrame | None = None, prepared: Prepared | None = None) -> Fitted:
        """valid: rows that decide when a boosted model stops; models without rounds leave them aside."""
        rows = df.where(F.col(y).isNotNull())
        p = prepared or prepare(rows, features, y)
        shell = self.shell(df, p)
        ready, extra = self.shaped(shell, p, rows, y), {}
        if self.takes("n"):
            extra["n"] = p.n
        if valid is not None and self.takes("stop"):
            ready, extra["stop"] = ready.unionByName(self.shaped(shell, p, valid.where(F.col(y).isNotNull()), y, True)), True
        shell.model = Pipeline(stages=self.make(p.columns, **extra | self.params)).fit(ready)
        return shell

    def shell(self, df: DataFrame, p: Prepared) -> Fitted:
        """What is fitted before the model."""
        return Fitted(p.columns, p.scaling(df.sparkSession, self.smooth), None, self, None, p.encoding, p.known(self.smooth))

    def shaped(self, shell: Fitted, p: Prepared, rows: DataFrame, y: str, held: bool = False) -> DataFrame:
        """The columns that stages are fitted on; held rows only decide when to stop."""
        weight = F.col("weight") if "weight" in rows.columns else F.when(F.col(y) == 1, p.high).otherwise(p.low)
        return shell.ready(rows, not held).select(*p.columns, weight.alias("_weight"), F.col(y).cast("double").alias("label"), F.lit(held).alias("_valid"))


@dataclass(frozen=True)
class Prepared:
    """What a fit needs to know of its training rows whatever its settings: a few numbers a feature."""

    columns: list[str]
    encoding: TargetEncoding | None
    stats: list
    n: int
    low: float
    high: float

    def known(self, smooth: float) -> dict[str, dict]:
        rows = {r["feature"]: r.asDict() for r in self.stats}
        for c in self.encoding.counts if self.encoding else ():
            mean, sd = self.encoding.spread(c, smooth)
            rows[f"enc_{c}"] = {"feature": f"enc_{c}", "med": mean, "mean": mean, "sd": sd}
        return rows

    def scaling(self, spark: SparkSession, smooth: float) -> DataFrame:
        rows = [tuple(r[k] for k in ("feature", "med", "mean", "sd")) for r in self.known(smooth).values()]
        return spark.createDataFrame(rows, "feature string, med double, mean double, sd double")


def prepare(rows: DataFrame, features: Sequence[str], y: str = TARGET) -> Prepared:
    """rows have an outcome each."""
    cats = [f for f in features if rows.schema[f].dataType.typeName() == "string"]
    numeric = [f for f in features if f not in cats]
    stats = fit_imputer_scaler(rows, numeric).select("feature", "med", "mean", "sd").collect() if numeric else []
    encoding = fit_target_encoding(rows, cats, y) if cats else None
    return Prepared([f"enc_{f}" if f in cats else f for f in features], encoding, stats, max(rows.count(), 1), *class_weights(rows, y))


def _vector(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features")


def logistic(features: Sequence[str], c: float = 1.0, l1: float = 0.0, n: int = 1) -> list:
    """Loss is a mean, so the inverse strength C over n training rows, which fit() counts, is a penalty of 1 / (C n)."""
    return [_vector(features), LogisticRegression(weightCol="_weight", regParam=1 / (c * n), elasticNetParam=l1, standardization=False, maxIter=50)]


def additive(features: Sequence[str], bins: int = 8, reg: float = 0.01) -> list:
    codes, hot = [f"{f}__bin" for f in features], [f"{f}__hot" for f in features]
    return [
        QuantileDiscretizer(inputCols=list(features), outputCols=codes, numBuckets=bins, handleInvalid="keep"), OneHotEncoder(inputCols=codes, outputCols=hot, handleInvalid="keep"),
        VectorAssembler(inputCols=hot, outputCol="features"), LogisticRegression(weightCol="_weight", regParam=reg, maxIter=50),
    ]


def boosted(features: Sequence[str], trees: int = 20, depth: int = 3, rate: float = 0.1, subsample: float = 1.0, least: int = 1, stop: bool = False) -> list:
    """With stop, rows marked _valid end the rounds once their loss no longer falls, and only the best rounds are kept."""
    gbt = GBTClassifier(weightCol="_weight", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, minInstancesPerNode=least, seed=DEFAULT.seed)
    return [_vector(features), gbt.setValidationIndicatorCol("_valid") if stop else gbt]


def forest(features: Sequence[str], trees: int = 20, depth: int = 5, subsample: float = 1.0, least: int = 1) -> list:
    return [_vector(features), RandomForestClassifier(weightCol="_weight", numTrees=trees, maxDepth=depth, subsamplingRate=subsample, minInstancesPerNode=least, seed=DEFAULT.seed)]


SPECS = {
    "Logistic Regression": Spec("Logistic Regression", logistic, calibration="sigmoid"),
    "EBM": Spec("EBM", additive, calibration="sigmoid"),
    "LightGBM": Spec("LightGBM", boosted),
    "XGBoost": Spec("XGBoost", boosted, {"depth": 2, "rate": 0.2, "subsample": 0.8}),
    "CatBoost": Spec("CatBoost", forest),
}


def scored(spec: Spec, train: DataFrame, test: DataFrame, features: Sequence[str] = NUMERIC_FEATURES, prepared: Prepared | None = None) -> DataFrame:
    """id, date, y, model, score of test rows."""
    out = spec.fit(train, features, prepared=prepared).score(test)
    return test.select(ID, DATE, F.col(TARGET).alias("y")).join(out, ID).withColumn("model", F.lit(spec.name))


# ---- calibration --------------------------------------------------------------------------
def fit_sigmoid(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Platt scaling of (y, score): a logistic regression on the log-odds with smoothed targets, as weighted rows of both labels."""
    n = rows.agg(F.sum("y").alias("p"), F.count("y").alias("n")).first()
    high, low = (n["p"] + 1) / (n["p"] + 2), 1 / (n["n"] - n["p"] + 2)
    target = F.when(F.col("y") == 1, high).otherwise(low)
    both = rows.select(_log_odds(F.col("score")).alias("z"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), target.alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - target).alias("w")))).alias("e")).select("z", "e.*")
    fitted = LogisticRegression(weightCol="w", maxIter=50).fit(VectorAssembler(inputCols=["z"], outputCol="features").transform(both))
    a, b = float(fitted.coefficients[0]), float(fitted.intercept)
    return lambda df: df.withColumn("score", F.round(1 / (1 + F.exp(-(a * _log_odds(F.col("score")) + b))), 6))


def _log_odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(q / (1 - q))


def fit_isotonic(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    fitted = IsotonicRegression(featuresCol="score", labelCol="y").fit(rows.select("score", "y"))
    return lambda df: fitted.transform(df).withColumn("score", F.round(F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)), 6)).drop("prediction")


def calibrate(fitted: Fitted, rows: DataFrame, kind: str) -> Fitted:
    """The model with a calibration fitted on rows it has not seen."""
    pairs = rows.select(ID, F.col(TARGET).cast("double").alias("y")).where("y IS NOT NULL").join(fitted.score(rows), ID)
    return replace(fitted, calibrate={"sigmoid": fit_sigmoid, "isotonic": fit_isotonic}[kind](pairs))


# ---- folds --------------------------------------------------------------------------------
#: Fits that run side by side, a Spark job each.
AT_ONCE = 4


def side_by_side(fn: Callable, items: Sequence) -> list:
    """fn of every item, in order."""
    with ThreadPool(AT_ONCE) as pool:
        return pool.map(fn, items, chunksize=1)


def out_of_fold(spec: Spec | Sequence[Spec], df: DataFrame, folds: int = 3, features: Sequence[str] = NUMERIC_FEATURES) -> DataFrame:
    """id, date, y, model, score of rows in validation folds, each scored by a model fitted on earlier dates only.

    Several specs share what is prepared for a fold.
    """

    def part(f):
        train = df.where(F.col(DATE) < F.lit(f["train_until"]))
        valid = df.where((F.col(DATE) >= F.lit(f["valid_from"])) & (F.col(DATE) <= F.lit(f["valid_until"])))
        return (f["fold"], train, valid, prepare(train.where(F.col(TARGET).isNotNull()), features)) if supported(train) else None

    ready = [p for p in side_by_side(part, temporal_folds(df, folds).orderBy("fold").collect()) if p]
    fits = [(s, *p) for s in ([spec] if isinstance(spec, Spec) else spec) for p in ready]
    return _union(side_by_side(lambda x: scored(x[0], x[2], x[3], features, x[4]).withColumn("fold", F.lit(x[1])), fits))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def stack(specs: Sequence[Spec], df: DataFrame, test: DataFrame, folds: int = 3, features: Sequence[str] = NUMERIC_FEATURES) -> DataFrame:
    """Scores of a logistic regression over the base models' out-of-fold scores, complete rows only."""
    cols = {s.name: f"m{i}" for i, s in enumerate(specs)}
    wide = lambda long: long.groupBy(ID, "y").pivot("model", list(cols)).agg(F.first("score")).select(ID, "y", *(F.col(f"`{n}`").alias(c) for n, c in cols.items())).na.drop()
    train = wide(out_of_fold(specs, df, folds, features))
    meta = Pipeline(stages=[_vector(list(cols.values())), LogisticRegression(labelCol="y", regParam=1e-3)]).fit(train)
    prepared = prepare(df.where(F.col(TARGET).isNotNull()), features)
    out = probability(meta.transform(wide(_union(side_by_side(lambda s: scored(s, df, test, features, prepared), specs))))).select(ID, "score")
    return test.select(ID, DATE, F.col(TARGET).alias("y")).join(out, ID).withColumn("model", F.lit("Stacking (experimental)"))


def rolling_validation(specs: Sequence[Spec], df: DataFrame, windows: int = DEFAULT.rolling_windows, features: Sequence[str] = NUMERIC_FEATURES) -> DataFrame:
    """window, model and metrics: every model refitted before each window, raw and calibrated on the last part of its training rows."""
    parts = []
    for w in rolling_windows(df, windows).orderBy("window").collect():
        train = calibration_split(df.where(F.col(DATE) < F.lit(w["valid_from"])))
        valid = df.where((F.col(DATE) >= F.lit(w["valid_from"])) & (F.col(DATE) <= F.lit(w["valid_until"])))
        fit, held = train.where("part = 'fit'"), train.where("part = 'calibration'")
        if not (supported(fit) and supported(valid)):
            continue
        for s in specs:
            fitted = s.fit(fit, features)
            for name, m in ((s.name, fitted), (f"{s.name} (calibrated)", calibrate(fitted, held, s.calibration) if supported(held) else None)):
                if m:
                    rows = valid.select(ID, DATE, F.col(TARGET).alias("y")).join(m.score(valid), ID)
                    parts.append(rows.withColumns({"model": F.lit(name), "window": F.lit(w["window"])}))
    return evaluate(_union(parts), ("window", "model"))


# ---- search -------------------------------------------------------------------------------
def halton(i: int, base: int) -> float:
    out, f = 0.0, 1.0
    while i:
        f /= base
        i, digit = divmod(i, base)
        out += f * digit
    return out


#: What is searched for each model: least, largest and scale of a setting.
SPACES: dict[str, dict[str, tuple[float, float, str]]] = {
    "Logistic Regression": {"c": (1e-4, 100, "log"), "smooth": (1, 200, "log")},
    "EBM": {"bins": (4, 32, "whole"), "reg": (1e-4, 1, "log"), "smooth": (1, 200, "log")},
    "LightGBM": {"depth": (2, 6, "whole"), "rate": (0.02, 0.3, "log"), "subsample": (0.6, 1, "even"), "least": (1, 50, "whole"), "smooth": (1, 200, "log")},
    "XGBoost": {"depth": (2, 4, "whole"), "rate": (0.05, 0.5, "log"), "subsample": (0.5, 1, "even"), "least": (1, 20, "whole"), "smooth": (1, 200, "log")},
    "CatBoost": {"depth": (3, 8, "whole"), "trees": (20, 80, "whole"), "subsample": (0.6, 1, "even"), "least": (1, 50, "whole"), "smooth": (1, 200, "log")},
}
_BASES = (2, 3, 5, 7, 11, 13)


def trial_settings(space: dict[str, tuple[float, float, str]], k: int) -> dict[str, float]:
    """The settings at the k-th point (from 1) of a Halton sequence over the space."""
    out = {}
    for base, (name, (low, high, scale)) in zip(_BASES, space.items(), strict=False):
        u = halton(k, base)
        value = low * (high / low) ** u if scale == "log" else low + (high - low) * u
        out[name] = min(int(low + (high - low + 1) * u), int(high)) if scale == "whole" else float(f"{value:.6g}")
    return out


@dataclass
class Tuned:
    spec: Spec
    trials: DataFrame


def tune(spec: Spec, df: DataFrame, trials: int = DEFAULT.n_trials, folds: int = DEFAULT.cv_folds, features: Sequence[str] = NUMERIC_FEATURES, ceiling: int = 1000, at_once: int = 4) -> Tuned:
    """The spec with the settings of the best mean fold average precision, and the history of trials.

    History: model, trial, settings (JSON), folds scored, mean_pr_auc, rounds, pruned, best; ties go to
    the earlier trial. Trials form groups of `at_once`. A trial ends early when its mean falls below the median that
    the trials of earlier groups had after as many folds; so the outcome does not depend on timing.
    Boosted models run a group side by side, stop by the fold's validation rows, at `ceiling` rounds at most, and
    take the conservative round count over the best trial's folds. Logistic regressions without an L1
    penalty go fold by fold instead, all trials that are left on one reading of the rows.
    """

    def part(f):
        train = df.where(F.col(DATE) < F.lit(f["train_until"]))
        valid = df.where((F.col(DATE) >= F.lit(f["valid_from"])) & (F.col(DATE) <= F.lit(f["valid_until"])))
        return (train, valid, prepare(train.where(F.col(TARGET).isNotNull()), features)) if supported(train) and supported(valid) else None

    parts = [p for p in side_by_side(part, temporal_folds(df, folds).orderBy("fold").collect()) if p]
    if not parts:
        raise ValueError("no fold has both classes in training and validation")
    boosts, before = spec.takes("stop"), []

    def candidate(k: int) -> tuple[Spec, dict]:
        settings = trial_settings(SPACES[spec.name], k)
        own = {n: v for n, v in settings.items() if n != "smooth"}
        return replace(spec, params=spec.params | own | ({"trees": ceiling} if boosts else {}), smooth=settings["smooth"]), settings

    def falls_behind(scores: Sequence[float], earlier: Sequence[Sequence[float]]) -> bool:
        means = sorted(sum(s[: len(scores)]) / len(scores) for s in earlier if len(s) >= len(scores))
        return len(scores) < len(parts) and bool(means) and sum(scores) / len(scores) < means[len(means) // 2]

    def run(k: int) -> dict:
        made, settings = candidate(k)
        scores, rounds, pruned = [], [], False
        for train, valid, prepared in parts:
            m = made.fit(train, features, valid=valid, prepared=prepared)
            rows = probability(m.model.transform(m.ready(valid))).select(F.lit("trial").alias("model"), F.col(TARGET).alias("y"), "score")
            scores.append(ranking_metrics(curve(rows)).first()["pr_auc"] or 0.0)
            rounds.append(m.model.stages[-1].getNumTrees if boosts else None)
            if falls_behind(scores, before):
                pruned = True
                break
        return {"k": k, "settings": settings, "scores": scores, "rounds": rounds, "pruned": pruned}

    def run_linear() -> list[dict]:
        made = {k: candidate(k) for k in range(1, trials + 1)}
        out = {k: {"k": k, "settings": settings, "scores": [], "rounds": [], "pruned": False} for k, (_, settings) in made.items()}
        for train, valid, prepared in parts:
            left = {k: s for k, (s, _) in made.items() if not out[k]["pruned"]}
            for k, score in linear_scores(left, train, valid, prepared).items():
                out[k]["scores"].append(score)
            for k in left:  # earlier groups have been through this fold, or ended before it
                out[k]["pruned"] = falls_behind(out[k]["scores"], [out[j]["scores"] for j in range(1, k - (k - 1) % at_once)])
        return list(out.values())

    done: list[dict] = []
    if spec.make is logistic and not spec.params.get("l1"):
        done = run_linear()
    else:
        with ThreadPool(at_once) as pool:
            for first in range(1, trials + 1, at_once):
                group = pool.map(run, range(first, min(first + at_once, trials + 1)), chunksize=1)
                done += group
                before += [r["scores"] for r in group]
    mean = lambda r: round(sum(r["scores"]) / len(r["scores"]), 6)
    best = max((r for r in done if not r["pruned"]), key=lambda r: (mean(r), -r["k"]))
    made = candidate(best["k"])[0]
    if boosts:
        made = replace(made, params=made.params | {"trees": conservative_rounds(best["rounds"], ceiling)})
    rows = [(spec.name, r["k"], json.dumps(r["settings"]), len(r["scores"]), mean(r), conservative_rounds(r["rounds"], ceiling) if boosts else None, r["pruned"], r is best) for r in done]
    return Tuned(made, df.sparkSession.createDataFrame(rows, "model string, trial int, settings string, folds int, mean_pr_auc double, rounds int, pruned boolean, best boolean"))


def linear_scores(specs: dict[int, Spec], train: DataFrame, valid: DataFrame, p: Prepared) -> dict[int, float]:
    """Average precision on the valid rows of each logistic regression fitted on the training rows; the specs differ in c and smooth."""
    cats = list(p.encoding.counts) if p.encoding else []
    numeric = [c for c in p.columns if c not in {f"enc_{x}" for x in cats}]

    def rows(df: DataFrame, training: bool) -> DataFrame:
        own = df.where(F.col(TARGET).isNotNull())
        weight = F.col("weight") if "weight" in df.columns else F.when(F.col(TARGET) == 1, p.high).otherwise(p.low)
        keys = p.encoding.keys(training) if cats else {}
        cells = [*(F.col(c).alias(f"x{i}") for i, c in enumerate(numeric)), *(keys[c].alias(f"k{i}") for i, c in enumerate(cats))]
        out = impute_scale(own, p.known(1.0), numeric).select(*cells, F.col(TARGET).cast("double").alias("y"), weight.cast("double").alias("w"))
        return _written(out.repartition(df.sparkSession.sparkContext.defaultParallelism), "linear-rows")

    def trial(s: Spec, training: bool) -> logit.Trial:
        known, tables = p.known(s.smooth), []
        for c in cats:
            k = known[f"enc_{c}"]
            tables.append((np.array(p.encoding.values(c, s.smooth, training)) - k["mean"]) / (k["sd"] or 1.0))
        return logit.Trial(1 / (s.params.get("c", 1.0) * p.n), tables)

    fitted = logit.fit(rows(train, True), len(numeric), {k: trial(s, True) for k, s in specs.items()})
    held = logit.scores(rows(valid, False), len(numeric), {k: (trial(s, False), fitted[k]) for k, s in specs.items()})
    power = {r["model"]: r["pr_auc"] for r in ranking_metrics(curve(held)).collect()}  # one curve for all trials
    return {k: power.get(k) or 0.0 for k in specs}


def conservative_rounds(best: Sequence[int | None], fallback: int = 1000, quantile: float = 0.25) -> int:
    """The lower quartile of the folds' best round counts; the fallback only where none is known."""
    known = sorted(v for v in best if v)
    if not known:
        return fallback
    at = quantile * (len(known) - 1)
    lo = math.floor(at)
    hi = min(lo + 1, len(known) - 1)
    return max(1, math.floor(known[lo] + (at - lo) * (known[hi] - known[lo])))


def stability_selection(df: DataFrame, features: Sequence[str], folds: int = 2, cs: Sequence[float] = (0.1, 1.0), l1s: Sequence[float] = (0.5,), params: Params = DEFAULT) -> DataFrame:
    """feature, frequency, mean_abs, kept: how often the best elastic net of each fold keeps a feature; topped up to the least number."""
    grid = [(c, l1) for c in cs for l1 in l1s]

    def best(f) -> dict[str, float] | None:
        train = df.where((F.col(DATE) < F.lit(f["train_until"])) & F.col(TARGET).isNotNull())
        valid = df.where((F.col(DATE) >= F.lit(f["valid_from"])) & (F.col(DATE) <= F.lit(f["valid_until"])))
        if not (supported(train) and supported(valid)):
            return None
        p = prepare(train, features)
        shell = Spec("net", logistic).shell(train, p)
        cells = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(p.columns)]
        ready = shell.spec.shaped(shell, p, train, TARGET).select(*cells, F.col("label").alias("y"), F.col("_weight").cast("double").alias("w"))
        ready = _written(ready.repartition(df.sparkSession.sparkContext.defaultParallelism), "net-rows")  # encoded once for all nets of the fold
        held = _written(shell.ready(valid.where(F.col(TARGET).isNotNull())).select(*cells, F.col(TARGET).cast("double").alias("y")), "net-held")
        nets = {i: logit.Trial((1 - l1) / (c * p.n), [], l1 / (c * p.n)) for i, (c, l1) in enumerate(grid)}
        fitted = logit.fit(ready, len(cells), nets)  # all nets on one reading of the rows a step
        power = {r["model"]: r["pr_auc"] for r in ranking_metrics(curve(logit.scores(held, len(cells), {i: (nets[i], b) for i, b in fitted.items()}))).collect()}  # one curve for all nets
        coefs = [dict(zip(shell.inputs, map(float, fitted[i][:-1]), strict=True)) for i in nets]
        fits = [(round(power.get(i) or 0.0, 8), -sum(abs(v) > 1e-8 for v in coef.values()), coef) for i, coef in enumerate(coefs)]
        return max(fits, key=lambda t: t[:2])[2]

    chosen = [c for c in side_by_side(best, temporal_folds(df, folds).orderBy("fold").collect()) if c is not None]
    k = max(len(chosen), 1)
    rows = [(f, sum(abs(c[f]) > 1e-8 for c in chosen) / k, sum(abs(c[f]) for c in chosen) / k) for f in features]
    rows.sort(key=lambda r: (-r[1], -r[2], r[0]))
    kept = {r[0] for i, r in enumerate(rows) if not chosen or r[1] >= params.stability_threshold or i < params.stability_min_features}
    return df.sparkSession.createDataFrame([(f, round(q, 6), round(m, 6), f in kept) for f, q, m in rows], "feature string, frequency double, mean_abs double, kept boolean")


def ablations(train: DataFrame, test: DataFrame, variants: dict[str, Sequence[str]]) -> DataFrame:
    """variant, n_features and metrics of one fixed logistic regression on each set of features.

    Each set is fitted on all training rows. The last is also fitted without the latest part of
    them, which then calibrates it: `uncalibrated` and `sigmoid` show that model before and after.
    """
    spec = SPECS["Logistic Regression"]
    parts = side_by_side(lambda v: scored(spec, train, test, v[1]).withColumn("model", F.lit(v[0])), list(variants.items()))
    sizes = [(name, len(features)) for name, features in variants.items()]
    last, features = list(variants.items())[-1]
    halves = calibration_split(train.where(F.col(TARGET).isNotNull()))
    fit, held = halves.where("part = 'fit'").drop("part"), halves.where("part = 'calibration'").drop("part")
    plain = spec.fit(fit, features)
    for kind, m in (("uncalibrated", plain), ("sigmoid", calibrate(plain, held, "sigmoid"))):
        parts.append(test.select(ID, DATE, F.col(TARGET).alias("y")).join(m.score(test), ID).withColumn("model", F.lit(f"{last}, {kind}")))
        sizes.append((f"{last}, {kind}", len(features)))
    table = train.sparkSession.createDataFrame(sizes, "model string, n_features int")
    return evaluate(_union(parts)).join(F.broadcast(table), "model").withColumnRenamed("model", "variant")


# ---- explanation --------------------------------------------------------------------------
def importance(fitted: Fitted, name: str) -> DataFrame:
    """model, feature, importance: coefficients or split importances, largest first."""
    last = fitted.model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    names = fitted.features if len(values) == len(fitted.features) else [f"bin{i}" for i in range(len(values))]
    rows = [(name, f, round(abs(float(v)), 6)) for f, v in zip(names, values.toArray(), strict=True)]
    return fitted.stats.sparkSession.createDataFrame(rows, "model string, feature string, importance double").orderBy(F.desc("importance"), "feature")


def linear_contributions(fitted: Fitted, df: DataFrame, name: str) -> DataFrame:
    """model, feature, mean_abs: exact attributions coefficient * (x - mean) of a linear model, averaged over all rows."""
    coef = dict(zip(fitted.features, map(float, fitted.model.stages[-1].coefficients), strict=True))
    ready = fitted.ready(df)
    means = ready.agg(*(F.avg(f).alias(f) for f in fitted.features)).first()
    row = ready.agg(*(F.avg(F.abs(coef[f] * (F.col(f) - means[f]))).alias(f) for f in fitted.features))
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), r6(f).alias("mean_abs")) for f in fitted.features))
    return row.select(F.lit(name).alias("model"), F.explode(cells).alias("c")).select("model", "c.*")


def permutation_importance(fitted: Fitted, df: DataFrame, name: str, features: Sequence[str] | None = None) -> DataFrame:
    """model, feature, auc_drop when the feature's values are exchanged between rows in hash order."""
    from pyspark.sql import Window

    own = df.where(F.col(TARGET).isNotNull())
    parts = [fitted.score(own).withColumn("model", F.lit("base"))]
    spots = Window.partitionBy(F.pmod(F.xxhash64(F.lit(1), ID), F.lit(64)))
    for f in features or fitted.inputs:
        moved = own.withColumn(f, F.coalesce(F.lead(f).over(spots.orderBy(F.xxhash64(ID))), F.col(f)))
        parts.append(fitted.score(moved).withColumn("model", F.lit(f)))
    rows = _union(parts).join(own.select(ID, F.col(TARGET).alias("y")), ID)
    m = ranking_metrics(curve(rows))
    base = m.where("model = 'base'").select(F.col("roc_auc").alias("base"))
    return m.where("model != 'base'").join(F.broadcast(base), how="cross").select(F.lit(name).alias("model"), F.col("model").alias("feature"), r6(F.col("base") - F.col("roc_auc")).alias("auc_drop"))
