"""Queries on sources, predicates, features and time splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as fx
from ..operators import models, scorecard, timesplit
from ..operators.curves import finite
from ..operators.metrics import r6
from ..params import DATE, DEFAULT, ID, MISS_CANDIDATES, STATUS, TARGET
from ..sources import applications as src
from ..sources import files
from .catalog import query
from .sql import APPS, MATURED, SCORES, select, windows

apps = src.applications


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return scorecard.long_scores(apps(spark, sf))


def window_scores(spark: SparkSession, sf: str, part: str = "selection") -> DataFrame:
    """Long scores of matured rows: selection holdout or development."""
    s = scores(spark, sf).where(F.col("y").isNotNull())
    d = F.col(DATE)
    split, sel = F.lit(DEFAULT.split_date), F.lit(DEFAULT.selection_date)
    return s.where((d >= split) & (d < sel)) if part == "selection" else s.where(d < split)


def matured_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    both = timesplit.temporal_split(apps(spark, sf))
    return both.where("split = 'train'").drop("split"), both.where("split = 'test'").drop("split")


# ---- S: sources and sinks -----------------------------------------------------------------
@query("S01_load_booked", select("SELECT count(*) AS n, count(*) FILTER (target = 0) AS n_negative, count(*) FILTER (target = 1) AS n_positive, count(*) FILTER (target IS NULL) AS n_immature, min(mis_date) AS min_date, max(mis_date) AS max_date FROM apps WHERE status_name = 'Booked'", APPS))
def _(spark, sf):
    return src.load_summary(apps(spark, sf))


@query("S02_load_with_rejects", select("SELECT status_name, count(*) AS n, round(avg(CAST(risk_score_rf IS NOT NULL AS DOUBLE)), 6) AS score_share FROM apps WHERE status_name <> 'Booked' GROUP BY 1", APPS))
def _(spark, sf):
    return src.reject_summary(src.load_with_rejects(apps(spark, sf))[1])


@query("S03_population_mode", select("SELECT status_name = 'Booked' AS booked, count(*) AS n FROM apps GROUP BY 1", APPS))
def _(spark, sf):
    booked, rejected = src.load_population(apps(spark, sf), "underwriting")
    return booked.unionByName(rejected).groupBy((F.col(STATUS) == "Booked").alias("booked")).agg(F.count("*").alias("n"))


@query("S04_S05_csv_roundtrip", select("SELECT status_name, round(sum(total_amt) / count(*), 6) AS mean_amt, count(*) AS n FROM apps GROUP BY 1", APPS))
def _(spark, sf):
    path = files.scratch(spark, "csv")
    files.write_csv(apps(spark, sf).groupBy(STATUS).agg((F.sum("total_amt") / F.count("*")).alias("mean_amt"), F.count("*").alias("n")), path)
    return files.read_csv(spark, path, "status_name string, mean_amt double, n long")


@query("S06_tiers_from_json", select("SELECT status_name AS tier, round(sum(total_amt) / count(*), 2) AS bound FROM apps GROUP BY 1", APPS))
def _(spark, sf):
    """Bounds made from the table, written as JSON and read back as bands."""
    bounds = apps(spark, sf).groupBy(STATUS).agg(F.round(F.sum("total_amt") / F.count("*"), 2).alias("bound"))
    path = files.scratch(spark, "tiers")
    files.write_text(bounds.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(STATUS, "bound")))).alias("value")), path)
    return spark.createDataFrame(list(files.read_tiers(spark, path)), "tier string, bound double")


@query("S09_text_sink", select("SELECT CAST(row_number() OVER (ORDER BY status_name) - 1 AS INTEGER) AS line, status_name || ': ' || count(*) AS text FROM apps GROUP BY status_name", APPS))
def _(spark, sf):
    counts = apps(spark, sf).groupBy(STATUS).agg(F.count("*").alias("n")).orderBy(STATUS)
    path = files.scratch(spark, "text")
    files.write_text(counts.select(F.concat_ws(": ", STATUS, F.col("n").cast("string")).alias("value")), path)
    return files.read_text(spark, path)


@query("S06_risk_tiers", "SELECT * FROM (VALUES ('LOW', 0.03::DOUBLE), ('MODERATE', 0.06), ('ELEVATED', 0.10), ('HIGH', 0.20), ('VERY_HIGH', 1.01)) AS t(tier, bound)")
def _(spark, sf):
    return spark.createDataFrame(list(files.read_tiers(spark, None)), "tier string, bound double")


@query("S10_sanitize_name", "SELECT model, regexp_replace(regexp_replace(lower(model), ' ', '_', 'g'), '[().]', '', 'g') AS file FROM (VALUES ('Logistic Regression'), ('LightGBM (calibrated)'), ('score_RF (benchmark)')) AS t(model)")
def _(spark, sf):
    rows = spark.createDataFrame([(n,) for n in ("Logistic Regression", "LightGBM (calibrated)", "score_RF (benchmark)")], "model string")
    return rows.select("model", files.sanitized(F.col("model")).alias("file"))


# ---- P: predicates ------------------------------------------------------------------------
PREDICATES = {
    "P01_status": ("status_name IN ('Rejected', 'Canceled')", lambda: F.col(STATUS).isin("Rejected", "Canceled")),
    "P02_maturity": ("mis_date <= DATE '2001-01-01' AND target IS NOT NULL", lambda: src.matured()),
    "P03_split": ("mis_date >= DATE '1999-07-01'", lambda: F.col(DATE) >= F.lit(DEFAULT.split_date)),
    "P04_finite_score": ("max_credit_tj_av IS NOT NULL AND isfinite(max_credit_tj_av)", lambda: finite("max_credit_tj_av")),
    "P09_ground_truth": ("status_name = 'Booked' AND target IS NOT NULL", lambda: (F.col(STATUS) == "Booked") & F.col(TARGET).isNotNull()),
}
for _name, (_sql, _col) in PREDICATES.items():
    query(_name, select(f"SELECT status_name, count(*) AS n FROM apps WHERE {_sql} GROUP BY 1", APPS))(lambda spark, sf, c=_col: apps(spark, sf).where(c()).groupBy(STATUS).agg(F.count("*").alias("n")))


@query("P05_P06_support", select("SELECT csp, count(*) AS n, CAST(sum(target) AS BIGINT) AS pos, count(*) >= 50 AND sum(target) >= 10 AS enough, least(sum(target), count(target) - sum(target)) >= 2 AS supported FROM m GROUP BY 1", APPS, MATURED))
def _(spark, sf):
    rows = apps(spark, sf).where(src.matured()).groupBy("csp").agg(F.count("*").alias("n"), F.sum(TARGET).cast("long").alias("pos"), models.class_support().alias("supported"))
    return rows.withColumn("enough", (F.col("n") >= DEFAULT.min_valid) & (F.col("pos") >= DEFAULT.min_positive))


@query("P07_minimum_rows", select("SELECT csp, customer_type, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 10", APPS, MATURED))
def _(spark, sf):
    return apps(spark, sf).where(src.matured()).groupBy("csp", "customer_type").agg(F.count("*").alias("n")).where("n >= 10")


@query("P08_name_contains", select("SELECT model, count(*) AS n FROM s WHERE contains(model, '(calibrated)') OR contains(model, '(benchmark)') GROUP BY 1", APPS, SCORES))
def _(spark, sf):
    return scores(spark, sf).where(F.col("model").contains("(calibrated)") | F.col("model").contains("(benchmark)")).groupBy("model").agg(F.count("*").alias("n"))


# ---- F: features --------------------------------------------------------------------------
_T1, _HH, _T = "nullif(income_t1, 0)", "nullif(income_t1 + coalesce(income_t2, 0), 0)", "nullif(tenor, 0)"
_LOG = "ln(1 + CASE WHEN {x} < 0 THEN 0 ELSE {x} END)"
FEATURE_SQL = {
    "F01": {"total_products": "total_card_nbr + total_loan_nbr"},
    "F02": {"has_codebtor": "CAST(income_t2 IS NOT NULL AS INTEGER)"},
    "F03": {"household_income": "income_t1 + coalesce(income_t2, 0)"},
    "F04": {"codebtor_income_share": f"income_t2 / {_HH}"},
    "F05": {"installment_to_income": f"installment_amt / {_T1}", "total_amt_to_income": f"total_amt / {_T1}", "amt_per_month": f"total_amt / {_T}"},
    "F06": {"installment_to_household": f"installment_amt / {_HH}", "total_amt_to_household": f"total_amt / {_HH}"},
    "F07": {f"codebtor_x_{n}": f"CAST(income_t2 IS NOT NULL AS INTEGER) * coalesce({x}, 0)" for n, x in (("inst_to_inc", f"installment_amt / {_T1}"), ("amt_to_inc", f"total_amt / {_T1}"), ("amt_per_month", f"total_amt / {_T}"))},
    "F08": {"book_ratio_loan": "book_loan_nbr / nullif(total_loan_nbr, 0)", "book_ratio_card": "book_card_nbr / nullif(total_card_nbr, 0)"},
    "F09": {"has_cards": "CAST(coalesce(total_card_nbr > 0, false) AS INTEGER)", "has_loans": "CAST(coalesce(total_loan_nbr > 0, false) AS INTEGER)"},
    "F10": {"log_income_t1": _LOG.format(x="income_t1"), "log_total_amt": _LOG.format(x="total_amt"), "log_max_credit": _LOG.format(x="max_credit_tj_av")},
    "F11": {n: f"{a} || '_' || {b}" for n, (a, b) in fx.CROSSES.items()},
    "F12": {f"miss_{c}": f"CAST({c} IS NULL AS INTEGER)" for c in MISS_CANDIDATES},
}
_INT = {"has_codebtor", "has_cards", "has_loans", *(f"miss_{c}" for c in MISS_CANDIDATES)}


def _shown(c: str):
    # eight digits: amounts in cents over months end in exact halves of the sixth digit
    return F.col(c) if c in _INT or c in fx.CROSSES else F.round(c, 8).alias(c)


for _name, _part in FEATURE_SQL.items():
    _cols = ", ".join(f"{e if c in _INT or c in fx.CROSSES else f'round({e}, 8)'} AS {c}" for c, e in _part.items())
    query(f"{_name}_{next(iter(_part))}", select(f"SELECT authorization_id, {_cols} FROM apps", APPS))(
        lambda spark, sf, cols=tuple(_part), flags=_name == "F12": fx.engineer(apps(spark, sf), None if flags else []).select(ID, *map(_shown, cols))
    )

INTERACTIONS = [("ratio", "total_amt", "income_t1", ()), ("product", "tenor", "age_t1", ()), ("cat_concat", "house_type", "csp", ()), ("binned_num_cat", "age_t1", "customer_type", (18.0, 30.0, 40.0, 50.0, 68.0))]


@query("F13_F17_interactions", select("SELECT authorization_id, round(total_amt / nullif(income_t1, 0), 6) AS total_amt_DIV_income_t1, tenor * age_t1 AS tenor_X_age_t1, house_type || '_' || csp AS house_type_x_csp, 'bin' || CAST(CAST(age_t1 > 30 AS INT) + CAST(age_t1 > 40 AS INT) + CAST(age_t1 > 50 AS INT) AS VARCHAR) || '_' || customer_type AS BIN_age_t1_x_customer_type FROM apps", APPS))
def _(spark, sf):
    out = fx.add_interactions(apps(spark, sf), INTERACTIONS)
    return out.select(ID, r6("total_amt_DIV_income_t1").alias("total_amt_DIV_income_t1"), "tenor_X_age_t1", "house_type_x_csp", "BIN_age_t1_x_customer_type")


_P = "round(1 / (1 + exp(-z0)), 6)"


@query("F18_risk_tier", select(f"SELECT authorization_id, CASE WHEN p IS NULL OR p < 0 THEN 'UNKNOWN' WHEN p < 0.03 THEN 'LOW' WHEN p < 0.06 THEN 'MODERATE' WHEN p < 0.10 THEN 'ELEVATED' WHEN p < 0.20 THEN 'HIGH' WHEN p < 1.01 THEN 'VERY_HIGH' ELSE 'UNKNOWN' END AS tier FROM (SELECT authorization_id, {_P} AS p FROM z)", APPS, SCORES))
def _(spark, sf):
    return apps(spark, sf).select(ID, fx.risk_tier(scorecard.model_scores()["Scorecard A"]).alias("tier"))


STATS = [("income_t1", 0.0, -500.0, 9000.0), ("max_credit_tj_av", 0.5, 5.0, 300.0), ("income_t2", 33.0, 0.0, 4500.0)]
_warn = ", ".join([*(f"CASE WHEN {n} IS NULL THEN '{n}: missing' END" for n, miss, *_ in STATS if miss < 1), *(f"CASE WHEN {n} < {lo} THEN '{n}: below training minimum' END, CASE WHEN {n} > {hi} THEN '{n}: above training maximum' END" for n, _m, lo, hi in STATS)])


@query("F19_ood_warnings", select(f"SELECT authorization_id, array_to_string(list_sort(list_filter([{_warn}], lambda x: x IS NOT NULL)), '; ') AS warnings FROM apps", APPS))
def _(spark, sf):
    return apps(spark, sf).select(ID, F.array_join(fx.ood_warnings(STATS), "; ").alias("warnings"))


@query("F20_model_version", "SELECT substr(sha256('Logistic Regression|100|age_t1,tenor'), 1, 12) AS version")
def _(spark, sf):
    return spark.createDataFrame([(files.model_version("Logistic Regression", 100, ["tenor", "age_t1"]),)], "version string")


@query("F21_score_batch", select(f"SELECT authorization_id, {_P} AS predicted_pd, CASE WHEN {_P} < 0.10 THEN 'low' ELSE 'high' END AS risk_tier FROM z", APPS, SCORES))
def _(spark, sf):
    p = scorecard.model_scores()["Scorecard A"]
    return apps(spark, sf).select(ID, p.alias("predicted_pd"), fx.risk_tier(p, (("low", 0.10), ("high", 1.01))).alias("risk_tier"))


@query("F22_benchmark_negation", select("SELECT authorization_id, model, score FROM s WHERE contains(model, '(benchmark)')", APPS, SCORES))
def _(spark, sf):
    return scores(spark, sf).where(F.col("model").contains("(benchmark)")).select(ID, "model", "score")


@query("F23_blend", select("SELECT authorization_id, round(0.3 * round(1 / (1 + exp(-z0)), 6) + (1 - 0.3) * round(1 / (1 + exp(-z1)), 6), 7) AS p FROM z", APPS, SCORES))
def _(spark, sf):
    m = scorecard.model_scores()
    return apps(spark, sf).select(ID, F.round(fx.blend(m["Scorecard A"], m["Scorecard B"], 0.3), 7).alias("p"))


@query("F24_target_source", select("SELECT authorization_id, target IS NOT NULL AS has_observed_target, CASE WHEN status_name = 'Booked' AND target IS NOT NULL THEN 'observed' WHEN status_name = 'Booked' THEN 'immature' ELSE 'unobserved' END AS target_source FROM apps", APPS))
def _(spark, sf):
    from ..operators.bias import target_source

    return target_source(apps(spark, sf)).select(ID, "has_observed_target", "target_source")


# ---- T: time splits -----------------------------------------------------------------------
_split = "CASE WHEN mis_date < DATE '1999-07-01' THEN 'train' ELSE 'test' END"


@query("T01_temporal_split", select(f"SELECT {_split} AS split, count(*) AS n, CAST(sum(target) AS BIGINT) AS bad, min(mis_date) AS min_date, max(mis_date) AS max_date, round(sum(score_rf), 2) AS bench FROM m GROUP BY 1", APPS, MATURED))
def _(spark, sf):
    return timesplit.temporal_split(apps(spark, sf)).groupBy("split").agg(F.count("*").alias("n"), F.sum(TARGET).cast("long").alias("bad"), F.min(DATE).alias("min_date"), F.max(DATE).alias("max_date"), F.round(F.sum("score_rf"), 2).alias("bench"))


@query("T02_holdouts", select("SELECT CASE WHEN mis_date < DATE '2000-04-01' THEN 'selection' ELSE 'final' END AS holdout, count(*) AS n, CAST(sum(target) AS BIGINT) AS bad FROM test GROUP BY 1", APPS, MATURED))
def _(spark, sf):
    return timesplit.holdout_split(matured_parts(spark, sf)[1]).groupBy("holdout").agg(F.count("*").alias("n"), F.sum(TARGET).cast("long").alias("bad"))


_BLOCKS = "b AS (SELECT mis_date, count(*) AS n, sum(count(*)) OVER (ORDER BY mis_date) AS cum, sum(count(*)) OVER () AS total FROM train GROUP BY mis_date)"
_CUT = "cut AS (SELECT min(mis_date) AS discovery_end FROM b WHERE cum >= greatest(1, ceil(total * 0.5)))"
_CAL = "cal AS (SELECT max(mis_date) AS calibration_start FROM b WHERE total - cum + n >= greatest(1, ceil(total * 0.15)))"


@query("T03_discovery_cutoff", select("SELECT discovery_end FROM cut", APPS, MATURED, _BLOCKS, _CUT))
def _(spark, sf):
    return timesplit.discovery_cutoff(matured_parts(spark, sf)[0])


@query("T04_discovery_split", select("SELECT CASE WHEN mis_date <= discovery_end THEN 'discovery' ELSE 'estimation' END AS part, count(*) AS n, min(mis_date) AS min_date, max(mis_date) AS max_date FROM train, cut GROUP BY 1", APPS, MATURED, _BLOCKS, _CUT))
def _(spark, sf):
    return timesplit.discovery_split(matured_parts(spark, sf)[0]).groupBy(F.col("window").alias("part")).agg(F.count("*").alias("n"), F.min(DATE).alias("min_date"), F.max(DATE).alias("max_date"))


@query("T05_calibration_split", select("SELECT CASE WHEN mis_date >= calibration_start THEN 'calibration' ELSE 'fit' END AS part, count(*) AS n, min(mis_date) AS min_date FROM train, cal GROUP BY 1", APPS, MATURED, _BLOCKS, _CAL))
def _(spark, sf):
    return timesplit.calibration_split(matured_parts(spark, sf)[0]).groupBy("part").agg(F.count("*").alias("n"), F.min(DATE).alias("min_date"))


_FOLDS = """bb AS (SELECT *, row_number() OVER (ORDER BY mis_date) AS block, count(*) OVER () AS blocks FROM b),
raw AS (SELECT j, count(*) FILTER (cum < total * j / {k}.0 / 1) + 1 AS raw, any_value(blocks) AS m FROM bb, (SELECT unnest(range(1, {k})) AS j) GROUP BY j),
placed AS (SELECT j, least(max(raw - j) OVER (ORDER BY j) + j, m - ({k} - j)) AS cut, m FROM raw),
ends AS (SELECT j, cut, coalesce(lead(cut) OVER (ORDER BY j), m) AS e FROM placed),
folds AS (SELECT CAST(j - 1 AS INTEGER) AS fold, x.mis_date AS valid_from, y.mis_date AS valid_until FROM ends JOIN bb AS x ON x.block = cut + 1 JOIN bb AS y ON y.block = e)"""


@query("T06_expanding_folds", select("SELECT fold, valid_from, valid_until, count(*) FILTER (mis_date < valid_from) AS n_train, count(*) FILTER (mis_date >= valid_from) AS n_valid FROM train JOIN folds ON mis_date <= valid_until GROUP BY ALL", APPS, MATURED, _BLOCKS, _FOLDS.format(k=5)))
def _(spark, sf):
    train = matured_parts(spark, sf)[0]
    rows = timesplit.fold_members(train, timesplit.expanding_folds(train, 4))
    return rows.groupBy("fold", "valid_from", "valid_until").agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "valid").alias("n_valid"))


@query("T07_temporal_cv", select("SELECT fold, valid_from, valid_until FROM folds", APPS, MATURED, _BLOCKS, _FOLDS.format(k=6)))
def _(spark, sf):
    return timesplit.temporal_folds(matured_parts(spark, sf)[0]).select("fold", "valid_from", "valid_until")


for _name, _k in (("T08_rolling_windows", 4), ("T09_search_windows", 5)):
    query(_name, select("SELECT win AS window_no, valid_from, valid_until, CAST(n_blocks AS BIGINT) AS n_blocks FROM w", APPS, MATURED, windows("train", _k)))(
        lambda spark, sf, k=_k: timesplit.rolling_windows(matured_parts(spark, sf)[0], k).withColumnRenamed("window", "window_no")
    )


@query("T10_population_summary", select("SELECT count(*) AS n, count(*) FILTER (target = 1) AS n_pos, round(avg(target), 6) AS bad_rate, min(mis_date) AS min_date, max(mis_date) AS max_date, count(*) FILTER (csp <> 'CHINA') AS n_booked, count(*) FILTER (csp = 'CHINA') AS n_pseudo FROM train", APPS, MATURED))
def _(spark, sf):
    weighted = matured_parts(spark, sf)[0].withColumn("weight", F.when(F.col("csp") == "CHINA", 0.5).otherwise(1.0))
    return timesplit.population_summary(weighted)


COVERAGE = "SELECT CASE WHEN mis_date < DATE '1999-07-01' THEN 'pre_split' ELSE 'post_split' END AS split, status_name, CASE WHEN status_name = 'Booked' THEN 'booked' ELSE 'not_booked' END AS population_group, count(*) AS n, count(target) AS n_observed, count(*) FILTER (target = 1) AS n_bad, min(mis_date) AS min_date, max(mis_date) AS max_date FROM apps GROUP BY ALL"


@query("T11_population_coverage", select(COVERAGE, APPS))
def _(spark, sf):
    return timesplit.population_coverage(apps(spark, sf))


@query("J06_fold_membership", select("SELECT win AS window_no, CASE WHEN mis_date >= valid_from THEN 'valid' ELSE 'train' END AS role, count(*) AS n, CAST(sum(target) AS BIGINT) AS bad FROM train JOIN w ON mis_date <= valid_until GROUP BY ALL", APPS, MATURED, windows("train", 4)))
def _(spark, sf):
    train = matured_parts(spark, sf)[0]
    rows = timesplit.fold_members(train, timesplit.rolling_windows(train, 4))
    return rows.groupBy(F.col("window").alias("window_no"), "role").agg(F.count("*").alias("n"), F.sum(TARGET).cast("long").alias("bad"))

