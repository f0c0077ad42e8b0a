"""Queries on encoders, interaction search and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import curves, encoders, metrics, resample, search, timesplit
from ..operators.binning import bin_of, quantile_edges
from ..operators.metrics import r6
from ..params import BENCHMARKS, CATEGORICAL, DATE, ID, NUMERIC
from .catalog import ORACLES, QUERIES, query
from .data import apps, matured_parts, window_scores
from .sql import APPS, MATURED, MODELS, SCORES, cells, curve, distinct, evaluation, left_bin, quantiles, ranking, right_bin, select, windows

parts = matured_parts


# ---- X: encoders --------------------------------------------------------------------------
_CATS = f"cc AS ({cells('train', CATEGORICAL, kind='VARCHAR')}), cn AS (SELECT feature, value, count(*) AS n FROM cc WHERE value IS NOT NULL GROUP BY ALL)"


@query("X01_cardinality_cap", select("SELECT CASE WHEN test.csp IN (SELECT value FROM top) THEN test.csp ELSE 'Other' END AS csp, count(*) AS n FROM test GROUP BY 1", APPS, MATURED, _CATS, "top AS (SELECT value FROM (SELECT value, row_number() OVER (ORDER BY n DESC, value) AS k FROM cn WHERE feature = 'csp') WHERE k <= 20)"))
def _(spark, sf):
    train, test = parts(spark, sf)
    return encoders.cap_categories(test, encoders.fit_top_categories(train, ["csp"]), ["csp"]).groupBy("csp").agg(F.count("*").alias("n"))


@query("X02_frequency_encoding", select("SELECT authorization_id, round(coalesce(a.n / ta, 0), 6) AS freq_house_type, round(coalesce(b.n / tb, 0), 6) AS freq_csp FROM test LEFT JOIN cn a ON a.feature = 'house_type' AND a.value = house_type LEFT JOIN cn b ON b.feature = 'csp' AND b.value = csp, (SELECT sum(n) FILTER (feature = 'house_type') AS ta, sum(n) FILTER (feature = 'csp') AS tb FROM cn)", APPS, MATURED, _CATS))
def _(spark, sf):
    train, test = parts(spark, sf)
    cols = ["house_type", "csp"]
    return encoders.add_frequencies(test, encoders.fit_frequencies(train, cols), cols).select(ID, *(r6(f"freq_{c}").alias(f"freq_{c}") for c in cols))


_rel = [(n, c, f"g{i}") for i, (n, c) in enumerate(encoders.GROUP_PAIRS)]
_rel_cols = ", ".join(f"round({n} / nullif(coalesce({g}.med, {g}o.med), 0), 6) AS {n}_rel_{c}" for n, c, g in _rel)
_rel_joins = " ".join(f"LEFT JOIN (SELECT {c} AS v, median({n}) AS med FROM train GROUP BY 1) {g} ON {c} = {g}.v" for n, c, g in _rel)
_rel_all = ", ".join(f"(SELECT median({n}) AS med FROM train) {g}o" for n, c, g in _rel)


@query("X03_group_relative", select(f"SELECT authorization_id, {_rel_cols} FROM test {_rel_joins}, {_rel_all}", APPS, MATURED))
def _(spark, sf):
    train, test = parts(spark, sf)
    return encoders.add_group_stats(test, train, encoders.GROUP_PAIRS).select(ID, *(r6(f"{n}_rel_{c}").alias(f"{n}_rel_{c}") for n, c in encoders.GROUP_PAIRS))


@query("A06_mode", select("SELECT csp, house_type AS mode FROM (SELECT csp, house_type, row_number() OVER (PARTITION BY csp ORDER BY count(house_type) DESC, house_type NULLS LAST) AS k FROM apps GROUP BY csp, house_type) WHERE k = 1", APPS))
def _(spark, sf):
    return encoders.mode(apps(spark, sf), "csp", "house_type")


@query("X04_enrichment", select("SELECT count(*) AS n, round(sum(coalesce(a.n / ta, 0)) / count(*), 6) AS mean_freq, round(median(age_t1 / nullif(g.med, 0)), 6) AS median_rel FROM test LEFT JOIN cn a ON a.feature = 'house_type' AND a.value = house_type LEFT JOIN (SELECT house_type AS v, median(age_t1) AS med FROM train GROUP BY 1) g ON house_type = g.v, (SELECT sum(n) FILTER (feature = 'house_type') AS ta FROM cn)", APPS, MATURED, _CATS))
def _(spark, sf):
    train, test = parts(spark, sf)
    out = encoders.enrich(train, test, ["house_type", "csp"], [("age_t1", "house_type")])[1]
    return out.agg(F.count("*").alias("n"), r6(F.sum("freq_house_type") / F.count("*")).alias("mean_freq"), r6(F.median("age_t1_rel_house_type")).alias("median_rel"))


_CORR = ["total_amt", "installment_amt", "tenor", "total_loan_nbr", "max_credit_tj_av", "age_t1"]
_pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {i} AS i, {j} AS j, corr({a}, {b}) AS r FROM train" for i, a in enumerate(_CORR) for j, b in enumerate(_CORR) if i < j)


@query("X05_correlation_prune", select("SELECT feature, CAST(position AS INTEGER) AS position, feature NOT IN (SELECT b FROM p WHERE abs(r) > 0.95) AS kept FROM (VALUES " + ", ".join(f"('{c}', {i})" for i, c in enumerate(_CORR)) + ") AS t(feature, position)", APPS, MATURED, f"p AS ({_pairs})"))
def _(spark, sf):
    return encoders.prune_correlated(parts(spark, sf)[0], _CORR)


@query("X06_leave_one_out", select("SELECT authorization_id, round(coalesce((sum(target) OVER w - target) / nullif(count(target) OVER w - 1, 0), avg(target) OVER ()), 6) AS loo FROM train WINDOW w AS (PARTITION BY csp)", APPS, MATURED))
def _(spark, sf):
    return encoders.leave_one_out(parts(spark, sf)[0], "csp").select(ID, r6("loo").alias("loo"))


@query(
    "X07_temporal_target_encoding",
    select(
        "SELECT authorization_id, coalesce(win, 0) AS window_no, CASE WHEN win > 0 THEN round(coalesce((SELECT sum(target) / count(*) FROM train u WHERE u.csp = t.csp AND u.mis_date < w.valid_from), (SELECT avg(target) FROM train u WHERE u.mis_date < w.valid_from)), 6) END AS encoded FROM train t LEFT JOIN w ON mis_date BETWEEN valid_from AND valid_until",
        APPS, MATURED, windows("train", 5),
    ),
)
def _(spark, sf):
    return encoders.temporal_target_encode(parts(spark, sf)[0], "csp").select(ID, F.col("window").alias("window_no"), r6("encoded").alias("encoded"))


@query("X08_X09_quantile_bins", select(f"SELECT CASE WHEN max_credit_tj_av IS NULL THEN 'missing' ELSE CAST({right_bin('max_credit_tj_av', 'e')} AS VARCHAR) END AS bin, count(*) AS n, min(max_credit_tj_av) AS lo, max(max_credit_tj_av) AS hi FROM test, (SELECT {distinct(f'quantile_cont(max_credit_tj_av, {quantiles(5)})')} AS e FROM train) GROUP BY 1", APPS, MATURED))
def _(spark, sf):
    train, test = parts(spark, sf)
    edges = quantile_edges(train.select(F.col("max_credit_tj_av").alias("value")), [], 5).select("edges")
    rows = test.join(F.broadcast(edges), how="cross").withColumn("bin", F.coalesce(bin_of("max_credit_tj_av", "edges", "right").cast("string"), F.lit("missing")))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.min("max_credit_tj_av").alias("lo"), F.max("max_credit_tj_av").alias("hi"))


@query("X10_impute_scale", select("SELECT authorization_id, round((coalesce(max_credit_tj_av, med) - mu) / sd, 6) AS max_credit_tj_av FROM test, (SELECT med, avg(coalesce(max_credit_tj_av, med)) AS mu, stddev_pop(coalesce(max_credit_tj_av, med)) AS sd FROM train, (SELECT median(max_credit_tj_av) AS med FROM train) GROUP BY med)", APPS, MATURED))
def _(spark, sf):
    train, test = parts(spark, sf)
    return encoders.impute_scale(test, encoders.fit_imputer_scaler(train, ["max_credit_tj_av"]), ["max_credit_tj_av"]).select(ID, r6("max_credit_tj_av").alias("max_credit_tj_av"))


@query(
    "X11_cross_fitted_target",
    select(
        "SELECT t.authorization_id, f.fold, round((sv - coalesce(ov, 0) + 10.0 * pr) / (nv - coalesce(on_, 0) + 10.0), 6) AS encoded FROM x t JOIN fo f USING (authorization_id) JOIN (SELECT csp, sum(target) AS sv, count(*) AS nv FROM x GROUP BY 1) a USING (csp) JOIN (SELECT csp, fold, sum(target) AS ov, count(*) AS on_ FROM x GROUP BY ALL) b ON b.csp = t.csp AND b.fold = f.fold JOIN (SELECT fold, (ta - sum(target)) / (tn - count(*)) AS pr FROM x, (SELECT sum(target) AS ta, count(*) AS tn FROM x) GROUP BY fold, ta, tn) p ON p.fold = f.fold",
        APPS, MATURED, "b AS (SELECT mis_date, count(*) AS n, sum(count(*)) OVER (ORDER BY mis_date) AS cum, sum(count(*)) OVER () AS total FROM train GROUP BY mis_date)",
        "x AS (SELECT train.*, CAST(least(floor((cum - n) * 5 / total), 4) AS INTEGER) AS fold FROM train JOIN b USING (mis_date))", "fo AS (SELECT authorization_id, fold FROM x)",
    ),
)
def _(spark, sf):
    return encoders.cross_fitted_target(parts(spark, sf)[0], "csp").select(ID, "fold", r6("encoded").alias("encoded"))


@query("X12_ordinal", select("SELECT authorization_id, CAST(coalesce(code, -1) AS INTEGER) AS code_csp FROM test LEFT JOIN (SELECT csp AS v, row_number() OVER (ORDER BY csp) - 1 AS code FROM (SELECT DISTINCT csp FROM train WHERE csp < 'U')) ON csp = v", APPS, MATURED))
def _(spark, sf):
    train, test = parts(spark, sf)
    return encoders.add_ordinal(test, encoders.fit_ordinal(train.where("csp < 'U'"), "csp"), "csp").select(ID, F.col("code_csp").cast("int").alias("code_csp"))


@query("X13_monotone_vector", "SELECT * FROM (VALUES ('total_amt', 0), ('income_t1', -1), ('amt_per_month', 1), ('csp', 0)) AS t(feature, sign)")
def _(spark, sf):
    names = ["total_amt", "income_t1", "amt_per_month"]
    return spark.createDataFrame(list(zip([*names, "csp"], encoders.monotone_vector(names, ["csp"]), strict=True)), "feature string, sign int")


@query("X14_feature_subset", select("SELECT authorization_id, mis_date, target, age_t1, house_type FROM test", APPS, MATURED))
def _(spark, sf):
    return encoders.feature_subset(*parts(spark, sf), ["age_t1", "house_type"], ["house_type"], cap=True)[1]


# ---- D: search ----------------------------------------------------------------------------
_WIN = windows("train", 5) + ", v AS (SELECT train.*, coalesce(win, 0) AS win FROM train LEFT JOIN w ON mis_date BETWEEN valid_from AND valid_until)"


def _encoded(values: dict[str, str], name: str) -> str:
    long = " UNION ALL ".join(f"SELECT '{k}' AS model, win, target AS y, coalesce({e}, 'missing') AS value FROM v" for k, e in values.items())
    return f"""{name}_l AS ({long}), {name}_g AS (SELECT model, value, win, sum(y) AS s, count(*) AS n FROM {name}_l GROUP BY ALL),
{name}_p AS (SELECT a.model, a.value, b.win, sum(g.s) AS s, sum(g.n) AS n FROM (SELECT DISTINCT model, value FROM {name}_g) a, (SELECT DISTINCT win FROM {name}_g) b LEFT JOIN {name}_g g ON g.model = a.model AND g.value = a.value AND g.win < b.win GROUP BY ALL),
{name}_o AS (SELECT model, win, sum(s) / sum(n) AS o FROM {name}_p GROUP BY ALL),
{name} AS (SELECT l.model, l.y, round(coalesce(p.s / nullif(p.n, 0), o.o), 9) AS score FROM {name}_l l JOIN {name}_p p USING (model, value, win) JOIN {name}_o o USING (model, win) WHERE l.win > 0)"""


def _numeric(values: dict[str, str], name: str) -> str:
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT '{k}' AS model, target AS y, CAST({e} AS DOUBLE) AS score FROM v WHERE win > 0" for k, e in values.items()) + ")"


_AUC = "CASE WHEN n_rows >= 50 AND n_pos >= 10 THEN round(roc_auc, 6) END"
_POWER = f"""{_numeric({c: c for c in NUMERIC}, "pn")}, {_encoded({c: c for c in CATEGORICAL}, "pc")}, {ranking("pn", name="rn")}, {ranking("pc", name="rc")},
power AS (SELECT model AS feature, kind, auc, CAST(n AS BIGINT) AS n, round(abs(auc - 0.5), 6) AS power FROM (SELECT model, 'numeric' AS kind, {_AUC} AS auc, n_rows AS n FROM rn UNION ALL SELECT model, 'categorical', {_AUC}, n_rows FROM rc))"""


@query("D01_D04_base_power", select("SELECT * FROM power", APPS, MATURED, _WIN, _POWER))
def _(spark, sf):
    return search.base_power(encoders.windowed(parts(spark, sf)[0], 5), NUMERIC, CATEGORICAL)


@query("D05_gate", select("SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY power DESC, feature) AS INTEGER) AS rank FROM power WHERE power IS NOT NULL QUALIFY rank <= CASE WHEN kind = 'numeric' THEN 12 ELSE 10 END", APPS, MATURED, _WIN, _POWER))
def _(spark, sf):
    return search.gate(search.base_power(encoders.windowed(parts(spark, sf)[0], 5), NUMERIC, CATEGORICAL))


_E5 = ", " + ", ".join(f"e_{a} AS (SELECT {distinct(f'quantile_cont({a}, {quantiles(5)})')} AS e FROM train)" for a in NUMERIC)
_LABEL = lambda a: f"CASE WHEN {a} IS NULL THEN 'missing' ELSE 'bin' || CAST({right_bin(a, f'(SELECT e FROM e_{a})')} AS VARCHAR) END"
_TEXT = lambda b: f"coalesce({b}, 'missing')"
_EXPRESSION = {
    "ratio": lambda a, b: (f"{a}_DIV_{b}", f"{a} / nullif({b}, 0)"), "product": lambda a, b: (f"{a}_X_{b}", f"{a} * {b}"),
    "cat_concat": lambda a, b: (f"{a}_x_{b}", f"{_TEXT(a)} || '_' || {_TEXT(b)}"), "binned_num_cat": lambda a, b: (f"BIN_{a}_x_{b}", f"({_LABEL(a)}) || '_' || {_TEXT(b)}"),
}
_PAIRS = [(kind, a, b, *_EXPRESSION[kind](a, b)) for kind, a, b in search.candidates(NUMERIC, CATEGORICAL)]
_RATIOS = {n: e for kind, _, _, n, e in _PAIRS if kind in ("ratio", "product")}
_CROSS = {n: e for kind, _, _, n, e in _PAIRS if kind in ("cat_concat", "binned_num_cat")}
_INFO = ", ".join(f"('{n}', '{k}', '{a}', '{b}')" for k, a, b, n, _ in _PAIRS)
_BOARD = f"""{_POWER}{_E5}, {_numeric(_RATIOS, "cn_")}, {_encoded(_CROSS, "cc_")}, {ranking("cn_", name="sn")}, {ranking("cc_", name="sc")},
scored AS (SELECT model, {_AUC} AS auc, n_rows AS n FROM sn UNION ALL SELECT model, {_AUC}, n_rows FROM sc),
board AS (SELECT feature, type, a, b, auc, CAST(n AS BIGINT) AS n, power, parent_power, round(power - parent_power, 6) AS lift, coalesce(round(power - parent_power, 6) >= 0.01, false) AS selected FROM
 (SELECT i.feature, type, a, b, scored.auc, scored.n, round(abs(scored.auc - 0.5), 6) AS power, greatest(x.power, y.power) AS parent_power FROM (VALUES {_INFO}) AS i(feature, type, a, b) JOIN scored ON model = i.feature JOIN power x ON x.feature = a JOIN power y ON y.feature = b))"""


@query("D06_D07_interaction_leaderboard", select("SELECT * FROM board", APPS, MATURED, _WIN, _BOARD))
def _(spark, sf):
    return search.search_interactions(parts(spark, sf)[0], NUMERIC, CATEGORICAL)


@query("D07_search_summary", select("SELECT count(*) AS n_candidates, count(auc) AS n_scored, count(*) FILTER (selected) AS n_selected, max(lift) AS best_lift, max(power) AS best_power, " + ", ".join(f"count(*) FILTER (type = '{k}') AS n_{k}, count(*) FILTER (type = '{k}' AND selected) AS selected_{k}" for k in ("ratio", "product", "cat_concat", "binned_num_cat")) + " FROM board", APPS, MATURED, _WIN, _BOARD))
def _(spark, sf):
    return search.search_summary(search.search_interactions(parts(spark, sf)[0], NUMERIC, CATEGORICAL))


@query("D10_provenance", "SELECT * FROM (VALUES ('tenor', 'raw', true, true), ('amt_per_month', 'engineered', true, false), ('freq_csp', 'frequency', true, true), ('tenor_X_age_t1', 'interaction', false, false), ('other', 'unknown', false, false)) AS t(feature, provenance, in_candidates, kept)")
def _(spark, sf):
    return search.provenance(spark, ["tenor", "tenor_X_age_t1"], ["amt_per_month"], ["tenor_X_age_t1"], ["freq_csp"], [], ["tenor", "amt_per_month", "freq_csp", "tenor_X_age_t1", "other"], ["tenor", "amt_per_month", "freq_csp"], ["tenor", "freq_csp"])


# ---- A: aggregates ------------------------------------------------------------------------
@query("A02_A06_group_aggregates", select("SELECT csp, count(*) AS n, count(DISTINCT mis_date) AS n_dates, round(avg(total_amt), 6) AS mean, round(stddev_samp(total_amt), 6) AS sd, round(quantile_cont(total_amt, 0.25), 6) AS q25, round(quantile_cont(total_amt, 0.75) - quantile_cont(total_amt, 0.25), 6) AS iqr, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM apps GROUP BY csp", APPS))
def _(spark, sf):
    q = lambda p: F.percentile("total_amt", p)
    out = apps(spark, sf).groupBy("csp").agg(F.count("*").alias("n"), F.countDistinct(DATE).alias("n_dates"), r6(F.avg("total_amt")).alias("mean"), r6(F.stddev_samp("total_amt")).alias("sd"), r6(q(0.25)).alias("q25"), r6(q(0.75) - q(0.25)).alias("iqr"))
    return out.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))


@query("A07_A10_ordered", select("SELECT authorization_id, CAST(k AS INTEGER) AS k, CAST(cum AS BIGINT) AS cum, midrank FROM (SELECT authorization_id, row_number() OVER (PARTITION BY csp ORDER BY total_amt DESC, authorization_id) AS k, sum(total_loan_nbr) OVER (PARTITION BY csp ORDER BY total_amt DESC, authorization_id ROWS UNBOUNDED PRECEDING) AS cum, rank() OVER (PARTITION BY csp ORDER BY tenor) + (count(*) OVER (PARTITION BY csp, tenor) - 1) / 2 AS midrank FROM apps WHERE tenor IS NOT NULL) WHERE k <= 3", APPS))
def _(spark, sf):
    rows = apps(spark, sf).where("tenor IS NOT NULL")
    own = Window.partitionBy("csp").orderBy(F.desc("total_amt"), ID)
    rows = rows.withColumn("score", F.col("tenor")).withColumn("k", F.row_number().over(own)).withColumn("cum", F.sum("total_loan_nbr").over(own.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return curves.midranks(rows, ["csp"], "score", "midrank").where("k <= 3").select(ID, "k", "cum", "midrank")


@query("A11_A14_statistics", select("SELECT csp, max_by(house_type, (total_amt, authorization_id)) AS top_type, round(corr(tenor, total_amt), 6) AS r, round(regr_slope(total_amt, tenor), 4) AS slope, round(covar_samp(total_amt, tenor), 2) AS cov FROM apps GROUP BY 1", APPS))
def _(spark, sf):
    return apps(spark, sf).groupBy("csp").agg(F.max_by("house_type", F.struct("total_amt", ID)).alias("top_type"), r6(F.corr("tenor", "total_amt")).alias("r"), F.round(F.regr_slope("total_amt", "tenor"), 4).alias("slope"), F.round(F.covar_samp("total_amt", "tenor"), 2).alias("cov"))


# ---- E: evaluation ------------------------------------------------------------------------
EVAL = evaluation("sel")


@query("E01_E03_rank_metrics", select("SELECT model, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(ks, 6) AS ks, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_pos AS BIGINT) AS n_pos FROM r", APPS, SCORES, ranking("dev")))
def _(spark, sf):
    m = curves.ranking_metrics(curves.curve(window_scores(spark, sf, "development")))
    return m.select("model", *(r6(c).alias(c) for c in ("roc_auc", "pr_auc", "ks")), "n_rows", "n_pos")


for _name, _keys in (("E04_E05_evaluate", "model"), ("E05_evaluate_by_month", "mis_date, model")):
    query(_name, select(f"SELECT * FROM {'e'}", APPS, SCORES, evaluation("sel", _keys)))(lambda spark, sf, k=tuple(_keys.split(", ")): metrics.evaluate(window_scores(spark, sf), k))


@query("E06_is_probability", select("SELECT model, bool_and(score >= 0 AND score <= 1 + 1e-9) AS is_probability FROM sel GROUP BY 1", APPS, SCORES))
def _(spark, sf):
    return window_scores(spark, sf).groupBy("model").agg(metrics.is_probability().alias("is_probability"))


@query("E07_leaderboard", select("SELECT * FROM e ORDER BY pr_auc DESC, model", APPS, SCORES, EVAL))
def _(spark, sf):
    return metrics.leaderboard(window_scores(spark, sf))


@query("E08_official", select("SELECT *, NOT contains(model, '(benchmark)') AS is_experimental FROM e", APPS, SCORES, EVAL))
def _(spark, sf):
    return metrics.official_models(metrics.leaderboard(window_scores(spark, sf)), reject_inference=True)


@query("E09_holdout_scores", select("SELECT authorization_id, mis_date, status_name, any_value(y) AS y, max(score) FILTER (model = 'Scorecard A') AS score__scorecard_a, max(score) FILTER (model = 'Scorecard B') AS score__scorecard_b FROM sel GROUP BY ALL", APPS, SCORES))
def _(spark, sf):
    from ..operators.scorecard import wide_scores

    return wide_scores(window_scores(spark, sf), ["Scorecard A", "Scorecard B"])


_RANK = "k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, authorization_id) AS rn, count(*) OVER (PARTITION BY model) AS nt FROM sel)"
LIFT = f"""{_RANK}, ld AS (SELECT model, CAST(least((rn - 1) // (nt // 10) + 1, 10) AS INTEGER) AS decile, count(*) AS n_accounts, sum(y) AS bads FROM k GROUP BY ALL),
lc AS (SELECT *, sum(n_accounts) OVER w AS cn, sum(bads) OVER w AS cb, sum(n_accounts) OVER (PARTITION BY model) AS tn, sum(bads) OVER (PARTITION BY model) AS tb FROM ld WINDOW w AS (PARTITION BY model ORDER BY decile)),
lift AS (SELECT model, decile, n_accounts, CAST(bads AS BIGINT) AS n_defaults, round(bads / n_accounts, 6) AS default_rate, round(cb / cn, 6) AS cum_default_rate, round(coalesce(bads / n_accounts / nullif(tb / tn, 0), 0), 6) AS lift, round(coalesce(cb / cn / nullif(tb / tn, 0), 0), 6) AS cum_lift, round(coalesce(cb / nullif(tb, 0), 0), 6) AS capture_rate FROM lc)"""


@query("E10_lift_table", select("SELECT * FROM lift", APPS, SCORES, LIFT))
def _(spark, sf):
    return metrics.lift_table(window_scores(spark, sf))


@query(
    "E11_threshold_analysis",
    select(
        "SELECT model, pct AS reject_pct, threshold, tp + fp AS n_rejected, tp + fp + fn + tn AS n_total, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS capture_rate FROM (SELECT k.model, pct, threshold, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp, count(*) FILTER (score < threshold AND y = 1) AS fn, count(*) FILTER (score < threshold AND y = 0) AS tn FROM k JOIN (SELECT model, pct, score AS threshold FROM k, (SELECT unnest([5.0, 10.0, 15.0, 20.0, 25.0, 30.0]::DOUBLE[]) AS pct) WHERE rn = least(ceil(nt * pct / 100), nt - 1) + 1) t ON k.model = t.model GROUP BY ALL)",
        APPS, SCORES, _RANK,
    ),
)
def _(spark, sf):
    return metrics.threshold_analysis(window_scores(spark, sf))


_DELONG = """dl AS (SELECT model, authorization_id, y, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS pooled, rank() OVER (PARTITION BY model, y ORDER BY score) + (count(*) OVER (PARTITION BY model, y, score) - 1) / 2 AS inn,
 count(*) OVER (PARTITION BY model) - count(*) OVER (PARTITION BY model, y) AS o FROM sel), dv AS (SELECT model, authorization_id, y, CASE WHEN y = 1 THEN (pooled - inn) / o ELSE 1 - (pooled - inn) / o END AS v FROM dl)"""


@query(
    "E12_delong",
    select(
        "SELECT candidate, reference, round(a1, 6) AS auc_candidate, round(b1, 6) AS auc_reference, round(a1 - b1, 6) AS delta, round(se, 6) AS se, round((a1 - b1) / se, 4) AS z FROM (SELECT 'Scorecard A' AS candidate, 'score_RF (benchmark)' AS reference, avg(a.v) FILTER (a.y = 1) AS a1, avg(b.v) FILTER (a.y = 1) AS b1, sqrt(var_samp(a.v - b.v) FILTER (a.y = 1) / count(*) FILTER (a.y = 1) + var_samp(a.v - b.v) FILTER (a.y = 0) / count(*) FILTER (a.y = 0)) AS se FROM dv a JOIN dv b USING (authorization_id) WHERE a.model = 'Scorecard A' AND b.model = 'score_RF (benchmark)')",
        APPS, SCORES, _DELONG,
    ),
)
def _(spark, sf):
    return metrics.delong(window_scores(spark, sf), "Scorecard A", "score_RF (benchmark)")


@query("E13_paired_bootstrap")
def _(spark, sf):
    return resample.paired_bootstrap(window_scores(spark, sf), "Scorecard A", "score_RF (benchmark)")


@query("E14_comparison_table")
def _(spark, sf):
    return resample.comparison_table(window_scores(spark, sf), MODELS, list(BENCHMARKS))


_P = "(VALUES ('a', 0.01), ('b', 0.04), ('c', 0.03), ('d', NULL), ('e', 0.005), ('f', 0.9)) AS t(name, p)"


@query("E15_holm", f"SELECT name, CAST(p AS DOUBLE) AS p, CASE WHEN p IS NOT NULL THEN round(least(1, max(s) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING)), 6)::DOUBLE END AS p_adjusted FROM (SELECT name, p, p * (5 - row_number() OVER (ORDER BY p NULLS LAST, name) + 1) AS s FROM {_P})")
def _(spark, sf):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None), ("e", 0.005), ("f", 0.9)], "name string, p double")
    return metrics.holm(rows, "p", tie=("name",)).withColumn("p_adjusted", r6("p_adjusted"))


@query("E16_bootstrap_intervals")
def _(spark, sf):
    return resample.bootstrap_intervals(window_scores(spark, sf).where(F.col("model").isin(*MODELS)))


OVERFIT = """ov AS (SELECT a.model, a.roc_auc AS train_roc_auc, a.pr_auc AS train_pr_auc, a.brier AS train_brier, b.roc_auc AS test_roc_auc, b.pr_auc AS test_pr_auc, b.brier AS test_brier, round(a.roc_auc - b.roc_auc, 6) AS auc_delta, round(a.pr_auc - b.pr_auc, 6) AS pr_delta, round(b.brier - a.brier, 6) AS brier_delta, round(a.roc_auc - b.roc_auc, 6) > 0.03 OR round(a.pr_auc - b.pr_auc, 6) > 0.03 AS overfit FROM ed a JOIN e b USING (model))"""


def overfit(spark, sf) -> DataFrame:
    return metrics.overfit_report(metrics.evaluate(window_scores(spark, sf, "development")), metrics.evaluate(window_scores(spark, sf)))


@query("E17_overfit", select("SELECT * FROM ov", APPS, SCORES, EVAL, evaluation("dev", name="ed"), OVERFIT))
def _(spark, sf):
    return overfit(spark, sf)


ROLLING = f"""{windows("dev", 4)}, rs AS (SELECT CAST(win AS INTEGER) AS win, dev.* FROM dev JOIN w ON mis_date BETWEEN valid_from AND valid_until), {evaluation("rs", "win, model", "ro")}"""


def rolling(spark, sf) -> DataFrame:
    dev = window_scores(spark, sf, "development")
    return metrics.rolling_metrics(dev, timesplit.rolling_windows(dev, 4))


@query("E18_rolling_metrics", select("SELECT win AS window_no, model, roc_auc, gini, ks, pr_auc, n, brier FROM ro", APPS, SCORES, ROLLING))
def _(spark, sf):
    return rolling(spark, sf).withColumnRenamed("window", "window_no")


SUMMARY = "su AS (SELECT model, count(DISTINCT win) AS n_folds, " + ", ".join(f"round(avg({c}), 8) AS mean_{c}, round(stddev_samp({c}), 8) AS std_{c}" for c in ("roc_auc", "pr_auc", "brier")) + " FROM ro GROUP BY model)"


@query("E19_rolling_summary", select("SELECT * FROM su", APPS, SCORES, ROLLING, SUMMARY))
def _(spark, sf):
    return metrics.rolling_summary(rolling(spark, sf))


@query("E20_concept_drift", select("SELECT model, count(*) AS n_folds, round(regr_slope(pr_auc, win), 6) AS slope, round(max_by(pr_auc, win) - min_by(pr_auc, win), 6) AS change, round(max(pr_auc) - min(pr_auc), 6) AS range, round(regr_slope(pr_auc, win), 6) < 0 AND round(max_by(pr_auc, win) - min_by(pr_auc, win), 6) < -0.02 AS drifting FROM ro WHERE NOT contains(model, '(calibrated)') GROUP BY model", APPS, SCORES, ROLLING))
def _(spark, sf):
    return metrics.concept_drift(rolling(spark, sf))


@query(
    "E21_ensemble_search",
    select(
        "SELECT tree, weight, round(pr_auc, 6) AS pr_auc, CAST(row_number() OVER (ORDER BY round(pr_auc, 6) DESC, tree, weight) AS INTEGER) AS rank FROM r",
        APPS, SCORES,
        "bl AS (SELECT t.model AS tree, round(g * 0.05, 6)::DOUBLE AS weight, a.y, g * 0.05::DOUBLE * a.score + (1 - g * 0.05::DOUBLE) * t.score AS score FROM sel a JOIN sel t USING (authorization_id), (SELECT unnest(range(0, 21)) AS g) WHERE a.model = 'Scorecard A' AND t.model IN ('Scorecard B', 'Scorecard C'))",
        ranking("bl", "tree, weight"),
    ),
)
def _(spark, sf):
    return metrics.ensemble_search(window_scores(spark, sf), "Scorecard A", ["Scorecard B", "Scorecard C"])


@query("E23_curve_points", select("SELECT model, score, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr, round(tp / (tp + fp), 6) AS precision FROM c", APPS, SCORES, curve("sel")))
def _(spark, sf):
    return curves.curve_points(window_scores(spark, sf)).select("model", "score", *(r6(c).alias(c) for c in ("fpr", "tpr", "precision")))


@query("E24_reliability", select(f"SELECT model, CAST({left_bin('score', 'e')} AS INTEGER) AS bin, round(avg(score) + 1e-11, 6) AS mean_score, round(avg(y), 6) AS observed_rate, count(*) AS n FROM sel JOIN (SELECT model, {distinct(f'quantile_cont(score, {quantiles(10)})')} AS e FROM sel GROUP BY 1) USING (model) GROUP BY ALL", APPS, SCORES))
def _(spark, sf):
    out = metrics.reliability(window_scores(spark, sf))
    return out.withColumn("mean_score", r6(F.col("mean_score") + 1e-11))  # means of few six-digit scores are exact halves, which the two engines round apart


@query("E25_capture_at_10", select("SELECT model, round(sum(y) FILTER (rn <= ceil(nt * 0.1)) / sum(y), 6) AS capture FROM k GROUP BY model", APPS, SCORES, _RANK))
def _(spark, sf):
    return metrics.capture_at(window_scores(spark, sf))


# SQL follows DeLong's test with a normal interval and Holm's adjustment; E22_scorecard_bootstrap has the bootstrap interval
def comparisons(spark, sf) -> DataFrame:
    out = metrics.delong(window_scores(spark, sf), MODELS, "score_RF (benchmark)")
    out = out.withColumn("delta_lo", r6(F.col("delta") - 1.96 * F.col("se"))).withColumn("p_value", metrics.normal_p(F.col("z")))
    return metrics.holm(out, "p_value", tie=("candidate",)).withColumn("p_adjusted", r6("p_adjusted"))


def card(spark, sf, compared: DataFrame | None = None) -> DataFrame:
    compared = comparisons(spark, sf) if compared is None else compared
    return metrics.model_scorecard(metrics.evaluate(window_scores(spark, sf)), overfit(spark, sf), metrics.rolling_summary(rolling(spark, sf)), compared, MODELS)


_names = "', '".join(MODELS)
_poly = "0.17087277::DOUBLE"
for _c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
    _poly = f"({_c}::DOUBLE + t * {_poly})"
_NORMAL_P = f"t * exp(-x * x + {_poly})"
COMPARE = f"""{_DELONG}, cz AS (SELECT model AS candidate, round(a1 - b1, 6) AS delta, round(round(a1 - b1, 6) - 1.96::DOUBLE * round(se, 6), 6) AS delta_lo, round((a1 - b1) / se, 4) AS z FROM
 (SELECT a.model, avg(a.v) FILTER (a.y = 1) AS a1, avg(b.v) FILTER (a.y = 1) AS b1, sqrt(var_samp(a.v - b.v) FILTER (a.y = 1) / count(*) FILTER (a.y = 1) + var_samp(a.v - b.v) FILTER (a.y = 0) / count(*) FILTER (a.y = 0)) AS se FROM dv a JOIN dv b USING (authorization_id) WHERE a.model IN ('{_names}') AND b.model = 'score_RF (benchmark)' GROUP BY 1)),
cp AS (SELECT *, {_NORMAL_P} AS p FROM (SELECT *, 1 / (1 + 0.5::DOUBLE * abs(z) / sqrt(2)) AS t, abs(z) / sqrt(2) AS x FROM cz)),
co AS (SELECT candidate, delta, delta_lo, round(least(1, max(ps) OVER (ORDER BY p, candidate ROWS UNBOUNDED PRECEDING)), 6) AS p_adjusted FROM (SELECT *, p * (count(p) OVER () - row_number() OVER (ORDER BY p, candidate) + 1) AS ps FROM cp))"""
_mm = lambda x, hi=True: f"coalesce(({x} - min({x}) OVER ()) / nullif(max({x}) OVER () - min({x}) OVER (), 0) * 100, 50)" if hi else f"coalesce((max({x}) OVER () - {x}) / nullif(max({x}) OVER () - min({x}) OVER (), 0) * 100, 50)"
CARD = f"""ca AS (SELECT e.model, e.pr_auc, e.roc_auc, coalesce(c.brier, e.brier) AS ub, ov.auc_delta, su.mean_pr_auc, co.delta, co.delta_lo, co.p_adjusted FROM e LEFT JOIN e c ON c.model = e.model || ' (calibrated)' LEFT JOIN ov ON ov.model = e.model LEFT JOIN su ON su.model = e.model LEFT JOIN co ON co.candidate = e.model WHERE e.model IN ('{_names}')),
cb AS (SELECT *, {_mm("pr_auc")} AS d, {_mm("ub", False)} AS c, {_mm("mean_pr_auc")} AS s, 100 - greatest(0, least(100, (auc_delta - 0.01::DOUBLE) / 0.09::DOUBLE * 100)) AS g, {_mm("delta")} AS l, CASE WHEN p_adjusted <= 0.05 AND delta_lo > 0 THEN 3 WHEN delta_lo > 0 THEN 2 WHEN delta > 0 THEN 1 ELSE 0 END AS tier FROM ca),
cd AS (SELECT model, round(d, 1) AS discrimination, round(c, 1) AS calibration, round(s, 1) AS stability, round(g, 1) AS generalization, round(l, 1) AS lift, round(0.35::DOUBLE * d + 0.15::DOUBLE * c + 0.2::DOUBLE * s + 0.15::DOUBLE * g + 0.15::DOUBLE * l, 1) AS weighted, tier, delta_lo, pr_auc, roc_auc FROM cb),
ce AS (SELECT *, weighted >= max(weighted) OVER () - 2 AS in_band FROM cd),
card AS (SELECT model, discrimination, calibration, stability, generalization, lift, weighted, tier, ['none', 'point_only', 'supported', 'strong'][tier + 1] AS evidence, in_band, row_number() OVER (ORDER BY in_band DESC, tier DESC, delta_lo DESC NULLS LAST, generalization DESC, calibration DESC, discrimination DESC, stability DESC, weighted DESC, pr_auc DESC, roc_auc DESC, model) = 1 AS recommended FROM ce)"""
CARD_CTES = (APPS, SCORES, EVAL, evaluation("dev", name="ed"), OVERFIT, ROLLING, SUMMARY, COMPARE, CARD)


@query("E22_scorecard_bootstrap")
def _(spark, sf):
    compared = resample.comparison_table(window_scores(spark, sf), MODELS, list(BENCHMARKS))
    return card(spark, sf, compared)


@query("E22_model_scorecard", select("SELECT * FROM card", *CARD_CTES))
def _(spark, sf):
    return card(spark, sf)


# ---- charts whose data is an evaluation table ---------------------------------------------
for _chart, _table in (("R08_roc_pr_curves", "E23_curve_points"), ("R10_thresholds", "E11_threshold_analysis"), ("R11_reliability", "E24_reliability")):
    query(_chart, ORACLES[_table])(QUERIES[_table])
