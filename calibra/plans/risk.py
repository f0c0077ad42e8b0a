"""Queries on stability, bias, governance, joins, models and presentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as fx
from ..operators import bias, discovery, encoders, governance, metrics, models, present, search, stability, timesplit
from ..operators.binning import quantile_edges, unpivot
from ..params import CATEGORICAL, DEFAULT, ID, NUMERIC, STATUS, TARGET
from ..sources import applications as src
from ..sources import files
from ..streaming import monitor
from .catalog import query
from .data import COVERAGE, apps, matured_parts, scores, window_scores
from .models_eval import CARD_CTES, EVAL, LIFT, OVERFIT, _RANK, card, comparisons, overfit, rolling
from .sql import APPS, BAND, MATURED, MODELS, PSI, SCORES, cells, distinct, evaluation, left_bin, quantiles, right_bin, select

# ---- G: stability -------------------------------------------------------------------------
_PSI_CTES = f"""ed AS (SELECT model, quantile_cont(score, {quantiles(10)}) AS e FROM dev GROUP BY 1),
sp AS (SELECT model, unnest(range(0, 10)) AS bin FROM ed),
pb AS (SELECT model, {left_bin('score', 'e')} AS bin, count(*) AS c FROM dev JOIN ed USING (model) GROUP BY ALL),
qb AS (SELECT model, {left_bin('score', 'e')} AS bin, count(*) AS c FROM sel JOIN ed USING (model) GROUP BY ALL),
pc AS (SELECT sp.model, coalesce(pb.c, 0) / sum(pb.c) OVER (PARTITION BY sp.model) AS e, coalesce(qb.c, 0) / sum(qb.c) OVER (PARTITION BY sp.model) AS a FROM sp LEFT JOIN pb USING (model, bin) LEFT JOIN qb USING (model, bin)),
psi AS (SELECT model, round({PSI}, 6) AS psi, {BAND.format(x=PSI)} AS band FROM pc GROUP BY 1)"""


def psi(spark, sf):
    value = lambda part: window_scores(spark, sf, part).withColumnRenamed("score", "value")
    return stability.psi(value("development"), value("selection"))


@query("G01_psi", select("SELECT * FROM psi", APPS, SCORES, _PSI_CTES))
def _(spark, sf):
    return psi(spark, sf)


_CNUM, _CCAT = ["total_amt", "tenor", "max_credit_tj_av", "age_t1"], ["house_type", "csp"]
_CSI = f"""tn AS ({cells('train', _CNUM)}), un AS ({cells('test', _CNUM)}),
te AS (SELECT feature, {distinct(f'quantile_cont(value, {quantiles(10)})')} AS e FROM tn WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 50 AND len({distinct(f'quantile_cont(value, {quantiles(10)})')}) >= 3),
ts AS (SELECT feature, unnest(range(0, len(e) - 1)) AS bin FROM te),
ta AS (SELECT feature, {left_bin('value', 'e')} AS bin, count(*) AS c FROM tn JOIN te USING (feature) WHERE value IS NOT NULL GROUP BY ALL),
tb AS (SELECT feature, {left_bin('value', 'e')} AS bin, count(*) AS c FROM un JOIN te USING (feature) WHERE value IS NOT NULL GROUP BY ALL),
tc AS (SELECT ts.feature, 'numeric' AS kind, coalesce(ta.c, 0) / sum(ta.c) OVER (PARTITION BY ts.feature) AS e, coalesce(tb.c, 0) / sum(tb.c) OVER (PARTITION BY ts.feature) AS a FROM ts LEFT JOIN ta USING (feature, bin) LEFT JOIN tb USING (feature, bin)),
ka AS (SELECT feature, value, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS e FROM ({cells('train', _CCAT, kind='VARCHAR')}) GROUP BY feature, value),
kb AS (SELECT feature, value, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS a FROM ({cells('test', _CCAT, kind='VARCHAR')}) GROUP BY feature, value),
kc AS (SELECT feature, 'categorical' AS kind, coalesce(e, 0) AS e, coalesce(a, 0) AS a FROM ka FULL JOIN kb USING (feature, value)),
csi AS (SELECT feature, kind, round({PSI}, 6) AS csi, {BAND.format(x=PSI)} AS band FROM (SELECT * FROM tc UNION ALL SELECT * FROM kc) GROUP BY feature, kind)"""


def csi(spark, sf):
    return stability.csi(*matured_parts(spark, sf), _CNUM, _CCAT)


@query("G02_csi", select("SELECT * FROM csi", APPS, MATURED, _CSI))
def _(spark, sf):
    return csi(spark, sf)


_REPORT = "rep AS (SELECT 'score' AS kind, model AS name, psi AS value, band FROM psi UNION ALL SELECT kind, feature, csi, band FROM csi)"


@query("G03_stability_report", select("SELECT * FROM rep", APPS, MATURED, SCORES, _PSI_CTES, _CSI, _REPORT))
def _(spark, sf):
    return stability.stability_report(*(window_scores(spark, sf, p).withColumnRenamed("score", "value") for p in ("development", "selection")), csi(spark, sf))


@query("G03_drift_counts", select("SELECT CASE WHEN kind = 'score' THEN 'score' ELSE 'feature' END AS kind, band, count(*) AS n FROM rep GROUP BY ALL", APPS, MATURED, SCORES, _PSI_CTES, _CSI, _REPORT))
def _(spark, sf):
    report = stability.stability_report(*(window_scores(spark, sf, p).withColumnRenamed("score", "value") for p in ("development", "selection")), csi(spark, sf))
    return stability.drift_counts(report)


_WOE = f"""wn AS ({cells('train', _CNUM, 'target')}), we AS (SELECT feature, {distinct(f'quantile_cont(value, {quantiles(10)})')} AS e FROM wn WHERE value IS NOT NULL GROUP BY 1),
wc AS (SELECT feature, 'numeric' AS kind, CAST({right_bin('value', 'e')} AS VARCHAR) AS bin, target FROM wn JOIN we USING (feature) WHERE value IS NOT NULL UNION ALL SELECT feature, 'categorical', value, target FROM ({cells('train', _CCAT, 'target', 'VARCHAR')}) WHERE value IS NOT NULL),
wg AS (SELECT feature, kind, bin, count(*) AS n, CAST(sum(target) AS BIGINT) AS bads FROM wc GROUP BY ALL),
wd AS (SELECT *, bads / sum(bads) OVER (PARTITION BY feature) AS b, (n - bads) / sum(n - bads) OVER (PARTITION BY feature) AS g FROM wg),
woe AS (SELECT feature, kind, bin, n, bads, round(bads / n, 6) AS event_rate, round(ln(greatest(g, 1e-6) / greatest(b, 1e-6)), 6) AS woe, round((g - b) * ln(greatest(g, 1e-6) / greatest(b, 1e-6)), 6) AS iv FROM wd),
iv AS (SELECT feature, kind, round(sum(iv), 6) AS iv, count(*) AS n_bins FROM woe GROUP BY feature, kind)"""


def woe(spark, sf):
    return stability.woe(matured_parts(spark, sf)[0], _CNUM, _CCAT)


@query("G04_woe", select("SELECT * FROM woe", APPS, MATURED, _WOE))
def _(spark, sf):
    return woe(spark, sf)


@query("G04_G05_information_value", select("SELECT *, CASE WHEN iv < 0.02 THEN 'not useful' WHEN iv < 0.1 THEN 'weak' WHEN iv < 0.3 THEN 'medium' ELSE 'strong' END AS strength FROM iv", APPS, MATURED, _WOE))
def _(spark, sf):
    return stability.information_value(woe(spark, sf))


# ---- G: bias ------------------------------------------------------------------------------
_series = " + ".join(f"{2 * (-1) ** (k - 1)} * exp(-2.0 * {k * k} * x * x)" for k in range(1, 21))


@query(
    "G06_population_ks",
    select(
        f"SELECT model, round(ks, 6) AS ks, nb AS n_booked, no AS n_other, round(mb, 6) AS mean_booked, round(mo, 6) AS mean_other, round(CASE WHEN x < 0.2 THEN 1 ELSE greatest(0, least(1, {_series})) END, 6) AS p_value FROM (SELECT *, (sqrt(nb * no / (nb + no)) + 0.12 + 0.11 / sqrt(nb * no / (nb + no))) * ks AS x FROM kk JOIN kz USING (model))",
        APPS, SCORES,
        "kd AS (SELECT model, score, count(*) FILTER (status_name = 'Booked') AS pos, count(*) FILTER (status_name <> 'Booked') AS neg FROM s GROUP BY ALL)",
        "kk AS (SELECT model, max(abs(tp / p - fp / n)) AS ks FROM (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n FROM kd WINDOW w AS (PARTITION BY model ORDER BY score)) GROUP BY 1)",
        "kz AS (SELECT model, count(*) FILTER (status_name = 'Booked') AS nb, count(*) FILTER (status_name <> 'Booked') AS no, avg(score) FILTER (status_name = 'Booked') AS mb, avg(score) FILTER (status_name <> 'Booked') AS mo FROM s GROUP BY 1)",
    ),
)
def _(spark, sf):
    return bias.population_ks(scores(spark, sf))


@query(
    "G07_selection_correlation",
    select(
        "SELECT model, count(*) AS n, round(corr(score, ref), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, CASE WHEN abs(corr(score, ref)) > 0.9 THEN 'HIGH' WHEN abs(corr(score, ref)) > 0.7 THEN 'MODERATE' ELSE 'LOW' END AS flag FROM (SELECT model, score, -risk_score_rf AS ref, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS ra, rank() OVER (PARTITION BY model ORDER BY -risk_score_rf) + (count(*) OVER (PARTITION BY model, risk_score_rf) - 1) / 2 AS rb FROM s JOIN apps USING (authorization_id)) GROUP BY 1",
        APPS, SCORES,
    ),
)
def _(spark, sf):
    return bias.selection_correlation(scores(spark, sf), apps(spark, sf))


_AGE = "CASE WHEN age_t1 < 18 THEN NULL WHEN age_t1 < 25 THEN '18-24' WHEN age_t1 < 35 THEN '25-34' WHEN age_t1 < 45 THEN '35-44' WHEN age_t1 < 55 THEN '45-54' WHEN age_t1 < 65 THEN '55-64' WHEN age_t1 < 100 THEN '65-99' END"
IMPACT = f"""ik AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, authorization_id) AS rn, count(*) OVER (PARTITION BY model) AS nt FROM s WHERE mis_date >= DATE '1999-07-01'),
it AS (SELECT model, score AS threshold FROM ik WHERE rn = least(ceil(nt * 10.0::DOUBLE / 100), nt - 1) + 1),
ij AS (SELECT model, {_AGE} AS age_band, score, threshold, y FROM ik JOIN it USING (model) JOIN (SELECT authorization_id, age_t1 FROM apps) USING (authorization_id)),
ig AS (SELECT model, age_band, count(*) AS n, count(*) FILTER (score < threshold) AS approved, avg(y) AS ob FROM ij WHERE age_band IS NOT NULL GROUP BY model, age_band HAVING count(*) >= 10),
impact AS (SELECT model, age_band, n, approved, round(approved / n, 6) AS approval_rate, round(ob, 6) AS observed_bad_rate, round(approved / n / max(approved / n) OVER (PARTITION BY model), 6) AS impact_ratio, CASE WHEN approved / n / max(approved / n) OVER (PARTITION BY model) < 0.8 THEN 'FAIL' ELSE 'PASS' END AS status FROM ig)"""


def impact(spark, sf):
    post = scores(spark, sf).where(F.col("mis_date") >= F.lit(DEFAULT.split_date))
    return bias.adverse_impact(post, apps(spark, sf))


@query("G08_adverse_impact", select("SELECT * FROM impact", APPS, SCORES, IMPACT))
def _(spark, sf):
    return impact(spark, sf)


_BANDS = f"""be AS (SELECT quantile_cont(risk_score_rf, {quantiles(10)}) AS e FROM train),
bd AS (SELECT CAST({right_bin('risk_score_rf', 'e')} AS INTEGER) AS band, count(*) AS n, CAST(sum(target) AS BIGINT) AS bad, round(avg(target), 6) AS rate, min(mis_date) AS source_min_date, max(mis_date) AS source_max_date FROM train, be GROUP BY 1)"""


@query("G09_band_rates", select("SELECT * FROM bd", APPS, MATURED, _BANDS))
def _(spark, sf):
    return bias.band_rates(src.load_booked(apps(spark, sf)))


@query("G10_J01_reject_rates", select(f"SELECT r.authorization_id, band, round(least(rate * 1.5, 0.5), 6)::DOUBLE AS assumed_rate FROM (SELECT *, CAST({right_bin('risk_score_rf', 'e')} AS INTEGER) AS band FROM apps, be WHERE status_name <> 'Booked' AND mis_date < DATE '1999-07-01') r JOIN bd USING (band)", APPS, MATURED, _BANDS))
def _(spark, sf):
    booked, rejected = src.load_with_rejects(apps(spark, sf))
    return bias.reject_rates(booked, rejected).select(ID, "band", "assumed_rate")


@query("G10_pseudo_labels")
def _(spark, sf):
    booked, rejected = src.load_with_rejects(apps(spark, sf))
    return bias.pseudo_labels(booked, rejected, 2000).select(ID, TARGET, "weight", "band", "assumed_rate")


@query("G11_augmentation", select("SELECT weight, count(*) AS n FROM (SELECT 1.0::DOUBLE AS weight FROM train UNION ALL SELECT 0.5 FROM apps WHERE status_name <> 'Booked' AND mis_date < DATE '1996-01-01') GROUP BY 1", APPS, MATURED))
def _(spark, sf):
    train = matured_parts(spark, sf)[0]
    rejects = src.load_with_rejects(apps(spark, sf))[1].where("mis_date < date'1996-01-01'").withColumn("weight", F.lit(DEFAULT.reject_weight))
    return bias.augment(train, rejects).groupBy("weight").agg(F.count("*").alias("n"))


@query("G12_applicant_scores", select("SELECT authorization_id, mis_date, status_name, CASE WHEN status_name = 'Booked' AND target IS NOT NULL THEN 'observed' WHEN status_name = 'Booked' THEN 'immature' ELSE 'unobserved' END AS target_source, target IS NOT NULL AS has_observed_target, round(1 / (1 + exp(-z0)), 6) AS score__scorecard_a FROM z WHERE mis_date >= DATE '1999-07-01'", APPS, SCORES))
def _(spark, sf):
    from ..operators.scorecard import wide_scores

    return bias.applicant_scores(apps(spark, sf), wide_scores(scores(spark, sf), ["Scorecard A"]))


# ---- G: governance ------------------------------------------------------------------------
_QNUM = ["total_amt", "income_t2", "max_credit_tj_av"]


@query(
    "G13_data_quality",
    select(
        "SELECT feature, 'numerical' AS type, count(*) AS n_rows, count(*) - count(value) AS missing_count, round((count(*) - count(value)) / count(*), 6) AS missing_pct, count(DISTINCT value) AS n_unique, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(q25, 6) AS q25, round(q75, 6) AS q75, round(max(value), 6) AS max, count(*) FILTER (value < q25 - 1.5::DOUBLE * (q75 - q25) OR value > q75 + 1.5::DOUBLE * (q75 - q25)) AS n_outliers_iqr FROM qn JOIN qq USING (feature) GROUP BY feature, q25, q75"
        f" UNION ALL SELECT feature, 'categorical', count(*), count(*) - count(value), round((count(*) - count(value)) / count(*), 6), count(DISTINCT value), NULL, NULL, NULL, NULL, NULL, NULL, 0 FROM ({cells('train', CATEGORICAL, kind='VARCHAR')}) GROUP BY feature",
        APPS, MATURED, f"qn AS ({cells('train', _QNUM)})", "qq AS (SELECT feature, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75 FROM qn GROUP BY 1)",
    ),
)
def _(spark, sf):
    return governance.data_quality(matured_parts(spark, sf)[0], _QNUM)


_DICT = [("total_amt", "raw"), ("tenor", "raw"), ("age_t1", "raw"), ("csp", "raw"), ("amt_per_month", "engineered")]


@query("G14_variable_dictionary", select("SELECT feature, CASE WHEN feature = 'csp' THEN 'categorical' ELSE 'numerical' END AS type, source, CASE feature WHEN 'age_t1' THEN 'decreasing' WHEN 'amt_per_month' THEN 'increasing' ELSE 'none' END AS monotone_constraint, iv AS information_value, source = 'raw' AS in_raw, feature IN ('age_t1', 'amt_per_month') AS in_monotone_map FROM (VALUES " + ", ".join(f"('{f}', '{p}')" for f, p in _DICT) + ") AS d(feature, source) LEFT JOIN iv USING (feature)", APPS, MATURED, _WOE))
def _(spark, sf):
    features = spark.createDataFrame(_DICT, "feature string, provenance string")
    return governance.variable_dictionary(features, stability.information_value(woe(spark, sf)), [*NUMERIC, "amt_per_month"], [*NUMERIC, *CATEGORICAL])


@query("G15_model_card")
def _(spark, sf):
    board = metrics.leaderboard(window_scores(spark, sf))
    best = card(spark, sf)
    name = metrics.selected_model(board, best).first()[0]
    report = stability.stability_report(*(window_scores(spark, sf, p).withColumnRenamed("score", "value") for p in ("development", "selection")), csi(spark, sf))
    compared = comparisons(spark, sf)
    text = governance.model_card(name, DEFAULT, board, timesplit.population_coverage(apps(spark, sf)), stability.information_value(woe(spark, sf)), report, impact(spark, sf), compared, best, metrics.rolling_summary(rolling(spark, sf)))
    path = files.scratch(spark, "card")
    files.write_text(spark.createDataFrame([(line,) for line in text.split("\n")], "value string"), path)
    return files.read_text(spark, path)


@query("G16_benchmark_result", "SELECT name, CASE WHEN coalesce(pa, p) >= 0.05 THEN 'ns' WHEN d > 0 THEN 'win' WHEN d < 0 THEN 'loss' ELSE 'tie' END AS result FROM (VALUES ('a', 0.1, 0.01, NULL), ('b', -0.1, 0.01, NULL), ('c', 0.1, 0.01, 0.2), ('d', 0.0, NULL, NULL)) AS t(name, d, p, pa)")
def _(spark, sf):
    rows = spark.createDataFrame([("a", 0.1, 0.01, None), ("b", -0.1, 0.01, None), ("c", 0.1, 0.01, 0.2), ("d", 0.0, None, None)], "name string, d double, p double, pa double")
    return rows.select("name", governance.benchmark_result(F.col("d"), F.col("pa"), F.col("p")).alias("result"))


# ---- J: joins -----------------------------------------------------------------------------
@query("J04_semi_anti", select("SELECT CASE WHEN authorization_id IN (SELECT authorization_id FROM train) THEN 'semi' ELSE 'anti' END AS side, count(*) AS n FROM apps GROUP BY 1", APPS, MATURED))
def _(spark, sf):
    every, ids = apps(spark, sf), matured_parts(spark, sf)[0].select(ID)
    side = lambda how, name: every.join(ids, ID, how).agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return side("left_semi", "semi").unionByName(side("left_anti", "anti"))


@query("J08_J09_unions", select("SELECT value, count(*) FILTER (part = 'a') AS n_train, count(*) FILTER (part = 'b') AS n_test FROM (SELECT csp AS value, 'a' AS part FROM train UNION ALL SELECT csp, 'b' FROM test) GROUP BY 1", APPS, MATURED))
def _(spark, sf):
    a, b = (p.groupBy(F.col("csp").alias("value")).agg(F.count("*").alias(n)) for p, n in zip(matured_parts(spark, sf), ("n_train", "n_test"), strict=True))
    return a.join(b, "value", "full").na.fill(0, ["n_train", "n_test"])


@query("J11_R03_status_pivot", select(f"SELECT split, CAST(coalesce(sum(n) FILTER (status_name = 'Booked'), 0) AS BIGINT) AS booked, CAST(coalesce(sum(n) FILTER (status_name = 'Rejected'), 0) AS BIGINT) AS rejected, CAST(coalesce(sum(n) FILTER (status_name = 'Canceled'), 0) AS BIGINT) AS canceled, CAST(sum(n) AS BIGINT) AS total FROM ({COVERAGE}) GROUP BY 1", APPS))
def _(spark, sf):
    return present.population_bars(timesplit.population_coverage(apps(spark, sf)))


# ---- R: presentation ----------------------------------------------------------------------
@query("R01_kpi_tiles", select(f"SELECT label, CAST(value AS BIGINT) AS value FROM (SELECT unnest(['scored', 'booked', 'rejected', 'canceled', 'holdout_rows', 'observed_bads']) AS label, unnest([sum(n), sum(n) FILTER (status_name = 'Booked'), sum(n) FILTER (status_name = 'Rejected'), sum(n) FILTER (status_name = 'Canceled'), (SELECT count(*) FROM sel WHERE model = 'Scorecard B'), sum(n_bad)]) AS value FROM ({COVERAGE}) WHERE split = 'post_split')", APPS, SCORES))
def _(spark, sf):
    return present.kpi_tiles(timesplit.population_coverage(apps(spark, sf)), metrics.evaluate(window_scores(spark, sf)), "Scorecard B")


@query("R04_ordered_models", select("SELECT *, CASE model WHEN 'Scorecard A' THEN 1 WHEN 'Scorecard B' THEN 2 WHEN 'Scorecard C' THEN 3 ELSE 4 END AS position FROM e WHERE NOT contains(model, '(calibrated)')", APPS, SCORES, EVAL))
def _(spark, sf):
    return present.ordered_models(metrics.evaluate(window_scores(spark, sf)), MODELS)


@query("R05_R06_lift_forest_and_rolling", select("SELECT candidate, delta, delta_lo FROM co", *CARD_CTES[:-1]))
def _(spark, sf):
    return comparisons(spark, sf).select("candidate", "delta", "delta_lo")


@query("R07_J02_raw_vs_calibrated", select("SELECT e.model, e.brier AS brier_raw, c.brier AS brier_calibrated, round(e.brier - c.brier, 6) AS improvement FROM e JOIN e c ON c.model = e.model || ' (calibrated)'", APPS, SCORES, EVAL))
def _(spark, sf):
    return present.raw_vs_calibrated(metrics.evaluate(window_scores(spark, sf)))


@query("R09_gains", select("SELECT model, decile, round(sum(n_accounts) OVER (PARTITION BY model ORDER BY decile) / sum(n_accounts) OVER (PARTITION BY model), 6) AS population, capture_rate AS captured FROM lift UNION ALL SELECT DISTINCT model, 0, 0.0, 0.0 FROM lift", APPS, SCORES, LIFT))
def _(spark, sf):
    return present.gains(metrics.lift_table(window_scores(spark, sf)))


@query("R12_executive_summary", select("SELECT e.model, roc_auc, pr_auc, ks, capture AS capture_at_10 FROM e JOIN (SELECT model, round(sum(y) FILTER (rn <= ceil(nt * 0.1)) / sum(y), 6) AS capture FROM k GROUP BY 1) USING (model) WHERE NOT contains(model, '(') ORDER BY pr_auc DESC, roc_auc DESC LIMIT 1", APPS, SCORES, EVAL, _RANK))
def _(spark, sf):
    s = window_scores(spark, sf)
    return present.executive_summary(metrics.evaluate(s), metrics.capture_at(s))


@query(
    "R13_psi_timeline",
    select(
        f"SELECT model, mis_date, n, round({PSI}, 6) AS psi FROM (SELECT g.model, g.mis_date, g.n, coalesce(x.e, 0) AS e, coalesce(q.c, 0) / g.n AS a FROM (SELECT model, mis_date, count(*) AS n FROM sel GROUP BY ALL) g JOIN sp USING (model) LEFT JOIN (SELECT model, bin, c / sum(c) OVER (PARTITION BY model) AS e FROM pb) x ON x.model = g.model AND x.bin = sp.bin LEFT JOIN (SELECT model, mis_date, {left_bin('score', 'e')} AS bin, count(*) AS c FROM sel JOIN ed USING (model) GROUP BY ALL) q ON q.model = g.model AND q.mis_date = g.mis_date AND q.bin = sp.bin) GROUP BY model, mis_date, n",
        APPS, SCORES, _PSI_CTES,
    ),
)
def _(spark, sf):
    value = lambda part: window_scores(spark, sf, part).withColumnRenamed("score", "value")
    return stability.psi_timeline(value("development"), value("selection"), "mis_date")


@query("R14_top_drivers", select("SELECT 'iv' AS model, feature, iv AS importance, CAST(row_number() OVER (ORDER BY iv DESC, feature) AS INTEGER) AS rank FROM iv QUALIFY rank <= 10", APPS, MATURED, _WOE))
def _(spark, sf):
    rows = stability.information_value(woe(spark, sf)).select(F.lit("iv").alias("model"), "feature", F.col("iv").alias("importance"))
    return present.top_drivers(rows)


@query("R15_selected_model", select("SELECT model FROM card WHERE recommended", *CARD_CTES))
def _(spark, sf):
    return metrics.selected_model(metrics.evaluate(window_scores(spark, sf)), card(spark, sf))


@query("R16_report_facts", select("SELECT (SELECT arg_max(model, (roc_auc, model)) FROM e WHERE NOT regexp_matches(model, 'calibrated|Ensemble')) AS best_auc_model, (SELECT arg_max(model, (pr_auc, model)) FROM e WHERE NOT regexp_matches(model, 'calibrated|Ensemble')) AS best_pr_model, (SELECT arg_max(model, (auc_delta, model)) FROM ov WHERE model <> 'Scorecard B') AS worst_peer, (SELECT max(auc_delta) FROM ov WHERE model <> 'Scorecard B') AS worst_peer_delta, (SELECT max(capture_rate) FROM lift WHERE model = 'Scorecard B' AND decile <= 2) AS top2_capture, (SELECT lift FROM lift WHERE model = 'Scorecard B' AND decile = 1) AS top_lift, (SELECT count(*) FROM impact WHERE model = 'Scorecard B' AND status = 'FAIL') AS n_failing, coalesce((SELECT string_agg(age_band, ', ' ORDER BY age_band) FROM impact WHERE model = 'Scorecard B' AND status = 'FAIL'), '') AS failing_bands", APPS, SCORES, EVAL, evaluation("dev", name="ed"), OVERFIT, LIFT, IMPACT))
def _(spark, sf):
    s = window_scores(spark, sf)
    return present.report_facts(metrics.evaluate(s), overfit(spark, sf), metrics.lift_table(s), impact(spark, sf), "Scorecard B")


@query("R17_histogram", select("SELECT model, y, bin, n, round(n / (sum(n) OVER (PARTITION BY model, y) * nullif(width, 0)), 6) AS density FROM (SELECT model, y, CAST(coalesce(least(floor((score - lo) / nullif(width, 0)), 49), 0) AS INTEGER) AS bin, width, count(*) AS n FROM (SELECT sel.*, lo, (hi - lo) / 50 AS width FROM sel JOIN (SELECT model, min(score) AS lo, max(score) AS hi FROM sel GROUP BY 1) USING (model)) GROUP BY ALL)", APPS, SCORES))
def _(spark, sf):
    return metrics.histogram(window_scores(spark, sf))


# ---- streaming extension ------------------------------------------------------------------
_EDGES = [float("-inf"), 20.0, 40.0, 60.0, 80.0, float("inf")]
_share = " + ".join(f"(greatest(count(*) FILTER ({c}) / count(*), 1e-6) - 0.2) * ln(greatest(count(*) FILTER ({c}) / count(*), 1e-6) / 0.2)" for c in ("value < 20", "value >= 20 AND value < 40", "value >= 40 AND value < 60", "value >= 60 AND value < 80", "value >= 80"))


@query("stream_psi", f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, round({_share}, 6) AS psi FROM events WHERE value IS NOT NULL GROUP BY 1")
def _(spark, sf):
    rows = src.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = monitor.binned_counts(rows, _EDGES, window="1 day")
    return monitor.psi_by_window(counts, [0.2] * 5).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# ---- M: models ----------------------------------------------------------------------------
def features(spark, sf):
    train, test = (fx.engineer(p, []) for p in matured_parts(spark, sf))
    selection = test.where(F.col("mis_date") < F.lit(DEFAULT.selection_date))
    out = []
    for name, part in (("train", train), ("selection", selection)):  # written once and read by every fold and fit, cached for nobody
        path = files.scratch(spark, f"features-{name}")
        files.write_table(part, path)
        out.append(spark.read.schema(part.schema).parquet(path))
    return tuple(out)


for _name, _key in (("M01_logistic", "Logistic Regression"), ("M02_additive", "EBM"), ("M03_boosted", "LightGBM"), ("M04_boosted_shallow", "XGBoost"), ("M05_forest", "CatBoost")):
    query(_name)(lambda spark, sf, k=_key: metrics.evaluate(models.scored(models.SPECS[k], *features(spark, sf), models.FEATURES)))


@query("M06_out_of_fold")
def _(spark, sf):
    return models.out_of_fold(models.SPECS["Logistic Regression"], features(spark, sf)[0], DEFAULT.cv_folds, models.FEATURES)


@query("M07_stacking")
def _(spark, sf):
    return metrics.evaluate(models.stack(list(models.SPECS.values()), *features(spark, sf), DEFAULT.cv_folds, models.FEATURES))


@query("M08_calibration")
def _(spark, sf):
    train, test = features(spark, sf)
    halves = timesplit.calibration_split(train)
    out = None
    for name, spec in models.SPECS.items():
        done = models.calibrate(spec.fit(halves.where("part = 'fit'").drop("part"), models.FEATURES), halves.where("part = 'calibration'").drop("part"), spec.calibration)
        rows = test.select(ID, F.col(TARGET).alias("y")).join(done.score(test), ID).withColumn("model", F.lit(f"{name} (calibrated)"))
        out = rows if out is None else out.unionByName(rows)
    return metrics.evaluate(out)


@query("M09_conservative_rounds", "SELECT * FROM (VALUES ('known', 130), ('none', 1000)) AS t(name, rounds)")
def _(spark, sf):
    return spark.createDataFrame([("known", models.conservative_rounds([120, 140, None, 300])), ("none", models.conservative_rounds([None]))], "name string, rounds int")


@query("M10_class_weights", select("SELECT round((count(*) - sum(target)) / sum(target), 6) AS pos_weight, round(count(*) / (2 * (count(*) - sum(target))), 6) AS w0, round(count(*) / (2 * sum(target)), 6) AS w1 FROM train", APPS, MATURED))
def _(spark, sf):
    train = matured_parts(spark, sf)[0]
    low, high = models.class_weights(train)
    return spark.createDataFrame([(round(models.pos_weight(train), 6), round(low, 6), round(high, 6))], "pos_weight double, w0 double, w1 double")


@query("M12_linear_contributions")
def _(spark, sf):
    train, test = features(spark, sf)
    return models.linear_contributions(models.SPECS["Logistic Regression"].fit(train, models.FEATURES), test, "Logistic Regression")


@query("M12_permutation_importance")
def _(spark, sf):
    train, test = features(spark, sf)
    return models.permutation_importance(models.SPECS["CatBoost"].fit(train, models.FEATURES), test, "CatBoost")


@query("M13_S08_tuning_trials")
def _(spark, sf):
    path = files.scratch(spark, "trials")  # the history is what comes back from its sink
    files.write_table(models.tune(models.SPECS["Logistic Regression"], features(spark, sf)[0], features=models.FEATURES).trials, path)
    return spark.read.parquet(path)


#: Trials of the registered tuned models, in folds of their own; tune() itself takes DEFAULT.n_trials.
_TRIALS, _CEILING = 4, 40


def tuned(spark, sf, key):
    """Metrics of a model refitted on all training rows with the settings its trials chose."""
    train, test = features(spark, sf)
    spec = models.tune(models.SPECS[key], train, _TRIALS, DEFAULT.cv_folds, models.FEATURES, _CEILING).spec
    return metrics.evaluate(models.scored(spec, train, test, models.FEATURES))


for _name, _key in (("M01_logistic_tuned", "Logistic Regression"), ("M02_additive_tuned", "EBM"), ("M03_boosted_tuned", "LightGBM"), ("M04_boosted_shallow_tuned", "XGBoost"), ("M05_forest_tuned", "CatBoost")):
    query(_name)(lambda spark, sf, k=_key: tuned(spark, sf, k))


@query("M11_safe_splits", select("SELECT CAST(least(5, count(target), sum(target), count(target) - sum(target)) AS INTEGER) AS folds FROM train", APPS, MATURED))
def _(spark, sf):
    return spark.createDataFrame([(models.safe_splits(matured_parts(spark, sf)[0]),)], "folds int")


@query("M11_refit")
def _(spark, sf):
    """A model fitted on the first half of the training rows, fitted anew from its own settings on all of them."""
    train, test = features(spark, sf)
    fitted = models.SPECS["Logistic Regression"].fit(timesplit.calibration_split(train).where("part = 'fit'").drop("part"), models.FEATURES).refit(train)
    return metrics.evaluate(test.select(ID, F.col(TARGET).alias("y")).join(fitted.score(test), ID).withColumn("model", F.lit("refitted")))


@query("D08_stability_selection")
def _(spark, sf):
    return models.stability_selection(features(spark, sf)[0], models.FEATURES, DEFAULT.cv_folds, discovery.CS, discovery.L1S)


def discovered(spark, sf):
    train, test = features(spark, sf)
    return train, test, discovery.discover(train, NUMERIC, CATEGORICAL, models.NUMERIC_FEATURES)


@query("D09_discovery_workflow")
def _(spark, sf):
    """The frozen list with where each feature comes from."""
    return discovered(spark, sf)[2].provenance


@query("E18_rolling_refit")
def _(spark, sf):
    return models.rolling_validation(list(models.SPECS.values()), features(spark, sf)[0], features=models.FEATURES)


@query("E26_ablations")
def _(spark, sf):
    train, test, d = discovered(spark, sf)
    train, test = d.design(train, test)
    raw = [*NUMERIC, *CATEGORICAL]
    sets = {"raw": raw, "with engineered": [*d.base, *CATEGORICAL], "with interactions": [*d.base, *CATEGORICAL, *d.names], "candidates": d.candidates, "frozen": d.frozen}
    return models.ablations(train, test, sets)


@query("E27_importance")
def _(spark, sf):
    return models.importance(models.SPECS["LightGBM"].fit(features(spark, sf)[0], models.FEATURES), "LightGBM")


@query("S07_F21_model_store")
def _(spark, sf):
    train, test = features(spark, sf)
    fitted, path = models.SPECS["Logistic Regression"].fit(train, models.FEATURES), files.scratch(spark, "model")
    fitted.save(path)
    again = models.Fitted.load(spark, path, fitted.features, fitted.spec)
    return again.score(test).withColumn("tier", fx.risk_tier(F.col("score")))


@query("T11_R02_status_flow", select("SELECT status_name, count(*) AS n, CAST(sum(CAST(target IS NOT NULL AS INTEGER)) AS BIGINT) AS observed FROM apps GROUP BY 1", APPS))
def _(spark, sf):
    return apps(spark, sf).groupBy(STATUS).agg(F.count("*").alias("n"), F.count(TARGET).alias("observed"))

