"""Building blocks of the SQL that checks the queries: common table expressions over the order tables."""

from __future__ import annotations

APPS = """
li AS (SELECT l_orderkey, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS ext, round(sum(l_quantity), 2) AS qty, count(*) FILTER (l_returnflag = 'R') AS n_r,
  count(*) FILTER (l_linestatus = 'F') AS n_f, count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'A') AS n_fa, count(*) FILTER (l_quantity > 25) AS n_q FROM lineitem GROUP BY l_orderkey),
apps AS (SELECT o_orderkey AS authorization_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS mis_date,
  CASE o_orderstatus WHEN 'F' THEN 'Booked' WHEN 'O' THEN 'Rejected' ELSE 'Canceled' END AS status_name,
  CASE WHEN o_orderstatus = 'F' AND CAST(date_trunc('month', o_orderdate) AS DATE) < DATE '2001-02-01' AND n_lines IS NOT NULL THEN CAST(2 * n_r > n_lines AS DOUBLE) END AS target,
  o_totalprice AS total_amt, ext / n_lines / 100 AS installment_amt, CAST(n_lines * 12 AS DOUBLE) AS tenor, c_acctbal AS income_t1,
  CASE WHEN c_custkey % 3 <> 0 THEN abs(c_acctbal) / 2 END AS income_t2, qty AS max_credit_tj_av, CAST(18 + o_custkey % 50 AS DOUBLE) AS age_t1,
  CAST(n_lines AS DOUBLE) AS total_loan_nbr, CAST(n_f AS DOUBLE) AS total_card_nbr, CAST(n_q AS DOUBLE) AS book_loan_nbr, CAST(n_fa AS DOUBLE) AS book_card_nbr,
  c_mktsegment AS house_type, o_orderpriority AS customer_type, r_name AS product_type_3, n_name AS csp, c_acctbal AS risk_score_rf, (o_orderkey * 7919 % 1000) / 10.0::DOUBLE AS score_rf
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN li ON o_orderkey = l_orderkey)"""

MATURED = """m AS (SELECT * FROM apps WHERE mis_date <= DATE '2001-01-01' AND target IS NOT NULL),
train AS (SELECT * FROM m WHERE mis_date < DATE '1999-07-01'),
test AS (SELECT * FROM m WHERE mis_date >= DATE '1999-07-01')"""

_Z = ["-1.6 + 0.000002 * total_amt - 0.00005 * coalesce(income_t1, 0) + 0.01 * (age_t1 - 40)", "-1.4 + 0.004 * coalesce(tenor, 0) + 0.3 * CAST(income_t2 IS NOT NULL AS DOUBLE) - 0.002 * coalesce(max_credit_tj_av, 0)", "-1.5 + 0.0005 * coalesce(installment_amt, 0) + 0.02 * coalesce(total_card_nbr, 0) - 0.01 * (age_t1 - 40)"]
MODELS = ["Scorecard A", "Scorecard B", "Scorecard C"]
_names = MODELS + [f"{n} (calibrated)" for n in MODELS] + ["risk_score_rf (benchmark)", "score_RF (benchmark)"]
_values = [f"round(1 / (1 + exp(-z{i})), 6)" for i in range(3)] + [f"round(1 / (1 + exp(-(0.5 * z{i} - 0.7))), 6)" for i in range(3)] + ["-risk_score_rf", "-score_rf"]
_rows = " UNION ALL ".join(f"SELECT authorization_id, mis_date, status_name, target AS y, '{n}' AS model, {v} AS score FROM z" for n, v in zip(_names, _values, strict=True))
SCORES = f"""z AS MATERIALIZED (SELECT *, {", ".join(f"{e} AS z{i}" for i, e in enumerate(_Z))} FROM apps),
s AS ({_rows}),
sel AS (SELECT * FROM s WHERE y IS NOT NULL AND mis_date >= DATE '1999-07-01' AND mis_date < DATE '2000-04-01'),
dev AS (SELECT * FROM s WHERE y IS NOT NULL AND mis_date < DATE '1999-07-01')"""


def curve(src: str, keys: str = "model", name: str = "c") -> str:
    """<name>: keys, score, pos, neg, tp, fp, p, n of a source."""
    return f"""{name}_d AS (SELECT {keys}, score, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM {src} WHERE y IS NOT NULL AND score IS NOT NULL AND isfinite(score) GROUP BY ALL),
{name} AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {keys}) AS p, sum(neg) OVER (PARTITION BY {keys}) AS n FROM {name}_d WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC))"""


def ranking(src: str, keys: str = "model", name: str = "r") -> str:
    """<name>: keys, roc_auc, pr_auc, ks, n_rows, n_pos."""
    return f"""{curve(src, keys, name + "_c")},
{name} AS (SELECT {keys}, CASE WHEN any_value(p) > 0 AND any_value(n) > 0 THEN sum(neg * (tp - pos + pos / 2)) / CAST(any_value(p) * any_value(n) AS DOUBLE) END AS roc_auc,
  CASE WHEN any_value(p) > 0 AND any_value(n) > 0 THEN sum(pos * tp / (tp + fp)) / any_value(p) END AS pr_auc,
  CASE WHEN any_value(p) > 0 AND any_value(n) > 0 THEN max(abs(tp / p - fp / n)) END AS ks, any_value(p) + any_value(n) AS n_rows, any_value(p) AS n_pos FROM {name}_c GROUP BY {keys})"""


def evaluation(src: str, keys: str = "model", name: str = "e") -> str:
    """<name>: the evaluation table of a source."""
    on = " AND ".join(f"{name}_r.{k.strip()} = {name}_b.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"{name}_r.{k.strip()}" for k in keys.split(","))
    return f"""{ranking(src, keys, name + "_r")},
{name}_b AS (SELECT {keys}, CASE WHEN bool_and(score >= 0 AND score <= 1 + 1e-9) THEN avg((least(greatest(score, 0), 1) - y) ** 2) END AS brier FROM {src} WHERE y IS NOT NULL AND score IS NOT NULL GROUP BY {keys}),
{name} AS (SELECT {own}, round(roc_auc, 6) AS roc_auc, round(2 * round(roc_auc, 12) - 1, 6) AS gini, round(ks, 6) AS ks, round(pr_auc, 6) AS pr_auc, CAST(n_rows AS BIGINT) AS n, round(brier, 6) AS brier FROM {name}_r JOIN {name}_b ON {on})"""


def windows(src: str, k: int, name: str = "w") -> str:
    """<name>: rolling windows (window, valid_from, valid_until, n_blocks) of a source."""
    return f"""{name}_b AS (SELECT mis_date, row_number() OVER (ORDER BY mis_date) - 3 AS i, count(*) OVER () - 2 AS m FROM (SELECT DISTINCT mis_date FROM {src})),
{name}_k AS (SELECT *, least({k}, m) AS k, m // least({k}, m) AS sz, m % least({k}, m) AS ex FROM {name}_b WHERE i >= 0),
{name} AS (SELECT CAST(CASE WHEN i < ex * (sz + 1) THEN i // (sz + 1) ELSE ex + (i - ex * (sz + 1)) // sz END + 1 AS INTEGER) AS win, min(mis_date) AS valid_from, max(mis_date) AS valid_until, count(*) AS n_blocks FROM {name}_k GROUP BY win)"""


def select(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def cells(df: str, columns: list[str], keep: str = "", kind: str = "DOUBLE") -> str:
    """SELECT keep, feature, value over a relation's columns."""
    return " UNION ALL ".join(f"SELECT {keep + ', ' if keep else ''}'{c}' AS feature, CAST({c} AS {kind}) AS value FROM {df}" for c in columns)


def left_bin(x: str, edges: str) -> str:
    return f"len(list_filter({edges}[2:len({edges}) - 1], lambda e: e <= {x}))"


def right_bin(x: str, edges: str) -> str:
    return f"len(list_filter({edges}[2:len({edges}) - 1], lambda e: e < {x}))"


def quantiles(bins: int) -> str:
    return "[" + ", ".join(repr(k / bins) for k in range(bins + 1)) + "]"


def distinct(edges: str) -> str:
    return f"list_sort(list_distinct({edges}))"


PSI = "sum((greatest(a, 1e-6) - greatest(e, 1e-6)) * ln(greatest(a, 1e-6) / greatest(e, 1e-6)))"
BAND = "CASE WHEN {x} < 0.10 THEN 'stable' WHEN {x} < 0.25 THEN 'moderate' ELSE 'significant' END"
