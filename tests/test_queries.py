"""Every query with SQL gives the same rows as DuckDB; the others give rows."""

from __future__ import annotations

import datetime
import os

import duckdb
import pytest

from calibra.plans import data, models_eval, risk  # noqa: F401  these register the queries
from calibra.plans.catalog import ORACLES, QUERIES


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.date().isoformat() if v.time() == datetime.time() else v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return 0.0 if isinstance(v, float) and v == 0 else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, sf, name):
    cur = duck.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    want = sorted(repr([plain(v) for v in r]) for r in cur.fetchall())
    got = QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(repr([plain(v) for v in r]) for r in got.select(*(f"`{c}`" for c in columns)).collect()) == want


@pytest.mark.parametrize("name", ["E13_paired_bootstrap", "E16_bootstrap_intervals", "G10_pseudo_labels", "G15_model_card", "M01_logistic", "M05_forest", "M06_out_of_fold", "M08_calibration", "E27_importance", "M11_refit", "S07_F21_model_store"])
def test_query_gives_rows(spark, sf, name):
    assert not QUERIES[name](spark, sf).isEmpty()
    spark.catalog.clearCache()
