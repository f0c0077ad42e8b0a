"""Scans of application records and the view that makes them from order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import DATE, DEFAULT, ID, STATUS, TARGET, Params


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is null everywhere: NaN would sort above all numbers and enter percentiles."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order, seen as a loan application. Months are date blocks.

    Lines are summed per order before the join, so both sides meet on the order key once, and
    customer, nation and region are small enough to be broadcast when their size says so.
    """
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("ext"), F.round(F.sum("l_quantity"), 2).alias("qty"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_r"), F.count_if(F.col("l_linestatus") == "F").alias("n_f"),
        F.count_if((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A")).alias("n_fa"), F.count_if(F.col("l_quantity") > 25).alias("n_q"),
    )
    customers = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    orders = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    observed = (F.col("o_orderstatus") == "F") & (month < F.lit("2001-02-01").cast("date")) & F.col("n_lines").isNotNull()
    return orders.select(
        F.col("o_orderkey").alias(ID),
        month.alias(DATE),
        F.when(F.col("o_orderstatus") == "F", "Booked").when(F.col("o_orderstatus") == "O", "Rejected").otherwise("Canceled").alias(STATUS),
        F.when(observed, (2 * F.col("n_r") > F.col("n_lines")).cast("double")).alias(TARGET),
        F.col("o_totalprice").alias("total_amt"),
        (F.col("ext") / F.col("n_lines") / 100).alias("installment_amt"),
        (F.col("n_lines") * 12).cast("double").alias("tenor"),
        F.col("c_acctbal").alias("income_t1"),
        F.when(F.col("c_custkey") % 3 != 0, F.abs("c_acctbal") / 2).alias("income_t2"),
        F.col("qty").alias("max_credit_tj_av"),
        (18 + F.col("o_custkey") % 50).cast("double").alias("age_t1"),
        F.col("n_lines").cast("double").alias("total_loan_nbr"),
        F.col("n_f").cast("double").alias("total_card_nbr"),
        F.col("n_q").cast("double").alias("book_loan_nbr"),
        F.col("n_fa").cast("double").alias("book_card_nbr"),
        F.col("c_mktsegment").alias("house_type"),
        F.col("o_orderpriority").alias("customer_type"),
        F.col("r_name").alias("product_type_3"),
        F.col("n_name").alias("csp"),
        F.col("c_acctbal").alias("risk_score_rf"),
        (F.col("o_orderkey") * 7919 % 1000 / 10).alias("score_rf"),
    )


def load_booked(df: DataFrame) -> DataFrame:
    return df.where(F.col(STATUS) == "Booked")


def load_with_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(booked, rejected or canceled)."""
    return load_booked(df), df.where(F.col(STATUS).isin("Rejected", "Canceled"))


def load_population(df: DataFrame, mode: str, reject_inference: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Booked rows, and the rejects if the mode or reject inference asks for them."""
    if mode not in ("booked_monitoring", "underwriting"):
        raise ValueError(f"unknown population mode {mode!r}")
    return load_with_rejects(df) if mode == "underwriting" or reject_inference else (load_booked(df), None)


def matured(params: Params = DEFAULT) -> Column:
    return (F.col(DATE) <= F.lit(params.maturity_cutoff)) & F.col(TARGET).isNotNull()


def load_summary(df: DataFrame) -> DataFrame:
    """One row: booked rows by outcome and their dates."""
    return load_booked(df).agg(
        F.count("*").alias("n"), F.count_if(F.col(TARGET) == 0).alias("n_negative"), F.count_if(F.col(TARGET) == 1).alias("n_positive"),
        F.count_if(F.col(TARGET).isNull()).alias("n_immature"), F.min(DATE).alias("min_date"), F.max(DATE).alias("max_date"),
    )


def reject_summary(df: DataFrame, score: str = "risk_score_rf") -> DataFrame:
    """By status: rows and the share that has the benchmark score."""
    return df.groupBy(STATUS).agg(F.count("*").alias("n"), F.round(F.avg(F.col(score).isNotNull().cast("double")), 6).alias("score_share"))
