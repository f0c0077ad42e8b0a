"""Scalar feature functions as column expressions; all stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT, MISS_CANDIDATES, Params

CROSSES = {"prodtype3_x_house": ("product_type_3", "house_type"), "prodtype3_x_custtype": ("product_type_3", "customer_type"), "custtype_x_house": ("customer_type", "house_type")}
RATIOS = ["codebtor_income_share", "installment_to_income", "total_amt_to_income", "amt_per_month", "installment_to_household", "total_amt_to_household", "book_ratio_loan", "book_ratio_card"]
ENGINEERED = [
    "total_products", "has_codebtor", "household_income", *RATIOS, "codebtor_x_inst_to_inc", "codebtor_x_amt_to_inc", "codebtor_x_amt_per_month",
    "has_cards", "has_loans", "log_income_t1", "log_total_amt", "log_max_credit", *CROSSES,
]


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def log1p_positive(x: Column) -> Column:
    """ln(1 + x) with negatives as 0; null stays null."""
    return F.log1p(F.when(x < 0, 0.0).otherwise(x))


def cross(a: str, b: str) -> Column:
    """a_b, null if either is."""
    return F.concat(F.col(a), F.lit("_"), F.col(b))


def engineered_columns() -> dict[str, Column]:
    c = F.col
    has = c("income_t2").isNotNull().cast("int")
    household = c("income_t1") + F.coalesce("income_t2", F.lit(0.0))
    to_income, amt_income, monthly = ratio(c("installment_amt"), c("income_t1")), ratio(c("total_amt"), c("income_t1")), ratio(c("total_amt"), c("tenor"))
    positive = lambda x: F.coalesce(c(x) > 0, F.lit(False)).cast("int")
    times = lambda x: has * F.coalesce(x, F.lit(0.0))
    return {
        "total_products": c("total_card_nbr") + c("total_loan_nbr"),
        "has_codebtor": has,
        "household_income": household,
        "codebtor_income_share": ratio(c("income_t2"), household),
        "installment_to_income": to_income,
        "total_amt_to_income": amt_income,
        "amt_per_month": monthly,
        "installment_to_household": ratio(c("installment_amt"), household),
        "total_amt_to_household": ratio(c("total_amt"), household),
        "codebtor_x_inst_to_inc": times(to_income),
        "codebtor_x_amt_to_inc": times(amt_income),
        "codebtor_x_amt_per_month": times(monthly),
        "book_ratio_loan": ratio(c("book_loan_nbr"), c("total_loan_nbr")),
        "book_ratio_card": ratio(c("book_card_nbr"), c("total_card_nbr")),
        "has_cards": positive("total_card_nbr"),
        "has_loans": positive("total_loan_nbr"),
        "log_income_t1": log1p_positive(c("income_t1")),
        "log_total_amt": log1p_positive(c("total_amt")),
        "log_max_credit": log1p_positive(c("max_credit_tj_av")),
        **{name: cross(a, b) for name, (a, b) in CROSSES.items()},
    }


def missing_flags(df: DataFrame, candidates: Sequence[str] = MISS_CANDIDATES, rate: float = DEFAULT.missing_rate) -> list[str]:
    """The candidates missing more often than the rate; one aggregate."""
    row = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in candidates)).first()
    return [c for c in candidates if (row[c] or 0.0) > rate]


def engineer(df: DataFrame, flagged: Sequence[str] | None = None, params: Params = DEFAULT) -> DataFrame:
    """All engineered columns in one projection. Flags are decided on df unless given, so several frames can share them."""
    flags = missing_flags(df, rate=params.missing_rate) if flagged is None else flagged
    return df.withColumns(engineered_columns() | {f"miss_{c}": F.col(c).isNull().cast("int") for c in flags})


def normalize_interaction(name: str) -> str:
    return name.replace("/", "_DIV_").replace("*", "_X_")


def bin_index(x: Column, inner: Sequence[float] | Column, closed: str) -> Column:
    """Number of inner edges below x: `<=` x for bins closed on the left, `<` x for bins closed on the right; null for null."""
    edges = inner if isinstance(inner, Column) else F.array(*(F.lit(float(e)) for e in inner)) if len(inner) else F.array().cast("array<double>")
    below = (lambda e: e <= x) if closed == "left" else (lambda e: e < x)
    return F.when(x.isNotNull(), F.size(F.filter(edges, below)))


def bin_label(x: Column, edges: Sequence[float]) -> Column:
    """The bin of x among stored edges (right-closed), as text; `missing` for null."""
    inner = sorted(set(edges))[1:-1]
    return F.when(x.isNull(), "missing").otherwise(F.concat(F.lit("bin"), bin_index(x, inner, "right").cast("string")))


def interaction(kind: str, a: str, b: str, edges: Sequence[float] = ()) -> tuple[str, Column]:
    """Name and expression of an interaction column."""
    if kind == "ratio":
        return f"{a}_DIV_{b}", ratio(F.col(a), F.col(b))
    if kind == "product":
        return f"{a}_X_{b}", F.col(a) * F.col(b)
    if kind == "cat_concat":
        return f"{a}_x_{b}", F.concat(F.coalesce(a, F.lit("missing")), F.lit("_"), F.coalesce(b, F.lit("missing")))
    if kind == "binned_num_cat":
        return f"BIN_{a}_x_{b}", F.concat(bin_label(F.col(a), edges), F.lit("_"), F.coalesce(b, F.lit("missing")))
    raise ValueError(f"unknown interaction {kind!r}")


def add_interactions(df: DataFrame, found: Sequence[tuple[str, str, str, Sequence[float]]]) -> DataFrame:
    """Adds (kind, a, b, edges) columns; those already there are left alone."""
    new = dict(interaction(kind, a, b, edges) for kind, a, b, edges in found)
    return df.withColumns({name: col for name, col in new.items() if name not in df.columns})


def risk_tier(p: Column, tiers: Sequence[tuple[str, float]] = DEFAULT.tiers) -> Column:
    """The first tier whose upper bound p is below; UNKNOWN for null, negative or larger values."""
    out = F.when(p.isNull() | (p < 0), "UNKNOWN")
    for name, bound in tiers:
        out = out.when(p < bound, name)
    return out.otherwise("UNKNOWN")


def ood_warnings(stats: Sequence[tuple[str, float, float, float]]) -> Column:
    """Sorted texts on values unlike training: stats are (feature, missing %, min, max) of the training rows."""
    checks = []
    for name, missing, low, high in stats:
        if missing < 1.0:
            checks.append(F.when(F.col(name).isNull(), f"{name}: missing"))
        checks.append(F.when(F.col(name) < low, f"{name}: below training minimum"))
        checks.append(F.when(F.col(name) > high, f"{name}: above training maximum"))
    return F.array_sort(F.array_compact(F.array(*checks)))


def blend(a: Column, b: Column, weight: float) -> Column:
    """Convex combination of two probabilities."""
    return weight * a + (1 - weight) * b
