"""Parameters of the credit-risk operators. Nothing is hard-coded in the operators."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class Params:
    """Dates cut time into train, selection and final windows; the rest are thresholds and sizes."""

    split_date: date = date(1999, 7, 1)
    selection_date: date = date(2000, 4, 1)
    maturity_cutoff: date = date(2001, 1, 1)
    max_categories: int = 20
    min_lift: float = 0.01
    min_valid: int = 50
    min_positive: int = 10
    calibration_fraction: float = 0.15
    discovery_fraction: float = 0.50
    top_num: int = 12
    top_cat: int = 10
    rolling_windows: int = 4
    search_windows: int = 5
    cv_folds: int = 5
    n_trials: int = 50
    min_train_blocks: int = 2
    correlation_limit: float = 0.95
    stability_threshold: float = 0.5
    stability_min_features: int = 5
    missing_rate: float = 0.01
    score_bins: int = 10
    n_bootstrap: int = 1000
    seed: int = 42
    reject_bins: int = 10
    reject_multiplier: float = 1.5
    reject_max_rate: float = 0.5
    reject_max_ratio: float = 1.0
    reject_weight: float = 0.5
    threshold_pcts: tuple[float, ...] = (5.0, 10.0, 15.0, 20.0, 25.0, 30.0)
    age_edges: tuple[int, ...] = (18, 25, 35, 45, 55, 65, 100)
    decision_statuses: tuple[str, ...] = ("Booked", "Rejected", "Canceled")
    #: Upper bounds of the risk tiers; a probability belongs to the first it is below.
    tiers: tuple[tuple[str, float], ...] = (("LOW", 0.03), ("MODERATE", 0.06), ("ELEVATED", 0.10), ("HIGH", 0.20), ("VERY_HIGH", 1.01))
    #: The sign a model's score must have in a feature.
    monotone: dict[str, int] = field(
        default_factory=lambda: {
            "income_t1": -1, "log_income_t1": -1, "household_income": -1, "max_credit_tj_av": -1, "log_max_credit": -1, "has_codebtor": -1,
            "codebtor_income_share": -1, "book_ratio_loan": -1, "book_ratio_card": -1, "age_t1": -1, "installment_to_income": 1, "total_amt_to_income": 1,
            "installment_to_household": 1, "total_amt_to_household": 1, "amt_per_month": 1,
        }
    )


DEFAULT = Params()
ID, DATE, STATUS, TARGET = "authorization_id", "mis_date", "status_name", "target"
NUMERIC = ["total_amt", "installment_amt", "tenor", "income_t1", "max_credit_tj_av", "age_t1", "total_loan_nbr", "total_card_nbr", "book_loan_nbr", "book_card_nbr"]
CATEGORICAL = ["house_type", "customer_type", "product_type_3", "csp"]
MISS_CANDIDATES = ["max_credit_tj_av", "income_t2"]
BENCHMARKS = {"risk_score_rf (benchmark)": "risk_score_rf", "score_RF (benchmark)": "score_rf"}
