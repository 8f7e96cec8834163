"""Aggregate expressions shared by the reports. Money is summed in whole cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: business assumptions
REDELIVERY_COST_RATE = 0.25
MARGIN_RATE = 0.20
CHURN_WINDOW_DAYS = 90
FLAT_COST_PER_FAILURE = 25
HIGH_RISK_RATE = 0.20
SAVINGS_SHARE = 0.30
TARGET_FAILURE_RATE = 0.15


def order_count() -> Column:
    return F.count("order_id")


def failure_count() -> Column:
    return F.count_if(F.col("has_missing"))


def failure_rate() -> Column:
    return F.avg(F.col("has_missing").cast("int"))


def revenue() -> Column:
    return F.sum("amount_cents") / 100.0


def average_ticket() -> Column:
    return F.sum("amount_cents") / 100.0 / F.count("amount_cents")


def half_even(value: Column | str, digits: int = 0) -> Column:
    """Rounds by scaling, to the nearest even digit on a tie, as array libraries do."""
    column = F.col(value) if isinstance(value, str) else value
    return F.rint(column * 10.0 ** digits) / 10.0 ** digits


def share(value: Column, total: Column) -> Column:
    return F.try_divide(value, total) * 100


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top, bottom)
