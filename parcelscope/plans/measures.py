"""Report measures over the fact table and the dimensions, with optional grouping and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import bands
from ..functions.calendar import day_order


def failure_rate_measure() -> Column:
    return F.coalesce(F.try_divide(F.count_if(F.col("has_missing")), F.count(F.lit(1))), F.lit(0.0))


def fact_measures(target: float = agg.TARGET_FAILURE_RATE, savings: float = agg.SAVINGS_SHARE) -> dict[str, Column]:
    """Money is summed in whole cents, and costs as failures times the cost of one, so no total depends on the order of rows."""
    cents = F.sum(F.round(F.col("order_amount") * 100).cast("bigint"))
    cost = F.count_if(F.col("has_missing")) * F.coalesce(F.max(F.when(F.col("has_missing"), F.col("failure_cost"))), F.lit(0.0))
    return {
        "total_orders": F.count(F.lit(1)), "total_revenue": cents / 100.0,
        "avg_ticket": F.try_divide(cents / 100.0, F.count("order_amount")), "failure_rate": failure_rate_measure(),
        "total_failure_cost": cost, "failure_rate_vs_global": failure_rate_measure() - target,
        "projected_savings": cost * savings}


def measure(df: DataFrame, measures: dict[str, Column], by: Sequence[str] = (),
            where: Column | None = None) -> DataFrame:
    """Aggregates any table by any columns after any filter, as a report page with slicers does."""
    filtered = df if where is None else df.where(where)
    return filtered.groupBy(*by).agg(*[m.alias(name) for name, m in measures.items()])


def driver_measures() -> dict[str, Column]:
    in_cell = lambda cell: F.countDistinct(F.when(
        F.col("intervention_quadrant") == bands.QUADRANTS_EXPORT[cell], F.col("driver_id")))
    return {"high_risk_drivers": in_cell("chronic"), "coaching_drivers": in_cell("unstable")}


def customer_measures() -> dict[str, Column]:
    lost = F.sum(F.when(F.col("churned"), F.col("total_revenue")))
    return {"customers_with_failure": F.count_if("had_failure"), "churned_customers": F.count_if("churned"),
            "revenue_at_risk": F.coalesce(lost, F.lit(0.0))}


def day_average_of_regions(region_day: DataFrame) -> DataFrame:
    """Mean of the regions' own rates per day, not weighted by orders."""
    return region_day.groupBy("day_of_week").agg(F.avg("failure_rate").alias("failure_rate")).withColumn(
        "day_ord", day_order(F.col("day_of_week")))


def failures_by_period(fact: DataFrame) -> DataFrame:
    return fact.where(F.col("period").isNotNull()).groupBy("period").agg(F.sum("has_missing_int").alias("failures"))


def critical_drivers(dim_drivers: DataFrame, k: int = 15) -> DataFrame:
    cells = [bands.QUADRANTS_EXPORT["chronic"], bands.QUADRANTS_EXPORT["unstable"]]
    return dim_drivers.where(F.col("intervention_quadrant").isin(cells)).orderBy(
        F.desc("hist_failure_rate"), "driver_id").limit(k).select(
        "driver_id", "driver_name", "exp_tier", "hist_failure_rate", "estimated_failure_cost",
        "intervention_quadrant")


def improved_drivers(dim_drivers: DataFrame) -> DataFrame:
    improved = F.coalesce(F.col("improved_h1_h2"), F.lit(False))
    return dim_drivers.agg(F.count_if(improved).alias("improved"), F.count(F.lit(1)).alias("drivers"),
                           (F.avg(improved.cast("int")) * 100).alias("pct_improved"))


def segment_matrix(dim_customers: DataFrame) -> DataFrame:
    """Customers per value segment and failure group."""
    wide = dim_customers.groupBy("value_segment").pivot("failure_group", bands.FAILURE_GROUPS_EXPORT).agg(
        F.count("customer_id"))
    names = ["failures_0", "failures_1", "failures_2", "failures_3_plus"]
    return wide.select("value_segment", *[F.coalesce(F.col(f"`{g}`"), F.lit(0)).alias(n)
                                          for g, n in zip(bands.FAILURE_GROUPS_EXPORT, names)])


def churn_by_group(dim_customers: DataFrame) -> DataFrame:
    return dim_customers.groupBy("failure_group").agg(F.avg(F.col("churned").cast("int")).alias("churn_rate"))


def purchase_frequency(dim_customers: DataFrame) -> DataFrame:
    return dim_customers.groupBy("had_failure").agg(F.avg("orders_per_month").alias("orders_per_month"))


def half_year_points(dim_drivers: DataFrame) -> DataFrame:
    return dim_drivers.where(F.col("rate_h1").isNotNull()).select(
        "driver_id", "rate_h1", "rate_h2", "improved_h1_h2")
