"""Driver performance, trajectories and consistency.

Everything starts from one table per driver and month, so orders of a busy driver are added up
before they are shuffled, and totals, semester rates and monthly variation share one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import bands
from ..session import written
from .distribution import medians
from .kpis import global_scalar, keyed
from .ranking import top_k, top_k_per


def driver_months(orders: DataFrame) -> DataFrame:
    return keyed(orders, "driver_id", "month").groupBy("driver_id", "month").agg(
        agg.order_count().alias("deliveries"), agg.failure_count().alias("failures"),
        F.sum("amount_cents").alias("cents"), F.sum("items_delivered").alias("items"))


def driver_totals(orders: DataFrame) -> DataFrame:
    """Deliveries, failures, rate, items, revenue and ticket per driver."""
    total = keyed(orders, "driver_id").groupBy("driver_id").agg(
        agg.order_count().alias("deliveries"), agg.failure_count().alias("failures"),
        agg.failure_rate().alias("failure_rate"), F.avg("items_delivered").alias("avg_items"),
        agg.revenue().alias("total_revenue"), agg.average_ticket().alias("avg_ticket"))
    return total


def named(per_driver: DataFrame, drivers: DataFrame) -> DataFrame:
    """Adds driver attributes; drivers without a name are left out, as in a group by name."""
    return per_driver.join(drivers.where(F.col("driver_name").isNotNull()), "driver_id")


def driver_performance(orders: DataFrame, drivers: DataFrame) -> DataFrame:
    return named(driver_totals(orders), drivers).select(
        "driver_id", "driver_name", "deliveries", "failures", "failure_rate", "avg_items",
        "total_revenue", "avg_ticket")


def driver_profile(orders: DataFrame, drivers: DataFrame) -> DataFrame:
    return named(driver_totals(orders), drivers).select(
        "driver_id", "driver_name", F.col("deliveries").alias("total_deliveries"),
        F.col("failures").alias("total_failures"), F.col("failure_rate").alias("hist_failure_rate"),
        "total_revenue", "avg_ticket", "trips", F.col("age").alias("driver_age"))


def driver_monthly(orders: DataFrame, drivers: DataFrame) -> DataFrame:
    return named(driver_months(orders), drivers).select(
        "driver_id", "driver_name", "month", "deliveries", "failures",
        (F.col("failures") / F.col("deliveries")).alias("failure_rate"),
        (F.col("cents") / 100.0).alias("revenue"))


def _semester_sums() -> list[Column]:
    first_half = F.substring("month", 6, 2).cast("int") <= 6
    return [F.coalesce(F.sum(F.when(half, F.col(source))), F.lit(0)).alias(f"{source}_{name}")
            for name, half in (("h1", first_half), ("h2", ~first_half))
            for source in ("deliveries", "failures")]


def _semester_rates(per_driver: DataFrame, min_deliveries: int) -> DataFrame:
    """Semester rates from conditional sums; NULL below the minimum volume."""
    both = (F.col("deliveries_h1") >= min_deliveries) & (F.col("deliveries_h2") >= min_deliveries)
    rate = {h: F.when(both, F.try_divide(F.col(f"failures_{h}"), F.col(f"deliveries_{h}"))) for h in ("h1", "h2")}
    return (per_driver.withColumn("rate_h1", rate["h1"]).withColumn("rate_h2", rate["h2"])
            .withColumn("delta_h1_h2", F.col("rate_h2") - F.col("rate_h1"))
            .withColumn("improved_h1_h2", F.col("rate_h2") < F.col("rate_h1")))


def semester_rates(orders: DataFrame, min_deliveries: int = 5) -> DataFrame:
    """Drivers with enough deliveries in both halves of the year."""
    sums = driver_months(orders).groupBy("driver_id").agg(*_semester_sums())
    return _semester_rates(sums, min_deliveries).where(F.col("rate_h1").isNotNull()).select(
        "driver_id", F.col("deliveries_h1").alias("del_h1"), "rate_h1",
        F.col("deliveries_h2").alias("del_h2"), "rate_h2", "delta_h1_h2", "improved_h1_h2")


def trajectory_summary(rates: DataFrame) -> DataFrame:
    improved, delta = F.col("improved_h1_h2"), F.col("delta_h1_h2")
    return rates.agg(
        F.count(F.lit(1)).alias("drivers"), F.count_if(improved).alias("improved"),
        F.count_if(~improved).alias("worsened"), (F.avg(improved.cast("int")) * 100).alias("pct_improved"),
        (-F.avg(F.when(improved, delta)) * 100).alias("avg_improvement_pp"),
        (F.avg(F.when(~improved, delta)) * 100).alias("avg_worsening_pp"))


def high_risk_first_half(rates: DataFrame, threshold: float = agg.HIGH_RISK_RATE) -> DataFrame:
    return rates.where(F.col("rate_h1") >= threshold)


def recovery_summary(rates: DataFrame, threshold: float = agg.HIGH_RISK_RATE) -> DataFrame:
    """What became in H2 of the drivers at or above the threshold in H1."""
    recovered, improved = F.col("rate_h2") < threshold, F.col("improved_h1_h2")
    counts = high_risk_first_half(rates, threshold).agg(
        F.count(F.lit(1)).alias("high_risk"), F.count_if(recovered).alias("recovered"),
        F.count_if(improved).alias("improved"),
        (-F.avg(F.when(improved, F.col("delta_h1_h2"))) * 100).alias("avg_reduction_pp"))
    pct = lambda c: F.coalesce(agg.share(F.col(c), F.col("high_risk")), F.lit(0.0))
    return counts.select(
        "high_risk", "recovered", "improved", (F.col("improved") - F.col("recovered")).alias("partial"),
        (F.col("high_risk") - F.col("improved")).alias("not_improved"),
        pct("recovered").alias("pct_recovered"), pct("improved").alias("pct_improved"), "avg_reduction_pp")


def _variation(average: Column, deviation: Column) -> Column:
    return F.coalesce(F.try_divide(deviation, average), F.lit(0.0))


def consistency(orders: DataFrame, min_deliveries: int = 1, min_months: int = 1) -> DataFrame:
    """Mean, deviation and variation of monthly rates per driver.

    Rates are rounded to nine decimals, so equal histories compare equal whatever order Spark
    added them in.
    """
    months = driver_months(orders).where(F.col("deliveries") >= min_deliveries)
    rate = F.col("failures") / F.col("deliveries")
    return months.groupBy("driver_id").agg(
        F.count("month").alias("months_active"), F.round(F.avg(rate), 9).alias("avg_rate"),
        F.round(F.stddev_samp(rate), 9).alias("std_rate"),
        F.round(_variation(F.avg(rate), F.stddev_samp(rate)), 9).alias("cv")
    ).where(F.col("months_active") >= min_months)


def export_consistency(orders: DataFrame) -> DataFrame:
    return consistency(orders).select(
        "driver_id", "months_active", "avg_rate", "std_rate", agg.half_even("cv", 3).alias("consistency_cv"))


def cohort_consistency(orders: DataFrame) -> DataFrame:
    return consistency(orders, min_deliveries=3, min_months=3)


def cohort_quadrants(table: DataFrame, median_is_unstable: bool = True) -> DataFrame:
    """Rate against variation, split at the medians of the table. The two reports differ in which
    side a driver exactly on the median variation falls."""
    split = table.withColumn("med", medians(table, ["avg_rate", "cv"]))
    unstable = F.col("cv") >= F.col("med.cv") if median_is_unstable else F.col("cv") > F.col("med.cv")
    return split.withColumn("quadrant", bands.quadrant(
        F.col("avg_rate") > F.col("med.avg_rate"), unstable, bands.QUADRANTS_COHORT)).drop("med")


def quadrant_counts(table: DataFrame, name: str = "quadrant") -> DataFrame:
    return table.groupBy(name).agg(F.count(F.lit(1)).alias("drivers"))


def top_chronic(quadrants: DataFrame, drivers: DataFrame, k: int = 10) -> DataFrame:
    chronic = quadrants.where(F.col("quadrant") == bands.QUADRANTS_COHORT["chronic"])
    return named(top_k(chronic, "avg_rate", "driver_id", k), drivers).select(
        "driver_id", "driver_name", "avg_rate", "cv", "months_active")


def tiered(orders: DataFrame, drivers: DataFrame, labels=bands.TIER_LABELS_COHORT) -> DataFrame:
    """Sums per driver with the driver's experience tier."""
    per_driver = keyed(orders, "driver_id").groupBy("driver_id").agg(
        agg.order_count().alias("orders"), agg.failure_count().alias("failures"),
        F.sum("amount_cents").alias("cents"))
    return keyed(per_driver.join(drivers, "driver_id").withColumn(
        "tier", bands.experience_tier(F.col("trips"), labels)), "tier")


def tier_stats(orders: DataFrame, drivers: DataFrame) -> DataFrame:
    """Order-weighted figures per experience tier, with the cost of failures."""
    per_tier = tiered(orders, drivers).groupBy("tier").agg(
        F.count("driver_id").alias("drivers"), F.sum("orders").alias("orders"),
        F.sum("failures").alias("failures"), (F.sum("failures") / F.sum("orders")).alias("failure_rate"),
        (F.sum("cents") / 100.0 / F.sum("orders")).alias("avg_ticket"),
        (F.sum("cents") / 100.0).alias("revenue"))
    cost = F.col("failures") * F.col("g.cost_per_failure")
    return per_tier.withColumn("g", global_scalar(orders)).select(
        *per_tier.columns, cost.alias("estimated_cost"), (cost / F.col("orders")).alias("cost_per_order"),
        (cost / F.col("revenue") * 100).alias("pct_revenue"),
        bands.label_order(F.col("tier"), bands.TIER_LABELS_COHORT).alias("tier_ord"))


def tier_stats_by_driver(orders: DataFrame, drivers: DataFrame) -> DataFrame:
    """Every driver counts once: mean of the drivers' own rates."""
    rate = F.col("failures") / F.col("orders")
    per_tier = tiered(orders, drivers, bands.TIER_LABELS_REPORT).where(
        F.col("driver_name").isNotNull()).groupBy("tier").agg(
        F.count("driver_id").alias("drivers"), F.avg(rate).alias("failure_rate"),
        F.sum("failures").alias("failures"))
    return per_tier.withColumn("g", global_scalar(orders)).select(
        "tier", "drivers", "failure_rate", (F.col("failures") * F.col("g.cost_per_failure")).alias("cost"))


def ranked_drivers(orders: DataFrame, drivers: DataFrame, k: int, min_deliveries: int = 1,
                   worst: bool = True, skip_always_failing: bool = False) -> DataFrame:
    """Best or worst drivers by failure rate. The list is cut before names are joined."""
    table = driver_totals(orders).where(F.col("deliveries") >= min_deliveries)
    if skip_always_failing:
        table = table.where(F.col("failure_rate") < 1.0)
    table = table.join(drivers.where(F.col("driver_name").isNotNull()), "driver_id", "left_semi")
    return named(top_k(table, "failure_rate", "driver_id", k, largest=worst), drivers).select(
        "driver_id", "driver_name", "deliveries", "failure_rate", "trips")


def worst_per_region(orders: DataFrame, drivers: DataFrame, k: int = 10, min_deliveries: int = 3) -> DataFrame:
    """Highest failure rates in each region, by driver name."""
    per_driver = keyed(orders, "region", "driver_id").groupBy("region", "driver_id").agg(
        agg.order_count().alias("deliveries"), agg.failure_count().alias("failures"))
    per_name = named(per_driver, drivers).groupBy("region", "driver_name").agg(
        F.sum("deliveries").alias("deliveries"), F.sum("failures").alias("failures"))
    rated = per_name.where(F.col("deliveries") >= min_deliveries).withColumn(
        "missing_rate", F.col("failures") / F.col("deliveries"))
    return top_k_per(rated, "region", "missing_rate", "driver_name", k).select(
        "region", "place", "driver_name", "deliveries", "missing_rate")


def driver_list(orders: DataFrame, drivers: DataFrame) -> DataFrame:
    return named(driver_totals(orders), drivers).select(
        "driver_id", "driver_name", F.col("failure_rate").alias("driver_hist_rate")).dropDuplicates(
        ["driver_id"]).orderBy("driver_name", "driver_id")


def export_quadrants(profile: DataFrame, min_deliveries: int = 5) -> DataFrame:
    """Quadrant of each driver; medians are taken over drivers with enough deliveries."""
    enough = F.col("total_deliveries") >= min_deliveries
    split = profile.withColumn("med", medians(profile.where(enough), ["hist_failure_rate", "consistency_cv"]))
    cell = bands.quadrant(F.col("hist_failure_rate") > F.col("med.hist_failure_rate"),
                          F.col("consistency_cv") > F.col("med.consistency_cv"), bands.QUADRANTS_EXPORT)
    return split.withColumn("intervention_quadrant", F.when(
        ~enough, bands.QUADRANTS_EXPORT["low_volume"]).otherwise(cell)).drop("med")


def driver_dimension(orders: DataFrame, drivers: DataFrame) -> DataFrame:
    """Profile, tier, semester change, consistency, quadrant and cost, one row per driver.

    The orders are read once: their sums per driver and month are written, and totals, variation,
    medians and the average ticket come from these. Rows without driver or month count for the ticket only.
    """
    rate = F.col("failures") / F.col("deliveries")
    sums = written(orders.groupBy("driver_id", "month").agg(
        agg.order_count().alias("deliveries"), agg.failure_count().alias("failures"),
        F.sum("amount_cents").alias("cents"), F.count("amount_cents").alias("priced")), "driver_months")
    ticket = sums.agg((F.sum("cents") / 100.0 / F.sum("priced")).alias("avg_ticket")).scalar()
    per_driver = keyed(sums, "driver_id", "month").groupBy("driver_id").agg(
        F.sum("deliveries").alias("total_deliveries"), F.sum("failures").alias("total_failures"),
        F.sum("cents").alias("cents"), F.count("month").alias("months_active"),
        agg.half_even(F.round(_variation(F.avg(rate), F.stddev_samp(rate)), 9), 3).alias("consistency_cv"),
        *_semester_sums())
    profile = named(_semester_rates(per_driver, 5), drivers).withColumn(
        "hist_failure_rate", F.col("total_failures") / F.col("total_deliveries"))
    placed = export_quadrants(profile).withColumn("cost", ticket * agg.REDELIVERY_COST_RATE)
    return placed.select(
        "driver_id", "driver_name", "total_deliveries", "total_failures",
        agg.half_even("hist_failure_rate", 4).alias("hist_failure_rate"),
        agg.half_even(F.col("cents") / 100.0, 4).alias("total_revenue"),
        agg.half_even(F.col("cents") / 100.0 / F.col("total_deliveries"), 4).alias("avg_ticket"),
        "trips", F.col("age").alias("driver_age"), bands.experience_tier(F.col("trips")).alias("exp_tier"),
        *[agg.half_even(c, 4).alias(c) for c in ("rate_h1", "rate_h2", "delta_h1_h2")], "improved_h1_h2",
        "consistency_cv", "months_active", "intervention_quadrant",
        agg.half_even(F.col("total_failures") * F.col("cost"), 4).alias("estimated_failure_cost"),
        (F.col("hist_failure_rate") > agg.HIGH_RISK_RATE).alias("risk_flag"))
