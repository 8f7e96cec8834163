"""Customer profiles, return after failure, churn and spend.

Orders are first added up per customer and month (or day), so one busy customer never sends all
orders to one task, and all customer figures share that one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import bands
from ..functions.cleaning import capped, capped_label
from .distribution import quantiles
from .kpis import keyed


def customer_months(orders: DataFrame) -> DataFrame:
    failed_date = F.when(F.col("has_missing"), F.col("date"))
    return keyed(orders, "customer_id", "month").groupBy("customer_id", "month").agg(
        agg.order_count().alias("orders"), agg.failure_count().alias("failures"),
        F.sum("amount_cents").alias("cents"), F.min("date").alias("first_order"),
        F.max("date").alias("last_order"), F.min(failed_date).alias("first_failure"),
        F.max(failed_date).alias("last_failure"))


def last_day(orders: DataFrame) -> Column:
    return orders.agg(F.max("date")).scalar()


def customer_profile(orders: DataFrame, as_of: str | None = None,
                     window_days: int = agg.CHURN_WINDOW_DAYS) -> DataFrame:
    """One row per customer with order, failure, return and churn figures.

    Churned: the last failure is at least `window_days` before the end of the data and no order
    has a later date. Returned: some order has a later date than the first failure.
    """
    per_customer = customer_months(orders).groupBy("customer_id").agg(
        F.sum("orders").alias("total_orders"), F.sum("failures").alias("total_failures"),
        F.sum("cents").alias("cents"), F.count("month").alias("months_active"),
        F.min("first_order").alias("first_order"), F.max("last_order").alias("last_order"),
        F.min("first_failure").alias("first_failure"), F.max("last_failure").alias("last_failure"))
    end = F.lit(as_of).cast("date") if as_of else last_day(orders)
    failures, total = F.col("total_failures"), F.col("total_orders")
    quiet = F.datediff("data_end", "last_failure") >= window_days
    silent = F.datediff("last_order", "last_failure") <= 0
    return per_customer.withColumn("data_end", end).select(
        "customer_id", "total_orders", "total_failures", "cents",
        (F.col("cents") / 100.0).alias("total_revenue"),
        (F.col("cents") / 100.0 / total).alias("avg_ticket"), "months_active", "first_order", "last_order",
        "first_failure", "last_failure", (failures / total).alias("failure_rate"),
        (total / F.col("months_active")).alias("orders_per_month"), (failures > 0).alias("had_failure"),
        F.coalesce(quiet & silent, F.lit(False)).alias("churned"),
        F.coalesce(F.col("last_order") > F.col("first_failure"), F.lit(False)).alias("returned_after_failure"))


def value_segments(profile: DataFrame) -> DataFrame:
    cuts = quantiles(profile, "cents", [0.25, 0.5, 0.75]).select(F.struct("*"))
    return profile.withColumn("cut", cuts.scalar()).withColumn("value_segment", bands.value_segment(
        F.col("cents"), F.col("cut.q25"), F.col("cut.q50"), F.col("cut.q75"))).drop("cut")


def customer_dimension(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Profile with bands and flags, one row per known customer with a name and an age."""
    known = customers.where(F.col("customer_name").isNotNull() & F.col("customer_age").isNotNull())
    table = value_segments(customer_profile(orders).join(known, "customer_id"))
    return table.select(
        "customer_id", "customer_name", "customer_age", "total_orders", "total_failures",
        *[agg.half_even(c, 4).alias(c) for c in ("total_revenue", "avg_ticket")], "months_active",
        "first_order", "last_order",
        *[agg.half_even(c, 4).alias(c) for c in ("failure_rate", "orders_per_month")], "had_failure",
        bands.age_band_right(F.col("customer_age"), bands.AGE_LABELS_DASH).alias("age_group"),
        bands.failure_group(F.col("total_failures")).alias("failure_group"), "value_segment",
        "churned", "returned_after_failure")


def failure_group_profile(profile: DataFrame) -> DataFrame:
    """Customers and revenue per number of failures. `avg_ticket` is the mean customer revenue."""
    grouped = profile.withColumn("failure_group", bands.failure_group(
        F.col("total_failures"), bands.FAILURE_GROUPS_COHORT)).groupBy("failure_group").agg(
        F.count("customer_id").alias("customers"), (F.sum("cents") / 100.0).alias("revenue"),
        (F.sum("cents") / 100.0 / F.count("customer_id")).alias("avg_ticket"))
    everything = Window.partitionBy()
    return grouped.select(
        "*", agg.share(F.col("customers"), F.sum("customers").over(everything)).alias("pct_customers"),
        agg.share(F.col("revenue"), F.sum("revenue").over(everything)).alias("pct_revenue"))


def affected_base(profile: DataFrame) -> DataFrame:
    had = F.col("had_failure")
    return profile.agg(
        F.count(F.lit(1)).alias("total_customers"), F.count_if(had).alias("customers_with_failure"),
        (F.avg(had.cast("int")) * 100).alias("pct_affected"),
        (F.coalesce(F.sum(F.when(had, F.col("cents"))), F.lit(0)) / 100.0).alias("revenue_affected"))


def order_frequency(profile: DataFrame) -> DataFrame:
    """Orders per active month for customers with and without a failure."""
    basic = profile.groupBy("had_failure").agg(
        F.avg("orders_per_month").alias("mean"), F.stddev_samp("orders_per_month").alias("std"),
        F.count("orders_per_month").alias("count"))
    middle = quantiles(profile, "orders_per_month", [0.5], ["had_failure"])
    return basic.join(middle, "had_failure").select(
        "had_failure", "mean", F.col("q50").alias("median"), "std", "count")


def churn_by_failures(profile: DataFrame, cap: int = 5) -> DataFrame:
    counted = profile.where("total_failures > 0").groupBy("total_failures").agg(
        F.count(F.lit(1)).alias("customers"), F.count_if("churned").alias("churned_count"))
    failures = F.col("total_failures")
    return counted.groupBy(capped(failures, cap).alias("failure_count_capped"),
                           capped_label(failures, cap).alias("failure_label")).agg(
        F.sum("customers").alias("customers"), F.sum("churned_count").alias("churned_count")).withColumn(
        "churn_rate", F.col("churned_count") / F.col("customers"))


def return_rates(profile: DataFrame) -> DataFrame:
    """Return after the first failure against the repeat rate of customers without a failure."""
    had = F.col("had_failure")
    rates = profile.agg(
        F.count_if(had).alias("customers_with_failure"),
        F.count_if("returned_after_failure").alias("returned"),
        (F.avg(F.when(~had, (F.col("total_orders") > 1).cast("int"))) * 100).alias("baseline_repeat_rate"))
    return rates.withColumn("return_rate", agg.share(F.col("returned"), F.col("customers_with_failure"))).select(
        "customers_with_failure", "returned",
        (F.col("customers_with_failure") - F.col("returned")).alias("not_returned"), "return_rate",
        "baseline_repeat_rate", (F.col("return_rate") - F.col("baseline_repeat_rate")).alias("delta_pp"))


def revenue_at_risk(profile: DataFrame) -> DataFrame:
    lost = F.when(F.col("churned"), F.col("cents"))
    return profile.agg(
        F.count_if("churned").alias("churned_customers"),
        (F.coalesce(F.sum(lost), F.lit(0)) / 100.0).alias("revenue_at_risk"),
        (F.avg(lost) / 100.0).alias("avg_revenue_per_churn"))


def retention_summary(dimension: DataFrame) -> DataFrame:
    """Eight figures over the finished customer dimension, one per row. The return rate here is
    over all customers; `return_rates` has it over customers with a failure."""
    churned = F.col("churned")
    pct = lambda flag: agg.half_even(F.avg(F.col(flag).cast("int")) * 100, 1)
    one = dimension.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("had_failure").alias("had"), pct("had_failure").alias("had_pct"),
        F.count_if("returned_after_failure").alias("back"), pct("returned_after_failure").alias("back_pct"),
        F.count_if("churned").alias("lost"),
        agg.half_even(F.coalesce(F.sum(F.when(churned, F.col("total_revenue"))), F.lit(0.0)), 2).alias("risk"),
        agg.half_even(F.avg(F.when(churned, F.col("total_revenue"))), 2).alias("risk_avg"))
    # fixed values: metric names of the retention report
    metrics = {"Total Customers": "n", "Customers with Failure": "had", "% Base Impacted": "had_pct",
               "Returned After Failure": "back", "Return Rate (%)": "back_pct", "Churned Customers": "lost",
               "Revenue at Risk ($)": "risk", "Average Cost per Churn ($)": "risk_avg"}
    rows = F.array(*[F.struct(F.lit(i).alias("metric_ord"), F.lit(name).alias("metric"),
                              F.col(c).cast("double").alias("value"))
                     for i, (name, c) in enumerate(metrics.items(), 1)])
    return one.select(F.inline(rows))


def lost_customers(dimension: DataFrame) -> DataFrame:
    return dimension.where("churned").select(
        "customer_id", "customer_name", "failure_group", "total_revenue", "value_segment").orderBy(
        F.desc("total_revenue"), "customer_id")


def customer_days(orders: DataFrame) -> DataFrame:
    """Orders per customer and day, with the customer's first failure date on every row."""
    days = keyed(orders, "customer_id", "date").groupBy("customer_id", "date").agg(
        agg.order_count().alias("orders"), agg.failure_count().alias("failures"),
        F.sum("amount_cents").alias("cents"))
    per_customer = Window.partitionBy("customer_id")
    first = F.min(F.when(F.col("failures") > 0, F.col("date"))).over(per_customer)
    return days.withColumn("first_failure", first)


def spend_by_phase(orders: DataFrame) -> DataFrame:
    """Mean ticket up to and after the first failure, for customers who have both."""
    before = F.col("date") <= F.col("first_failure")
    mean = lambda phase: F.try_divide(F.sum(F.when(phase, F.col("cents"))) / 100.0,
                                      F.sum(F.when(phase, F.col("orders"))))
    return customer_days(orders).where(F.col("first_failure").isNotNull()).groupBy("customer_id").agg(
        mean(before).alias("pre_failure"), mean(~before).alias("post_failure")).where(
        "pre_failure IS NOT NULL AND post_failure IS NOT NULL").withColumn(
        "delta", F.col("post_failure") - F.col("pre_failure"))


def spend_change(phases: DataFrame) -> DataFrame:
    both = phases.agg(F.count(F.lit(1)).alias("customers"), F.avg("pre_failure").alias("avg_pre"),
                      F.avg("post_failure").alias("avg_post"))
    return both.withColumn("delta", F.col("avg_post") - F.col("avg_pre")).withColumn(
        "pct_change", F.try_divide("delta", "avg_pre") * 100)


def ordered_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name)
