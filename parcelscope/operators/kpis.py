"""Order-grain KPIs by time, place and customer age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import bands, calendar
from .joins import join_per_key


def global_totals(orders: DataFrame, cost_rate: float = agg.REDELIVERY_COST_RATE) -> DataFrame:
    """One row of dataset-wide figures used inside row expressions."""
    return orders.agg(
        agg.order_count().alias("orders"), F.sum("amount_cents").alias("cents"),
        agg.failure_count().alias("failures"), agg.failure_rate().alias("failure_rate"),
        agg.average_ticket().alias("avg_ticket"), F.max("date").alias("last_day")).withColumn(
        "cost_per_failure", F.col("avg_ticket") * cost_rate)


def global_scalar(orders: DataFrame) -> Column:
    """The same row as a struct-valued scalar sub-query: evaluated once, no join."""
    return global_totals(orders).select(F.struct("*")).scalar()


def executive_kpis(orders: DataFrame) -> DataFrame:
    return orders.agg(
        agg.order_count().alias("total_orders"), agg.revenue().alias("total_revenue"),
        agg.average_ticket().alias("avg_ticket"), agg.failure_rate().alias("failure_rate"),
        agg.failure_count().alias("total_failures"),
        F.countDistinct("customer_id").alias("total_customers"),
        F.countDistinct("driver_id").alias("total_drivers"),
        F.countDistinct("region").alias("total_regions"))


def keyed(orders: DataFrame, *keys: str) -> DataFrame:
    """Rows whose group keys are all known."""
    for key in keys:
        orders = orders.where(F.col(key).isNotNull())
    return orders


def monthly_trend(orders: DataFrame) -> DataFrame:
    return keyed(orders, "month").groupBy("month").agg(
        agg.order_count().alias("total_orders"), agg.revenue().alias("total_revenue"),
        agg.failure_rate().alias("failure_rate"))


def monthly_kpis(orders: DataFrame) -> DataFrame:
    """Monthly figures with the change against the month before. Windows run over months only."""
    per_month = keyed(orders, "month").groupBy("month").agg(
        agg.order_count().alias("total_orders"), agg.revenue().alias("total_revenue"),
        agg.average_ticket().alias("avg_ticket"), agg.failure_count().alias("total_failures"),
        agg.failure_rate().alias("failure_rate"))
    before = Window.orderBy("month")
    return per_month.withColumn("g", global_scalar(orders)).select(
        *per_month.columns, (F.col("total_failures") * F.col("g.cost_per_failure")).alias("failure_cost"),
        ((F.try_divide("total_revenue", F.lag("total_revenue").over(before)) - 1) * 100)
        .alias("mom_revenue_change"),
        ((F.col("failure_rate") - F.lag("failure_rate").over(before)) * 100).alias("mom_failure_change"))


def revenue_by_region(orders: DataFrame) -> DataFrame:
    return keyed(orders, "region").groupBy("region").agg(agg.revenue().alias("total_revenue")).orderBy(
        F.desc("total_revenue"), "region")


def region_summary(orders: DataFrame) -> DataFrame:
    return keyed(orders, "region").groupBy("region").agg(
        agg.order_count().alias("total_orders"), agg.revenue().alias("total_revenue"),
        agg.average_ticket().alias("avg_ticket"), agg.failure_rate().alias("missing_rate"))


def region_quality(orders: DataFrame) -> DataFrame:
    return keyed(orders, "region").groupBy("region").agg(
        agg.order_count().alias("total_orders"), agg.failure_count().alias("missing_count"),
        agg.failure_rate().alias("missing_rate")).orderBy(F.desc("missing_rate"), "region")


def region_dimension_kpis(orders: DataFrame) -> DataFrame:
    per_region = keyed(orders, "region").groupBy("region").agg(
        agg.order_count().alias("total_orders"), agg.failure_count().alias("total_failures"),
        agg.failure_rate().alias("failure_rate"), agg.revenue().alias("total_revenue"),
        agg.average_ticket().alias("avg_ticket"), F.countDistinct("driver_id").alias("unique_drivers"),
        F.countDistinct("customer_id").alias("unique_customers"))
    rate, overall = F.col("failure_rate"), F.col("g.failure_rate")
    return per_region.withColumn("g", global_scalar(orders)).select(
        *per_region.columns,
        (F.col("total_failures") * F.col("g.cost_per_failure")).alias("failure_cost_estimated"),
        ((rate - overall) * 100).alias("vs_global_avg_pp"),
        bands.versus_global(rate, overall).alias("performance_label"))


def by_day(orders: DataFrame) -> DataFrame:
    """Failure rate per day name, Monday first, all seven days present."""
    per_day = keyed(orders, "day_of_week").groupBy("day_of_week").agg(
        agg.order_count().alias("total_orders"), agg.failure_count().alias("failures"),
        agg.failure_rate().alias("failure_rate"))
    return calendar.in_day_order(per_day).withColumn("g", global_scalar(orders)).select(
        "day_ord", "day_of_week", F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
        F.coalesce("failures", F.lit(0)).alias("failures"), "failure_rate",
        bands.status(F.col("failure_rate"), F.col("g.failure_rate")).alias("status"))


def hour_day(orders: DataFrame) -> DataFrame:
    return keyed(orders, "day_of_week", "delivery_hour").groupBy("day_of_week", "delivery_hour").agg(
        agg.order_count().alias("volume"), agg.failure_rate().alias("failure_rate"),
        agg.revenue().alias("revenue")).withColumn(
        "day_ord", calendar.day_order(F.col("day_of_week"))).orderBy("day_ord", "delivery_hour")


def region_day(orders: DataFrame) -> DataFrame:
    return keyed(orders, "region", "day_of_week").groupBy("region", "day_of_week").agg(
        agg.order_count().alias("total_orders"), agg.failure_rate().alias("failure_rate"),
        agg.failure_count().alias("total_failures")).withColumn(
        "day_ord", calendar.day_order(F.col("day_of_week"))).orderBy("region", "day_ord")


def region_hour(orders: DataFrame) -> DataFrame:
    return keyed(orders, "region", "delivery_hour").groupBy("region", "delivery_hour").agg(
        agg.order_count().alias("orders"), agg.failure_rate().alias("failure_rate"))


def region_day_hour(orders: DataFrame) -> DataFrame:
    return keyed(orders, "region", "day_of_week", "delivery_hour").groupBy(
        "region", "day_of_week", "delivery_hour").agg(
        agg.order_count().alias("orders"), agg.failure_rate().alias("failure_rate"))


def period_quality(orders: DataFrame, labels=bands.PERIOD_LABELS_REPORT) -> DataFrame:
    named = orders.withColumn("period", bands.period_of_day(F.col("delivery_hour"), labels))
    return keyed(named, "period").groupBy("period").agg(
        agg.order_count().alias("total_orders"), agg.failure_rate().alias("failure_rate")).withColumn(
        "period_ord", bands.label_order(F.col("period"), labels))


def _orders_by_customer(orders: DataFrame) -> DataFrame:
    return orders.groupBy("customer_id").agg(agg.order_count().alias("orders"), F.sum("amount_cents").alias("cents"))


def age_bands(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders and average ticket per customer age band. Orders are added up per customer before
    the customer table is joined."""
    labelled = _orders_by_customer(orders).join(customers, "customer_id").withColumn(
        "age_group", bands.age_band_left(F.col("customer_age")))
    return keyed(labelled, "age_group").groupBy("age_group").agg(
        F.sum("orders").alias("count"), (F.sum("cents") / 100.0 / F.sum("orders")).alias("avg_ticket")
    ).withColumn("age_ord", bands.label_order(F.col("age_group"), bands.AGE_LABELS))


def items_by_failure(orders: DataFrame) -> DataFrame:
    return orders.groupBy("has_missing").agg(F.avg("items_delivered").alias("avg_items"))


def extremes(summary: DataFrame, label: str, metric: str) -> DataFrame:
    """Worst and best label of a small summary; equal metrics go to the first label."""
    worst = F.min_by(F.struct(label, metric), F.struct(-F.col(metric), F.col(label)))
    best = F.min_by(F.struct(label, metric), F.struct(F.col(metric), F.col(label)))
    return summary.agg(worst.alias("w"), best.alias("b")).select(
        F.col(f"w.{label}").alias(f"worst_{label}"), F.col(f"w.{metric}").alias(f"worst_{label}_rate"),
        F.col(f"b.{label}").alias(f"best_{label}"), F.col(f"b.{metric}").alias(f"best_{label}_rate"))


def with_customer_mean(orders: DataFrame, name: str = "mean_ticket") -> DataFrame:
    """Adds the customer's mean ticket to each order."""
    means = keyed(orders, "customer_id").groupBy("customer_id").agg(agg.average_ticket().alias(name))
    return join_per_key(orders, means, "customer_id")


def amounts_by(orders: DataFrame, *keys: str) -> DataFrame:
    return keyed(orders, *keys).groupBy(*keys).agg(agg.order_count().alias("orders"),
                                                  agg.failure_rate().alias("failure_rate"))
