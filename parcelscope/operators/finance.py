"""Cost of failures, customer value and savings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from .kpis import global_scalar, global_totals


def cost_model(orders: DataFrame, cost_rate: float = agg.REDELIVERY_COST_RATE,
               flat_cost: float = agg.FLAT_COST_PER_FAILURE) -> DataFrame:
    """Cost per failure from the average ticket, next to the flat estimate."""
    return global_totals(orders, cost_rate).select(
        "avg_ticket", "failures", "cost_per_failure",
        (F.col("failures") * F.col("cost_per_failure")).alias("total_failure_cost"),
        F.lit(flat_cost).alias("flat_cost_per_failure"),
        (F.col("failures") * flat_cost).alias("flat_total_cost"))


def order_costs(orders: DataFrame) -> DataFrame:
    """Failure cost on every order."""
    cost = F.col("has_missing").cast("int") * F.col("g.cost_per_failure")
    return orders.withColumn("g", global_scalar(orders)).withColumn("failure_cost", cost).drop("g")


def impact_by_quadrant(driver_dimension: DataFrame, savings_share: float = agg.SAVINGS_SHARE) -> DataFrame:
    """Sums over the finished driver dimension, whose measures carry four decimals."""
    per_cell = driver_dimension.groupBy("intervention_quadrant").agg(
        F.count("driver_id").alias("drivers"), F.sum("total_deliveries").alias("total_deliveries"),
        F.sum("total_failures").alias("total_failures"),
        F.sum("estimated_failure_cost").alias("total_failure_cost"),
        F.avg("hist_failure_rate").alias("avg_failure_rate"))
    cost = F.col("total_failure_cost")
    return per_cell.select(
        "*", agg.share(cost, F.sum(cost).over(Window.partitionBy())).alias("pct_total_cost"),
        (cost * savings_share).alias("savings_if_30pct_reduction"))


def lifetime_value(orders: DataFrame, profile: DataFrame, margin: float = agg.MARGIN_RATE,
                   projected_months: int = 72) -> DataFrame:
    """Monthly value of an average customer and its loss over the churned ones."""
    customers = profile.agg(F.avg("total_orders").alias("orders"), F.count_if("churned").alias("churned"))
    table = customers.withColumn("g", global_scalar(orders)).select(
        F.col("g.avg_ticket").alias("avg_ticket"), (F.col("orders") / 12).alias("orders_per_month"), "churned")
    return table.withColumn(
        "monthly_ltv", F.col("avg_ticket") * F.col("orders_per_month") * margin).withColumn(
        "projected_loss", F.col("churned") * F.col("monthly_ltv") * projected_months)


# fixed values: the action plan
SAVINGS_RULES = [
    (1, "Retraining of drivers with failure rate > 20%", "Chronic and Unstable Drivers", 0.30, "driver"),
    (2, "Digital checklist for orders > 12 items or > $400", "High value/volume orders", 0.13, "order"),
    (3, "Operational reinforcement on Mondays", "Weekly operations", 0.05, "time"),
    (4, "Operational audit in the worst region", "Worst region", 0.04, "region"),
    (5, "Immediate compensation after customer's 1st failure", "Churned customers", None, "retention"),
]


def savings_plan(orders: DataFrame, profile: DataFrame) -> DataFrame:
    """Actions with the part of the failure cost they save; the last one saves the revenue at risk."""
    lost = F.coalesce(F.sum(F.when(F.col("churned"), F.col("cents"))), F.lit(0)) / 100.0
    figures = profile.agg(lost.alias("risk")).withColumn("g", global_scalar(orders))
    rules = F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(a).alias("action"), F.lit(t).alias("target"),
                               F.lit(s).cast("double").alias("share"), F.lit(c).alias("category"))
                      for p, a, t, s, c in SAVINGS_RULES])
    cost = agg.half_even(F.col("g.failures") * F.col("g.cost_per_failure"), 2)
    return figures.select(F.explode(rules).alias("r"), "risk", cost.alias("cost")).select(
        "r.priority", "r.action", "r.target", "r.category",
        agg.half_even(F.coalesce(F.col("cost") * F.col("r.share"), F.col("risk")), 2).alias("savings"))


def full_cost(orders: DataFrame, profile: DataFrame) -> DataFrame:
    """Redelivery cost and lost revenue together."""
    lost = F.coalesce(F.sum(F.when(F.col("churned"), F.col("cents"))), F.lit(0)) / 100.0
    return profile.agg(lost.alias("lost_revenue")).withColumn("g", global_scalar(orders)).select(
        (F.col("g.failures") * F.col("g.cost_per_failure")).alias("redelivery_cost"), "lost_revenue").withColumn(
        "total_cost", F.col("redelivery_cost") + F.col("lost_revenue"))
