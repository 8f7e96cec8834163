"""Star schema: fact tables, dimensions and the pre-aggregated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import bands, calendar
from ..functions.cleaning import date_key, date_of, failed, hour_of, money_decimal
from ..operators import customers as cust
from ..operators import drivers as drv
from ..operators import finance, joins, kpis, products, quality
from ..operators.kpis import global_scalar
from ..session import written


def fact_orders(orders: DataFrame) -> DataFrame:
    """Order facts with calendar parts, bands and failure cost; no shuffle of the orders."""
    d = F.col("date")
    return orders.withColumn("g", global_scalar(orders)).select(
        "order_id", date_key(d).alias("date_key"), "date", "driver_id", "customer_id", "region",
        "order_amount", "items_delivered", "items_missing", "delivery_hour", "has_missing",
        F.col("has_missing").cast("int").alias("has_missing_int"),
        (F.col("has_missing").cast("int") * F.col("g.cost_per_failure")).alias("failure_cost"),
        "day_of_week", "month", F.weekofyear(d).alias("week_number"), F.quarter(d).alias("quarter"),
        calendar.semester(d).alias("semester"), bands.period_of_day(F.col("delivery_hour")).alias("period"),
        bands.order_size_tier(F.col("items_delivered")).alias("order_size_tier"),
        bands.amount_tier(F.col("order_amount")).alias("amount_tier"))


def fact_orders_typed(raw_orders: DataFrame, regions: DataFrame) -> DataFrame:
    """Order facts straight from raw text with decimal amounts and region numbers."""
    located = joins.attach_region_id(raw_orders, regions)
    return located.select(
        "order_id", date_key(date_of(F.col("date"))).alias("date_key"), "region_id", "driver_id", "customer_id",
        money_decimal(F.col("order_amount"), 10).alias("order_amount"), "items_delivered", "items_missing",
        hour_of(F.col("delivery_hour")).alias("delivery_hour"),
        failed(F.col("items_missing")).cast("int").alias("has_missing"))


def dim_driver(raw_drivers: DataFrame) -> DataFrame:
    return raw_drivers.select("driver_id", "driver_name", "age", bands.age_band_sql(F.col("age")).alias("age_group"),
                              F.col("Trips").alias("total_trips"))


def dim_customer(customers: DataFrame) -> DataFrame:
    age = F.col("customer_age")
    return customers.select("customer_id", "customer_name", age.alias("age"), bands.age_band_sql(age).alias("age_group"))


def dim_product(raw_products: DataFrame) -> DataFrame:
    return raw_products.select(F.col("produc_id").alias("product_id"), "product_name", "category",
                               money_decimal(F.col("price"), 8, strip="$").alias("unit_price"))


def dim_date(orders: DataFrame) -> DataFrame:
    return calendar.calendar(calendar.days_spine(quality.date_span(orders)))


def dim_date_us(orders: DataFrame) -> DataFrame:
    return calendar.calendar_us(calendar.numbered_days(quality.date_span(orders)))


def global_kpis(orders: DataFrame, customers: DataFrame, drivers: DataFrame) -> DataFrame:
    """Nineteen figures in one row, taken from the facts and the finished dimensions."""
    dim_drivers = drv.driver_dimension(orders, drivers)
    dim_customers = cust.customer_dimension(orders, customers)
    regions = kpis.amounts_by(orders, "region").withColumnRenamed("failure_rate", "rate")
    of_drivers = dim_drivers.agg(F.struct(
        F.countDistinct("driver_id").alias("total"),
        F.count_if(F.col("intervention_quadrant") == bands.QUADRANTS_EXPORT["chronic"]).alias("chronic"),
        F.count_if(F.col("intervention_quadrant") == bands.QUADRANTS_EXPORT["unstable"]).alias("coaching"))).scalar()
    churned = F.col("churned")
    of_customers = dim_customers.agg(F.struct(
        F.countDistinct("customer_id").alias("total"), F.count_if("had_failure").alias("had"),
        F.count_if("churned").alias("churned"),
        F.coalesce(F.sum(F.when(churned, F.col("total_revenue"))), F.lit(0.0)).alias("risk"))).scalar()
    of_regions = kpis.extremes(regions, "region", "rate").withColumn(
        "total", regions.agg(F.count(F.lit(1))).scalar()).select(F.struct("*")).scalar()
    cost = F.col("failures") * F.col("cost_per_failure")
    return kpis.global_totals(orders).withColumns({"d": of_drivers, "c": of_customers, "r": of_regions}).select(
        F.col("orders").alias("total_orders"), agg.half_even(F.col("cents") / 100.0, 2).alias("total_revenue"),
        agg.half_even("avg_ticket", 2).alias("avg_ticket"), agg.half_even("failure_rate", 4).alias("global_failure_rate"),
        F.col("failures").alias("total_failures"), agg.half_even(cost, 2).alias("total_failure_cost"),
        F.col("d.total").alias("total_drivers"), F.col("c.total").alias("total_customers"),
        F.col("r.total").alias("total_regions"), F.col("r.worst_region").alias("worst_region"),
        agg.half_even("r.worst_region_rate", 4).alias("worst_region_rate"), F.col("r.best_region").alias("best_region"),
        agg.half_even("r.best_region_rate", 4).alias("best_region_rate"), F.col("d.chronic").alias("chronic_drivers"),
        F.col("d.coaching").alias("coaching_drivers"), F.col("c.had").alias("customers_with_failure"),
        F.col("c.churned").alias("customer_churn_count"), agg.half_even("c.risk", 2).alias("revenue_at_risk"),
        agg.half_even("cost_per_failure", 2).alias("cost_per_failure"))


def star_tables(t) -> dict[str, DataFrame]:
    """The thirteen exported tables by name. `t` holds orders, customers, drivers, products, order_items.

    Orders and the two large dimensions feed many of the tables, so each is computed once and stored.
    """
    orders = written(t.orders, "orders")
    dim_drivers = written(drv.driver_dimension(orders, t.drivers), "dim_drivers")
    dim_customers = written(cust.customer_dimension(orders, t.customers), "dim_customers")
    return {
        "fct_orders": fact_orders(orders), "dim_date": dim_date(orders), "dim_drivers": dim_drivers,
        "dim_customers": dim_customers, "dim_regions": kpis.region_dimension_kpis(orders),
        "dim_products": products.product_dimension(t.order_items, t.products),
        "agg_monthly_kpis": kpis.monthly_kpis(orders), "agg_hour_day_heatmap": kpis.hour_day(orders),
        "agg_region_day": kpis.region_day(orders), "agg_driver_monthly": drv.driver_monthly(orders, t.drivers),
        "agg_financial_impact": finance.impact_by_quadrant(dim_drivers),
        "agg_top_products": products.top_products_table(t.order_items, t.products),
        "agg_retention_summary": cust.retention_summary(dim_customers),
    }
