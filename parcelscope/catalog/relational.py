"""Joins, top-k lists, distinct values and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import bands
from ..operators import customers as cust
from ..operators import drivers as drv
from ..operators import joins, kpis, products, ranking, reshape
from ..plans import measures, star
from .base import query


@query("j1_master", """SELECT order_id, customer_id, driver_id, date, amount_cents, region, items_delivered, items_missing,
    delivery_hour, has_missing, customer_name, customer_age, driver_name, age, trips FROM m""")
def _(t):
    return joins.build_master(t.orders, t.customers, t.drivers).select(
        "order_id", "customer_id", "driver_id", "date", "amount_cents", "region", "items_delivered", "items_missing",
        "delivery_hour", "has_missing", "customer_name", "customer_age", "driver_name", "age", "trips")


REGION_NO = """rn AS (SELECT region, row_number() OVER (ORDER BY region)::INT AS region_id
    FROM (SELECT DISTINCT region FROM o WHERE region IS NOT NULL))"""


@query("j2_fact_region", REGION_NO + " SELECT order_id, region_id FROM o JOIN rn USING (region)")
def _(t):
    return joins.attach_region_id(t.orders, joins.region_dimension(t.orders)).select("order_id", "region_id")


@query("j3_items_products", "SELECT order_id, product_id, product_name, category, round(price, 6) AS price "
       "FROM it LEFT JOIN pr USING (product_id)")
def _(t):
    return t.order_items.join(t.products, "product_id", "left").select(
        "order_id", "product_id", "product_name", "category", "price")


@query("j4_products_counts", "SELECT product_id, count(order_id) AS order_count FROM pr LEFT JOIN it USING (product_id) GROUP BY 1")
def _(t):
    return products.product_dimension(t.order_items, t.products).select("product_id", "order_count")


@query("j5_half_years", "SELECT driver_id, round(rate_h1, 6) AS rate_h1, round(rate_h2, 6) AS rate_h2 FROM h")
def _(t):
    return drv.semester_rates(t.orders_without_region).select("driver_id", "rate_h1", "rate_h2")


@query("j6_enriched_drivers", "SELECT driver_id, deliveries, round_even(rate_h1, 4) AS rate_h1, consistency_cv, months_active FROM dx")
def _(t):
    return drv.driver_dimension(t.orders_without_region, t.drivers).select(
        "driver_id", F.col("total_deliveries").alias("deliveries"), "rate_h1", "consistency_cv", "months_active")


@query("j7_last_failure_last_order", "SELECT customer_id, last_failure, last_order FROM ca WHERE last_failure IS NOT NULL")
def _(t):
    return cust.customer_profile(t.orders_without_region).where("last_failure IS NOT NULL").select(
        "customer_id", "last_failure", "last_order")


@query("j8_churn_flag", "SELECT customer_id, churned FROM c")
def _(t):
    return cust.customer_profile(t.orders_without_region).select("customer_id", "churned")


@query("j9_first_failure_orders", "SELECT order_id, customer_id, date, first_failure, date > first_failure AS is_post "
       "FROM o JOIN ca USING (customer_id) WHERE first_failure IS NOT NULL")
def _(t):
    first = cust.customer_profile(t.orders_without_region).where("first_failure IS NOT NULL").select(
        "customer_id", "first_failure")
    return joins.join_per_key(t.orders_without_region, first, "customer_id", "inner").select(
        "order_id", "customer_id", "date", "first_failure", (F.col("date") > F.col("first_failure")).alias("is_post"))


@query("j10_semi_join", "SELECT order_id, customer_id FROM o WHERE customer_id IN (SELECT customer_id FROM c WHERE "
       "returned_after_failure)")
def _(t):
    returned = cust.customer_profile(t.orders_without_region).where("returned_after_failure")
    return joins.semi(t.orders_without_region, returned, "customer_id").select("order_id", "customer_id")


@query("j11_member_flag", "SELECT customer_id, customer_id IN (SELECT customer_id FROM o WHERE has_missing) AS had_failure "
       "FROM cu")
def _(t):
    return joins.member_flag(t.customers, t.orders_without_region.where("has_missing"), "customer_id", "had_failure").select(
        "customer_id", "had_failure")


@query("j12_map_lookup", "SELECT order_id, day_of_week, day_ord FROM o JOIN days USING (day_of_week)")
def _(t):
    from ..functions.calendar import DAYS
    table = {name: i for i, name in enumerate(DAYS, 1)}
    return t.orders_without_region.select("order_id", "day_of_week",
                                          joins.lookup(F.col("day_of_week"), table).alias("day_ord"))


@query("j13_global_scalar", "SELECT order_id, round(order_amount - g_ticket, 6) AS vs_ticket, "
       "(last_day - date)::INT AS days_to_end FROM o, g")
def _(t):
    orders = t.orders_without_region
    return orders.withColumn("g", kpis.global_scalar(orders)).select(
        "order_id", (F.col("order_amount") - F.col("g.avg_ticket")).alias("vs_ticket"),
        F.datediff("g.last_day", "date").alias("days_to_end"))


@query("j14_anti_join", "SELECT order_id, customer_id FROM o WHERE customer_id NOT IN (SELECT customer_id FROM o WHERE has_missing)")
def _(t):
    failed = t.orders_without_region.where("has_missing").select("customer_id").distinct()
    return joins.anti(t.orders_without_region, failed, "customer_id").select("order_id", "customer_id")


# ---- top-k and distinct

def _ranked_sql(order, k, condition):
    return (f"SELECT driver_id, driver_name, deliveries, round(failure_rate, 6) AS failure_rate, trips FROM dt "
            f"WHERE {condition} ORDER BY dt.failure_rate {order}, driver_id LIMIT {k}")


@query("t1_worst_drivers_min5", _ranked_sql("DESC", 10, "deliveries >= 5"))
def _(t):
    return drv.ranked_drivers(t.orders_without_region, t.drivers, 10, 5)


@query("t1_best_drivers_min5", _ranked_sql("ASC", 10, "deliveries >= 5"))
def _(t):
    return drv.ranked_drivers(t.orders_without_region, t.drivers, 10, 5, worst=False)


@query("t1_worst_drivers_min20", _ranked_sql("DESC", 10, "deliveries >= 20"))
def _(t):
    return drv.ranked_drivers(t.orders_without_region, t.drivers, 10, 20)


@query("t1_best_drivers_min20", _ranked_sql("ASC", 10, "deliveries >= 20"))
def _(t):
    return drv.ranked_drivers(t.orders_without_region, t.drivers, 10, 20, worst=False)


@query("t2_worst_drivers_with_tier", """SELECT driver_name, round(failure_rate, 6) AS failure_rate, deliveries,
    CASE WHEN trips <= 25 THEN 'Rookie (<=25)' WHEN trips <= 50 THEN 'Intermediate (26-50)' ELSE 'Experienced (51+)' END
    AS tier FROM dt ORDER BY dt.failure_rate DESC, driver_id LIMIT 10""")
def _(t):
    return drv.ranked_drivers(t.orders_without_region, t.drivers, 10).select(
        "driver_name", "failure_rate", "deliveries",
        bands.experience_tier(F.col("trips"), bands.TIER_LABELS_REPORT).alias("tier"))


@query("t3_worst_15", _ranked_sql("DESC", 15, "deliveries >= 5"))
def _(t):
    return drv.ranked_drivers(t.orders_without_region, t.drivers, 15, 5)


@query("t3_best_15", _ranked_sql("ASC", 15, "deliveries >= 5 AND failure_rate < 1"))
def _(t):
    return drv.ranked_drivers(t.orders_without_region, t.drivers, 15, 5, worst=False, skip_always_failing=True)


@query("t4_worst_per_region", """rd AS (SELECT region, driver_name, count(*) AS deliveries, avg(has_missing::INT) AS rate FROM m
    WHERE driver_name IS NOT NULL GROUP BY ALL HAVING count(*) >= 3) SELECT region, place, driver_name, deliveries,
    round(rate, 6) AS missing_rate FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY rate DESC, driver_name)::INT
    AS place FROM rd) WHERE place <= 10""")
def _(t):
    return drv.worst_per_region(t.orders, t.drivers)


@query("t5_top_products", "SELECT product_name, count(*) AS order_count FROM it JOIN pr USING (product_id) GROUP BY 1 "
       "ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return products.top_by_name(t.order_items, t.products, "product_name")


@query("t5_top_products_category", "SELECT product_name, category, count(*) AS order_count FROM it JOIN pr USING (product_id) "
       "GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
def _(t):
    return products.top_by_name(t.order_items, t.products, "product_name", "category")


@query("t6_top_chronic", """ch AS (SELECT cc.* FROM cc, (SELECT median(avg_rate) AS rm, median(cv) AS cm FROM cc)
    WHERE avg_rate > rm AND cv < cm ORDER BY cc.avg_rate DESC, driver_id LIMIT 10)
    SELECT driver_id, driver_name, round(avg_rate, 6) AS avg_rate, round(cv, 6) AS cv, months_active
    FROM ch JOIN dr USING (driver_id)""")
def _(t):
    quadrants = drv.cohort_quadrants(drv.cohort_consistency(t.orders_without_region))
    return drv.top_chronic(quadrants, t.drivers)


@query("t7_distinct_by_key", "SELECT DISTINCT driver_id, driver_name FROM m WHERE driver_id IS NOT NULL")
def _(t):
    # Distinct ids first: the names depend on the id alone.
    ids = t.orders_without_region.select("driver_id").dropDuplicates(["driver_id"])
    return ids.join(t.drivers, "driver_id").select("driver_id", "driver_name")


@query("t8_distinct_values", "SELECT DISTINCT region FROM o")
def _(t):
    return cust.ordered_values(t.orders, "region")


# ---- reshape

def _pivot_sql(rows, value, source="o"):
    cells = ", ".join(f"round(coalesce({value} FILTER (WHERE delivery_hour = {h}), 0), 6) AS h{h:02d}" for h in range(24))
    return f"SELECT {rows}, {cells} FROM {source} WHERE {rows} IS NOT NULL GROUP BY {rows}"


@query("r1_pivot_day_hour_volume", _pivot_sql("day_of_week", "count(*)").replace("round(coalesce(", "(coalesce(").replace(
    ", 0), 6) AS", ", 0)) AS"))
def _(t):
    return reshape.pivot_hours(t.orders_without_region, "day_of_week", F.count("order_id"))


@query("r1_pivot_day_hour_rate", _pivot_sql("day_of_week", "avg(has_missing::INT)"))
def _(t):
    return reshape.pivot_hours(t.orders_without_region, "day_of_week", F.avg(F.col("has_missing").cast("int")), 0.0)


@query("r1_pivot_region_hour_rate", _pivot_sql("region", "avg(has_missing::INT)").replace(
    "round(coalesce(", "round_even(coalesce(").replace(", 0), 6)", ", 0), 2)"))
def _(t):
    return reshape.pivot_hours(t.orders, "region", agg.half_even(F.avg(F.col("has_missing").cast("int")), 2), 0.0)


PHASES = """ph AS (SELECT customer_id, sum(amount_cents) FILTER (WHERE date <= first_failure) / 100.0
        / count(*) FILTER (WHERE date <= first_failure) AS pre_failure,
    sum(amount_cents) FILTER (WHERE date > first_failure) / 100.0
        / nullif(count(*) FILTER (WHERE date > first_failure), 0) AS post_failure
    FROM o JOIN ca USING (customer_id) WHERE first_failure IS NOT NULL GROUP BY 1),
    pp AS (SELECT *, post_failure - pre_failure AS delta FROM ph WHERE pre_failure IS NOT NULL AND post_failure IS NOT NULL)"""


@query("r2_pivot_phases", PHASES + " SELECT customer_id, round(pre_failure, 6) AS pre_failure, "
       "round(post_failure, 6) AS post_failure, round(delta, 6) AS delta FROM pp")
def _(t):
    return cust.spend_by_phase(t.orders_without_region)


@query("r3_melt_half_years", "SELECT * FROM (SELECT driver_id, 'rate_h1' AS semester, round(rate_h1, 6) AS rate FROM h "
       "UNION ALL SELECT driver_id, 'rate_h2', round(rate_h2, 6) FROM h)")
def _(t):
    return reshape.melt(drv.semester_rates(t.orders_without_region), ["driver_id"], ["rate_h1", "rate_h2"],
                        "semester", "rate")


@query("r4_unpivot_missing_items", "SELECT order_id, product_id, position::INT AS position FROM mp WHERE position <= 3")
def _(t):
    return reshape.unpivot_missing_items(t.missing_items)
