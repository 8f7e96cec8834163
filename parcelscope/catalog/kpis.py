"""Aggregations and window results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..operators import clusters, features, finance, joins, kpis, products, ranking, stats
from ..operators import customers as cust
from ..operators import drivers as drv
from ..plans import star
from ..session import written
from .base import query
from .solvers import assigned_sql, clusters_sql


@query("a1_executive_kpis", """SELECT count(*) AS total_orders, round(sum(amount_cents) / 100.0, 6) AS total_revenue,
    round(sum(amount_cents) / 100.0 / count(*), 6) AS avg_ticket, round(avg(has_missing::INT), 6) AS failure_rate,
    count(*) FILTER (WHERE has_missing) AS total_failures, count(DISTINCT customer_id) AS total_customers,
    count(DISTINCT driver_id) AS total_drivers, count(DISTINCT region) AS total_regions FROM o""")
def _(t):
    return kpis.executive_kpis(t.orders)


@query("a2_monthly_trend", "SELECT month, count(*) AS total_orders, round(sum(amount_cents) / 100.0, 6) AS total_revenue, "
       "round(avg(has_missing::INT), 6) AS failure_rate FROM o GROUP BY 1")
def _(t):
    return kpis.monthly_trend(t.orders)


MONTHLY_SQL = """mo AS (SELECT month, count(*) AS total_orders, sum(amount_cents) / 100.0 AS total_revenue,
        sum(amount_cents) / 100.0 / count(*) AS avg_ticket, count(*) FILTER (WHERE has_missing) AS total_failures,
        avg(has_missing::INT) AS failure_rate FROM o GROUP BY 1)"""


@query("a3_monthly_kpis", MONTHLY_SQL + """ SELECT month, total_orders, round(total_revenue, 6) AS total_revenue,
    round(avg_ticket, 6) AS avg_ticket, total_failures, round(failure_rate, 6) AS failure_rate,
    round(total_failures * g_cost, 6) AS failure_cost,
    round((total_revenue / lag(total_revenue) OVER (ORDER BY month) - 1) * 100, 6) AS mom_revenue_change,
    round((failure_rate - lag(failure_rate) OVER (ORDER BY month)) * 100, 6) AS mom_failure_change FROM mo, g""")
def _(t):
    return kpis.monthly_kpis(t.orders)


@query("a4_revenue_by_region", "SELECT region, round(sum(amount_cents) / 100.0, 6) AS total_revenue FROM o GROUP BY 1")
def _(t):
    return kpis.revenue_by_region(t.orders)


@query("a5_region_summary", "SELECT region, count(*) AS total_orders, round(sum(amount_cents) / 100.0, 6) AS total_revenue, "
       "round(sum(amount_cents) / 100.0 / count(*), 6) AS avg_ticket, round(avg(has_missing::INT), 6) AS missing_rate "
       "FROM o GROUP BY 1")
def _(t):
    return kpis.region_summary(t.orders)


@query("a6_region_quality", "SELECT region, count(*) AS total_orders, count(*) FILTER (WHERE has_missing) AS missing_count, "
       "round(avg(has_missing::INT), 6) AS missing_rate FROM o GROUP BY 1")
def _(t):
    return kpis.region_quality(t.orders)


@query("a7_region_dimension", """SELECT region, count(*) AS total_orders, count(*) FILTER (WHERE has_missing) AS total_failures,
    round(avg(has_missing::INT), 6) AS failure_rate, round(sum(amount_cents) / 100.0, 6) AS total_revenue,
    round(sum(amount_cents) / 100.0 / count(*), 6) AS avg_ticket, count(DISTINCT driver_id) AS unique_drivers,
    count(DISTINCT customer_id) AS unique_customers,
    round(count(*) FILTER (WHERE has_missing) * min(g_cost), 6) AS failure_cost_estimated,
    round((avg(has_missing::INT) - min(g_rate)) * 100, 6) AS vs_global_avg_pp,
    CASE WHEN avg(has_missing::INT) > min(g_rate) THEN 'Above Average' ELSE 'Below Average' END AS performance_label
    FROM o, g GROUP BY 1""")
def _(t):
    return kpis.region_dimension_kpis(t.orders)


@query("a8_day_failure_rate", """SELECT day_ord, day_of_week, count(order_id) AS total_orders,
    count(*) FILTER (WHERE has_missing) AS failures, round(avg(has_missing::INT), 6) AS failure_rate,
    CASE WHEN avg(has_missing::INT) > min(g_rate) THEN 'critical' ELSE 'ok' END AS status
    FROM days LEFT JOIN o USING (day_of_week), g GROUP BY 1, 2""")
def _(t):
    return kpis.by_day(t.orders)


HOUR_DAY = "FROM o JOIN days USING (day_of_week) GROUP BY ALL"


@query("a9_hour_day_volume", "SELECT day_of_week, day_ord, delivery_hour, count(*) AS volume " + HOUR_DAY)
def _(t):
    return kpis.hour_day(t.orders).select("day_of_week", "day_ord", "delivery_hour", "volume")


@query("a10_hour_day_table", "SELECT day_of_week, day_ord, delivery_hour, count(*) AS volume, "
       "round(avg(has_missing::INT), 6) AS failure_rate, round(sum(amount_cents) / 100.0, 6) AS revenue " + HOUR_DAY)
def _(t):
    return kpis.hour_day(t.orders)


@query("a11_hour_day_failure_rate", "SELECT day_of_week, delivery_hour, round(avg(has_missing::INT), 6) AS failure_rate "
       + HOUR_DAY.replace("JOIN days USING (day_of_week)", ""))
def _(t):
    return kpis.hour_day(t.orders).select("day_of_week", "delivery_hour", "failure_rate")


@query("a11_region_hour_day", "SELECT region, day_of_week, delivery_hour, count(*) AS orders, "
       "round(avg(has_missing::INT), 6) AS failure_rate FROM o GROUP BY ALL")
def _(t):
    return kpis.region_day_hour(t.orders)


@query("a12_region_day", "SELECT region, day_of_week, day_ord, count(*) AS total_orders, round(avg(has_missing::INT), 6) "
       "AS failure_rate, count(*) FILTER (WHERE has_missing) AS total_failures " + HOUR_DAY)
def _(t):
    return kpis.region_day(t.orders)


@query("a13_region_hour", "SELECT region, delivery_hour, count(*) AS orders, round(avg(has_missing::INT), 6) AS failure_rate "
       "FROM o GROUP BY ALL")
def _(t):
    return kpis.region_hour(t.orders)


@query("a14_period_failure_rate", """SELECT CASE WHEN delivery_hour <= 5 THEN 'Overnight (0-5h)' WHEN delivery_hour <= 11
    THEN 'Morning (6-11h)' WHEN delivery_hour <= 17 THEN 'Afternoon (12-17h)' ELSE 'Evening (18-23h)' END AS period,
    count(*) AS total_orders, round(avg(has_missing::INT), 6) AS failure_rate,
    (min(delivery_hour) // 6 + 1)::INT AS period_ord FROM o GROUP BY 1""")
def _(t):
    return kpis.period_quality(t.orders)


AGE_LEFT = """ag AS (SELECT *, CASE WHEN customer_age < 18 OR customer_age >= 100 THEN NULL WHEN customer_age < 30 THEN '18-29'
    WHEN customer_age < 45 THEN '30-44' WHEN customer_age < 60 THEN '45-59' ELSE '60+' END AS age_group FROM m)"""


@query("a15_orders_by_age", AGE_LEFT + " SELECT age_group, count(*) AS count FROM ag WHERE age_group IS NOT NULL GROUP BY 1")
def _(t):
    return kpis.age_bands(t.orders_without_region, t.customers).select("age_group", "count")


@query("a16_ticket_by_age", AGE_LEFT + " SELECT age_group, round(sum(amount_cents) / 100.0 / count(*), 6) AS avg_ticket "
       "FROM ag WHERE age_group IS NOT NULL GROUP BY 1")
def _(t):
    return kpis.age_bands(t.orders_without_region, t.customers).select("age_group", "avg_ticket")


@query("a17_items_by_category", "SELECT category, count(*) AS count FROM it JOIN pr USING (product_id) GROUP BY 1")
def _(t):
    return products.items_by_category(t.order_items, t.products)


@query("a18_counts_by_name", "SELECT product_name, count(*) AS order_count FROM it JOIN pr USING (product_id) GROUP BY 1")
def _(t):
    return products.counts_by(t.order_items, t.products, "product_name")


@query("a18_counts_by_name_category", "SELECT product_name, category, count(*) AS order_count FROM it "
       "JOIN pr USING (product_id) GROUP BY ALL")
def _(t):
    return products.counts_by(t.order_items, t.products, "product_name", "category")


@query("a18_product_table", "SELECT product_id, product_name, category, round(price, 6) AS price, count(*) AS order_count, "
       "round(count(*) * price, 6) AS revenue_generated FROM it JOIN pr USING (product_id) "
       "GROUP BY product_id, product_name, category, pr.price")
def _(t):
    return products.top_products_table(t.order_items, t.products)


@query("a19_product_dimension", "SELECT product_id, product_name, category, round(price, 6) AS price, count(order_id) AS "
       "order_count, round(count(order_id) * price, 6) AS revenue_potential FROM pr LEFT JOIN it USING (product_id) "
       "GROUP BY product_id, product_name, category, pr.price")
def _(t):
    return products.product_dimension(t.order_items, t.products)


@query("a20_driver_performance", "SELECT driver_id, driver_name, deliveries, failures, round(failure_rate, 6) AS failure_rate, "
       "round(avg_items, 6) AS avg_items, round(total_revenue, 6) AS total_revenue, round(avg_ticket, 6) AS avg_ticket FROM dt")
def _(t):
    return drv.driver_performance(t.orders_without_region, t.drivers)


@query("a21_driver_profile", "SELECT driver_id, driver_name, deliveries AS total_deliveries, failures AS total_failures, "
       "round(failure_rate, 6) AS hist_failure_rate, round(total_revenue, 6) AS total_revenue, "
       "round(avg_ticket, 6) AS avg_ticket, trips, age AS driver_age FROM dt")
def _(t):
    return drv.driver_profile(t.orders_without_region, t.drivers)


@query("a22_driver_monthly", "SELECT driver_id, driver_name, month, deliveries, failures, round(rate, 6) AS failure_rate, "
       "round(revenue, 6) AS revenue FROM dm")
def _(t):
    return drv.driver_monthly(t.orders_without_region, t.drivers)


@query("a23_consistency_export", "SELECT driver_id, months_active, round(avg_rate, 6) AS avg_rate, "
       "round(std_rate, 6) AS std_rate, consistency_cv FROM ce")
def _(t):
    return drv.export_consistency(t.orders_without_region)


@query("a24_consistency_cohort", "SELECT driver_id, months_active, round(avg_rate, 6) AS avg_rate, "
       "round(std_rate, 6) AS std_rate, round(cv, 6) AS cv FROM cc")
def _(t):
    return drv.cohort_consistency(t.orders_without_region)


@query("a25_semester_rates", "SELECT driver_id, del_h1, round(rate_h1, 6) AS rate_h1, del_h2, round(rate_h2, 6) AS rate_h2, "
       "round(delta_h1_h2, 6) AS delta_h1_h2, improved_h1_h2 FROM h")
def _(t):
    return drv.semester_rates(t.orders_without_region)


TIER_SQL = """ti AS (SELECT *, CASE WHEN trips <= 0 OR trips > 100 THEN NULL WHEN trips <= 25 THEN 1 WHEN trips <= 50 THEN 2
    ELSE 3 END AS tier_no FROM m WHERE trips IS NOT NULL),
    tn AS (SELECT unnest([1, 2, 3]) AS tier_no, unnest(['Novice (≤25 trips)', 'Intermediate (26–50)', 'Experienced (51+)'])
           AS cohort, unnest(['Rookie (<=25)', 'Intermediate (26-50)', 'Experienced (51+)']) AS report)"""


@query("a26_tier_stats", TIER_SQL + """ SELECT cohort AS tier, count(DISTINCT driver_id) AS drivers, count(*) AS orders,
    count(*) FILTER (WHERE has_missing) AS failures, round(avg(has_missing::INT), 6) AS failure_rate,
    round(sum(amount_cents) / 100.0 / count(*), 6) AS avg_ticket,
    round(count(*) FILTER (WHERE has_missing) * min(g_cost), 6) AS estimated_cost
    FROM ti JOIN tn USING (tier_no), g GROUP BY 1""")
def _(t):
    return drv.tier_stats(t.orders_without_region, t.drivers).select(
        "tier", "drivers", "orders", "failures", "failure_rate", "avg_ticket", "estimated_cost")


@query("a27_tier_stats_by_driver", TIER_SQL + """, td AS (SELECT driver_id, report AS tier, avg(has_missing::INT) AS rate,
    count(*) FILTER (WHERE has_missing) AS failures FROM ti JOIN tn USING (tier_no) GROUP BY 1, 2)
    SELECT tier, count(*) AS drivers, round(avg(rate), 6) AS failure_rate,
    round(sum(failures) * min(g_cost), 6) AS cost FROM td, g GROUP BY 1""")
def _(t):
    return drv.tier_stats_by_driver(t.orders_without_region, t.drivers)


@query("a28_tier_financials", TIER_SQL + """, tf AS (SELECT cohort AS tier, count(*) AS orders,
    count(*) FILTER (WHERE has_missing) AS failures, sum(amount_cents) / 100.0 AS revenue FROM ti JOIN tn USING (tier_no) GROUP BY 1)
    SELECT tier, orders, failures, round(revenue, 6) AS revenue, round(failures * g_cost, 6) AS estimated_cost,
    round(failures * g_cost / orders, 6) AS cost_per_order, round(failures * g_cost / revenue * 100, 6) AS pct_revenue FROM tf, g""")
def _(t):
    return drv.tier_stats(t.orders_without_region, t.drivers).select(
        "tier", "orders", "failures", "revenue", "estimated_cost", "cost_per_order", "pct_revenue")


@query("a29_customer_profile", """SELECT customer_id, total_orders, total_failures, round(total_revenue, 6) AS total_revenue,
    round(avg_ticket, 6) AS avg_ticket, months_active, first_order, last_order, round(failure_rate, 6) AS failure_rate,
    round(orders_per_month, 6) AS orders_per_month, had_failure FROM c""")
def _(t):
    return cust.customer_profile(t.orders_without_region).select(
        "customer_id", "total_orders", "total_failures", "total_revenue", "avg_ticket", "months_active", "first_order",
        "last_order", "failure_rate", "orders_per_month", "had_failure")


@query("a30_failure_group_profile", """fg AS (SELECT CASE WHEN total_failures = 0 THEN '0 failures' WHEN total_failures = 1
    THEN '1 failure' WHEN total_failures = 2 THEN '2 failures' ELSE '3+ failures' END AS failure_group,
    count(*) AS customers, sum(cents) / 100.0 AS revenue, sum(cents) / 100.0 / count(*) AS avg_ticket FROM c GROUP BY 1)
    SELECT failure_group, customers, round(revenue, 6) AS revenue, round(avg_ticket, 6) AS avg_ticket,
    round(customers * 100.0 / sum(customers) OVER (), 6) AS pct_customers,
    round(revenue / sum(revenue) OVER () * 100, 6) AS pct_revenue FROM fg""")
def _(t):
    return cust.failure_group_profile(cust.customer_profile(t.orders_without_region))


@query("a31_affected_base", """SELECT count(*) AS total_customers, count(*) FILTER (WHERE had_failure) AS customers_with_failure,
    round(avg(had_failure::INT) * 100, 6) AS pct_affected,
    round(sum(cents) FILTER (WHERE had_failure) / 100.0, 6) AS revenue_affected FROM c""")
def _(t):
    return cust.affected_base(cust.customer_profile(t.orders_without_region))


@query("a32_order_frequency", """SELECT had_failure, round(avg(orders_per_month), 6) AS mean,
    round(median(orders_per_month), 6) AS median, round(stddev_samp(orders_per_month), 6) AS std, count(*) AS count
    FROM c GROUP BY 1""")
def _(t):
    return cust.order_frequency(cust.customer_profile(t.orders_without_region))


@query("a33_churn_by_failures", """SELECT least(total_failures, 5) AS failure_count_capped,
    CASE WHEN total_failures >= 5 THEN '5+' ELSE total_failures::VARCHAR END AS failure_label, count(*) AS customers,
    count(*) FILTER (WHERE churned) AS churned_count, round(avg(churned::INT), 6) AS churn_rate
    FROM c WHERE total_failures > 0 GROUP BY 1, 2""")
def _(t):
    return cust.churn_by_failures(cust.customer_profile(t.orders_without_region))


@query("a34_impact_by_quadrant", """fi AS (SELECT intervention_quadrant, count(*) AS drivers,
    sum(total_deliveries)::BIGINT AS total_deliveries, sum(total_failures)::BIGINT AS total_failures,
    sum(estimated_failure_cost) AS total_failure_cost, avg(hist_failure_rate) AS avg_failure_rate FROM dd GROUP BY 1)
    SELECT intervention_quadrant, drivers, total_deliveries, total_failures, round(total_failure_cost, 6) AS total_failure_cost,
    round(avg_failure_rate, 6) AS avg_failure_rate,
    round(total_failure_cost / sum(total_failure_cost) OVER () * 100, 6) AS pct_total_cost,
    round(total_failure_cost * 0.30, 6) AS savings_if_30pct_reduction FROM fi""")
def _(t):
    return finance.impact_by_quadrant(drv.driver_dimension(t.orders_without_region, t.drivers))


DRIVER_ROWS_SQL = """df AS (SELECT driver_id, count(*) AS total_deliveries, avg(has_missing::INT) AS missing_rate,
    sum(amount_cents) / 100.0 / count(*) AS avg_order_value, count(DISTINCT region) AS region_diversity,
    avg(items_delivered) AS avg_items FROM o WHERE driver_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)"""
DRIVER_CLUSTERS_SQL = f"""{DRIVER_ROWS_SQL}, {clusters_sql("df", "driver_id", clusters.DRIVER_FEATURES, [3], "d")}, {assigned_sql(3, "d")},
    ds AS (SELECT cluster, count(*) AS n_drivers, round_even(avg(missing_rate), 3) AS avg_missing_rate,
    round_even(avg(total_deliveries), 3) AS avg_deliveries, round_even(avg(avg_order_value), 3) AS avg_ticket
    FROM df JOIN kad ON key = driver_id GROUP BY 1),
    dp AS (SELECT *, ['Low Risk', 'Medium Risk', 'High Risk'][row_number() OVER (ORDER BY avg_missing_rate, cluster)] AS profile FROM ds)"""


def _driver_clusters(t):
    rows = written(clusters.driver_features(t.orders), "drivers")
    return clusters.assigned(clusters.fit_clusters(rows, clusters.DRIVER_FEATURES, 3, "driver_id"), rows)


@query("a35_profile_impact", DRIVER_CLUSTERS_SQL + """, pi AS (SELECT profile, count(*) AS total_orders, count(*) FILTER (WHERE has_missing)
    AS total_failures, sum(amount_cents) / 100.0 AS total_revenue FROM o JOIN kad ON key = driver_id JOIN dp USING (cluster) GROUP BY 1)
    SELECT profile, total_orders, total_failures, round(total_failures::DOUBLE / total_orders, 6) AS failure_rate,
    round(total_revenue, 6) AS total_revenue, round(total_failures * 25.0, 6) AS estimated_cost,
    round(total_failures * 25.0 / total_revenue * 100, 6) AS pct_revenue_at_risk,
    round(total_failures * 100.0 / sum(total_failures) OVER (), 6) AS pct_of_cost FROM pi""", recursive=True)
def _(t):
    return clusters.profile_impact(t.orders_without_region, _driver_clusters(t))


@query("a36_retention_summary", """rs AS (SELECT count(*) AS n, count(*) FILTER (WHERE had_failure) AS had,
    round_even(avg(had_failure::INT) * 100, 1) AS had_pct, count(*) FILTER (WHERE returned_after_failure) AS back,
    round_even(avg(returned_after_failure::INT) * 100, 1) AS back_pct, count(*) FILTER (WHERE churned) AS lost,
    round_even(coalesce(sum(total_revenue) FILTER (WHERE churned), 0), 2) AS risk,
    round_even(avg(total_revenue) FILTER (WHERE churned), 2) AS risk_avg FROM dc)
    SELECT unnest(range(1, 9))::INT AS metric_ord, unnest(['Total Customers', 'Customers with Failure', '% Base Impacted',
    'Returned After Failure', 'Return Rate (%)', 'Churned Customers', 'Revenue at Risk ($)', 'Average Cost per Churn ($)'])
    AS metric, unnest([n::DOUBLE, had, had_pct, back, back_pct, lost, risk, risk_avg]) AS value FROM rs""")
def _(t):
    return cust.retention_summary(cust.customer_dimension(t.orders_without_region, t.customers))


GLOBAL_KPI_SQL = """rr AS (SELECT region, avg(has_missing::INT) AS rate FROM o GROUP BY 1)
    SELECT g_orders AS total_orders, round_even(g_cents / 100.0, 2) AS total_revenue, round_even(g_ticket, 2) AS avg_ticket,
    round_even(g_rate, 4) AS global_failure_rate, g_failures AS total_failures,
    round_even(g_failures * g_cost, 2) AS total_failure_cost, (SELECT count(DISTINCT driver_id) FROM dd) AS total_drivers,
    (SELECT count(DISTINCT customer_id) FROM dc) AS total_customers, (SELECT count(*) FROM rr) AS total_regions,
    (SELECT region FROM rr ORDER BY rate DESC, region LIMIT 1) AS worst_region,
    (SELECT round_even(max(rate), 4) FROM rr) AS worst_region_rate,
    (SELECT region FROM rr ORDER BY rate, region LIMIT 1) AS best_region,
    (SELECT round_even(min(rate), 4) FROM rr) AS best_region_rate,
    (SELECT count(*) FROM dd WHERE intervention_quadrant = 'Chronic — Disciplinary Action') AS chronic_drivers,
    (SELECT count(*) FROM dd WHERE intervention_quadrant = 'Unstable — Coaching') AS coaching_drivers,
    (SELECT count(*) FROM dc WHERE had_failure) AS customers_with_failure,
    (SELECT count(*) FROM dc WHERE churned) AS customer_churn_count,
    (SELECT round_even(coalesce(sum(total_revenue), 0), 2) FROM dc WHERE churned) AS revenue_at_risk,
    round_even(g_cost, 2) AS cost_per_failure FROM g"""


@query("a37_global_kpis", GLOBAL_KPI_SQL)
def _(t):
    return star.global_kpis(t.orders, t.customers, t.drivers)


VARIANCE_SQL = """tk AS (SELECT customer_id, count(*) AS orders, count(*) FILTER (WHERE has_missing) AS failures,
        round(sum(amount_cents) / 100.0 / count(*), 9) AS mean_ticket FROM o GROUP BY 1),
    tq AS (SELECT quantile_cont(mean_ticket, 0.25) AS q25, quantile_cont(mean_ticket, 0.5) AS q50,
                  quantile_cont(mean_ticket, 0.75) AS q75 FROM o JOIN tk USING (customer_id)),
    vs AS (SELECT customer_id, CASE WHEN mean_ticket <= q25 THEN 'Low Value' WHEN mean_ticket <= q50 THEN 'Medium Value'
                  WHEN mean_ticket <= q75 THEN 'High Value' ELSE 'VIP' END AS value_segment FROM tk, tq),
    ao AS (SELECT has_missing::INT AS y, region, CASE WHEN customer_age <= 18 OR customer_age > 100 THEN NULL
                  WHEN customer_age <= 30 THEN '18-29' WHEN customer_age <= 45 THEN '30-44' WHEN customer_age <= 60
                  THEN '45-59' ELSE '60+' END AS age_group, value_segment FROM m JOIN vs USING (customer_id))"""


@query("a38_variance_comparison", VARIANCE_SQL + """, vr AS (
    SELECT 'Driver (individual)' AS dimension, failure_rate AS rate FROM dt WHERE deliveries >= 10 UNION ALL
    SELECT 'Region', avg(y) FROM ao GROUP BY region UNION ALL
    SELECT 'Age Group', avg(y) FROM ao WHERE age_group IS NOT NULL GROUP BY age_group UNION ALL
    SELECT 'Value Segment', avg(y) FROM ao GROUP BY value_segment)
    SELECT dimension, round(max(rate), 6) AS maximum, round(min(rate), 6) AS minimum, round(stddev_samp(rate), 6) AS std,
    round_even((max(rate) - min(rate)) * 100, 1) AS range_pp FROM vr GROUP BY 1""")
def _(t):
    return stats.variance_comparison(t.orders, t.customers)


@query("a39_items_by_failure", "SELECT has_missing, round(avg(items_delivered), 6) AS avg_items FROM o GROUP BY 1")
def _(t):
    return kpis.items_by_failure(t.orders_without_region)


@query("a40_extreme_regions", """rr AS (SELECT region, avg(has_missing::INT) AS rate FROM o GROUP BY 1)
    SELECT (SELECT region FROM rr ORDER BY rate DESC, region LIMIT 1) AS worst_region,
    (SELECT round(max(rate), 6) FROM rr) AS worst_region_rate,
    (SELECT region FROM rr ORDER BY rate, region LIMIT 1) AS best_region,
    (SELECT round(min(rate), 6) FROM rr) AS best_region_rate""")
def _(t):
    return kpis.extremes(kpis.amounts_by(t.orders, "region"), "region", "failure_rate")


@query("a41_cluster_summary", DRIVER_CLUSTERS_SQL + " SELECT * FROM dp", recursive=True)
def _(t):
    return clusters.driver_clusters(_driver_clusters(t))


@query("a42_driver_list", "SELECT driver_id, driver_name, round(failure_rate, 6) AS driver_hist_rate FROM dt")
def _(t):
    return drv.driver_list(t.orders_without_region, t.drivers)


# ---- windows

@query("w1_region_numbers", "SELECT DISTINCT region AS region_name, dense_rank() OVER (ORDER BY region)::INT AS region_id FROM o")
def _(t):
    return joins.region_dimension(t.orders)


@query("w2_prior_failure_rate", """SELECT order_id, driver_id, round(coalesce(CASE WHEN driver_id IS NOT NULL THEN
    avg(has_missing::INT) OVER (PARTITION BY driver_id ORDER BY date, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    END, g_rate), 6) AS driver_fail_rate FROM o, g""")
def _(t):
    return features.prior_failure_rate(t.orders_without_region).select("order_id", "driver_id", "driver_fail_rate")


@query("w3_customer_mean_ticket", "SELECT order_id, customer_id, round(sum(amount_cents) OVER (PARTITION BY customer_id) "
       "/ 100.0 / count(*) OVER (PARTITION BY customer_id), 6) AS mean_ticket FROM o")
def _(t):
    return kpis.with_customer_mean(t.orders_without_region).select("order_id", "customer_id", "mean_ticket")


@query("w3_driver_historic_rate", "SELECT order_id, driver_id, round(failure_rate, 6) AS driver_hist_rate "
       "FROM o LEFT JOIN dt USING (driver_id)")
def _(t):
    return features.with_historic_rate(t.orders_without_region).select("order_id", "driver_id", "driver_hist_rate")


@query("w4_month_over_month", MONTHLY_SQL + """ SELECT month,
    round((total_revenue / lag(total_revenue) OVER (ORDER BY month) - 1) * 100, 6) AS mom_revenue_change,
    round((failure_rate - lag(failure_rate) OVER (ORDER BY month)) * 100, 6) AS mom_failure_change FROM mo""")
def _(t):
    return kpis.monthly_kpis(t.orders_without_region).select("month", "mom_revenue_change", "mom_failure_change")


@query("w5_first_last", "SELECT customer_id, first_order, last_order, first_failure, last_failure FROM ca")
def _(t):
    return cust.customer_profile(t.orders_without_region).select(
        "customer_id", "first_order", "last_order", "first_failure", "last_failure")


@query("w6_share_of_total", "SELECT region, round(sum(amount_cents) * 100.0 / sum(sum(amount_cents)) OVER (), 6) AS pct_revenue "
       "FROM o GROUP BY 1")
def _(t):
    total = F.sum("total_revenue").over(Window.partitionBy())
    return kpis.region_summary(t.orders).select("region", agg.share(F.col("total_revenue"), total).alias("pct_revenue"))


@query("w7_rank_labels", "SELECT region, row_number() OVER (ORDER BY avg(has_missing::INT) DESC, region)::INT AS place "
       "FROM o GROUP BY region")
def _(t):
    return kpis.amounts_by(t.orders, "region").select("region", F.row_number().over(
        Window.orderBy(F.desc("failure_rate"), "region")).alias("place"))
