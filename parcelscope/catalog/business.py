"""Dimensions, facts, documents and report measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands
from ..operators import customers as cust
from ..operators import distribution, finance, kpis, reshape
from ..operators import drivers as drv
from ..plans import measures, report, star
from ..sources import writers
from .base import query
from .kpis import GLOBAL_KPI_SQL
from .relational import PHASES, REGION_NO


@query("d1_driver_dimension", """SELECT driver_id, driver_name, total_deliveries, total_failures, hist_failure_rate,
    total_revenue, avg_ticket, trips, driver_age, exp_tier, rate_h1, rate_h2, delta_h1_h2, improved_h1_h2, consistency_cv,
    months_active, intervention_quadrant, estimated_failure_cost, risk_flag FROM dd""")
def _(t):
    return drv.driver_dimension(t.orders_without_region, t.drivers)


@query("d2_customer_dimension", "SELECT * FROM dc")
def _(t):
    return cust.customer_dimension(t.orders_without_region, t.customers)


@query("d3_fact_orders", "SELECT * REPLACE (round(order_amount, 6) AS order_amount, round(failure_cost, 6) AS failure_cost) FROM f")
def _(t):
    return star.fact_orders(t.orders)


@query("d4_fact_orders_typed", REGION_NO + """ SELECT order_id, CAST(strftime(date, '%Y%m%d') AS INT) AS date_key, region_id,
    driver_id, customer_id, round(order_amount, 6) AS order_amount, items_delivered, items_missing, delivery_hour,
    has_missing::INT AS has_missing FROM o JOIN rn USING (region)""")
def _(t):
    from ..operators.joins import region_dimension
    return star.fact_orders_typed(t.raw_orders, region_dimension(t.orders))


_AGE = "CASE WHEN {0} BETWEEN 18 AND 29 THEN '18-29' WHEN {0} BETWEEN 30 AND 44 THEN '30-44' WHEN {0} BETWEEN 45 AND 59 THEN '45-59' ELSE '60+' END"


@query("d5_dim_driver", f"SELECT driver_id, driver_name, age, {_AGE.format('age')} AS age_group, trips AS total_trips FROM dr")
def _(t):
    return star.dim_driver(t.raw_drivers)


@query("d5_dim_customer", f"SELECT customer_id, customer_name, customer_age AS age, {_AGE.format('customer_age')} AS age_group FROM cu")
def _(t):
    return star.dim_customer(t.customers)


@query("d5_dim_product", "SELECT product_id, product_name, category, round(price, 2) AS unit_price FROM pr")
def _(t):
    return star.dim_product(t.raw_products)


@query("d6_trajectory", """SELECT count(*) AS drivers, count(*) FILTER (WHERE improved_h1_h2) AS improved,
    count(*) FILTER (WHERE NOT improved_h1_h2) AS worsened, round(avg(improved_h1_h2::INT) * 100, 6) AS pct_improved,
    round(-avg(delta_h1_h2) FILTER (WHERE improved_h1_h2) * 100, 6) AS avg_improvement_pp,
    round(avg(delta_h1_h2) FILTER (WHERE NOT improved_h1_h2) * 100, 6) AS avg_worsening_pp FROM h""")
def _(t):
    return drv.trajectory_summary(drv.semester_rates(t.orders_without_region))


@query("d7_recovery", """rc AS (SELECT count(*) AS high_risk, count(*) FILTER (WHERE rate_h2 < 0.20) AS recovered,
    count(*) FILTER (WHERE rate_h2 < rate_h1) AS improved,
    -avg(delta_h1_h2) FILTER (WHERE rate_h2 < rate_h1) * 100 AS red FROM h WHERE rate_h1 >= 0.20)
    SELECT high_risk, recovered, improved, improved - recovered AS partial, high_risk - improved AS not_improved,
    round(recovered * 100.0 / high_risk, 6) AS pct_recovered, round(improved * 100.0 / high_risk, 6) AS pct_improved,
    round(red, 6) AS avg_reduction_pp FROM rc""")
def _(t):
    return drv.recovery_summary(drv.semester_rates(t.orders_without_region))


@query("d8_quadrant_counts", """SELECT CASE WHEN avg_rate > rm AND cv < cm THEN 'High Risk / Consistent (Chronic)'
    WHEN avg_rate > rm THEN 'High Risk / Unstable (Coaching)' WHEN cv < cm THEN 'Low Risk / Consistent (Reference)'
    ELSE 'Low Risk / Unstable (Monitor)' END AS quadrant, count(*) AS drivers
    FROM cc, (SELECT median(avg_rate) AS rm, median(cv) AS cm FROM cc) GROUP BY 1""")
def _(t):
    return drv.quadrant_counts(drv.cohort_quadrants(drv.cohort_consistency(t.orders_without_region)))


@query("d9_returned", "SELECT customer_id, returned_after_failure FROM c")
def _(t):
    return cust.customer_profile(t.orders_without_region).select("customer_id", "returned_after_failure")


@query("d10_return_rates", """rt AS (SELECT count(*) FILTER (WHERE had_failure) AS wf,
    count(*) FILTER (WHERE returned_after_failure) AS rf,
    avg((total_orders > 1)::INT) FILTER (WHERE NOT had_failure) * 100 AS base FROM c)
    SELECT wf AS customers_with_failure, rf AS returned, wf - rf AS not_returned, round(rf * 100.0 / wf, 6) AS return_rate,
    round(base, 6) AS baseline_repeat_rate, round(rf * 100.0 / wf - base, 6) AS delta_pp FROM rt""")
def _(t):
    return cust.return_rates(cust.customer_profile(t.orders_without_region))


@query("d11_churned_customers", "SELECT customer_id, last_failure, last_order FROM c WHERE churned")
def _(t):
    return cust.customer_profile(t.orders_without_region).where("churned").select(
        "customer_id", "last_failure", "last_order")


@query("d12_revenue_at_risk", "SELECT count(*) AS churned_customers, round(sum(cents) / 100.0, 6) AS revenue_at_risk, "
       "round(avg(cents) / 100.0, 6) AS avg_revenue_per_churn FROM c WHERE churned")
def _(t):
    return cust.revenue_at_risk(cust.customer_profile(t.orders_without_region))


@query("d13_lifetime_value", """lv AS (SELECT g_ticket AS t, avg(total_orders) / 12 AS f, count(*) FILTER (WHERE churned) AS n
    FROM c, g GROUP BY 1) SELECT round(t, 6) AS avg_ticket, round(f, 6) AS orders_per_month, n AS churned,
    round(t * f * 0.20, 6) AS monthly_ltv, round(n * (t * f * 0.20) * 6 * 12, 6) AS projected_loss FROM lv""")
def _(t):
    return finance.lifetime_value(t.orders_without_region, cust.customer_profile(t.orders_without_region))


@query("d14_spend_change", PHASES + """ SELECT count(*) AS customers, round(avg(pre_failure), 6) AS avg_pre,
    round(avg(post_failure), 6) AS avg_post, round(avg(post_failure) - avg(pre_failure), 6) AS delta,
    round((avg(post_failure) - avg(pre_failure)) / avg(pre_failure) * 100, 6) AS pct_change FROM pp""")
def _(t):
    return cust.spend_change(cust.spend_by_phase(t.orders_without_region))


@query("d15_lost_customers", "SELECT customer_id, customer_name, failure_group, total_revenue, value_segment FROM dc WHERE churned")
def _(t):
    return cust.lost_customers(cust.customer_dimension(t.orders_without_region, t.customers))


@query("d16_cost_model", """SELECT round(g_ticket, 6) AS avg_ticket, g_failures AS failures, round(g_cost, 6) AS cost_per_failure,
    round(g_failures * g_cost, 6) AS total_failure_cost, 25 AS flat_cost_per_failure,
    g_failures * 25 AS flat_total_cost FROM g""")
def _(t):
    return finance.cost_model(t.orders_without_region)


@query("d17_savings_plan", """sp AS (SELECT round_even(g_failures * g_cost, 2) AS cost,
    (SELECT coalesce(sum(cents), 0) / 100.0 FROM c WHERE churned) AS risk FROM g)
    SELECT unnest([1, 2, 3, 4, 5])::INT AS priority, unnest(['Retraining of drivers with failure rate > 20%',
    'Digital checklist for orders > 12 items or > $400', 'Operational reinforcement on Mondays',
    'Operational audit in the worst region', 'Immediate compensation after customer''s 1st failure']) AS action,
    unnest(['Chronic and Unstable Drivers', 'High value/volume orders', 'Weekly operations', 'Worst region',
    'Churned customers']) AS target, unnest(['driver', 'order', 'time', 'region', 'retention']) AS category,
    unnest([round_even(cost * 0.30, 2), round_even(cost * 0.13, 2), round_even(cost * 0.05, 2), round_even(cost * 0.04, 2),
    round_even(risk, 2)]) AS savings FROM sp""")
def _(t):
    return finance.savings_plan(t.orders_without_region, cust.customer_profile(t.orders_without_region))


@query("d18_region_kpis", """SELECT region, count(*) AS total_orders, round(sum(amount_cents) / 100.0, 6) AS total_revenue,
    round(avg(has_missing::INT), 6) AS missing_rate, round(sum(amount_cents) / 100.0 / count(*), 6) AS avg_ticket,
    avg(has_missing::INT) > min(g_rate) AS above_average FROM o, g GROUP BY 1""")
def _(t):
    return report.region_detail(t.orders)


@query("d18_region_day_hour", """SELECT region, day_of_week, delivery_hour, count(*) AS orders,
    round(avg(has_missing::INT), 6) AS failure_rate FROM o GROUP BY ALL""")
def _(t):
    return kpis.region_day_hour(t.orders)


RUN_SQL = """rr AS (SELECT region, avg(has_missing::INT) AS rate FROM o GROUP BY 1),
    dw AS (SELECT day_of_week, day_ord, avg(has_missing::INT) AS rate FROM o JOIN days USING (day_of_week) GROUP BY 1, 2),
    dl AS (SELECT * FROM dt WHERE deliveries >= 5)
    SELECT g_orders AS total_orders, round(g_cents / 100.0, 6) AS total_revenue, round(g_ticket, 6) AS avg_ticket,
    round(g_rate, 6) AS missing_rate, (SELECT region FROM rr ORDER BY rate DESC, region LIMIT 1) AS worst_region,
    (SELECT round(max(rate), 6) FROM rr) AS worst_region_rate,
    (SELECT region FROM rr ORDER BY rate, region LIMIT 1) AS best_region,
    (SELECT round(min(rate), 6) FROM rr) AS best_region_rate,
    (SELECT day_of_week FROM dw ORDER BY rate DESC, day_ord LIMIT 1) AS worst_day,
    (SELECT round(max(rate), 6) FROM dw) AS worst_day_rate,
    (SELECT driver_name FROM dl ORDER BY failure_rate DESC, driver_id LIMIT 1) AS worst_driver,
    (SELECT round(max(failure_rate), 6) FROM dl) AS worst_driver_rate,
    (SELECT driver_name FROM dl ORDER BY failure_rate, driver_id LIMIT 1) AS best_driver,
    (SELECT round(min(failure_rate), 6) FROM dl) AS best_driver_rate,
    (SELECT round(corr(items_delivered, items_missing), 6) FROM o) AS corr FROM g"""


@query("d19_run_summary", RUN_SQL)
def _(t):
    return report.run_summary(t.orders, t.drivers).drop("pvalue")


def _read_back(row):
    """The document's fields as columns again, as a reader of the file would get them."""
    schema = row.schema
    return writers.document(row).select(F.from_json("document", schema).alias("d")).select("d.*")


@query("k3_kpi_document", GLOBAL_KPI_SQL)
def _(t):
    return _read_back(star.global_kpis(t.orders, t.customers, t.drivers))


@query("k4_run_document", RUN_SQL)
def _(t):
    return _read_back(report.run_summary(t.orders, t.drivers)).drop("pvalue")


REPORT_LISTS = """pd AS (SELECT CASE WHEN delivery_hour <= 5 THEN 'Overnight (0-5h)' WHEN delivery_hour <= 11 THEN 'Morning (6-11h)'
    WHEN delivery_hour <= 17 THEN 'Afternoon (12-17h)' ELSE 'Evening (18-23h)' END AS label, has_missing FROM o),
    rl AS (SELECT 'region' AS section, region AS label, row_number() OVER (ORDER BY avg(has_missing::INT) DESC, region) - 1 AS pos,
           avg(has_missing::INT) AS rate FROM o GROUP BY region UNION ALL
    SELECT 'month', month, row_number() OVER (ORDER BY month) - 1, avg(has_missing::INT) FROM o GROUP BY month UNION ALL
    SELECT 'day', day_of_week, day_ord - 1, avg(has_missing::INT) FROM o JOIN days USING (day_of_week) GROUP BY day_of_week, day_ord
    UNION ALL SELECT 'period', label, CASE label[1] WHEN 'O' THEN 0 WHEN 'M' THEN 1 WHEN 'A' THEN 2 ELSE 3 END,
           avg(has_missing::INT) FROM pd GROUP BY label)
    SELECT section, label, pos::INT AS pos, round_even(rate * 100, 1) AS failure_rate FROM rl"""


@query("k6_report_lists", REPORT_LISTS)
def _(t):
    document = writers.document(report.report_document(t.orders, t.customers, t.drivers))
    item = lambda name: f"array<struct<{name} string, failure_rate double>>"
    lists = {"region": "regions", "month": "monthly_trend", "day": "days_of_week", "period": "periods_of_day"}
    schema = ", ".join(f"{field} {item(name)}" for name, field in lists.items())
    parsed = document.select(F.from_json("document", schema).alias("d"))
    parts = [parsed.select(F.posexplode(f"d.{field}").alias("pos", "r")).select(
        F.lit(name).alias("section"), F.col(f"r.{name}").alias("label"), "pos", "r.failure_rate")
        for name, field in lists.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("k6_report_document")
def _(t):
    from .learning import model_results
    return writers.document(report.report_document(t.orders, t.customers, t.drivers, model_results(t)))


@query("k6_report_plan", """sp AS (SELECT round_even(g_failures * g_cost, 2) AS cost,
    (SELECT coalesce(sum(cents), 0) / 100.0 FROM c WHERE churned) AS risk FROM g),
    br AS (SELECT region FROM o GROUP BY 1 ORDER BY avg(has_missing::INT), region LIMIT 1)
    SELECT unnest([1, 2, 3, 4, 5])::INT AS priority, unnest(['30% reduction in failure cost', '-2pp in failure rate',
    'Reduction of the worst failure window', 'Alignment to ' || region || ' benchmark',
    'Recover $' || format('{:,}', CAST(round_even(round_even(risk, 2), 0) AS BIGINT)) || ' in revenue']) AS impact,
    (SELECT strftime(first_day, '%Y-%m') || '–' || strftime(last_day, '%Y-%m') FROM g) AS period FROM sp, br""")
def _(t):
    document = writers.document(report.report_document(t.orders, t.customers, t.drivers))
    schema = "meta struct<period string>, action_plan array<struct<priority int, impact string>>"
    return document.select(F.from_json("document", schema).alias("d")).select("d.meta.period", F.inline("d.action_plan"))


# ---- report measures


def _pick(t, *names):
    table = measures.fact_measures()
    return measures.measure(star.fact_orders(t.orders), {n: table[n] for n in names})


@query("e1_totals", "SELECT count(*) AS total_orders, round(sum(round(order_amount * 100)::BIGINT) / 100.0, 6) AS total_revenue, "
       "round(sum(round(order_amount * 100)::BIGINT) / 100.0 / count(*), 6) AS avg_ticket FROM f")
def _(t):
    return _pick(t, "total_orders", "total_revenue", "avg_ticket")


@query("e2_failure_rate", "SELECT round(avg(has_missing_int), 6) AS failure_rate FROM f")
def _(t):
    return _pick(t, "failure_rate")


@query("e3_failure_cost", "SELECT round(count(*) FILTER (has_missing) * max(failure_cost), 6) AS total_failure_cost FROM f")
def _(t):
    return _pick(t, "total_failure_cost")


@query("e4_rate_vs_target", "SELECT round(avg(has_missing_int) - 0.15, 6) AS failure_rate_vs_global FROM f")
def _(t):
    return _pick(t, "failure_rate_vs_global")


@query("e5_driver_measures", "SELECT count(*) FILTER (WHERE intervention_quadrant = 'Chronic — Disciplinary Action') AS "
       "high_risk_drivers, count(*) FILTER (WHERE intervention_quadrant = 'Unstable — Coaching') AS coaching_drivers FROM dd")
def _(t):
    return measures.measure(drv.driver_dimension(t.orders_without_region, t.drivers), measures.driver_measures())


@query("e6_customer_measures", "SELECT count(*) FILTER (WHERE had_failure) AS customers_with_failure, count(*) FILTER (WHERE "
       "churned) AS churned_customers, round(sum(total_revenue) FILTER (WHERE churned), 4) AS revenue_at_risk FROM dc")
def _(t):
    return measures.measure(cust.customer_dimension(t.orders_without_region, t.customers),
                            measures.customer_measures()).withColumn("revenue_at_risk", F.round("revenue_at_risk", 4))


@query("e7_projected_savings", "SELECT round(count(*) FILTER (has_missing) * max(failure_cost) * 0.30, 6) AS projected_savings FROM f")
def _(t):
    return _pick(t, "projected_savings")


@query("e8_sliced_measures", f"SELECT region, semester, count(*) AS total_orders, round(sum(round(order_amount * 100)::BIGINT) / 100.0, 6) AS total_revenue, "
       "round(avg(has_missing_int), 6) AS failure_rate, round(count(*) FILTER (has_missing) * max(failure_cost), 6) AS total_failure_cost FROM f "
       "WHERE day_of_week IN ('Monday', 'Tuesday') AND amount_tier IS NOT NULL GROUP BY 1, 2")
def _(t):
    table = measures.fact_measures()
    picked = {n: table[n] for n in ("total_orders", "total_revenue", "failure_rate", "total_failure_cost")}
    return measures.measure(star.fact_orders(t.orders), picked, ["region", "semester"],
                            F.col("day_of_week").isin("Monday", "Tuesday") & F.col("amount_tier").isNotNull())


@query("e9_day_average_of_regions", """SELECT day_of_week, round(avg(rate), 6) AS failure_rate, day_ord FROM
    (SELECT region, day_of_week, avg(has_missing::INT) AS rate FROM o GROUP BY 1, 2) JOIN days USING (day_of_week) GROUP BY 1, 3""")
def _(t):
    return measures.day_average_of_regions(kpis.region_day(t.orders))


@query("e10_failures_by_period", "SELECT period, sum(has_missing_int)::BIGINT AS failures FROM f GROUP BY 1")
def _(t):
    return measures.failures_by_period(star.fact_orders(t.orders))


@query("e11_critical_drivers", """SELECT driver_id, driver_name, exp_tier, hist_failure_rate, estimated_failure_cost,
    intervention_quadrant FROM dd WHERE intervention_quadrant IN ('Chronic — Disciplinary Action', 'Unstable — Coaching')
    ORDER BY hist_failure_rate DESC, driver_id LIMIT 15""")
def _(t):
    return measures.critical_drivers(drv.driver_dimension(t.orders_without_region, t.drivers))


@query("e12_quadrant_distribution", "SELECT intervention_quadrant, count(*) AS drivers FROM dd GROUP BY 1")
def _(t):
    return drv.quadrant_counts(drv.driver_dimension(t.orders_without_region, t.drivers), "intervention_quadrant")


@query("e12_improved_drivers", "SELECT count(*) FILTER (WHERE improved_h1_h2) AS improved, count(*) AS drivers, "
       "round(avg(coalesce(improved_h1_h2, false)::INT) * 100, 6) AS pct_improved FROM dd")
def _(t):
    return measures.improved_drivers(drv.driver_dimension(t.orders_without_region, t.drivers))


@query("e13_segment_matrix", """SELECT value_segment, count(*) FILTER (WHERE total_failures = 0) AS failures_0,
    count(*) FILTER (WHERE total_failures = 1) AS failures_1, count(*) FILTER (WHERE total_failures = 2) AS failures_2,
    count(*) FILTER (WHERE total_failures >= 3) AS failures_3_plus FROM dc GROUP BY 1""")
def _(t):
    return measures.segment_matrix(cust.customer_dimension(t.orders_without_region, t.customers))


@query("e14_churn_by_group", "SELECT failure_group, round(avg(churned::INT), 6) AS churn_rate FROM dc GROUP BY 1")
def _(t):
    return measures.churn_by_group(cust.customer_dimension(t.orders_without_region, t.customers))


@query("e15_purchase_frequency", "SELECT had_failure, round(avg(orders_per_month), 6) AS orders_per_month FROM dc GROUP BY 1")
def _(t):
    return measures.purchase_frequency(cust.customer_dimension(t.orders_without_region, t.customers))


@query("e16_half_year_points", "SELECT driver_id, rate_h1, rate_h2, improved_h1_h2 FROM dd WHERE rate_h1 IS NOT NULL")
def _(t):
    return measures.half_year_points(drv.driver_dimension(t.orders_without_region, t.drivers))


@query("e17_full_cost", """SELECT round(g_failures * g_cost, 6) AS redelivery_cost, round(r, 6) AS lost_revenue,
    round(g_failures * g_cost + r, 6) AS total_cost FROM g, (SELECT coalesce(sum(cents), 0) / 100.0 AS r FROM c WHERE churned)""")
def _(t):
    return finance.full_cost(t.orders_without_region, cust.customer_profile(t.orders_without_region))
