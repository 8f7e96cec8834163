"""Registry of named queries and of the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DecimalType, DoubleType

from ..sources.lens import Deliveries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The delivery tables over the supplied ones, in SQL.
LENS = """
ld AS (SELECT l_orderkey, arg_min(l_suppkey, {'line': l_linenumber, 'supplier': l_suppkey}) AS driver_id
       FROM lineitem GROUP BY l_orderkey),
lm AS (SELECT l.*, ld.driver_id,
              l_returnflag = 'R' AND CAST(round(l_discount * 100) AS INT) >=
                CASE ld.driver_id % 5 WHEN 0 THEN 6 WHEN 1 THEN 9 ELSE 10 END AS miss
       FROM lineitem l JOIN ld USING (l_orderkey)),
lo AS (SELECT l_orderkey, min(driver_id) AS driver_id, count(*) AS n, count(*) FILTER (WHERE miss) AS miss
       FROM lm GROUP BY l_orderkey),
o AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS date,
             CAST(floor(o_totalprice / 10) AS BIGINT) AS amount_cents,
             CAST(floor(o_totalprice / 10) AS BIGINT) / 100.0 AS order_amount, r_name AS region,
             CAST((o_orderkey * 7 + o_custkey) % 24 AS INT) AS delivery_hour, lo.driver_id,
             CAST(coalesce(lo.miss, 0) AS INT) AS items_missing,
             CAST(coalesce(lo.n, 0) - coalesce(lo.miss, 0) AS INT) AS items_delivered,
             coalesce(lo.miss, 0) > 0 AS has_missing, dayname(o_orderdate) AS day_of_week,
             strftime(o_orderdate, '%Y-%m') AS month
      FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
           JOIN region ON r_regionkey = n_regionkey LEFT JOIN lo ON lo.l_orderkey = o_orderkey),
cu AS (SELECT c_custkey AS customer_id, c_name AS customer_name,
              CAST(18 + (c_custkey * 7) % 73 AS INT) AS customer_age FROM customer),
dr AS (SELECT s_suppkey AS driver_id, s_name AS driver_name, CAST(18 + (s_suppkey * 11) % 50 AS INT) AS age,
              CAST(1 + (s_suppkey * 7) % 100 AS INT) AS trips FROM supplier),
pr AS (SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_retailprice AS price FROM part),
it AS (SELECT l_orderkey AS order_id, l_partkey AS product_id FROM lineitem),
mp AS (SELECT l_orderkey AS order_id, l_partkey AS product_id, row_number() OVER (PARTITION BY l_orderkey
              ORDER BY l_linenumber, l_suppkey, l_partkey) AS position FROM lm WHERE miss),
m AS (SELECT o.*, customer_name, customer_age, driver_name, age, trips
      FROM o LEFT JOIN cu USING (customer_id) LEFT JOIN dr USING (driver_id)),
g AS (SELECT count(*) AS g_orders, sum(amount_cents) AS g_cents, count(*) FILTER (WHERE has_missing) AS g_failures,
             avg(has_missing::INT) AS g_rate, sum(amount_cents) / 100.0 / count(*) AS g_ticket,
             sum(amount_cents) / 100.0 / count(*) * 0.25 AS g_cost, min(date) AS first_day, max(date) AS last_day FROM o),
days AS (SELECT unnest(range(1, 8))::INT AS day_ord,
                unnest(['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday']) AS day_of_week),
ca AS (SELECT customer_id, count(*) AS total_orders, count(*) FILTER (WHERE has_missing) AS total_failures,
              sum(amount_cents)::BIGINT AS cents, count(DISTINCT month) AS months_active, min(date) AS first_order,
              max(date) AS last_order, min(date) FILTER (WHERE has_missing) AS first_failure,
              max(date) FILTER (WHERE has_missing) AS last_failure FROM o WHERE customer_id IS NOT NULL GROUP BY 1),
c AS (SELECT ca.*, cents / 100.0 AS total_revenue, cents / 100.0 / total_orders AS avg_ticket,
             total_failures::DOUBLE / total_orders AS failure_rate,
             total_orders::DOUBLE / months_active AS orders_per_month, total_failures > 0 AS had_failure,
             coalesce(last_day - last_failure >= 90 AND last_order <= last_failure, false) AS churned,
             customer_id IN (SELECT o.customer_id FROM o JOIN ca f USING (customer_id) WHERE o.date > f.first_failure)
               AS returned_after_failure FROM ca, g),
cq AS (SELECT quantile_cont(cents, 0.25) AS q25, quantile_cont(cents, 0.5) AS q50,
              quantile_cont(cents, 0.75) AS q75 FROM c),
dc AS (SELECT customer_id, customer_name, customer_age, total_orders, total_failures,
              round_even(total_revenue, 4) AS total_revenue, round_even(avg_ticket, 4) AS avg_ticket, months_active,
              first_order, last_order, round_even(failure_rate, 4) AS failure_rate,
              round_even(orders_per_month, 4) AS orders_per_month, had_failure,
              CASE WHEN customer_age > 18 AND customer_age <= 30 THEN '18–29' WHEN customer_age > 30 AND customer_age <= 45
                   THEN '30–44' WHEN customer_age > 45 AND customer_age <= 60 THEN '45–59'
                   WHEN customer_age > 60 AND customer_age <= 100 THEN '60+' END AS age_group,
              CASE total_failures WHEN 0 THEN '0 — No failure' WHEN 1 THEN '1 — One failure'
                   WHEN 2 THEN '2 — Two failures' ELSE '3+ — Multiple failures' END AS failure_group,
              CASE WHEN cents >= q75 THEN 'VIP' WHEN cents >= q50 THEN 'High Value'
                   WHEN cents >= q25 THEN 'Medium Value' ELSE 'Low Value' END AS value_segment,
              churned, returned_after_failure FROM c JOIN cu USING (customer_id), cq),
dt AS (SELECT driver_id, driver_name, age, trips, count(*) AS deliveries, count(*) FILTER (WHERE has_missing) AS failures,
              avg(has_missing::INT) AS failure_rate, avg(items_delivered) AS avg_items,
              sum(amount_cents) / 100.0 AS total_revenue, sum(amount_cents) / 100.0 / count(*) AS avg_ticket
       FROM m WHERE driver_id IS NOT NULL GROUP BY ALL),
dm AS (SELECT driver_id, driver_name, month, count(*) AS deliveries, count(*) FILTER (WHERE has_missing) AS failures,
              avg(has_missing::INT) AS rate, sum(amount_cents) / 100.0 AS revenue
       FROM m WHERE driver_id IS NOT NULL GROUP BY ALL),
h AS (SELECT a.driver_id, del_h1, rate_h1, del_h2, rate_h2, rate_h2 - rate_h1 AS delta_h1_h2,
             rate_h2 < rate_h1 AS improved_h1_h2
      FROM (SELECT driver_id, count(*) AS del_h1, avg(has_missing::INT) AS rate_h1 FROM o
            WHERE month(date) <= 6 AND driver_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 5) a
      JOIN (SELECT driver_id, count(*) AS del_h2, avg(has_missing::INT) AS rate_h2 FROM o
            WHERE month(date) > 6 AND driver_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 5) b USING (driver_id)),
ce AS (SELECT driver_id, count(*) AS months_active, round(avg(rate), 9) AS avg_rate,
              round(stddev_samp(rate), 9) AS std_rate,
              round_even(round(coalesce(stddev_samp(rate) / nullif(avg(rate), 0), 0), 9), 3) AS consistency_cv
       FROM dm GROUP BY 1),
cc AS (SELECT driver_id, count(*) AS months_active, round(avg(rate), 9) AS avg_rate,
              round(stddev_samp(rate), 9) AS std_rate,
              round(coalesce(stddev_samp(rate) / nullif(avg(rate), 0), 0), 9) AS cv
       FROM dm WHERE deliveries >= 3 GROUP BY 1 HAVING count(*) >= 3),
dx AS (SELECT dt.*, ce.months_active, ce.consistency_cv, rate_h1, rate_h2, delta_h1_h2, improved_h1_h2
       FROM dt JOIN ce USING (driver_id) LEFT JOIN h USING (driver_id)),
dq AS (SELECT median(failure_rate) AS rate_med, median(consistency_cv) AS cv_med FROM dx WHERE deliveries >= 5),
dd AS (SELECT driver_id, driver_name, deliveries AS total_deliveries, failures AS total_failures,
              round_even(failure_rate, 4) AS hist_failure_rate, round_even(total_revenue, 4) AS total_revenue,
              round_even(avg_ticket, 4) AS avg_ticket, trips, age AS driver_age,
              CASE WHEN trips > 0 AND trips <= 25 THEN 'Rookie (≤25 trips)' WHEN trips > 25 AND trips <= 50
                   THEN 'Intermediate (26–50 trips)' WHEN trips > 50 AND trips <= 100 THEN 'Experienced (51+ trips)'
                   END AS exp_tier,
              round_even(rate_h1, 4) AS rate_h1, round_even(rate_h2, 4) AS rate_h2,
              round_even(delta_h1_h2, 4) AS delta_h1_h2, improved_h1_h2, consistency_cv, months_active,
              CASE WHEN deliveries < 5 THEN 'Insufficient Volume (<5)'
                   WHEN failure_rate > rate_med AND consistency_cv <= cv_med THEN 'Chronic — Disciplinary Action'
                   WHEN failure_rate > rate_med THEN 'Unstable — Coaching'
                   WHEN consistency_cv <= cv_med THEN 'Reference — Best Practices'
                   ELSE 'Monitor — Low Risk' END AS intervention_quadrant,
              round_even(failures * g_cost, 4) AS estimated_failure_cost, failure_rate > 0.20 AS risk_flag
       FROM dx, dq, g),
f AS (SELECT order_id, CAST(strftime(date, '%Y%m%d') AS INT) AS date_key, date, driver_id, customer_id, region,
             order_amount, items_delivered, items_missing, delivery_hour, has_missing,
             has_missing::INT AS has_missing_int, has_missing::INT * g_cost AS failure_cost, day_of_week, month,
             week(date)::INT AS week_number, quarter(date)::INT AS quarter,
             CASE WHEN month(date) <= 6 THEN 'H1' ELSE 'H2' END AS semester,
             CASE WHEN delivery_hour <= 5 THEN 'Overnight (0–5h)' WHEN delivery_hour <= 11 THEN 'Morning (6–11h)'
                  WHEN delivery_hour <= 17 THEN 'Afternoon (12–17h)' ELSE 'Evening (18–23h)' END AS period,
             CASE WHEN items_delivered <= 0 OR items_delivered > 100 THEN NULL WHEN items_delivered <= 5 THEN 'Small (1–5)'
                  WHEN items_delivered <= 10 THEN 'Medium (6–10)' WHEN items_delivered <= 20 THEN 'Large (11–20)'
                  ELSE 'Extra (21+)' END AS order_size_tier,
             CASE WHEN order_amount <= 0 OR order_amount > 10000 THEN NULL WHEN order_amount <= 100 THEN '< $100'
                  WHEN order_amount <= 250 THEN '$100–$250' WHEN order_amount <= 400 THEN '$250–$400'
                  ELSE '> $400' END AS amount_tier FROM o, g)
"""


def six_decimals(column):
    """Rounds half away from zero by scaling, without a decimal object per value.

    From 2^43 on a double has less than three binary places, and rounding changes nothing; floor() of the
    scaled value would not fit a bigint there. NaN and infinity stay as they are.
    """
    scaled = F.signum(column) * F.floor(F.abs(column) * 1e6 + 0.5) / 1e6
    return F.when(F.abs(column) < float(1 << 43), scaled).otherwise(column)


def presentable(df: DataFrame) -> DataFrame:
    """Doubles with six decimals, decimals as doubles, bytes as ints."""
    out = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (DoubleType, DecimalType)):
            column = six_decimals(column.cast("double")).alias(field.name)
        elif isinstance(field.dataType, ByteType):
            column = column.cast("int").alias(field.name)
        out.append(column)
    return df.select(*out)


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Registers a function of the delivery tables, with the SQL that must agree with it.

    `sql` is a SELECT, or further named tables followed by one, over the tables of LENS; `recursive` where
    one of them is built from itself.
    """
    def register(build: Callable[[Deliveries], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: presentable(build(Deliveries(spark, folder)))
        if sql is not None:
            body = sql.strip()
            joint = "" if body.upper().startswith("SELECT") else ","
            ORACLE[name] = f"WITH {'RECURSIVE ' * recursive}{LENS.strip()}{joint} {body}"
        return build
    return register
