"""Sources, sinks, profiling, cleaning and bands."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bands, calendar, cleaning
from ..operators import customers as cust
from ..operators import distribution, drivers, finance, joins, kpis, quality, ranking, reshape, stats
from ..plans import star
from ..session import fresh_path
from ..sources import readers, writers
from .base import query

# ---- sources and sinks

CLEAN_SQL = """SELECT order_id::VARCHAR AS order_id, date, round(order_amount, 6) AS order_amount, amount_cents, region,
    items_delivered, items_missing, delivery_hour, driver_id::VARCHAR AS driver_id, customer_id::VARCHAR AS customer_id,
    day_of_week, month, has_missing FROM o"""


def _written_csv(t, *names):
    folder = fresh_path(t.spark, "raw")
    for name in names:
        writers.write_csv(t.raw[name], f"{folder}/{name}.csv")
    return folder


@query("s1_csv_scan", CLEAN_SQL)
def _(t):
    folder = _written_csv(t, "orders")
    raw = readers.read_csv(t.spark, f"{folder}/orders.csv", readers.schemas.ORDERS)
    return cleaning.clean_orders(raw)


@query("s2_load_all_tables", """SELECT * FROM (
    SELECT 'orders' AS table_name, count(*) AS row_count FROM o UNION ALL
    SELECT 'customers', count(*) FROM cu UNION ALL SELECT 'products', count(*) FROM pr UNION ALL
    SELECT 'drivers', count(*) FROM dr UNION ALL SELECT 'order_items', count(*) FROM it)""")
def _(t):
    folder = _written_csv(t, "orders", "customers", "products", "drivers", "order_items")
    out = None
    for name, df in readers.load_clean(t.spark, folder).items():
        one = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        out = one if out is None else out.unionByName(one)
    return out


def _digest_sql(table: str, source: str, columns: str, doubles: str = "") -> str:
    """The digest of `quality.content_digest` over a table."""
    text = lambda c: f"floor({c} * 10000 + 0.5)::BIGINT::VARCHAR" if c in doubles.split() else f"{c}::VARCHAR"
    parts = " || '|' || ".join(f"coalesce({text(c)}, 'null')" for c in sorted([*columns.split(), *doubles.split()]))
    return (f"SELECT '{table}' AS table_name, count(*) AS row_count, sum(('0x' || substr(md5({parts}), 1, 13))::BIGINT)::VARCHAR "
            f"AS digest FROM {source}")


def _digests(tables):
    """One row per table: name, rows and digest of the named columns."""
    out = None
    for name, (df, columns) in tables.items():
        one = quality.content_digest(df, columns.split()).withColumn("table_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


# Columns of each table for its digest: plain ones, and doubles.
_ORDER_COLUMNS = "order_id customer_id driver_id date amount_cents region items_delivered items_missing delivery_hour has_missing day_of_week month"
_LOADED = {"orders": ("o", _ORDER_COLUMNS, "order_amount"), "customers": ("cu", "customer_id customer_name customer_age", ""),
           "products": ("pr", "product_id product_name category", "price"), "drivers": ("dr", "driver_id driver_name age trips", ""),
           "order_items": ("it", "order_id product_id", "")}
_STORED = {"master": ("m", _ORDER_COLUMNS + " customer_name customer_age driver_name age trips", "order_amount"),
           "products": _LOADED["products"], "order_items": _LOADED["order_items"]}
_EXPORTED = {
    "fct_orders": ("f", "order_id date_key date driver_id customer_id region items_delivered items_missing delivery_hour has_missing "
                        "has_missing_int day_of_week month week_number quarter semester period order_size_tier amount_tier",
                   "order_amount failure_cost"),
    "dim_drivers": ("dd", "driver_id driver_name total_deliveries total_failures trips driver_age exp_tier improved_h1_h2 months_active "
                          "intervention_quadrant risk_flag",
                    "hist_failure_rate total_revenue avg_ticket rate_h1 rate_h2 delta_h1_h2 consistency_cv estimated_failure_cost"),
    "dim_customers": ("dc", "customer_id customer_name customer_age total_orders total_failures months_active first_order last_order "
                            "had_failure age_group failure_group value_segment churned returned_after_failure",
                      "total_revenue avg_ticket failure_rate orders_per_month")}


def _digest_union(tables) -> str:
    return "SELECT * FROM (" + " UNION ALL ".join(_digest_sql(name, *parts) for name, parts in tables.items()) + ")"


@query("s2_loaded_contents", _digest_union(_LOADED))
def _(t):
    loaded = readers.load_clean(t.spark, _written_csv(t, *_LOADED))
    return _digests({name: (loaded[name], f"{plain} {doubles}") for name, (_, plain, doubles) in _LOADED.items()})


@query("s3_parquet_scan", "SELECT region, count(*) AS orders, sum(amount_cents)::BIGINT AS cents FROM o GROUP BY 1")
def _(t):
    path = fresh_path(t.spark, "scan")
    writers.write_parquet(t.orders, path)
    return readers.read_parquet(t.spark, path).groupBy("region").agg(
        F.count("order_id").alias("orders"), F.sum("amount_cents").alias("cents"))


@query("s4_cached_or_built", "SELECT count(*) AS orders, count(driver_name) AS with_driver, "
       "round(sum(amount_cents) / 100.0, 6) AS revenue FROM m")
def _(t):
    path = fresh_path(t.spark, "master")
    build = lambda: joins.build_master(t.orders, t.customers, t.drivers)
    writers.write_parquet(readers.cached_or_built(t.spark, path, build), path)
    return readers.cached_or_built(t.spark, path, build).agg(
        F.count("order_id").alias("orders"), F.count("driver_name").alias("with_driver"),
        (F.sum("amount_cents") / 100.0).alias("revenue"))


@query("s5_document_scan", "SELECT g_orders AS total_orders, round(round_even(g_cents / 100.0, 2), 6) AS total_revenue FROM g")
def _(t):
    path = fresh_path(t.spark, "document")
    writers.write_document(star.global_kpis(t.orders, t.customers, t.drivers), path)
    return readers.read_document(t.spark, path, "total_orders bigint, total_revenue double")


CALENDAR_SQL = """SELECT date, CAST(strftime(date, '%Y%m%d') AS INT) AS date_key, dayname(date) AS day_of_week,
    isodow(date)::INT AS day_number, week(date)::INT AS week_number, month(date)::INT AS month_number,
    monthname(date) AS month_name, strftime(date, '%b') AS month_short, quarter(date)::INT AS quarter,
    CASE WHEN month(date) <= 6 THEN 'H1' ELSE 'H2' END AS semester, year(date)::INT AS year,
    isodow(date) IN (6, 7) AS is_weekend, strftime(date, '%Y-%m') AS month_year
    FROM (SELECT unnest(generate_series(first_day::TIMESTAMP, last_day::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM g)"""


@query("s6_calendar", "SELECT unnest(generate_series(first_day::TIMESTAMP, last_day::TIMESTAMP, INTERVAL 1 DAY))::DATE "
       "AS date FROM g")
def _(t):
    return calendar.days_spine(quality.date_span(t.orders))


@query("s7_numbered_calendar", "SELECT number::INT AS number, (first_day + number::INT)::DATE AS full_date FROM "
       "(SELECT first_day, unnest(range(0, (last_day - first_day) + 1)) AS number FROM g)")
def _(t):
    return calendar.numbered_days(quality.date_span(t.orders))


@query("k1_parquet_sink", "SELECT * FROM (SELECT 'master' AS table_name, count(*) AS row_count FROM m UNION ALL "
       "SELECT 'products', count(*) FROM pr UNION ALL SELECT 'order_items', count(*) FROM it)")
def _(t):
    folder = fresh_path(t.spark, "processed")
    counts = writers.write_processed(joins.build_master(t.orders, t.customers, t.drivers), t.products, t.order_items, folder)
    return writers.manifest(t.spark, folder, counts).drop("bytes", "description")


@query("k1_stored_contents", _digest_union(_STORED))
def _(t):
    folder = fresh_path(t.spark, "processed")
    writers.write_processed(joins.build_master(t.orders, t.customers, t.drivers), t.products, t.order_items, folder)
    return _digests({name: (readers.read_parquet(t.spark, f"{folder}/{name}"), f"{plain} {doubles}")
                     for name, (_, plain, doubles) in _STORED.items()})


@query("k2_exported_contents", _digest_union(_EXPORTED))
def _(t):
    folder = fresh_path(t.spark, "star")
    tables = {name: df for name, df in star.star_tables(t).items() if name in _EXPORTED}
    writers.write_star_csv(tables, folder)
    return _digests({name: (readers.read_csv(t.spark, f"{folder}/{name}", tables[name].schema), f"{plain} {doubles}")
                     for name, (_, plain, doubles) in _EXPORTED.items()})


STAR_ROWS = """SELECT * FROM (SELECT 'fct_orders' AS table_name, count(*) AS row_count FROM o UNION ALL
    SELECT 'dim_date', (last_day - first_day) + 1 FROM g UNION ALL SELECT 'dim_drivers', count(*) FROM dd UNION ALL
    SELECT 'dim_customers', count(*) FROM dc UNION ALL SELECT 'dim_regions', count(DISTINCT region) FROM o UNION ALL
    SELECT 'dim_products', count(*) FROM pr UNION ALL SELECT 'agg_monthly_kpis', count(DISTINCT month) FROM o UNION ALL
    SELECT 'agg_hour_day_heatmap', count(DISTINCT (day_of_week, delivery_hour)) FROM o UNION ALL
    SELECT 'agg_region_day', count(DISTINCT (region, day_of_week)) FROM o UNION ALL
    SELECT 'agg_driver_monthly', count(*) FROM dm UNION ALL
    SELECT 'agg_financial_impact', count(DISTINCT intervention_quadrant) FROM dd UNION ALL
    SELECT 'agg_top_products', count(DISTINCT product_id) FROM it UNION ALL SELECT 'agg_retention_summary', 8)"""


@query("k2_star_csv_sink", STAR_ROWS)
def _(t):
    folder = fresh_path(t.spark, "star")
    counts = writers.write_star_csv(star.star_tables(t), folder)
    return writers.manifest(t.spark, folder, counts).drop("bytes", "description")


def _star_files(t):
    """All fourteen files: the thirteen tables and the document of global figures."""
    folder = fresh_path(t.spark, "star")
    counts = writers.write_star_csv(star.star_tables(t), folder)
    counts["global_kpis"] = writers.write_counted(
        star.global_kpis(t.orders, t.customers, t.drivers), f"{folder}/global_kpis", writers.write_document)
    return writers.manifest(t.spark, folder, counts)


@query("k7_file_manifest")
def _(t):
    return _star_files(t)


@query("k7_file_manifest_checks", STAR_ROWS.replace("SELECT * FROM (", "SELECT table_name, row_count, true AS has_bytes, "
       "true AS described FROM (").removesuffix(")") + " UNION ALL SELECT 'global_kpis', 1)")
def _(t):
    return _star_files(t).select("table_name", "row_count", (F.col("bytes") > 0).alias("has_bytes"),
                                 (F.length("description") > 0).alias("described"))


# ---- profiling

@query("p1_table_profile", """SELECT * FROM (
    SELECT 'customers' AS table_name, unnest(['customer_id', 'customer_name', 'customer_age']) AS column_name,
           unnest(['bigint', 'string', 'int']) AS data_type, (SELECT count(*) FROM cu) AS row_count, 3 AS column_count
    UNION ALL SELECT 'drivers', unnest(['driver_id', 'driver_name', 'age', 'trips']),
           unnest(['bigint', 'string', 'int', 'int']), (SELECT count(*) FROM dr), 4
    UNION ALL SELECT 'order_items', unnest(['order_id', 'product_id']), unnest(['bigint', 'bigint']),
           (SELECT count(*) FROM it), 2
    UNION ALL SELECT 'products', unnest(['product_id', 'product_name', 'category', 'price']),
           unnest(['bigint', 'string', 'string', 'double']), (SELECT count(*) FROM pr), 4
    UNION ALL SELECT 'orders', unnest(['order_id', 'customer_id', 'date', 'amount_cents', 'order_amount', 'delivery_hour',
           'driver_id', 'items_missing', 'items_delivered', 'region', 'day_of_week', 'month', 'has_missing']),
           unnest(['bigint', 'bigint', 'date', 'bigint', 'double', 'int', 'bigint', 'int', 'int', 'string', 'string', 'string',
           'boolean']), (SELECT count(*) FROM o), 13)""")
def _(t):
    return quality.table_profile(_tables(t))


def _tables(t):
    return {"customers": t.customers, "drivers": t.drivers, "order_items": t.order_items, "products": t.products,
            "orders": t.orders}


def _per_table(t, summary):
    """One summary per table, with the table's name."""
    out = None
    for name, df in _tables(t).items():
        one = summary(df).withColumn("table_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("p2_null_counts_by_table", """SELECT * FROM (
    SELECT 'orders' AS table_name, 'driver_id' AS column_name, count(*) - count(driver_id) AS nulls FROM o UNION ALL
    SELECT 'products', 'product_name', count(*) - count(product_name) FROM pr UNION ALL
    SELECT 'products', 'category', count(*) - count(category) FROM pr UNION ALL
    SELECT 'products', 'price', count(*) - count(price) FROM pr UNION ALL
    SELECT 'customers', 'customer_name', count(*) - count(customer_name) FROM cu UNION ALL
    SELECT 'drivers', 'driver_name', count(*) - count(driver_name) FROM dr) WHERE nulls > 0""")
def _(t):
    return _per_table(t, quality.null_counts)


@query("p3_duplicate_rows_by_table", """SELECT * FROM (
    SELECT 'orders' AS table_name, count(*) AS row_count, count(DISTINCT order_id) AS distinct_rows, count(*) - count(DISTINCT order_id)
           AS duplicates FROM o UNION ALL
    SELECT 'customers', count(*), count(DISTINCT customer_id), count(*) - count(DISTINCT customer_id) FROM cu UNION ALL
    SELECT 'drivers', count(*), count(DISTINCT driver_id), count(*) - count(DISTINCT driver_id) FROM dr UNION ALL
    SELECT 'products', count(*), count(DISTINCT product_id), count(*) - count(DISTINCT product_id) FROM pr UNION ALL
    SELECT 'order_items', sum(n)::BIGINT, count(*), sum(n - 1)::BIGINT
    FROM (SELECT count(*) AS n FROM it GROUP BY order_id, product_id))""")
def _(t):
    return _per_table(t, quality.duplicate_rows)


@query("p2_null_counts", "SELECT * FROM (SELECT 'driver_id' AS column_name, count(*) - count(driver_id) AS nulls FROM m "
       "UNION ALL SELECT 'driver_name', count(*) - count(driver_name) FROM m UNION ALL "
       "SELECT 'age', count(*) - count(age) FROM m UNION ALL SELECT 'trips', count(*) - count(trips) FROM m) "
       "WHERE nulls > 0")
def _(t):
    return quality.null_counts(joins.build_master(t.orders, t.customers, t.drivers))


@query("p3_duplicate_rows", "SELECT sum(n)::BIGINT AS row_count, count(*) AS distinct_rows, sum(n - 1)::BIGINT AS duplicates "
       "FROM (SELECT count(*) AS n FROM it GROUP BY order_id, product_id)")
def _(t):
    return quality.duplicate_rows(t.order_items)


@query("p4_sample_rows", "SELECT * FROM cu ORDER BY customer_id LIMIT 5")
def _(t):
    return quality.sample_rows(t.customers, ["customer_id"], 5)


@query("p4_sample_orders", "SELECT order_id, date, round(order_amount, 6) AS order_amount, region, driver_id, customer_id "
       "FROM o ORDER BY order_id LIMIT 5")
def _(t):
    return quality.sample_rows(t.orders, ["order_id"], 5).select(
        "order_id", "date", "order_amount", "region", "driver_id", "customer_id")


@query("p4_sample_products", "SELECT * FROM (SELECT product_id, product_name, category, round(price, 6) AS price FROM pr) "
       "ORDER BY product_id LIMIT 5")
def _(t):
    return quality.sample_rows(t.products, ["product_id"], 5)


@query("p4_sample_drivers", "SELECT * FROM dr ORDER BY driver_id LIMIT 5")
def _(t):
    return quality.sample_rows(t.drivers, ["driver_id"], 5)


@query("p4_sample_order_items", "SELECT * FROM it ORDER BY order_id, product_id LIMIT 5")
def _(t):
    return quality.sample_rows(t.order_items, ["order_id", "product_id"], 5)


@query("p5_date_range", "SELECT first_day, last_day FROM g")
def _(t):
    return quality.date_span(t.orders)


@query("p6_describe", """SELECT count(*) AS count, round(avg(order_amount), 6) AS mean,
    round(stddev_samp(order_amount), 6) AS std, round(min(order_amount), 6) AS min,
    round(quantile_cont(order_amount, 0.25), 6) AS q25, round(quantile_cont(order_amount, 0.5), 6) AS q50,
    round(quantile_cont(order_amount, 0.75), 6) AS q75, round(max(order_amount), 6) AS max FROM o""")
def _(t):
    return distribution.describe(t.orders, "order_amount")


@query("p7_validation_totals", "SELECT g_orders AS total_orders, round(g_cents / 100.0, 6) AS total_revenue, "
       "round(g_rate, 6) AS missing_rate FROM g")
def _(t):
    return quality.validation_totals(t.orders)


@query("p8_key_checks", """SELECT * FROM (
    SELECT 'orders.order_id unique' AS "check",
           (SELECT count(*) FROM (SELECT 1 FROM o GROUP BY order_id HAVING count(*) > 1)) AS violations
    UNION ALL SELECT 'order_items.order_id+product_id unique',
           (SELECT count(*) FROM (SELECT 1 FROM it GROUP BY order_id, product_id HAVING count(*) > 1))
    UNION ALL SELECT 'orders.customer_id in customers',
           (SELECT count(DISTINCT customer_id) FROM o WHERE customer_id NOT IN (SELECT customer_id FROM cu))
    UNION ALL SELECT 'orders.driver_id in drivers',
           (SELECT count(DISTINCT driver_id) FROM o WHERE driver_id NOT IN (SELECT driver_id FROM dr))
    UNION ALL SELECT 'order_items.product_id in products',
           (SELECT count(DISTINCT product_id) FROM it WHERE product_id NOT IN (SELECT product_id FROM pr)))""")
def _(t):
    tables = {"orders": t.orders, "customers": t.customers, "drivers": t.drivers, "products": t.products,
              "order_items": t.order_items}
    return quality.quality_report(
        tables, {"orders": ["order_id"], "order_items": ["order_id", "product_id"]},
        [("orders", "customers", "customer_id"), ("orders", "drivers", "driver_id"),
         ("order_items", "products", "product_id")])


# ---- cleaning and scalar columns

@query("c1_money_parse", "SELECT order_id, amount_cents, round(order_amount, 6) AS order_amount FROM o")
def _(t):
    cents = cleaning.money_cents(F.col("order_amount"))
    return t.raw_orders.select("order_id", cents.alias("amount_cents"), (cents / 100.0).alias("order_amount"))


@query("c2_money_decimal", "SELECT product_id, round(price, 2) AS unit_price FROM pr")
def _(t):
    return t.raw_products.select(F.col("produc_id").alias("product_id"),
                                 cleaning.money_decimal(F.col("price"), 8, strip="$").alias("unit_price"))


@query("c3_hour", "SELECT order_id, delivery_hour FROM o")
def _(t):
    return t.raw_orders.select("order_id", cleaning.hour_of(F.col("delivery_hour")).alias("delivery_hour"))


@query("c4_date", "SELECT order_id, date FROM o")
def _(t):
    return t.raw_orders.select("order_id", cleaning.date_of(F.col("date")).alias("date"))


@query("c5_day_name", "SELECT order_id, day_of_week FROM o")
def _(t):
    return t.orders.select("order_id", cleaning.day_name(F.col("date")).alias("day_of_week"))


@query("c6_year_month", "SELECT order_id, month FROM o")
def _(t):
    return t.orders.select("order_id", cleaning.year_month(F.col("date")).alias("month"))


@query("c7_failure_flag", "SELECT order_id, has_missing FROM o")
def _(t):
    return t.orders.select("order_id", cleaning.failed(F.col("items_missing")).alias("has_missing"))


@query("c8_column_rename", "SELECT * FROM (SELECT 'product' AS kind, product_id AS id, round(price, 6) AS amount FROM pr "
       "UNION ALL SELECT 'driver', driver_id, trips FROM dr)")
def _(t):
    products = cleaning.clean_products(t.raw_products).select(
        F.lit("product").alias("kind"), F.col("product_id").alias("id"), F.col("price").alias("amount"))
    crew = cleaning.clean_drivers(t.raw_drivers).select(
        F.lit("driver").alias("kind"), F.col("driver_id").alias("id"), F.col("trips").cast("double").alias("amount"))
    return products.unionByName(crew)


@query("c9_date_key", "SELECT order_id, CAST(strftime(date, '%Y%m%d') AS INT) AS date_key FROM o")
def _(t):
    return t.orders.select("order_id", cleaning.date_key(F.col("date")).alias("date_key"))


@query("c10_calendar_attributes", CALENDAR_SQL)
def _(t):
    return star.dim_date(t.orders)


CALENDAR_US_SQL = """SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_key, d AS full_date, year(d)::INT AS year,
    quarter(d)::INT AS quarter, 'Q' || quarter(d) || ' ' || year(d) AS quarter_label, month(d)::INT AS month_num,
    monthname(d) AS month_name, strftime(d, '%b') || ' ' || year(d) AS month_label,
    strftime(d, '%U')::INT + CASE WHEN dayofweek(date_trunc('year', d)) = 0 THEN 0 ELSE 1 END AS week_of_year,
    day(d)::INT AS day_of_month, dayofweek(d)::INT + 1 AS day_of_week, dayname(d) AS day_name,
    CASE WHEN dayofweek(d) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend
    FROM (SELECT unnest(generate_series(first_day::TIMESTAMP, last_day::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM g)"""
@query("c11_calendar_us", CALENDAR_US_SQL)
def _(t):
    return star.dim_date_us(t.orders)


@query("c12_semester", "SELECT order_id, semester FROM f")
def _(t):
    return t.orders.select("order_id", calendar.semester(F.col("date")).alias("semester"))


@query("c13_week_quarter", "SELECT order_id, week_number, quarter FROM f")
def _(t):
    return t.orders.select("order_id", F.weekofyear("date").alias("week_number"), F.quarter("date").alias("quarter"))


@query("c14_weekend_monday", "SELECT order_id, (isodow(date) >= 6)::INT AS is_weekend, (isodow(date) = 1)::INT AS is_monday FROM o")
def _(t):
    return t.orders.select("order_id", cleaning.weekend_flag(F.col("day_of_week")).alias("is_weekend"),
                           cleaning.monday_flag(F.col("day_of_week")).alias("is_monday"))


@query("c15_failure_cost", "SELECT order_id, round(failure_cost, 6) AS failure_cost FROM f")
def _(t):
    return finance.order_costs(t.orders).select("order_id", "failure_cost")


@query("c16_days_between", "SELECT customer_id, (last_day - last_failure)::INT AS days_since_last_failure, "
       "(last_order - last_failure)::INT AS days_after_failure FROM ca, g WHERE last_failure IS NOT NULL")
def _(t):
    rows = cust.customer_profile(t.orders_without_region).where("last_failure IS NOT NULL").withColumn(
        "data_end", cust.last_day(t.orders_without_region))
    return rows.select(
        "customer_id", cleaning.days_between(F.col("data_end"), F.col("last_failure")).alias("days_since_last_failure"),
        cleaning.days_between(F.col("last_order"), F.col("last_failure")).alias("days_after_failure"))


@query("c17_upper_clip", "SELECT customer_id, least(total_failures, 5) AS capped, "
       "CASE WHEN total_failures >= 5 THEN '5+' ELSE total_failures::VARCHAR END AS label FROM ca")
def _(t):
    n = F.col("total_failures")
    return cust.customer_profile(t.orders_without_region).select(
        "customer_id", cleaning.capped(n, 5).cast("bigint").alias("capped"), cleaning.capped_label(n, 5).alias("label"))


@query("c18_neg_log10", "SELECT driver_id, round(-log10(greatest(failure_rate, 1e-10)), 6) AS strength FROM dt")
def _(t):
    return drivers.driver_totals(t.orders_without_region).select(
        "driver_id", cleaning.neg_log10(F.col("failure_rate")).alias("strength"))


@query("c19_formatting", """SELECT region, format('${:,}', CAST(round(sum(amount_cents) / 100.0) AS BIGINT)) AS revenue,
    printf('%.1f%%', avg(has_missing::INT) * 100) AS rate FROM o GROUP BY 1""")
def _(t):
    return kpis.region_summary(t.orders).select(
        "region", cleaning.currency(F.col("total_revenue")).alias("revenue"),
        cleaning.percent(F.col("missing_rate")).alias("rate"))


@query("c20_label_codes", "SELECT order_id, region, CAST(code AS INT) AS region_enc FROM o JOIN "
       "(SELECT region, row_number() OVER (ORDER BY region) - 1 AS code FROM (SELECT DISTINCT region FROM o)) USING (region)")
def _(t):
    from ..operators.features import label_codes
    return label_codes(t.orders.select("order_id", "region"), "region", "region_enc").select(
        "order_id", "region", "region_enc")


@query("c21_filters", "SELECT order_id, region, delivery_hour FROM o WHERE has_missing AND month(date) <= 6 "
       "AND region IN ('ASIA', 'EUROPE')")
def _(t):
    return t.orders.where(F.col("has_missing") & (calendar.semester(F.col("date")) == "H1")
                          & F.col("region").isin("ASIA", "EUROPE")).select("order_id", "region", "delivery_hour")


@query("c22_column_pruning", "SELECT order_id, driver_name, trips FROM m")
def _(t):
    return joins.build_master(t.orders, t.customers, t.drivers).select("order_id", "driver_name", "trips")


# ---- bands

@query("g1_age_left_closed", """SELECT customer_id, CASE WHEN customer_age < 18 OR customer_age >= 100 THEN NULL
    WHEN customer_age < 30 THEN '18-29' WHEN customer_age < 45 THEN '30-44' WHEN customer_age < 60 THEN '45-59'
    ELSE '60+' END AS age_group FROM cu""")
def _(t):
    return t.customers.select("customer_id", bands.age_band_left(F.col("customer_age")).alias("age_group"))


@query("g2_age_right_closed", """SELECT customer_id, CASE WHEN customer_age <= 18 OR customer_age > 100 THEN NULL
    WHEN customer_age <= 30 THEN '18-29' WHEN customer_age <= 45 THEN '30-44' WHEN customer_age <= 60 THEN '45-59'
    ELSE '60+' END AS age_group FROM cu""")
def _(t):
    return t.customers.select("customer_id", bands.age_band_right(F.col("customer_age")).alias("age_group"))


@query("g3_age_bounded", """SELECT * FROM (SELECT 'driver' AS kind, driver_id AS id, CASE WHEN age BETWEEN 18 AND 29
    THEN '18-29' WHEN age BETWEEN 30 AND 44 THEN '30-44' WHEN age BETWEEN 45 AND 59 THEN '45-59' ELSE '60+' END AS age_group
    FROM dr UNION ALL SELECT 'customer', customer_id, CASE WHEN customer_age BETWEEN 18 AND 29 THEN '18-29'
    WHEN customer_age BETWEEN 30 AND 44 THEN '30-44' WHEN customer_age BETWEEN 45 AND 59 THEN '45-59' ELSE '60+' END FROM cu)""")
def _(t):
    of = lambda df, kind, key, age: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"),
                                              bands.age_band_sql(F.col(age)).alias("age_group"))
    return of(t.drivers, "driver", "driver_id", "age").unionByName(
        of(t.customers, "customer", "customer_id", "customer_age"))


@query("g4_experience_tier", "SELECT driver_id, CASE WHEN trips <= 25 THEN 'Rookie (<=25)' WHEN trips <= 50 "
       "THEN 'Intermediate (26-50)' ELSE 'Experienced (51+)' END AS tier FROM dr")
def _(t):
    return t.drivers.select("driver_id", bands.experience_tier(F.col("trips"), bands.TIER_LABELS_REPORT).alias("tier"))


@query("g5_period", "SELECT order_id, CASE delivery_hour // 6 WHEN 0 THEN 'overnight' WHEN 1 THEN 'morning' "
       "WHEN 2 THEN 'afternoon' ELSE 'evening' END AS period, (delivery_hour // 6 + 1)::INT AS period_ord FROM o")
def _(t):
    period = bands.period_of_day(F.col("delivery_hour"), bands.PERIOD_LABELS_MODEL)
    return t.orders.select("order_id", period.alias("period"),
                           bands.label_order(period, bands.PERIOD_LABELS_MODEL).alias("period_ord"))


@query("g6_order_size_tier", "SELECT order_id, order_size_tier FROM f")
def _(t):
    return t.orders.select("order_id", bands.order_size_tier(F.col("items_delivered")).alias("order_size_tier"))


@query("g7_amount_tier", "SELECT order_id, amount_tier FROM f")
def _(t):
    return t.orders.select("order_id", bands.amount_tier(F.col("order_amount")).alias("amount_tier"))


@query("g8_failure_group", "SELECT customer_id, CASE WHEN total_failures = 0 THEN '0 failures' WHEN total_failures = 1 "
       "THEN '1 failure' WHEN total_failures = 2 THEN '2 failures' ELSE '3+ failures' END AS failure_group FROM ca")
def _(t):
    return cust.customer_profile(t.orders_without_region).select("customer_id", bands.failure_group(
        F.col("total_failures"), bands.FAILURE_GROUPS_COHORT).alias("failure_group"))


@query("g9_value_segment", "SELECT customer_id, CASE WHEN cents >= q75 THEN 'VIP' WHEN cents >= q50 THEN 'High Value' "
       "WHEN cents >= q25 THEN 'Medium Value' ELSE 'Low Value' END AS value_segment FROM c, cq")
def _(t):
    return cust.value_segments(cust.customer_profile(t.orders_without_region)).select("customer_id", "value_segment")


ORDER_VALUE_SQL = """tk AS (SELECT customer_id, count(*) AS orders, count(*) FILTER (WHERE has_missing) AS failures,
        round(sum(amount_cents) / 100.0 / count(*), 9) AS mean_ticket FROM o GROUP BY 1),
    tq AS (SELECT quantile_cont(mean_ticket, 0.25) AS q25, quantile_cont(mean_ticket, 0.5) AS q50,
                  quantile_cont(mean_ticket, 0.75) AS q75 FROM o JOIN tk USING (customer_id)),
    vs AS (SELECT tk.*, CASE WHEN mean_ticket <= q25 THEN 'Low Value' WHEN mean_ticket <= q50 THEN 'Medium Value'
                  WHEN mean_ticket <= q75 THEN 'High Value' ELSE 'VIP' END AS value_segment FROM tk, tq)"""


@query("g10_value_quartile_orders", ORDER_VALUE_SQL + " SELECT customer_id, orders, round(mean_ticket, 6) AS mean_ticket, "
       "value_segment FROM vs")
def _(t):
    return stats.order_value_quartiles(t.orders_without_region).select(
        "customer_id", "orders", "mean_ticket", "value_segment")


@query("g11_region_label", "SELECT region, CASE WHEN avg(has_missing::INT) > min(g_rate) THEN 'Above Average' ELSE "
       "'Below Average' END AS performance_label, CASE WHEN avg(has_missing::INT) > min(g_rate) THEN 'critical' ELSE 'ok' "
       "END AS status FROM o, g GROUP BY 1")
def _(t):
    rates = kpis.amounts_by(t.orders, "region").withColumn("g", kpis.global_scalar(t.orders))
    rate, overall = F.col("failure_rate"), F.col("g.failure_rate")
    return rates.select("region", bands.versus_global(rate, overall).alias("performance_label"),
                        bands.status(rate, overall).alias("status"))


@query("g12_risk_label", "SELECT driver_id, CASE WHEN failure_rate < 0.10 THEN 'Low Risk' WHEN failure_rate < 0.20 "
       "THEN 'Medium Risk' ELSE 'High Risk' END AS risk_label FROM dt")
def _(t):
    return drivers.driver_totals(t.orders_without_region).select(
        "driver_id", bands.risk_label(F.col("failure_rate")).alias("risk_label"))


@query("g13_attribution_level", """SELECT category, CASE WHEN pct > 50 THEN 'critical' WHEN pct > 10 THEN 'warning'
    WHEN pct > 3 THEN 'neutral' ELSE 'ok' END AS level FROM (SELECT category, count(*) * 100.0 / sum(count(*)) OVER () AS pct
    FROM it JOIN pr USING (product_id) GROUP BY 1)""")
def _(t):
    from ..operators import products
    total = Window.partitionBy()
    return products.items_by_category(t.order_items, t.products).withColumn(
        "pct", F.col("count") * 100.0 / F.sum("count").over(total)).select(
        "category", bands.attribution_level(F.col("pct")).alias("level"))


@query("g14_significance", "SELECT region, CASE WHEN avg(has_missing::INT) < 0.05 THEN 'YES (p < 0.05)' ELSE "
       "'NO (p >= 0.05)' END AS verdict, CASE WHEN avg(has_missing::INT) < 0.001 THEN 'p < 0.001' ELSE "
       "printf('p = %.4f', avg(has_missing::INT)) END AS label FROM o GROUP BY 1")
def _(t):
    return kpis.amounts_by(t.orders, "region").select(
        "region", bands.significance(F.col("failure_rate")).alias("verdict"),
        bands.p_text(F.col("failure_rate")).alias("label"))


@query("g15_risk_flag", "SELECT driver_id, failure_rate > 0.20 AS risk_flag FROM dt")
def _(t):
    return drivers.driver_totals(t.orders_without_region).select(
        "driver_id", (F.col("failure_rate") > 0.20).alias("risk_flag"))


@query("g16_quadrant_export", "SELECT driver_id, intervention_quadrant FROM dd")
def _(t):
    return drivers.driver_dimension(t.orders_without_region, t.drivers).select("driver_id", "intervention_quadrant")


def _quadrant_sql(unstable):
    return f"""SELECT driver_id, months_active, round(avg_rate, 6) AS avg_rate, round(std_rate, 6) AS std_rate,
    round(cv, 6) AS cv, CASE WHEN avg_rate > rm AND NOT (cv {unstable} cm) THEN 'High Risk / Consistent (Chronic)'
    WHEN avg_rate > rm THEN 'High Risk / Unstable (Coaching)' WHEN NOT (cv {unstable} cm)
    THEN 'Low Risk / Consistent (Reference)' ELSE 'Low Risk / Unstable (Monitor)' END AS quadrant
    FROM cc, (SELECT median(avg_rate) AS rm, median(cv) AS cm FROM cc)"""


@query("g17_quadrant_cohort", _quadrant_sql(">="))
def _(t):
    return drivers.cohort_quadrants(drivers.cohort_consistency(t.orders_without_region))


@query("g18_quadrant_dashboard", _quadrant_sql(">"))
def _(t):
    return drivers.cohort_quadrants(drivers.cohort_consistency(t.orders_without_region), median_is_unstable=False)


def _histogram_sql(source, value, bins):
    return f"""hv AS (SELECT {value} AS v FROM {source}),
    he AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
                  CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM hv),
    hc AS (SELECT least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1})::INT AS bin, count(*) AS n FROM hv, he GROUP BY 1)
    SELECT b.bin::INT AS bin, round(lo + b.bin * ((hi - lo) / {bins}), 6) AS bin_start,
           round(lo + (b.bin + 1) * ((hi - lo) / {bins}), 6) AS bin_end, coalesce(n, 0) AS rows
    FROM (SELECT unnest(range(0, {bins})) AS bin) b LEFT JOIN hc ON hc.bin = b.bin, he"""


@query("g19_histogram_order_value", _histogram_sql("o", "order_amount", 40))
def _(t):
    return distribution.histogram(t.orders, "order_amount", 40)


@query("g19_histogram_churned_revenue", _histogram_sql("c WHERE churned", "total_revenue", 20))
def _(t):
    return distribution.histogram(cust.customer_profile(t.orders_without_region).where("churned"), "total_revenue", 20)


@query("g19_histogram_ticket_delta", """ph AS (SELECT customer_id, avg(amount_cents) FILTER (WHERE date <= first_failure) / 100.0 AS pre,
    avg(amount_cents) FILTER (WHERE date > first_failure) / 100.0 AS post FROM o JOIN ca USING (customer_id)
    WHERE first_failure IS NOT NULL GROUP BY 1), pd AS (SELECT round(post - pre, 9) AS v FROM ph
    WHERE pre IS NOT NULL AND post IS NOT NULL), """ + _histogram_sql("pd", "v", 30))
def _(t):
    phases = cust.spend_by_phase(t.orders_without_region).withColumn("delta", F.round("delta", 9))
    return distribution.histogram(phases, "delta", 30)


@query("g19_histogram_driver_rate", _histogram_sql("dt WHERE deliveries >= 5", "failure_rate", 40))
def _(t):
    rates = drivers.driver_performance(t.orders_without_region, t.drivers).where("deliveries >= 5")
    return distribution.histogram(rates, "failure_rate", 40)


def _box_sql(source, value, by):
    return f"""bq AS (SELECT {by} AS k, quantile_cont({value}, 0.25) AS q25, quantile_cont({value}, 0.5) AS q50,
           quantile_cont({value}, 0.75) AS q75 FROM {source} GROUP BY 1)
    SELECT k AS {by}, count(*) AS n, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75,
           round(least(min(v) FILTER (WHERE v BETWEEN q25 - (q75 - q25) * 1.5 AND q75 + (q75 - q25) * 1.5), q25), 6) AS whisker_low,
           round(greatest(max(v) FILTER (WHERE v BETWEEN q25 - (q75 - q25) * 1.5 AND q75 + (q75 - q25) * 1.5), q75), 6) AS whisker_high,
           count(*) FILTER (WHERE NOT (v BETWEEN q25 - (q75 - q25) * 1.5 AND q75 + (q75 - q25) * 1.5)) AS outliers
    FROM (SELECT {by} AS k, {value} AS v FROM {source}) JOIN bq USING (k) GROUP BY k, q25, q50, q75"""


@query("g20_box_high_risk_drivers", "hh AS (SELECT 'rate_h1' AS semester, rate_h1 AS rate FROM h WHERE rate_h1 >= 0.20 "
       "UNION ALL SELECT 'rate_h2', rate_h2 FROM h WHERE rate_h1 >= 0.20), " + _box_sql("hh", "rate", "semester"))
def _(t):
    risky = drivers.high_risk_first_half(drivers.semester_rates(t.orders_without_region))
    long = reshape.melt(risky, ["driver_id"], ["rate_h1", "rate_h2"], "semester", "rate")
    return distribution.box_stats(long, "rate", ["semester"])


@query("g20_box_order_frequency", _box_sql("c", "orders_per_month", "had_failure"))
def _(t):
    return distribution.box_stats(cust.customer_profile(t.orders_without_region), "orders_per_month", ["had_failure"])
