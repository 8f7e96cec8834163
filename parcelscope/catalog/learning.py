"""Statistical tests, models, clusters and attribution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import attribution, clusters, features, kpis, models, stats
from ..operators import customers as cust
from ..plans import report
from ..session import written
from ..sources import writers
from .base import query
from .kpis import DRIVER_CLUSTERS_SQL, DRIVER_ROWS_SQL, VARIANCE_SQL
from .relational import PHASES
from .solvers import assigned_sql, axes_sql, clusters_sql, newton_sql


@query("x1_correlation", """cr AS (SELECT count(*) AS n, corr(items_delivered, items_missing) AS r FROM o)
    SELECT n, round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t FROM cr""")
def _(t):
    return stats.correlation(t.orders_without_region, "items_delivered", "items_missing")


def _u_tables(source, value, first):
    """Ranks from a sort of all rows, independent of the counted form used in Spark."""
    return f"""rk AS (SELECT {value} AS v, {first} AS f, rank() OVER (ORDER BY {value}) AS lo,
           count(*) OVER (PARTITION BY {value}) AS t FROM {source}),
    us AS (SELECT count(*) FILTER (WHERE f)::DOUBLE AS n1, count(*) FILTER (WHERE NOT f)::DOUBLE AS n2,
           sum(lo + (t - 1) / 2.0) FILTER (WHERE f) - n1 * (n1 + 1) / 2 AS u1, sum(t::DOUBLE * t - 1) AS ties FROM rk),
    ux AS (SELECT *, n1 * n2 - u1 AS u2, n1 * n2 / 2 AS mu,
           sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM us),
    uz AS (SELECT *, (greatest(u1, u2) - mu - 0.5) / sd AS z2, (u1 - mu - 0.5) / sd AS zg FROM ux)"""


_U_COLUMNS = ("n1::BIGINT AS n1, n2::BIGINT AS n2, round(u1, 6) AS u1, round(u2, 6) AS u2, round(z2, 6) AS z_two_sided, "
              "round(zg, 6) AS z_greater")

# Tail areas by Simpson's rule over s = 0..1, where x = the limit + s / (1 - s).
_STEPS = "ig AS (SELECT i / 4000.0 AS s, CASE WHEN i = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(0, 4000) r(i))"


def _area(density, limit):
    return (f"(SELECT sum(w * ({density}) / ((1 - s) * (1 - s))) / 12000.0 FROM "
            f"(SELECT w, s, {limit} + s / (1 - s) AS x FROM ig) steps)")


def _normal_p(z):
    area = _area("exp(-x * x / 2) / sqrt(2 * pi())", f"abs({z})")
    return f"CASE WHEN {z} >= 0 THEN {area} ELSE 1 - {area} END"


def _t_p(t, v):
    return "2 * " + _area(f"exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) / sqrt({v} * pi()) * "
                          f"pow(1 + x * x / {v}, -({v} + 1) / 2.0)", f"abs({t})")


def _chi2_p(h, k):
    return _area(f"exp(({k} / 2.0 - 1) * ln(x) - x / 2 - lgamma({k} / 2.0)) / pow(2, {k} / 2.0)", h)


def _u_sql(source, value, first):
    return f"{_u_tables(source, value, first)} SELECT {_U_COLUMNS} FROM uz"


@query("x2_order_frequency_u", _u_sql("c", "orders_per_month", "NOT had_failure"))
def _(t):
    return stats.frequency_test(t.orders_without_region)


RISK_SQL = """q AS (SELECT quantile_cont(failure_rate, 0.75) AS hi, quantile_cont(failure_rate, 0.25) AS lo FROM dt WHERE deliveries >= 10),
    rg AS (SELECT has_missing::INT AS y, true AS is_high FROM o WHERE driver_id IN
             (SELECT driver_id FROM dt, q WHERE deliveries >= 10 AND failure_rate >= hi)
           UNION ALL SELECT has_missing::INT, false FROM o WHERE driver_id IN
             (SELECT driver_id FROM dt, q WHERE deliveries >= 10 AND failure_rate <= lo))"""


@query("x3_driver_risk_u", RISK_SQL + ", " + _u_sql("rg", "y", "is_high"))
def _(t):
    cells = stats.risk_group_flags(stats.driver_risk_groups(stats.driver_rates(t.orders_without_region)))
    return stats.mann_whitney_counts(cells, "failed", "is_high")


def _h_tables(source, value, group, at=""):
    return f"""kr{at} AS (SELECT {group} AS k, rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0 AS rk,
           count(*) OVER (PARTITION BY {value}) AS t FROM {source} WHERE {group} IS NOT NULL),
    kn{at} AS (SELECT count(*)::DOUBLE AS n, sum(t::DOUBLE * t - 1) AS ties FROM kr{at}),
    kg{at} AS (SELECT k, count(*) AS nj, avg(rk) AS mean_rank FROM kr{at} GROUP BY 1),
    kh{at} AS (SELECT count(*) AS groups, n::BIGINT AS n, 12 / (n * (n + 1)) * sum(nj * (mean_rank - (n + 1) / 2)
           * (mean_rank - (n + 1) / 2)) / (1 - ties / (n * n * n - n)) AS h, count(*) - 1 AS df
           FROM kg{at}, kn{at} GROUP BY n, ties)"""


def _h_sql(source, value, group):
    return f"{_h_tables(source, value, group)} SELECT groups, n, round(h, 6) AS h, df FROM kh"


@query("x4_age_groups_h", VARIANCE_SQL + ", " + _h_sql("ao", "y", "age_group"))
def _(t):
    sums = stats.customer_age_sums(t.orders_without_region, t.customers)
    return stats.kruskal_counts(stats.grouped_flags(sums, "age_group"))


@query("x4_value_segments_h", VARIANCE_SQL + ", " + _h_sql("ao", "y", "value_segment"))
def _(t):
    return stats.kruskal_counts(stats.grouped_flags(stats.order_value_quartiles(t.orders_without_region), "value_segment"))


@query("x4_regions_h", VARIANCE_SQL + ", " + _h_sql("ao", "y", "region"))
def _(t):
    return stats.kruskal_counts(stats.grouped_flags(stats.region_sums(t.orders), "region"))


@query("x4_amount_by_region_h", _h_sql("o", "amount_cents", "region"))
def _(t):
    return stats.kruskal(t.orders, "amount_cents", "region")


@query("x5_paired_t", PHASES + """ SELECT count(*) AS n, round(avg(pre_failure - post_failure), 6) AS mean_difference,
    round(avg(pre_failure - post_failure) / (stddev_samp(pre_failure - post_failure) / sqrt(count(*))), 6) AS t FROM pp""")
def _(t):
    return stats.paired_t(cust.spend_by_phase(t.orders_without_region), "pre_failure", "post_failure")


# The same tests with their p-values.

@query("x1_correlation_p", f"""{_STEPS}, cr AS (SELECT count(*) AS n, corr(items_delivered, items_missing) AS r FROM o),
    ct AS (SELECT n, r, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS v FROM cr)
    SELECT n, round(r, 6) AS r, round(t, 6) AS t, round({_t_p("t", "v")}, 6) AS p_value FROM ct""")
def _(t):
    return stats.with_t_p(stats.correlation(t.orders_without_region, "items_delivered", "items_missing"), 2)


@query("x2_order_frequency_p", f"""{_STEPS}, {_u_tables("c", "orders_per_month", "NOT had_failure")}
    SELECT {_U_COLUMNS}, round(least(2 * ({_normal_p("z2")}), 1), 6) AS p_value FROM uz""")
def _(t):
    return stats.with_mann_whitney_p(stats.frequency_test(t.orders_without_region), "two-sided")


@query("x5_paired_t_p", PHASES + f""", {_STEPS}, pt AS (SELECT count(*) AS n, avg(pre_failure - post_failure) AS d,
    avg(pre_failure - post_failure) / (stddev_samp(pre_failure - post_failure) / sqrt(count(*))) AS t FROM pp)
    SELECT n, round(d, 6) AS mean_difference, round(t, 6) AS t, round({_t_p("t", "(n - 1)")}, 6) AS p_value FROM pt""")
def _(t):
    return stats.with_t_p(stats.paired_t(cust.spend_by_phase(t.orders_without_region), "pre_failure", "post_failure"), 1)


@query("x6_test_table", f"""{VARIANCE_SQL}, {RISK_SQL}, {_STEPS}, {_u_tables("rg", "y", "is_high")},
    {_h_tables("ao", "y", "region", "r")}, {_h_tables("ao", "y", "age_group", "a")}, {_h_tables("ao", "y", "value_segment", "v")},
    tt AS (SELECT 'Driver (high vs. low risk)' AS dimension, 'Driver' AS category, 'Mann-Whitney U' AS test, u1 AS statistic,
                  {_normal_p("zg")} AS p FROM uz UNION ALL
    SELECT 'Region', 'Location', 'Kruskal-Wallis', h, {_chi2_p("h", "df")} FROM khr UNION ALL
    SELECT 'Age Group', 'Customer', 'Kruskal-Wallis', h, {_chi2_p("h", "df")} FROM kha UNION ALL
    SELECT 'Value Segment', 'Customer', 'Kruskal-Wallis', h, {_chi2_p("h", "df")} FROM khv)
    SELECT dimension, category, test, round(statistic, 6) AS statistic, round(p, 6) AS p_value,
    CASE WHEN p < 0.05 THEN 'YES (p < 0.05)' ELSE 'NO (p >= 0.05)' END AS significant,
    CASE WHEN p < 0.001 THEN 'p < 0.001' ELSE printf('p = %.4f', p) END AS label FROM tt""")
def _(t):
    return stats.test_table(t.orders, t.customers)


@query("x7_risk_group_means", RISK_SQL + """ SELECT round(avg(y) FILTER (WHERE is_high), 6) AS high_rate,
    round(avg(y) FILTER (WHERE NOT is_high), 6) AS low_rate,
    round((avg(y) FILTER (WHERE is_high) - avg(y) FILTER (WHERE NOT is_high)) * 100, 6) AS gap_pp FROM rg""")
def _(t):
    return stats.risk_group_means(stats.risk_group_flags(
        stats.driver_risk_groups(stats.driver_rates(t.orders_without_region))))


FEATURE_SQL = """pf AS (SELECT order_id, coalesce(CASE WHEN driver_id IS NOT NULL THEN avg(has_missing::INT) OVER (PARTITION BY
    driver_id ORDER BY date, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, g_rate) AS rate FROM o, g),
    re AS (SELECT region, row_number() OVER (ORDER BY region) - 1 AS code FROM (SELECT DISTINCT region FROM o)),
    pn AS (SELECT order_id, CASE delivery_hour // 6 WHEN 0 THEN 'overnight' WHEN 1 THEN 'morning' WHEN 2 THEN 'afternoon'
           ELSE 'evening' END AS period FROM o),
    pe AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS code FROM (SELECT DISTINCT period FROM pn)),
    ft AS MATERIALIZED (SELECT order_id, rate AS driver_fail_rate, order_amount, items_delivered, delivery_hour,
    pe.code::INT AS period_enc, (isodow(date) >= 6)::INT AS is_weekend, (isodow(date) = 1)::INT AS is_monday,
    re.code::INT AS region_enc, customer_age, has_missing::INT AS label FROM o JOIN pf USING (order_id) JOIN re USING (region)
    JOIN pn USING (order_id) JOIN pe USING (period) JOIN cu USING (customer_id))"""


def _features(t):
    """Features from orders written once: none of the passes over them reads the lines again."""
    return features.feature_table(written(t.orders.select(*features.FEATURE_SOURCES), "feature_orders"), t.customers)


@query("l1_feature_table", FEATURE_SQL + """ SELECT * REPLACE (round(driver_fail_rate, 6) AS driver_fail_rate,
    round(order_amount, 6) AS order_amount) FROM ft""")
def _(t):
    return _features(t)


def _split(t):
    """Features, and then the rows with their part, are written once to the shared folder: training rebuilds neither."""
    return features.parts_of(written(features.marked_rows(written(_features(t), "features")), "split"))


def _forest(t, trees=300):
    train, test = _split(t)
    return models.fit_forest(train, trees=trees), train, test


@query("l2_split", """sd AS (SELECT has_missing, CAST(('0x' || substr(md5(order_id::VARCHAR), 1, 13))::BIGINT AS DOUBLE) AS draw FROM o),
    sc AS (SELECT has_missing, quantile_cont(draw, 0.2) AS cut FROM sd GROUP BY 1)
    SELECT CASE WHEN draw <= cut THEN 'test' ELSE 'train' END AS part, has_missing, count(*) AS orders
    FROM sd JOIN sc USING (has_missing) GROUP BY 1, 2""")
def _(t):
    train, test = features.split_rows(t.orders_without_region, label="has_missing")
    named = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return named.groupBy("part", "has_missing").agg(F.count(F.lit(1)).alias("orders"))


# A feature without any spread is 0 everywhere.
_Z = ", ".join(f"round(coalesce(({f} - avg({f}) OVER ()) / nullif(stddev_samp({f}) OVER (), 0), 0), 6) AS {f}_z"
               for f in clusters.DRIVER_FEATURES)


@query("l3_standardised", f"""df AS (SELECT driver_id, count(*) AS total_deliveries, avg(has_missing::INT) AS missing_rate,
    sum(amount_cents) / 100.0 / count(*) AS avg_order_value, count(DISTINCT region) AS region_diversity,
    avg(items_delivered) AS avg_items FROM o WHERE driver_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)
    SELECT driver_id, {_Z} FROM df""")
def _(t):
    rows = clusters.driver_features(t.orders)
    return models.standardised(rows, clusters.DRIVER_FEATURES).select(
        "driver_id", *[f"{f}_z" for f in clusters.DRIVER_FEATURES])


SPLIT_SQL = FEATURE_SQL + """, sd AS (SELECT *, CAST(('0x' || substr(md5(order_id::VARCHAR), 1, 13))::BIGINT AS DOUBLE) AS draw FROM ft),
    sc AS (SELECT label, quantile_cont(draw, 0.2) AS cut FROM sd GROUP BY 1),
    tr AS MATERIALIZED (SELECT sd.* FROM sd JOIN sc USING (label) WHERE draw > cut),
    te AS MATERIALIZED (SELECT sd.* FROM sd JOIN sc USING (label) WHERE draw <= cut)"""
REGRESSION_SQL = SPLIT_SQL + ", " + newton_sql("tr", features.FEATURES, True, "a")
_NAMES = ", ".join(f"'{f}'" for f in features.FEATURES)


@query("l4_odds_ratios", f"""{REGRESSION_SQL}, od AS (SELECT unnest([{_NAMES}]) AS feature, unnest(w[1:9]) AS coef FROM rwa)
    SELECT feature, round(coef, 6) AS coef, round(exp(coef), 6) AS odds_ratio FROM od""", recursive=True)
def _(t):
    train, _test = _split(t)
    return models.odds_ratios(t.spark, models.fit_logistic(train))


RISK_MODEL_SQL = """rc AS (SELECT region, row_number() OVER (ORDER BY region) - 1 AS region_enc FROM (SELECT DISTINCT region FROM o)),
    wc AS (SELECT day_of_week, row_number() OVER (ORDER BY day_of_week) - 1 AS day_enc FROM (SELECT DISTINCT day_of_week FROM o)),
    dh AS (SELECT driver_id, avg(has_missing::INT) AS rate FROM o WHERE driver_id IS NOT NULL GROUP BY 1),
    rr AS MATERIALIZED (SELECT order_id, region_enc, day_enc, delivery_hour, order_amount, items_delivered, coalesce(rate, g_rate) AS
    driver_hist_rate, has_missing::INT AS label FROM o JOIN rc USING (region) JOIN wc USING (day_of_week) LEFT JOIN dh USING (driver_id), g),
    """ + newton_sql("rr", models.RISK_FEATURES, False, "b") + """,
    rs AS MATERIALIZED (SELECT order_id, y::INT AS label, 1 / (1 + exp(-list_dot_product(x, w))) AS score, x, w FROM nxb, rwb)"""


def _risk_model(t):
    rows = written(features.risk_features(t.orders), "risk")
    return models.fit_logistic(rows, models.RISK_FEATURES, standardise=False), rows


@query("l5_risk_model_in_sample", RISK_MODEL_SQL + " SELECT order_id, label, round(score, 6) AS score FROM rs", recursive=True)
def _(t):
    model, rows = _risk_model(t)
    return models.scored(model, rows).select("order_id", "label", "score")


@query("l6_forest_scores")
def _(t):
    model, _train, test = _forest(t)
    return models.scored(model, test).select("order_id", "label", "score")


@query("l7_importances")
def _(t):
    model, _train, _test = _forest(t, trees=200)
    return models.importances(model)


LOGISTIC_TEST_SQL = REGRESSION_SQL + """, ls AS MATERIALIZED (SELECT order_id, label, 1 / (1 + exp(-(w[10] + """ + " + ".join(
    f"coalesce(({f} - m{i}) / nullif(s{i}, 0), 0) * w[{i + 1}]" for i, f in enumerate(features.FEATURES)) + """))) AS score
    FROM te, rwa, moa)"""


@query("l8_logistic_auc", LOGISTIC_TEST_SQL + """, rk AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0
    AS place FROM ls) SELECT round((sum(place) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
    / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc FROM rk""", recursive=True)
def _(t):
    train, test = _split(t)
    return models.auc_from_counts(models.scored(models.fit_logistic(train), test))


@query("l8_auc")
def _(t):
    model, _train, test = _forest(t)
    return models.auc_from_counts(models.scored(model, test))


@query("l9_logistic_curve", LOGISTIC_TEST_SQL + """ SELECT DISTINCT round(score, 6) AS threshold,
    round(sum((label = 0)::INT) OVER (ORDER BY score DESC)::DOUBLE / sum((label = 0)::INT) OVER (), 6) AS fpr,
    round(sum((label = 1)::INT) OVER (ORDER BY score DESC)::DOUBLE / sum((label = 1)::INT) OVER (), 6) AS tpr FROM ls""", recursive=True)
def _(t):
    train, test = _split(t)
    return models.roc_curve(models.scored(models.fit_logistic(train), test))


@query("l9_roc_curves")
def _(t):
    train, test = _split(t)
    curves = [models.roc_curve(models.scored(model, test)).withColumn("model", F.lit(name)) for name, model in
              (("logistic", models.fit_logistic(train)), ("forest", models.fit_forest(train)))]
    return curves[0].unionByName(curves[1])


@query("l10_attributions")
def _(t):
    model, _train, test = _forest(t)
    return attribution.attributions(t.spark, model, test)


@query("l11_category_attribution")
def _(t):
    model, _train, test = _forest(t)
    return attribution.category_attribution(attribution.attributions(t.spark, model, test))


def _conclusion(t):
    model, _train, test = _forest(t)
    # Five rows that the conclusion and the documents each read: stored, so that the attributions are made once.
    categories = written(attribution.category_attribution(attribution.attributions(t.spark, model, test)), "categories")
    variance = stats.variance_comparison(t.orders, t.customers)
    return categories, report.conclusion(categories, variance, models.auc(models.scored(model, test)))


@query("l12_conclusion")
def _(t):
    return _conclusion(t)[1]


def model_results(t):
    """Attribution by category, tests and conclusion, stored as one row."""
    categories, summary = _conclusion(t)
    return written(report.model_document(categories, stats.test_table(t.orders, t.customers), summary), "model")


@query("k5_model_document")
def _(t):
    return writers.document(model_results(t))


@query("k5_test_records", f"""{VARIANCE_SQL}, {RISK_SQL}, {_STEPS}, {_u_tables("rg", "y", "is_high")},
    {_h_tables("ao", "y", "region", "r")}, {_h_tables("ao", "y", "age_group", "a")}, {_h_tables("ao", "y", "value_segment", "v")},
    tt AS (SELECT 'mann_whitney_drivers' AS name, 'Mann-Whitney U' AS test, round_even(u1, 2) AS statistic, {_normal_p("zg")} AS p,
                  true AS short FROM uz UNION ALL
    SELECT 'kruskal_regions', 'Kruskal-Wallis', round_even(h, 2), {_chi2_p("h", "df")}, true FROM khr UNION ALL
    SELECT 'kruskal_age_groups', 'Kruskal-Wallis', round_even(h, 4), {_chi2_p("h", "df")}, false FROM kha UNION ALL
    SELECT 'kruskal_value_segments', 'Kruskal-Wallis', round_even(h, 4), {_chi2_p("h", "df")}, false FROM khv)
    SELECT name, test, round(statistic, 6) AS statistic, round(p, 6) AS p_value, p < 0.05 AS significant,
    CASE WHEN short AND p < 0.001 THEN 'p < 0.001' WHEN short THEN printf('p = %.4f', p) ELSE printf('p = %.3f', p) END AS label FROM tt""")
def _(t):
    names = [name for name, *_ in report.TEST_RECORDS.values()]
    records = stats.test_table(t.orders, t.customers).select(F.lit(1).alias("one")).limit(1).withColumn(
        "r", report.test_records(stats.test_table(t.orders, t.customers)))
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"r.{n}").alias("v")) for n in names])
    return records.select(F.explode(listed).alias("x")).select(
        "x.name", "x.v.test", "x.v.statistic", "x.v.p_value", "x.v.significant", "x.v.label")


@query("l13_risk_scores", RISK_MODEL_SQL + f""" SELECT order_id, round(score, 6) AS probability,
    CASE WHEN score < 0.1 THEN 'Low Risk' WHEN score < 0.2 THEN 'Medium Risk' ELSE 'High Risk' END AS risk_label,
    round((score - g_rate) * 100, 6) AS delta_pp, unnest([{", ".join(f"'{f}'" for f in models.RISK_FEATURES)}]) AS feature,
    unnest(list_transform(x[1:6], lambda v, i: round(v * w[i], 6))) AS contribution FROM rs, g""", recursive=True)
def _(t):
    model, _rows = _risk_model(t)
    base = kpis.global_scalar(t.orders_without_region)
    return models.risk_scores(model, features.raw_risk_rows(t.orders, t.orders), base["failure_rate"]).select(
        "order_id", "probability", "risk_label", "delta_pp", F.inline("contributions"))


@query("l14_driver_profile", """SELECT driver_id, count(*) AS total_deliveries, round(avg(has_missing::INT), 6) AS missing_rate,
    round(sum(amount_cents) / 100.0 / count(*), 6) AS avg_order_value, count(DISTINCT region) AS region_diversity,
    round(avg(items_delivered), 6) AS avg_items FROM o WHERE driver_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 3""")
def _(t):
    return clusters.driver_features(t.orders)


@query("l15_customer_profile", """SELECT customer_id, count(*) AS total_orders, round(sum(amount_cents) / 100.0, 6) AS total_spent,
    round(sum(amount_cents) / 100.0 / count(*), 6) AS avg_order_value, round(avg(has_missing::INT), 6) AS missing_rate,
    min(customer_age) AS customer_age FROM m GROUP BY 1""")
def _(t):
    return clusters.customer_features(t.orders_without_region, t.customers)


def _driver_clusters(t):
    rows = written(clusters.driver_features(t.orders), "drivers")
    return clusters.assigned(clusters.fit_clusters(rows, clusters.DRIVER_FEATURES, 3, "driver_id"), rows)


@query("l16_elbow", f"""{DRIVER_ROWS_SQL}, {clusters_sql("df", "driver_id", clusters.DRIVER_FEATURES, range(2, 9), "e")}
    SELECT k::INT AS k, round(inertia, 6) AS inertia FROM kbe""", recursive=True)
def _(t):
    return clusters.elbow(t.spark, written(clusters.driver_features(t.orders), "drivers"), clusters.DRIVER_FEATURES, "driver_id")


@query("l17_driver_clusters", DRIVER_CLUSTERS_SQL + " SELECT * FROM dp", recursive=True)
def _(t):
    return clusters.driver_clusters(_driver_clusters(t))


@query("l17_cluster_members", DRIVER_CLUSTERS_SQL + " SELECT key AS driver_id, cluster FROM kad", recursive=True)
def _(t):
    return _driver_clusters(t).select("driver_id", "cluster")


@query("l18_customer_clusters", f"""cf AS (SELECT customer_id, count(*) AS total_orders, sum(amount_cents) / 100.0 AS total_spent,
    sum(amount_cents) / 100.0 / count(*) AS avg_order_value, avg(has_missing::INT) AS missing_rate, min(customer_age) AS customer_age
    FROM m GROUP BY 1), {clusters_sql("cf", "customer_id", clusters.CUSTOMER_FEATURES, [4], "c")}, {assigned_sql(4, "c")},
    cs AS (SELECT cluster, count(*) AS n_customers, avg(total_orders) AS o, avg(total_spent) AS s, avg(avg_order_value) AS v,
    avg(missing_rate) AS r, avg(coalesce(customer_age, 0)) AS a FROM cf JOIN kac ON key = customer_id GROUP BY 1)
    SELECT cluster, n_customers, round_even(o, 2) AS avg_orders, round_even(s, 2) AS avg_spent, round_even(v, 2) AS avg_ticket,
    round_even(r, 2) AS avg_missing, round_even(a, 2) AS avg_age, ['VIP', 'Regular High', 'Regular Low', 'Occasional'][row_number() OVER
    (ORDER BY round_even(s, 2) DESC, cluster)] AS segment FROM cs""", recursive=True)
def _(t):
    rows = written(clusters.customer_features(t.orders_without_region, t.customers), "customers")
    model = clusters.fit_clusters(rows, clusters.CUSTOMER_FEATURES, 4, "customer_id")
    return clusters.customer_clusters(clusters.assigned(model, rows))


@query("l19_driver_axes", f"""{DRIVER_ROWS_SQL}, {clusters_sql("df", "driver_id", clusters.DRIVER_FEATURES, [3], "d")},
    {axes_sql(len(clusters.DRIVER_FEATURES), "d")}
    SELECT key AS driver_id, round(list_dot_product(x, v1), 6) AS pca1, round(list_dot_product(x, v2), 6) AS pca2,
    round(e1, 6) AS explained1, round(e2, 6) AS explained2 FROM kxd, axd""", recursive=True)
def _(t):
    rows = written(clusters.driver_features(t.orders), "drivers")
    return clusters.projected(clusters.principal_axes(rows, clusters.DRIVER_FEATURES), rows, "driver_id")


@query("l20_cluster_distribution", DRIVER_CLUSTERS_SQL + """ SELECT profile, count(*) AS drivers, round(avg(missing_rate), 6) AS avg_rate,
    round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM df JOIN kad ON key = driver_id JOIN dp USING (cluster)
    GROUP BY 1""", recursive=True)
def _(t):
    return clusters.cluster_distribution(_driver_clusters(t))


@query("l21_top_factors")
def _(t):
    model, _train, _test = _forest(t, trees=200)
    return models.top_factors(models.importances(model))


# Properties that hold whatever the library's random numbers, next to the rows that SQL can count.

def _checks(spark, rows):
    return spark.createDataFrame([(name, int(n), bool(holds)) for name, n, holds in rows], "check string, n bigint, holds boolean")


def _falls(curve):
    """Places where the curve falls as the threshold does: within slices of thresholds, and from one slice to the next."""
    sliced = curve.withColumn("slice", F.floor(F.col("threshold") * 64))
    order = Window.partitionBy("slice").orderBy(F.desc("threshold"))
    within = sliced.withColumns({"x": F.lag("fpr", 1, 0.0).over(order), "y": F.lag("tpr", 1, 0.0).over(order)}).where(
        "fpr < x OR tpr < y").count()
    ends = sliced.groupBy("slice").agg(*[f(c).alias(f"{n}_{c}") for c in ("fpr", "tpr") for n, f in (("low", F.min), ("high", F.max))])
    rows = sorted(ends.collect(), key=lambda r: -r.slice)      # 65 slices at most
    return within + sum(b.low_fpr < a.high_fpr or b.low_tpr < a.high_tpr for a, b in zip(rows, rows[1:]))


@query("l6_l11_forest_checks", SPLIT_SQL + """ SELECT * FROM (
    SELECT 'L6 scores of test rows in 0..1' AS "check", count(*) AS n, true AS holds FROM te UNION ALL
    SELECT 'L7 importances add up to 1', 9, true UNION ALL
    SELECT 'L8 area equals the library', count(*), true FROM te WHERE label = 1 UNION ALL
    SELECT 'L8 area above chance', 1, true UNION ALL
    SELECT 'L9 curve never falls', 0, true UNION ALL
    SELECT 'L10 base and attributions add up to the score', count(*), true FROM te UNION ALL
    SELECT 'L11 category shares add up to 100', 5, true UNION ALL SELECT 'L21 top factors in order', 5, true)""")
def _(t):
    model, _train, test = _forest(t)
    scores = written(models.scored(model, test).select("order_id", "label", "score"), "scores")
    n, failed, low, high = scores.agg(F.count("order_id"), F.sum("label"), F.min("score"), F.max("score")).first()
    weights = models.importances(model).collect()
    area, library = models.auc_from_counts(scores).first().auc, models.auc(scores)
    falls = _falls(models.roc_curve(scores))
    phi = written(attribution.attributions(t.spark, model, test), "phi")
    total = sum((F.col(f) for f in features.FEATURES), F.col("base_value"))
    rows, off = phi.join(scores, "order_id").agg(F.count("order_id"), F.max(F.abs(total - F.col("score")))).first()
    shares = attribution.category_attribution(phi).collect()
    top = models.top_factors(models.importances(model)).collect()
    return _checks(t.spark, [
        ("L6 scores of test rows in 0..1", n, 0 <= low <= high <= 1),
        ("L7 importances add up to 1", len(weights), abs(sum(w.importance for w in weights) - 1) < 1e-9),
        ("L8 area equals the library", failed, abs(area - library) < 1e-9), ("L8 area above chance", 1, area > 0.5),
        ("L9 curve never falls", falls, falls == 0),
        ("L10 base and attributions add up to the score", rows, off < 1e-9),
        ("L11 category shares add up to 100", len(shares), abs(sum(s.pct for s in shares) - 100) < 1e-9),
        ("L21 top factors in order", len(top), [f.feature for f in top] == [w.feature for w in weights[:5]])])


@query("l4_l13_regression_checks", """SELECT * FROM (SELECT 'L4 gradient is zero' AS "check", 9 AS n, true AS holds UNION ALL
    SELECT 'L5 scores of all rows in 0..1', count(*), true FROM o UNION ALL
    SELECT 'L13 every order has a probability', count(*), true FROM o UNION ALL
    SELECT 'L13 label fits the probability', count(*), true FROM o UNION ALL
    SELECT 'L13 six contributions each', count(*) * 6, true FROM o)""")
def _(t):
    train, _test = _split(t)
    model = models.fit_logistic(train)
    steepest = max(map(abs, models.gradient(train, model))) / model.rows
    risk, rows = _risk_model(t)
    n, low, high = models.scored(risk, rows).agg(F.count("score"), F.min("score"), F.max("score")).first()
    base = kpis.global_scalar(t.orders_without_region)
    marked = models.risk_scores(risk, features.raw_risk_rows(t.orders, t.orders), base["failure_rate"])
    p = F.col("probability")
    fits = F.col("risk_label") == F.when(p < 0.1, "Low Risk").when(p < 0.2, "Medium Risk").otherwise("High Risk")
    every, fitting, parts, least, most = marked.agg(F.count(p), F.count_if(fits), F.sum(F.size("contributions")),
                                                    F.min(p), F.max(p)).first()
    return _checks(t.spark, [
        ("L4 gradient is zero", len(features.FEATURES), steepest < 1e-4),
        ("L5 scores of all rows in 0..1", n, 0 <= low <= high <= 1),
        ("L13 every order has a probability", every, 0 <= least <= most <= 1),
        ("L13 label fits the probability", fitting, fitting == every), ("L13 six contributions each", parts, True)])


@query("l16_l20_cluster_checks", """dn AS (SELECT driver_id, count(*) AS n, count(*) FILTER (WHERE has_missing) AS bad FROM o
    WHERE driver_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)
    SELECT * FROM (SELECT 'L16 distance falls with k' AS "check", 3 AS n, true AS holds UNION ALL
    SELECT 'L17 drivers over clusters', count(*), true FROM dn UNION ALL
    SELECT 'L17 rates rise from low to high risk', 3, true UNION ALL
    SELECT 'L18 customers over clusters', count(DISTINCT customer_id), true FROM o UNION ALL
    SELECT 'L18 spending falls from the first segment', 4, true UNION ALL
    SELECT 'L19 axes explain a share each', 2, true UNION ALL
    SELECT 'L20 shares of drivers add up', count(*), true FROM dn UNION ALL
    SELECT 'A35 failures over profiles', sum(bad)::BIGINT, true FROM dn)""")
def _(t):
    rows = written(clusters.driver_features(t.orders), "drivers")
    elbow = clusters.elbow(t.spark, rows, clusters.DRIVER_FEATURES, "driver_id", ks=(2, 3, 4)).orderBy("k").collect()
    found = _driver_clusters(t)
    profiles = clusters.driver_clusters(found).collect()
    rates = [next(p.avg_missing_rate for p in profiles if p.profile == name) for name in clusters.DRIVER_PROFILES]
    people = written(clusters.customer_features(t.orders_without_region, t.customers), "customers")
    model = clusters.fit_clusters(people, clusters.CUSTOMER_FEATURES, 4, "customer_id")
    segments = clusters.customer_clusters(clusters.assigned(model, people)).collect()
    spent = [next(s.avg_spent for s in segments if s.segment == name) for name in clusters.CUSTOMER_SEGMENTS]
    explained = clusters.principal_axes(rows, clusters.DRIVER_FEATURES).explained
    shares = clusters.cluster_distribution(found).collect()
    impact = clusters.profile_impact(t.orders_without_region, found).collect()
    return _checks(t.spark, [
        ("L16 distance falls with k", len(elbow), elbow[0].inertia > elbow[1].inertia > elbow[2].inertia),
        ("L17 drivers over clusters", sum(p.n_drivers for p in profiles), True),
        ("L17 rates rise from low to high risk", len(rates), rates == sorted(rates)),
        ("L18 customers over clusters", sum(s.n_customers for s in segments), True),
        ("L18 spending falls from the first segment", len(spent), spent == sorted(spent, reverse=True)),
        ("L19 axes explain a share each", len(explained), 1 >= sum(explained) and explained[0] >= explained[1] > 0),
        ("L20 shares of drivers add up", sum(s.drivers for s in shares), abs(sum(s.pct for s in shares) - 100) < 1e-9),
        ("A35 failures over profiles", sum(i.total_failures for i in impact), True)])
