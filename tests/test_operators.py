"""Operators on small tables with the edge cases that separate right from nearly right."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelscope.functions import bands
from parcelscope.operators import customers as cust
from parcelscope.operators import distribution, features, finance, joins, kpis, products, quality, ranking, reshape, stats
from parcelscope.operators import drivers as drv
from parcelscope.catalog import base
from parcelscope.plans import measures
from parcelscope.sources.lens import Deliveries

from helpers import by_key, column, customers, drivers, orders


# ---- distribution

@pytest.mark.parametrize("values", [[1.0], [2.0, 1.0], [1.0, 2.0, 4.0, 9.0], [5.0] * 7, list(range(1, 101)),
                                    [random.Random(1).gauss(0, 1) for _ in range(500)]])
def test_quantiles_match_linear_interpolation(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = distribution.quantiles(df, "v", [0.0, 0.25, 0.5, 0.75, 1.0]).collect()[0]
    assert list(got) == pytest.approx(list(np.quantile(values, [0, 0.25, 0.5, 0.75, 1])))


def test_quantiles_per_group_ignore_null_groups(spark):
    rows = [("a", 1), ("a", 3), ("b", 10), (None, 99)]
    got = by_key(distribution.quantiles(spark.createDataFrame(rows, "g string, v int"), "v", [0.5], ["g"]), "g", "q50")
    assert got == {"a": 2.0, "b": 10.0}


def test_running_totals_equal_a_plain_cumulative_sum(spark):
    rng = random.Random(3)
    values = sorted({round(rng.random(), 3) for _ in range(400)})
    weights = {v: rng.randint(0, 9) for v in values}
    df = spark.createDataFrame(list(weights.items()), "v double, n int")
    got = {r.v: (r.n_before, r.n_total) for r in distribution.running_counts(df, "v").collect()}
    so_far, total = 0, sum(weights.values())
    for v in values:
        assert got[v] == (so_far, total)
        so_far += weights[v]


def test_histogram_counts_all_rows(spark):
    values = [0.0, 0.1, 0.5, 0.999, 1.0, 1.0]
    rows = distribution.histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v", 4).orderBy("bin").collect()
    assert [r.rows for r in rows] == list(np.histogram(values, 4)[0])
    same = distribution.histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), "v", 4).orderBy("bin").collect()
    assert [r.rows for r in same] == list(np.histogram([2.0] * 3, 4)[0])


def test_box_stats(spark):
    values = [1, 2, 3, 4, 5, 6, 7, 100]
    r = distribution.box_stats(spark.createDataFrame([(float(v),) for v in values], "v double"), "v").collect()[0]
    assert (r.n, r.q50, r.whisker_low, r.whisker_high, r.outliers) == (8, 4.5, 1.0, 7.0, 1)


def test_describe(spark):
    values = [1.0, 2.0, 4.0, 9.0]
    r = distribution.describe(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()[0]
    assert (r["count"], r.mean, r.min, r.max, r.q25, r.q50, r.q75) == (4, 4.0, 1.0, 9.0, 1.75, 3.0, 5.25)
    assert r["std"] == pytest.approx(statistics.stdev(values))


# ---- joins and quality

def test_master_keeps_orders_without_driver(spark):
    o = orders(spark, [{"driver_id": 1}, {"driver_id": None}, {"customer_id": 9}])
    got = joins.build_master(o, customers(spark, [(1, 30)]), drivers(spark, [(1, 10)]))
    assert sorted(column(got, "order_id", "trips", "customer_age"), key=str) == [(1, 10, 30), (2, None, 30), (3, 10, None)]


def test_region_join_drops_unknown_regions(spark):
    o = orders(spark, [{"region": "South"}, {"region": None}, {"region": "North"}])
    regions = joins.region_dimension(o)
    assert by_key(regions, "region_name", "region_id") == {"North": 1, "South": 2}
    assert sorted(column(joins.attach_region_id(o, regions), "order_id")) == [1, 3]


def test_no_job_runs_while_a_plan_is_built(spark):
    o, dims = orders(spark, [{}, {"driver_id": 2}]), customers(spark, [(1, 30)])
    spark.sparkContext.setJobGroup("building", "")
    for plan in (joins.attach_region_id(o, joins.region_dimension(o)), features.label_codes(o, "region", "c"),
                 features.feature_table(o, dims), features.risk_features(o)):
        assert "ResolvedHint" not in plan._jdf.queryExecution().analyzed().toString()
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("building") == []
    spark.sparkContext.setJobGroup("", "")


def test_semi_anti_flag_lookup(spark):
    o = orders(spark, [{"customer_id": 1}, {"customer_id": 2}, {"customer_id": 2}])
    ids = spark.createDataFrame([(2,), (2,)], "customer_id bigint")
    assert sorted(column(joins.semi(o, ids, "customer_id"), "order_id")) == [2, 3]
    assert column(joins.anti(o, ids, "customer_id"), "order_id") == [1]
    assert by_key(joins.member_flag(o, ids, "customer_id", "hit"), "order_id", "hit") == {1: False, 2: True, 3: True}
    assert column(o.select(joins.lookup(F.col("region"), {"North": 7}).alias("x")).limit(1), "x") == [7]


@pytest.fixture()
def many_partitions(spark):
    """Shuffle layout as on a cluster: many partitions that are neither merged nor replaced by a broadcast."""
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.enabled": "false",
             "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _hot_orders(spark):
    """A third of the orders belong to one driver and one customer, a third have no driver."""
    base = spark.range(9000)
    third = F.col("id") % 3
    return base.select(
        F.col("id").alias("order_id"), F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("date"),
        F.lit(1000).cast("bigint").alias("amount_cents"), F.lit(10.0).alias("order_amount"), F.lit("North").alias("region"),
        F.lit(1).alias("items_delivered"), (F.col("id") % 7 == 0).cast("int").alias("items_missing"),
        F.lit(9).alias("delivery_hour"), (F.col("id") % 7 == 0).alias("has_missing"),
        F.when(third == 0, 1).when(third == 1, 2 + F.col("id") % 500).cast("bigint").alias("driver_id"),
        F.when(third == 0, 1).otherwise(2 + F.col("id") % 900).cast("bigint").alias("customer_id"))


def _largest_part(df):
    # The hash needs every column, so no join can be left out as unused.
    parts = df.select(F.spark_partition_id().alias("p"), F.xxhash64("*").alias("h")).groupBy("p")
    sizes = column(parts.agg(F.count(F.lit(1)).alias("n"), F.max("h")), "n")
    return max(sizes) / sum(sizes)


def test_hot_keys_are_spread_over_tasks(spark, many_partitions):
    o = _hot_orders(spark)
    rated = features.prior_failure_rate(o)
    assert rated.count() == 9000 and _largest_part(rated) < 0.15
    joined = features.with_historic_rate(o)
    assert joined.count() == 9000 and _largest_part(joined) < 0.15
    means = kpis.with_customer_mean(o)
    assert means.count() == 9000 and _largest_part(means) < 0.15
    plain = o.join(o.groupBy("driver_id").agg(F.count("order_id").alias("n")), "driver_id", "left")
    assert _largest_part(plain) > 0.3


def test_join_per_key_equals_plain_join(spark):
    o = _hot_orders(spark)
    per_key = o.where("driver_id % 5 <> 0").groupBy("driver_id").agg(F.count("order_id").alias("n"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = o.join(per_key, "driver_id", how).select("order_id", *(["n"] if how in ("left", "inner") else []))
        got = joins.join_per_key(o, per_key, "driver_id", how).select(*plain.columns)
        assert got.exceptAll(plain).count() == plain.exceptAll(got).count() == 0, how


def test_quality_checks(spark):
    o = orders(spark, [{"order_id": 1}, {"order_id": 1, "driver_id": 5}, {"order_id": 2, "driver_id": None}])
    assert column(quality.repeated_keys(o, ["order_id"]), "order_id", "copies") == [(1, 2)]
    assert column(quality.orphan_keys(o, drivers(spark, [(1, 5)]), "driver_id"), "driver_id", "rows") == [(5, 1)]
    assert by_key(quality.null_counts(o), "column_name", "nulls") == {"driver_id": 1}
    with pytest.raises(ValueError):
        quality.assert_unique(o, ["order_id"])
    dup = quality.duplicate_rows(spark.createDataFrame([(1, None), (1, None), (2, 3)], "a int, b int")).collect()[0]
    assert tuple(dup) == (3, 2, 1)


# ---- KPIs

def test_monthly_change_is_null_for_a_single_month(spark):
    r = kpis.monthly_kpis(orders(spark, [{}, {"items_missing": 1}])).collect()[0]
    assert (r.mom_revenue_change, r.mom_failure_change, r.failure_rate, r.failure_cost) == (None, None, 0.5, 2.5)


def test_region_kpis_leave_out_null_regions(spark):
    o = orders(spark, [{"region": "A", "items_missing": 1}, {"region": "A", "driver_id": None}, {"region": None}])
    r = kpis.region_dimension_kpis(o).collect()
    assert len(r) == 1 and (r[0].total_orders, r[0].unique_drivers, r[0].performance_label) == (2, 1, "Above Average")


def test_extremes_take_the_first_label_on_a_tie(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("d", 0.1), ("c", 0.1)], "region string, rate double")
    assert tuple(kpis.extremes(df, "region", "rate").collect()[0]) == ("a", 0.5, "c", 0.1)


def test_age_bands_count_orders(spark):
    o = orders(spark, [{"customer_id": 1}, {"customer_id": 1}, {"customer_id": 2, "amount_cents": 400}, {"customer_id": 3}])
    got = kpis.age_bands(o, customers(spark, [(1, 18), (2, 29), (3, 100)]))
    assert column(got, "age_group", "count", "avg_ticket") == [("18-29", 3, 8.0)]


def test_pivot_fills_missing_hours(spark):
    wide = reshape.pivot_hours(orders(spark, [{"delivery_hour": 0}, {"delivery_hour": 23}]), "region", F.count("order_id"))
    row = wide.collect()[0]
    assert (row.h00, row.h01, row.h23, len(wide.columns)) == (1, 0, 1, 25)


def test_unpivot_missing_items(spark):
    wide = spark.createDataFrame([(1, 5, None, None), (2, 6, 7, 8), (3, None, None, None)],
                                 "order_id int, product_id_1 int, product_id_2 int, product_id_3 int")
    got = sorted(column(reshape.unpivot_missing_items(wide), "order_id", "product_id", "position"))
    assert got == [(1, 5, 1), (2, 6, 1), (2, 7, 2), (2, 8, 3)]


def test_products(spark):
    items = spark.createDataFrame([(1, 1), (1, 1), (2, 9), (2, None)], "order_id int, product_id int")
    table = spark.createDataFrame([(1, "P1", "C", 2.5), (2, "P2", None, 1.0)],
                                  "product_id int, product_name string, category string, price double")
    assert by_key(products.product_dimension(items, table), "product_id", "order_count") == {1: 2, 2: 0}
    assert column(products.items_by_category(items, table), "category", "count") == [("C", 2)]
    assert column(products.top_products_table(items, table), "product_id", "revenue_generated") == [(1, 5.0)]


# ---- drivers

def _driver_orders(spark, plan):
    """plan: driver -> list of (month, deliveries, failures)."""
    rows = []
    for driver, months in plan.items():
        for month, n, bad in months:
            rows += [{"driver_id": driver, "date": f"2023-{month:02d}-05", "items_missing": int(i < bad)} for i in range(n)]
    return orders(spark, rows)


def test_consistency_of_one_month_and_of_no_failure(spark):
    o = _driver_orders(spark, {1: [(1, 4, 2)], 2: [(1, 3, 0), (2, 3, 0)], None: [(1, 5, 5)]})
    got = {r.driver_id: (r.months_active, r.std_rate, r.cv) for r in drv.consistency(o).collect()}
    assert got == {1: (1, None, 0.0), 2: (2, 0.0, 0.0)}


def test_cohort_minimums(spark):
    o = _driver_orders(spark, {1: [(1, 3, 1), (2, 3, 0), (3, 3, 3)], 2: [(1, 3, 1), (2, 3, 0), (3, 2, 2)]})
    assert column(drv.cohort_consistency(o), "driver_id", "months_active") == [(1, 3)]


def test_quadrants_differ_for_a_driver_on_the_median(spark):
    table = spark.createDataFrame([(1, 0.1, 0.1), (2, 0.5, 0.2), (3, 0.9, 0.3)], "driver_id int, avg_rate double, cv double")
    strict = by_key(drv.cohort_quadrants(table, median_is_unstable=False), "driver_id", "quadrant")
    loose = by_key(drv.cohort_quadrants(table), "driver_id", "quadrant")
    q = bands.QUADRANTS_COHORT
    assert strict == {1: q["reference"], 2: q["reference"], 3: q["unstable"]}
    assert loose == {1: q["reference"], 2: q["monitor"], 3: q["unstable"]}


def test_semester_rates_need_both_halves(spark):
    o = _driver_orders(spark, {1: [(1, 5, 2), (7, 5, 1)], 2: [(1, 5, 1), (7, 4, 1)], 3: [(2, 10, 1), (12, 5, 4)]})
    rates = drv.semester_rates(o)
    assert {r.driver_id: (r.rate_h1, r.rate_h2, r.improved_h1_h2) for r in rates.collect()} == {
        1: (0.4, 0.2, True), 3: (0.1, 0.8, False)}
    summary = drv.recovery_summary(rates).collect()[0]
    assert (summary.high_risk, summary.recovered, summary.improved, summary.partial) == (1, 0, 1, 1)
    path = drv.trajectory_summary(rates).collect()[0]
    assert (path.drivers, path.improved, round(path.avg_improvement_pp, 6), round(path.avg_worsening_pp, 6)) == (2, 1, 20.0, 70.0)


def test_equal_rates_are_cut_by_key(spark):
    o = _driver_orders(spark, {d: [(1, 5, 1)] for d in (4, 2, 3)} | {1: [(1, 5, 5)], 9: [(1, 4, 4)]})
    crew = drivers(spark, [(d, 10) for d in (1, 2, 3, 4, 9)])
    assert column(drv.ranked_drivers(o, crew, 2, 5), "driver_id", "failure_rate") == [(1, 1.0), (2, 0.2)]
    best = drv.ranked_drivers(o, crew, 9, 5, worst=False, skip_always_failing=True)
    assert sorted(column(best, "driver_id")) == [2, 3, 4]


def test_worst_per_region(spark):
    rows = [{"region": r, "driver_id": d, "items_missing": m} for r, d, m in
            [("N", 1, 1), ("N", 1, 0), ("N", 1, 0), ("N", 2, 1), ("N", 2, 1), ("N", 2, 1), ("S", 1, 1), ("S", 1, 1)]]
    got = drv.worst_per_region(orders(spark, rows), drivers(spark, [(1, 5), (2, 5)]), k=1)
    assert column(got, "region", "place", "driver_name") == [("N", 1, "Driver 2")]


def test_driver_dimension_volume_rule(spark):
    o = _driver_orders(spark, {1: [(1, 5, 1), (2, 5, 1)], 2: [(1, 5, 5)], 3: [(1, 4, 1)], None: [(1, 9, 9)]})
    dim = drv.driver_dimension(o, drivers(spark, [(1, 10), (2, 60), (3, 101)]))
    rows = {r.driver_id: r for r in dim.collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[3].intervention_quadrant == bands.QUADRANTS_EXPORT["low_volume"] and rows[3].exp_tier is None
    assert rows[2].intervention_quadrant == bands.QUADRANTS_EXPORT["chronic"] and rows[2].risk_flag
    assert rows[1].rate_h1 is None and rows[1].improved_h1_h2 is None
    total = finance.impact_by_quadrant(dim).agg(F.sum("pct_total_cost")).collect()[0][0]
    assert total == pytest.approx(100.0)
    improved = measures.improved_drivers(dim).collect()[0]
    assert (improved.improved, improved.drivers) == (0, 3)


def test_two_tier_averages(spark):
    o = _driver_orders(spark, {1: [(1, 9, 0)], 2: [(1, 1, 1)]})
    crew = drivers(spark, [(1, 10), (2, 20)])
    weighted = drv.tier_stats(o, crew).collect()[0]
    plain = drv.tier_stats_by_driver(o, crew).collect()[0]
    assert (weighted.failure_rate, plain.failure_rate, weighted.drivers) == (0.1, 0.5, 2)


# ---- customers

END = {"customer_id": 99, "date": "2023-12-31"}


def _profile(spark, rows):
    return {r.customer_id: r for r in cust.customer_profile(orders(spark, [*rows, END])).collect()}


def test_churn_window_and_last_order(spark):
    rows = []
    for customer, failed_on, extra in ((1, "2023-10-03", None), (2, "2023-10-02", None), (3, "2023-10-01", None),
                                       (4, "2023-10-02", "2023-10-02"), (5, "2023-10-02", "2023-10-03")):
        rows.append({"customer_id": customer, "date": failed_on, "items_missing": 1})
        if extra:
            rows.append({"customer_id": customer, "date": extra})
    got = _profile(spark, rows)
    # 31 December is 89, 90 and 91 days after the first three failures.
    assert [got[c].churned for c in (1, 2, 3, 4, 5, 99)] == [False, True, True, True, False, False]
    assert [got[c].returned_after_failure for c in (1, 4, 5, 99)] == [False, False, True, False]


def test_same_day_order_is_no_return(spark):
    got = _profile(spark, [{"date": "2023-03-01", "items_missing": 1}, {"date": "2023-03-01"}])
    assert not got[1].returned_after_failure


def test_retention_has_both_return_rates(spark):
    rows = [{"customer_id": 1, "date": "2023-01-01", "items_missing": 1}, {"customer_id": 1, "date": "2023-02-01"},
            {"customer_id": 2}, {"customer_id": 3}]
    o = orders(spark, [*rows, END])
    people = customers(spark, [(1, 20), (2, 30), (3, 40), (99, 50)])
    summary = by_key(cust.retention_summary(cust.customer_dimension(o, people)), "metric", "value")
    assert summary["Return Rate (%)"] == 25.0 and summary["Average Cost per Churn ($)"] is None
    rates = cust.return_rates(cust.customer_profile(o)).collect()[0]
    assert (rates.return_rate, rates.baseline_repeat_rate) == (100.0, 0.0)


def test_spend_by_phase(spark):
    rows = [{"date": "2023-01-01", "amount_cents": 100}, {"date": "2023-01-05", "amount_cents": 300, "items_missing": 1},
            {"date": "2023-01-05", "amount_cents": 500}, {"date": "2023-01-06", "amount_cents": 900},
            {"customer_id": 2, "items_missing": 1}, {"customer_id": 3}]
    phases = cust.spend_by_phase(orders(spark, rows))
    assert column(phases, "customer_id", "pre_failure", "post_failure", "delta") == [(1, 3.0, 9.0, 6.0)]
    change = cust.spend_change(phases).collect()[0]
    assert (change.customers, change.delta, change.pct_change) == (1, 6.0, 200.0)


def test_customer_segments_partition_customers(spark):
    o = orders(spark, [{"customer_id": c, "amount_cents": 100 * c} for c in range(1, 9)])
    dim = cust.customer_dimension(o, customers(spark, [(c, 18 + c) for c in range(1, 9)]))
    counts = by_key(dim.groupBy("value_segment").count(), "value_segment", "count")
    assert counts == {s: 2 for s in bands.VALUE_SEGMENTS}
    matrix = measures.segment_matrix(dim).agg(F.sum("failures_0")).collect()[0][0]
    assert matrix == 8


def test_churn_by_failures_is_capped(spark):
    rows = [{"customer_id": 1, "items_missing": 1}] * 7 + [{"customer_id": 2, "items_missing": 1}] * 5
    got = cust.churn_by_failures(cust.customer_profile(orders(spark, [*[dict(r) for r in rows], END])))
    assert column(got, "failure_count_capped", "failure_label", "customers", "churned_count") == [(5, "5+", 2, 2)]


# ---- statistics

def _ranks(values):
    order = sorted(values)
    return [(order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for v in values]


def test_mann_whitney_against_pairwise_count(spark):
    rng = random.Random(5)
    rows = [(float(rng.randint(0, 20)), rng.random() < 0.4) for _ in range(200)]
    r = stats.mann_whitney(spark.createDataFrame(rows, "v double, f boolean"), "v", F.col("f")).collect()[0]
    a, b = [v for v, f in rows if f], [v for v, f in rows if not f]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r.u1 == pytest.approx(u) and r.u1 + r.u2 == len(a) * len(b)


def test_all_values_tied(spark):
    rows = [(1.0, True), (1.0, False), (1.0, True)]
    r = stats.mann_whitney(spark.createDataFrame(rows, "v double, f boolean"), "v", F.col("f")).collect()[0]
    assert r.u1 == 1.0 and r.z_two_sided is None


def test_kruskal_of_seven_groups(spark):
    groups = [(1426, 231), (1422, 218), (1384, 219), (1421, 204), (1401, 212), (1461, 203), (1485, 215)]
    rows = [(str(i), n, f) for i, (n, f) in enumerate(groups)]
    sums = spark.createDataFrame(rows, "g string, orders bigint, failures bigint")
    r = stats.with_chi2_p(stats.kruskal_counts(stats.grouped_flags(sums, "g"))).collect()[0]
    n, f = sum(a for a, _ in groups), sum(b for _, b in groups)
    chi2 = sum((b - a * f / n) ** 2 / (a * f / n) + ((a - b) - a * (n - f) / n) ** 2 / (a * (n - f) / n) for a, b in groups)
    assert r.h == pytest.approx((n - 1) / n * chi2) and r.df == 6
    assert r.h == pytest.approx(4.656560, abs=1e-6) and r.p_value == pytest.approx(0.5885535600, abs=1e-9)


def test_kruskal_on_values(spark):
    rng = random.Random(6)
    rows = [(float(rng.randint(0, 30)), rng.choice("abc")) for _ in range(300)]
    r = stats.kruskal(spark.createDataFrame(rows, "v double, g string"), "v", "g").collect()[0]
    ranks, n = _ranks([v for v, _ in rows]), len(rows)
    sums = {g: [rk for rk, (_, k) in zip(ranks, rows) if k == g] for g in "abc"}
    h = 12 / (n * (n + 1)) * sum(sum(x) ** 2 / len(x) for x in sums.values()) - 3 * (n + 1)
    values = [v for v, _ in rows]
    ties = sum(values.count(v) ** 3 - values.count(v) for v in set(values))
    assert r.h == pytest.approx(h / (1 - ties / (n ** 3 - n)))


def test_correlation_and_paired_t(spark):
    rows = [(1.0, 2.0), (2.0, 3.5), (3.0, 3.0), (4.0, 6.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    r = stats.with_t_p(stats.correlation(df, "x", "y"), 2).collect()[0]
    assert r.r == pytest.approx(np.corrcoef([1, 2, 3, 4], [2, 3.5, 3, 6])[0, 1]) and r.n == 4
    d = [-1.0, -1.5, 0.0, -2.0]
    t = stats.paired_t(df, "x", "y").collect()[0].t
    assert t == pytest.approx(statistics.mean(d) / (statistics.stdev(d) / 2))


def test_order_value_quartiles_weigh_orders(spark):
    rows = [{"customer_id": 1, "amount_cents": 100}] * 7 + [{"customer_id": c, "amount_cents": 100 * c} for c in (2, 3, 4)]
    got = by_key(stats.order_value_quartiles(orders(spark, [dict(r) for r in rows])), "customer_id", "value_segment")
    cuts = np.quantile([1.0] * 7 + [2.0, 3.0, 4.0], [0.25, 0.5, 0.75])
    assert got[1] == "Low Value" and got[4] == "VIP" and cuts[0] == cuts[1] == 1.0


def test_dimension_sums_equal_separate_groupings_and_read_the_orders_once(spark):
    rng = random.Random(5)
    rows = [{"driver_id": rng.choice([1, 2, None]), "region": rng.choice(["South", "North", None]), "items_missing": rng.randint(0, 1),
             "customer_id": rng.choice([1, 2, 3, None]), "amount_cents": rng.choice([100, 250, 999])} for _ in range(60)]
    o = orders(spark, [dict(r) for r in rows])
    per_driver, per_region, per_customer = stats.dimension_sums(o)
    want = stats.driver_rates(o, 0).collect()
    assert sorted(per_driver.collect()) == sorted(want) and len(want) == 2
    assert sorted(per_region.collect()) == sorted(stats.region_sums(o).collect())
    columns = ["customer_id", "orders", "failures", "mean_ticket"]
    assert sorted(per_customer.select(columns).collect()) == sorted(stats.customer_sums(o).select(columns).collect())
    for table in stats.dimension_sums(o.limit(0)):
        assert table.count() == 0


def test_driver_dimension_counts_orders_without_driver_or_month_in_the_ticket_only(spark):
    o = orders(spark, [{"driver_id": 1, "items_missing": 1, "amount_cents": 100}, {"driver_id": None, "amount_cents": 300},
                       {"driver_id": 1, "date": None, "amount_cents": 500}])
    row = drv.driver_dimension(o, drivers(spark, [(1, 10)])).collect()[0]
    assert (row.total_deliveries, row.total_failures, row.total_revenue) == (1, 1, 1.0)
    assert row.estimated_failure_cost == 3.0 * 0.25


def test_risk_groups(spark):
    plan = {d: [(1, 10, d)] for d in range(1, 9)}
    groups = stats.driver_risk_groups(stats.driver_rates(_driver_orders(spark, plan)))
    cells = stats.risk_group_flags(groups)
    r = stats.mann_whitney_counts(cells, "failed", "is_high").collect()[0]
    assert (r.n1, r.n2) == (20, 20) and r.u1 + r.u2 == 400
    means = stats.risk_group_means(cells).collect()[0]
    assert (means.high_rate, means.low_rate) == (0.75, 0.15)


# ---- features

def test_prior_rate_orders_by_date_then_id(spark):
    rows = [{"order_id": 3, "date": "2023-01-02"}, {"order_id": 2, "date": "2023-01-02", "items_missing": 1},
            {"order_id": 9, "date": "2023-01-01"}, {"order_id": 4, "date": "2023-01-03"},
            {"order_id": 5, "driver_id": None, "items_missing": 1}]
    got = by_key(features.prior_failure_rate(orders(spark, rows)), "order_id", "driver_fail_rate")
    assert got == {9: 0.4, 2: 0.0, 3: 0.5, 4: pytest.approx(1 / 3), 5: 0.4}


def test_prior_rate_with_one_hot_driver(spark):
    """One driver with most orders and many orders without a driver, against a plain loop."""
    rng = random.Random(7)
    rows = [{"order_id": i, "driver_id": rng.choice([1, 1, 1, 2, 3, None]), "date": f"2023-01-{rng.randint(1, 9):02d}",
             "items_missing": int(rng.random() < 0.3)} for i in rng.sample(range(10000), 600)]
    overall = sum(r["items_missing"] for r in rows) / len(rows)
    seen, want = {}, {}
    for r in sorted(rows, key=lambda r: (r["date"], r["order_id"])):
        past = seen.setdefault(r["driver_id"], [])
        want[r["order_id"]] = sum(past) / len(past) if past and r["driver_id"] else overall
        past.append(r["items_missing"])
    got = by_key(features.prior_failure_rate(orders(spark, rows)), "order_id", "driver_fail_rate")
    assert got == pytest.approx(want)


def test_prior_rate_with_text_ids(spark):
    o = orders(spark, [{"items_missing": 1}, {}]).withColumn("order_id", F.concat(F.lit("A"), F.col("order_id")))
    got = by_key(features.prior_failure_rate(o), "order_id", "driver_fail_rate")
    assert got == {"A1": 0.5, "A2": 1.0}


def test_prior_rate_with_text_ids_and_a_third_without_driver(spark):
    """Text keys, one hot driver, and a third of all orders without a driver, all on one day."""
    rng = random.Random(8)
    rows = [{"order_id": i, "driver_id": None if n % 3 == 0 else 1, "items_missing": int(rng.random() < 0.3)}
            for n, i in enumerate(rng.sample(range(100_000, 999_999), 3000))]
    o = orders(spark, rows).withColumn("order_id", F.concat(F.lit("ORDER-2023-"), F.col("order_id").cast("string")))
    overall = sum(r["items_missing"] for r in rows) / len(rows)
    past, want = [], {}
    for r in sorted(rows, key=lambda r: r["order_id"]):
        key = f"ORDER-2023-{r['order_id']}"
        want[key] = sum(past) / len(past) if past and r["driver_id"] else overall
        if r["driver_id"]:
            past.append(r["items_missing"])
    assert by_key(features.prior_failure_rate(o), "order_id", "driver_fail_rate") == pytest.approx(want)
    chunks = distribution.with_value_chunk(o.withColumn("p", features.text_place(o, "order_id")), "p").groupBy("chunk").count()
    assert chunks.agg(F.max("count")).collect()[0][0] < 200


def test_prior_rate_puts_missing_dates_last(spark):
    rows = [{"order_id": 1, "date": None, "items_missing": 1}, {"order_id": 2, "date": "2023-01-02", "items_missing": 1},
            {"order_id": 3, "date": "2023-01-03"}]
    got = by_key(features.prior_failure_rate(orders(spark, rows)), "order_id", "driver_fail_rate")
    assert got == {2: pytest.approx(2 / 3), 3: 1.0, 1: 0.5}


def test_what_if_rows_of_unknown_drivers_get_the_overall_rate(spark):
    history = orders(spark, [{"items_missing": 1}, {}, {"driver_id": 2}, {"driver_id": None, "region": "South"}])
    rows = features.raw_risk_rows(orders(spark, [{"driver_id": 1}, {"driver_id": 77}, {"driver_id": None, "region": "South"}]), history)
    assert by_key(rows, "order_id", "driver_hist_rate") == {1: 0.5, 2: 0.25, 3: 0.25}
    assert by_key(rows, "order_id", "region_enc") == {1: 0, 2: 0, 3: 1}
    assert features.risk_features(history).count() == 4


def test_products_without_a_name_or_category_are_no_group(spark):
    items = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4)], "order_id int, product_id int")
    table = spark.createDataFrame([(1, "A", "x", 1.0), (2, None, "x", 1.0), (3, "C", None, 1.0), (4, "D", "y", None)],
                                  "product_id int, product_name string, category string, price double")
    assert by_key(products.counts_by(items, table, "product_name"), "product_name", "order_count") == {"A": 1, "C": 1, "D": 1}
    assert by_key(products.counts_by(items, table, "category"), "category", "order_count") == {"x": 2, "y": 1}
    assert column(products.top_products_table(items, table), "product_id") == [1]


def test_label_codes_and_split(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "order_id int, region string")
    assert by_key(features.label_codes(df, "region", "c"), "order_id", "c") == {1: 1, 2: 0, 3: None}
    ids = spark.range(5003).select(F.col("id").alias("order_id"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    train, test = features.split_rows(ids)
    assert train.columns == test.columns == ids.columns and train.join(test, "order_id").count() == 0
    for label, size in by_key(ids.groupBy("label").count(), "label", "count").items():
        assert abs(test.where(F.col("label") == label).count() - size / 5) <= 1
    assert train.count() + test.count() == 5003


# ---- report measures

def test_six_decimals_at_any_size(spark):
    values = [0.1234565, -0.1234565, 2.5, 1.4e13, -1.4e13, 1e18, 9.1e12, 123456789.1234567, float("inf"), float("-inf"), 0.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = column(df.select(base.six_decimals(F.col("v")).alias("r")), "r")
    assert got == [0.123457, -0.123457, 2.5, 1.4e13, -1.4e13, 1e18, 9.1e12, 123456789.123457, float("inf"), float("-inf"), 0.0, None]
    nan = spark.createDataFrame([(float("nan"),)], "v double").select(base.six_decimals(F.col("v")).alias("r"))
    assert str(column(nan, "r")[0]) == "nan"


def test_first_driver_with_large_ids(spark, tmp_path):
    rows = [(1, 1, 5_000_000_007), (1, 2, 5), (2, 3, 100_000_000), (2, 2, 1_099_511_627_775), (3, 1, None)]
    lines = spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_suppkey bigint").select(
        "*", F.lit("N").alias("l_returnflag"), F.lit(0.1).alias("l_discount"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = by_key(Deliveries(spark, str(tmp_path)).order_lines, "order_id", "driver_id")
    assert got == {1: 5_000_000_007, 2: 1_099_511_627_775, 3: None}
    lines.withColumn("l_suppkey", F.lit(1 << 40)).write.parquet(f"{tmp_path}/b/lineitem.parquet")
    with pytest.raises(Exception, match="too large"):
        Deliveries(spark, f"{tmp_path}/b").order_lines.collect()


def test_measure_of_nothing_is_zero(spark):
    o = orders(spark, [{}]).withColumn("failure_cost", F.lit(0.0))
    r = measures.measure(o, measures.fact_measures(), where=F.lit(False)).collect()[0]
    assert (r.total_orders, r.failure_rate) == (0, 0.0)


def test_unweighted_day_average(spark):
    o = orders(spark, [{"region": "A", "items_missing": 1}] + [{"region": "B"}] * 3)
    assert kpis.by_day(o).where("day_of_week = 'Monday'").collect()[0].failure_rate == 0.25
    assert measures.day_average_of_regions(kpis.region_day(o)).collect()[0].failure_rate == 0.5


def test_savings_plan(spark):
    o = orders(spark, [{"amount_cents": 40000, "items_missing": 1}, {"amount_cents": 40000}])
    got = by_key(finance.savings_plan(o, cust.customer_profile(o)), "priority", "savings")
    assert got == {1: 30.0, 2: 13.0, 3: 5.0, 4: 4.0, 5: 0.0}


def test_top_k_per_group(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 9), ("b", 4, 1)], "g string, k int, m int")
    got = column(ranking.top_k_per(df, "g", "m", "k", 2), "g", "k", "place")
    assert sorted(got) == [("a", 1, 2), ("a", 3, 1), ("b", 4, 1)]


def test_content_digest_knows_rows_but_not_their_order(spark):
    from parcelscope.operators import quality
    rows = [(1, "a", 1.5, True), (2, None, None, False), (2, None, None, False), (3, "", -0.25, None)]
    frame = lambda r: spark.createDataFrame(r, "i int, t string, d double, b boolean")
    digest = lambda r: tuple(quality.content_digest(frame(r), ["t", "i", "b", "d"]).collect()[0])
    own = digest(rows)
    assert own[0] == 4 and own == digest(rows[::-1]) == tuple(
        quality.content_digest(frame(rows).repartition(3), ["d", "b", "i", "t"]).collect()[0])
    assert len({own, digest(rows[1:]), digest([*rows[:3], (3, None, -0.25, None)]), digest([(1, "a", 1.6, True), *rows[1:]])}) == 4
    assert digest([]) == (0, None)
