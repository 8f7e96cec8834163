"""Every catalog query against its SQL, documents, sinks and plan shapes."""

import json

import pytest
from pyspark.sql import functions as F

from parcelscope import catalog
from parcelscope.operators import joins, kpis, stats
from parcelscope.plans import report, star
from parcelscope.session import sized_for
from parcelscope.sources import readers, schemas, writers
from parcelscope.sources.lens import Deliveries

from compare import compare, connect

# Each writes thirteen tables or trains models; the model ones have tests of their own.
SLOW = {"k2_star_csv_sink", "k7_file_manifest", "k5_model_document"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(n for n in catalog.ORACLE if n not in SLOW))
def test_query_equals_sql(spark, con, sf, name):
    assert compare(spark, con, catalog.QUERIES[name], catalog.ORACLE[name], sf) == ""


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_results_do_not_depend_on_partitions(spark, con, sf, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for name in ("d1_driver_dimension", "d2_customer_dimension", "w2_prior_failure_rate", "g17_quadrant_cohort"):
            assert compare(spark, con, catalog.QUERIES[name], catalog.ORACLE[name], sf) == "", name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_results_hold_without_broadcast(spark, con, sf):
    """The plans must also be right when no table is small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("a7_region_dimension", "d1_driver_dimension", "d4_fact_orders_typed", "j1_master", "l1_feature_table"):
            assert compare(spark, con, catalog.QUERIES[name], catalog.ORACLE[name], sf) == "", name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_report_document(spark, sf):
    t = Deliveries(spark, sf)
    text = writers.document(report.report_document(t.orders, t.customers, t.drivers)).collect()[0].document
    doc = json.loads(text)
    assert [d["day"] for d in doc["days_of_week"]][0] == "Monday" and len(doc["days_of_week"]) == 7
    assert sum(r["orders"] for r in doc["regions"]) == doc["kpis"]["total_orders"] == 1500
    rates = [r["failure_rate"] for r in doc["regions"]]
    assert rates == sorted(rates, reverse=True)
    months = [m["month"] for m in doc["monthly_trend"]]
    assert months == sorted(months)
    assert [p["priority"] for p in doc["action_plan"]] == [1, 2, 3, 4, 5]
    assert doc["retention"]["churned_customers"] == 17 and len(doc["worst_drivers"]) == 10


def test_kpi_document_fields(spark, sf):
    t = Deliveries(spark, sf)
    doc = json.loads(writers.document(star.global_kpis(t.orders, t.customers, t.drivers)).collect()[0].document)
    assert len(doc) == 19 and doc["total_failures"] == 257 and doc["customer_churn_count"] == 17


def test_run_document_fields(spark, sf):
    t = Deliveries(spark, sf)
    doc = json.loads(writers.document(report.run_summary(t.orders, t.drivers)).collect()[0].document)
    assert len(doc) == 16 and 0 <= doc["pvalue"] <= 1


def test_model_document(spark, sf):
    t = Deliveries(spark, sf)
    shares = spark.createDataFrame([("Driver", 0.3, 60.0, "critical"), ("Customer", 0.2, 40.0, "warning")],
                                   "category string, mean_abs double, pct double, level string")
    summary = report.conclusion(shares, stats.variance_comparison(t.orders, t.customers), 0.79)
    doc = json.loads(writers.document(report.model_document(
        shares, stats.test_table(t.orders, t.customers), summary)).collect()[0].document)
    assert doc["conclusion"]["driver_vs_client_ratio"] == 2.0
    assert [c["category"] for c in doc["shap_categories"]] == ["Driver", "Customer"]
    assert len(doc["statistical_tests"]) == 4


def test_csv_round_trip_with_quotes(spark, tmp_path):
    rows = [("P1", 'Say "hi", now', "Food", "$1,000.50"), ("P2", "Plain", None, "$2.00")]
    df = spark.createDataFrame(rows, schemas.PRODUCTS)
    writers.write_csv(df, f"{tmp_path}/products.csv")
    back = readers.read_csv(spark, f"{tmp_path}/products.csv", schemas.PRODUCTS)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_cached_source(spark, tmp_path):
    path, calls = f"{tmp_path}/cached", []

    def build():
        calls.append(1)
        return spark.range(3)

    writers.write_parquet(readers.cached_or_built(spark, path, build), path)
    assert readers.cached_or_built(spark, path, build).count() == 3 and len(calls) == 1


def test_missing_document_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_document(spark, f"{tmp_path}/none", "a int")


def test_partition_settings_grow_with_the_input():
    small, large = sized_for(1 << 30), sized_for(100 << 40)
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert 10_000 < int(large["spark.sql.shuffle.partitions"]) <= 50_000
    assert int(large["spark.sql.files.maxPartitionBytes"]) > int(small["spark.sql.files.maxPartitionBytes"])


# ---- plan shapes

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_not_read_when_unused(spark, sf):
    text = plan(kpis.revenue_by_region(Deliveries(spark, sf).orders))
    assert "l_orderkey" not in text and "o_totalprice" in text


def test_scans_read_only_needed_columns(spark, sf):
    text = plan(Deliveries(spark, sf).orders.groupBy("month").agg(F.sum("amount_cents")))
    assert "o_orderpriority" not in text and "c_acctbal" not in text


def test_no_cross_joins(spark, sf):
    t = Deliveries(spark, sf)
    for df in (kpis.region_dimension_kpis(t.orders), star.fact_orders(t.orders), kpis.monthly_kpis(t.orders),
               joins.build_master(t.orders, t.customers, t.drivers)):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_fact_table_needs_no_shuffle_for_its_cost(spark, sf):
    """The average ticket is a sub-query, not a join against the orders."""
    t = Deliveries(spark, sf)
    plain = t.orders.select("order_id", "has_missing")
    assert plan(star.fact_orders(t.orders)).count("Join") >= plan(plain).count("Join")
    assert "Subquery" in plan(star.fact_orders(t.orders))
