"""Summary documents assembled from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import bands
from ..operators import customers as cust
from ..operators import drivers as drv
from ..operators import finance, kpis, stats

# fixed values: name, description, decimals of the statistic and decimals of the p-value of each test in the model document;
# a test with four decimals says "p < 0.001" for less
TEST_RECORDS = {
    "Driver (high vs. low risk)": ("mann_whitney_drivers", "High risk (>=Q75) vs. Low risk (<=Q25) among drivers", 2, 4),
    "Age Group": ("kruskal_age_groups", "Failure rate by customer age group", 4, 3),
    "Value Segment": ("kruskal_value_segments", "Failure rate by customer value segment", 4, 3),
    "Region": ("kruskal_regions", "Failure rate across regions", 2, 4),
}
# fixed values: what each action of the plan brings
IMPACTS = {1: "30% reduction in failure cost", 2: "-2pp in failure rate", 3: "Reduction of the worst failure window"}

# fixed value: the statement that closes the model results
VERDICT = "The problem lies with the drivers — not the customers."


def rows_as_array(df: DataFrame, order: str) -> Column:
    """A small ordered table as an array of structs, for nesting in a document."""
    columns = [F.col(order).alias("_order"), *[F.col(c) for c in df.columns if c != order]]
    listed = F.array_sort(F.collect_list(F.struct(*columns)))
    names = [c for c in df.columns if c != order]
    return df.agg(F.transform(listed, lambda r: F.struct(*[r[n].alias(n) for n in names]))).scalar()


def run_summary(orders: DataFrame, drivers: DataFrame) -> DataFrame:
    """Sixteen headline results in one row."""
    regions = kpis.amounts_by(orders, "region").select("region", "failure_rate")
    region = kpis.extremes(regions, "region", "failure_rate").select(F.struct("*")).scalar()
    days = kpis.by_day(orders).where("failure_rate IS NOT NULL")
    day = days.agg(F.min_by(F.struct("day_of_week", "failure_rate"),
                            F.struct(-F.col("failure_rate"), F.col("day_ord")))).scalar()
    first = lambda worst: drv.ranked_drivers(orders, drivers, 1, 5, worst).agg(
        F.first(F.struct("driver_name", "failure_rate"))).scalar()
    corr = stats.correlation(orders, "items_delivered", "items_missing").select(F.struct("*")).scalar()
    row = kpis.global_totals(orders).withColumns({
        "region": region, "day": day, "worst": first(True), "best": first(False), "c": corr})
    with_p = stats.with_t_p(row.withColumns({"t": F.col("c.t"), "n": F.col("c.n")}), 2)
    return with_p.select(
        F.col("orders").alias("total_orders"), (F.col("cents") / 100.0).alias("total_revenue"), "avg_ticket",
        F.col("failure_rate").alias("missing_rate"), F.col("region.worst_region").alias("worst_region"),
        F.col("region.worst_region_rate").alias("worst_region_rate"),
        F.col("region.best_region").alias("best_region"), F.col("region.best_region_rate").alias("best_region_rate"),
        F.col("day.day_of_week").alias("worst_day"), F.col("day.failure_rate").alias("worst_day_rate"),
        F.col("worst.driver_name").alias("worst_driver"), F.col("worst.failure_rate").alias("worst_driver_rate"),
        F.col("best.driver_name").alias("best_driver"), F.col("best.failure_rate").alias("best_driver_rate"),
        F.col("c.r").alias("corr"), F.col("p_value").alias("pvalue"))


def conclusion(categories: DataFrame, variance: DataFrame, model_auc: float) -> DataFrame:
    """What the attribution and the spread of rates say, in one row."""
    pct = lambda name: F.max(F.when(F.col("category") == name, F.col("pct")))
    shares = categories.agg(pct("Driver").alias("driver"), pct("Customer").alias("client"))
    of = lambda name, column: F.max(F.when(F.col("dimension") == name, F.col(column)))
    ranges = variance.agg(F.struct(
        of("Driver (individual)", "range_pp").alias("driver_range_pp"), of("Age Group", "range_pp").alias("age_range_pp"),
        of("Driver (individual)", "maximum").alias("worst"), of("Driver (individual)", "minimum").alias("best"))).scalar()
    return shares.withColumn("v", ranges).select(
        F.lit(round(model_auc, 4)).alias("model_auc"), agg.half_even("driver", 1).alias("driver_shap_pct"),
        agg.half_even("client", 1).alias("client_shap_pct"),
        agg.half_even(F.try_divide("driver", "client"), 0).alias("driver_vs_client_ratio"),
        F.col("v.driver_range_pp").alias("driver_range_pp"), F.col("v.age_range_pp").alias("age_range_pp"),
        agg.half_even(F.col("v.worst") * 100, 1).alias("worst_driver_rate"),
        agg.half_even(F.col("v.best") * 100, 1).alias("best_driver_rate"), F.lit(VERDICT).alias("verdict"))


def model_document(categories: DataFrame, tests: DataFrame, summary: DataFrame) -> DataFrame:
    """Model results: attribution by category, tests and conclusion as one nested row."""
    shares = categories.select(F.struct((-F.col("pct")).alias("k"), "category").alias("place"), "category",
                               agg.half_even("pct", 1).alias("pct"), "level")
    return summary.select(F.struct("*").alias("conclusion")).withColumns({
        "shap_categories": rows_as_array(shares, "place"), "statistical_tests": test_records(tests)})


def test_records(tests: DataFrame) -> Column:
    """The four tests as one struct with a field each."""
    fields = []
    for dimension, (name, description, digits, decimals) in TEST_RECORDS.items():
        p = F.col("p_value")
        label = bands.p_text(p) if decimals == 4 else F.format_string(f"p = %.{decimals}f", p)
        record = F.struct("test", F.lit(description).alias("description"), agg.half_even("statistic", digits).alias("statistic"),
                          "p_value", (p < 0.05).alias("significant"), label.alias("label"))
        fields.append(F.max(F.when(F.col("dimension") == dimension, record)).alias(name))
    return tests.agg(F.struct(*fields)).scalar()


def report_document(orders: DataFrame, customers: DataFrame, drivers: DataFrame,
                    model_results: DataFrame | None = None, project: str = "Delivery quality") -> DataFrame:
    """The dashboard document: nested KPIs, regions, months, days, periods, tiers, drivers,
    retention and plan in one row. Every nested list is a finished small summary."""
    r1 = lambda c: agg.half_even(F.col(c) * 100, 1)
    g = kpis.global_scalar(orders)
    profile = cust.customer_profile(orders)

    regions = orders.where(F.col("region").isNotNull()).groupBy("region").agg(
        agg.order_count().alias("orders"), agg.revenue().alias("revenue"),
        agg.failure_rate().alias("rate")).withColumn("g", g).select(
        F.struct((-F.col("rate")).alias("k"), "region").alias("place"), "region", "orders",
        agg.half_even("revenue", 2).alias("revenue"), r1("rate").alias("failure_rate"),
        agg.half_even((F.col("rate") - F.col("g.failure_rate")) * 100, 1).alias("vs_avg_pp"),
        bands.status(F.col("rate"), F.col("g.failure_rate")).alias("status"))
    months = kpis.monthly_trend(orders).select(
        F.col("month").alias("place"), "month", F.col("total_orders").alias("orders"),
        agg.half_even("total_revenue", 2).alias("revenue"), r1("failure_rate").alias("failure_rate"))
    days = kpis.by_day(orders).select(F.col("day_ord").alias("place"), F.col("day_of_week").alias("day"),
                                      r1("failure_rate").alias("failure_rate"), "status")
    periods = kpis.period_quality(orders).select(F.col("period_ord").alias("place"), "period",
                                                 r1("failure_rate").alias("failure_rate"))
    tiers = drv.tier_stats_by_driver(orders, drivers).select(
        bands.label_order(F.col("tier"), bands.TIER_LABELS_REPORT).alias("place"), "tier", "drivers",
        r1("failure_rate").alias("failure_rate"), agg.half_even("cost", 2).alias("cost"))
    worst = drv.ranked_drivers(orders, drivers, 10).select(
        F.struct((-F.col("failure_rate")).alias("k"), "driver_id").alias("place"), "driver_name",
        r1("failure_rate").alias("failure_rate"), "deliveries",
        bands.experience_tier(F.col("trips"), bands.TIER_LABELS_REPORT).alias("tier"))
    best = kpis.extremes(kpis.amounts_by(orders, "region").select("region", "failure_rate"), "region", "failure_rate").select(
        "best_region").scalar()
    impact = F.when(F.col("place") == 4, F.concat(F.lit("Alignment to "), best, F.lit(" benchmark"))).when(
        F.col("place") == 5, F.concat(F.lit("Recover $"), F.format_number("savings", 0), F.lit(" in revenue")))
    for place, text in IMPACTS.items():
        impact = impact.when(F.col("place") == place, F.lit(text))
    plan = finance.savings_plan(orders, profile).withColumnRenamed("priority", "place").withColumn(
        "priority", F.col("place")).withColumn("impact", impact)
    meta = orders.agg(F.struct(
        F.lit(project).alias("project"), F.concat_ws("–", F.min("month"), F.max("month")).alias("period"),
        F.countDistinct("region").alias("regions"))).scalar()

    base, back, risk = cust.affected_base(profile), cust.return_rates(profile), cust.revenue_at_risk(profile)
    one = lambda df: df.select(F.struct("*")).scalar()
    kpi_row = kpis.executive_kpis(orders).withColumn("g", g).select(
        "total_orders", agg.half_even("total_revenue", 2).alias("total_revenue"), agg.half_even("avg_ticket", 2).alias("avg_ticket"),
        r1("failure_rate").alias("failure_rate_pct"), "total_failures",
        agg.half_even(F.col("g.failures") * F.col("g.cost_per_failure"), 2).alias("total_failure_cost"),
        "total_drivers", "total_customers", "total_regions",
        agg.half_even("g.cost_per_failure", 2).alias("cost_per_failure"))
    document = kpi_row.select(meta.alias("meta"), F.struct("*").alias("kpis")).withColumns({
        "regions": rows_as_array(regions, "place"), "monthly_trend": rows_as_array(months, "place"),
        "days_of_week": rows_as_array(days, "place"), "periods_of_day": rows_as_array(periods, "place"),
        "driver_tiers": rows_as_array(tiers, "place"), "worst_drivers": rows_as_array(worst, "place"),
        "b": one(base), "back": one(back), "risk": one(risk), "action_plan": rows_as_array(plan, "place")})
    document = document.withColumn("retention", F.struct(
        F.col("b.total_customers").alias("total_customers"),
        F.col("b.customers_with_failure").alias("customers_with_failure"),
        agg.half_even("b.pct_affected", 1).alias("pct_affected"),
        agg.half_even("back.return_rate", 1).alias("return_rate_after_failure"),
        F.col("risk.churned_customers").alias("churned_customers"),
        agg.half_even("risk.revenue_at_risk", 2).alias("revenue_at_risk"))).drop("b", "back", "risk")
    if model_results is not None:
        m = lambda path: F.col(f"m.{path}")
        proof = F.concat(F.lit("Mann-Whitney "), m("statistical_tests.mann_whitney_drivers.label"),
                         F.lit(" (drivers) vs Kruskal-Wallis "), m("statistical_tests.kruskal_age_groups.label"),
                         F.lit(" (customers by age)"))
        document = document.withColumn("m", one(model_results)).withColumns({
            "shap_categories": m("shap_categories"),
            "conclusion": F.struct(
                m("conclusion.verdict"), m("conclusion.driver_shap_pct"), m("conclusion.client_shap_pct"),
                m("conclusion.driver_vs_client_ratio").cast("int").alias("driver_vs_client_ratio"),
                m("conclusion.worst_driver_rate"), m("conclusion.best_driver_rate"), m("conclusion.model_auc"),
                proof.alias("statistical_proof"), m("statistical_tests"))}).drop("m")
    return document


def region_detail(orders: DataFrame, region: Column | None = None) -> DataFrame:
    """Figures of every region, or of the one that matches the filter."""
    chosen = orders if region is None else orders.where(region)
    table = kpis.region_summary(chosen).withColumn("g", kpis.global_scalar(orders))
    return table.select("region", "total_orders", "total_revenue", "missing_rate", "avg_ticket",
                        (F.col("missing_rate") > F.col("g.failure_rate")).alias("above_average"))
