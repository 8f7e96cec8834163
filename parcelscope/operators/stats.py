"""Rank and mean tests from distributed sums. Only one-row results reach the p-value functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands, tails
from ..functions import aggregates as agg
from ..session import written
from .customers import customer_profile
from .distribution import quantiles, running_counts
from .kpis import keyed


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r with the t statistic of a zero-correlation test."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = both.agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r")))
    return r.select("n", "r", t.alias("t"))


def with_t_p(result: DataFrame, df_shift: int) -> DataFrame:
    return result.withColumn("p_value", tails.t_two_sided(F.col("t"), F.col("n") - df_shift))


def _average_rank(n: str = "n") -> Column:
    """Mean rank of the rows that share a value."""
    return F.col(f"{n}_before") + (F.col(n) + 1) / 2


def _centred_rank() -> Column:
    """Mean rank minus the overall mean rank, which keeps sums over many rows small."""
    return _average_rank() - (F.col("n_total") + 1) / 2


def _tie_term() -> Column:
    t = F.col("n").cast("double")
    return F.sum(t * t * t - t)


def _u_from_sums(ranked: DataFrame) -> DataFrame:
    sums = ranked.agg(F.sum("n").alias("total"), F.sum("n_first").alias("n1"),
                      F.sum(F.col("n_first") * _average_rank()).alias("r1"), _tie_term().alias("ties"))
    total = F.col("total").cast("double")
    n1 = F.col("n1").cast("double")
    n2 = total - n1
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((total + 1) - F.try_divide(F.col("ties"), total * (total - 1))))
    table = sums.select("n1", (F.col("total") - F.col("n1")).alias("n2"), u1.alias("u1"),
                        (n1 * n2 - u1).alias("u2"), (n1 * n2 / 2).alias("mean"), spread.alias("sigma"))
    above = lambda u: F.try_divide(u - F.col("mean") - 0.5, F.col("sigma"))
    return table.select("n1", "n2", "u1", "u2", above(F.greatest("u1", "u2")).alias("z_two_sided"),
                        above(F.col("u1")).alias("z_greater"))


def _h_from_sums(per_group: DataFrame, pooled: DataFrame) -> DataFrame:
    groups = per_group.agg(
        F.count(F.lit(1)).alias("groups"), F.sum("size").alias("n"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("size")).alias("weighted"))
    n = F.col("n").cast("double")
    raw = F.try_divide(F.lit(12.0), n * (n + 1)) * F.col("weighted")
    corrected = F.try_divide(raw, 1 - F.try_divide(F.col("ties"), n * n * n - n))
    return groups.withColumn("ties", pooled.agg(_tie_term()).scalar()).select(
        "groups", "n", corrected.alias("h"), (F.col("groups") - 1).alias("df"))


def mann_whitney(df: DataFrame, value: str, first: Column) -> DataFrame:
    """U of the rows where `first` is true against the rows where it is false.

    Ranks are taken per distinct value, with ties sharing their mean rank; z_two_sided and
    z_greater carry the continuity correction.
    """
    flagged = df.select(F.col(value).alias("v"), first.alias("first")).where("v IS NOT NULL AND first IS NOT NULL")
    counts = flagged.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.count_if("first").alias("n_first"))
    return _u_from_sums(running_counts(counts, "v"))


def with_mann_whitney_p(result: DataFrame, alternative: str) -> DataFrame:
    if alternative == "two-sided":
        p = F.least(tails.normal_upper(F.col("z_two_sided")) * 2, F.lit(1.0))
    else:
        p = tails.normal_upper(F.col("z_greater"))
    return result.withColumn("p_value", p)


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """Tie-corrected H over the groups of a column. Rows are counted per value and group first."""
    cells = keyed(df, value, group).groupBy(F.col(value).alias("v"), F.col(group).alias("g")).agg(
        F.count(F.lit(1)).alias("cell"))
    pooled = running_counts(cells.groupBy("v").agg(F.sum("cell").alias("n")), "v").select(
        "v", "n", _centred_rank().alias("rank"))
    per_group = cells.join(pooled.select("v", "rank"), "v").groupBy("g").agg(
        F.sum("cell").alias("size"), F.sum(F.col("cell") * F.col("rank")).alias("rank_sum"))
    return _h_from_sums(per_group, pooled)


def with_chi2_p(result: DataFrame) -> DataFrame:
    return result.withColumn("p_value", tails.chi2_upper(F.col("h"), F.col("df")))


def paired_t(df: DataFrame, first: str, second: str) -> DataFrame:
    d = F.col(first) - F.col(second)
    sums = df.agg(F.count(d).alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("std"))
    return sums.select("n", "mean_difference",
                       F.try_divide(F.col("mean_difference"), F.col("std") / F.sqrt("n")).alias("t"))


def driver_rates(orders: DataFrame, min_deliveries: int = 10) -> DataFrame:
    return enough_deliveries(keyed(orders, "driver_id").groupBy("driver_id").agg(
        agg.order_count().alias("deliveries"), agg.failure_count().alias("failures"),
        agg.failure_rate().alias("rate")), min_deliveries)


def enough_deliveries(per_driver: DataFrame, min_deliveries: int = 10) -> DataFrame:
    return per_driver.where(F.col("deliveries") >= min_deliveries)


def driver_risk_groups(rates: DataFrame) -> DataFrame:
    """Drivers in the upper and the lower quartile of the rates; a driver can be in both."""
    cuts = quantiles(rates, "rate", [0.25, 0.75]).select(F.struct("*"))
    return rates.withColumn("cut", cuts.scalar()).select(
        "driver_id", "deliveries", "failures", "rate",
        (F.col("rate") >= F.col("cut.q75")).alias("high"), (F.col("rate") <= F.col("cut.q25")).alias("low"))


def risk_group_flags(groups: DataFrame) -> DataFrame:
    """Order flags of both groups as counts: (is_high, failed, n). Built from the driver sums."""
    sides = F.array(*[F.struct(F.lit(side == "high").alias("is_high"), F.col(side).alias("member"))
                      for side in ("high", "low")])
    members = groups.select(F.explode(sides).alias("s"), "deliveries", "failures").where("s.member")
    flags = F.array(F.struct(F.lit(1).alias("failed"), F.col("failures").alias("n")),
                    F.struct(F.lit(0).alias("failed"), (F.col("deliveries") - F.col("failures")).alias("n")))
    return members.select("s.is_high", F.explode(flags).alias("f")).groupBy("is_high", "f.failed").agg(
        F.sum("f.n").alias("n"))


def mann_whitney_counts(cells: DataFrame, value: str, first: str) -> DataFrame:
    """Mann-Whitney on counted rows (value, first, n) whose values are flags."""
    counts = cells.groupBy(F.col(value).alias("v")).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col(first), F.col("n"))), F.lit(0)).alias("n_first"))
    return _u_from_sums(running_counts(counts, "v", few=True))


def risk_group_means(cells: DataFrame) -> DataFrame:
    failed = lambda side: F.sum(F.when(side & (F.col("failed") == 1), F.col("n")))
    rows = lambda side: F.sum(F.when(side, F.col("n")))
    high = F.col("is_high")
    means = cells.agg((failed(high) / rows(high)).alias("high_rate"), (failed(~high) / rows(~high)).alias("low_rate"))
    return means.withColumn("gap_pp", (F.col("high_rate") - F.col("low_rate")) * 100)


def customer_sums(orders: DataFrame) -> DataFrame:
    return keyed(orders, "customer_id").groupBy("customer_id").agg(*_sums()).withColumn("mean_ticket", _mean_ticket())


def order_value_quartiles(orders: DataFrame) -> DataFrame:
    """Orders and failures per customer with the quartile of the customer's mean ticket.

    Cut points weigh every customer by its orders, as quartiles over order rows do, but only one
    row per customer is moved.
    """
    return value_quartiles(customer_sums(orders))


def value_quartiles(per_customer: DataFrame) -> DataFrame:
    counts = per_customer.groupBy("mean_ticket").agg(F.sum("orders").alias("n"))
    run = running_counts(counts, "mean_ticket")
    last = F.col("n_total") - 1
    at = lambda rank: F.min(F.when(F.col("n_before") + F.col("n") > rank, F.col("mean_ticket")))
    cut = lambda q: at(F.floor(last * q)) + (at(F.ceil(last * q)) - at(F.floor(last * q))) * (
        F.max(last * q) - F.floor(F.max(last * q)))
    cuts = run.agg(F.struct(*[cut(q).alias(f"q{round(q * 100)}") for q in (0.25, 0.5, 0.75)]).alias("cut"))
    return per_customer.withColumn("cut", cuts.scalar()).select(
        "customer_id", "orders", "failures", "mean_ticket", bands.value_quartile(
            F.col("mean_ticket"), F.col("cut.q25"), F.col("cut.q50"), F.col("cut.q75")).alias("value_segment"))


def customer_age_sums(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return with_age_group(customer_sums(orders), customers)


def with_age_group(per_customer: DataFrame, customers: DataFrame) -> DataFrame:
    return per_customer.select("customer_id", "orders", "failures").join(customers, "customer_id").withColumn(
        "age_group", bands.age_band_right(F.col("customer_age")))


def _sums() -> list[Column]:
    return [agg.order_count().alias("orders"), agg.failure_count().alias("failures"), agg.failure_rate().alias("rate"),
            F.sum("amount_cents").alias("cents"), F.count("amount_cents").alias("priced")]


def _mean_ticket() -> Column:
    return F.round(F.col("cents") / 100.0 / F.col("priced"), 9)


def dimension_sums(orders: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sums per driver, per region and per customer from one pass over the orders, written and read back.

    Every order is counted in three groups side by side; rows without a key are left out of its groups.
    """
    keys = ["driver_id", "region", "customer_id"]
    counted = orders.select(*keys, "order_id", "has_missing", "amount_cents").groupingSets([[k] for k in keys], *keys).agg(
        F.grouping_id().alias("others"), *_sums())
    table = written(counted, "dimension_sums")
    by = lambda key: keyed(table.where(F.col("others") == 7 - (4 >> keys.index(key))), key)
    drivers = by("driver_id").withColumnRenamed("orders", "deliveries").select("driver_id", "deliveries", "failures", "rate")
    return (drivers, by("region").select("region", "orders", "failures"), by("customer_id").select(
        "customer_id", "orders", "failures", _mean_ticket().alias("mean_ticket")))


def grouped_flags(sums: DataFrame, group: str) -> DataFrame:
    """(group, failed, n) from any table with orders and failures per row."""
    flags = F.array(F.struct(F.lit(1).alias("failed"), F.col("failures").alias("n")),
                    F.struct(F.lit(0).alias("failed"), (F.col("orders") - F.col("failures")).alias("n")))
    return keyed(sums, group).groupBy(group).agg(
        F.sum("orders").alias("orders"), F.sum("failures").alias("failures")).select(
        F.col(group).alias("g"), F.explode(flags).alias("f")).select("g", "f.failed", "f.n").where("n > 0")


def kruskal_counts(cells: DataFrame) -> DataFrame:
    """Kruskal-Wallis on counted rows (g, failed, n)."""
    pooled = running_counts(cells.groupBy(F.col("failed").alias("v")).agg(F.sum("n").alias("n")), "v", few=True).select(
        "v", "n", _centred_rank().alias("rank"))
    per_group = cells.join(pooled.select(F.col("v").alias("failed"), "rank"), "failed").groupBy("g").agg(
        F.sum("n").alias("size"), F.sum(F.col("n") * F.col("rank")).alias("rank_sum"))
    return _h_from_sums(per_group, pooled)


def frequency_test(orders: DataFrame) -> DataFrame:
    """Orders per active month: customers without a failure against customers with one."""
    return mann_whitney(customer_profile(orders), "orders_per_month", ~F.col("had_failure"))


def region_sums(orders: DataFrame) -> DataFrame:
    return keyed(orders, "region").groupBy("region").agg(
        agg.order_count().alias("orders"), agg.failure_count().alias("failures"))


def test_table(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Which dimension separates failing from good orders."""
    per_driver, per_region, per_customer = dimension_sums(orders)
    cells = risk_group_flags(driver_risk_groups(enough_deliveries(per_driver)))
    drivers = with_mann_whitney_p(mann_whitney_counts(cells, "failed", "is_high"), "greater").select(
        F.col("u1").alias("statistic"), "p_value")
    by_group = lambda sums, g: with_chi2_p(kruskal_counts(grouped_flags(sums, g))).select(
        F.col("h").alias("statistic"), "p_value")
    parts = [("Driver (high vs. low risk)", "Driver", "Mann-Whitney U", drivers),
             ("Region", "Location", "Kruskal-Wallis", by_group(per_region, "region")),
             ("Age Group", "Customer", "Kruskal-Wallis",
              by_group(with_age_group(per_customer, customers), "age_group")),
             ("Value Segment", "Customer", "Kruskal-Wallis",
              by_group(value_quartiles(per_customer), "value_segment"))]
    out = None
    for dimension, category, test, row in parts:
        one = row.select(F.lit(dimension).alias("dimension"), F.lit(category).alias("category"),
                         F.lit(test).alias("test"), "statistic", "p_value")
        out = one if out is None else out.unionByName(one)
    return out.withColumns({
        "significant": bands.significance(F.col("p_value")), "label": bands.p_text(F.col("p_value"))})


def variance_comparison(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Spread of failure rates across drivers, regions, age bands and value segments."""
    per_driver, per_region, per_customer = dimension_sums(orders)
    rate = lambda sums, g: keyed(sums, g).groupBy(g).agg(
        (F.sum("failures") / F.sum("orders")).alias("rate"))
    parts = [("Driver (individual)", enough_deliveries(per_driver)), ("Region", rate(per_region, "region")),
             ("Age Group", rate(with_age_group(per_customer, customers), "age_group")),
             ("Value Segment", rate(value_quartiles(per_customer), "value_segment"))]
    out = None
    for name, table in parts:
        one = table.agg(F.lit(name).alias("dimension"), F.max("rate").alias("maximum"),
                        F.min("rate").alias("minimum"), F.stddev_samp("rate").alias("std"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("range_pp", agg.half_even((F.col("maximum") - F.col("minimum")) * 100, 1))
