"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

All queries run once untimed, then BENCH_REPEATS (1) more times; a query's figure is its median.
Results are computed in full and thrown away by the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from parcelscope import catalog
from parcelscope.session import get_session

HEADLINE = [
    "a1_executive_kpis", "a3_monthly_kpis", "a6_region_quality", "a7_region_dimension", "a10_hour_day_table",
    "a13_region_hour", "a16_ticket_by_age", "a19_product_dimension", "a22_driver_monthly", "a26_tier_stats",
    "a32_order_frequency", "a33_churn_by_failures", "a38_variance_comparison", "d1_driver_dimension",
    "d2_customer_dimension", "d3_fact_orders", "d4_fact_orders_typed", "d7_recovery", "d10_return_rates",
    "d14_spend_change", "d17_savings_plan", "e8_sliced_measures", "g17_quadrant_cohort", "j1_master",
    "l1_feature_table", "p3_duplicate_rows", "p6_describe", "r1_pivot_region_hour_rate", "r4_unpivot_missing_items",
    "t4_worst_per_region", "w2_prior_failure_rate", "x2_order_frequency_u", "x3_driver_risk_u", "x5_paired_t",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = get_session("parcelscope-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in HEADLINE:
        run(name)
    seconds = {name: round(statistics.median(run(name) for _ in range(repeats)), 3) for name in HEADLINE}
    print(json.dumps({"metric": "headline queries, total of medians", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
