"""Parquet, CSV and JSON sinks and the manifest of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_counted(df: DataFrame, path: str, write) -> int:
    """Writes by `write(df, path)` and returns the rows that went through, counted on the way."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")), path)
    return seen.get["rows"]


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a path, files with a header only included."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def write_csv(df: DataFrame, path: str) -> None:
    # Quotes are doubled, as `read_csv` expects.
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_processed(master: DataFrame, products: DataFrame, order_items: DataFrame, folder: str) -> dict[str, int]:
    """Rows written per table."""
    return {name: write_counted(df, f"{folder}/{name}", write_parquet)
            for name, df in {"master": master, "products": products, "order_items": order_items}.items()}


def write_star_csv(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Rows written per table."""
    return {name: write_counted(df, f"{folder}/{name}", write_csv) for name, df in tables.items()}


def document(row: DataFrame) -> DataFrame:
    """A one-row frame as one JSON text column."""
    return row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


def write_document(row: DataFrame, path: str) -> None:
    document(row).coalesce(1).write.mode("overwrite").text(path)


# fixed values: what each exported file holds; {rows} stands for its rows
DESCRIPTIONS = {
    "fct_orders": "{rows} rows — fact table", "dim_date": "{rows} rows — full calendar",
    "dim_drivers": "{rows} drivers — with tier and quadrant", "dim_customers": "{rows} customers — with churn and segment",
    "dim_regions": "{rows} regions — with KPIs", "dim_products": "{rows} products — with ranking",
    "agg_monthly_kpis": "{rows} months — MoM trend", "agg_hour_day_heatmap": "Hour × day heatmap",
    "agg_region_day": "Failure by region × day", "agg_driver_monthly": "{rows} rows — monthly performance",
    "agg_financial_impact": "Cost by intervention quadrant", "agg_top_products": "{rows} ranked products",
    "agg_retention_summary": "{rows} retention metrics", "global_kpis": "Global KPIs for reference",
}


def manifest(spark: SparkSession, folder: str, counts: dict[str, int]) -> DataFrame:
    """Name, rows, bytes and description of each written table: rows as counted at the write, bytes from the file system."""
    rows = [(name, int(n), int(bytes_of(spark, f"{folder}/{name}")), DESCRIPTIONS.get(name, "").format(rows=f"{n:,}"))
            for name, n in counts.items()]
    return spark.createDataFrame(rows, "table_name string, row_count bigint, bytes bigint, description string")
