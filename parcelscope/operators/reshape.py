"""Wide and long forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOURS = list(range(24))


def pivot_hours(df: DataFrame, rows: str, value: Column, fill: float = 0) -> DataFrame:
    """One column per hour 0..23; cells without rows hold `fill`."""
    wide = df.where(F.col(rows).isNotNull()).groupBy(rows).pivot("delivery_hour", HOURS).agg(value)
    names = {str(h): f"h{h:02d}" for h in HOURS}
    return wide.select(rows, *[F.coalesce(F.col(f"`{h}`"), F.lit(fill)).alias(n) for h, n in names.items()])


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def unpivot_missing_items(wide: DataFrame) -> DataFrame:
    """Up to three product columns per order as rows with their position; empty places are dropped."""
    places = [c for c in wide.columns if c.startswith("product_id_")]
    long = wide.unpivot(["order_id"], places, "place", "product_id").where(F.col("product_id").isNotNull())
    return long.select("order_id", "product_id",
                       F.replace("place", F.lit("product_id_"), F.lit("")).cast("tinyint").alias("position"))
