"""Line-item counts per product. Lines are counted per product before products are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def product_counts(order_items: DataFrame) -> DataFrame:
    return order_items.where(F.col("product_id").isNotNull()).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("order_count"))


def counted(order_items: DataFrame, products: DataFrame) -> DataFrame:
    return product_counts(order_items).join(products, "product_id")


def items_by_category(order_items: DataFrame, products: DataFrame) -> DataFrame:
    return counted(order_items, products).where(F.col("category").isNotNull()).groupBy("category").agg(
        F.sum("order_count").alias("count")).orderBy(F.desc("count"), "category")


def counts_by(order_items: DataFrame, products: DataFrame, *names: str) -> DataFrame:
    """Lines per combination of product attributes; products that lack one of them are left out."""
    return counted(order_items, products).na.drop(subset=list(names)).groupBy(*names).agg(
        F.sum("order_count").alias("order_count"))


def top_by_name(order_items: DataFrame, products: DataFrame, *names: str, k: int = 10) -> DataFrame:
    return counts_by(order_items, products, *names).orderBy(F.desc("order_count"), *names).limit(k)


def top_products_table(order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Products with at least one line and the revenue at list price; incomplete products are left out."""
    return counted(order_items, products).na.drop(subset=["product_name", "category", "price"]).select(
        "product_id", "product_name", "category", "price", "order_count",
        (F.col("order_count") * F.col("price")).alias("revenue_generated"))


def product_dimension(order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Every product; those without lines count 0."""
    joined = products.join(product_counts(order_items), "product_id", "left")
    count = F.coalesce("order_count", F.lit(0))
    return joined.select("product_id", "product_name", "category", "price", count.alias("order_count"),
                         (count * F.col("price")).alias("revenue_potential"))
