"""Joins between orders, dimensions and id lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def build_master(orders: DataFrame, customers: DataFrame, drivers: DataFrame) -> DataFrame:
    """Orders with the attributes of their customer and driver; no order is dropped.

    The stored dimensions have known sizes, so Spark itself broadcasts what fits its threshold.
    """
    crew = drivers.select("driver_id", "driver_name", "age", "trips")
    return orders.join(customers, "customer_id", "left").join(crew, "driver_id", "left")


def region_dimension(orders: DataFrame) -> DataFrame:
    """Regions numbered in name order."""
    from .ranking import dense_rank_labels
    return dense_rank_labels(orders, "region", "region_id").withColumnRenamed("region", "region_name")


def attach_region_id(orders: DataFrame, regions: DataFrame) -> DataFrame:
    """Keeps only orders whose region is known. How the join runs is decided by Spark from the sizes it meets."""
    return orders.join(regions.withColumnRenamed("region_name", "region"), "region")


def hot_keys(fact: DataFrame, key: str, parts: int = 200) -> Column:
    """Keys that hold more than 1/parts of the rows, so fewer than `parts` of them, as an array."""
    counts = fact.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("total", total).where(F.col("n") * parts > F.col("total")).agg(
        F.collect_list(key)).scalar()


def join_per_key(fact: DataFrame, per_key: DataFrame, key: str, how: str = "left", row_id: str = "order_id",
                 spread: int = 64) -> DataFrame:
    """Joins rows to a table with one row per key, when one key may hold a large part of the rows.

    Rows of hot keys, and rows without a key, are spread over several join keys by a hash of their
    id; only the few hot keys are repeated on the other side. Every other key joins as usual.
    """
    slot = F.pmod(F.xxhash64(F.col(row_id)), F.lit(spread)).cast("int")
    hot = hot_keys(fact, key)
    rows = fact.withColumn("_hot", hot).withColumn("_slot", F.when(
        F.col(key).isNull() | F.array_contains("_hot", F.col(key)), slot).otherwise(F.lit(0))).drop("_hot")
    slots = F.when(F.array_contains("_hot", F.col(key)), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(
        F.array(F.lit(0)))
    copies = per_key.withColumn("_hot", hot).withColumn("_slot", F.explode(slots)).drop("_hot")
    return rows.join(copies, [key, "_slot"], how).drop("_slot")


def semi(df: DataFrame, ids: DataFrame, key: str, row_id: str = "order_id") -> DataFrame:
    return join_per_key(df, ids.select(key).distinct(), key, "left_semi", row_id)


def anti(df: DataFrame, ids: DataFrame, key: str, row_id: str = "order_id") -> DataFrame:
    return join_per_key(df, ids.select(key).distinct(), key, "left_anti", row_id)


def member_flag(df: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """True for rows whose key is in the id list. For tables with one row per key."""
    listed = ids.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(listed, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def lookup(value: Column, table: dict, default=None) -> Column:
    """Maps a value through a small literal table."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, value), F.lit(default))
