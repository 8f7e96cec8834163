"""Top-k lists and ranks over dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, metric: str, key: str, k: int, largest: bool = True) -> DataFrame:
    """First k rows by metric; equal metrics are ordered by key."""
    order = F.desc(metric) if largest else F.asc(metric)
    return df.orderBy(order, F.asc(key)).limit(k)


def top_k_per(df: DataFrame, by: str, metric: str, key: str, k: int) -> DataFrame:
    """First k rows of every group, with their place."""
    place = Window.partitionBy(by).orderBy(F.desc(metric), F.asc(key))
    return df.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def label_place(value: Column, labels: Column, first: int = 0) -> Column:
    """Place of a label in a sorted array of all labels; NULL stays NULL.

    For columns of a few labels: the array is one scalar sub-query, so no row is joined or moved.
    """
    return (F.array_position(labels, value) - 1 + first).cast("int")


def dense_rank_labels(df: DataFrame, label: str, code: str, first: int = 1) -> DataFrame:
    """Distinct labels numbered in alphabetical order. The window runs over the labels only."""
    labels = df.select(label).where(F.col(label).isNotNull()).distinct()
    return labels.withColumn(code, (F.dense_rank().over(Window.orderBy(label)) + (first - 1)).cast("int"))
