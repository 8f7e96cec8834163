"""Profiles and data-quality checks of any table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import aggregates as agg


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table and column: type, rows and number of columns."""
    out = None
    for name, df in tables.items():
        fields = F.array(*[F.struct(F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"),
                                    F.lit(f.dataType.simpleString()).alias("data_type"))
                           for f in df.schema])
        rows = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.explode(fields).alias("c"), "row_count").select(
            "c.*", "row_count", F.lit(len(df.columns)).alias("column_count"))
        out = rows if out is None else out.unionByName(rows)
    return out


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, only for columns that have any, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "nulls").where("nulls > 0")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row, over all columns."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
    return copies.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
                      F.count(F.lit(1)).alias("distinct_rows"),
                      F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"))


def sample_rows(df: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    return df.orderBy(*order).limit(n)


def date_span(orders: DataFrame) -> DataFrame:
    return orders.agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"))


def validation_totals(orders: DataFrame) -> DataFrame:
    return orders.agg(agg.order_count().alias("total_orders"), agg.revenue().alias("total_revenue"),
                      agg.failure_rate().alias("missing_rate"))


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def orphan_keys(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Fact keys without a dimension row. Keys are counted first, so a hot key travels once."""
    used = fact.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return used.join(dim.select(key), key, "left_anti")


def assert_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Returns `df` unchanged; raises when the key repeats."""
    worst = repeated_keys(df, key).limit(1).collect()
    if worst:
        raise ValueError(f"key {list(key)} is not unique, for example {worst[0].asDict()}")
    return df


def quality_report(tables: dict[str, DataFrame], keys: dict[str, Sequence[str]],
                   references: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Counts of repeated keys and of orphan keys per declared key and reference."""
    parts = [repeated_keys(tables[name], key).agg(
        F.lit(f"{name}.{'+'.join(key)} unique").alias("check"),
        F.count(F.lit(1)).alias("violations")) for name, key in keys.items()]
    parts += [orphan_keys(tables[fact], tables[dim], key).agg(
        F.lit(f"{fact}.{key} in {dim}").alias("check"),
        F.count(F.lit(1)).alias("violations")) for fact, dim, key in references]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def content_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and an order-free digest of the named columns: the sum of a hash of each row's values as text.

    Doubles count in ten-thousandths, NULL as a text of its own. A row that is missing, changed or there twice
    changes the digest; rows are added up on the map side.
    """
    parts = []
    for name in sorted(columns):
        value = F.col(name)
        if isinstance(df.schema[name].dataType, DoubleType):
            value = F.floor(value * 10_000 + 0.5)
        parts.append(F.coalesce(value.cast("string"), F.lit("null")))
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(row).cast("decimal(38,0)").cast("string").alias("digest"))
