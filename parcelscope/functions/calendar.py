"""Calendar spine and calendar attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cleaning import DAYS, date_key, day_name, year_month


def days_spine(span: DataFrame, start: str = "first_day", end: str = "last_day") -> DataFrame:
    """One row per day between two date columns of a one-row frame, both ends included."""
    return span.select(
        F.explode(F.sequence(F.col(start), F.col(end), F.expr("INTERVAL 1 DAY"))).alias("date"))


def numbered_days(span: DataFrame, start: str = "first_day", end: str = "last_day") -> DataFrame:
    """The same spine built from day offsets counted from the first day."""
    offsets = span.select(
        F.col(start).alias("origin"),
        F.explode(F.sequence(F.lit(0), F.datediff(F.col(end), F.col(start)))).alias("number"))
    return offsets.select("number", F.date_add("origin", F.col("number")).alias("full_date"))


def date_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.lit(start).cast("date").alias("first_day"),
                                 F.lit(end).cast("date").alias("last_day"))


def day_number(date: Column) -> Column:
    """Monday = 1 .. Sunday = 7."""
    return F.weekday(date) + 1


def semester(date: Column) -> Column:
    return F.when(F.month(date) <= 6, "H1").otherwise("H2")


def us_week(date: Column) -> Column:
    """Week of the year when weeks start on Sunday and week 1 holds 1 January."""
    lead = F.dayofweek(F.trunc(date, "YEAR")) - 1
    return F.ceil((F.dayofyear(date) + lead) / 7).cast("int")


def calendar(days: DataFrame) -> DataFrame:
    """Calendar dimension with ISO weeks and Monday-first day numbers."""
    d = F.col("date")
    number = day_number(d)
    return days.select(
        d, date_key(d).alias("date_key"), day_name(d).alias("day_of_week"),
        number.alias("day_number"), F.weekofyear(d).alias("week_number"),
        F.month(d).alias("month_number"), F.date_format(d, "MMMM").alias("month_name"),
        F.date_format(d, "MMM").alias("month_short"), F.quarter(d).alias("quarter"),
        semester(d).alias("semester"), F.year(d).alias("year"),
        number.isin(6, 7).alias("is_weekend"), year_month(d).alias("month_year"))


def calendar_us(days: DataFrame) -> DataFrame:
    """Calendar dimension with Sunday-first weeks and spelled-out labels."""
    d = F.col("full_date")
    year = F.year(d).cast("string")
    weekday = F.dayofweek(d)
    return days.select(
        date_key(d).alias("date_key"), d, F.year(d).alias("year"), F.quarter(d).alias("quarter"),
        F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), year).alias("quarter_label"),
        F.month(d).alias("month_num"), F.date_format(d, "MMMM").alias("month_name"),
        F.concat(F.date_format(d, "MMM"), F.lit(" "), year).alias("month_label"),
        us_week(d).alias("week_of_year"), F.dayofmonth(d).alias("day_of_month"),
        weekday.alias("day_of_week"), day_name(d).alias("day_name"),
        weekday.isin(1, 7).cast("int").alias("is_weekend"))


def day_order(day: Column) -> Column:
    """Position of a day name, Monday = 1."""
    return F.array_position(F.array(*[F.lit(n) for n in DAYS]), day).cast("int")


def all_days(spark: SparkSession) -> DataFrame:
    """The seven day names with their position."""
    return spark.range(1, 8).select(
        F.col("id").cast("int").alias("day_ord"),
        F.element_at(F.array(*[F.lit(n) for n in DAYS]), F.col("id").cast("int")).alias("day_of_week"))


def in_day_order(per_day: DataFrame) -> DataFrame:
    """Adds missing days with NULL measures and the position of each day."""
    return all_days(per_day.sparkSession).join(per_day, "day_of_week", "left")
