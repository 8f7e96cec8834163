"""Parsing of raw text columns and the order flags derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money_cents(text: Column) -> Column:
    """'$1,095.54' -> 109554; text that is no amount gives NULL."""
    plain = F.regexp_replace(text, "[$,]", "")
    return (plain.try_cast("decimal(16,2)") * 100).cast("bigint")


def money_decimal(text: Column, precision: int, strip: str = "$,") -> Column:
    """Amount text as DECIMAL(precision, 2) after removing the characters in `strip`."""
    for mark in strip:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return text.try_cast(f"decimal({precision},2)")


def hour_of(text: Column) -> Column:
    """'HH:MM:SS' -> hour as int."""
    return F.hour(F.try_to_timestamp(text, F.lit("HH:mm:ss")))


def date_of(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


# fixed values: day order of every weekly report
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


# Plain integer and text operations: far cheaper per row than pattern-based date formatting.

def day_name(date: Column) -> Column:
    return F.get(F.array(*[F.lit(d) for d in DAYS]), F.weekday(date))


def year_month(date: Column) -> Column:
    return F.substring(date.cast("string"), 1, 7)


def date_key(date: Column) -> Column:
    return (F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)).cast("int")


def failed(items_missing: Column) -> Column:
    """True when at least one item is missing; NULL counts as no failure."""
    return F.coalesce(items_missing > 0, F.lit(False))


def with_order_flags(orders: DataFrame) -> DataFrame:
    """Adds day_of_week, month and has_missing."""
    return orders.withColumns({
        "day_of_week": day_name(F.col("date")),
        "month": year_month(F.col("date")),
        "has_missing": failed(F.col("items_missing")),
    })


def clean_orders(raw: DataFrame) -> DataFrame:
    typed = raw.withColumns({
        "date": date_of(F.col("date")),
        "amount_cents": money_cents(F.col("order_amount")),
        "delivery_hour": hour_of(F.col("delivery_hour")),
    })
    return with_order_flags(typed.withColumn("order_amount", F.col("amount_cents") / 100.0))


def clean_products(raw: DataFrame) -> DataFrame:
    return raw.withColumnRenamed("produc_id", "product_id").withColumn(
        "price", money_cents(F.col("price")) / 100.0)


def clean_drivers(raw: DataFrame) -> DataFrame:
    return raw.withColumnRenamed("Trips", "trips")


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def weekend_flag(day: Column) -> Column:
    return day.isin("Saturday", "Sunday").cast("int")


def monday_flag(day: Column) -> Column:
    return (day == "Monday").cast("int")


def capped(value: Column, upper: int) -> Column:
    return F.least(value, F.lit(upper))


def capped_label(value: Column, upper: int) -> Column:
    return F.when(value >= upper, F.lit(f"{upper}+")).otherwise(value.cast("string"))


def neg_log10(p: Column, floor: float = 1e-10) -> Column:
    return -F.log10(F.greatest(p, F.lit(floor)))


def currency(value: Column, decimals: int = 0) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, decimals))


def percent(rate: Column, decimals: int = 1) -> Column:
    return F.concat(F.format_number(rate * 100, decimals), F.lit("%"))
