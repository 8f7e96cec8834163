"""Model features of orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import bands
from ..functions.cleaning import monday_flag, weekend_flag
from .distribution import quantile_name, quantiles, running_totals, with_value_chunk
from .joins import join_per_key
from .kpis import global_scalar
from .ranking import dense_rank_labels, label_place

# fixed values: names of the model features
FEATURES = ["driver_fail_rate", "order_amount", "items_delivered", "delivery_hour", "period_enc",
            "is_weekend", "is_monday", "region_enc", "customer_age"]

#: Columns of orders that the features are made of.
FEATURE_SOURCES = ["order_id", "driver_id", "customer_id", "date", "has_missing", "region", "delivery_hour",
                   "day_of_week", "order_amount", "amount_cents", "items_delivered"]

#: Stands for a missing date, so that undated orders come last; and the parts that orders without a driver are dealt into, by day.
LAST_DAY, DRIVERLESS_CUTS = "9999-12-31", 997

# fixed values: category of each feature
FEATURE_CATEGORIES = {
    "driver_fail_rate": "Driver",
    "customer_age": "Customer",
    "order_amount": "Order",
    "items_delivered": "Order",
    "delivery_hour": "Time",
    "period_enc": "Time",
    "is_weekend": "Time",
    "is_monday": "Time",
    "region_enc": "Location",
}


def prior_failure_rate(orders: DataFrame, name: str = "driver_fail_rate") -> DataFrame:
    """Failure rate over all earlier orders of the same driver, by date and order id.

    Orders without a driver or without earlier orders get the overall rate, and orders without a date
    come after all others of their driver. A driver's orders are cut by day and by order-id range,
    and orders without a driver are dealt out by a hash, so neither ends up in one task.
    """
    flags = orders.withColumns({
        "failed": F.col("has_missing").cast("int"), "one": F.lit(1),
        "_day": F.coalesce("date", F.lit(LAST_DAY).cast("date"))})
    if isinstance(orders.schema["order_id"].dataType, NumericType):
        flags = with_value_chunk(flags, "order_id", name="id_chunk")
    else:
        flags = with_value_chunk(flags.withColumn("_place", text_place(orders, "order_id")), "_place", name="id_chunk")
    # Nobody asks for the history of a missing driver: any cut of these rows will do.
    dealt = F.when(F.col("driver_id").isNull(), F.pmod(F.xxhash64("order_id"), F.lit(DRIVERLESS_CUTS)).cast("int"))
    flags = flags.withColumn("id_chunk", F.coalesce(dealt, "id_chunk"))
    run = running_totals(flags, ["one", "failed"], ["order_id"], ["_day", "id_chunk"], ["driver_id"])
    rate = F.when(F.col("driver_id").isNotNull(), F.try_divide("failed_before", "one_before"))
    return run.withColumn("g", global_scalar(orders)).select(
        *orders.columns, F.coalesce(rate, F.col("g.failure_rate")).alias(name))


def text_place(df: DataFrame, column: str) -> Column:
    """A bigint that sorts like a text column: the seven bytes after the beginning that all values share."""
    ends = df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high")).alias("e")).select(
        F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("e.low"), F.length("e.high")))), F.lit(0),
                    lambda n, i: F.when((n == i - 1) & (F.substring(F.col("e.low"), F.lit(1), i) == F.substring(
                        F.col("e.high"), F.lit(1), i)), i).otherwise(n)).alias("shared"), "e.low").select(
        F.coalesce(F.octet_length(F.substring(F.col("low"), F.lit(1), F.col("shared"))), F.lit(0))).scalar()
    own = F.substring(F.encode(F.col(column), "UTF-8"), ends + 1, F.lit(7))
    padded = F.rpad(F.hex(own), 14, "0")
    return F.conv(padded, 16, 10).cast("bigint")


def label_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """Adds 0-based codes of the labels in alphabetical order; NULL stays NULL. The column may have any number of labels."""
    return df.join(dense_rank_labels(df, column, code, first=0), column, "left")


def with_historic_rate(orders: DataFrame, name: str = "driver_hist_rate") -> DataFrame:
    """Adds each driver's rate over all of its orders, the order itself included."""
    rates = orders.where(F.col("driver_id").isNotNull()).groupBy("driver_id").agg(
        F.avg(F.col("has_missing").cast("int")).alias(name))
    return join_per_key(orders, rates, "driver_id")


def feature_table(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Nine features and the label per order; rows with any NULL are left out.

    Chunk limits, running totals, overall rate and labels each read the orders: hand over a stored
    table of FEATURE_SOURCES where reading them is dear.
    """
    ages = customers.select("customer_id", "customer_age")
    rated = prior_failure_rate(orders).join(ages, "customer_id", "left")
    flagged = rated.withColumns({
        "period": bands.period_of_day(F.col("delivery_hour"), bands.PERIOD_LABELS_MODEL),
        "is_weekend": weekend_flag(F.col("day_of_week")),
        "is_monday": monday_flag(F.col("day_of_week"))})
    period = bands.period_of_day(F.col("delivery_hour"), bands.PERIOD_LABELS_MODEL)
    labels = orders.agg(F.struct(F.array_sort(F.collect_set("region")).alias("region"),
                                 F.array_sort(F.collect_set(period)).alias("period"))).scalar()
    coded = flagged.withColumn("labels", labels).withColumns({
        "region_enc": label_place(F.col("region"), F.col("labels.region")),
        "period_enc": label_place(F.col("period"), F.col("labels.period"))})
    return coded.select("order_id", *FEATURES, F.col("has_missing").cast("int").alias("label")).na.drop()


def risk_features(orders: DataFrame) -> DataFrame:
    """Six raw features, with the driver's all-time rate; rows with any NULL are left out."""
    return raw_risk_rows(orders, orders).withColumn("label", F.col("has_missing").cast("int")).drop("has_missing").na.drop()


def raw_risk_rows(rows: DataFrame, history: DataFrame) -> DataFrame:
    """The six features of orders or of what-if rows in raw form, coded as in `history`.

    A row of a driver without history, or without a driver, has the overall rate. what-if rows need
    order_id, region, day_of_week, delivery_hour, order_amount, items_delivered and driver_id.
    """
    labels = history.agg(F.struct(F.array_sort(F.collect_set("region")).alias("region"),
                                  F.array_sort(F.collect_set("day_of_week")).alias("day"),
                                  F.avg(F.col("has_missing").cast("int")).alias("rate"))).scalar()
    rates = history.where(F.col("driver_id").isNotNull()).groupBy("driver_id").agg(
        F.avg(F.col("has_missing").cast("int")).alias("_rate"))
    rated = join_per_key(rows, rates, "driver_id").withColumn("labels", labels)
    kept = [c for c in ("has_missing",) if c in rows.columns]
    return rated.select(
        "order_id", label_place(F.col("region"), F.col("labels.region")).alias("region_enc"),
        label_place(F.col("day_of_week"), F.col("labels.day")).alias("day_enc"), "delivery_hour", "order_amount",
        "items_delivered", F.coalesce("_rate", "labels.rate").alias("driver_hist_rate"), *kept)


def marked_rows(df: DataFrame, test_share: float = 0.2, label: str = "label") -> DataFrame:
    """Adds `in_test`, true for the test share within each label.

    Rows go by a hash of their order id, and each label is cut at its own quantile of the hash: the
    share is exact to one row, and no row is moved but for the counting of hashes. Each use of the result
    looks for the cuts anew: store it where it is used more than once.
    """
    draw = F.conv(F.substring(F.md5(F.col("order_id").cast("string")), 1, 13), 16, 10).cast("double")
    drawn = df.withColumn("_draw", draw)
    cuts = quantiles(drawn, "_draw", [test_share], [label]).select(label, F.col(quantile_name(test_share)).alias("cut")).agg(
        F.map_from_entries(F.collect_list(F.struct(label, "cut")))).scalar()
    return drawn.withColumn("in_test", F.col("_draw") <= F.try_element_at(cuts, F.col(label))).drop("_draw")


def parts_of(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test rows."""
    return marked.where(~F.col("in_test")).drop("in_test"), marked.where("in_test").drop("in_test")


def split_rows(df: DataFrame, test_share: float = 0.2, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Train and test rows, the test share taken within each label."""
    return parts_of(marked_rows(df, test_share, label))
