"""The supplied star-schema tables seen as deliveries, using integer arithmetic only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cleaning import with_order_flags

#: Supplier ids lie below 2^40 and line numbers below 2^23, so that a line number and an id fit one bigint.
SUPPLIER_BITS = 40


def _discount_points() -> Column:
    return F.rint(F.col("l_discount") * 100).cast("int")


def _first_driver() -> Column:
    """Supplier of the first line. One bigint per line keeps the aggregation free of structs."""
    line, supplier = F.col("l_linenumber").cast("bigint"), F.col("l_suppkey").cast("bigint")
    packed = F.shiftleft(line, SUPPLIER_BITS) + supplier
    fits = supplier.between(0, (1 << SUPPLIER_BITS) - 1) & line.between(0, (1 << 63 - SUPPLIER_BITS) - 1)
    outside = F.raise_error(F.lit("a line number or supplier id is too large")).cast("bigint")
    checked = F.when(fits | supplier.isNull() | line.isNull(), packed).otherwise(outside)
    return F.min(checked).bitwiseAND(F.lit((1 << SUPPLIER_BITS) - 1))


def _threshold(driver: Column) -> Column:
    """Discount points from which a returned line counts as missing."""
    return F.when(driver % 5 == 0, 6).when(driver % 5 == 1, 9).otherwise(10)


@dataclass(frozen=True)
class Deliveries:
    """Lazy delivery tables over one folder of supplied Parquet files."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")

    @cached_property
    def order_lines(self) -> DataFrame:
        """Driver and item counts per order, in one aggregation over the lines.

        The three possible thresholds are counted side by side, so the driver does not have
        to be known before the missing lines are counted.
        """
        points = F.when(F.col("l_returnflag") == "R", _discount_points())
        per_order = self.table("lineitem").groupBy("l_orderkey").agg(
            _first_driver().alias("driver_id"),
            F.count(F.lit(1)).alias("lines"),
            *[F.count_if(points >= k).alias(f"from_{k}") for k in (6, 9, 10)])
        driver = F.col("driver_id")
        missing = (F.when(driver % 5 == 0, F.col("from_6")).when(driver % 5 == 1, F.col("from_9"))
                   .otherwise(F.col("from_10")))
        return per_order.select(F.col("l_orderkey").alias("order_id"), "driver_id", "lines",
                                missing.alias("items_missing"))

    @cached_property
    def customer_regions(self) -> DataFrame:
        nation = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            "c_custkey", F.col("r_name").alias("region"))

    @cached_property
    def plain_orders(self) -> DataFrame:
        """Orders without the derived flags. The line counts hang on a left join over a unique
        key, so a query that needs none of them does not read the lines at all."""
        cents = F.floor(F.col("o_totalprice") / 10).cast("bigint")
        heads = self.table("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").cast("date").alias("date"), cents.alias("amount_cents"),
            (cents / 100.0).alias("order_amount"),
            ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 24).cast("int").alias("delivery_hour"))
        missing = F.coalesce("items_missing", F.lit(0))
        return (heads.join(self.order_lines, "order_id", "left")
                .withColumn("items_delivered", (F.coalesce("lines", F.lit(0)) - missing).cast("int"))
                .withColumn("items_missing", missing.cast("int"))
                .drop("lines"))

    @cached_property
    def orders_without_region(self) -> DataFrame:
        """For customer- and driver-grain work, which needs no region and so no join for it."""
        return with_order_flags(self.plain_orders)

    @cached_property
    def orders(self) -> DataFrame:
        located = self.plain_orders.join(
            self.customer_regions, F.col("customer_id") == F.col("c_custkey")).drop("c_custkey")
        return with_order_flags(located)

    @cached_property
    def customers(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("customer_id"), F.col("c_name").alias("customer_name"),
            (18 + (key * 7) % 73).cast("int").alias("customer_age"))

    @cached_property
    def drivers(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            key.alias("driver_id"), F.col("s_name").alias("driver_name"),
            (18 + (key * 11) % 50).cast("int").alias("age"), (1 + (key * 7) % 100).cast("int").alias("trips"))

    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"))

    @cached_property
    def order_items(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"))

    @cached_property
    def missing_items(self) -> DataFrame:
        """Wide table of the first three missing products per order."""
        lines = self.table("lineitem")
        drivers = lines.groupBy("l_orderkey").agg(_first_driver().alias("driver_id"))
        returned = lines.where((F.col("l_returnflag") == "R") & (_discount_points() >= 6))
        # Both sides are dealt out by the order, as the ranking and the last step need it: one shuffle each.
        missing = returned.join(drivers, "l_orderkey").where(
            _discount_points() >= _threshold(F.col("driver_id")))
        place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
        first = missing.withColumn("position", F.row_number().over(place)).where("position <= 3")
        return first.groupBy(F.col("l_orderkey").alias("order_id")).agg(
            *[F.min(F.when(F.col("position") == k, F.col("l_partkey"))).alias(f"product_id_{k}")
              for k in (1, 2, 3)])

    # The same rows in the raw text form of the source files.

    @cached_property
    def raw_orders(self) -> DataFrame:
        return self.orders.select(
            "order_id", F.date_format("date", "yyyy-MM-dd").alias("date"),
            F.concat(F.lit("$"), F.format_number(F.col("order_amount"), 2)).alias("order_amount"),
            "region", "items_delivered", "items_missing",
            F.format_string("%02d:00:00", "delivery_hour").alias("delivery_hour"),
            "driver_id", "customer_id")

    @cached_property
    def raw_products(self) -> DataFrame:
        return self.products.select(
            F.col("product_id").alias("produc_id"), "product_name", "category",
            F.format_string("$%.2f", "price").alias("price"))

    @cached_property
    def raw_drivers(self) -> DataFrame:
        return self.drivers.withColumnRenamed("trips", "Trips")

    @property
    def raw(self) -> dict[str, DataFrame]:
        return {"orders": self.raw_orders, "customers": self.customers, "products": self.raw_products,
                "drivers": self.raw_drivers, "order_items": self.order_items}
