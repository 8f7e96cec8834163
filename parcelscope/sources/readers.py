"""CSV, Parquet and JSON readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..functions import cleaning
from . import schemas


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    # Quotes inside quoted text are doubled in the files, as in common CSV writers.
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def load_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All five raw tables by name."""
    return {name: read_csv(spark, f"{folder}/{name}.csv", schema)
            for name, schema in schemas.RAW_TABLES.items()}


def load_clean(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    raw = load_raw(spark, folder)
    return {"orders": cleaning.clean_orders(raw["orders"]), "customers": raw["customers"],
            "products": cleaning.clean_products(raw["products"]),
            "drivers": cleaning.clean_drivers(raw["drivers"]), "order_items": raw["order_items"]}


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cached_or_built(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table when a complete one is present, otherwise the result of `build`."""
    if path_exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path)
    return build()


def read_document(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One JSON document per file; a missing file is an error that names what to run first."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"{path} not found: write the model results document first")
    return spark.read.schema(schema).option("multiLine", True).json(path)
