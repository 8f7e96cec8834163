"""Shared helpers: stored intermediate tables, column picking, connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the session's warehouse where none is set: both are shared by all executors."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{path.rstrip('/')}/parcelscope-llm"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: cuts the lineage, and survives lost executors.

    The files go when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by `stored` that nothing reads any more."""
    spark = df.sparkSession
    for file in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/parcelscope-llm/" in file:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(file)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Short stretches of the batches, so that a worker holds few texts as Python objects at a time.

    A stretch has at most `rows` rows and about `size` bytes of text, or one longer text. Memory that a batch
    took goes back to the system after it, as workers live on for the stages that follow.
    """
    for batch in batches:
        bytes_of = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                bytes_of += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        upto, start = np.cumsum(bytes_of), 0
        while start < batch.num_rows:
            before = int(upto[start - 1]) if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(upto, before + size, "right"))))
            yield batch.slice(start, stop - start)
            start = stop
        del batch
        pa.default_memory_pool().release_unused()
        _trim()


def _trim() -> None:
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_of(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of undirected links: (node, component) for each linked node, component = smallest node.

    Alternates large-star and small-star steps, each a grouped minimum and a join, so that a node with
    very many links is pre-aggregated and its join side can be split. Links to itself and links with a
    null end are left out. The number of rounds grows with the logarithm of the longest chain.
    """
    links = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    current = stored(links, "links")
    before = _digest(current)
    while before[0]:
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(current.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        # A node's own larger neighbours move to its minimum; the node itself keeps its link to it.
        large = large.union(least.where("u > m").select("u", "m")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(lowest, "hi")
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi > lo").union(
            lowest.select("hi", "m")).distinct()
        following = stored(small, "links")
        after = _digest(following)
        dropped(current)
        current = following
        if after == before:
            break
        before = after
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
