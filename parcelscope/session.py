"""Spark session settings and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split oversized join partitions even where that costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def sized_for(input_bytes: int, shuffled_share: float = 0.1) -> dict[str, str]:
    """Partition settings for a cluster run over `input_bytes`.

    Aggregations here shuffle a small share of what they read. Partitions start at about 128 MB of
    that share, and Spark merges those that turn out smaller. Scan tasks grow with the input, so the
    scheduler is not flooded with small ones.
    """
    mib = 1 << 20
    partitions = max(200, min(50_000, round(input_bytes * shuffled_share / (128 * mib))))
    scan = 128 if input_bytes < (10 << 40) else 512
    return {"spark.sql.shuffle.partitions": str(partitions),
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * mib),
            "spark.sql.files.maxPartitionBytes": str(scan * mib)}


def get_session(app: str = "parcelscope", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or the session's warehouse where none is named: every executor reaches both."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the application's own folder under the shared one, which goes when the session ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/parcelscope/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, for results that are used many times."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
