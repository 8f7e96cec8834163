"""Driver and customer segments by k-means, and main axes."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from .kpis import keyed
from .models import scaling

# The functions run in Python workers travel with the job; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DRIVER_FEATURES = ["missing_rate", "total_deliveries", "avg_order_value", "region_diversity", "avg_items"]
CUSTOMER_FEATURES = ["total_orders", "total_spent", "avg_order_value", "missing_rate", "customer_age"]

#: Starts per model, of which the best is kept, and rounds of one start at most.
STARTS, ITERATIONS = 10, 300

# fixed values: segment labels in rank order
DRIVER_PROFILES = ["Low Risk", "Medium Risk", "High Risk"]
CUSTOMER_SEGMENTS = ["VIP", "Regular High", "Regular Low", "Occasional"]


def driver_features(orders: DataFrame, min_deliveries: int = 3) -> DataFrame:
    """Orders are added up per driver and region first; a region then counts once per driver."""
    cells = keyed(orders, "driver_id").groupBy("driver_id", "region").agg(
        agg.order_count().alias("orders"), agg.failure_count().alias("failures"),
        F.sum("amount_cents").alias("cents"), F.sum("items_delivered").alias("items"))
    total = F.sum("orders")
    return cells.groupBy("driver_id").agg(
        total.alias("total_deliveries"), (F.sum("failures") / total).alias("missing_rate"),
        (F.sum("cents") / 100.0 / total).alias("avg_order_value"), F.count("region").alias("region_diversity"),
        (F.sum("items") / total).alias("avg_items")).where(F.col("total_deliveries") >= min_deliveries)


def customer_features(orders: DataFrame, customers: DataFrame) -> DataFrame:
    per_customer = keyed(orders, "customer_id").groupBy("customer_id").agg(
        agg.order_count().alias("total_orders"), agg.revenue().alias("total_spent"),
        agg.average_ticket().alias("avg_order_value"), agg.failure_rate().alias("missing_rate"))
    return per_customer.join(customers.select("customer_id", "customer_age"), "customer_id", "left")


@dataclass(frozen=True)
class Clusters:
    """Centres of a fitted clustering in scaled units, in the order of their features, and its inertia."""

    features: tuple[str, ...]
    means: np.ndarray
    scales: np.ndarray
    centres: np.ndarray
    inertia: float


def fit_clusters(df: DataFrame, features: Sequence[str], k: int, key: str) -> Clusters:
    return fit_all(df, features, [k], key)[k]


def fit_all(df: DataFrame, features: Sequence[str], ks: Sequence[int], key: str, starts: int = STARTS) -> dict[int, Clusters]:
    """For each number of clusters the clustering of the lowest inertia among several starts.

    Start s of k clusters begins with the rows at places s k .. s k + k - 1 in the order of a hash of
    their key. All starts of all k move together: a round is one pass over the rows, which adds up the
    rows next to each centre per task, and one sum per centre. A start that no longer moves leaves the
    next round. A centre without rows stays. Missing features count as 0; fewer rows than clusters give
    fewer clusters, and no rows none.
    """
    filled = df.na.fill(0, list(features))
    means, scales = (np.array(v) for v in scaling(filled, features))
    x = [((F.col(f) - float(m)) * float(s)).alias(f"x{i}") for i, (f, m, s) in enumerate(zip(features, means, scales))]
    rows = filled.select(*x)
    place = F.md5(F.col(key).cast("string"))
    seeds = np.array([tuple(r)[:-2] for r in filled.select(*x, place.alias("place"), F.col(key).alias("key")).orderBy(
        "place", "key").limit(starts * max(ks)).collect()]).reshape(-1, len(features))
    moving = {(k, s): seeds[[(s * k + c) % len(seeds) for c in range(min(k, len(seeds)))]] for k in ks for s in range(starts)} \
        if len(seeds) else {}
    done: dict[tuple[int, int], tuple[float, np.ndarray]] = {}
    for last in range(ITERATIONS, -1, -1):
        if not moving:
            break
        after = _moved(rows, moving)
        for start, (inertia, centres) in after.items():
            if not last or np.abs(centres - moving[start]).max() <= 1e-12:
                done[start] = inertia, centres
                del moving[start]
            else:
                moving[start] = centres
    best = {}
    for k in ks:
        found = [done[k, s] for s in range(starts) if (k, s) in done]
        inertia, centres = min(found, key=lambda f: round(f[0], 9)) if found else (0.0, np.zeros((0, len(features))))
        best[k] = Clusters(tuple(features), means, scales, centres[np.lexsort(np.round(centres, 9).T[::-1])], inertia)
    return best


def _moved(rows: DataFrame, centres: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], tuple[float, np.ndarray]]:
    """Inertia of the given centres, and each centre moved to the mean of the rows nearest to it (ties: the first)."""
    names = list(centres)
    d = len(rows.columns)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(c), d + 2)) for c in centres.values()]
        for batch in batches:
            x = np.column_stack([column.to_numpy(zero_copy_only=False) for column in batch.columns])
            for total, own in zip(sums, centres.values()):
                distance = np.stack([((x - c) ** 2).sum(axis=1) for c in own])
                of = distance.argmin(axis=0)
                values = np.column_stack([x, np.ones(len(x)), distance.min(axis=0)])
                for j in range(d + 2):
                    total[:, j] += np.bincount(of, values[:, j], len(own))
        flat = np.concatenate(sums)
        start = np.repeat(np.arange(len(sums)), [len(s) for s in sums]).astype(np.int32)
        number = np.concatenate([np.arange(len(s)) for s in sums]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(start), pa.array(number), *map(pa.array, flat.T.copy())],
                                         ["start", "number", *(f"s{j}" for j in range(d + 2))])

    columns = [f"s{j}" for j in range(d + 2)]
    sums = rows.mapInArrow(nearest, "start int, number int, " + ", ".join(f"{c} double" for c in columns)).groupBy(
        "start", "number").agg(*[F.sum(c).alias(c) for c in columns]).collect()
    out = {name: (0.0, own.copy()) for name, own in centres.items()}
    for r in sums:
        inertia, own = out[names[r.start]]
        if r[d + 2]:
            own[r.number] = np.array(r[2:d + 2]) / r[d + 2]
        out[names[r.start]] = inertia + r[d + 3], own
    return out


def assigned(model: Clusters, df: DataFrame) -> DataFrame:
    """Adds cluster, the number of the nearest centre, as plain arithmetic; without centres it is null."""
    filled = df.na.fill(0, list(model.features))
    x = [(F.col(f) - float(m)) * float(s) for f, m, s in zip(model.features, model.means, model.scales)]
    far = [F.struct(sum((F.pow(v - float(c), F.lit(2.0)) for v, c in zip(x, centre)), F.lit(0.0)).alias("distance"),
                    F.lit(i).alias("cluster")) for i, centre in enumerate(model.centres)]
    nearest = F.least(*far)["cluster"] if len(far) > 1 else F.lit(0 if far else None).cast("int")
    return filled.withColumn("cluster", nearest)


def elbow(spark: SparkSession, df: DataFrame, features: Sequence[str], key: str, ks: Sequence[int] = range(2, 9)) -> DataFrame:
    """Within-cluster squared distance for each number of clusters."""
    found = fit_all(df, features, list(ks), key)
    return spark.createDataFrame([(k, float(model.inertia)) for k, model in found.items()], "k int, inertia double")


def ranked_labels(summary: DataFrame, metric: str, labels: Sequence[str], name: str,
                  largest_first: bool = False) -> DataFrame:
    """Names clusters by their position in the order of a metric."""
    order = F.desc(metric) if largest_first else F.asc(metric)
    place = F.row_number().over(Window.orderBy(order, "cluster"))
    return summary.withColumn(name, F.element_at(F.array(*[F.lit(x) for x in labels]), place))


def driver_clusters(clustered: DataFrame) -> DataFrame:
    summary = clustered.groupBy("cluster").agg(
        F.count("driver_id").alias("n_drivers"), agg.half_even(F.avg("missing_rate"), 3).alias("avg_missing_rate"),
        agg.half_even(F.avg("total_deliveries"), 3).alias("avg_deliveries"),
        agg.half_even(F.avg("avg_order_value"), 3).alias("avg_ticket"))
    return ranked_labels(summary, "avg_missing_rate", DRIVER_PROFILES, "profile")


def customer_clusters(clustered: DataFrame) -> DataFrame:
    summary = clustered.groupBy("cluster").agg(
        F.count("customer_id").alias("n_customers"), agg.half_even(F.avg("total_orders"), 2).alias("avg_orders"),
        agg.half_even(F.avg("total_spent"), 2).alias("avg_spent"),
        agg.half_even(F.avg("avg_order_value"), 2).alias("avg_ticket"),
        agg.half_even(F.avg("missing_rate"), 2).alias("avg_missing"),
        agg.half_even(F.avg("customer_age"), 2).alias("avg_age"))
    return ranked_labels(summary, "avg_spent", CUSTOMER_SEGMENTS, "segment", largest_first=True)


def cluster_distribution(clustered: DataFrame) -> DataFrame:
    """Drivers, share and mean rate per risk profile."""
    labelled = clustered.join(driver_clusters(clustered).select("cluster", "profile"), "cluster")
    counts = labelled.groupBy("profile").agg(F.count(F.lit(1)).alias("drivers"),
                                             F.avg("missing_rate").alias("avg_rate"))
    return counts.withColumn("pct", agg.share(F.col("drivers"), F.sum("drivers").over(Window.partitionBy())))


def profile_impact(orders: DataFrame, clustered: DataFrame,
                   cost: float = agg.FLAT_COST_PER_FAILURE) -> DataFrame:
    """Failures and flat cost per risk profile; orders are added up per driver before the join."""
    profiles = clustered.join(driver_clusters(clustered).select("cluster", "profile"), "cluster", "left")
    sums = keyed(orders, "driver_id").groupBy("driver_id").agg(
        agg.order_count().alias("orders"), agg.failure_count().alias("failures"), F.sum("amount_cents").alias("cents"))
    impact = sums.join(profiles.select("driver_id", "profile"), "driver_id").groupBy("profile").agg(
        F.sum("orders").alias("total_orders"), F.sum("failures").alias("total_failures"),
        (F.sum("failures") / F.sum("orders")).alias("failure_rate"), (F.sum("cents") / 100.0).alias("total_revenue"))
    return impact.withColumn("estimated_cost", F.col("total_failures") * cost).withColumn(
        "pct_revenue_at_risk", F.col("estimated_cost") / F.col("total_revenue") * 100).withColumn(
        "pct_of_cost", agg.share(F.col("estimated_cost"), F.sum("estimated_cost").over(Window.partitionBy())))


@dataclass(frozen=True)
class Axes:
    """Main axes of the scaled features as columns, each with its largest entry positive, and the share each explains."""

    features: tuple[str, ...]
    means: np.ndarray
    scales: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray


def principal_axes(df: DataFrame, features: Sequence[str], k: int = 2) -> Axes:
    """One aggregate gives the products of all pairs of scaled features; their matrix is as wide as the features."""
    filled, d = df.na.fill(0, list(features)), len(features)
    means, scales = scaling(filled, features)
    x = [(F.col(f) - m) * s for f, m, s in zip(features, means, scales)]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = filled.agg(F.count(F.lit(1)), *[F.sum(x[i] * x[j]) for i, j in pairs]).first()
    covariance = np.zeros((d, d))
    for (i, j), value in zip(pairs, sums[1:]):
        covariance[i, j] = covariance[j, i] = (value or 0) / max(sums[0] - 1, 1)
    values, vectors = np.linalg.eigh(covariance)
    vectors = vectors[:, ::-1][:, :k]
    largest = vectors[np.abs(vectors).round(9).argmax(axis=0), np.arange(k)]
    trace = values.sum()
    return Axes(tuple(features), np.array(means), np.array(scales), vectors * np.sign(largest),
                values[::-1][:k] / trace if trace > 0 else np.zeros(k))


def projected(axes: Axes, df: DataFrame, key: str) -> DataFrame:
    """Coordinates on the main axes, with the share of variance each axis explains."""
    filled = df.na.fill(0, list(axes.features))
    x = [(F.col(f) - float(m)) * float(s) for f, m, s in zip(axes.features, axes.means, axes.scales)]
    place = [sum((v * float(w) for v, w in zip(x, axis)), F.lit(0.0)) for axis in axes.vectors.T]
    return filled.select(key, *[p.alias(f"pca{i + 1}") for i, p in enumerate(place)],
                         *[F.lit(float(v)).alias(f"explained{i + 1}") for i, v in enumerate(axes.explained)])
