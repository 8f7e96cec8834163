"""Exact running totals, quantiles, histograms and box statistics without a global sort task.

Rows are first reduced to counts per distinct value. The values are cut into ordered chunks, each
chunk is scanned on its own, and the totals of the chunks before it are added. Chunk limits come
from an approximate quantile sketch; they only affect how even the chunks are, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fewest and most ordered chunks that values are cut into; between them the session's shuffle partitions decide.
CHUNKS, MOST_CHUNKS = 64, 512


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct value (and group); NULL values and NULL groups are left out."""
    present = df
    for name in (*by, value):
        present = present.where(F.col(name).isNotNull())
    return present.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def _limits_below(value: Column, limits: Column, first: int, last: int) -> Column:
    """How many of the sorted limits lie below the value, by halving the range."""
    if first == last:
        return F.lit(first)
    middle = (first + last) // 2
    return F.when(value > F.get(limits, F.lit(middle)), _limits_below(value, limits, middle + 1, last)).otherwise(
        _limits_below(value, limits, first, middle))


def with_value_chunk(df: DataFrame, value: str, weight: str | None = None, name: str = "chunk",
                     chunks: int | None = None) -> DataFrame:
    """Adds the number of the ordered chunk that holds a numeric value; as many chunks as shuffle partitions, within limits."""
    if chunks is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        chunks = max(CHUNKS, min(MOST_CHUNKS, partitions))
    # Naming the weight keeps this branch's columns equal to the main one, so its shuffle is reused.
    source = F.when(F.col(weight) >= 0, F.col(value)) if weight else F.col(value)
    limits = df.agg(F.percentile_approx(source, [i / chunks for i in range(1, chunks)], 10 * MOST_CHUNKS)).scalar()
    # Plain comparisons: a lambda over the limits would hide the value from Spark's filter inference.
    chunk = _limits_below(F.col(value), F.col("chunk_limits"), 0, chunks - 1)
    return df.withColumn("chunk_limits", limits).withColumn(name, chunk).drop("chunk_limits")


def running_totals(df: DataFrame, weights: Sequence[str], order: Sequence[str], chunk: Sequence[str],
                   by: Sequence[str] = ()) -> DataFrame:
    """Adds `<weight>_before` and `<weight>_total` within each `by` group.

    `chunk` columns must sort like `order`. No task holds more than one chunk of rows, or the
    chunk totals of one group.
    """
    totals = df.groupBy(*by, *chunk).agg(*[F.sum(w).alias(w) for w in weights])
    group = Window.partitionBy(*by)
    earlier = group.orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, *chunk,
        *[F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"{w}_offset") for w in weights],
        *[F.sum(w).over(group).alias(f"{w}_total") for w in weights])
    inside = Window.partitionBy(*by, *chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = df.select("*", *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"{w}_inside")
                               for w in weights])
    joined = running.join(offsets, [*by, *chunk], "left")
    return joined.select(
        *df.columns,
        *[(F.col(f"{w}_inside") + F.col(f"{w}_offset")).alias(f"{w}_before") for w in weights],
        *[F.col(f"{w}_total") for w in weights])


def running_counts(counts: DataFrame, value: str, weights: Sequence[str] = ("n",),
                   by: Sequence[str] = (), few: bool = False) -> DataFrame:
    """Running totals of weights over distinct values, smallest value first.

    `few` is for values with a fixed small domain, such as 0/1 flags: no chunks are needed then.
    """
    if few:
        group = Window.partitionBy(*by)
        earlier = group.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select("*", *[F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"{w}_before") for w in weights],
                             *[F.sum(w).over(group).alias(f"{w}_total") for w in weights])
    keyed = with_value_chunk(counts, value, weights[0])
    return running_totals(keyed, weights, [value], ["chunk"], by).drop("chunk")


def _at_rank(value: str, rank: Column) -> Column:
    """Smallest value that has more than `rank` rows at or below it."""
    return F.min(F.when(F.col("n_before") + F.col("n") > rank, F.col(value)))


def quantile_name(q: float) -> str:
    return f"q{round(q * 100):02d}"


def quantiles(df: DataFrame, value: str, probabilities: Sequence[float],
              by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one row (per group), columns q25, q50, ..."""
    run = running_counts(value_counts(df, value, by), value, by=by)
    last = F.col("n_total") - 1
    low = run.groupBy(*by).agg(
        F.max("n_total").alias("n"),
        *[_at_rank(value, F.floor(last * q)).alias(f"low_{i}") for i, q in enumerate(probabilities)],
        *[_at_rank(value, F.ceil(last * q)).alias(f"high_{i}") for i, q in enumerate(probabilities)])

    def between(i: int, q: float) -> Column:
        part = (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
        return F.col(f"low_{i}") + (F.col(f"high_{i}") - F.col(f"low_{i}")) * part

    return low.select(*by, *[between(i, q).alias(quantile_name(q)) for i, q in enumerate(probabilities)])


def medians(df: DataFrame, values: Sequence[str]) -> Column:
    """Struct of the exact medians of several columns, as a scalar sub-query column."""
    long = df.select(*[F.col(v).cast("double").alias(v) for v in values]).unpivot([], list(values), "name", "value")
    middle = quantiles(long, "value", [0.5], ["name"])
    return middle.agg(F.struct(*[F.max(F.when(F.col("name") == v, F.col("q50"))).alias(v) for v in values])).scalar()


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last bin is closed."""
    counts = value_counts(df, value)
    smallest, largest = F.min(value), F.max(value)
    pad = F.when(smallest == largest, F.lit(0.5)).otherwise(F.lit(0.0))
    span = counts.where("n > 0").agg(
        F.struct((smallest - pad).alias("low"), (largest + pad).alias("high")).alias("span"))
    width = (F.col("span.high") - F.col("span.low")) / bins
    place = F.floor((F.col(value) - F.col("span.low")) / width)
    filled = counts.withColumn("span", span.scalar()).groupBy(
        F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.sum("n").alias("rows"))
    edges = span.select("span", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).select(
        "bin", (F.col("span.low") + F.col("bin") * width).alias("bin_start"),
        (F.col("span.low") + (F.col("bin") + 1) * width).alias("bin_end"))
    return edges.join(filled, "bin", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def box_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges, and outlier counts."""
    quartiles = quantiles(df, value, [0.25, 0.5, 0.75], by)
    counts = value_counts(df, value, by)
    if by:
        fenced = counts.join(quartiles, list(by))
    else:
        fenced = counts.withColumn("q", quartiles.select(F.struct("*")).scalar()).select("*", "q.*")
    reach = (F.col("q75") - F.col("q25")) * 1.5
    inside = F.col(value).between(F.col("q25") - reach, F.col("q75") + reach)
    return fenced.groupBy(*by, "q25", "q50", "q75").agg(
        F.sum("n").alias("n"),
        F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("outliers")).select(
        *by, "n", "q25", "q50", "q75", F.least("low", "q25").alias("whisker_low"),
        F.greatest("high", "q75").alias("whisker_high"), "outliers")


def describe(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, standard deviation, extremes and quartiles in one row."""
    basic = df.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                   F.min(value).alias("min"), F.max(value).alias("max"))
    quartiles = quantiles(df, value, [0.25, 0.5, 0.75]).select(F.struct("*"))
    return basic.withColumn("q", quartiles.scalar()).select("count", "mean", "std", "min", "q.*", "max")
