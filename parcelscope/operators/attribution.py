"""Per-feature attribution of forest predictions (path-dependent Shapley values)."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import bands
from . import boxes
from .boxes import leaf_rules
from .features import FEATURE_CATEGORIES, FEATURES
from .models import Forest

# The functions run in Python workers travel with the job; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def leaf_table(reach: np.ndarray, value: float, patterns: np.ndarray) -> np.ndarray:
    """Attribution of each feature of a leaf for the given met/unmet patterns: array (patterns, d).

    The Shapley weight of k met features out of d - 1 is the integral of t^k (1 - t)^(d - 1 - k)
    over 0..1, so the sum over feature sets is the integral of a product. That is a polynomial of
    degree d - 1, which a Gauss rule with d / 2 points integrates exactly.
    """
    d = len(reach)
    met = ((patterns[:, None] >> np.arange(d)) & 1).astype(float)
    points, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
    t = (points + 1) / 2
    factors = t[:, None, None] * met + (1 - t)[:, None, None] * reach
    others = factors.prod(axis=2, keepdims=True) / factors
    return (met - reach) * value * np.tensordot(weights / 2, others, 1)


def _attribute(rules: list[tuple], x: np.ndarray, trees: int) -> np.ndarray:
    phi = np.zeros_like(x)
    for features, lows, highs, reach, value in rules:
        if len(features):
            values = x[:, features]
            pattern = ((values > lows) & (values <= highs)) @ (1 << np.arange(len(features)))
            seen, place = np.unique(pattern, return_inverse=True)
            phi[:, features] += leaf_table(reach, value, seen)[place]
    return phi / trees


class KeyTables:
    """Attributions of all cells of a key's grid, from all leaves at once.

    Given the quadrature point t of `leaf_table`, a leaf's product is affine in whether a grid feature is met, so over
    the grid it is a sum of boxes, one for each set of its grid features.
    """

    def __init__(self, leaves: boxes.Boxes, trees: int):
        self.leaves, width = leaves, len(leaves.limits)
        deepest = max(1, int(leaves.inside.sum(axis=1).max(initial=1)))
        points, weights = np.polynomial.legendre.leggauss((deepest + 1) // 2)
        self.t, self.scale = (points + 1) / 2, weights[:, None] / 2 * leaves.value / trees
        t, axes = self.t[:, None], range(len(leaves.grid))
        sets = [[a for a in axes if s >> a & 1] for s in range(1 << len(leaves.grid))]
        self.of = []
        for j in range(width):
            mine = np.flatnonzero(leaves.inside[:, j])
            factors, spots = np.zeros((len(sets), len(self.t), len(mine))), []
            for s, chosen in enumerate(sets):
                holds = leaves.inside[mine][:, [leaves.grid[a] for a in chosen]].all(axis=1)
                factor = np.where(holds, 1.0, 0.0) * np.ones((len(self.t), 1))
                for a in axes:
                    f = leaves.grid[a]
                    if f == j:
                        factor = factor if a in chosen else factor * -leaves.reach[mine, f]
                    else:
                        factor = factor * (t if a in chosen else np.where(leaves.inside[mine, f], (1 - t) * leaves.reach[mine, f], 1.0))
                factors[s] = factor
                place, cell, sign = leaves.corners(mine[holds], chosen)
                spots.append((np.flatnonzero(holds)[place] + s * len(mine), cell, sign))
            self.of.append((mine, factors, *(np.concatenate(c) for c in zip(*spots))))

    def table(self, key: np.ndarray) -> np.ndarray:
        leaves, met = self.leaves, self.leaves.met(key).astype(float)
        reach = leaves.reach[:, leaves.key]
        t = self.t[:, None, None]
        each = np.where(leaves.inside[:, leaves.key], t * met + (1 - t) * reach, 1.0)
        whole = self.scale * each.prod(axis=2)
        corners = np.zeros((len(leaves.limits), leaves.cells))
        for j, (mine, factors, source, cell, sign) in enumerate(self.of):
            if not len(mine):
                continue
            part = whole[:, mine]
            if j in leaves.key:
                k = leaves.key.index(j)
                part = part / each[:, mine, k] * (met[mine, k] - reach[mine, k])
            sums = np.einsum("sqn,qn->sn", factors, part)
            corners[j] = np.bincount(cell, sums.ravel()[source] * sign, leaves.cells)
        return leaves.filled(corners)


#: Leaf by leaf, a row takes a fifth of the time of a key's table, and a batch begins with the time of some 300 tables.
FEW_ROWS, FEW_KEYS, ROWS_A_TABLE = 8, 300, 5


def _rare(sizes: np.ndarray) -> np.ndarray:
    """Keys of few rows, if a batch has so many of them that their rows are cheaper leaf by leaf."""
    few = sizes < FEW_ROWS
    return few & (few.sum() > FEW_KEYS + sizes[few].sum() / ROWS_A_TABLE)


def attributions(spark: SparkSession, model: Forest, rows: DataFrame) -> DataFrame:
    """order_id, base value and one column per feature; base + sum equals the predicted chance."""
    nodes = model.nodes()
    trees = int(nodes["tree"].nunique())
    rules = leaf_rules(nodes)
    base = sum(float(np.prod(reach)) * value for _, _, _, reach, value in rules) / trees
    names = list(model.features)
    leaves = boxes.Boxes(rules, boxes.limits_of(nodes, len(names)))
    shared = spark.sparkContext.broadcast((rules, leaves))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, held = None, {}
        for batch in batches:
            rules, leaves = shared.value
            tables = tables or KeyTables(leaves, trees)
            phi = leaves.looked_up(batch[names].to_numpy(dtype=float), held, tables.table, _rare,
                                   lambda x: _attribute(rules, x, trees))
            out = pd.DataFrame(phi, columns=names)
            out.insert(0, "order_id", batch["order_id"].to_numpy())
            out.insert(1, "base_value", base)
            yield out

    key = rows.schema["order_id"].dataType.simpleString()
    schema = f"order_id {key}, base_value double, " + ", ".join(f"{n} double" for n in names)
    return boxes.dealt_by_key(rows.select("order_id", *names), names, leaves).mapInPandas(explain, schema)


def sample_orders(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of n rows."""
    return df.orderBy(F.xxhash64(F.col("order_id"), F.lit(seed)), "order_id").limit(n)


def feature_attribution(phi: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    means = phi.agg(*[F.avg(F.abs(f)).alias(f) for f in features])
    return means.unpivot([], list(features), "feature", "mean_abs")


def category_attribution(phi: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Mean absolute attribution per feature category, with its share and level."""
    category = F.create_map(*[F.lit(x) for pair in FEATURE_CATEGORIES.items() for x in pair])
    sums = feature_attribution(phi, features).groupBy(category[F.col("feature")].alias("category")).agg(
        F.sum("mean_abs").alias("mean_abs"))
    pct = agg.share(F.col("mean_abs"), F.sum("mean_abs").over(Window.partitionBy()))
    return sums.withColumn("pct", pct).withColumn("level", bands.attribution_level(F.col("pct"))).orderBy(
        F.desc("pct"), "category")
