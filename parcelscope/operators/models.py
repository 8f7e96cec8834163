"""Failure-risk models: logistic regression and random forest, and their scores without the fitted library objects."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bands
from ..session import fresh_path, written
from . import boxes, forests
from .distribution import running_counts
from .features import FEATURES

# The functions run in Python workers travel with the job; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RISK_FEATURES = ["region_enc", "day_enc", "delivery_hour", "order_amount", "items_delivered",
                 "driver_hist_rate"]

# fixed values: what each factor means and the action for it
FACTOR_ACTIONS = {
    "driver_fail_rate": ("Driver history is the main predictor of future failure",
                         "Targeted training program for high-risk drivers"),
    "delivery_hour": ("Delivery time slot influences the operational error rate",
                      "Review processes during identified peak hours"),
    "region_enc": ("Some regions have inferior infrastructure/processes",
                   "Operational audit in the highest-failure regions"),
    "order_amount": ("Higher-value orders tend to have more items and a higher chance of failure",
                     "Mandatory double-check for orders above the average ticket"),
    "items_delivered": ("Orders with more items are harder to verify",
                        "Digital checklist for orders with more than X items"),
    "is_monday": ("Monday concentrates more failures (post-weekend operations)",
                  "Staff reinforcement on Mondays"),
    "customer_age": ("Customer profile correlates with order type and tolerance",
                     "Monitor complaints by age group"),
    "is_weekend": ("Weekends have a different operation dynamic", "Scale up team on weekends"),
    "period_enc": ("Time of day impacts delivery quality", "Redistribute deliveries to lower-failure periods"),
}


# ---- logistic regression

@dataclass(frozen=True)
class Logistic:
    """A fitted regression: each feature as (x - centre) * scale, then weights and an intercept."""

    features: tuple[str, ...]
    centres: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float
    rows: int
    penalty: float

    def linear(self) -> Column:
        terms = [(F.col(f).cast("double") - c) * (s * w)
                 for f, c, s, w in zip(self.features, self.centres, self.scales, self.weights)]
        return sum(terms, F.lit(self.intercept))

    def score(self) -> Column:
        """Plain arithmetic on the feature columns; null where a feature is."""
        return 1 / (1 + F.exp(-self.linear()))


def scaling(df: DataFrame, features: Sequence[str]) -> tuple[list[float], list[float]]:
    """Mean of each feature, and one over its sample deviation (0 for a feature without spread)."""
    row = df.agg(*[F.struct(F.avg(f).alias("mean"), F.stddev_samp(f).alias("sd")).alias(f"f{i}")
                   for i, f in enumerate(features)]).first()
    return ([float(row[i].mean or 0) for i in range(len(features))],
            [1 / row[i].sd if row[i].sd else 0.0 for i in range(len(features))])


def standardised(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds f_z for each feature. The scale uses the sample deviation, which is larger than the population
    one by sqrt(n / (n - 1)); a feature without any spread is 0 everywhere."""
    means, scales = scaling(df, features)
    return df.select("*", *[((F.col(f) - m) * s).alias(f"{f}_z") for f, m, s in zip(features, means, scales)])


def gradient(df: DataFrame, model: Logistic) -> list[float]:
    """Slope of the penalised loss at the model: one per feature and the intercept's; zero at the optimum."""
    return _newton_sums(df, model)[1].tolist()


def _newton_sums(df: DataFrame, model: Logistic) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature at a model: one aggregate of d squared sums, whatever the rows."""
    d = len(model.features)
    x = [*((F.col(f).cast("double") - c) * s for f, c, s in zip(model.features, model.centres, model.scales)), F.lit(1.0)]
    rows = df.select(model.linear().alias("eta"), F.col("label").cast("double").alias("y"),
                     *[v.alias(f"x{i}") for i, v in enumerate(x)]).withColumn("p", 1 / (1 + F.exp(-F.col("eta"))))
    # log(1 + e^eta) without overflow.
    loss = F.greatest("eta", F.lit(0.0)) + F.log1p(F.exp(-F.abs("eta"))) - F.col("y") * F.col("eta")
    spread = F.col("p") * (1 - F.col("p"))
    pairs = [(i, j) for i in range(d + 1) for j in range(i + 1)]
    sums = rows.agg(F.sum(loss), *[F.sum((F.col("p") - F.col("y")) * F.col(f"x{i}")) for i in range(d + 1)],
                    *[F.sum(spread * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).first()
    weights = np.array([*model.weights, 0.0])
    curvature = np.zeros((d + 1, d + 1))
    for (i, j), value in zip(pairs, sums[d + 2:]):
        curvature[i, j] = curvature[j, i] = value
    curvature[np.arange(d), np.arange(d)] += model.penalty
    return (sums[0] + model.penalty * float(weights @ weights) / 2,
            np.array(sums[1:d + 2]) + model.penalty * weights, curvature)


def fit_logistic(train: DataFrame, features: Sequence[str] = FEATURES, standardise: bool = True,
                 strength: float = 1.0, rounds: int = 50) -> Logistic:
    """L2-penalised logistic regression: the sum of log losses plus |weights|^2 / (2 strength); the intercept is free.

    Newton's method: each round is one aggregate over the rows and the solution of a system as wide as the
    features; steps that would raise the loss are halved. The optimum is unique, and reached to rounding
    in a few rounds. Rows with one label only have no optimum: all weights are 0 and the score is the label.
    """
    d = len(features)
    counts = train.agg(F.count("label").alias("n"), F.sum("label").alias("failed")).first()
    if not counts.n:
        raise ValueError("no labelled rows to fit")
    centres, scales = scaling(train, features) if standardise else ([0.0] * d, [1.0] * d)
    model = Logistic(tuple(features), tuple(centres), tuple(scales), (0.0,) * d, 0.0, counts.n, 1 / strength)
    if counts.failed in (0, counts.n):
        return replace(model, intercept=math.inf if counts.failed else -math.inf)
    model = replace(model, intercept=math.log(counts.failed / (counts.n - counts.failed)))
    loss, slope, curvature = _newton_sums(train, model)
    for _ in range(rounds):
        unit = 1 / np.sqrt(np.diagonal(curvature))
        step = unit * np.linalg.lstsq(curvature * np.outer(unit, unit), slope * unit, rcond=None)[0]
        for _ in range(30):
            moved = replace(model, weights=tuple(float(w - s) for w, s in zip(model.weights, step)),
                            intercept=float(model.intercept - step[-1]))
            after = _newton_sums(train, moved)
            if after[0] <= loss + 1e-12 * abs(loss):
                break
            step = step / 2
        # Steps are compared with the spread of the linear score, so that units of features do not matter.
        small = float(np.abs(step / unit).max()) < 1e-9 * math.sqrt(counts.n)
        model, (loss, slope, curvature) = moved, after
        if small:
            break
    return model


# ---- random forest

@dataclass(frozen=True)
class Forest:
    """A fitted forest as its table of nodes: tree, id, left, right, feature, threshold, cover, positive, gain.

    `cover` and `positive` are the weighted training rows of a node, all and failed. The number of nodes is
    bounded by trees x 2^(depth + 1), whatever the data.
    """

    features: tuple[str, ...]
    table: DataFrame
    depth: int

    def nodes(self) -> pd.DataFrame:
        return self.table.toPandas()


def fit_forest(train: DataFrame, features: Sequence[str] = FEATURES, trees: int = 300,
               depth: int = 8, seed: int = 42) -> Forest:
    """A table of nodes, from which scores, importances and attributions come.

    Gini splits on the square root of the features at each node, 32 bins a feature, rows drawn with replacement for every tree.
    """
    rows = train.select(*[F.col(f).cast("double").alias(f) for f in features], F.col("label").cast("double").alias("label"))
    nodes = forests.node_table(*forests.grow(rows, features, trees, depth, seed))
    return Forest(tuple(features), written(train.sparkSession.createDataFrame(nodes, forests.NODE_SCHEMA), "forest"), depth)


def forest_table(spark: SparkSession, fitted: RandomForestClassificationModel) -> DataFrame:
    """The same table of nodes for a forest that the library has trained."""
    path = fresh_path(spark, "forest")
    fitted.save(path)
    # `impurityStats` holds the weighted rows per class, so its sum is the cover of the node.
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("id"),
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.aggregate("nodeData.impurityStats", F.lit(0.0), lambda a, x: a + x).alias("cover"),
        F.col("nodeData.impurityStats")[1].alias("positive"), F.col("nodeData.gain").alias("gain"))


#: Leaf values are added as whole numbers of 2^-VALUE_BITS, so that a score does not depend on the order of the leaves.
VALUE_BITS = 50


def whole_value(value: np.ndarray) -> np.ndarray:
    return np.rint(np.asarray(value, float) * (1 << VALUE_BITS)).astype(np.int64)


def full_trees(nodes: pd.DataFrame, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, threshold) per tree and inner place, and the leaf value (a whole number) per tree and last place.

    Trees are filled up to the same depth: the children of place k are 2k + 1 and 2k + 2, and below a leaf every place
    has its value. So all trees are walked in step.
    """
    trees, inner = nodes["tree"].nunique(), (1 << depth) - 1
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, inner + 1))
    for t, (_, tree) in enumerate(nodes.groupby("tree")):
        by_id = {row.id: row for row in tree.itertuples()}
        stack = [(0, 0, 0)]
        while stack:
            name, place, level = stack.pop()
            node = by_id[name]
            if level == depth:
                value[t, place - inner] = node.positive / node.cover
                continue
            if node.left >= 0:
                feature[t, place], threshold[t, place] = node.feature, node.threshold
            sides = (node.left, node.right) if node.left >= 0 else (name, name)
            stack += [(side, 2 * place + 1 + i, level + 1) for i, side in enumerate(sides)]
    return feature, threshold, whole_value(value)


def walked(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, rows: int = 2048) -> np.ndarray:
    """Mean leaf value over the trees for each row of x; NaN where a feature is missing."""
    trees, inner = feature.shape
    base, flat_feature, flat_threshold = (np.arange(trees) * inner)[:, None], feature.ravel(), threshold.ravel()
    leaves, out = (np.arange(trees) * (inner + 1))[:, None], np.empty(len(x))
    for start in range(0, len(x), rows):
        part = x[start:start + rows]
        flat, row = part.ravel(), (np.arange(len(part)) * part.shape[1])[None, :]
        place = np.zeros((trees, len(part)), np.int64)
        while inner and place.min(initial=inner) < inner:
            at = base + place
            place = 2 * place + 1 + ~(flat[row + flat_feature[at]] <= flat_threshold[at])
        mean = value.ravel()[leaves + place - inner].sum(axis=0) / (trees * 2.0 ** VALUE_BITS)
        out[start:start + rows] = np.where(np.isnan(part).any(axis=1), np.nan, mean)
    return out


class ScoreTables:
    """Scores of all cells of a key's grid: the values of the leaves whose other features the key meets, summed over their boxes."""

    def __init__(self, leaves: boxes.Boxes, trees: int):
        self.leaves, self.scale, self.value = leaves, trees * 2.0 ** VALUE_BITS, whole_value(leaves.value)
        bounded = leaves.inside[:, leaves.grid] @ (1 << np.arange(len(leaves.grid)))
        spots = []
        for s in np.unique(bounded):
            mine = np.flatnonzero(bounded == s)
            place, cell, sign = leaves.corners(mine, [a for a in range(len(leaves.grid)) if s >> a & 1])
            spots.append((mine[place], cell, sign))
        self.leaf, self.cell, self.sign = (np.concatenate(c) for c in zip(*spots))

    def table(self, key: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.leaves.met(key).all(axis=1)[self.leaf])
        corners = np.zeros((1, self.leaves.cells), np.int64)
        np.add.at(corners[0], self.cell[at], self.value[self.leaf[at]] * self.sign[at])
        return self.leaves.filled(corners) / self.scale


#: A key's table takes the time of walking about so many rows through a forest of 300 trees.
WALKED_ROWS = 50


def forest_score(forest: Forest, leaves: boxes.Boxes) -> Column:
    """Score as a vectorised function of the feature columns; only they go to Python. Rows may come in any order, and
    take less time where those of a key follow each other."""
    nodes = forest.nodes()
    shared = forest.table.sparkSession.sparkContext.broadcast((full_trees(nodes, forest.depth), leaves))

    @F.pandas_udf("double")
    def score(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        tables, held = None, {}
        for batch in columns:
            arrays, leaves = shared.value
            tables = tables or ScoreTables(leaves, len(arrays[0]))
            x = np.column_stack([c.to_numpy(dtype=float) for c in batch])
            yield pd.Series(leaves.looked_up(x, held, tables.table, lambda sizes: sizes < WALKED_ROWS,
                                             lambda rows: walked(rows, *arrays)[:, None])[:, 0] if len(x) else [], dtype=float)

    return F.nanvl(score(*[F.col(f).cast("double") for f in forest.features]), F.lit(None).cast("double"))


def forest_scored(forest: Forest, df: DataFrame) -> DataFrame:
    leaves = boxes.of_nodes(forest.nodes(), len(forest.features))
    return boxes.dealt_by_key(df, forest.features, leaves).withColumn("score", forest_score(forest, leaves))


def importances(forest: Forest) -> DataFrame:
    """Fall of impurity times rows, over the splits of each feature, as a share within each tree, then over all trees.

    Features that no tree splits on have 0; a tree without splits takes no part.
    """
    spark = forest.table.sparkSession
    names = spark.createDataFrame(list(enumerate(forest.features)), "feature int, name string")
    splits = forest.table.where("left >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("cover")).alias("fall"))
    of_tree = Window.partitionBy("tree")
    shares = splits.withColumn("share", F.try_divide("fall", F.sum("fall").over(of_tree))).groupBy("feature").agg(
        F.sum("share").alias("share"))
    total = F.sum("share").over(Window.partitionBy())
    return names.join(shares, "feature", "left").select(
        F.col("name").alias("feature"), F.coalesce(F.try_divide(F.col("share"), total), F.lit(0.0)).alias("importance")).orderBy(
        F.desc("importance"), "feature")


# ---- scores

Model = Logistic | Forest


def scored(model: Model, df: DataFrame) -> DataFrame:
    """Adds score, the predicted chance of a failure; rows that lack a feature have none."""
    return df.withColumn("score", model.score()) if isinstance(model, Logistic) else forest_scored(model, df)


def auc(predictions: DataFrame) -> float:
    return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="score",
                                         metricName="areaUnderROC", numBins=0).evaluate(predictions)


def roc_curve(predictions: DataFrame) -> DataFrame:
    """False and true positive rate when everything from a score upwards counts as a failure."""
    counts = predictions.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    run = running_counts(counts, "score", ["pos", "neg"])
    above = lambda w: F.try_divide(F.col(f"{w}_total") - F.col(f"{w}_before"), F.col(f"{w}_total"))
    return run.select(F.col("score").alias("threshold"), above("neg").alias("fpr"), above("pos").alias("tpr"))


def auc_from_counts(predictions: DataFrame) -> DataFrame:
    """Area under the curve as the chance that a failed order scores above a good one."""
    counts = predictions.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    run = running_counts(counts, "score", ["pos", "neg"])
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2))
    return run.agg(F.try_divide(wins, F.max("pos_total").cast("double") * F.max("neg_total")).alias("auc"))


def odds_ratios(spark: SparkSession, model: Logistic) -> DataFrame:
    rows = [(f, w, math.exp(w)) for f, w in zip(model.features, model.weights)]
    return spark.createDataFrame(rows, "feature string, coef double, odds_ratio double").orderBy(
        F.desc("odds_ratio"), "feature")


def top_factors(factor_importance: DataFrame, k: int = 5) -> DataFrame:
    text = F.create_map(*[x for f, (meaning, action) in FACTOR_ACTIONS.items()
                          for x in (F.lit(f), F.struct(F.lit(meaning).alias("interpretation"),
                                                       F.lit(action).alias("action")))])
    return factor_importance.orderBy(F.desc("importance"), "feature").limit(k).withColumn(
        "t", F.try_element_at(text, F.col("feature"))).select("feature", "importance", "t.*")


def risk_scores(model: Logistic, scenarios: DataFrame, base_rate: Column) -> DataFrame:
    """Probability, label, distance to the overall rate and the share of each raw feature in the
    linear score, for any number of orders or what-if rows."""
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f) * w).alias("contribution"))
                      for f, w in zip(model.features, model.weights)])
    return scored(model, scenarios).withColumn("base_rate", base_rate).select(
        "order_id", F.col("score").alias("probability"), bands.risk_label(F.col("score")).alias("risk_label"),
        ((F.col("score") - F.col("base_rate")) * 100).alias("delta_pp"), parts.alias("contributions"))
