"""Scores and attributions from sums of boxes against leaf by leaf."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelscope.operators import attribution, boxes, features, models

NAMES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def forest(spark):
    rng, rows = random.Random(4), []
    for i in range(1500):
        a, b, c, d, e = rng.random(), rng.randint(0, 3), rng.random(), rng.choice([0, 1]), rng.gauss(0, 2)
        rows.append((i, a, b, c, d, e, int(rng.random() < (0.8 if a > 0.5 and b > 1 else 0.2 + 0.2 * d + 0.1 * (c > 0.7)))))
    df = spark.createDataFrame(rows, "order_id int, a double, b int, c double, d int, e double, label int")
    return df, models.fit_forest(df, NAMES, trees=15, depth=6)


def _parts(model):
    nodes = model.nodes()
    rules = boxes.leaf_rules(nodes)
    return nodes, rules, boxes.Boxes(rules, boxes.limits_of(nodes, len(NAMES)))


def _x(df):
    return df.select(*NAMES).toPandas().to_numpy(dtype=float)


def test_score_tables_equal_walking(forest):
    df, model = forest
    nodes, _, leaves = _parts(model)
    arrays, x = models.full_trees(nodes, model.depth), _x(df)
    assert sorted(leaves.grid + leaves.key) == list(range(5)) and leaves.key
    walked = models.walked(x, *arrays)
    found = leaves.looked_up(x, {}, models.ScoreTables(leaves, 15).table, lambda sizes: sizes < 0, None)[:, 0]
    assert found.tolist() == walked.tolist()                                   # the same to the last bit, so ties stay ties
    mixed = leaves.looked_up(x, {}, models.ScoreTables(leaves, 15).table, lambda sizes: sizes < 200,
                             lambda some: models.walked(some, *arrays)[:, None])[:, 0]
    assert mixed.tolist() == walked.tolist()


def test_attribution_tables_equal_leaf_by_leaf(forest):
    df, model = forest
    _, rules, leaves = _parts(model)
    x = _x(df)[:400]
    x[7, 2], x[9, 1] = np.nan, np.nan
    plain = attribution._attribute(rules, x, 15)
    tables = attribution.KeyTables(leaves, 15)
    for rare in (lambda sizes: sizes < 0, lambda sizes: sizes < 60):
        found = leaves.looked_up(x, {}, tables.table, rare, lambda some: attribution._attribute(rules, some, 15))
        assert found == pytest.approx(plain, abs=1e-13)


def test_tables_are_made_once_per_key(forest):
    """Work goes with the keys and not with the rows: one table for all rows of a key, over several batches too."""
    df, model = forest
    _, _, leaves = _parts(model)
    x = _x(df)
    x = np.repeat(x[:20], 500, axis=0)
    bins = np.stack([np.searchsorted(v, x[:, f]) for f, v in enumerate(leaves.limits)], axis=1)
    x = x[np.lexsort(bins[:, leaves.key].T)]
    tables, made, held = models.ScoreTables(leaves, 15), [], {}

    def table(key):
        made.append(tuple(key))
        return tables.table(key)

    for start in range(0, len(x), 700):
        leaves.looked_up(x[start:start + 700], held, table, lambda sizes: sizes < 0, None)
    assert len(made) == len(set(made)) == len(np.unique(bins[:, leaves.key], axis=0))


def test_scores_of_any_layout(spark, forest):
    df, model = forest
    odd = df.unionByName(df.limit(5).withColumn("a", F.lit(None).cast("double")).withColumn("order_id", F.col("order_id") + 9000))
    want = {r.order_id: r.score for r in models.scored(model, odd.coalesce(1)).collect()}
    got = {r.order_id: r.score for r in models.scored(model, odd.repartition(9)).collect()}
    assert got == want and len(got) == 1505 and sorted(k for k, v in got.items() if v is None) == [9000, 9001, 9002, 9003, 9004]
    assert set(models.scored(model, odd).columns) == {*odd.columns, "score"}
    phi = attribution.attributions(spark, model, df.repartition(9)).toPandas().set_index("order_id")
    score = pd.Series(want)
    assert np.abs(phi.sum(axis=1) - score[phi.index]).max() < 1e-12 and len(phi) == 1500
    assert models.scored(model, df.where("a > 2")).count() == 0


def test_forest_without_splits(spark):
    df = spark.createDataFrame([(i, 1.0, 2, 0.5, 1, 0.0, i % 2) for i in range(200)],
                               "order_id int, a double, b int, c double, d int, e double, label int")
    model = models.fit_forest(df, NAMES, trees=3, depth=4)
    scores = {r.score for r in models.scored(model, df).collect()}
    phi = attribution.attributions(spark, model, df).collect()
    assert len(scores) == 1 and all(r[f] == 0 for r in phi for f in NAMES) and phi[0].base_value == pytest.approx(scores.pop())


def test_parts_are_stored(spark):
    df = spark.range(1000).select(F.col("id").alias("order_id"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    train, test = features.parts_of(features.marked_rows(df))
    again = features.split_rows(df)
    assert (train.count(), test.count()) == (800, 200) == (again[0].count(), again[1].count())
    assert test.where("label = 1").count() == 40 and train.columns == df.columns
