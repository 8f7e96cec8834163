"""Training of forests: against plain counts, on odd rows, and whatever the partitions."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelscope.operators import forests, models

NAMES = ["a", "b", "c", "d"]


def _rows(n=900, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c, d = rng.random(), rng.randint(0, 5), rng.choice([0, 1]), round(rng.gauss(0, 1), 1)
        out.append((i, a, b, c, d, int(rng.random() < (0.8 if a > 0.5 and b > 2 else 0.15 + 0.1 * c))))
    return out


def _table(spark, rows):
    return spark.createDataFrame(rows, "order_id int, a double, b int, c int, d double, label int")


def _nodes(model):
    return model.nodes().sort_values(["tree", "id"]).reset_index(drop=True)


def test_forest_does_not_depend_on_partitions(spark):
    df = _table(spark, _rows())
    one = models.fit_forest(df.coalesce(1), NAMES, trees=6, depth=5)
    many = models.fit_forest(df.orderBy(F.desc("order_id")).repartition(7), NAMES, trees=6, depth=5)
    pd.testing.assert_frame_equal(_nodes(one), _nodes(many))
    assert not _nodes(one).equals(_nodes(models.fit_forest(df, NAMES, trees=6, depth=5, seed=43)))


def test_nodes_hold_the_rows_that_reach_them(spark):
    """Every node's counts and gain from the drawn rows themselves, and no better split among the features looked at."""
    rows, depth, seed, trees = _rows(), 4, 42, 5
    df = _table(spark, rows).select(*[F.col(f).cast("double").alias(f) for f in NAMES], F.col("label").cast("double").alias("label"))
    grown, limits = forests.grow(df, NAMES, trees, depth, seed)
    assert [len(v) for v in limits[1:3]] == [5, 1]
    plain = pd.DataFrame(rows, columns=["order_id", *NAMES, "label"])
    cells = forests.binned(df, NAMES, limits, 3).toPandas()
    assert cells["n"].sum() == len(plain)
    block = forests.Block(cells, len(NAMES), forests.joined(limits), seed)
    bins = np.stack([np.searchsorted(v, plain[f]) for f, v in zip(NAMES, limits)])
    assert sorted(zip(*np.repeat(block.codes, cells["n"], axis=1).tolist())) == sorted(zip(*(2 * bins + plain["label"].to_numpy()).tolist()))
    gini = lambda c: 1 - ((c / c.sum()) ** 2).sum()
    checked = 0
    for t in range(trees):
        weight = block.weights(t, {})
        reach = {0: np.ones(len(weight), bool)}
        for place in range((1 << depth) - 1):
            if place not in reach:
                continue
            count = lambda at: np.array([weight[at & (block.codes[0] % 2 == y)].sum() for y in (0, 1)])
            here = reach[place]
            if count(here).sum():
                assert grown.count[t, place].tolist() == count(here).tolist()
            if not count(here).all():
                assert grown.feature[t, place] == -1
                continue
            falls = {}
            for f in grown.asked[t, place]:
                for cut in range(len(limits[f])):
                    left, right = here & (block.codes[f] // 2 <= cut), here & (block.codes[f] // 2 > cut)
                    a, b = count(left), count(right)
                    if a.sum() and b.sum():
                        falls[f, cut] = gini(a + b) - (a.sum() * gini(a) + b.sum() * gini(b)) / (a + b).sum()
            best = max(falls.values(), default=-1)
            if grown.feature[t, place] < 0:
                assert best <= 1e-12
                continue
            f, cut = grown.feature[t, place], grown.cut[t, place]
            assert falls[f, cut] == pytest.approx(best, abs=1e-12) == grown.gain[t, place]
            reach[2 * place + 1], reach[2 * place + 2] = here & (block.codes[f] // 2 <= cut), here & (block.codes[f] // 2 > cut)
            checked += 1
    assert checked > 20


def test_draws_are_poisson():
    n = 40_000
    cells = pd.DataFrame({"w0": np.arange(n), "label": 0, "n": np.where(np.arange(n) % 2, 1, 13)})
    block = forests.Block(cells, 3, [[(0, 0, 5)], [(1, 0, 5)], [(2, 0, 5)]], 42)
    drawn = np.stack([block.weights(t, {}) for t in range(9)])
    for part, mean in ((drawn[:, 1::2], 1), (drawn[:, ::2], 13)):
        assert part.mean() == pytest.approx(mean, rel=0.01) and part.var() == pytest.approx(mean, rel=0.03)
        assert np.abs(np.corrcoef(part) - np.eye(9)).max() < 0.04
    assert (part.shape == (9, n // 2)) and (drawn[:, 1::2] == 0).mean() == pytest.approx(math.exp(-1), abs=0.01)
    large = forests.poisson_table(14)
    assert large.mean() == pytest.approx(1 << 14, rel=1e-3) and large.var() == pytest.approx(1 << 14, rel=0.01)


def test_forest_on_odd_rows(spark):
    same = models.fit_forest(_table(spark, [(i, 1.0, 2, 0, 0.5, int(i % 4 == 0)) for i in range(4000)]), NAMES, trees=3, depth=3)
    nodes = same.nodes()
    assert (nodes["left"] == -1).all() and len(nodes) == 3
    assert (nodes["positive"] / nodes["cover"]).tolist() == pytest.approx([0.25] * 3, abs=0.05)
    alike = models.fit_forest(_table(spark, [(i, float(i), i, 0, None or 0.0, 1) for i in range(50)]), NAMES, trees=3, depth=3)
    assert [r.score for r in models.scored(alike, _table(spark, [(1, 0.0, 0, 0, 0.0, 1)])).collect()] == [1.0]
    single = models.fit_forest(_table(spark, [(1, 1.0, 1, 1, 1.0, 1)]), NAMES, trees=9, depth=3).nodes()
    assert (single["positive"] == single["cover"]).all() and (single["cover"] > 0).all()
    with pytest.raises(ValueError):
        models.fit_forest(_table(spark, []), NAMES, trees=2, depth=2)
    with pytest.raises(Exception, match="missing"):
        models.fit_forest(_table(spark, [(1, None, 1, 1, 1.0, 1), (2, 1.0, 1, 1, 1.0, 0)]), NAMES, trees=2, depth=2)


def test_more_features_than_one_number_holds(spark):
    rng, names = random.Random(2), [f"x{i}" for i in range(15)]
    rows = [(i, *[rng.random() for _ in names], 0) for i in range(600)]
    rows = [(*r[:-1], int(r[14] > 0.5)) for r in rows]                        # x13 decides
    model = models.fit_forest(spark.createDataFrame(rows, ["order_id", *names, "label"]), names, trees=12, depth=4)
    assert models.importances(model).first().feature == "x13"
