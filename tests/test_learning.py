"""Models, clusters and attribution: properties that must hold whatever the random numbers."""

import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from parcelscope.operators import attribution, clusters, features, kpis, models
from parcelscope.sources.lens import Deliveries


@pytest.fixture(scope="module")
def table(spark, sf):
    t = Deliveries(spark, sf)
    return features.feature_table(t.orders, t.customers).persist()


@pytest.fixture(scope="module")
def small_forest(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        a, b, c = rng.random(), rng.randint(0, 5), rng.random()
        rows.append((i, a, b, c, int(rng.random() < (0.8 if a > 0.5 and b > 2 else 0.2))))
    df = spark.createDataFrame(rows, "order_id int, a double, b int, c double, label int")
    return df, models.fit_forest(df, ["a", "b", "c"], trees=4, depth=4)


def test_attribution_adds_up_to_the_prediction(spark, small_forest):
    df, model = small_forest
    phi = attribution.attributions(spark, model, df)
    worst = phi.join(models.scored(model, df).select("order_id", "score"), "order_id").select(
        F.max(F.abs(F.col("base_value") + F.col("a") + F.col("b") + F.col("c") - F.col("score")))).collect()[0][0]
    assert worst < 1e-9


def _expected(by_id, node, x, known):
    """Mean prediction of a tree when only the features in `known` are given."""
    n = by_id[node]
    if n.left < 0:
        return n.positive / n.cover
    if n.feature in known:
        return _expected(by_id, n.left if x[n.feature] <= n.threshold else n.right, x, known)
    return sum(by_id[k].cover / n.cover * _expected(by_id, k, x, known) for k in (n.left, n.right))


def test_attribution_equals_the_definition(spark, small_forest):
    df, model = small_forest
    nodes = model.nodes()
    trees = [{r.id: r for r in t.itertuples()} for _, t in nodes.groupby("tree")]
    some = df.where("order_id < 12")
    got = {r.order_id: (r.a, r.b, r.c) for r in attribution.attributions(spark, model, some).collect()}
    for row in some.collect():
        x = (row.a, row.b, row.c)
        for i in range(3):
            want, others = 0.0, [j for j in range(3) if j != i]
            for size in range(3):
                for known in itertools.combinations(others, size):
                    weight = math.factorial(size) * math.factorial(2 - size) / math.factorial(3)
                    want += weight * np.mean([_expected(t, 0, x, {*known, i}) - _expected(t, 0, x, set(known)) for t in trees])
            assert got[row.order_id][i] == pytest.approx(want, abs=1e-12)


def test_category_shares(spark, table):
    train, test = features.split_rows(table)
    model = models.fit_forest(train, trees=5, depth=5)
    shares = attribution.category_attribution(attribution.attributions(spark, model, test)).collect()
    assert sum(r.pct for r in shares) == pytest.approx(100.0)
    assert {r.category for r in shares} == {"Driver", "Customer", "Order", "Time", "Location"}
    names = models.importances(model).collect()
    assert sum(r.importance for r in names) == pytest.approx(1.0)
    assert [r.feature for r in models.top_factors(models.importances(model), 5).collect()] == [
        r.feature for r in names[:5]]


def test_auc_forms_agree(spark, table):
    train, test = features.split_rows(table)
    scores = models.scored(models.fit_forest(train, trees=5, depth=4), test).select("label", "score").persist()
    area = models.auc_from_counts(scores).collect()[0].auc
    pos = [r.score for r in scores.where("label = 1").collect()]
    neg = [r.score for r in scores.where("label = 0").collect()]
    pairs = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert area == pytest.approx(pairs) and models.auc(scores) == pytest.approx(pairs)
    curve = models.roc_curve(scores).orderBy(F.desc("threshold")).collect()
    assert curve[-1].fpr == curve[-1].tpr == 1.0
    assert all(a.fpr <= b.fpr and a.tpr <= b.tpr for a, b in zip(curve, curve[1:]))


def test_model_finds_the_planted_driver_effect(spark):
    t = Deliveries(spark, "/root/testdata/sf0.01")
    path_rows = features.feature_table(t.orders, t.customers).persist()
    train, test = features.split_rows(path_rows)
    model = models.fit_logistic(train)
    assert models.auc(models.scored(model, test)) > 0.6
    best = models.odds_ratios(spark, model).collect()[0]
    assert best.feature == "driver_fail_rate" and best.odds_ratio == pytest.approx(math.exp(best.coef))
    path_rows.unpersist()


def test_risk_scores(spark, sf):
    t = Deliveries(spark, sf)
    rows = features.risk_features(t.orders).persist()
    model = models.fit_logistic(rows, models.RISK_FEATURES, standardise=False)
    base = kpis.global_scalar(t.orders_without_region)["failure_rate"]
    scored = models.risk_scores(model, rows, base)
    for r in scored.limit(5).collect():
        linear = sum(c.contribution for c in r.contributions) + model.intercept
        assert r.probability == pytest.approx(1 / (1 + math.exp(-linear)))
        assert r.risk_label in ("Low Risk", "Medium Risk", "High Risk")


def test_clusters(spark, sf):
    t = Deliveries(spark, sf)
    rows = clusters.customer_features(t.orders_without_region, t.customers).persist()
    model = clusters.fit_clusters(rows, clusters.CUSTOMER_FEATURES, 4, "customer_id")
    summary = clusters.customer_clusters(clusters.assigned(model, rows)).collect()
    spend = {r.segment: r.avg_spent for r in summary}
    assert [spend[s] for s in clusters.CUSTOMER_SEGMENTS] == sorted(spend.values(), reverse=True)
    assert sum(r.n_customers for r in summary) == rows.count()
    inertia = [r.inertia for r in clusters.elbow(spark, rows, clusters.CUSTOMER_FEATURES, "customer_id", range(2, 5)).orderBy("k").collect()]
    assert inertia[-1] < inertia[0]
    axes = clusters.principal_axes(rows, clusters.CUSTOMER_FEATURES)
    r = clusters.projected(axes, rows, "customer_id").collect()[0]
    assert 0 < r.explained2 <= r.explained1 < 1


def test_standardised_columns(spark, sf):
    rows = clusters.driver_features(Deliveries(spark, sf).orders)
    z = models.standardised(rows, clusters.DRIVER_FEATURES).agg(
        F.avg("missing_rate_z").alias("m"), F.stddev_samp("missing_rate_z").alias("s")).collect()[0]
    assert z.m == pytest.approx(0, abs=1e-9) and z.s == pytest.approx(1)


def test_sample_is_repeatable(spark):
    ids = spark.range(1000).withColumnRenamed("id", "order_id")
    first = [r.order_id for r in attribution.sample_orders(ids, 50).collect()]
    again = [r.order_id for r in attribution.sample_orders(ids.repartition(7), 50).collect()]
    assert first == again and len(set(first)) == 50


# ---- forests against the library, and against SQL over their exported nodes

def test_scores_and_importances_equal_the_library(spark, table):
    train, test = features.split_rows(table)
    estimator = RandomForestClassifier(numTrees=7, maxDepth=6, featureSubsetStrategy="sqrt", seed=3)
    library = Pipeline(stages=[VectorAssembler(inputCols=features.FEATURES, outputCol="features"), estimator]).fit(train)
    own = models.Forest(tuple(features.FEATURES), models.forest_table(spark, library.stages[-1]), 6)
    for r in models.scored(own, test).limit(200).collect():
        theirs = library.stages[-1].predictProbability(Vectors.dense([float(r[f]) for f in features.FEATURES]))[1]
        assert r.score == pytest.approx(theirs, abs=1e-12)
    got = {r.feature: r.importance for r in models.importances(own).collect()}
    assert [got[f] for f in features.FEATURES] == pytest.approx(library.stages[-1].featureImportances.toArray(), abs=1e-12)


def test_regression_equals_the_library(spark, table):
    own = models.fit_logistic(table, strength=1.0)
    rows = models.standardised(table, features.FEATURES)
    estimator = LogisticRegression(maxIter=1000, tol=1e-12, regParam=1 / rows.count(), standardization=False)
    names = [f"{f}_z" for f in features.FEATURES]
    library = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), estimator]).fit(rows).stages[-1]
    assert own.weights == pytest.approx(library.coefficients.toArray(), abs=1e-6)
    assert own.intercept == pytest.approx(library.intercept, abs=1e-6)
    assert max(map(abs, models.gradient(table, own))) < 1e-9


def test_regression_on_odd_rows(spark):
    rows = lambda data: spark.createDataFrame(data, "a double, b double, label int")
    alike = models.fit_logistic(rows([(1.0, 2.0, 1), (2.0, 2.0, 1)]), ["a", "b"])
    assert alike.weights == (0.0, 0.0) and alike.intercept == math.inf
    assert [r.score for r in models.scored(alike, rows([(1.0, 2.0, 1)])).collect()] == [1.0]
    apart = models.fit_logistic(rows([(float(i), 5.0, int(i > 3)) for i in range(8)] * 2), ["a", "b"])
    assert apart.weights[1] == 0.0 and 0 < apart.weights[0] < 10
    got = models.scored(apart, rows([(None, 5.0, 0), (0.0, 5.0, 0), (7.0, 5.0, 1)])).collect()
    assert got[0].score is None and got[1].score < 0.1 < 0.9 < got[2].score
    with pytest.raises(ValueError):
        models.fit_logistic(rows([]), ["a", "b"])


IMPORTANCE_SQL = """WITH f AS (SELECT n.tree, n.feature, n.cover * (2 * (n.positive / n.cover) * (1 - n.positive / n.cover))
      - l.cover * (2 * (l.positive / l.cover) * (1 - l.positive / l.cover)) - r.cover * (2 * (r.positive / r.cover) * (1 - r.positive / r.cover)) AS fall
    FROM nodes n JOIN nodes l ON l.tree = n.tree AND l.id = n."left" JOIN nodes r ON r.tree = n.tree AND r.id = n."right"),
  s AS (SELECT feature, sum(fall / total) AS share FROM f JOIN (SELECT tree, sum(fall) AS total FROM f GROUP BY 1) USING (tree) GROUP BY 1)
SELECT feature, share / sum(share) OVER () FROM s"""

# Every feature set, walked through every tree: a known feature decides, an unknown one takes both sides by their rows.
SHAPLEY_SQL = """WITH RECURSIVE w AS (
    SELECT order_id, x, tree, mask, 0 AS node, 1.0::DOUBLE AS weight FROM rows, (SELECT DISTINCT tree FROM nodes), range({sets}) m(mask)
    UNION ALL SELECT order_id, x, w.tree, mask, c.id, weight * CASE WHEN mask >> n.feature & 1 = 1 THEN 1 ELSE c.cover / n.cover END
    FROM w JOIN nodes n ON n.tree = w.tree AND n.id = w.node AND n."left" >= 0 JOIN nodes c ON c.tree = w.tree AND c.id IN (n."left", n."right")
    WHERE mask >> n.feature & 1 = 0 OR (c.id = n."left") = (x[n.feature + 1] <= n.threshold)),
  v AS (SELECT order_id, mask, sum(weight * positive / cover) / count(DISTINCT w.tree) AS value
        FROM w JOIN nodes n ON n.tree = w.tree AND n.id = w.node AND n."left" < 0 GROUP BY 1, 2)
SELECT a.order_id, i, sum(factorial(bit_count(a.mask)) * factorial({d} - 1 - bit_count(a.mask)) / factorial({d}) * (b.value - a.value))
FROM range({d}) f(i) JOIN v a ON a.mask >> i & 1 = 0 JOIN v b ON b.order_id = a.order_id AND b.mask = a.mask + (1 << i) GROUP BY 1, 2"""


def test_attributions_and_importances_equal_sql_over_the_nodes(spark, table):
    train, test = features.split_rows(table)
    model = models.fit_forest(train, trees=4, depth=4)
    some = attribution.sample_orders(test, 8)
    con = duckdb.connect()
    nodes, rows = model.nodes(), some.select("order_id", F.array(*[F.col(f).cast("double") for f in features.FEATURES]).alias("x")).toPandas()
    con.register("nodes", nodes)
    con.register("rows", rows)
    d = len(features.FEATURES)
    want = {(r, features.FEATURES[i]): v for r, i, v in con.execute(SHAPLEY_SQL.format(sets=1 << d, d=d)).fetchall()}
    phi = attribution.attributions(spark, model, some)
    got = {(r.order_id, f): r[f] for r in phi.collect() for f in features.FEATURES}
    assert len(got) == 8 * d and got == pytest.approx(want, abs=1e-12)
    means = {r.feature: r.mean_abs for r in attribution.feature_attribution(phi).collect()}
    for f in features.FEATURES:
        assert means[f] == pytest.approx(np.mean([abs(v) for (_, g), v in want.items() if g == f]), abs=1e-12)
    shares = {features.FEATURES[i]: v for i, v in con.execute(IMPORTANCE_SQL).fetchall()}
    ranked = models.importances(model).collect()
    assert {r.feature: r.importance for r in ranked if r.importance} == pytest.approx(shares, abs=1e-9)
    assert [r.feature for r in models.top_factors(models.importances(model)).collect()] == [r.feature for r in ranked[:5]]


def test_clusters_on_odd_rows(spark):
    rows = lambda data: spark.createDataFrame(data, "id int, a double, b double")
    empty = clusters.fit_clusters(rows([]), ["a", "b"], 3, "id")
    assert len(empty.centres) == 0 and clusters.assigned(empty, rows([(1, 1.0, 2.0)])).collect()[0].cluster is None
    two = clusters.fit_clusters(rows([(1, 0.0, None), (2, 9.0, 1.0)]), ["a", "b"], 3, "id")
    assert len(two.centres) == 2 and two.inertia == pytest.approx(0.0)
    same = clusters.fit_clusters(rows([(i, 1.0, 1.0) for i in range(9)]), ["a", "b"], 3, "id")
    assert {r.cluster for r in clusters.assigned(same, rows([(5, 1.0, 1.0), (None, None, None)])).collect()} == {0}


def test_clusters_are_a_fixed_point(spark):
    draw = random.Random(3)
    points = [(i, draw.gauss(3 * (i % 4), 1), draw.gauss(2 * (i % 3), 1)) for i in range(600)]
    df = spark.createDataFrame(points, "id int, a double, b double").repartition(7)
    found = clusters.fit_all(df, ["a", "b"], [2, 3, 5], "id")
    for k, model in found.items():
        x = (np.array([p[1:] for p in points]) - model.means) * model.scales
        far = ((x[:, None] - model.centres[None]) ** 2).sum(axis=2)
        of = far.argmin(axis=1)
        assert model.inertia == pytest.approx(far.min(axis=1).sum())
        assert np.array([x[of == c].mean(axis=0) for c in range(k)]) == pytest.approx(model.centres)
        got = {r.id: r.cluster for r in clusters.assigned(model, df).collect()}
        assert [got[p[0]] for p in points] == of.tolist()
    assert found[2].inertia > found[3].inertia > found[5].inertia
