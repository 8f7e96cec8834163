import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from parcelscope.llm import crf, queries


def test_marginals_against_enumeration():
    draw = np.random.default_rng(1)
    counts = np.array([3, 1, 5, 2])
    scores, moves = draw.normal(size=counts.sum()) * 2, draw.normal(size=(2, 2))
    good, pairs = crf.Chains(counts).marginals(scores, moves)
    at = 0
    for n in counts:
        weights = {}
        for labels in itertools.product((0, 1), repeat=int(n)):
            total = sum((scores[at + i] / 2) * (1 if y else -1) for i, y in enumerate(labels))
            weights[labels] = np.exp(total + sum(moves[a, b] for a, b in zip(labels, labels[1:])))
        z = sum(weights.values())
        for i in range(n):
            assert np.isclose(good[at + i], sum(w for y, w in weights.items() if y[i]) / z)
            for a, b in itertools.product((0, 1), repeat=2):
                want = sum(w for y, w in weights.items() if i + 1 < n and y[i:i + 2] == (a, b)) / z
                assert np.isclose(pairs[at + i, a, b], want)
        at += n


def test_long_chains_stay_finite():
    good, _ = crf.Chains(np.array([200_000])).marginals(np.full(200_000, 40.0), np.array([[3.0, -3], [-3, 3]]))
    assert np.isfinite(good).all() and good.min() > 0.99


def test_features_of_edge_cases():
    assert crf.line_features("").shape == (1, len(crf.FEATURES)) and not crf.line_features("").any()
    rows = crf.line_features("AB cd!\n\nAB cd!\n1 | 2\n" + "é" * 100_000)
    assert rows.shape[0] == 5 and rows[0, -1] == 1 == rows[0, -2] and rows[0, 3] == 0.5 and rows[3, 6] > 0


def auc(scores, labels):
    order = scores.argsort().argsort()
    good = labels == 1
    return (order[good].sum() - good.sum() * (good.sum() - 1) / 2) / good.sum() / (~good).sum()


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op10_quality(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    labels = np.array([truth[r.doc_id] for r in held])
    assert auc(np.array([r.score for r in held]), labels) > 0.97
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_held_out_labels_and_side_columns_do_not_matter(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(crf.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = crf.trained(docs, labels), crf.trained(docs.withColumn("lang", F.lit("x")).withColumn("key", F.lit(1)), other)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.curve, b.curve)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "a"), (2, "x " * 100_000, "b"), (2, "x " * 100_000, "b")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 7)], "doc_id long, quality int")
    field = crf.trained(docs, labels)
    assert field is None and {r.score for r in crf.scored(docs, field).collect()} == {0.5}
    field = crf.trained(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"),
                        spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    scores = crf.scored(docs, field).collect()
    assert len(scores) == 4 and scores[0].score == scores[1].score and scores[2].score == scores[3].score
    kept = crf.accepted(docs, field, least=0.0)
    assert kept.schema == docs.schema and kept.count() == 4 and crf.accepted(docs, field, least=1.1).count() == 0
    assert crf.scored(docs.limit(0), field).count() == 0
