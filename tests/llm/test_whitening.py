"""Components by contour integration against a dense eigensolver; exact sums against whole-number arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelscope.llm import queries, whitening


def matrix_of(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values, float)) @ q.T


SPECTRA = [[3.0], [5, 4, 3, 2, 1], [1] * 9, [7] * 12 + [1] * 12, [0] * 6, [1, 0, 0, 0], list(range(40)), [2.0 ** -i for i in range(30)],
           [1 + 1e-12 * i for i in range(20)] + [0.5] * 5, list(np.random.default_rng(2).random(50))]


@pytest.mark.parametrize("values", SPECTRA)
def test_inertia_counts(values):
    m = matrix_of(values)
    for shift in (-0.5, 0.3, 0.7, 1.5, 6.5):
        assert whitening.above(m, shift) == sum(v > shift for v in values)
    a = np.array([[0.0, 2.0], [2.0, 0.0]])
    assert whitening.positive_count(a) == 1 and whitening.positive_count(np.zeros((3, 3))) == 0


@pytest.mark.parametrize("values", SPECTRA)
@pytest.mark.parametrize("components", [1, 7, 32])
def test_leading_pairs(spark, values, components):
    m = matrix_of(values)
    got, vectors = whitening.leading_pairs(spark, (m + m.T) / 2, components)
    top = sorted((v for v in values if v > 1e-12), reverse=True)[:components]
    assert got == pytest.approx(top, rel=1e-9, abs=1e-12)
    assert vectors.T @ vectors == pytest.approx(np.eye(len(top)), abs=1e-12)
    assert m @ vectors == pytest.approx(vectors * got, abs=1e-12 * max(1, max(values)))


def exact(rows):
    x = [[int(np.floor(64 * float(np.float32(v)))) + 1_000_000 for v in r] for r in rows]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviations = [sum((n * v - t) ** 2 for v, t in zip(r, s)) for r in x]
    centred = np.array([[(n * v - t) / n for v, t in zip(r, s)] for r in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, deviations, centred, values[::-1], vectors[:, ::-1]


def test_query_against_a_dense_solver(spark, sf):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()
             if r.embedding is not None and all(v is not None and np.isfinite(v) for v in r.embedding)]
    n, deviations, centred, values, vectors = exact([v for _, v in table])
    rows = {(r.vec_id, r.component): r for r in queries.op13_whitening(spark, sf).collect()}
    assert len(rows) == n * 32
    for k in range(32):
        own = [rows[i, k + 1] for i, _ in table]
        assert {r.n for r in own} == {n} and [r.deviation for r in own] == deviations
        assert own[0].explained == pytest.approx(values[k] / values.sum(), rel=1e-10)
        white = np.array([r.whitened for r in own])
        want = centred @ vectors[:, k] / np.sqrt(values[k])
        assert min(np.abs(white - want).max(), np.abs(white + want).max()) < 1e-7
        assert own[0].identity_error < 1e-10


def rows_of(spark, vectors, **more):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    return df.withColumns({name: F.lit(value) for name, value in more.items()})


def test_unusable_vectors_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [2.0, 1.0], [0.5, -1.0], [-3.0, 0.0]]
    df = rows_of(spark, [None, [], [1.0, None], [nan, 1.0], [1.0, -inf], [1.0, 2.0, 3.0], [1e30, 1.0], *good],
                 key="x", vector=3, component="y", n="z")
    rows = whitening.whitened(df).collect()
    assert {r.key for r in rows} == {7, 8, 9, 10} and {r.n for r in rows} == {4} and {r.component for r in rows} == {1, 2}
    _, deviations, *_ = exact(good)
    assert [r.deviation for r in sorted(rows, key=lambda r: (r.key, r.component))][::2] == deviations


def test_fewer_dimensions_than_components(spark):
    line = whitening.whitened(rows_of(spark, [[1.0, 2.0, 0.0], [2.0, 4.0, 0.0], [3.0, 6.0, 0.0]])).collect()
    assert len(line) == 3 and {r.component for r in line} == {1} and line[0].explained == pytest.approx(1.0)
    assert line[0].identity_error < 1e-12
    assert whitening.whitened(rows_of(spark, [[1.0, 2.0]] * 5)).collect() == []
    assert whitening.whitened(rows_of(spark, [[1.0]])).collect() == []
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whitened(empty).collect() == [] and "whitened" in whitening.whitened(empty).columns


def test_repeated_rows_ties_and_null_keys(spark):
    square = [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, -1.0]] * 3
    df = rows_of(spark, square).withColumn("vec_id", F.when(F.col("vec_id") > 3, F.col("vec_id") % 4))
    rows = whitening.whitened(df).collect()
    assert len(rows) == 24 and sum(r.key is None for r in rows) == 8 and {r.n for r in rows} == {12}
    assert all(r.explained == pytest.approx(0.5) for r in rows) and rows[0].identity_error < 1e-12


def test_large_entries_stay_exact(spark):
    big = [[float(2 ** 40), 1.0], [float(-2 ** 40), 2.0], [float(2 ** 39), 3.0]]
    rows = whitening.whitened(rows_of(spark, big)).collect()
    _, deviations, *_ = exact(big)
    want = [d if d < 1 << 63 else None for d in deviations]
    assert [r.deviation for r in sorted(rows, key=lambda r: (r.component, r.key))][:3] == want
    assert whitening._exact_product(np.array([[1 << 40]]), np.array([[1 << 40]]))[0, 0] == 1 << 80
