"""Whitening of vectors by their leading components, which contour integration (FEAST) takes from the covariance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of vectors become whole numbers: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: A scaled entry from here on counts as not finite: sums of products must fit 38 digits.
LARGEST = float(1 << 48)
#: Eigenvalues in one interval at most, unless they lie closer together than CLOSE times the largest.
SLICE, CLOSE = 8, 1e-9
#: Points of the contour's half circle, rounds of subspace iteration, and the residual that ends them, times the norm.
POINTS, ROUNDS, RESIDUAL = 8, 40, 1e-14
#: Eigenvalues up to this share of the largest, times the dimension, are taken as zero.
RANK_SHARE = 4 * np.finfo(float).eps

CELLS = "i int, j int, value decimal(38,0)"


# ---- eigenpairs of a symmetric matrix

def positive_count(matrix: np.ndarray) -> int:
    """Positive eigenvalues, as the positive pivots of a symmetric elimination (Sylvester's law of inertia).

    The largest diagonal entry is the pivot, or the largest entry off the diagonal with its two rows and columns,
    which always hold one positive and one negative eigenvalue.
    """
    a, count = matrix.copy(), 0
    bound = (1 + np.sqrt(17)) / 8
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        off = np.abs(a - np.diag(np.diagonal(a)))
        r = int(diagonal.argmax())
        p, q = np.unravel_index(int(off.argmax()), off.shape)
        if max(diagonal[r], off[p, q]) == 0:
            return count
        if diagonal[r] >= bound * off[p, q]:
            pivots, count = [r], count + int(a[r, r] > 0)
        else:
            pivots, count = [int(p), int(q)], count + 1
        rest = np.setdiff1d(np.arange(len(a)), pivots)
        left = a[np.ix_(rest, pivots)]
        a = a[np.ix_(rest, rest)] - left @ np.linalg.solve(a[np.ix_(pivots, pivots)], left.T)
        a = (a + a.T) / 2
    return count


def above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues greater than `shift`."""
    return positive_count(matrix - shift * np.eye(len(matrix)))


@dataclass(frozen=True)
class Interval:
    """Eigenvalues in (low, high]: how many there are by inertia."""

    low: float
    high: float
    count: int


def intervals(matrix: np.ndarray, components: int) -> list[Interval]:
    """Intervals from the top of the spectrum that hold the `components` largest eigenvalues, or all that are not zero."""
    d = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    floor, top = float(d * RANK_SHARE * norm), float(norm * (1 + 1e-6))
    total = above(matrix, floor) if norm > 0 else 0
    # The topmost interval is taken first; next to each end stands the number of eigenvalues above it.
    found, pending, have = [], [(floor, total, top, 0)], 0
    while pending and have < min(components, total):
        low, over_low, high, over_high = pending.pop()
        count = over_low - over_high
        if not count:
            continue
        if count <= SLICE or high - low <= CLOSE * norm:
            found.append(Interval(low, high, count))
            have += count
        else:
            middle = (low + high) / 2
            over = above(matrix, middle)
            pending += [(low, over_low, middle, over), (middle, over, high, over_high)]
    return found


def solved(matrix: np.ndarray, interval: Interval, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the interval, falling, and their vectors as columns.

    The integral of the resolvent around the interval projects a random block onto the wanted space; a
    half circle of Gauss points is enough, as the matrix is real. Rayleigh-Ritz takes the pairs from the
    projected block, which is projected again until their residuals are small. The block grows until as
    many pairs lie in the interval as inertia counts.
    """
    d, norm = len(matrix), float(np.abs(matrix).sum(axis=1).max())
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angles = np.pi / 2 * (1 - nodes)
    # The circle runs a little outside the interval, so that an eigenvalue at its end is inside.
    margin = max(1e-3 * (interval.high - interval.low), 1e-13 * norm)
    centre, radius = (interval.low + interval.high) / 2, (interval.high - interval.low) / 2 + margin
    points = centre + radius * np.exp(1j * angles)
    factors = weights / 4 * radius * np.exp(1j * angles) * 2
    draw = np.random.default_rng(seed)
    size = min(d, 2 * interval.count + 4)
    while True:
        block = draw.standard_normal((d, size))
        for _ in range(ROUNDS):
            projected = np.zeros((d, size))
            for point, factor in zip(points, factors):
                projected += (factor * np.linalg.solve(point * np.eye(d) - matrix, block.astype(complex))).real
            basis, _ = np.linalg.qr(projected)
            values, inner = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ inner
            residuals = np.linalg.norm(matrix @ block - block * values, axis=0)
            slack = 1e-13 * norm
            inside = (values > interval.low - slack) & (values <= interval.high + slack)
            good = inside & (residuals <= max(RESIDUAL * d, 1e-14) * norm)
            if good.sum() == inside.sum() >= interval.count:
                break
        # Rounding may put a pair at an end of the interval on both of its sides: the innermost ones count.
        place = np.flatnonzero(good)
        if len(place) > interval.count:
            depth = np.minimum(values[place] - interval.low, interval.high - values[place])
            place = place[np.argsort(-depth, kind="stable")[:interval.count]]
        if len(place) == interval.count:
            order = place[np.argsort(-values[place], kind="stable")]
            return values[order], block[:, order]
        if size == d:
            raise ArithmeticError(f"{len(place)} eigenvalues found in {interval}")
        size = min(d, 2 * size)


def leading_pairs(spark: SparkSession, matrix: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues above zero, falling, and their vectors as columns; each interval is solved in a task of its own.

    A last Rayleigh-Ritz step over all of them makes vectors of neighbouring intervals orthogonal.
    """
    parts = intervals(matrix, components)
    if not parts:
        return np.zeros(0), np.zeros((len(matrix), 0))
    shared = spark.sparkContext.broadcast(matrix)

    def solve_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                _, vectors = solved(shared.value, Interval(row.low, row.high, row.count_))
                yield pd.DataFrame({"vector": [v.tolist() for v in vectors.T]})

    tasks = spark.createDataFrame([(p.low, p.high, p.count) for p in parts], "low double, high double, count_ int")
    rows = tasks.repartitionByRange(len(parts), "low").mapInPandas(solve_all, "vector array<double>").collect()
    shared.unpersist()
    basis, _ = np.linalg.qr(np.array([r.vector for r in rows]).T)
    values, inner = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-values, kind="stable")[:components]
    return values[order], (basis @ inner)[:, order]


# ---- sums over the vectors

def usable(vector: Column) -> Column:
    """The vector is there, has entries, and each is a finite number below LARGEST once scaled."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda v: F.coalesce(
        ~F.isnan(v) & (F.abs(v.cast("double") * SCALE) < LARGEST), F.lit(False))), F.lit(False))


def whole_numbers(rows: pa.Array, dimension: int) -> np.ndarray:
    """floor(SCALE * entry) + SHIFT of a batch of vectors."""
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    return np.floor(SCALE * flat).astype(np.int64) + SHIFT


def _exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b in whole numbers; doubles hold them exactly while the sums stay below 2^53."""
    largest = max((int(np.abs(x).max(initial=0)) for x in (a, b)))
    if largest * largest * len(a) < 1 << 53:
        return np.rint(a.astype(np.float64).T @ b.astype(np.float64)).astype(np.int64).astype(object)
    return a.astype(object).T @ b.astype(object)


def _summed(rows: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray]) -> dict[tuple[int, int], int]:
    """Exact sums of a matrix per batch over all rows: one matrix per task, added up cell by cell by Spark."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = partial(batch)
                total = own if total is None else total + own
        if total is not None:
            i, j = np.indices(total.shape)
            values = pa.array([Decimal(int(v)) for v in total.ravel()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), values], ["i", "j", "value"])

    sums = rows.mapInArrow(cells, CELLS).groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    return {(r.i, r.j): int(r.value) for r in sums}


@dataclass(frozen=True)
class Whitener:
    """Number of vectors, exact sums per dimension, and the components: eigenvalues, vectors, share of the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 per row, exact; none where it does not fit a long."""
        farthest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + max(map(abs, self.sums))
        exact = farthest * farthest * len(self.sums) < 1 << 63
        off = x.astype(np.int64 if exact else object) * self.n - np.array(self.sums, np.int64 if exact else object)
        if not exact and int(np.abs(off).max(initial=0)) ** 2 * len(self.sums) < 1 << 63:
            off = off.astype(np.int64)
        sums = (off * off).sum(axis=1)
        return [int(v) if int(v) < 1 << 63 else None for v in sums]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        # Whole and fractional part of the mean apart: the differences are small, and exact but for the last.
        whole = np.array([s // self.n for s in self.sums])
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return ((x - whole).astype(np.float64) - part) @ self.vectors / np.sqrt(self.values)


def vectors_of(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """key and vector of the usable rows of the most frequent length (of equally frequent ones the longest), and the length."""
    kept = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")).where(usable(F.col("vector")))
    length = kept.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    dimension = length.length if length else 0
    return kept.where(F.size("vector") == dimension), dimension


def fitted(vectors: DataFrame, dimension: int, components: int) -> Whitener:
    """Components of all rows of `vectors` (see `vectors_of`): sums first, then products of the centred entries.

    Entries are centred by the whole part of their mean, and the products are exact; what is left of the
    mean goes off exactly at the end. The driver sees one number per dimension and per pair of dimensions.
    """
    sums = _summed(vectors, lambda b: np.vstack([
        np.append(whole_numbers(b.column(1), dimension).astype(object).sum(axis=0), b.num_rows)]))
    if not sums:
        return Whitener(0, [0] * dimension, np.zeros(0), np.zeros((dimension, 0)), np.zeros(0))
    n, total = sums[0, dimension], [sums[0, j] for j in range(dimension)]
    centre = np.array([s // n for s in total])

    def products(batch: pa.RecordBatch) -> np.ndarray:
        off = whole_numbers(batch.column(1), dimension) - centre
        return _exact_product(off, off)

    gram = _summed(vectors, products)
    rest = [s - n * int(c) for s, c in zip(total, centre)]
    covariance = np.array([[(n * gram[i, j] - rest[i] * rest[j]) / (n * n) for j in range(dimension)]
                           for i in range(dimension)])
    values, axes = leading_pairs(vectors.sparkSession, covariance, components)
    trace = float(np.trace(covariance))
    return Whitener(n, total, values, axes, values / trace if trace > 0 else values)


def identity_error(vectors: DataFrame, dimension: int, whitener: Whitener) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, measured over all rows; 0 without components."""
    k = len(whitener.values)
    if not k:
        return 0.0

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            white = whitener.whitened(whole_numbers(batch.column(1), dimension))
            total[:k] += white.T @ white
            total[k] += white.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)),
                                          pa.array(total.ravel())], ["i", "j", "value"])

    sums = vectors.mapInArrow(products, "i int, j int, value double").groupBy("i", "j").agg(
        F.sum("value").alias("value")).collect()
    total = np.zeros((k + 1, k))
    for row in sums:
        total[row.i, row.j] = row.value / whitener.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """One row per usable vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, holds a null or non-finite entry, or has another length than most are
    left out. Components are those of the `components` largest eigenvalues above zero, so there are fewer
    where the vectors span fewer dimensions, and none where all are equal or the table is empty: the result
    is empty then. Null keys and repeated rows are kept and count as often as they come; other columns are
    not read. A deviation that does not fit a long is null.
    """
    vectors, dimension = vectors_of(rows, key, vector)
    whitener = fitted(vectors, dimension, components)
    error = identity_error(vectors, dimension, whitener)
    k = len(whitener.values)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = whole_numbers(batch.column(1), dimension)
            row = np.repeat(np.arange(len(x)), k)
            number = np.tile(np.arange(k), len(x))
            deviations = pa.array(whitener.deviations(x), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array((number + 1).astype(np.int32)),
                 pa.array(np.full(len(row), whitener.n)), deviations.take(pa.array(row)),
                 pa.array(whitener.whitened(x).ravel()), pa.array(whitener.explained[number]),
                 pa.array(np.full(len(row), error))],
                ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(projected, f"key {dict(vectors.dtypes)['key']}, component int, n long, deviation long, "
                                         "whitened double, explained double, identity_error double")
