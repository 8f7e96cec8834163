"""Leaves of a forest as boxes over bin numbers, summed up once for all rows that agree in the features with few bins.

The features with the most bins (three at most) span a grid; the others are the key. For the rows of one key every leaf is a
box in the grid, so a sum over all leaves is a table of the grid: the corners of the boxes are added up, and running sums
along the axes fill it. A row then looks up its cell. Rows of rare keys are left to the plain methods.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Callable, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells and features of a grid at most.
CELLS, AXES = 1 << 16, 3


def leaf_rules(nodes: pd.DataFrame) -> list[tuple]:
    """Every leaf as (features, lows, highs, reach, value).

    A row meets feature j of the leaf when low_j < x_j <= high_j; reach_j is the part of the
    training rows that follows the leaf's branches at the splits on that feature.
    """
    rules = []
    for _, tree in nodes.groupby("tree"):
        by_id = {row.id: row for row in tree.itertuples()}
        stack = [(0, {})]
        while stack:
            node_id, path = stack.pop()
            node = by_id[node_id]
            if node.left < 0:
                names = sorted(path)
                rules.append((np.array(names, dtype=int), np.array([path[f][0] for f in names]),
                              np.array([path[f][1] for f in names]), np.array([path[f][2] for f in names]),
                              node.positive / node.cover))
                continue
            low, high, reach = path.get(node.feature, (-np.inf, np.inf, 1.0))
            left = (low, min(high, node.threshold), reach * by_id[node.left].cover / node.cover)
            right = (max(low, node.threshold), high, reach * by_id[node.right].cover / node.cover)
            stack.append((node.left, {**path, node.feature: left}))
            stack.append((node.right, {**path, node.feature: right}))
    return rules


class Boxes:
    """Bounds (`low` to `high`, both included, in bin numbers), reach and value per leaf; grid and key features."""

    def __init__(self, rules: list[tuple], limits: list[np.ndarray]):
        shape = len(rules), len(limits)
        self.limits, self.value = limits, np.array([r[4] for r in rules])
        self.inside, self.reach = np.zeros(shape, bool), np.ones(shape)
        self.low, self.high = np.zeros(shape, np.int64), np.tile([len(v) for v in limits], (len(rules), 1)).astype(np.int64)
        sorted_limits = [v.tolist() for v in limits]
        for leaf, (features, lows, highs, reach, _) in enumerate(rules):
            self.inside[leaf, features], self.reach[leaf, features] = True, reach
            for f, low, high in zip(features.tolist(), lows.tolist(), highs.tolist()):
                if low > -np.inf:
                    self.low[leaf, f] = bisect_left(sorted_limits[f], low) + 1
                if high < np.inf:
                    self.high[leaf, f] = bisect_left(sorted_limits[f], high)
        self.grid, cells = [], 1
        for f in sorted(range(len(limits)), key=lambda f: -len(limits[f])):
            if len(self.grid) < AXES and cells * (len(limits[f]) + 1) <= CELLS:
                self.grid, cells = [*self.grid, f], cells * (len(limits[f]) + 1)
        self.key = [f for f in range(len(limits)) if f not in self.grid]
        self.sizes, self.cells = tuple(len(limits[f]) + 1 for f in self.grid), cells
        self.strides = [int(np.prod(self.sizes[i + 1:])) for i in range(len(self.grid))]

    def corners(self, leaves: np.ndarray, axes: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place among `leaves`, cell and sign of the corners of their boxes along some axes of the grid."""
        places, cells, signs = [], [], []
        for ends in product((0, 1), repeat=len(axes)):
            at, fits = np.zeros(len(leaves), np.int64), np.ones(len(leaves), bool)
            for axis, end in zip(axes, ends):
                f = self.grid[axis]
                edge = self.high[leaves, f] + 1 if end else self.low[leaves, f]
                fits &= edge < self.sizes[axis]
                at += edge * self.strides[axis]
            places.append(np.flatnonzero(fits))
            cells.append(at[fits])
            signs.append(np.full(fits.sum(), -1 if sum(ends) % 2 else 1))
        return np.concatenate(places), np.concatenate(cells), np.concatenate(signs)

    def filled(self, corners: np.ndarray) -> np.ndarray:
        """(tables, cells) of box sums from their corners."""
        out = corners.reshape(len(corners), *self.sizes)
        for axis in range(len(self.sizes)):
            np.cumsum(out, axis=axis + 1, out=out)
        return out.reshape(len(corners), -1)

    def met(self, key: np.ndarray) -> np.ndarray:
        """Which key features of each leaf a key meets."""
        return (self.low[:, self.key] <= key) & (key <= self.high[:, self.key])

    def looked_up(self, x: np.ndarray, held: dict, table: Callable[[np.ndarray], np.ndarray],
                  rare: Callable[[np.ndarray], np.ndarray], plain: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """(rows, values) from the tables of their keys. `rare` says of the sizes of the keys which are left to
        `plain`, as rows with a missing feature are; `held` keeps the last table for the next batch."""
        bins = np.stack([np.searchsorted(v, x[:, f]) for f, v in enumerate(self.limits)], axis=1)
        key = np.ascontiguousarray(bins[:, self.key])
        whole = ~np.isnan(x).any(axis=1)
        if self.key:
            _, first, of = np.unique(key, axis=0, return_index=True, return_inverse=True)
            of = of.ravel()
        else:
            first, of = np.zeros(1, int), np.zeros(len(x), int)
        of = np.where(whole, of, len(first))
        sizes = np.bincount(of, minlength=len(first) + 1)
        same = [bool(held) and np.array_equal(held["key"], key[i]) for i in first]
        alone = np.append(rare(sizes[:-1]) & ~np.array(same, bool), True)
        out, cell = np.empty((0, 0)), sum((bins[:, f] * s for f, s in zip(self.grid, self.strides)), np.zeros(len(x), np.int64))
        order = of.argsort(kind="stable")
        ends = sizes.cumsum()
        # In the order of the rows, so that the last table is the one the next batch goes on with.
        for g in sorted(np.flatnonzero(~alone & (sizes > 0)), key=lambda g: (not same[g], first[g])):
            rows = order[ends[g] - sizes[g]:ends[g]]
            if not same[g]:
                held.update(key=key[rows[0]].copy(), table=table(key[rows[0]]))
            found = held["table"][:, cell[rows]].T
            out = out if out.size else np.empty((len(x), found.shape[1]))
            out[rows] = found
        left = alone[of]
        if left.any():
            found = plain(x[left])
            out = out if out.size else np.empty((len(x), found.shape[1]))
            out[left] = found
        return out


def limits_of(nodes: pd.DataFrame, features: int) -> list[np.ndarray]:
    splits = nodes[nodes["left"] >= 0]
    return [np.unique(splits.loc[splits["feature"] == f, "threshold"].to_numpy(dtype=float)) for f in range(features)]


def of_nodes(nodes: pd.DataFrame, features: int) -> Boxes:
    return Boxes(leaf_rules(nodes), limits_of(nodes, features))


def _bin(value: Column, limits: np.ndarray, first: int, last: int) -> Column:
    if first == last:
        return F.lit(first)
    middle = (first + last) // 2
    return F.when(value > float(limits[middle]), _bin(value, limits, middle + 1, last)).otherwise(_bin(value, limits, first, middle))


def dealt_by_key(df: DataFrame, names: Sequence[str], boxes: Boxes) -> DataFrame:
    """Rows of a key next to each other. Keys go by a hash, and a hash of the row cuts keys that hold many rows."""
    if not boxes.key:
        return df
    bins = [_bin(F.col(names[f]).cast("double"), boxes.limits[f], 0, len(boxes.limits[f])) for f in boxes.key]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumns({"_key": F.xxhash64(*bins), "_row": F.xxhash64(*[F.col(n) for n in names])})
    return dealt.repartitionByRange(parts, "_key", "_row").sortWithinPartitions("_key").drop("_key", "_row")
