"""Training of a random forest on binned rows: all trees grow together, one pass over the rows per level."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

# The functions run in Python workers travel with the job; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bins per feature, bits that hold a bin number, and features in one bigint.
BINS, BITS, PACKED = 32, 5, 12
#: Bits of the numbers that bins of several features are joined to, when rows are led to their places.
JOINED_BITS = 11
#: Rows taken at once in a task, and the least and most parts that the rows are dealt into.
BLOCK, LEAST_PARTS, MOST_PARTS = 1 << 17, 16, 512
NODE_SCHEMA = ("tree int, id int, left int, right int, feature int, threshold double, cover double, positive double, "
               "gain double")


# ---- binned rows

def cut_points(rows: DataFrame, features: Sequence[str]) -> tuple[list[np.ndarray], int, int]:
    """Limits between the bins of each feature, rows, and rows with label 1.

    A feature of at most BINS values has a bin for each, with limits halfway between them; others are cut at their
    quantiles. Raises an error where a feature or label is missing, or a label is not 0 or 1.
    """
    names = list(features)

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: list[np.ndarray | None] = [np.empty(0) for _ in names]
        rows, failed = 0, 0
        for batch in batches:
            if batch.isna().to_numpy().any() or not batch["label"].isin([0, 1]).all():
                raise ValueError("a feature or a label is missing, or a label is not 0 or 1")
            rows, failed = rows + len(batch), failed + int(batch["label"].sum())
            for i, name in enumerate(names):
                if seen[i] is not None:
                    seen[i] = np.union1d(seen[i], batch[name].to_numpy(dtype=float))
                    seen[i] = None if len(seen[i]) > BINS else seen[i]
        yield pd.DataFrame({"rows": [rows], "failed": [failed], "seen": [seen]})

    parts = rows.mapInPandas(distinct, "rows bigint, failed bigint, seen array<array<double>>").collect()
    values: list[np.ndarray | None] = []
    for i in range(len(names)):
        lists = [p.seen[i] for p in parts]
        found = None if None in lists else np.unique(np.concatenate([np.empty(0), *map(np.array, lists)]))
        values.append(None if found is None or len(found) > BINS else found)
    places = [k / BINS for k in range(1, BINS)]
    many = [i for i, v in enumerate(values) if v is None]
    cuts = rows.agg(*[F.percentile_approx(names[i], places, 10_000).alias(f"q{i}") for i in many]).first() if many else None
    limits = [np.unique(cuts[f"q{i}"]) if v is None else (v[1:] + v[:-1]) / 2 for i, v in enumerate(values)]
    return limits, sum(p.rows for p in parts), sum(p.failed for p in parts)


def binned(rows: DataFrame, features: Sequence[str], limits: list[np.ndarray], parts: int) -> DataFrame:
    """Distinct rows of bin numbers (in bigints `w0`, `w1`, ...) and label, with how often each occurs, stored in `parts` files."""
    names, words = list(features), [f"w{k}" for k in range(math.ceil(len(features) / PACKED))]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {w: np.zeros(len(batch), np.int64) for w in words}
            for i, name in enumerate(names):
                out[words[i // PACKED]] |= np.searchsorted(limits[i], batch[name].to_numpy(dtype=float)) << (i % PACKED * BITS)
            yield pd.DataFrame({**out, "label": batch["label"].to_numpy(dtype=np.int32)})

    packed = rows.mapInPandas(pack, ", ".join(f"{w} bigint" for w in words) + ", label int")
    counted = packed.groupBy(*words, "label").agg(F.count(F.lit(1)).alias("n"))
    return written(counted.repartition(parts, *words, "label"), "cells")


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits scrambled (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def poisson_table(power: int) -> np.ndarray:
    """Poisson draws of mean 2^power for 65,536 even places of the distribution."""
    mean, u = 2.0 ** power, (np.arange(1 << 16) + 0.5) / (1 << 16)
    if power > 12:
        z = np.array([NormalDist().inv_cdf(p) for p in u.tolist()])
        return np.rint(mean + math.sqrt(mean) * z)
    k = np.arange(int(mean + 12 * math.sqrt(mean) + 12))
    logs = k * math.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
    return np.searchsorted(np.cumsum(np.exp(logs)), u).astype(float)


def joined(limits: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Groups of (feature, shift, bits): the bin numbers of a group make one number of at most JOINED_BITS bits."""
    groups: list[list[tuple[int, int, int]]] = []
    for bits, f in sorted(((max(1, len(v).bit_length()), f) for f, v in enumerate(limits)), reverse=True):
        for group in groups:
            used = sum(b for _, _, b in group)
            if used + bits <= JOINED_BITS:
                group.append((f, used, bits))
                break
        else:
            groups.append([(f, 0, bits)])
    return groups


class Block:
    """Rows of a task: one byte per feature and row, which holds the bin number and, as the last bit, the label."""

    def __init__(self, batch: pd.DataFrame, features: int, groups: list[list[tuple[int, int, int]]], seed: int):
        label = batch["label"].to_numpy(dtype=np.uint8)
        mix = np.full(len(batch), seed, np.int64).view(np.uint64) * np.uint64(2) + label
        for k in range(math.ceil(features / PACKED)):
            mix = _mixed(mix ^ _mixed(batch[f"w{k}"].to_numpy(dtype=np.int64).view(np.uint64)))
        self.mix = mix
        bins = [(batch[f"w{i // PACKED}"].to_numpy(dtype=np.int64) >> (i % PACKED * BITS)) & (BINS - 1) for i in range(features)]
        self.joined = [sum(bins[f] << shift for f, shift, _ in group) for group in groups]
        self.codes = np.stack([b.astype(np.uint8) * 2 + label for b in bins])
        n = batch["n"].to_numpy(dtype=np.int64)
        powers = range(int(n.max()).bit_length())
        self.with_bit = {p: np.flatnonzero(n >> p & 1) for p in powers if (n >> p & 1).any()}
        self.drawn: dict[int, tuple[int, np.ndarray]] = {}

    def weights(self, tree: int, tables: dict[int, np.ndarray]) -> np.ndarray:
        """How often a tree draws each distinct row: Poisson with its count as mean, the same whatever task asks.

        64 scrambled bits per row serve four trees, which come one after the other.
        """
        out = np.zeros(len(self.mix))
        for power, rows in self.with_bit.items():
            if power not in tables:
                tables[power] = poisson_table(power)
            if self.drawn.get(power, (None, None))[0] != tree // 4:
                key = _mixed(np.array([tree // 4 * 64 + power + 1], np.uint64))
                self.drawn[power] = tree // 4, _mixed(self.mix[rows] ^ key).view(np.uint16).reshape(-1, 4)
            drawn = tables[power].take(self.drawn[power][1][:, tree % 4])
            if len(rows) == len(out):
                out += drawn
            else:
                out[rows] += drawn
        return out


def _blocks(batches: Iterator[pd.DataFrame], *about) -> Iterator[Block]:
    held, rows = [], 0
    for batch in batches:
        held, rows = [*held, batch], rows + len(batch)
        if rows >= BLOCK:
            yield Block(pd.concat(held), *about)
            held, rows = [], 0
    if rows:
        yield Block(pd.concat(held), *about)


# ---- growth

class Grown:
    """All trees by heap places: the children of place k are 2k + 1 and 2k + 2. `feature` is -1 where nothing is split."""

    def __init__(self, trees: int, features: int, depth: int, seed: int):
        places = (1 << depth + 1) - 1
        self.depth, self.feature = depth, np.full((trees, places), -1, np.int16)
        self.cut, self.gain = np.zeros((trees, places), np.uint8), np.full((trees, places), -1.0)
        self.count = np.zeros((trees, places, 2))
        # Every place may split on this many features of its own, drawn beforehand.
        draws = np.random.default_rng(seed).random((trees, (1 << depth) - 1, features))
        self.asked = draws.argsort(axis=2)[:, :, :math.ceil(math.sqrt(features))].astype(np.int16)
        # The first and last bin of each feature that reach a place.
        self.low, self.high = np.zeros((trees, places, features), np.uint8), np.full((trees, places, features), BINS - 1, np.uint8)

    def split(self, tree: int, place: int, asked: int, cut: int) -> None:
        feature = self.asked[tree, place, asked]
        self.feature[tree, place], self.cut[tree, place] = feature, cut
        for side in (2 * place + 1, 2 * place + 2):
            self.low[tree, side], self.high[tree, side] = self.low[tree, place], self.high[tree, place]
        self.high[tree, 2 * place + 1, feature], self.low[tree, 2 * place + 2, feature] = cut, cut + 1


def signposts(low: np.ndarray, high: np.ndarray, groups: list[list[tuple[int, int, int]]]) -> list[list[np.ndarray]]:
    """For 64 open places at a time and each group, the places (as bits) that a joined bin number may lead to.

    `low` and `high` have a row per place. One place at most is left in the numbers of all groups of a row.
    """
    out = []
    for start in range(0, len(low), 64):
        some = np.zeros((64, low.shape[1], BINS), bool)
        bins, held = np.arange(BINS), slice(start, start + 64)
        some[:len(low[held])] = (bins >= low[held, :, None]) & (bins <= high[held, :, None])
        masks = np.packbits(some, axis=0, bitorder="little").transpose(1, 2, 0).copy().view("<u8")[:, :, 0]
        tables = []
        for group in groups:
            number = np.arange(1 << sum(bits for _, _, bits in group))
            tables.append(np.bitwise_and.reduce([masks[f][number >> shift & ((1 << bits) - 1)] for f, shift, bits in group]))
        out.append(tables)
    return out


def histograms(block: Block, weights: np.ndarray, posts: list[list[np.ndarray]], asked: np.ndarray, out: np.ndarray) -> None:
    """Adds up the weights per open place of one tree, feature asked for at it, bin and label."""
    for part, tables in enumerate(posts):
        leads = tables[0].take(block.joined[0])
        for table, number in zip(tables[1:], block.joined[1:]):
            leads &= table.take(number)
        rows = np.flatnonzero((leads != 0) & (weights != 0))
        # A number with one bit, as a double, has the place of the bit as its exponent.
        slot = ((leads.take(rows).astype(float).view(np.int64) >> 52) - 1023).astype(np.uint8)
        rows = rows.take(slot.argsort(kind="stable"))
        weight, ends = weights.take(rows), np.bincount(slot, minlength=64).cumsum().tolist()
        begin = 0
        for s, end in enumerate(ends, 64 * part):
            if end > begin:
                mine, own = rows[begin:end], weight[begin:end]
                for j, f in enumerate(asked[s]):
                    out[s, j] += np.bincount(block.codes[f].take(mine), own, 2 * BINS)
                begin = end


def _gini(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and impurity of (..., 2) counts per label."""
    n = counts.sum(axis=-1)
    p = counts / np.maximum(n, 1)[..., None]
    return n, 1 - (p * p).sum(axis=-1)


def best_splits(sums: np.ndarray) -> pd.DataFrame:
    """For (places, features, bins, 2) sums, the split of each place with the largest fall of impurity; its first, if tied."""
    run = sums.cumsum(axis=2)
    total, left = run[:, :, -1:], run[:, :, :-1]
    right = total - left
    (n, impurity), (n_left, low), (n_right, high) = _gini(total), _gini(left), _gini(right)
    fall = impurity - (n_left * low + n_right * high) / np.maximum(n, 1)
    fall = np.where((n_left >= 1) & (n_right >= 1), fall, -1.0).reshape(len(sums), -1)
    at = fall.argmax(axis=1)
    every = np.arange(len(sums))
    j, cut = at // (BINS - 1), at % (BINS - 1)
    return pd.DataFrame({"slot": every, "asked": j, "cut": cut, "gain": fall[every, at], "good": total[every, j, 0, 0],
                         "failed": total[every, j, 0, 1], "left_good": left[every, j, cut, 0], "left_failed": left[every, j, cut, 1]})


SPLITS = "tree int, slot int, asked int, cut int, gain double, good double, failed double, left_good double, left_failed double"


def _level(cells: DataFrame, grown: Grown, open_places: list[list[int]], groups: list, seed: int) -> pd.DataFrame:
    """Best split of every open place, from one pass over the rows; each task adds up its own rows first."""
    bounds = {t: (grown.low[t, p], grown.high[t, p], grown.asked[t, p]) for t, p in enumerate(open_places) if p}
    shared = cells.sparkSession.sparkContext.broadcast(bounds)
    features, shape = grown.low.shape[2], (grown.asked.shape[2], 2 * BINS)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {t: np.zeros((len(low), *shape)) for t, (low, _, _) in shared.value.items()}
        posts: dict[int, list] = {}
        tables: dict[int, np.ndarray] = {}
        for block in _blocks(batches, features, groups, seed):
            for t, (low, high, asked) in shared.value.items():
                if t not in posts:
                    posts[t] = signposts(low, high, groups)
                histograms(block, block.weights(t, tables), posts[t], asked, sums[t])
        trees = list(posts)
        for some in (trees[i:i + 32] for i in range(0, len(trees), 32)):
            yield pd.DataFrame({"tree": some, "sums": [sums[t].tobytes() for t in some]})

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        sums = sum(np.frombuffer(s) for s in part["sums"]).reshape(-1, shape[0], BINS, 2)
        return best_splits(sums).assign(tree=part["tree"].iloc[0])[[c.split()[0] for c in SPLITS.split(", ")]]

    added = cells.mapInPandas(add_up, "tree int, sums binary")
    found = added.groupBy("tree").applyInPandas(decide, SPLITS).toPandas()
    shared.unpersist()
    return found


def grow(rows: DataFrame, features: Sequence[str], trees: int, depth: int, seed: int) -> tuple[Grown, list[np.ndarray]]:
    """The grown trees and the limits of the bins.

    Each tree draws as many rows as there are, with replacement (Poisson counts that depend on the binned row, the
    tree and the seed alone, so the partitions of the input do not matter), and looks at the square root of the
    features at every place.
    """
    limits, n, failed = cut_points(rows, features)
    if not n:
        raise ValueError("no labelled rows to fit")
    parts = max(min(LEAST_PARTS, math.ceil(n / 4096)), min(MOST_PARTS, math.ceil(n / (BLOCK // 2))))
    cells = binned(rows, features, limits, parts)
    grown, groups = Grown(trees, len(features), depth, seed), joined(limits)
    open_places = [[0] for _ in range(trees)]
    for level in range(depth):
        if not any(open_places):
            break
        found, now, open_places = _level(cells, grown, open_places, groups, seed), open_places, [[] for _ in range(trees)]
        for r in found.itertuples(index=False):
            place, (left, right) = now[r.tree][r.slot], (2 * now[r.tree][r.slot] + 1, 2 * now[r.tree][r.slot] + 2)
            grown.count[r.tree, place] = r.good, r.failed
            if r.gain <= 0:
                continue
            grown.split(r.tree, place, r.asked, r.cut)
            grown.gain[r.tree, place] = r.gain
            grown.count[r.tree, left] = r.left_good, r.left_failed
            grown.count[r.tree, right] = r.good - r.left_good, r.failed - r.left_failed
            if level + 1 < depth:
                open_places[r.tree] += [side for side in (left, right) if grown.count[r.tree, side].all()]
    # A tree that drew no row at all, which only a handful of rows allows, has the rows as they are.
    grown.count[grown.count[:, 0].sum(axis=1) == 0, 0] = n - failed, failed
    return grown, limits


def node_table(grown: Grown, limits: list[np.ndarray]) -> pd.DataFrame:
    """Nodes in the columns of NODE_SCHEMA, numbered from the root, left sides first. As in the library, sides that would both
    be leaves of the same label are one leaf."""
    feature, says = grown.feature.copy(), grown.count[:, :, 1] > grown.count[:, :, 0]
    for place in range((1 << grown.depth) - 2, -1, -1):
        left, right = 2 * place + 1, 2 * place + 2
        feature[(feature[:, left] < 0) & (feature[:, right] < 0) & (says[:, left] == says[:, right]), place] = -1
    rows = []
    for t, (split, cut, gain, count) in enumerate(zip(feature.tolist(), grown.cut.tolist(), grown.gain.tolist(), grown.count.tolist())):
        number, stack = 0, [(0, None)]
        while stack:
            place, parent = stack.pop()
            if parent is not None:
                rows[parent][3 if place % 2 == 0 else 2] = number
            good, failed = count[place]
            node = [t, number, -1, -1, -1, None, good + failed, failed, -1.0]
            if split[place] >= 0:
                node[4:6] = split[place], float(limits[split[place]][cut[place]])
                node[8] = gain[place]
                stack += [(2 * place + 2, len(rows)), (2 * place + 1, len(rows))]
            rows.append(node)
            number += 1
    return pd.DataFrame(rows, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])
