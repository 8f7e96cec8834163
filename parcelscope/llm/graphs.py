"""Beam search over neighbour graphs, for many queries at once."""

from __future__ import annotations

import numpy as np

#: Marks (query, node) that a search may hold at a time; more queries are searched in turns.
MARKS = 1 << 25


def beam_search(vectors: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int,
                expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of largest inner product found by each query, best first, and the products (-1 and -inf where fewer are found).

    `neighbours` holds node numbers, -1 for none; `entries` the start nodes of each query. A search keeps
    its `width` best nodes and goes on from the best that it has not gone on from, until none is left.
    """
    turn = max(1, MARKS // max(1, len(vectors)))
    if len(queries) > turn:
        parts = [beam_search(vectors, neighbours, queries[i:i + turn], entries[i:i + turn], width, expand)
                 for i in range(0, len(queries), turn)]
        return tuple(np.concatenate(x) for x in zip(*parts))
    count = len(queries)
    ids = np.full((count, width), -1, np.int64)
    scores = np.full((count, width), -np.inf, np.float32)
    done = np.ones((count, width), bool)
    marked = np.zeros((count, len(vectors) + 1), bool)
    marked[:, -1] = True                     # node -1: none

    def take(rows: np.ndarray, found: np.ndarray) -> None:
        found = np.sort(found, axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found[marked[rows[:, None], found]] = -1
        marked[rows[:, None], found] = True
        products = np.einsum("qd,qkd->qk", queries[rows], vectors[found], optimize=False)
        products[found < 0] = -np.inf
        pool = np.concatenate((scores[rows], products), axis=1)
        best = np.argpartition(-pool, width - 1, axis=1)[:, :width] if pool.shape[1] > width else np.arange(
            pool.shape[1])[None, :].repeat(len(rows), axis=0)
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(pool, best, 1), axis=1, kind="stable"), 1)
        scores[rows] = np.take_along_axis(pool, best, 1)
        ids[rows] = np.take_along_axis(np.concatenate((ids[rows], found), axis=1), best, 1)
        done[rows] = np.take_along_axis(np.concatenate((done[rows], found < 0), axis=1), best, 1)

    active = np.arange(count)
    take(active, entries.astype(np.int64))
    while len(active):
        waiting = ~done[active]
        active, waiting = active[waiting.any(axis=1)], waiting[waiting.any(axis=1)]
        if not len(active):
            break
        chosen = waiting & (np.cumsum(waiting, axis=1) <= expand)
        places = np.argsort(~chosen, axis=1, kind="stable")[:, :expand]
        picked = np.take_along_axis(chosen, places, 1)
        nodes = np.where(picked, np.take_along_axis(ids[active], places, 1), -1)
        done[active] |= chosen
        following = np.where((nodes >= 0)[:, :, None], neighbours[nodes], -1).reshape(len(active), -1)
        take(active, following)
    return ids, scores


def reached(found: np.ndarray, truth: list[np.ndarray]) -> float:
    """Share of the true neighbours that were found; 1 if there are none."""
    total = sum(len(t) for t in truth)
    return sum(len(np.intersect1d(f, t)) for f, t in zip(found, truth)) / total if total else 1.0


def components_of(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node that each node reaches over the links (a, b)."""
    label = np.arange(count)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            return label
        label = new
