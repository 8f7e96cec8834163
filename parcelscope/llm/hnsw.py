"""Near-duplicate vectors: a hierarchical navigable small-world graph per shard, searched by every vector of its label."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, stored
from .graphs import beam_search, components_of

#: Rows of a shard, about: what one graph holds in a task's memory.
SHARD_ROWS = 20_000
#: Rows of a component that are compared with each other at a time.
TILE = 1024
#: Links per node above the ground layer (twice as many on it), and the beam when inserting.
LINKS, INSERT_BEAM = 16, 48
#: Queries, and vectors planted at the threshold of nodes, whose links are found by brute force to audit the beam; recall
#: that must be reached.
AUDITED, PLANTED, RECALL = 64, 256, 0.995
#: Products that a comparison with every node holds at a time.
CELLS = 1 << 21


class Graph:
    """Layers of neighbour lists over unit vectors; layer 0 holds all nodes, each layer above about one in LINKS."""

    def __init__(self, vectors: np.ndarray, seed: int = 0) -> None:
        self.vectors = vectors
        n = len(vectors)
        draw = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(int), 8)
        self.order = np.argsort(-level, kind="stable")
        self.layers: list[np.ndarray] = []            # from the top down
        self.tops: np.ndarray = self.order[:1]
        for layer in range(int(level.max()) if n else 0, -1, -1):
            nodes = self.order[:int((level >= layer).sum())]
            self._build(nodes, 2 * LINKS if layer == 0 else LINKS)

    def stored(self) -> bytes:
        """The links without the vectors."""
        return zlib.compress(pickle.dumps((self.tops, [layer.astype(np.int32) for layer in self.layers])), 1)

    @classmethod
    def restored(cls, vectors: np.ndarray, links: bytes) -> Graph:
        graph = cls.__new__(cls)
        graph.vectors = vectors
        graph.tops, layers = pickle.loads(zlib.decompress(links))
        graph.layers = [layer.astype(np.int64) for layer in layers]
        return graph

    def _build(self, nodes: np.ndarray, links: int) -> None:
        graph = np.full((len(self.vectors), links + links // 4), -1, np.int64)      # lists overflow a little before they are cut
        starts = self.entries(self.vectors[nodes])
        size = 0
        while size < len(nodes):
            step = nodes[size:size + max(256, min(size, 1024))]
            own = self.vectors[step]
            near = own @ own.T                          # nodes inserted together know each other
            np.fill_diagonal(near, -np.inf)
            k = min(INSERT_BEAM // 2, len(step) - 1)
            mates = np.argpartition(-near, k - 1, axis=1)[:, :k] if k > 0 else np.empty((len(step), 0), int)
            ids, scores = step[mates], np.take_along_axis(near, mates, 1)
            if size:
                found, products = beam_search(self.vectors, graph, own, starts[size:size + len(step)], INSERT_BEAM)
                ids, scores = np.concatenate((found, ids), axis=1), np.concatenate((products, scores), axis=1)
            chosen = self._diverse(ids, scores, links)
            graph[step, :links] = chosen
            self._link_back(graph, step, chosen, links)
            size += len(step)
        self._cut(graph, nodes[graph[nodes, links] >= 0], links)
        self.layers.append(np.ascontiguousarray(graph[:, :links]))

    def _diverse(self, ids: np.ndarray, scores: np.ndarray, links: int) -> np.ndarray:
        """Of each row's candidates up to `links`: first those nearer to the row's node than to any chosen one, then the nearest."""
        out = np.full((len(ids), links), -1, np.int64)
        for part in range(0, len(ids), 512):
            order = np.argsort(-scores[part:part + 512], axis=1, kind="stable")[:, :3 * links]
            near = np.take_along_axis(ids[part:part + 512], order, 1)
            value = np.take_along_axis(scores[part:part + 512], order, 1)
            near = np.where(np.isfinite(value), near, -1)
            points = self.vectors[near]
            between = points @ points.transpose(0, 2, 1)
            kept = np.zeros(near.shape, bool)
            for c in range(near.shape[1]):
                closest = np.where(kept, between[:, c], -np.inf).max(axis=1)
                kept[:, c] = (near[:, c] >= 0) & (value[:, c] > closest) & (kept.sum(axis=1) < links)
            rank = np.where(near < 0, 2, np.where(kept, 0, 1))
            place = np.argsort(rank, axis=1, kind="stable")[:, :links]
            best = np.take_along_axis(near, place, 1)
            out[part:part + 512, :best.shape[1]] = best
        return out

    def _cut(self, graph: np.ndarray, owners: np.ndarray, links: int, more: np.ndarray | None = None) -> None:
        """Keeps the diverse `links` of the owners' lists and, if given, of `more` nodes for each."""
        both = graph[owners] if more is None else np.concatenate((graph[owners], more), axis=1)
        value = np.einsum("id,ikd->ik", self.vectors[owners], self.vectors[both])
        graph[owners, :links] = self._diverse(both, np.where(both >= 0, value, -np.inf), links)
        graph[owners, links:] = -1

    def _link_back(self, graph: np.ndarray, nodes: np.ndarray, chosen: np.ndarray, links: int) -> None:
        """Adds the links' other directions; a list that overflows is cut to the diverse ones of its old and up to `links` new nodes."""
        source, target = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        score = np.einsum("id,id->i", self.vectors[source], self.vectors[target])
        order = np.lexsort((-score, target))
        source, target = source[order], target[order]
        first = np.concatenate(([True], target[1:] != target[:-1])) if len(target) else np.empty(0, bool)
        at = np.flatnonzero(first)
        place = np.arange(len(target)) - np.repeat(at, np.diff(np.append(at, len(target))))
        new = np.full((len(at), links), -1, np.int64)
        inside = place < links
        new[np.cumsum(first)[inside] - 1, place[inside]] = source[inside]
        owners = target[at]
        new[(new[:, :, None] == graph[owners][:, None, :]).any(axis=2)] = -1
        fits = (graph[owners] >= 0).sum(axis=1) + (new >= 0).sum(axis=1) <= graph.shape[1]
        both = np.concatenate((graph[owners[fits]], new[fits]), axis=1)
        graph[owners[fits]] = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable")[:, :graph.shape[1]], 1)
        self._cut(graph, owners[~fits], links, new[~fits])

    def entries(self, queries: np.ndarray) -> np.ndarray:
        """Start nodes on the next layer down: the best found on the layers so far."""
        starts = np.repeat(self.tops[None, :], len(queries), axis=0)
        for graph in self.layers:
            starts = beam_search(self.vectors, graph, queries, starts, 4, 1)[0]
        return starts

    def search(self, queries: np.ndarray, width: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nearest nodes on the ground layer; `own` gives the nodes that the queries themselves are, as further starts."""
        starts = np.repeat(self.tops[None, :], len(queries), axis=0)
        for graph in self.layers[:-1]:
            starts = beam_search(self.vectors, graph, queries, starts, 4, 1)[0]
        if own is not None:
            starts = np.concatenate((starts, own[:, None]), axis=1)
        return beam_search(self.vectors, self.layers[-1], queries, starts, min(width, len(self.vectors)))


def compared(exact: np.ndarray, asked: np.ndarray, rows: np.ndarray, least: float,
             own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (query, node) that connect what all products from `least` on connect, for the queries in `rows`, block by block.

    `own` gives the nodes that the queries themselves are. There are fewer links than nodes and queries,
    however many products there are.
    """
    name = len(exact) + np.arange(len(asked)) if own is None else own
    part = np.arange(len(exact) + (len(asked) if own is None else 0))
    query, node = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    size = max(1, CELLS // max(1, len(exact)))
    for start in range(0, len(rows), size):
        block = rows[start:start + size]
        near = asked[block] @ exact.T >= least
        for i in np.flatnonzero(near.any(axis=1)):
            found, this = np.flatnonzero(near[i]), part[name[block[i]]]
            if (part[found] == this).all():
                continue
            parts, first = np.unique(part[found], return_index=True)
            new = found[first[parts != this]]
            query.append(np.full(len(new), block[i]))
            node.append(new)
            joined = np.zeros(len(part), bool)
            joined[parts] = joined[this] = True
            part[joined[part]] = min(parts[0], this)
    return np.concatenate(query), np.concatenate(node)


def planted(exact: np.ndarray, nodes: np.ndarray, least: float) -> np.ndarray:
    """A vector for each of the nodes, at a product just above `least` to it, turned towards another one of them."""
    near = exact[nodes]
    aside = np.roll(near, len(near) // 2, axis=0)
    aside = aside - np.einsum("id,id->i", aside, near)[:, None] * near
    size = np.sqrt(np.einsum("id,id->i", aside, aside))[:, None]
    cosine = min(1.0, least + 1e-4)
    return cosine * near + np.sqrt(1 - cosine ** 2) * np.divide(aside, size, out=np.zeros_like(aside), where=size > 1e-6)


def _recall(found: np.ndarray, truth: list[np.ndarray], room: int) -> float:
    """Mean share of each query's links that were found, or of the `room` that its beam has for them; 1 if none has links."""
    shares = [len(np.intersect1d(f, t)) / min(len(t), room) for f, t in zip(found, truth) if len(t)]
    return float(np.mean(shares)) if shares else 1.0


def near_pairs(graph: Graph, exact: np.ndarray, asked: np.ndarray, least: float,
               own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) that connect what products from `least` on connect, with a beam that doubles until the audit passes.

    The audit holds the beam against the true links of some queries and, as these may have none, against those of
    vectors planted as far from a node as a link can be, which start from the top alone. `exact` and `asked` are the
    graph's nodes and the queries in double. Queries whose beam ends before their links do, and all of them where a
    beam of a sixteenth of the graph has not passed, are compared with every node.
    """
    queries, width, n = asked.astype(np.float32), 32, len(exact)
    everyone = np.arange(len(queries))
    audit, nodes = (np.unique(np.linspace(0, size - 1, min(count, size)).astype(int))
                    for size, count in ((len(queries), AUDITED), (n, PLANTED)))
    products = queries[audit] @ graph.vectors.T
    if own is not None:
        products[np.arange(len(audit)), own[audit]] = -np.inf
    links = [np.flatnonzero(row >= least + 1e-6) for row in products]
    probes = planted(exact, nodes, least).astype(np.float32)
    apart = [np.flatnonzero(row >= least + 1e-6) for row in probes @ graph.vectors.T]
    while width * 16 <= n:
        found = graph.search(queries[audit], width, None if own is None else own[audit])[0]
        # A query with more links than the beam has room for is compared with every node below.
        if _recall(found, links, width - (own is not None)) >= RECALL and _recall(
                graph.search(probes, width)[0], apart, width) >= RECALL:
            break
        width *= 2
    else:
        return compared(exact, asked, everyone, least, own)
    ids, scores = graph.search(queries, width, own)
    near = (scores >= least - 1e-5) & (ids >= 0)
    cut = near[:, -1]
    query, place = np.nonzero(near & ~cut[:, None])
    node = ids[query, place]
    true = np.einsum("id,id->i", asked[query], exact[node]) >= least
    more = compared(exact, asked, everyone[cut], least, own)
    return np.concatenate((query[true], more[0])), np.concatenate((node[true], more[1]))


def usable(vector: str) -> Column:
    """Neither null nor empty nor zero, and without null or non-finite components."""
    c = F.col(vector)
    sound = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(c) > 0) & sound & F.exists(c, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("id,id->i", scaled, scaled))[:, None]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def distinct(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each distinct vector, in row order, and the place in that list of every row's vector."""
    rows = np.ascontiguousarray(vectors + 0.0).view(f"V{vectors.shape[1] * vectors.itemsize}").ravel()    # no negative zeros
    places: dict[bytes, int] = {}
    copy_of = np.array([places.setdefault(row, len(places)) for row in map(bytes, rows)])
    return np.unique(copy_of, return_index=True)[1], copy_of


def _tree(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each id to the smallest id that it reaches."""
    label = components_of(len(ids), a, b)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    other = least[label] != ids
    return ids[other], least[label][other]


SHARD = "label int, dim int, shard int, ids binary, vectors binary, graph binary, a array<long>, b array<long>"


def shard_links(points: DataFrame, least: float) -> DataFrame:
    """One row per shard: its distinct unit vectors, the smallest id and the graph of these (binary), and links (a, b)
    that connect the ids of its near vectors, equal ones among them."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").drop_duplicates("id")
        ids, exact = rows["id"].to_numpy(), unit(_matrix(rows["vector"]))
        first, copy_of = distinct(exact)
        points = exact[first]
        graph = Graph(points.astype(np.float32), seed=int(key[2]))
        query, node = near_pairs(graph, points, points, least, np.arange(len(first)))
        copies = np.flatnonzero((first[copy_of] != np.arange(len(ids))) & (np.einsum("id,id->i", exact, exact) >= least))
        a, b = _tree(ids, np.concatenate((copies, first[query])), np.concatenate((first[copy_of[copies]], first[node])))
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "shard": [key[2]], "ids": [ids[first].tobytes()],
                             "vectors": [points.tobytes()], "graph": [graph.stored()], "a": [a], "b": [b]})

    return points.groupBy("label", "dim", "shard").applyInPandas(build, SHARD)


def cross_links(shards: DataFrame, least: float) -> DataFrame:
    """Links between the shards of a label: each shard's vectors search every later shard's graph.

    A row holds two shards, whatever the label's size; links of a pair of shards are fewer than their rows.
    """
    one, other = shards.select("label", "dim", "shard", "ids", "vectors", "graph"), shards.select(
        F.col("label").alias("l"), F.col("dim").alias("d"), F.col("shard").alias("s"),
        F.col("ids").alias("other_ids"), F.col("vectors").alias("other_vectors"))
    same = (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")) & (F.col("shard") > F.col("s"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, more = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["other_ids"], np.int64)
                exact = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
                others = np.frombuffer(row["other_vectors"], np.float64).reshape(len(more), -1)
                graph = Graph.restored(exact.astype(np.float32), row["graph"])
                query, node = near_pairs(graph, exact, others, least)
                a, b = _tree(np.concatenate((ids, more)), query + len(ids), node)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return one.join(other, same).select("ids", "vectors", "graph", "other_ids", "other_vectors").mapInArrow(
        search, "a long, b long")


def _counted(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (component, i, j, id): each id's links to the group's other tile, or within it where i = j."""
    held: pa.Table | None = None

    def counts(part: pa.Table) -> pa.RecordBatch:
        ids = part.column("id").to_numpy()
        flat = part.column("vector").combine_chunks()
        vectors = unit(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1))
        tile, i, j = (part.column(c).to_numpy() for c in ("tile", "i", "j"))
        links = np.zeros(len(ids), np.int64)
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        near = vectors[left] @ vectors[right].T >= least
        if i[0] == j[0]:
            links[left] = near.sum(axis=1) - near.diagonal()
        else:
            links[left], links[right] = near.sum(axis=1), near.sum(axis=0)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], ["id", "links"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = np.stack([held.column(c).to_numpy() for c in ("component", "i", "j")])
        ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        start = 0
        for stop in ends.tolist():
            yield counts(held.slice(start, stop - start))
            start = stop
        held = held.slice(start)
    if held is not None and held.num_rows:
        yield counts(held)


def link_counts(points: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """id, links: exact number of near vectors in its component, compared tile by tile; a component may be of any size."""
    members = points.join(labels, F.col("id") == F.col("node")).select("id", "vector", "component")
    sizes = labels.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    dealt = members.join(sizes, "component").select(
        "component", "id", "vector", tile.alias("tile"), F.explode(F.expr("sequence(0, tiles - 1)")).alias("other")).select(
        "component", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id", "vector")
    grouped = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "id")
    return grouped.mapInArrow(lambda batches: _counted(batches, least), "id long, links long").groupBy("id").agg(
        F.sum("links").alias("links"))


def linked(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
           least: float = 0.93) -> DataFrame:
    """One row per input row: key, n_links, component (smallest key reachable), kept.

    Only vectors of one label and length are compared, by cosine in double precision. Rows with a null
    key or label, or with a vector that is null, empty, zero or holds null or non-finite components,
    link with nothing and are their own component. Rows of equal key and label are one vector, the
    first in order, and are returned as often as they come. No rows give no rows.
    """
    whole = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), F.col(label).cast("int").alias("label"))
    points = whole.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vector")).withColumn(
        "dim", F.size("vector"))
    sizes = points.groupBy("label", "dim").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("shards"))
    dealt = points.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    shards = stored(shard_links(dealt.select("label", "dim", "shard", "id", "vector"), least), "shards")
    inside = shards.select(F.explode(F.arrays_zip("a", "b")).alias("l")).select("l.a", "l.b")
    labels = stored(components(inside.union(cross_links(shards, least)), "a", "b"), "labels")
    single = points.select("id", "vector").groupBy("id").agg(F.min("vector").alias("vector"))
    found = labels.join(link_counts(single, labels, least).withColumnRenamed("id", "node"), "node")
    return whole.join(found, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias("key"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component")).withColumn(
        "kept", F.coalesce(F.col("key") == F.col("component"), F.lit(True)))
