"""Nearest neighbours by inner product: a neighbour graph by NN-descent in Spark joins, searched greedily.

Vectors get one more component that makes their norms equal, so that a large inner product with a query
means a small distance to it. Vectors are dealt into shards by a hash of their id; each shard's graph is
improved in rounds, in which the neighbours of a node are compared with each other, and each query
searches the graph of every shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, stored
from .graphs import beam_search, reached
from .hnsw import usable

#: Rows of a shard, about: what one graph holds in a task's memory. Queries of a block.
SHARD_ROWS, BLOCK_ROWS = 32_768, 512
#: Blocks that one copy of a shard's graph is sent for.
BLOCKS_TOGETHER = 2
#: Neighbours that a node keeps; other nodes' links to it that it takes part in; new partners that a comparison suggests to each node.
NEIGHBOURS, REVERSE, SUGGESTED = 20, 20, 6
#: Rounds at most, and the share of changed links under which rounds end.
ROUNDS, SETTLED = 7, 0.02
#: Nodes compared before there is a graph, in each of two random groupings.
FIRST_GROUP = 32
#: Queries of a block whose neighbours are found by brute force to audit the beam, and recall that must be reached.
AUDITED, RECALL = 32, 0.95
#: Products that a comparison with every node holds at a time.
CELLS = 1 << 22


def lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    """Vectors scaled by the largest norm, with the component that gives all of them norm one."""
    scaled = vectors / largest
    rest = np.sqrt(np.maximum(1 - np.einsum("id,id->i", scaled, scaled), 0))
    return np.concatenate((scaled, rest[:, None]), axis=1)


def coded(vectors: np.ndarray) -> list[bytes]:
    """One byte per component, after the factor that gives the values back: enough to order neighbours while building."""
    factor = np.abs(vectors).max(axis=1, keepdims=True) / 127
    codes = np.rint(vectors / np.maximum(factor, 1e-30)).astype(np.int8)
    return [f.tobytes() + c.tobytes() for f, c in zip(factor.astype("<f4"), codes)]


def _decoded(codes: list[bytes]) -> np.ndarray:
    block = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return block[:, 4:].view(np.int8) * np.ascontiguousarray(block[:, :4]).view("<f4")


def _grouped(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of sorted rows; the last group of a batch waits for the next one."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        last = [held.column(c)[-1].as_py() for c in columns]
        same = np.ones(held.num_rows, bool)
        for c, value in zip(columns, last):
            same &= held.column(c).to_numpy() == value
        cut = held.num_rows - int(same.sum())
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, node, fresh, code) sorted by place: each node's best partners among its place's nodes.

    Pairs of two nodes that were both there in the round before are left out.
    """
    for table in _grouped(batches, ["place"]):
        place = table.column("place").to_numpy()
        nodes, fresh = table.column("node").to_numpy(), table.column("fresh").to_numpy(zero_copy_only=False)
        codes = table.column("code").to_pylist()
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        left, right, scores = [], [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(place)]):
            own, vectors = nodes[a:b], _decoded(codes[a:b])      # vectors of one place have one length
            near = vectors @ vectors.T
            near[~(fresh[a:b][:, None] | fresh[a:b][None, :]) | (own[:, None] == own[None, :])] = -np.inf
            k = min(SUGGESTED, b - a)
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            value = np.take_along_axis(near, best, 1)
            row, column = np.nonzero(np.isfinite(value))
            left.append(own[row])
            right.append(own[best[row, column]])
            scores.append(value[row, column])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(left)), pa.array(np.concatenate(right)),
             pa.array(np.concatenate(scores).astype(np.float32))], ["node", "other", "score"])


def _improved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, other, score, fresh) sorted by node: each node's NEIGHBOURS best others, fresh if not known before."""
    for table in _grouped(batches, ["node"]):
        node, other = table.column("node").to_numpy(), table.column("other").to_numpy()
        score, fresh = table.column("score").to_numpy(), table.column("fresh").to_numpy(zero_copy_only=False)
        order = np.lexsort((fresh, other, node))
        once = np.concatenate(([True], (node[order][1:] != node[order][:-1]) | (other[order][1:] != other[order][:-1])))
        kept = order[once]
        kept = kept[np.lexsort((other[kept], -score[kept], node[kept]))]
        starts = np.flatnonzero(np.concatenate(([True], node[kept][1:] != node[kept][:-1])))
        place = np.arange(len(kept)) - np.repeat(starts, np.diff(np.append(starts, len(kept))))
        kept = kept[place < NEIGHBOURS]
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[kept]), pa.array(other[kept]), pa.array(score[kept]), pa.array(fresh[kept])],
            ["node", "other", "score", "fresh"])


_SUGGESTIONS = "node long, other long, score float"
_LINKS = "node long, other long, score float, fresh boolean"


def _merged(links: DataFrame) -> DataFrame:
    return links.repartition("node").sortWithinPartitions("node").mapInArrow(_improved, _LINKS)


def _suggestions(members: DataFrame) -> DataFrame:
    rows = members.select("place", "node", "fresh", "code")
    return rows.repartition("place").sortWithinPartitions("place").mapInArrow(_compared, _SUGGESTIONS)


def neighbour_graph(points: DataFrame) -> DataFrame:
    """node, other, score, fresh: about the NEIGHBOURS nearest nodes of each node of the same shard.

    `points` has id, shard, size (rows of the shard) and code. The first links come from random groups
    within shards. A round joins each node's links with the links to it (a hash picks REVERSE of these,
    as a node may be near to very many), compares the nodes that meet there, and keeps each node's best.
    """
    graph = None
    for turn in (1, 2):
        group = F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("size") / FIRST_GROUP))
        first = _suggestions(points.select(F.xxhash64("shard", group).alias("place"), F.col("id").alias("node"),
                                           F.lit(True).alias("fresh"), "code", "shard")).withColumn("fresh", F.lit(True))
        graph = first if graph is None else graph.union(first)
    graph = stored(_merged(graph), "graph")
    for _ in range(ROUNDS):
        back = graph.withColumn("turn", F.row_number().over(Window.partitionBy("other").orderBy(F.xxhash64("node"), "node")))
        members = graph.select(F.col("node").alias("place"), F.col("other").alias("member"), "fresh").union(
            back.where(F.col("turn") <= REVERSE).select("other", "node", "fresh"))
        with_codes = members.join(points.select("id", "code"), F.col("member") == F.col("id")).select(
            "place", F.col("member").alias("node"), "fresh", "code")
        suggested = _suggestions(with_codes).withColumn("fresh", F.lit(True))
        following = stored(_merged(graph.withColumn("fresh", F.lit(False)).union(suggested)), "graph")
        dropped(graph)
        graph = following
        changed = graph.agg(F.avg(F.col("fresh").cast("double"))).first()[0]
        if changed is None or changed < SETTLED:
            break
    return graph


SHARD = "shard long, copies binary, held binary, vectors binary, neighbours binary"


def shard_graphs(points: DataFrame, graph: DataFrame) -> DataFrame:
    """One row per shard: each node's copies and their number, vectors as given (float32 or float64 as doubles) and
    neighbour lists as row numbers, all binary."""
    back = graph.withColumn("turn", F.row_number().over(Window.partitionBy("other").orderBy(F.xxhash64("node"), "node")))
    both = graph.select("node", "other").union(back.where(F.col("turn") <= REVERSE).select("other", "node"))
    lists = both.groupBy("node").agg(F.collect_set("other").alias("near"))
    rows = points.join(lists, F.col("id") == F.col("node"), "left").select("shard", "id", "vector", "near", "copies")

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids = rows["id"].to_numpy()
        near = np.full((len(ids), NEIGHBOURS + REVERSE), -1, np.int32)
        for i, found in enumerate(rows["near"]):
            if found is not None:
                near[i, :len(found)] = np.searchsorted(ids, np.asarray(found))
        vectors = np.stack([np.asarray(v, np.float64) for v in rows["vector"]])
        held = np.array([len(c) for c in rows["copies"]], np.int64)
        copies = np.concatenate([np.asarray(c, np.int64) for c in rows["copies"]])
        return pd.DataFrame({"shard": [key[0]], "copies": [copies.tobytes()], "held": [held.tobytes()],
                             "vectors": [vectors.tobytes()], "neighbours": [near.tobytes()]})

    return rows.groupBy("shard").applyInPandas(pack, SHARD)


def searched(copies: np.ndarray, held: np.ndarray, vectors: np.ndarray, neighbours: np.ndarray, queries: np.ndarray,
             own: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, product) of the `count` best that the beam finds for each query; the beam doubles until the audit passes.

    Of each node `copies` holds the smallest ids, one list after the other, and `held` how many; `own` the
    queries' ids, which are no candidates. Products are taken in double for all nodes that single
    precision cannot tell from the best, and the audit judges the rows that are returned. Queries whose
    beam ends among such nodes are compared with every node, and all of them where no beam has passed.
    """
    points, asked = vectors.astype(np.float32), queries.astype(np.float32)
    n, at = len(vectors), np.cumsum(held) - held
    least = copies[at]
    # The query's own id may take one place.
    k = min(count + 1, n)
    doubt = 2 * vectors.shape[1] * np.finfo(np.float32).eps * np.sqrt(
        np.einsum("id,id->i", queries, queries) * np.einsum("id,id->i", vectors, vectors).max(initial=0))

    def ranked(query: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = np.einsum("id,id->i", queries[query], vectors[node])
        place = _places(query, order := np.lexsort((least[node], -score, query)))
        order = order[place < k]
        query, node, score = (np.repeat(x[order], held[node[order]]) for x in (query, node, score))
        first = np.flatnonzero(np.concatenate(([True], (query[1:] != query[:-1]) | (node[1:] != node[:-1])))) if len(node) else []
        number = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node)))).astype(np.int64)
        found = copies[at[node] + number]
        other = found != own[query]
        query, found, score = query[other], found[other], score[other]
        order = np.lexsort((found, -score, query))
        order = order[_places(query, order) < count]
        return query[order], found[order], score[order]

    def everything(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of the k best among all nodes, with those that rounding may have put behind them."""
        query, node = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        size = max(1, CELLS // n)
        for start in range(0, len(rows), size):
            block = rows[start:start + size]
            products = queries[block] @ vectors.T
            limit = np.partition(products, n - k, axis=1)[:, n - k] - 1e-6 * doubt[block]
            row, column = np.nonzero(products >= limit[:, None])
            query.append(block[row])
            node.append(column)
        return np.concatenate(query), np.concatenate(node)

    def beamed(rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, scores = beam_search(points, neighbours, asked[rows], entries[rows], width)
        limit = scores[:, k - 1] - doubt[rows]
        near = (scores >= limit[:, None]) & (ids >= 0)
        cut = near[:, -1]
        row, place = np.nonzero(near & ~cut[:, None])
        more = everything(rows[cut])
        return ranked(np.concatenate((rows[row], more[0])), np.concatenate((ids[row, place], more[1])))

    everyone, width = np.arange(len(queries)), 4 * count
    if width < n:
        starts = np.unique(np.random.default_rng(n).integers(0, n, 64))
        entries = np.repeat(starts[None, :], len(queries), axis=0)
        audit = np.unique(np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int))
        query, found, _ = ranked(*everything(audit))
        truth = [found[query == q] for q in audit]
        while width < n:
            query, found, _ = beamed(audit, width)
            if reached([found[query == q] for q in audit], truth) >= RECALL:
                return beamed(everyone, width)
            width *= 2
    return ranked(*everything(everyone))


def _places(group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Place of each row in its group, of rows taken in `order`, which keeps groups together."""
    group = group[order]
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.empty(0, int)
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))


def nearest(rows: DataFrame, asked: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the `count` rows of largest inner product with each row of `asked`.

    `rows` are indexed whole; `asked` has the same columns, and a row is no candidate for a query of its
    own key. Equal scores go by the smaller key. Rows with a null key, or a vector that is null, empty,
    zero or holds null or non-finite components, take no part; vectors of another length than the
    query's are no candidates. Repeated keys count once, with the smallest vector. No rows give no rows.
    """
    def points_of(df: DataFrame) -> DataFrame:
        whole = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
        sound = whole.where(F.col("id").isNotNull() & usable("vector"))
        return sound.groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))

    # Equal vectors are one node. No query takes more of its ids than `count`, and its own.
    first = Window.partitionBy("dim", "vector").orderBy("id")
    points = points_of(rows).withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= count + 1).groupBy(
        "dim", "vector").agg(F.sort_array(F.collect_list("id")).alias("copies")).withColumn("id", F.col("copies")[0])
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sizes = points.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("largest")).withColumn(
        "shards", F.ceil(F.col("n") / SHARD_ROWS))
    turn = F.pmod(F.xxhash64("id", F.lit(0)), F.col("shards"))
    dealt = points.join(sizes, "dim").select(
        "id", "vector", (F.col("dim").cast("long") * (1 << 32) + turn).alias("shard"), "largest",
        F.ceil(F.col("n") / F.col("shards")).alias("size"), "copies")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: list[bytes | None] = [None] * batch.num_rows
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                values = batch.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                largest = batch.column(3).to_numpy()[at[0]]
                for i, code in zip(at, coded(lifted(values.reshape(len(at), dim), largest))):
                    codes[i] = code
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *batch.columns[4:], pa.array(codes, pa.binary())],
                                             ["id", "vector", "shard", "size", "copies", "code"])

    kind = dict(rows.dtypes)[vector]
    placed = stored(dealt.mapInArrow(encode, f"id long, vector {kind}, shard long, size long, "
                                            "copies array<long>, code binary"), "points")
    graphs = stored(shard_graphs(placed, neighbour_graph(placed)), "graphs")

    queries = points_of(asked)
    blocks = queries.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    block = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks"))
    packed = queries.join(blocks, "dim").withColumn("block", block).groupBy("dim", "block").agg(
        F.collect_list("id").alias("asked"), F.flatten(F.collect_list("vector")).alias("values"))
    # The stated queries, block by block, against every shard of their length.
    everywhere = packed.join(sizes.select("dim", "shards"), "dim").select(
        "asked", "values", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("turn"), "dim", "block").select(
        "asked", "values", (F.col("dim").cast("long") * (1 << 32) + F.col("turn")).alias("of"),
        F.floor(F.col("block") / BLOCKS_TOGETHER).alias("copy_of"))
    # A graph goes to as many tasks as its queries need, however many these are.
    copies = graphs.join(blocks, F.shiftright("shard", 32) == F.col("dim")).withColumn(
        "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / BLOCKS_TOGETHER))))
    pairs = everywhere.join(copies, (F.col("of") == F.col("shard")) & (F.col("copy_of") == F.col("copy"))).select(
        "asked", "values", "copies", "held", "vectors", "neighbours")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(0)[i].values.to_numpy()
                values = batch.column(1)[i].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
                copies, held = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in (2, 3))
                vectors = np.frombuffer(batch.column(4)[i].as_buffer(), np.float64).reshape(len(held), -1)
                near = np.frombuffer(batch.column(5)[i].as_buffer(), np.int32).reshape(len(held), -1).astype(np.int64)
                query, found, score = searched(copies, held, vectors, near, values, own, count)
                yield pa.RecordBatch.from_arrays([pa.array(own[query]), pa.array(found), pa.array(score)],
                                                 ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).select(
        "query_id", "rank", "vec_id", "score")
