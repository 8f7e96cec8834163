"""SimHash near-duplicates: segment-popcount embedding, grid join under the Manhattan bound, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, stored, text_of

BITS = 64
#: Rows of a grid cell that one task compares at a time; larger cells are cut into tiles of about this size.
TILE = 2048
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """A bit is set where more than half of the shingles' XXH64 values set it; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    plain = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(plain[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())], "<u8")
    columns = hashes.view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = 3) -> DataFrame:
    """key, print (the fingerprint as a signed long) of each row; a null text is empty."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["key", "print"])

    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(of, f"key {dict(rows.dtypes)['key']}, print long")


def embedded(column: Column) -> Column:
    """Bit counts of the 32 two-bit segments in unary: 0 as 00, 1 as 01, 2 as 11.

    The Manhattan distance of two count vectors is then the number of differing bits, and never more
    than the distance of the fingerprints.
    """
    low = F.lit(0x5555555555555555)
    upper = F.shiftrightunsigned(column, 1)
    return column.bitwiseOR(upper).bitwiseAND(low).bitwiseOR(F.shiftleft(column.bitwiseAND(upper).bitwiseAND(low), 1))


def masks(blocks: int, radius: int) -> list[int]:
    """One mask per choice of blocks - radius blocks of segments, as signed longs.

    Vectors within Manhattan distance `radius` differ in at most that many blocks, so they are equal
    under one mask at least.
    """
    cuts = [round(i * BITS / 2 / blocks) * 2 for i in range(blocks + 1)]
    of = [((1 << cuts[i + 1]) - 1) & ~((1 << cuts[i]) - 1) for i in range(blocks)]
    return [int(np.uint64(sum(c)).astype(np.int64)) for c in combinations(of, blocks - radius)]


def _spanning(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what the links within `radius` connect, one fewer than the values of each part."""
    found, left = [], values
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            value = queue.pop()
            near = np.bitwise_count(left ^ value) <= radius
            if near.any():
                new = left[near]
                found += [(int(value), int(v)) for v in new]
                queue += list(new)
                left = left[~near]
    return found


def _group_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (cell, i, j) with the fingerprints of each tile pair; gives spanning links."""

    def links(groups: np.ndarray, values: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate(([0], ends[:-1]))
        twos = starts[ends - starts == 2]
        near = twos[np.bitwise_count(values[twos] ^ values[twos + 1]) <= radius] if len(twos) else twos
        more = [e for a, b in zip(starts.tolist(), ends.tolist()) if b - a > 2 for e in _spanning(values[a:b], radius)]
        a, b = (np.concatenate((values[near + i], np.array([e[i] for e in more], np.uint64))).view(np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rest_groups, rest_values = None, np.empty(0, np.uint64)
    for batch in batches:
        groups = np.stack([batch.column(i).to_numpy() for i in range(3)])
        values = batch.column(3).to_numpy().view(np.uint64)
        if rest_groups is not None:
            groups, values = np.concatenate((rest_groups, groups), axis=1), np.concatenate((rest_values, values))
        ends = np.flatnonzero((groups[:, 1:] != groups[:, :-1]).any(axis=0)) + 1
        if len(ends):
            yield links(groups, values, ends)
            groups, values = groups[:, ends[-1]:], values[ends[-1]:]
        rest_groups, rest_values = groups, values
    if len(rest_values):
        yield links(rest_groups, rest_values, np.array([len(rest_values)]))


def near_links(prints: DataFrame, blocks: int = 6, radius: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all that differ in at most `radius` bits.

    Every fingerprint goes to one grid cell per mask. Cells with one member end there. A large cell is
    dealt into tiles by hash and each pair of tiles is a group of its own, so no task holds more than
    about two tiles, and a group gives fewer links than it has members, never all pairs.
    """
    # Under more bits per mask fewer unrelated fingerprints meet; the number of masks grows instead.
    distinct = prints.select("print").distinct()
    vector = embedded(F.col("print"))
    # The place of the mask is mixed into the cell; cells that collide only cost comparisons.
    cells = distinct.select("print", vector.alias("v")).select("print", F.explode(F.array(*(
        F.xxhash64(F.lit(i), F.col("v").bitwiseAND(F.lit(m))) for i, m in enumerate(masks(blocks, radius))))).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1").select(
        "cell", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("print", F.lit(1)), F.col("tiles")).cast("int")
    members = cells.join(sizes, "cell").select("cell", "print", "tiles", tile.alias("tile"))
    dealt = members.select("cell", "print", "tile", F.explode(F.expr("sequence(0, tiles - 1)")).alias("other")).select(
        "cell", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "print")
    grouped = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return grouped.mapInArrow(lambda batches: _group_links(batches, radius), "a long, b long").distinct()


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                 radius: int = 3) -> DataFrame:
    """One row per input row: key, fingerprint (16 hex digits), component (smallest key reachable by links).

    Fingerprints that differ in at most `radius` bits link; equal ones always do. Texts without words
    (null, empty) have fingerprint zero and link like any other. A row with a null key takes part in
    links, and its component is the smallest non-null key reachable, or null if there is none.
    Repeated rows are returned as often as they come; an empty table gives an empty one.
    """
    prints = stored(fingerprints(docs, key, text, shingle), "prints")
    labels = stored(components(near_links(prints, radius=radius), "a", "b"), "labels")
    own = prints.groupBy("print").agg(F.min("key").alias("least"))
    marked = own.join(labels, F.col("print") == F.col("node"), "left").select(
        "print", "least", F.coalesce("component", "print").alias("part"))
    least = marked.groupBy("part").agg(F.min("least").alias("component"))
    named = marked.join(least, "part").select("print", "component")
    return prints.join(named, "print").select(
        "key", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component")


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                        radius: int = 3) -> DataFrame:
    """The rows of `docs` that stand for their group: those whose key is the group's smallest.

    Rows are told apart by key alone: of several rows with the same key all stay or go together, and
    all rows with a null key stay if one of them belongs to a group without any other key.
    """
    found = deduplicated(docs, key, text, shingle, radius)
    keep = found.where(F.col("key").eqNullSafe(F.col("component"))).select(F.col("key").alias("_kept")).distinct()
    return docs.join(keep, F.col(key).eqNullSafe(F.col("_kept")), "left_semi")
