"""Repeated substrings: positions ranked at growing lengths until they are unique or reach the threshold.

Ranking every byte position at every round would move many times the corpus, so ranks are sparse. Of each
window of `length` bytes, the smallest hash of a quarter-length string inside it names one position, the
anchor; equal windows have equal anchors. Windows that share an anchor form a run. Ranks are 64- or
128-bit fingerprints instead of dense numbers:

1. each anchor by its quarter-length string: anchors of a rank of their own end here;
2. each run by all its bytes: runs of equal rank are repeated as a whole;
3. of the other runs, single windows by their full length, against one run of each rank with their anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import dropped, sliced, stored, text_of

#: Bytes whose windows are looked at together; longer texts are cut into stretches that overlap by a window.
STRETCH = 1 << 18
#: Runs of one anchor that a task compares at a time; beyond it their windows are counted by Spark.
TOGETHER = 4096

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


@cache
def _powers(which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value per byte, and the powers of an odd base and of its inverse mod 2^64."""
    base = _MULTIPLIERS[which]
    n = 2 * STRETCH + 1
    table = np.random.default_rng(1000 + which).integers(0, 1 << 64, 256, dtype=np.uint64)
    powers, inverses = (np.full(n, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    for values in (powers, inverses):
        values[0] = 1
        np.cumprod(values, out=values)
    return table, powers, inverses


class Prefixes:
    """Rolling fingerprints of the strings in a buffer."""

    def __init__(self, data: np.ndarray, which: int) -> None:
        table, powers, self.inverses = _powers(which)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * powers[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverses[start]

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.inverses[:n]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(32))
    values *= np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def window_anchors(data: np.ndarray, length: int, core: int) -> tuple[np.ndarray, np.ndarray, Prefixes]:
    """Anchor of each window of the buffer, and the fingerprint of the core string at each position."""
    sums = Prefixes(data, 0)
    cores = sums.every(core)
    order = (_mixed(cores) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(cores), dtype=np.uint64)
    width, size = length - core + 1, 1
    while 2 * size <= width:
        order = np.minimum(order[:-size], order[size:])
        size *= 2
    if size < width:
        order = np.minimum(order[:size - width], order[width - size:])
    return (order & np.uint64(0xFFFFFFFF)).astype(np.int64), cores, sums


def stretches(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about STRETCH bytes: data, and per piece its text's place in the list, start in the text, start in the buffer."""
    pieces: list[tuple[int, int, bytes]] = []
    held = 0
    for i, text in enumerate(texts):
        for start in range(0, max(0, len(text) - length + 1), STRETCH):
            piece = text[start:start + STRETCH + length - 1]
            if held + len(piece) > 2 * STRETCH - length and pieces:
                yield _buffer(pieces)
                pieces, held = [], 0
            pieces.append((i, start, piece))
            held += len(piece)
            if held >= STRETCH:
                yield _buffer(pieces)
                pieces, held = [], 0
    if pieces:
        yield _buffer(pieces)


def _buffer(pieces):
    sizes = np.array([len(p) for _, _, p in pieces])
    return (np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8), np.array([i for i, _, _ in pieces]),
            np.array([s for _, s, _ in pieces]), np.concatenate(([0], np.cumsum(sizes))))


def runs_of(texts: list[bytes], length: int, core: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Per run: its text's place, the anchor's position, least and most distance from a window's start to the anchor,
    rank of the core, and two ranks of the run's bytes."""
    for data, place, offset, edges in stretches(texts, length):
        anchors, cores, sums = window_anchors(data, length, core)
        piece = np.repeat(np.arange(len(place)), np.diff(edges))[:len(anchors)]
        window = np.flatnonzero(np.arange(len(anchors)) + length <= edges[piece + 1])
        at, of = anchors[window], piece[window]
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])))
        first = window[new]
        last = np.concatenate((window[np.flatnonzero(new)[1:] - 1], window[-1:]))
        at, of = at[new], of[new]
        other = Prefixes(data, 1)
        yield (place[of], at - edges[of] + offset[of], at - last, at - first, _mixed(cores[at]),
               sums.of(first, last + length), other.of(first, last + length))


def _texts(column) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def sparse_ranks(docs: DataFrame, length: int) -> DataFrame:
    """key, content, anchor, lo, hi, core, f1, f2 for every run of every text."""
    kind = dict(docs.dtypes)["key"]

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for place, anchor, lo, hi, core, f1, f2 in runs_of(_texts(batch.column(2)), length, length // 4):
                rows = pa.array(place)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(anchor), pa.array(lo.astype(np.int32)),
                     pa.array(hi.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (core, f1, f2))],
                    ["key", "content", "anchor", "lo", "hi", "core", "f1", "f2"])

    return docs.select("key", "content", "text").mapInArrow(
        ranked, f"key {kind}, content long, anchor long, lo int, hi int, core long, f1 long, f2 long")


def _windows(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, ...]:
    """Of all windows in the batch's snippets: row, start in the snippet, and two ranks."""
    snippets = _texts(batch.column("snippet"))
    out = []
    for data, place, offset, edges in stretches(snippets, length):
        piece = np.repeat(np.arange(len(place)), np.diff(edges))[:len(data) - length + 1]
        at = np.flatnonzero(np.arange(len(piece)) + length <= edges[piece + 1])
        of = piece[at]
        ranks = [Prefixes(data, w).every(length)[at] for w in (0, 1)]
        out.append((place[of], at - edges[of] + offset[of], *ranks))
    return tuple(np.concatenate(x) for x in zip(*out))


def _repeated_runs(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Spans of windows that occur more than once in the batch, which holds all runs of its anchors."""
    row, start, r1, r2 = _windows(batch, length)
    copies = batch.column("n").to_numpy()[row]
    order = np.lexsort((r2, r1))
    r1, r2 = r1[order], r2[order]
    group = np.concatenate(([0], np.cumsum((r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1]))))
    total = np.bincount(group, copies[order])
    again = np.zeros(len(row), bool)
    again[order] = total[group] > 1
    again &= copies == 1                              # the others are repeated as a whole
    row, start = row[again], start[again]
    if not len(row):
        return batch.slice(0, 0).select(["key", "content"]).append_column("start", pa.array([], pa.int64())).append_column(
            "stop", pa.array([], pa.int64()))
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(row) - 1]))
    rows = row[first]
    base = (batch.column("anchor").to_numpy() - batch.column("hi").to_numpy())[rows]
    taken = pa.array(rows)
    return pa.RecordBatch.from_arrays(
        [batch.column("key").take(taken), batch.column("content").take(taken),
         pa.array(base + start[first]), pa.array(base + start[last] + length)], ["key", "content", "start", "stop"])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts sorted batches so that no value of `core` is split over two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cores = batch.column("core").to_numpy()
        if held and held[0].column("core")[0].as_py() != cores[-1]:
            ends = np.flatnonzero(cores[1:] != cores[:-1]) + 1
            cut = int(ends[-1]) if len(ends) else 0
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held, batch = [], batch.slice(cut)
        elif not held:
            ends = np.flatnonzero(cores[1:] != cores[:-1]) + 1
            if len(ends):
                yield batch.slice(0, int(ends[-1]))
                batch = batch.slice(int(ends[-1]))
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _packed(docs: DataFrame) -> DataFrame:
    """`docs` with the text compressed into blob, for a shuffle; other columns as they are."""
    place = docs.columns.index("text")
    fields = [StructField("blob", BinaryType()) if f.name == "text" else f for f in docs.schema.fields]

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in sliced(batches):
            blobs = pa.array([tool.compress(t) for t in _texts(batch.column(place))], pa.binary())
            columns = [blobs if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.mapInArrow(small, StructType(fields))


def _snippets(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """The bytes of each run: core, runs, key, content, anchor, lo, hi, n, snippet."""
    kind = dict(docs.dtypes)["key"]
    of_text = runs.groupBy("key", "content").agg(F.collect_list(F.struct(
        "core", "runs", "anchor", "lo", "hi", "n", "size")).alias("list")).withColumnsRenamed({"key": "k", "content": "c"})
    # Rows of equal key and text give their runs twice; these are known to be repeated already (n > 1).
    joined = _packed(docs.select("key", "content", "text")).join(
        of_text, F.col("key").eqNullSafe(F.col("k")) & (F.col("content") == F.col("c"))).select("key", "content", "blob", "list")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in sliced(batches):
            counts = np.diff(batch.column(3).offsets.to_numpy())
            flat = batch.column(3).flatten()
            fields = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
            rows = np.repeat(np.arange(batch.num_rows), counts)
            start = fields["anchor"].to_numpy() - fields["hi"].to_numpy()
            stop = start + fields["size"].to_numpy()
            found, text, of = [], b"", -1
            for r, a, b in zip(rows.tolist(), start.tolist(), stop.tolist()):
                if r != of:
                    text, of = tool.decompress(batch.column(2)[r].as_py()), r
                found.append(text[a:b])
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [fields["core"], fields["runs"], batch.column(0).take(taken), batch.column(1).take(taken),
                 *(fields[x] for x in ("anchor", "lo", "hi", "n")), pa.array(found, pa.binary())],
                ["core", "runs", "key", "content", "anchor", "lo", "hi", "n", "snippet"])

    return joined.mapInArrow(cut, f"core long, runs long, key {kind}, content long, anchor long, lo int, hi int, "
                                  "n long, snippet binary")


def repeated_spans(docs: DataFrame, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """key, content, start, stop: spans whose windows of `length` bytes all occur elsewhere; they may overlap.

    `docs` has key, content (a hash of the text) and text. Rows with an equal key and text share
    their spans, and count as repeats of each other. Further the stored tables that the spans are read from.
    """
    kind = dict(docs.dtypes)["key"]
    everything = stored(sparse_ranks(docs, length), "ranks")
    # Stored before the join, so that Spark can split the rows of a very frequent core over several tasks.
    shared = stored(everything.groupBy("core").agg(F.count("*").alias("anchors")).where("anchors > 1").select("core"), "cores")
    ranks = stored(everything.join(shared, "core"), "shared")
    dropped(everything)
    whole = ["core", "lo", "hi", "f1", "f2"]
    classes = stored(ranks.groupBy(*whole).agg(
        F.count("*").alias("n"), F.min(F.struct("key", "content", "anchor")).alias("one")), "classes")
    copied = ranks.join(classes.where("n > 1").select(*whole), whole).select(
        "key", "content", (F.col("anchor") - F.col("hi")).alias("start"),
        (F.col("anchor") - F.col("lo") + length).alias("stop"))
    several = stored(classes.groupBy("core").agg(F.count("*").alias("runs"), F.min("n").alias("least")).where(
        "runs > 1 AND least = 1").select("core", "runs"), "several")
    runs = classes.join(several, "core").select(
        "core", "runs", "one.*", "lo", "hi", "n", (F.col("hi") - F.col("lo") + length).alias("size"))
    snippets = _snippets(docs, runs)
    few = snippets.where(F.col("runs") <= TOGETHER).repartition("core").sortWithinPartitions("core")
    spans = f"key {kind}, content long, start long, stop long"
    near = few.mapInArrow(lambda batches: (_repeated_runs(b, length) for b in _whole_groups(sliced(batches, 1024))), spans)

    def each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for part in range(0, whole_batch.num_rows, 1000):
                batch = whole_batch.slice(part, 1000)
                row, start, r1, r2 = _windows(batch, length)
                taken = pa.array(row)
                base = (batch.column("anchor").to_numpy() - batch.column("hi").to_numpy())[row]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(taken), batch.column("content").take(taken), pa.array(base + start),
                     batch.column("n").take(taken), pa.array(r1.view(np.int64)), pa.array(r2.view(np.int64))],
                    ["key", "content", "start", "n", "r1", "r2"])

    many = stored(snippets.where(F.col("runs") > TOGETHER).mapInArrow(
        each_window, f"key {kind}, content long, start long, n long, r1 long, r2 long"), "windows")
    again = stored(many.groupBy("r1", "r2").agg(F.sum("n").alias("total")).where("total > 1").select("r1", "r2"), "again")
    far = many.where("n = 1").join(again, ["r1", "r2"]).select(
        "key", "content", "start", (F.col("start") + length).alias("stop"))
    return copied.union(near).union(far), [shared, ranks, classes, several, many, again]


def _listed(rows: DataFrame, length: int, name: str) -> DataFrame:
    """k, c (key and content) and `name`: the starts and stops of each text's repeated spans, stored."""
    spans, used = repeated_spans(rows.select("key", "content", "text"), length)
    # A set: rows of equal key and text each bring the same spans.
    lists = stored(spans.groupBy("key", "content").agg(F.collect_set(F.struct("start", "stop")).alias("spans")).select(
        F.col("key").alias("k"), F.col("content").alias("c"),
        F.struct(F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops")).alias(name)), "spans")
    for part in used:
        dropped(part)
    return lists


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that the spans cover."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return starts[first], reach[np.concatenate((first[1:] - 1, [len(starts) - 1]))]


def _long_enough(text: bytes, starts: np.ndarray, stops: np.ndarray, words: int, size: int) -> np.ndarray:
    """Which spans have more than `words` words or at least `size` bytes."""
    spans = zip(starts.tolist(), stops.tolist())
    return np.array([b - a >= size or len(text[a:b].split()) > words for a, b in spans], bool)


#: What goes: bytes that strings of so many bytes repeat, in maximal runs of more than so many words or at least so many bytes.
Rule = tuple[int, int, int]


def _cut(docs: DataFrame, key: str, text: str, rules: dict[str, Rule], rest: list[str], decoded: bool = False) -> DataFrame:
    """key, rest (struct of the named columns), missing (the text was null), n_bytes and, by the name of each rule, a struct
    of n_removed, n_spans, kept: kept is binary, or text if `decoded`, then without the bytes left over from characters that were cut.
    """
    others = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in rest)).alias("rest")
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text_of(text)).alias("content"), text_of(text).alias("text"),
                       F.col(text).isNull().alias("missing"), others)
    lists = [_listed(rows, length, name) for name, (length, _, _) in rules.items()]
    joined = _packed(rows)
    for spans in lists:
        joined = joined.join(spans, F.col("key").eqNullSafe(F.col("k")) & (F.col("content") == F.col("c")), "left").drop("k", "c")
    joined = joined.select("blob", *rules, "key", "rest", "missing")
    result = StructType([StructField("n_removed", LongType()), StructField("n_spans", LongType()),
                         StructField("kept", StringType() if decoded else BinaryType())])
    schema = StructType([*joined.schema.fields[1 + len(rules):], StructField("n_bytes", LongType()),
                         *(StructField(name, result) for name in rules)])

    def without(whole: bytes, spans: pa.Scalar, words: int, size: int) -> tuple[int, int, bytes]:
        if not spans.is_valid:
            return 0, 0, whole
        a, b = merged(spans["starts"].values.to_numpy(), spans["stops"].values.to_numpy())
        goes = _long_enough(whole, a, b, words, size)
        a, b = a[goes], b[goes]
        kept = b"".join(whole[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(whole)]))
        return len(whole) - len(kept), len(a), kept

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in sliced(batches):
            sizes, out = [], [[] for _ in rules]
            for blob, *spans in zip(*batch.columns[:1 + len(rules)]):
                whole = tool.decompress(blob.as_py())
                sizes.append(len(whole))
                for found, at, (_, words, size) in zip(out, spans, rules.values()):
                    found.append(without(whole, at, words, size))
            structs = []
            for found in out:
                removed, runs, kept = zip(*found) if found else ((), (), ())
                kept = pa.array([k.decode("utf-8", "ignore") for k in kept] if decoded else kept, pa.string() if decoded else pa.binary())
                structs.append(pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), kept],
                                                          ["n_removed", "n_spans", "kept"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[1 + len(rules):], pa.array(sizes, pa.int64()), *structs], schema.names)

    return joined.mapInArrow(cut, schema)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400,
                    passages: Rule | None = None) -> DataFrame:
    """One row per input row: key, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary).

    A byte goes if a string of `length` bytes that holds it also starts anywhere else, in the same text
    or another; all occurrences go, as judged on the input. Null texts are empty; texts shorter than
    `length` keep every byte. Rows are told apart by key and text: repeated rows are repeats of each
    other, and null keys are kept. No rows give no rows.

    `passages` (length, words, size) adds a struct of that name: n_removed, n_spans and kept where the bytes that
    strings of that length repeat go, in maximal runs of more than `words` words or at least `size` bytes.
    """
    rules = {"repeats": (length, 0, 0)} | ({"passages": passages} if passages else {})
    return _cut(docs, key, text, rules, []).select("key", "n_bytes", "repeats.*", *list(rules)[1:])


def rewritten(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400,
              n_chars: str = "n_chars", words: int = 0, size: int = 0) -> DataFrame:
    """The rows and columns of `docs` without the repeated bytes in `text`, and with `n_chars`, if it is a column, to match.

    Bytes that strings of `length` bytes repeat form maximal runs; a run goes if it has more than `words` words
    (parts between ASCII white space) or at least `size` bytes, by default always. Of a character that loses some of
    its bytes the others go too. A null text stays null.
    """
    rest = [c for c in docs.columns if c != text]
    rows = _cut(docs, key, text, {"repeats": (length, words, size)}, rest, True).withColumn(
        "_text", F.when(~F.col("missing"), F.col("repeats.kept")))
    own = {text: F.col("_text"), n_chars: F.char_length(F.coalesce("_text", F.lit(""))).cast("long")}
    return rows.select(*((own[c] if c in own else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))
