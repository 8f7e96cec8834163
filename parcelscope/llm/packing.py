"""Packing by concatenate and cut: prefix sums over partition totals give every document its place in one long id stream."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import sliced, stored, text_of

if TYPE_CHECKING:
    from tokenizers import Tokenizer

PIECES = ("key {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "padded_length long")

#: Bytes of a generation of the encoder's words and of its matches; two generations of each live at a time, in every worker that ever packed.
CACHE_BYTES, MATCH_BYTES = 40 << 20, 8 << 20

_ENCODERS: dict[tuple[str, str], tuple[Callable[[str], bytes], str]] = {}


def byte_names() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def encoder(path: str, pattern: str) -> tuple[Callable[[str], bytes], str]:
    """Ids as the tokenizers library gives them, and the smallest integer type that holds them; one per worker process.

    The strings of the file's added tokens are cut out of a text first and become their own ids; the pattern's
    matches of what lies between go to the library's model one by one.
    """
    if (path, pattern) not in _ENCODERS:
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        model, names = tokenizer.model, byte_names()

        def match_ids(match: str) -> bytes:
            if match.isascii() and match.isprintable():
                data = match.replace(" ", names[32])
            else:
                data = match.encode("utf-8", "surrogatepass").decode("latin-1").translate(names)
            return array("I", [token.id for token in model.tokenize(data)]).tobytes()

        kind = "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        _ENCODERS[path, pattern] = with_added(Encoder(match_ids, pattern, CACHE_BYTES, MATCH_BYTES), tokenizer), kind
    return _ENCODERS[path, pattern]


def with_added(encode: Callable[[str], bytes], tokenizer: Tokenizer) -> Callable[[str], bytes]:
    """`encode` for the text between added tokens, and the ids of these tokens where they stand."""
    added = tokenizer.get_added_tokens_decoder()
    odd = [t.content for t in added.values() if t.lstrip or t.rstrip or t.single_word or t.normalized]
    if odd:
        raise ValueError(f"added tokens that take in their surroundings are not supported: {odd}")
    if not added:
        return encode
    ids = {token.content: array("I", [i]).tobytes() for i, token in added.items()}
    found = re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")")

    def encode_all(text: str) -> bytes:
        parts = found.split(text)
        if len(parts) == 1:
            return encode(text)
        return b"".join(ids[part] if i % 2 else encode(part) for i, part in enumerate(parts) if part)

    return encode_all


def streams(docs: DataFrame, path: str, pattern: str, key: str, text: str, end_id: int) -> DataFrame:
    """First pass: key, part (input partition), start (ids before the document in its partition), n, ids; stored.

    The stored rows fix which documents form a partition, so the second pass sees the same totals
    whatever executor is lost.
    """
    ending = end_id.to_bytes(4, "little")

    def encode_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encode, kind), part, at = encoder(path, pattern), TaskContext.get().partitionId(), 0
        for batch in sliced(batches):
            ids = [encode(t.as_py()) + ending for t in batch.column(1)]
            counts = np.array([len(i) // 4 for i in ids], np.int64)
            starts = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            # Two bytes an id where that is enough: the stored table is the largest this operator writes.
            small = [np.frombuffer(i, "<u4").astype(kind).tobytes() for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ids), part), pa.int32()), pa.array(starts), pa.array(counts),
                 pa.array(small, pa.binary())], ["key", "part", "start", "n", "ids"])

    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return stored(rows.mapInArrow(
        encode_part, f"key {dict(rows.dtypes)['key']}, part int, start long, n long, ids binary"), "ids")


def packed(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text",
           length: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length.

    All documents' ids, each followed by `end_id`, form one stream in the order of partitions; it is cut
    at every multiple of `length`. Each id lies in one piece, and only the last sequence can be short:
    it is padded to `length`, unless it holds a power of two already. A null or empty text is its end
    id alone; null keys and repeated rows are documents of their own; no rows give no pieces.

    What goes to all tasks is one row per input partition.
    """
    parts = streams(docs, path, pattern, key, text, end_id)
    totals = parts.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"),
                          F.sum("total").over(everything).alias("stream"))
    rows = parts.join(F.broadcast(bases), "part").select(
        "key", (F.col("base") + F.col("start")).alias("at"), "n", "stream", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            at, n, stream = (batch.column(i).to_numpy() for i in (1, 2, 3))
            last = (at + n - 1) // length
            pieces = last - at // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = at[row] // length + number
            start = np.maximum(sequence * length - at[row], 0)
            stop = np.minimum((sequence + 1) * length - at[row], n[row])
            ids = batch.column(4)
            sums, of = np.empty(len(row), np.int64), -1
            for i, (r, a, b) in enumerate(zip(row.tolist(), start.tolist(), stop.tolist())):
                if r != of:
                    data, of = ids[r].as_py(), r
                    if len(data) == 2 * n[r]:
                        data = np.frombuffer(data, "<u2").astype("<u4").tobytes()
                sums[i] = zlib.crc32(memoryview(data)[4 * a: 4 * b])
            used = np.minimum(stream[row] - sequence * length, length)
            padded = np.where((used & (used - 1)) == 0, used, length)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), *(pa.array(x) for x in (
                    start, stop - start, sums, n[row], sequence, at[row] + start - sequence * length, padded))],
                ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"])

    return rows.mapInArrow(cut, PIECES.format(key=dict(rows.dtypes)["key"]))


def padding_share() -> Column:
    """Share of padding in packed sequences, as an aggregate over the pieces."""
    filled = F.sum("length")
    return 1 - filled / F.sum(F.when(F.col("offset") == 0, F.col("padded_length")))
