"""Byte-level BPE: encoding by a segment tree of pair ranks, decoding, and a bounded cache of frequent chunks."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Rank of a pair that cannot merge.
NEVER = 1 << 62
#: A space that the next match may not begin with: such texts are split by the pattern as a whole.
UNSAFE_SPACE = re.compile(r" (?:\s|\Z)")
#: Words kept per worker and generation; two generations live at a time.
CACHE_WORDS = 400_000
CACHED_LENGTH = 24
#: Bytes that a dictionary takes for an entry, beside its text and its value.
ENTRY_BYTES = 40
#: Bytes of the table that tells a second sight from a first.
SEEN = 1 << 22
#: ASCII characters that are neither letters, digits nor white space, and begin no match that holds letters.
SYMBOLS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Vocabulary:
    """Token ids by bytes (from a file of base64 token and rank per line), and the rank of each pair that merges."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.pairs = {(left, right): rank for token, rank in self.ids.items() for cut in range(1, len(token))
                      if (left := self.ids.get(token[:cut])) is not None
                      and (right := self.ids.get(token[cut:])) is not None}


def merged(data: bytes, vocabulary: Vocabulary) -> list[int]:
    """Token ids of one match; a match that is a token is that token.

    A leaf of the tree stands for a byte position and holds the rank of the pair that starts there, or
    NEVER; ranks are stored times the number of leaves plus the position, so the smallest value at the
    root is the leftmost of the lowest ranks. A merge changes three leaves: its own, the one it
    swallows and the live one before it.
    """
    whole = vocabulary.ids.get(data)
    if whole is not None or not data:
        return [] if whole is None else [whole]
    n = len(data)
    ids = [vocabulary.single[b] for b in data]
    pairs = vocabulary.pairs
    size = 1 << (n - 1).bit_length()
    tree = [NEVER] * (2 * size)
    for i in range(n - 1):
        rank = pairs.get((ids[i], ids[i + 1]))
        if rank is not None:
            tree[size + i] = rank * size + i
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(at: int, value: int) -> None:
        node = at + size
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            node >>= 1
            if other < value:
                value = other
            if tree[node] == value:
                return
            tree[node] = value

    while tree[1] < NEVER:
        rank, at = divmod(tree[1], size)
        gone = following[at]
        ids[at], ids[gone] = rank, -1
        after = following[gone]
        following[at] = after
        put(gone, NEVER)
        if after < n:
            before[after] = at
            found = pairs.get((rank, ids[after]))
            put(at, NEVER if found is None else found * size + at)
        else:
            put(at, NEVER)
        previous = before[at]
        if previous >= 0:
            found = pairs.get((ids[previous], rank))
            put(previous, NEVER if found is None else found * size + previous)
    return [i for i in ids if i >= 0]


class Remembered(dict):
    """What `make` gives for a short text that comes again, kept for two generations of CACHE_WORDS texts or `size` bytes.

    A text is kept from its second sight on, by a byte of its hash in a table of fixed size, so that texts
    that come once do not push out the others.
    """

    def __init__(self, make: Callable[[str], bytes], size: float = math.inf) -> None:
        super().__init__()
        self.make, self.older, self.seen = make, {}, bytearray(SEEN)
        self.size, self.held = size, 0

    def __missing__(self, text: str) -> bytes:
        value = self.older.get(text)
        if value is None:
            value = self.make(text)
            if len(text) > CACHED_LENGTH:
                return value
            mark = hash(text)
            place, tag = mark % SEEN, mark // SEEN & 255
            if self.seen[place] != tag:
                self.seen[place] = tag
                return value
        if len(self) >= CACHE_WORDS or self.held >= self.size:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self[text] = value
        self.held += sys.getsizeof(text) + sys.getsizeof(value) + ENTRY_BYTES
        return value


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    A space that precedes a non-space always starts a match, so texts are cut there. Most of the chunks
    are a word, or a word and symbols after it, and need no pattern: words come from a cache, and so
    do the matches of the other chunks. A generation of the words takes about `size` bytes at most,
    one of the matches `match_size`.
    """

    def __init__(self, match_ids: Callable[[str], bytes], pattern: str, size: float = math.inf, match_size: float = math.inf) -> None:
        self.split = regex.compile(pattern).findall
        self.match_ids = match_ids
        self.matches = Remembered(match_ids, match_size)
        self.spaced = Remembered(self._spaced, size)

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.matches.__getitem__, self.split(chunk)))

    def _spaced(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self.match_ids(" " + chunk)
        word = chunk.rstrip(SYMBOLS)
        if word.isalpha():
            return self.spaced[word] + self.matches[chunk[len(word):]]
        return self._chunk(" " + chunk)

    def __call__(self, text: str) -> bytes:
        if UNSAFE_SPACE.search(text):
            return self._chunk(text)
        first, *rest = text.split(" ")
        return self._chunk(first) + b"".join(map(self.spaced.__getitem__, rest))


_ENCODERS: dict[tuple[str, str], tuple[Vocabulary, Encoder]] = {}


def encoder(path: str, pattern: str) -> tuple[Vocabulary, Encoder]:
    """One per worker process, so that its cache lives as long as the worker."""
    if (path, pattern) not in _ENCODERS:
        vocabulary = Vocabulary(path)
        _ENCODERS[path, pattern] = vocabulary, Encoder(
            lambda match: array("I", merged(match.encode("utf-8", "surrogatepass"), vocabulary)).tobytes(), pattern)
    return _ENCODERS[path, pattern]


def decoded(ids: bytes, vocabulary: Vocabulary) -> bytes:
    return b"".join(map(vocabulary.tokens.__getitem__, array("I", ids)))


def encoded(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (binary, little-endian uint32) of each row's whole text; a null text is empty and has no ids."""

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern)[1]
        for batch in batches:
            ids = pa.array([encode(t.as_py()) for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])

    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(ids_of, f"key {dict(rows.dtypes)['key']}, ids binary")


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, and SHA-256 of the ids and of the bytes decoded from them; one row per input row.

    Null keys and repeated rows are kept as they are; a null or empty text has no tokens and the digest
    of no bytes; an empty table gives an empty one.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, encode = encoder(path, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for value in batch.column(1):
                ids = encode(value.as_py())
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_bytes.append(hashlib.sha256(decoded(ids, vocabulary)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(
        digests, f"key {dict(rows.dtypes)['key']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
