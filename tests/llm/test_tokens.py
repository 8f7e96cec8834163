import base64
import functools
import hashlib
import random
import sys
import zlib
from array import array
from collections import defaultdict
from unittest.mock import Mock

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parcelscope.llm import bpe, packing, queries

PATH, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a  b \n c", "x" * 30_000, "é𝄞 ok\x85\x1c", "<|endoftext|> y", "the the", "the the", "\n\n\n"]


@functools.cache
def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return reference()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\x85\xa0\x1cab1é'.ßst𝄞<|>", max_size=40))
def test_ids_equal_the_library(text):
    assert list(array("I", bpe.encoder(PATH, P.PATTERN)[1](text))) == reference().encode_ordinary(text)


def test_segment_tree_on_long_matches(library):
    vocabulary = bpe.encoder(PATH, P.PATTERN)[0]
    draw = random.Random(3)
    for n in (1, 2, 3, 17, 500, 4000):
        word = "".join(draw.choice("abcdehinorst") for _ in range(n))
        assert bpe.merged(word.encode(), vocabulary) == library.encode_ordinary(word)


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 100)
    made = []
    words = bpe.Remembered(lambda w: made.append(w) or w.encode())
    for _ in range(3):
        for i in range(1000):
            assert words[str(i)] == str(i).encode() and len(words) <= 100 and len(words.older) <= 100
    before = len(made)
    assert words["999"] == b"999" and len(made) == before


def test_each_code_point_as_both_libraries_take_it():
    tokenizer = Tokenizer.from_file(JSON)
    own, packs = bpe.encoder(PATH, P.PATTERN)[1], packing.encoder(JSON, P.PATTERN)[0]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 37 == 0)]
    texts = [f"a{c} b{c}!{c} {c}x {c}" for c in points]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert list(array("I", packs(text))) == want.ids, repr(text)
        assert list(array("I", own(text))) == reference().encode_ordinary(text), repr(text)


def frame(spark, texts):
    return spark.createDataFrame([(i if i else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")


def test_round_trip_edge_cases(spark, library):
    rows = bpe.round_trip(frame(spark, TEXTS), PATH, P.PATTERN).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r.key or 0] or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(frame(spark, []), PATH, P.PATTERN).count() == 0


def test_bpe_query_on_whole_table(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op2_bpe(spark, sf).collect()
    assert {r.doc_id for r in rows} == texts.keys() and len(rows) == len(texts)
    for r in rows:
        assert r.ids_sha256 == hashlib.sha256(array("I", library.encode_ordinary(texts[r.doc_id])).tobytes()).hexdigest()


def check_pieces(pieces, texts, length):
    tokenizer = Tokenizer.from_file(JSON)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.key].append(p)
        by_sequence[p.sequence_id].append(p)
    assert by_doc.keys() == texts.keys()
    total = 0
    for key, own in by_doc.items():
        ids = [*tokenizer.encode(texts[key] or "", add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(array("I", ids[at: at + p.length]).tobytes())
            at += p.length
        assert at == len(ids)
        total += at
    for number, own in by_sequence.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == (length if number < max(by_sequence) else total - length * max(by_sequence))
    assert sorted(by_sequence) == list(range(-(-total // length)))


@pytest.mark.parametrize("length", [8, 1024])
def test_packing_edge_cases(spark, length):
    texts = dict(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()], "doc_id long, text string, start int, part int")
    check_pieces(packing.packed(docs.repartition(3), JSON, P.PATTERN, length=length).collect(), texts, length)
    assert packing.packed(docs.limit(0), JSON, P.PATTERN).count() == 0


def test_added_tokens_are_taken_as_the_library_takes_them(spark):
    mark = "<|endoftext|>"
    texts = dict(enumerate([f"a {mark} b", mark, mark * 3, f" {mark}", f"{mark}x {mark[:-1]}", f"a{mark}\n{mark} é", mark.upper(), f"<|{mark}|>"]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pieces = packing.packed(docs, JSON, P.PATTERN, length=8).collect()
    check_pieces(pieces, texts, 8)
    assert {p.key: p.doc_tokens for p in pieces}[0] == 5 and {p.key: p.doc_tokens for p in pieces}[2] == 4


def test_cache_gives_what_the_model_gives():
    made = []
    cache = bpe.Remembered(lambda text: made.append(text) or text.encode())
    assert [cache[t] for t in ("a", "a", "a", "b", "x" * 99, "x" * 99)] == [b"a", b"a", b"a", b"b", b"x" * 99, b"x" * 99]
    assert made == ["a", "a", "b", "x" * 99, "x" * 99]


def test_packing_encoder_holds_few_bytes(monkeypatch):
    made = []

    class Kept(bpe.Encoder):
        def __init__(self, *given):
            super().__init__(*given)
            made.append(self)

    monkeypatch.setattr(packing, "Encoder", Kept)
    monkeypatch.setattr(packing, "_ENCODERS", {})
    encode = packing.encoder(JSON, P.PATTERN)[0]
    # Words, and words after a line break, which are matches without a space before them.
    text = " ".join(f"{word}\nA{word}" for i in range(200_000) if (word := f"{i:07d}".translate(str.maketrans("0123456789", "eatonishrd"))))
    first = encode(text)
    assert encode(text) == first == encode(text)
    for cache, size in (made[0].matches, 8 << 20), (made[0].spaced, 40 << 20):
        assert cache
        for generation in cache, cache.older:
            assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in generation.items()) <= size


def test_packing_takes_few_texts_at_a_time(spark, monkeypatch):
    """A batch of the usual 10,000 rows gives short ones, each with its place in the partition."""
    docs = Mock(dtypes=[("key", "bigint")], mapInArrow=lambda of, schema: of)
    docs.select.return_value = docs
    monkeypatch.setattr(packing, "stored", lambda rows, name: rows)
    monkeypatch.setattr(packing, "TaskContext", Mock(**{"get.return_value.partitionId.return_value": 7}))
    texts = ["a b " * (i % 9) for i in range(10_000)]
    texts[4000] = "long " * 1_000_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(texts)], ["key", "text"])
    out = list(packing.streams(docs, JSON, P.PATTERN, "doc_id", "text", 0)([batch, batch.slice(0, 0), batch.slice(0, 10)]))
    assert max(b.num_rows for b in out) <= 256
    whole = pa.Table.from_batches(out).to_pydict()
    assert whole["key"] == [*range(10_000), *range(10)] and set(whole["part"]) == {7}
    at = 0
    for start, n, ids in zip(whole["start"], whole["n"], whole["ids"]):
        assert start == at and len(ids) == 2 * n
        at += n


def test_packing_null_keys(spark):
    rows = packing.packed(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string"), JSON, P.PATTERN).collect()
    assert [r.length for r in rows] == [3, 3] and sorted(r.offset for r in rows) == [0, 3]
    assert all(r.padded_length == 1024 for r in rows)


def test_packing_query_on_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_pieces(queries.op8_packing(spark, sf).withColumnRenamed("doc_id", "key").collect(), texts, 1024)
