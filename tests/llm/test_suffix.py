import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from parcelscope.llm import queries, suffix


def plain(texts, length, words=0, size=0):
    """(bytes, removed, spans, kept) of each text, from all strings of `length` bytes; shorter runs than asked for stay."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = True
        for run in re.finditer(rb"\x01+", gone[:-1].tobytes()):
            if run.end() - run.start() < size and len(re.findall(rb"[^ \t-\r]+", d[run.start():run.end()])) <= words:
                gone[run.start():run.end()] = False
        runs = int((gone[:-1] & ~gone[1:]).sum())
        out.append((len(d), int(gone.sum()), runs, bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])))
    return out


def rows_of(spark, texts, length):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, content string, lo int")
    got = {r.key: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
           for r in suffix.without_repeats(docs.repartition(3), length=length).collect()}
    assert len(got) == len(texts)
    return [got[i] for i in range(len(texts))]


def corpus(seed, documents, size, passages):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 6)))
    shared = [" ".join(word() for _ in range(draw.randint(3, 60))) for _ in range(passages)]
    texts = []
    for _ in range(documents):
        parts = [" ".join(word() for _ in range(draw.randint(0, size))) for _ in range(3)]
        parts[1:1] = draw.sample(shared, draw.randint(0, 3))
        texts.append(" ".join(parts))
    for _ in range(documents // 3):            # copies with a few changed characters
        t = list(draw.choice(texts))
        for _ in range(draw.randint(0, 3)):
            if t:
                t[draw.randrange(len(t))] = "z"
        texts.append("".join(t))
    return texts + draw.sample(texts, 3)


def test_anchors_depend_on_the_window_alone():
    draw = np.random.default_rng(0)
    data = draw.integers(97, 101, 5000).astype(np.uint8)
    anchors, _, _ = suffix.window_anchors(data, 40, 10)
    seen = {}
    for i, a in enumerate(anchors):
        assert i <= a <= i + 30
        assert seen.setdefault(data[i:i + 40].tobytes(), a - i) == a - i
    joined = np.concatenate((data[1000:1700], data[300:900]))
    assert (suffix.window_anchors(joined, 40, 10)[0][:600] == anchors[1000:1600] - 1000).all()


@pytest.mark.parametrize("seed,length", [(1, 40), (2, 16), (3, 64)])
def test_against_all_substrings(spark, seed, length):
    texts = corpus(seed, 40, 60, 6)
    assert rows_of(spark, texts, length) == plain(texts, length)


def test_many_runs_of_one_anchor(spark, monkeypatch):
    monkeypatch.setattr(suffix, "TOGETHER", 3)
    texts = corpus(4, 60, 30, 3)
    assert rows_of(spark, texts, 24) == plain(texts, 24)


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(suffix, "STRETCH", 1000)
    long = "".join(random.Random(9).choice("abcdefgh") for _ in range(7000))
    texts = [None, "", "short", "a" * 39, "a" * 40, "b" * 41, "c" * 500, "ab" * 100, long, long[2500:4200], "é" * 30, "é" * 30,
             "x" + "é" * 30]
    assert rows_of(spark, texts, 40) == plain(texts, 40)
    docs = spark.createDataFrame([(None, long), (None, long), (None, "q")], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in suffix.without_repeats(docs).collect())
    assert got == [(1, 0), (7000, 7000), (7000, 7000)]
    assert suffix.without_repeats(docs.limit(0)).count() == 0


def test_rewritten_keeps_rows_and_columns(spark):
    texts = [None, "keep", "\ufffd" + "é" * 30, "é" * 30, "x" + "é" * 30 + "y"]
    docs = spark.createDataFrame([(i if i else None, t, "k", 9, "r") for i, t in enumerate(texts)],
                                 "doc_id long, text string, kept string, n_chars long, `odd name.` string")
    out = suffix.rewritten(docs, length=41)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert (got[None].text, got[1].text) == (None, "keep") and got[1].n_chars == 4 and got[None].n_chars == 0
    assert (got[2].text, got[3].text, got[4].text) == ("\ufffd", "", "xy") and got[4].kept == "k" and got[4][4] == "r"


def test_runs_of_few_words_stay(spark):
    draw = random.Random(5)
    word = lambda low, high: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(low, high)))
    passages = [[word(1, 4) for _ in range(12)], [word(1, 4) for _ in range(30)], [word(30, 40) for _ in range(5)],
                [word(8, 9) for _ in range(6)]]
    texts = [None, ""]
    for passage in passages * 2:
        texts.append(" ".join([word(2, 9) for _ in range(20)] + passage + [word(2, 9) for _ in range(20)]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = [kept.decode() for *_, kept in plain(texts, 20, words=20, size=150)]
    got = {r.doc_id: r.text for r in suffix.rewritten(docs, length=20, words=20, size=150).collect()}
    assert [got[i] or "" for i in range(len(texts))] == want
    # Twelve words or sixty bytes stay, thirty words or 150 bytes go.
    assert [w == (t or "") for w, t in zip(want, texts)] == [True, True] + [True, False, False, True] * 2


def test_query_on_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(texts, plain(texts.values(), 400)))
    rows = queries.op6_suffix_dedup(spark, sf).collect()
    assert len(rows) == len(texts) and any(r.n_removed for r in rows)
    for r in rows:
        n, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())


def test_passages_beside_repeats(spark):
    texts = corpus(6, 40, 60, 6) + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.key: r for r in suffix.without_repeats(docs.repartition(3), length=80, passages=(30, 8, 60)).collect()}
    assert len(got) == len(texts)
    for i, (repeats, passages) in enumerate(zip(plain(texts, 80), plain(texts, 30, 8, 60))):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == repeats
        assert (got[i].passages.n_removed, got[i].passages.n_spans, bytes(got[i].passages.kept)) == passages[1:]
    assert any(r.passages.n_removed > r.n_removed for r in got.values())


def test_query_catches_passages_below_the_threshold(spark, tmp_path):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    passages = [some(52) for _ in range(5)]
    assert all(len(p) < 400 for p in passages)
    short = some(20)
    texts = [f"{some(40)} {p} {some(40)}" for p in passages * 2] + [some(150) for _ in range(5)]
    texts += [f"{some(30)} {short} {some(30)}" for _ in range(3)] + [None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_suffix_dedup(spark, str(tmp_path)).collect()}
    assert all(r.n_removed == 0 and r.text == (texts[i] or "") for i, r in got.items())
    for i, text in enumerate(texts):
        if i < 10:
            assert got[i].n_passage_bytes >= len(passages[i % 5]) and passages[i % 5] not in got[i].text_without_passages
        else:
            assert got[i].n_passage_bytes == 0 and got[i].text_without_passages == (text or "")
