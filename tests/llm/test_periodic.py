"""Periodic runs against every period of every stretch; the planted query against plain Python."""

import hashlib
import itertools
import random
import re
import time
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from parcelscope.llm import periodic, queries


def plain_runs(words):
    """Every stretch that no neighbour extends, for every period, with the smallest period of equal stretches."""
    n, found = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if (i, j + q) not in found:
                found[i, j + q] = q
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(6, 4 * q))


def plain_kept(words, runs):
    gone = set(itertools.chain.from_iterable(range(s + q, s + length) for s, length, q in runs))
    return [w for i, w in enumerate(words) if i not in gone]


def check(words):
    runs = periodic.periodic_runs(words)
    assert runs == plain_runs(words), words
    assert periodic.collapsed(words, runs) == plain_kept(words, runs)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    assert periodic.strongest(runs) == best


def test_all_short_texts():
    for n in range(0, 12):
        for words in itertools.product("ab", repeat=n):
            check(words)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_with_repeats(seed):
    draw = random.Random(seed)
    for _ in range(250):
        words = []
        while len(words) < draw.randint(0, 120):
            unit = [draw.choice("abc"[:draw.randint(1, 3)]) for _ in range(draw.randint(1, 12))]
            words += (unit * draw.randint(1, 9))[:draw.randint(1, 60)]
        check(words)


def test_runs_within_runs():
    unit = ["a"] * 7 + ["b"]
    check(unit * 6)
    check((unit * 5 + ["c"]) * 4 + ["a"])
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    check(list(fibonacci[-1]))


def test_very_long_texts_are_searched_whole_and_fast():
    draw = random.Random(5)
    prose = [str(int(draw.paretovariate(0.7))) for _ in range(200_000)]
    for words, runs in ((["w"] * 200_000, [(0, 200_000, 1)]), (["a", "b"] * 100_000, [(0, 200_000, 2)]),
                        (prose[:50_000] * 4, [(0, 200_000, 50_000)])):
        start = time.time()
        found = periodic.periodic_runs(words)
        assert all(r in found for r in runs) and time.time() - start < 30


def test_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (None, "a b " * 4 + "a", "x"), (3, " \t\n", "x"), (3, "q q q q q q", None), (3, "q q q q q q", None),
         (4, "one  two\x0bthree\x1cfour ünï", "x"), (5, "é " * 40_000, "y")], "doc_id long, text string, key string")
    rows = periodic.found(docs.withColumns({"runs": F.lit(1), "n_words": F.lit("z"), "collapsed": F.lit(None)}))
    got = sorted(((r.key, r.n_words, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed)
                  for r in rows.collect()), key=repr)
    assert got == sorted([
        (1, 0, [], None, ""), (2, 0, [], None, ""), (3, 0, [], None, ""), (None, 9, [(0, 9, 2)], (0, 9, 2), "a b"),
        (3, 6, [(0, 6, 1)], (0, 6, 1), "q"), (3, 6, [(0, 6, 1)], (0, 6, 1), "q"),
        (4, 4, [], None, "one two three\x1cfour ünï"), (5, 40_000, [(0, 40_000, 1)], (0, 40_000, 1), "é")], key=repr)
    assert periodic.found(docs.limit(0)).collect() == []


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = periodic.periodic_runs(words) if len(words) > 400 else plain_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(plain_kept(words, runs))))


def test_query(spark, sf):
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, sf).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    want = {r.doc_id: plain_row(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got == want
    assert sum(r[1] > 0 for r in got.values()) > 10
