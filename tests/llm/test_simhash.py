import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parcelscope.llm import queries, simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints):
    """Smallest key reachable, by comparing all pairs of distinct fingerprints."""
    values = np.array(sorted(set(prints.values())), np.uint64)
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= 3) + i + 1:
            parent[root(int(j))] = root(i)
    place = {int(v): root(i) for i, v in enumerate(values)}
    least = {}
    for key, value in prints.items():
        least[place[value]] = min(least.get(place[value], key), key)
    return {key: least[place[value]] for key, value in prints.items()}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "One two", "a b c", "É é Σ A\x0bB\x1cC d", "x y " * 400, "tie a b c"])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == plain_fingerprint(text)


def test_embedding_bounds_the_distance(spark):
    draw = random.Random(1)
    values = [draw.getrandbits(64) for _ in range(200)]
    rows = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "v long")
    got = [int(np.int64(r.u).astype(np.uint64)) for r in rows.select(simhash.embedded(F.col("v")).alias("u")).collect()]
    counts = np.array([[bin(v >> s & 3).count("1") for s in range(0, 64, 2)] for v in values])
    for i in range(0, 200, 7):
        for j in range(200):
            manhattan = int(np.abs(counts[i] - counts[j]).sum())
            assert (got[i] ^ got[j]).bit_count() == manhattan <= (values[i] ^ values[j]).bit_count()


def test_masks_cover_every_choice():
    assert len(simhash.masks(6, 3)) == 20
    of = [m & (1 << 64) - 1 for m in simhash.masks(6, 3)]
    draw = random.Random(2)
    for _ in range(500):
        change = sum(1 << b for b in draw.sample(range(64), 3))
        assert any(change & m == 0 for m in of)


def test_links_connect_chains_and_large_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    draw = random.Random(5)
    values = {draw.getrandbits(64) for _ in range(300)}
    for start in list(values)[:6]:                         # chains of single steps of three bits
        for _ in range(40):
            start ^= sum(1 << b for b in draw.sample(range(64), 3))
            values.add(start)
    centre = draw.getrandbits(64)                          # one group of near copies
    values |= {centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 2))) for _ in range(400)}
    prints = dict(enumerate(sorted(values)))
    rows = spark.createDataFrame([(k, int(np.uint64(v).astype(np.int64))) for k, v in prints.items()], "key long, print long")
    links = simhash.near_links(rows).collect()
    for link in links:
        assert (link.a ^ link.b & (1 << 64) - 1).bit_count() and bin((link.a ^ link.b) & (1 << 64) - 1).count("1") <= 3
    labels = {r.node: r.component for r in simhash.components(spark.createDataFrame(links), "a", "b").collect()}
    want = plain_components(prints)
    groups = {}
    for key, value in prints.items():
        signed = int(np.uint64(value).astype(np.int64))
        groups.setdefault(labels.get(signed, ("alone", signed)), set()).add(want[key])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_edge_cases(spark):
    rows = [(5, None, "c"), (4, "", "c"), (None, " ", "c"), (9, "same words here now", "c"), (9, "same words here now", "c"),
            (7, "Same  words\nhere NOW", "c"), (None, "alone", "c"), (8, "w " * 50_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    out = simhash.deduplicated(docs).collect()
    assert len(out) == len(rows)
    got = sorted((r.key or -1, r.component or -1) for r in out)
    assert got == sorted([(5, 4), (4, 4), (-1, 4), (9, 7), (9, 7), (7, 7), (-1, -1), (8, 8)])
    kept = simhash.without_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 4, 7, 8]
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def test_query_on_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    want = plain_components(prints)
    rows = queries.op4_simhash(spark, sf).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {
        (k, f"{prints[k]:016x}", want[k]) for k in texts} and len(rows) == len(texts)
