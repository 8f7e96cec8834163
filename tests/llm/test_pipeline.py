import random
import re

import pytest

import corpus_pipeline
from parcelscope.llm import crf, simhash, suffix
from test_chat_secrets import base_spans
from test_simhash import plain_components, plain_fingerprint
from test_suffix import plain
from test_tokens import check_pieces


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Input and output of each stage."""
    docs = corpus_pipeline.table(spark, sf, "documents")
    found = []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, sf), name)
        found.append((docs, out))
        docs = out
    return found


def by_id(df):
    rows = df.collect()
    found = {r.doc_id: r for r in rows}
    assert len(found) == len(rows)
    return found


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage_drops_what_the_classifier_rejects(spark, sf, stages):
    before, after = stages[0]
    scores = crf.scored(before, crf.trained(before, corpus_pipeline.table(spark, sf, "labels"))).collect()
    assert by_id(after).keys() == {r.key for r in scores if r.score >= 0.3}
    truth = {r.doc_id: r.quality for r in corpus_pipeline.table(spark, sf, "labels").collect()}
    kept = by_id(after).keys()
    clean = [k for k, q in truth.items() if q == 1]
    assert sum(k in kept for k in clean) >= 0.98 * len(clean) and len(kept) < before.count()


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    before, after = by_id(stages[1][0]), by_id(stages[1][1])
    groups = plain_components({k: plain_fingerprint(r.text) for k, r in before.items()})
    assert after.keys() == set(groups.values()) and all(after[k] == before[k] for k in after)


def test_suffix_stage_removes_repeated_strings(stages):
    before, after = by_id(stages[2][0]), by_id(stages[2][1])
    assert before.keys() == after.keys()
    for (key, _), (_, _, _, kept) in zip(before.items(), plain([r.text for r in before.values()], 200, 50, 400)):
        assert after[key].text == kept.decode("utf-8", "ignore") and after[key].n_chars == len(after[key].text)


def test_suffix_stage_takes_every_shared_passage_of_over_fifty_words(spark, sf):
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 7)))
    passage = " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 5))) for _ in range(51))
    short = " ".join(word() for _ in range(45))
    own = [" ".join(word() for _ in range(60)) for _ in range(6)]
    texts = [f"{own[0]} {passage} {own[1]}", f"{passage} {own[2]}", f"{own[3]} {short}", f"{own[4]} {short}", own[5]]
    assert 200 <= len(passage) < 400 and len(short) < 400
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = by_id(corpus_pipeline.repeated_passages(spark, docs, sf))
    assert not any(passage[i:i + 200] in r.text for r in got.values() for i in range(len(passage) - 199))
    assert [got[i].text for i in (2, 3, 4)] == texts[2:]
    assert own[0] in got[0].text and own[1] in got[0].text and own[2] in got[1].text


def test_secret_stage_marks_each_secret(stages):
    before, after = by_id(stages[3][0]), by_id(stages[3][1])
    assert before.keys() == after.keys()
    for key, row in before.items():
        pieces, at = [], 0
        for start, _, stop in base_spans(row.text):
            if start >= at:
                pieces.append(row.text[at:start])
            at = max(at, stop)
        pieces.append(row.text[at:])
        parts = re.split(re.escape("[SECRET]"), after[key].text)
        if len(pieces) == 1:
            assert after[key].text == row.text
        assert not base_spans(after[key].text.replace("[SECRET]", " ")) and len(parts) >= len(pieces)
        assert after[key].n_chars == len(after[key].text)


def test_packing_stage(stages):
    before, after = stages[4]
    check_pieces(after.withColumnRenamed("doc_id", "key").collect(), {r.doc_id: r.text for r in before.collect()}, 1024)


def test_run_gives_the_last_stage(spark, sf, stages):
    out = corpus_pipeline.run(spark, sf)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert out.columns == stages[-1][1].columns
    # Where documents lie in the stream depends on how rows are dealt; their tokens do not.
    totals = lambda df: sorted({(r.doc_id, r.doc_tokens) for r in df.select(*columns).collect()})
    assert totals(out) == totals(stages[-1][1])


def test_empty_documents(spark, sf):
    docs = corpus_pipeline.table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
    assert simhash.without_near_copies(docs).columns == suffix.rewritten(docs).columns == docs.columns


@pytest.fixture(scope="module")
def odd(spark):
    """Null texts, empty and very long texts, null and repeated ids, repeated rows, and columns named as the stages' own."""
    good = "The river rose slowly through the night. People moved what they could, and waited.\n" * 3
    rows = [(1, None), (2, ""), (None, None), (None, good), (3, good + "One."), (3, good + "One."), (3, "another text of the same id"),
            (4, "w" * 900_000), (5, " \n\t "), (6, "password = hunter22secret here"), (None, "token: abcdef123456 x")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 7, -1.0) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, key string, content long, score double")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quality_stage_on_odd_rows(spark, sf, odd):
    assert rows_of(crf.accepted(odd, None)) == rows_of(odd)
    kept = corpus_pipeline.quality(spark, odd, sf)
    assert kept.columns == odd.columns and set(rows_of(kept)) <= set(rows_of(odd))


def test_near_duplicate_stage_on_odd_rows(spark, sf, odd):
    kept = corpus_pipeline.near_duplicates(spark, odd, sf)
    assert kept.columns == odd.columns and set(rows_of(kept)) <= set(rows_of(odd))
    ids = {}
    for r in kept.collect():
        ids.setdefault(plain_fingerprint(r.text), set()).add(r.doc_id)
    assert ids.keys() == {plain_fingerprint(r.text) for r in odd.collect()}
    assert all(len(of - {None}) <= 1 for of in ids.values()) and kept.where("doc_id = 2 OR doc_id = 5").count() == 0


def test_suffix_stage_on_odd_rows(spark, sf, odd):
    out = corpus_pipeline.repeated_passages(spark, odd, sf)
    assert out.columns == odd.columns and out.count() == odd.count()
    # Rows in the order of their id and text stand next to each other, as texts here only lose what they share.
    texts = [r.text for r in odd.collect()]
    want = sorted(kept.decode("utf-8", "ignore") for *_, kept in plain([t for t in texts if t is None or len(t) < 10_000], 200, 50, 400))
    got = [r for r in out.collect()]
    assert sorted(r.text or "" for r in got if len(r.text or "") < 10_000 and r.doc_id != 4) == want
    assert sum(r.text is None for r in got) == 2 and [r.text for r in got if r.doc_id == 4] == [""]
    assert all(r.key == "k" and r.content == 7 and r.n_chars == len(r.text or "") for r in got)


def test_secret_stage_on_odd_rows(spark, sf, odd):
    out = corpus_pipeline.secret_spans(spark, odd, sf).collect()
    texts = sorted((r.text or "" for r in odd.where("text NOT LIKE '%hunter%' AND text NOT LIKE 'token%' OR text IS NULL").collect()))
    assert sorted(r.text or "" for r in out if "[SECRET]" not in (r.text or "")) == texts
    assert sorted(r.text for r in out if "[SECRET]" in (r.text or "")) == ["[SECRET] here", "[SECRET] x"]
    assert sum(r.text is None for r in out) == 2 and all(r.key == "k" and r.score == -1.0 for r in out)


def test_packing_stage_on_odd_rows(spark, sf, odd):
    pieces = corpus_pipeline.packed_sequences(spark, odd, sf).collect()
    starts = [p for p in pieces if p.start == 0]
    assert len(starts) == odd.count() and sum(p.length for p in pieces) == sum(p.doc_tokens for p in starts)
    assert sum(p.doc_tokens == 1 for p in starts) == 3
