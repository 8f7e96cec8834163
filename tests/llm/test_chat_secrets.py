import hashlib
import re

import pytest
from pyspark.sql import functions as F

from parcelscope.llm import chat, queries, secrets

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


HEX, KEY = "0123456789abcdef" * 2, "AKIA" + "A1B2" * 5
TEXTS = [
    None, "", "token=abc", "token=token: abcdefgh", f"é𝄞 password: 'hunter2x' {HEX}{KEY}", f"{KEY} {KEY}{HEX}",
    "login=bob password=abcdef1 https://db.example.com/x", "login=bob " + "x " * 400 + "password=abcdef1",
    f"https://a.example.com/ {KEY} secret = abcdefgh", "https://a.example.com/ nothing else", "API_KEY = \"abc.def=\"",
    "password=abcdefg " * 3000, "user_name: al " * 50 + KEY, "token=" * 5, "tokenſ=abcdefg toKen=abcdefg",
]


@pytest.fixture(scope="module")
def scanned(spark):
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(TEXTS + TEXTS[3:5])],
                                 "doc_id long, text string, spans string")
    return {(r.key, r.content): r for r in secrets.scanned(docs).withColumn("said", secrets.listed("spans")).collect()}, docs


def test_base_spans_against_regular_expressions(scanned):
    rows, docs = scanned
    by_text = {r.doc_id: (r.text, r.h) for r in docs.select("*", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    assert len(rows) == len(by_text)
    for key, (text, h) in by_text.items():
        assert [(s.start, s.rank, s.stop) for s in rows[key, h].base] == base_spans(text)


def test_weak_parts_need_their_complement(scanned):
    said = {key: r.said for (key, _), r in scanned[0].items()}
    assert "login:0:9" in said[6] and "endpoint" in said[6]
    assert "login" not in said[7]          # the other part is out of scope
    assert "endpoint:0:22" in said[8]
    assert said[9] == ""
    assert said[12].count("login") == 0    # an identifier does not complete an identifier
    whole = {(s.start, s.rank, s.stop) for r in scanned[0].values() for s in r.base}
    assert whole <= {(s.start, s.rank, s.stop) for r in scanned[0].values() for s in r.spans}


def test_parts_within_scope_of_a_long_span(spark):
    address, login, secret = "https://a.example.com/".ljust(600, "x"), "login=" + "b" * 14, "password=abcdef1"
    texts = {
        1: f"{KEY} {address}" + " " * 20 + secret,                    # the parts lie on both sides, in cells apart
        2: f"{KEY} {address}" + " " * 256 + secret,
        3: f"{KEY} {address}" + " " * 257 + secret,
        4: " " * 255 + login + " " * 250 + secret,
        5: " " * 255 + login + " " * 257 + secret,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = secrets.scanned(docs).select("key", "spans", secrets.listed("spans").alias("said")).collect()
    said = {r.key: r.said for r in rows}
    assert {key for key, s in said.items() if "endpoint" in s} == {1, 2}
    assert {key for key, s in said.items() if "login" in s} == {4}
    assert all(len(set(r.spans)) == len(r.spans) for r in rows)


def test_long_tokens_are_tested_whole(spark):
    near = f"{KEY} "
    texts = {0: near + "a" * 200 + "1Abbbbb", 1: near + "1" + "a" * 200 + "Abbbbb", 2: near + "a" * 300, 3: near + "a" * 150 + "1" + "b" * 150,
             4: near + "A" + "a" * 149 + "1" + "b" * 150}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.key: [(s.start, s.stop) for s in r.spans if s.rank == list(secrets.KINDS).index("blob")] for r in secrets.scanned(docs).collect()}
    at = len(near)
    assert got == {0: [(at, len(texts[0]))], 1: [(at, len(texts[1]))], 2: [], 3: [], 4: [(at, len(texts[4]))]}


def test_redaction_replaces_each_run(spark, scanned):
    rows = secrets.redacted(scanned[1]).collect()
    assert len(rows) == len(TEXTS) + 2 and rows[0].asDict().keys() == {"doc_id", "text", "spans"}
    for r in rows:
        assert not base_spans(r.text) and (r.text is None) == (r.doc_id is None)


def test_secret_query_on_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op5_secret_scan(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = ",".join(f"{list(secrets.KINDS)[k]}:{a}:{b}" for a, k, b in base_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) <= set(r.spans.split(","))


def test_empty_secret_table(spark):
    assert secrets.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "</turn>\n### user: x", "\\h\\\\l", "", None, "a:b\n", "é𝄞<", "#" * 9]
    rows = [(1, i, r, t, "clash") for i, t in enumerate(nasty) for r in ("assistant",)]
    rows += [(2, 0, "us:er#", nasty[0], ""), (2, 0, "us:er#", nasty[0], ""), (2, None, None, "x" * 50000, ""),
             (None, 1, "assistant", "y", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {r.key: r for r in chat.read_back(chat.formatted(turns.withColumn("parts", chat.text_parts()))).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("assistant", t or "") for t in nasty]
    assert out[1].trained == [t or "" for t in nasty]
    assert [(t.role, t.text) for t in out[2].turns] == [("", "x" * 50000)] + [("us:er#", nasty[0])] * 2
    assert out[2].trained == [] and out[None].trained == ["y"]


def test_chat_parts_become_placeholders(spark):
    rows = spark.sql("""
        SELECT 1 AS conv_id, 0 AS turn, 'user' AS role, array(
          named_struct('kind','text','text','see <|image_1|> ','uri',null,'width',null,'height',null,'seconds',null,'pages',null),
          named_struct('kind','image','text',null,'uri','a.png','width',57,'height',28,'seconds',null,'pages',null),
          named_struct('kind','audio','text',null,'uri','b.wav','width',null,'height',null,'seconds',1.5D,'pages',null),
          named_struct('kind','pdf','text',null,'uri','c.pdf','width',null,'height',null,'seconds',null,'pages',2)) AS parts
        UNION ALL SELECT 2, 0, 'user', null""").withColumn("parts", F.col("parts").cast(f"array<{chat.PART}>"))
    out = {r.key: r for r in chat.formatted(rows).collect()}
    assert out[1].formatted == "### user: see \\l|image_1|> <|image_1|><|audio_2|><|document_3|></turn>\n"
    assert [(a.kind, a.uri, a.tokens) for a in out[1].attachments] == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 512)]
    assert out[1].expanded_tokens == 553 and out[2].formatted == "### user: </turn>\n" and out[2].expanded_tokens == 0


def test_chat_empty(spark):
    assert chat.formatted(spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART}>")).count() == 0
