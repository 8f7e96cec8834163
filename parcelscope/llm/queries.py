"""The registered queries of this subpackage, each applied to its whole table, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, crf, hnsw, html_tree, nn_descent, packing, periodic, secrets, simhash, suffix, url_rules, whitening
from .common import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows = html_tree.extracted(pages, html_tree.trained(pages))
    return rows.select(F.col("key").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)
    return rows.withColumnRenamed("key", "doc_id")


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hnsw.linked(table(spark, sf_dir, "embeddings"), least=0.93)
    return rows.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.deduplicated(table(spark, sf_dir, "documents"))
    return rows.select(F.col("key").alias("doc_id"), "fingerprint", F.col("component").alias("component_id"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scanned(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("key").alias("doc_id"), *(secrets.counted("base", k).alias(f"n_{k}") for k in secrets.BASE),
        F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix.without_repeats(table(spark, sf_dir, "documents"), length=400, passages=(200, 50, 400))
    # Bytes left over from cut characters show as U+FFFD in the texts; the digest is of the bytes.
    return rows.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                       F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
                       F.col("passages.n_removed").alias("n_passage_bytes"),
                       F.make_valid_utf8(F.col("passages.kept").cast("string")).alias("text_without_passages"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    planted = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)],
                                  "conv_id long, turn long, role string, text string")
    rows = turns.union(extra).withColumn("parts", chat.text_parts("text"))
    back = chat.read_back(chat.formatted(rows))
    turn_texts = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.withColumn("loss", F.array_join("trained", "")).select(
        F.col("key").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turn_texts, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.PATTERN)
    return pieces.withColumnRenamed("key", "doc_id")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nn_descent.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), count=20)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = crf.trained(docs, table(spark, sf_dir, "labels"))
    return crf.scored(docs, field).select(
        F.col("key").alias("doc_id"), F.coalesce(crf.held_out("key"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents in which every tenth id, by the hash h of its decimal digits, repeats its words from a on with period p.

    Texts of the others, of a null id and of no words stay as they are.
    """
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = periodic.words_of(F.col("text"))
    n, g = F.size("words").cast("long"), F.floor(h / 10).cast("long")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words")).withColumn("a", F.when(n > 0, g % n))
    period = F.floor((n - F.col("a")) / (3 + g % 8)).cast("long") + 1
    planted = F.transform(F.col("words"), lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.withColumn("p", period).select(
        "doc_id", F.when(F.col("a").isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic.found(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.col("strongest")
    return rows.select(
        F.col("key").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
        best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(periodic.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


SITES = (("net/", False), ("example.net/en/", True), ("example.com/de/", False), ("org/fr/", True))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_rules.site_rule(text, allow) for text, allow in SITES] + [
        url_rules.pattern_rule(text) for text in url_rules.PATTERNS]
    rows = url_rules.judged(table(spark, sf_dir, "pages"), rules)
    return rows.select(F.col("key").alias("page_id"), "host", "path", "rule", "pattern", "verdict")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), components=32).withColumnRenamed("key", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_bpe": op2_bpe,
    "op3_near_vectors": op3_near_vectors,
    "op4_simhash": op4_simhash,
    "op5_secret_scan": op5_secret_scan,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_packing": op8_packing,
    "op9_nearest": op9_nearest,
    "op10_quality": op10_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_url_filter": op12_url_filter,
    "op13_whitening": op13_whitening,
}

ORACLE: dict[str, str] = {
    "op7_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l') AS body,
             replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c') AS head FROM t)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('### ' || head || ': ' || body || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    # Every rule stated as a regular expression of its own, tried on every URL.
    "op12_url_filter": r"""
WITH s AS (SELECT * FROM (VALUES ('net/', '(^|\.)net$', '/', 'block'), ('example.net/en/', '(^|\.)example\.net$', '/en/', 'allow'),
    ('example.com/de/', '(^|\.)example\.com$', '/de/', 'block'), ('org/fr/', '(^|\.)org$', '/fr/', 'allow')) v(rule, host_regex, prefix, verdict)),
f AS (SELECT * FROM (VALUES
    ('||adult-', '^([^/?#]*\.)?adult-', 'block'), ('||adult.', '^([^/?#]*\.)?adult\.', 'block'),
    ('||porn-', '^([^/?#]*\.)?porn-', 'block'), ('||porn.', '^([^/?#]*\.)?porn\.', 'block'),
    ('||xxx.', '^([^/?#]*\.)?xxx\.', 'block'), ('||xxx-', '^([^/?#]*\.)?xxx-', 'block'),
    ('||casino-', '^([^/?#]*\.)?casino-', 'block'), ('||casino.', '^([^/?#]*\.)?casino\.', 'block'),
    ('||poker-', '^([^/?#]*\.)?poker-', 'block'), ('||betting-', '^([^/?#]*\.)?betting-', 'block'),
    ('||ads.', '^([^/?#]*\.)?ads\.', 'block'), ('||ad.', '^([^/?#]*\.)?ad\.', 'block'),
    ('||adserver.', '^([^/?#]*\.)?adserver\.', 'block'), ('||tracker.', '^([^/?#]*\.)?tracker\.', 'block'),
    ('||tracking.', '^([^/?#]*\.)?tracking\.', 'block'), ('||doubleclick.', '^([^/?#]*\.)?doubleclick\.', 'block'),
    ('/adserver/', '/adserver/', 'block'), ('/banner-ads/', '/banner-ads/', 'block'), ('/popunder/', '/popunder/', 'block'),
    ('/affiliate^', '/affiliate([^a-z0-9_.%-]|$)', 'block'), ('/wp-login.', '/wp-login\.', 'block'),
    ('/wp-admin/', '/wp-admin/', 'block'), ('/cgi-bin/', '/cgi-bin/', 'block'), ('/login^', '/login([^a-z0-9_.%-]|$)', 'block'),
    ('/signup^', '/signup([^a-z0-9_.%-]|$)', 'block'), ('/checkout^', '/checkout([^a-z0-9_.%-]|$)', 'block'),
    ('/cart^', '/cart([^a-z0-9_.%-]|$)', 'block'), ('/share^*url=', '(?s)/share([^a-z0-9_.%-]|$).*url=', 'block'),
    ('/search^*q=', '(?s)/search([^a-z0-9_.%-]|$).*q=', 'block'), ('/calendar/*/day/', '(?s)/calendar/.*/day/', 'block'),
    ('^sessionid=', '[^a-z0-9_.%-]sessionid=', 'block'), ('^phpsessid=', '[^a-z0-9_.%-]phpsessid=', 'block'),
    ('^jsessionid=', '[^a-z0-9_.%-]jsessionid=', 'block'), ('^replytocom=', '[^a-z0-9_.%-]replytocom=', 'block'),
    ('/print/*.html|', '(?s)/print/.*\.html$', 'block'), ('@@||docs.', '^([^/?#]*\.)?docs\.', 'allow'),
    ('@@||wiki.', '^([^/?#]*\.)?wiki\.', 'allow'), ('@@/license^', '/license([^a-z0-9_.%-]|$)', 'allow')) v(pattern, regex, verdict)),
u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, row_number() OVER () AS place, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
             translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM u),
ps AS (SELECT place, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
       FROM p JOIN s ON regexp_matches(host, host_regex) AND starts_with(path, prefix) GROUP BY place),
pf AS (SELECT place, arg_min(pattern, (verdict = 'block', pattern)) AS pattern, min(verdict) AS verdict
       FROM p JOIN f ON regexp_matches(folded, regex) GROUP BY place)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN pattern END AS pattern,
       coalesce(ps.verdict, pf.verdict, 'allow') AS verdict
FROM p LEFT JOIN ps USING (place) LEFT JOIN pf USING (place)""",
}
