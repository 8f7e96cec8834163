"""Secret scan with multipart credential linking, in DataFrame functions only.

Base kinds stand on their own. Weak kinds (a login name, a long mixed token, an endpoint) are too
common to report alone: they are reported only where the parts that complete a credential lie in the
same scope, found by an interval join on (text, grid cell).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

#: Base patterns in their stated order, then the weak ones.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LOGIN = r"""(?i:user_?name|user_?id|login|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]+"""
BLOB = r"[A-Za-z0-9+/_-]{32,}"
ENDPOINT = r"""https?://[A-Za-z0-9.:-]+[^\s"'<>]*"""
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "login": LOGIN, "blob": BLOB, "endpoint": ENDPOINT}
BASE = ("assign", "access", "hex")

#: Which part of a credential a kind is, and which other parts must lie in its scope before a weak kind counts.
PART_OF = {"assign": "secret", "access": "identifier", "hex": "secret",
           "login": "identifier", "blob": "secret", "endpoint": "endpoint"}
NEEDS = {"login": ("secret",), "blob": ("identifier",), "endpoint": ("identifier", "secret")}

#: Code points that may lie between the parts of one credential.
SCOPE = 256
#: A short value after a key word is no secret.
LEAST_VALUE = 6
#: What the whole match of a kind must hold somewhere.
HOLDS = {"blob": ("[0-9]", "[A-Z]")}


def match_spans(text: Column, kind: str) -> Column:
    """array<struct<start,rank,stop>> of the leftmost non-overlapping matches, in code points.

    A match starts after all text and all matches before it: lengths of the pieces that `split` leaves
    and of the matches themselves, in turn.
    """
    pattern, rank = KINDS[kind], list(KINDS).index(kind)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pieces = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:long,rank:int,stop:long,value:int>>")
    state = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))

    def step(s: Column, pair: Column) -> Column:
        start = s["at"] + F.char_length(pair["piece"])
        stop = start + F.char_length(pair["match"])
        value = F.char_length(F.regexp_extract(pair["match"], pattern, 1)) if kind == "assign" else F.lit(LEAST_VALUE)
        for part in HOLDS.get(kind, ()):
            value = F.when(F.rlike(pair["match"], F.lit(part)), value).otherwise(F.lit(0))
        return F.struct(stop.cast("long").alias("at"), F.concat(s["spans"], F.array(F.struct(
            start.cast("long").alias("start"), F.lit(rank).alias("rank"), stop.cast("long").alias("stop"),
            value.cast("int").alias("value")))).alias("spans"))

    pairs = F.transform(found, lambda m, i: F.struct(F.get(pieces, i).alias("piece"), m.alias("match")))
    spans = F.aggregate(pairs, state, step)["spans"]
    kept = F.filter(spans, lambda s: s["value"] >= LEAST_VALUE)
    plain = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["stop"].alias("stop")))
    return F.when(F.size(found) > 0, plain).otherwise(F.array().cast("array<struct<start:long,rank:int,stop:long>>"))


def candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, content (hash of the text) and one array of spans for each kind; one row per input row."""
    whole = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return whole.select("key", F.xxhash64("text").alias("content"), F.char_length("text").alias("n_chars"),
                        *(match_spans(F.col("text"), kind).alias(kind) for kind in KINDS))


def linked(found: DataFrame) -> DataFrame:
    """Weak spans that the scope confirms: key, content, extra (sorted array of spans).

    The interval join: a part covers the cells from SCOPE before it to SCOPE after it, a weak span those
    from its start to its stop, and the semi join keeps it if the two intervals meet: then they share a cell.
    Rows with the same key and text count once, as their spans are the same.
    """
    texts = found.where(F.size("login") + F.size("blob") + F.size("endpoint") > 0).dropDuplicates(["key", "content"])
    spans = texts.select("key", "content", F.explode(F.concat(*KINDS)).alias("s")).select(
        "key", "content", F.col("s.start").alias("start"), F.col("s.rank").alias("rank"), F.col("s.stop").alias("stop"))
    names = list(KINDS)
    part = F.element_at(F.array(*(F.lit(PART_OF[k]) for k in names)), F.col("rank") + 1)
    cells = F.sequence(F.floor((F.col("start") - SCOPE) / SCOPE), F.floor((F.col("stop") + SCOPE) / SCOPE))
    parts = spans.select("key", "content", part.alias("part"), F.col("start").alias("p_start"),
                         F.col("stop").alias("p_stop"), F.explode(cells).alias("cell"))
    weak = spans.where(F.col("rank") >= len(BASE))
    own_cells = F.sequence(F.floor(F.col("start") / SCOPE), F.floor(F.col("stop") / SCOPE))

    def confirmed(rows: DataFrame, need: str) -> DataFrame:
        other = parts.where(F.col("part") == need).select(
            F.col("key").alias("k"), F.col("content").alias("c"), F.col("cell").alias("p_cell"), "p_start", "p_stop")
        near = (F.col("key").eqNullSafe(F.col("k")) & (F.col("content") == F.col("c")) & (F.col("cell") == F.col("p_cell"))
                & (F.col("p_start") <= F.col("stop") + SCOPE) & (F.col("p_stop") >= F.col("start") - SCOPE))
        # Each need looks in all cells of a span: the parts may lie on its two sides.
        return rows.withColumn("cell", F.explode(own_cells)).join(other, near, "left_semi").drop("cell").distinct()

    kept = None
    for kind, needs in NEEDS.items():
        rows = weak.where(F.col("rank") == names.index(kind))
        for need in needs:
            rows = confirmed(rows, need)
        kept = rows if kept is None else kept.union(rows)
    return kept.groupBy("key", "content").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "stop"))).alias("extra"))


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, content, base and spans, both sorted arrays of struct<start,rank,stop>.

    rank is the place in KINDS. Null texts are empty and have no spans; null keys are kept, and rows
    with an equal key and text get equal results. An empty table gives an empty one.
    """
    found = stored(candidates(docs, key, text), "secrets")
    base = F.sort_array(F.concat(*BASE))
    rows = found.select("key", "content", "n_chars", base.alias("base"))
    extra = linked(found).select(F.col("key").alias("k"), F.col("content").alias("c"), "extra")
    joined = rows.join(extra, F.col("key").eqNullSafe(F.col("k")) & (F.col("content") == F.col("c")), "left")
    spans = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "extra")))
    return joined.select("key", "content", "n_chars", "base", spans.alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end for each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == list(KINDS).index(kind))).cast("long")


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of `docs` with each reported span, or run of overlapping spans, replaced by `mark`; other columns as they are.

    A null text stays null; rows of a null key and repeated rows are redacted each on their own; no rows give no rows.
    """
    spans = scanned(docs, key, text).select(
        F.col("key").alias("_k"), F.col("content").alias("_c"), F.col("spans").alias("_spans")).where(
        F.size("_spans") > 0).dropDuplicates(["_k", "_c"])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s: Column, span: Column) -> Column:
        gap = F.substring(F.col(text), (s["at"] + 1).cast("int"), F.greatest(span["start"] - s["at"], F.lit(0)).cast("int"))
        touching = (span["start"] < s["at"]) & (s["at"] > 0)
        return F.struct(F.greatest(s["at"], span["stop"]).alias("at"),
                        F.when(touching, s["out"]).otherwise(F.concat(s["out"], gap, F.lit(mark))).alias("out"))

    replaced = F.aggregate("_spans", start, step, lambda s: F.concat(s["out"], F.substring(
        F.col(text), (s["at"] + 1).cast("int"), F.char_length(text))))
    match = F.col(key).eqNullSafe(F.col("_k")) & (F.xxhash64(text_of(text)) == F.col("_c"))
    return docs.join(spans, match, "left").select(*(
        F.coalesce(replaced, F.col(text)).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
