"""Chat formatting by typed content parts, in DataFrame functions only.

A conversation's turns hold ordered parts (text, image, audio, document). The visitor flattens each
part into text or a placeholder, records attachments with their expanded token counts, and the
template joins the turns. Inside texts the characters that could form control strings are escaped,
so the formatted conversation can always be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template. Neither "#" nor "<" survives the escape, so OPEN and CLOSE occur only as marks.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))

PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"

#: Token costs of attachments: one per image tile, per second of audio, per page of a document.
TILE, TILE_TOKENS, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 1, 25, 256


def escaped(column: Column, pairs=ESCAPES) -> Column:
    for plain, code in pairs:
        column = F.replace(column, F.lit(plain), F.lit(code))
    return column


def unescaped(column: Column, pairs=ESCAPES) -> Column:
    # Each backslash is followed by its code letter, so the backslash itself is restored last.
    for plain, code in reversed(pairs):
        column = F.replace(column, F.lit(code), F.lit(plain))
    return column


def _up(column: Column, unit: int) -> Column:
    return F.ceil(F.coalesce(column, F.lit(0)) / unit).cast("long")


def part_tokens(part: Column) -> Column:
    """Placeholder tokens that an attachment expands to: at least one; 0 for text."""
    image = _up(part["width"], TILE) * _up(part["height"], TILE) * TILE_TOKENS
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * TOKENS_PER_SECOND).cast("long")
    pages = F.coalesce(part["pages"], F.lit(0)).cast("long") * TOKENS_PER_PAGE
    return (F.when(part["kind"] == "text", F.lit(0).cast("long"))
            .when(part["kind"] == "image", F.greatest(image, F.lit(1)))
            .when(part["kind"] == "audio", F.greatest(audio, F.lit(1)))
            .otherwise(F.greatest(pages, F.lit(1))))


def _rendered(part: Column, number: Column) -> Column:
    placeholder = F.concat(F.lit("<|"), part["kind"], F.lit("_"), number.cast("string"), F.lit("|>"))
    return F.when(part["kind"] == "text", escaped(F.coalesce(part["text"], F.lit("")))).otherwise(placeholder)


def visited(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
            parts: str = "parts") -> DataFrame:
    """One row per turn: key, turn, role, body (flattened text), attachments (part, kind, uri, tokens).

    Parts keep their order; a null list counts as no part and an unknown or null kind as a document.
    Placeholders are numbered by the part's place in its turn, and stand in an unescaped "<|...|>",
    which no text can contain.
    """
    kind = lambda p: F.when(p["kind"].isin("text", "image", "audio"), p["kind"]).otherwise("document")
    known = F.transform(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")),
                        lambda p: p.withField("kind", kind(p)))
    found = turns.select(F.col(key).alias("key"), F.col(turn).alias("turn"),
                         F.coalesce(F.col(role), F.lit("")).alias("role"), known.alias("known"))
    numbered = F.transform("known", lambda p, i: F.struct(
        i.alias("part"), p["kind"].alias("kind"), p["uri"].alias("uri"), part_tokens(p).alias("tokens")))
    return found.select(
        "key", "turn", "role",
        F.array_join(F.transform("known", _rendered), "").alias("body"),
        F.filter(numbered, lambda a: a["kind"] != "text").alias("attachments"))


def text_parts(text: str = "text") -> Column:
    """A plain text column as a list with one text part; null is the empty text."""
    value = F.named_struct(
        F.lit("kind"), F.lit("text"), F.lit("text"), F.coalesce(F.col(text), F.lit("")),
        F.lit("uri"), F.lit(None).cast("string"), F.lit("width"), F.lit(None).cast("int"),
        F.lit("height"), F.lit(None).cast("int"), F.lit("seconds"), F.lit(None).cast("double"),
        F.lit("pages"), F.lit(None).cast("int"))
    return F.array(value)


def formatted(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
              parts: str = "parts", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: key, formatted, mask, attachments, expanded_tokens.

    mask lists the spans that training counts: the body of each turn by `trained_role`, as the turn's
    number in the output (from 0), and start and end of the span in code points from the turn's first.
    Turns go by their number, then role, then text; repeated rows are turns of their own; a null role
    is the empty role; a null key is one conversation. No rows give no conversations.
    """
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), ROLE_ESCAPES), F.lit(MIDDLE))
    rows = visited(turns, key, turn, role, parts).select(
        "key", F.struct("turn", "role", "body", "attachments", head.alias("head"),
                        F.char_length(head).cast("long").alias("n_head"),
                        F.char_length("body").cast("long").alias("n_body")).alias("t"))
    joined = rows.groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    pieces = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE)))
    spans = F.transform(F.col("turns"), lambda t, i: F.struct(
        i.alias("turn"), t["role"].alias("role"), t["n_head"].alias("n_head"), t["n_body"].alias("n_body")))
    mask = F.filter(F.col("spans"), lambda s: s["role"] == trained_role)
    attached = F.flatten(F.transform("turns", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(
        i.alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["uri"].alias("uri"),
        a["tokens"].alias("tokens")))))
    return joined.select(
        "key", F.array_join(pieces, "").alias("formatted"), spans.alias("spans"), attached.alias("attachments")).select(
        "key", "formatted",
        F.transform(mask, lambda s: F.struct(
            s["turn"].alias("turn"), s["n_head"].alias("start"), (s["n_head"] + s["n_body"]).alias("end"))).alias("mask"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"))


def read_back(conversations: DataFrame) -> DataFrame:
    """Adds what the formatted text itself says: turns (role, text) and trained, the texts under the mask."""
    pieces = F.filter(F.split("formatted", CLOSE, -1), lambda p: F.length(p) > 0)
    # "### role: text": the role holds no plain colon, so the first colon ends it.
    colon = lambda p: F.instr(p, MIDDLE)
    turn = lambda p: F.struct(
        unescaped(F.substring(p, F.lit(len(OPEN) + 1), colon(p) - len(OPEN) - 1), ROLE_ESCAPES).alias("role"),
        unescaped(F.substring(p, colon(p) + len(MIDDLE), F.char_length(p))).alias("text"))
    under = lambda m: unescaped(F.substring(
        F.element_at("pieces", (m["turn"] + 1).cast("int")),
        (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))
    return conversations.withColumn("pieces", pieces).select(
        "*", F.transform("pieces", turn).alias("turns"), F.transform("mask", under).alias("trained")).drop("pieces")
