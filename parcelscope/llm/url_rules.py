"""URL rules: each pattern is indexed by its rarest token, and a URL runs only the patterns its tokens fetch."""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of tokens; all others, and the ends of a URL, are their bounds.
TOKEN = r"[a-z0-9]+"
#: Rules up to this number are looked up inside the row, in an index that goes with the plan (some 200 bytes each);
#: longer lists are joined by token.
IN_ROW = 5_000
#: The in-row index has a slot for each value of a token's hash below this.
SLOTS = 1024

#: The start of a host, or of a label in it.
LABEL = r"^([^/?#]*\.)?"
ENTRY = "rank: int, regex: string, site: boolean, allow: boolean, text: string"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Production patterns, most specific first within a topic. `||` is the start of a host or of a label in it, `|` an end
# of the URL, `*` any text, `^` a character that is not a letter, digit, `_`, `-`, `.` or `%`, or the end; `@@` allows.
PATTERNS = (
    "||adult-", "||adult.", "||porn-", "||porn.", "||xxx.", "||xxx-", "||casino-", "||casino.", "||poker-", "||betting-",
    "||ads.", "||ad.", "||adserver.", "||tracker.", "||tracking.", "||doubleclick.",
    "/adserver/", "/banner-ads/", "/popunder/", "/affiliate^", "/wp-login.", "/wp-admin/", "/cgi-bin/",
    "/login^", "/signup^", "/checkout^", "/cart^", "/share^*url=", "/search^*q=", "/calendar/*/day/",
    "^sessionid=", "^phpsessid=", "^jsessionid=", "^replytocom=", "/print/*.html|",
    "@@||docs.", "@@||wiki.", "@@/license^",
)


@dataclass(frozen=True)
class Rule:
    """A regular expression on host, path and the rest of a URL, the tokens that a match must hold, and what follows.

    Of the rules that fit, site rules go before patterns; then the greatest weight decides.
    """

    text: str
    regex: str
    tokens: tuple[str, ...]
    allow: bool
    site: bool
    weight: int


def site_rule(text: str, allow: bool) -> Rule:
    """`example.net/en/`: the host, its subdomains, and paths that start so. Longer rules weigh more."""
    host, slash, path = text.partition("/")
    if not host or not slash or re.search(r"[?#]|://", text):
        raise ValueError(f"not a host and a path: {text!r}")
    host = _folded(host)
    # The path may go on, so its last token counts only if the rule itself ends it.
    closed = re.findall(TOKEN + r"(?=[^a-z0-9])", _folded(f"{host}/{path}"))
    return Rule(text, rf"{LABEL}{_quoted(host)}/{_quoted(path)}", tuple(dict.fromkeys(closed)), allow, True, len(text))


def pattern_rule(text: str) -> Rule:
    """A pattern as in PATTERNS; capitals do not matter. One that allows goes before one that blocks."""
    allow = text.startswith("@@")
    body = _folded(text.removeprefix("@@"))
    start, inner = "", body
    if body.startswith("||"):
        start, inner = LABEL, body[2:]
    elif body.startswith("|"):
        start, inner = "^", body[1:]
    closed = inner.endswith("|")
    inner = inner.removesuffix("|")
    parts = [{"*": ".*", "^": r"([^a-z0-9_.%-]|\z)"}.get(part) or _quoted(part) for part in re.findall(r"\*|\^|[^*^]+", inner)]
    # A token counts only with a bound on both sides: "*" and an open end may hide more of the word.
    marked = ("|" if start else "") + inner + ("|" if closed else "")
    tokens = re.findall(rf"(?<=[^a-z0-9*]){TOKEN}(?=[^a-z0-9*])", marked)
    return Rule(text, "(?s)" + start + "".join(parts) + (r"\z" if closed else ""), tuple(dict.fromkeys(tokens)), allow,
                False, int(allow))


def _folded(text: str) -> str:
    return text.translate(str.maketrans(_UPPER, _LOWER))


def _quoted(literal: str) -> str:
    return re.sub(r"([^\w/])", r"\\\1", literal)


def ranked(rules: Sequence[Rule]) -> list[Rule]:
    """The rules by precedence: site rules first, then by weight; ties by their text, and what blocks before what allows."""
    return sorted(set(rules), key=lambda r: (not r.site, -r.weight, r.text, r.allow))


def parsed(urls: DataFrame, url: str) -> DataFrame:
    """The distinct columns _url, _host (lower case), _path, _subject (the URL from its host on) and _folded (in lower case).

    Null, and a URL without `://`, have empty parts.
    """
    rest = F.coalesce(F.when(F.instr(F.col(url), "://") > 0, F.substr(F.col(url), F.instr(F.col(url), "://") + 3)), F.lit(""))
    split = urls.withColumn("_rest", rest).withColumns({
        "_host": F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), _UPPER, _LOWER),
        "_path": F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)})
    after = F.substr(F.col("_rest"), F.char_length("_host") + 1)
    return split.withColumn("_subject", F.concat("_host", after)).withColumn(
        "_folded", F.translate("_subject", _UPPER, _LOWER)).drop("_rest")


def tokens_of(folded: str = "_folded") -> Column:
    """The distinct tokens of a URL, and the empty one, under which rules without a token are kept."""
    return F.array_distinct(F.concat(F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0)), F.array(F.lit(""))))


def indexed(rows: DataFrame, rules: Sequence[Rule]) -> list[tuple[str, int, Rule]]:
    """(token, rank, rule) with the token of each rule that fewest URLs of the table hold; ties go to the longer, then the smaller.

    What comes to the driver is one count per token of the rules.
    """
    wanted = sorted({t for rule in rules for t in rule.tokens})
    tokens = rows.select(F.explode(tokens_of()).alias("token"))
    if len(wanted) <= IN_ROW:
        tokens = tokens.where(F.col("token").isin(wanted))
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    if len(wanted) > IN_ROW:
        counted = counted.join(rows.sparkSession.createDataFrame([(t,) for t in wanted], "token string"), "token")
    counts = {r.token: r.n for r in counted.collect()} if wanted else {}
    return [(min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=""), rank, rule)
            for rank, rule in enumerate(ranked(rules))]


def _fits(regex: Column, site: Column) -> Column:
    return F.rlike(F.when(site, F.col("_subject")).otherwise(F.col("_folded")), regex)


def _in_row(rows: DataFrame, index: list[tuple[str, int, Rule]]) -> DataFrame:
    """Adds _best, looked up in an array of slots: no row moves."""
    slots = defaultdict(list)
    for token, rank, rule in index:
        slots[zlib.crc32(token.encode()) % SLOTS].append(
            {"token": token, "rank": rank, "regex": rule.regex, "site": rule.site, "allow": rule.allow, "text": rule.text})
    table = F.from_json(F.lit(json.dumps([slots[i] for i in range(SLOTS)])), f"array<array<struct<token: string, {ENTRY}>>>")
    slot = lambda t: F.get(table, (F.crc32(F.encode(t, "UTF-8")) % SLOTS).cast("int"))
    fetched = F.flatten(F.transform(tokens_of(), lambda t: F.filter(slot(t), lambda r: r["token"] == t)))
    fitting = F.filter(fetched, lambda r: _fits(r["regex"], r["site"]))
    return rows.withColumn("_best", F.array_min(F.transform(fitting, lambda r: F.struct(
        r["rank"].alias("rank"), r["site"].alias("site"), r["allow"].alias("allow"), r["text"].alias("text")))))


def _joined(rows: DataFrame, index: list[tuple[str, int, Rule]]) -> DataFrame:
    """Adds _best by joining distinct URLs and rules on the token, for lists of any length."""
    spark = rows.sparkSession
    listed = spark.createDataFrame([(t, rank, r.regex, r.site, r.allow, r.text) for t, rank, r in index],
                                   "token string, " + ENTRY.replace(":", ""))
    urls = rows.select("_subject", "_folded").distinct().withColumn("token", F.explode(tokens_of()))
    best = urls.join(listed, "token").where(_fits(F.col("regex"), F.col("site"))).groupBy("_subject").agg(
        F.min(F.struct("rank", "site", "allow", "text")).alias("_best")).withColumnRenamed("_subject", "_of")
    return rows.join(best, F.col("_subject") == F.col("_of"), "left").drop("_of")


def judged(urls: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", in_row: int = IN_ROW) -> DataFrame:
    """One row per input row: key, url, host, path, rule, pattern, verdict.

    `rule` is the site rule that decides, `pattern` the pattern that decides where no site rule fits; both are
    null where nothing fits, and the verdict is then `allow`. A null URL, and one without `://`, has an empty
    host and path and is judged like an empty text. Null keys and repeated rows are kept as they are, other
    columns are not read, and an empty table or an empty list of rules is in order.
    """
    rows = parsed(urls.select(F.col(key).alias("key"), F.col(url).alias("url")), "url")
    index = indexed(rows, rules)
    found = (_in_row if len(index) <= in_row else _joined)(rows, index)
    return found.select(
        "key", "url", F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.when(F.col("_best.site"), F.col("_best.text")).alias("rule"),
        F.when(~F.col("_best.site"), F.col("_best.text")).alias("pattern"),
        F.when(F.coalesce("_best.allow", F.lit(True)), "allow").otherwise("block").alias("verdict"))
