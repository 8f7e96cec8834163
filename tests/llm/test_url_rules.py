"""URL rules: the index against trying every rule on every URL, and the patterns' own syntax."""

import re

import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from parcelscope.llm import queries, url_rules

URLS = [None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.NET/EN/", "https://a.example.net/en/1", "https://example.net/en",
        "https://example.net", "https://example.net?x=/en/", "https://net/", "https://xnet/", "https://x.NET/a#b", "ftp://b.org/fr/ü",
        "https://org/fr/", "http://a://b.net/c", "https://a.example.com/de/5?ad=1", "https://adult-x.example.com/it/1",
        "https://x.adult-y.example.com/", "https://notadult-x.example.com/", "https://ads.example.com/LOGIN", "https://e.com/login/now",
        "https://e.com/loginpage", "https://e.com/login", "https://e.com/a?sessionid=3", "https://e.com/print/1.html",
        "https://e.com/print/1.html?x", "https://docs.e.com/login", "https://e.com/wp-login.php\n", "https://e.com/search?a=1&q=2",
        "https://" + "sub." * 3000 + "example.net/en/" + "x/" * 3000, "https://e.com/\nadserver/"]


def plain(url, rules):
    """Every rule tried on the URL."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    subject = host + rest[len(host):]
    folded = "".join(c.lower() if c.isascii() else c for c in subject)
    fit = [r for r in rules if re.search(r.regex.replace(r"\z", r"\Z"), subject if r.site else folded)]
    best = min(fit, key=lambda r: (not r.site, -r.weight, r.text, r.allow), default=None)
    return (url, host, path, best.text if best and best.site else None, best.text if best and not best.site else None,
            "allow" if best is None or best.allow else "block")


def rules():
    return [url_rules.site_rule(t, allow) for t, allow in queries.SITES] + [url_rules.pattern_rule(t) for t in url_rules.PATTERNS]


@pytest.mark.parametrize("in_row", [0, 1000])
def test_both_ways_equal_all_rules_on_all_urls(spark, in_row):
    more = [url_rules.pattern_rule(t) for t in ("casino", "*ad=", "|ftp", "|b.org/", "/EN|", "@@||a.example.com^", "^", "*")]
    more += [url_rules.site_rule("Example.COM/de/5", True), url_rules.site_rule("e.com/", True), url_rules.site_rule("org/fr/", False)]
    for listed in (rules(), rules()[:12] + more, []):
        pages = spark.createDataFrame([(i // 2, u, "x", "y") for i, u in enumerate(URLS * 2)],
                                      "page_id long, url string, host string, _best string")
        got = sorted((tuple(r) for r in url_rules.judged(pages, listed, in_row=in_row).select(
            "url", "host", "path", "rule", "pattern", "verdict").collect()), key=repr)
        assert got == sorted((plain(u, listed) for u in URLS * 2), key=repr)


@pytest.mark.parametrize("in_row", [0, 1000])
def test_empty_table_and_null_keys(spark, in_row):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judged(empty, rules(), in_row=in_row).collect() == []
    one = url_rules.judged(spark.createDataFrame([(None, None)], "page_id long, url string"), rules(), in_row=in_row).collect()
    assert [tuple(r) for r in one] == [(None, None, "", "", None, None, "allow")]


@pytest.mark.parametrize("text, yes, no", [
    ("||ads.", ["ads.x/", "a.ads.x"], ["bads.x", "x/ads."]), ("/cart^", ["x/cart", "x/cart/", "x/cart?a"], ["x/cart-2", "x/carts"]),
    ("|http", ["httpx.com"], ["xhttp"]), (".gif|", ["a/b.gif"], ["a/b.gif?"]), ("a*b", ["xaxxbx", "ab"], ["ba"]),
    ("A+(b)[1]", ["xa+(b)[1]"], ["aab1"])])
def test_pattern_syntax(text, yes, no):
    regex = url_rules.pattern_rule(text).regex.replace(r"\z", r"\Z")
    assert all(re.search(regex, u) for u in yes) and not any(re.search(regex, u) for u in no)


def test_tokens_are_whole_words_of_every_match():
    tokens = lambda t: url_rules.pattern_rule(t).tokens
    assert tokens("||adult-") == ("adult",) and tokens("casino") == () and tokens("/ads*/x/") == ("x",)
    assert tokens("/print/*.html|") == ("print", "html") and tokens("^sid=") == ("sid",) and tokens("a/b") == ()
    assert url_rules.site_rule("my-shop.net/en/sal", True).tokens == ("my", "shop", "net", "en")
    with pytest.raises(ValueError):
        url_rules.site_rule("net", False)


def test_each_rule_is_under_its_rarest_token(spark):
    rows = url_rules.parsed(spark.createDataFrame([("h://a.b/",), ("h://b/",), ("h://b/c",)], "url string"), "url")
    index = {rule.text: token for token, _, rule in url_rules.indexed(
        rows, [url_rules.site_rule("a.b/", True), url_rules.site_rule("b/", True), url_rules.pattern_rule("x")])}
    assert index == {"a.b/": "a", "b/": "b", "x": ""}


def test_plan_moves_no_rows_and_runs_no_python(spark, sf):
    text = url_rules.judged(spark.read.parquet(f"{sf}/pages.parquet"), rules())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text and "html:string" not in text


def test_query_equals_sql(spark, sf):
    assert compare(spark, connect(sf), queries.op12_url_filter, queries.ORACLE["op12_url_filter"], sf) == ""
