import html
import itertools
import re

import numpy as np
import pytest

from parcelscope.llm import html_pages, html_tree, queries


@pytest.fixture(scope="module")
def model(spark):
    return html_tree.trained(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def by_landmark(source):
    """Text between the article tags by its paragraph and heading tags, for pages of the test tables' one layout."""
    body = source[source.index("<article>") + 9:source.index("</article>")]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(b for b in blocks if b)


def test_messages_against_enumeration():
    page = html_tree.parsed("<div><p>a<b>x</b></p><ul><li>b</li><li>c</li></ul></div><p>d</p>")
    forest = html_tree.Forest([page, html_tree.parsed("t")])
    draw = np.random.default_rng(4)
    weights = draw.normal(size=sum(html_tree.GROUPS))
    pairs = draw.normal(size=(len(html_tree.TAGS), 2, 2))
    content, joint = forest.marginals(weights, pairs)
    n = len(forest.tag)
    own, z, want, both = weights[forest.index].sum(axis=1), 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for labels in itertools.product((0, 1), repeat=n):
        score = sum(own[i] * labels[i] for i in range(n))
        score += sum(pairs[forest.tag[i], labels[p], labels[i]] for i, p in enumerate(forest.parent) if p >= 0)
        w = np.exp(score)
        z, want = z + w, want + w * np.array(labels)
        for i, p in enumerate(forest.parent):
            if p >= 0:
                both[i, labels[p], labels[i]] += w
    assert np.allclose(content, want / z) and np.allclose(joint, both / z)


def test_parser_on_broken_markup():
    def blocks(source):
        return [t for t in html_tree.parsed(source).text if t]
    assert blocks("<p>a<b>b<p>c&amp;&nbsp;d<br>e</i></div>f") == ["ab", "c& d ef"]
    assert blocks("<script>var a='</p><p>no';</script>x<style>p{}</style><!-- <p>no</p> -->y<!-- open") == ["xy"]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>") == list("abcdefg")
    assert blocks("<head><title>no</title><meta x></head>a<svg><title>no</title></svg> < b <p title='>'>c</p>") == ["a < b", "c"]
    assert blocks("a <math><mi>x</mi></math> <object>y</object> <button>z</button><canvas>v</canvas><select><option>no</select>") == ["a x y zv"]
    assert blocks(f"<p title='{'a > b ' * 6000}' class=\"{'>' * 30_000}\">c</p>d") == ["c", "d"]
    assert blocks("<p title=\"x>y</p>z") == ["y", "z"] and blocks("") == [] and blocks("<b><p>a</b>c</p>") == ["ac"]
    assert len(blocks("<div>" * 30_000 + "deep")) == 1


def test_held_out_skeletons(model):
    sources = html_pages.labelled(copies=4, seed=1234)
    pages = [html_tree.parsed(s) for s in sources]
    forest = html_tree.Forest(pages)
    labels = html_tree.labels_of(pages, forest, True)
    content = forest.marginals(model.weights, model.pairs)[0] > 0.5
    leaf = forest.tag == 1
    assert (content[leaf] == labels[leaf]).mean() > 0.98


def test_query_on_whole_tables(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        sources = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
        rows = queries.op1_html_text(spark, folder).collect()
        assert len(rows) == len(sources)
        for r in rows:
            assert r.text == by_landmark(sources[r.page_id].html) and r.url == sources[r.page_id].url
            assert r.n_chars == len(r.text)


def test_blocks_are_joined_by_an_empty_line(model):
    page = ("<nav><a href='/'>Home</a></nav><article><h1>One, two and three</h1><p>First   paragraph, with <b>bold</b>\n words in it. "
            "It goes on.</p><p>Second paragraph; it says more, and says it at some length.</p></article>")
    assert model.texts([page]) == ["One, two and three\n\nFirst paragraph, with bold words in it. It goes on.\n\n"
                                   "Second paragraph; it says more, and says it at some length."]


def test_edge_cases(spark, model):
    long = "<article>" + "<p>" + "word word, word. " * 30_000 + "</p></article>"
    rows = [(1, "u", None, "c"), (None, None, "", "c"), (3, "u", "<nav><a>x</a></nav>", "c"), (4, "u", long, "c"), (4, "u", long, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_tree.extracted(pages, model).collect()
    assert sorted((r.key or 0, len(r.text)) for r in out) == [(0, 0), (1, 0), (3, 0)] + [(4, 30_000 * 17 - 1)] * 2
    assert html_tree.extracted(pages.limit(0), model).count() == 0
    assert html_tree.trained(pages.limit(0)).texts(["<article><h1>a b</h1><p>One two, three four five. Six.</p></article>"])[0]
