"""Main text of web pages: a tree-structured graphical model over the DOM, solved by sum-product messages.

Nodes are block elements and the runs of text inside them. Every node is content or not: its own score
comes from tag, class words, text length, link share and punctuation; potentials between a child and
its parent let the decision spread through the tree. Messages go from the leaves to the root and back,
and the marginals of the text runs decide what belongs to the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

# Elements of the HTML standard, by their role here.
BLOCKS = ("html body main article section div header footer nav aside form ul ol li dl dt dd table thead tbody tfoot tr "
          "td th caption p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address hr details summary dialog fieldset "
          "legend menu center hgroup search").split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noscript xmp noembed noframes".split())
#: Inert content and form controls; whatever else holds text is judged by the model.
SKIPPED = frozenset("head template select datalist".split())
CLOSES_P = frozenset(BLOCKS) - frozenset("html body td th tr thead tbody tfoot caption li dt dd legend summary".split())
#: Start tags that end an open element of the same family, up to the elements that hold such a family.
FAMILIES = {"li": (frozenset(["li"]), frozenset("ul ol menu".split())),
            "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
            "tr": (frozenset("tr td th".split()), frozenset(["table"])),
            "td": (frozenset("td th".split()), frozenset("table tr".split())),
            "th": (frozenset("td th".split()), frozenset("table tr".split())),
            "tbody": (frozenset("tr td th tbody thead tfoot".split()), frozenset(["table"])),
            "tfoot": (frozenset("tr td th tbody thead tfoot".split()), frozenset(["table"]))}
TAGS = {name: i for i, name in enumerate(["#root", "#text", *BLOCKS])}

#: Words in class, id and role that say what an element is for.
HINTS = (
    ("comment comments reply replies discussion disqus respond", 1),
    ("nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip", 2),
    ("ad ads advert adverts advertisement advertising promo promoted sponsor sponsored banner", 3),
    ("sidebar side aside widget related recommended recommendations trending popular more complementary", 4),
    ("cookie cookies consent notice alert warning popup modal overlay newsletter subscribe signup login search form gdpr", 5),
    ("header masthead footer copyright legal share social sharing byline meta tags contentinfo toolbar", 6),
    ("article content post entry main story body text prose", 7),
)
HINT_OF = {word: kind for words, kind in HINTS for word in words.split()}

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|
    (/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>)""", re.S | re.X)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?|\Z", re.I) for name in RAW}
_NAMING = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none""", re.I)
_WORDS = re.compile(r"[a-z]+")
_POINTS = re.compile(r"[.,;:!?]")

LENGTHS = (1, 20, 50, 100, 200, 500, 1000, 4000)
SHARES = (0.02, 0.2, 0.5, 0.9)
POINTS = (0.001, 0.03, 0.08, 0.15)
#: Start of each feature group in the weight vector, and its size.
GROUPS = (len(TAGS), 8, len(LENGTHS) + 1, len(SHARES) + 1, len(POINTS) + 1, len(TAGS))
OFFSETS = np.concatenate(([0], np.cumsum(GROUPS)[:-1]))


@dataclass
class Page:
    """Nodes in page order, so that a parent comes before its children; text holds each run, None at elements."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[int] = field(default_factory=lambda: [0])
    hint: list[int] = field(default_factory=lambda: [0])
    marked: list[int] = field(default_factory=lambda: [0])
    text: list[str | None] = field(default_factory=lambda: [None])
    links: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])

    def add(self, parent: int, tag: int, hint: int, marked: int, text: str | None = None, links: int = 0) -> int:
        for values, value in zip((self.parent, self.tag, self.hint, self.marked, self.text, self.links),
                                 (parent, tag, hint, marked, text, links)):
            values.append(value)
        self.depth.append(self.depth[parent] + 1)
        return len(self.tag) - 1


def hint_of(attributes: str) -> int:
    """What class, id and role say; words that tell of something beside the article go before those that tell of it."""
    if _HIDDEN.search(attributes):
        return 5
    kinds = [HINT_OF[word] for groups in _NAMING.findall(attributes)
             for word in _WORDS.findall("".join(groups).lower()) if word in HINT_OF]
    return next((kind for kind in kinds if kind < 7), 7 if kinds else 0)


def parsed(source: str) -> Page:
    """Blocks and text runs of a page, however broken its markup is.

    An element that is left open ends with its parent; an end tag without its start is ignored. Scripts,
    styles, comments and other parts that a reader never sees as text leave no node.
    """
    page = Page()
    names, nodes = ["#root"], [0]              # open elements, and the block that each is or lies in
    opened: dict[str, int] = {}
    pieces: list[str] = []
    linked = skipping = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.add(nodes[-1], 1, 0, 0, text, min(linked, len(text)))
            pieces.clear()
        linked = 0

    def pop() -> None:
        nonlocal skipping
        name = names[-1]
        if name in TAGS:
            flush()
        names.pop()
        nodes.pop()
        opened[name] -= 1
        skipping -= name in SKIPPED

    def end(name: str) -> None:
        nonlocal skipping
        if not opened.get(name):
            return
        if name not in TAGS and name not in SKIPPED:
            # An inline element never closes the blocks that were opened in it.
            for place in range(len(names) - 1, 0, -1):
                if names[place] == name:
                    del names[place], nodes[place]
                    opened[name] -= 1
                    return
        while names[-1] != name:
            pop()
        pop()

    def end_within(targets: frozenset, holders: frozenset) -> None:
        for place in range(len(names) - 1, 0, -1):
            if names[place] in holders:
                return
            if names[place] in targets:
                while len(names) > place:
                    pop()

    while True:
        found = _TAG.search(source, at)
        text = source[at:found.start() if found else len(source)]
        if text and not skipping:
            decoded = html.unescape(text) if "&" in text else text
            pieces.append(decoded)
            if opened.get("a"):
                linked += len(decoded.strip())
        if not found:
            break
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        if found[1] or found[4]:
            if name == "p":
                flush()
            if name == "br":
                pieces.append(" ")
            end(name)
            continue
        if name in RAW:
            at = _RAW_END[name].search(source, at).end()
            continue
        if name == "br" or name == "wbr":
            pieces.append(" " * (name == "br"))
            continue
        if name == "body":
            end("head")
        is_block = name in TAGS
        if is_block:
            flush()
            if opened.get("p") and name in CLOSES_P:
                end("p")
            if name in FAMILIES and any(opened.get(t) for t in FAMILIES[name][0]):
                end_within(*FAMILIES[name])
        if name in VOID:
            continue
        attributes = found[3] or found[6] or ""
        node = nodes[-1]
        if is_block and not skipping:
            marked = 1 if "data-main" in attributes else 2 if "data-not" in attributes else 0
            node = page.add(node, TAGS[name], hint_of(attributes) if attributes else 0, marked)
        names.append(name)
        nodes.append(node)
        opened[name] = opened.get(name, 0) + 1
        skipping += name in SKIPPED
    flush()
    return page


class Forest:
    """Trees of many pages side by side: features, and the levels along which messages go."""

    def __init__(self, pages: list[Page]) -> None:
        sizes = np.array([len(p.tag) for p in pages])
        starts = np.cumsum(sizes) - sizes
        self.page = np.repeat(np.arange(len(pages)), sizes)
        local = np.concatenate([np.array(p.parent) for p in pages])
        self.parent = np.where(local < 0, -1, local + np.repeat(starts, sizes))
        self.tag = np.concatenate([np.array(p.tag) for p in pages])
        self.text = [t for p in pages for t in p.text]
        hint = np.concatenate([np.array(p.hint) for p in pages])
        totals = np.zeros((3, len(self.tag)))
        totals[0] = [len(t) if t else 0 for t in self.text]
        totals[1] = np.concatenate([np.array(p.links) for p in pages])
        totals[2] = [len(_POINTS.findall(t)) if t else 0 for t in self.text]
        depth = np.concatenate([np.array(p.depth) for p in pages])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 1)))
        for level in self.levels[:0:-1]:
            for row in totals:
                row += np.bincount(self.parent[level], row[level], len(row))
        share = totals[1] / np.maximum(totals[0], 1)
        points = totals[2] / np.maximum(totals[0], 1)
        self.chars = totals[0]
        self.index = OFFSETS + np.stack([
            self.tag, hint, np.searchsorted(LENGTHS, totals[0], side="right"), np.searchsorted(SHARES, share, side="right"),
            np.searchsorted(POINTS, points, side="right"),
            np.where(self.parent < 0, 0, self.tag[self.parent])], axis=1)

    def marginals(self, weights: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(node is content), and P(labels of parent and node) as (nodes, 2, 2), zero at roots.

        `pairs` holds log potentials by the child's tag, parent's label and child's label.
        """
        n = len(self.tag)
        belief = np.zeros((n, 2))
        belief[:, 1] = weights[self.index].sum(axis=1)
        up = np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            sent = np.logaddexp.reduce(pairs[self.tag[level]] + belief[level][:, None, :], axis=2)
            up[level] = sent - sent.max(axis=1, keepdims=True)
            for y in (0, 1):
                belief[:, y] += np.bincount(self.parent[level], up[level, y], n)
        joint = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            parent = self.parent[level]
            without = belief[parent] - up[level]
            both = without[:, :, None] + pairs[self.tag[level]] + belief[level][:, None, :]
            both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
            joint[level] = both / both.sum(axis=(1, 2), keepdims=True)
            down = np.logaddexp.reduce(without[:, :, None] + pairs[self.tag[level]], axis=1)
            belief[level] += down - down.max(axis=1, keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


@dataclass
class Model:
    weights: np.ndarray
    pairs: np.ndarray

    def texts(self, sources: list[str]) -> list[str]:
        """Main text of each page: runs of text that are more likely content than not, with an empty line between."""
        if not sources:
            return []
        forest = Forest([parsed(s) for s in sources])
        content = forest.marginals(self.weights, self.pairs)[0] > 0.5
        out: list[list[str]] = [[] for _ in sources]
        for i in np.flatnonzero(content & (forest.tag == 1)):
            out[forest.page[i]].append(forest.text[i])
        return ["\n\n".join(blocks) for blocks in out]


def labels_of(pages: list[Page], forest: Forest, marked: bool) -> np.ndarray:
    """Label of every node of labelled pages.

    Pages of `marked` say so by data-main and data-not. Others are labelled by their landmarks: text in
    article or main, but not in navigation, sidebars, headers, footers, forms or what a class word
    names as such. An element takes the label of most of its text.
    """
    leaf = np.zeros(len(forest.tag))
    outside = {TAGS[t] for t in ("nav", "aside", "footer", "header", "form", "menu", "dialog", "search")}
    inside = {TAGS[t] for t in ("article", "main")}
    start = 0
    for page in pages:
        state = [0] * len(page.tag)
        for i in range(1, len(page.tag)):
            above = state[page.parent[i]]
            if marked:
                state[i] = {0: above, 1: 1, 2: 0}[page.marked[i]]
            elif above == 2 or page.tag[i] in outside or 1 <= page.hint[i] <= 6:
                state[i] = 2
            else:
                state[i] = 1 if page.tag[i] in inside else above
            leaf[start + i] = state[i] == 1 and page.text[i] is not None
        start += len(page.tag)
    held = forest.chars * leaf
    for level in forest.levels[:0:-1]:
        held += np.where(forest.tag == 1, 0, np.bincount(forest.parent[level], held[level], len(held)))
    return np.where(forest.tag == 1, leaf, held * 2 > np.maximum(forest.chars, 1)).astype(np.int64)


def fitted(groups: list[tuple[list[Page], bool]], steps: int = 200, shrink: float = 1e-4) -> Model:
    """Trains on labelled pages by gradient ascent (Adam) on the likelihood of all node labels; pages weigh the same."""
    pages = [p for group, _ in groups for p in group]
    forest = Forest(pages)
    labels = np.concatenate([labels_of(group, Forest(group), marked) for group, marked in groups if group])
    share = np.concatenate([np.full(len(p.tag), 1 / len(group) / len(p.tag)) for group, _ in groups for p in group])
    n, kinds = int(sum(GROUPS)), len(TAGS)
    weights, pairs = np.zeros(n), np.zeros((kinds, 2, 2))
    inner = np.flatnonzero(forest.parent >= 0)
    cell = (forest.tag[inner] * 2 + labels[forest.parent[inner]]) * 2 + labels[inner]
    known = np.bincount(cell, share[inner], kinds * 4)
    moment, square = np.zeros(n + kinds * 4), np.zeros(n + kinds * 4)
    for step in range(1, steps + 1):
        content, joint = forest.marginals(weights, pairs)
        change = (labels - content) * share
        slope = sum(np.bincount(forest.index[:, k], change, n) for k in range(len(GROUPS))) - shrink * weights
        expected = np.zeros((kinds, 4))
        for c in range(4):
            expected[:, c] = np.bincount(forest.tag[inner], joint[inner].reshape(-1, 4)[:, c] * share[inner], kinds)
        slope = np.concatenate((slope, known - expected.ravel() - shrink * pairs.ravel()))
        moment, square = 0.9 * moment + 0.1 * slope, 0.99 * square + 0.01 * slope ** 2
        move = 0.1 * (moment / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-6)
        weights, pairs = weights + move[:n], pairs + move[n:].reshape(kinds, 2, 2)
    return Model(weights, pairs)


#: Pages of the table that the model is trained on at most, and characters of one at most.
TRAINING_PAGES = 300
TRAINING_CHARS = 200_000


def trained(pages: DataFrame, key: str = "page_id", source: str = "html") -> Model:
    """The model learned from the built-in labelled pages and a bounded sample of `pages` with an article or main landmark.

    The sample holds TRAINING_PAGES pages, those of the smallest hash of their source; it is all that
    the driver gets.
    """
    from .html_pages import labelled

    short = F.length(source) <= TRAINING_CHARS
    usable = pages.where(short & F.lower(source).rlike("<(article|main)[\\s>]")).select(F.xxhash64(source).alias("h"))
    chosen = usable.distinct().orderBy("h").limit(TRAINING_PAGES)
    rows = pages.where(short).select(F.col(source).alias("html")).join(
        F.broadcast(chosen), F.xxhash64("html") == F.col("h"), "left_semi").distinct().collect()
    sample = [parsed(text) for text in sorted(r.html for r in rows)]
    return fitted([([parsed(text) for text in labelled()], True), (sample, False)])


def extracted(pages: DataFrame, model: Model, key: str = "page_id", source: str = "html",
              others: tuple[str, ...] = ("url",)) -> DataFrame:
    """key, `others` and text of each page; one row per input row.

    A null or empty source, and one without any content, has the empty text. Null keys and repeated rows
    are kept; no rows give no rows.
    """
    rows = pages.select(F.col(key).alias("key"), *others, text_of(source).alias("source"))
    kinds = dict(rows.dtypes)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for start in range(0, batch.num_rows, 500):     # bounds the nodes that are held at a time
                part = batch.slice(start, 500)
                found = pa.array(model.texts(part.column(last).to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(last)), found], ["key", *others, "text"])

    schema = ", ".join([f"key {kinds['key']}", *(f"`{o}` {kinds[o]}" for o in others), "text string"])
    return rows.mapInArrow(texts, schema)
