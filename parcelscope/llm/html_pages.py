"""Labelled pages that the page model is trained on: skeletons of common layouts filled with invented words.

data-main marks an element whose text is the article, data-not one inside it that is not. In a skeleton
$s stands for a few words, $m for a sentence, $l for a paragraph, $c for a long one, $a for a link and
$k for a list of links.
"""

from __future__ import annotations

import random
import re

SKELETONS = (
    """<html><head><title>$s</title></head><body><header><a href="/">$s</a><nav><ul>$k</ul></nav></header>
    <main><article data-main><h1>$s</h1><p>$l</p><p>$c</p><h2>$s</h2><p>$l</p><blockquote><p>$m</p></blockquote></article></main>
    <aside><h3>$s</h3><ul>$k</ul><p>$m</p></aside><footer><p>&copy; $s</p><ul>$k</ul></footer></body></html>""",
    """<body><nav><ul>$k</ul></nav><div class="ad">$m</div><article data-main><h1>$s</h1><p><b>$l<br><p>$c</p><p>$l</p><p>$m</p>
    </article><footer>&copy; $s &middot; $m</footer></body>""",
    """<body><div id="header"><h1>$s</h1><div class="menu">$a | $a | $a</div></div><div id="content"><div class="post" data-main>
    <h2>$s</h2><p>$l</p><p>$m</p><ul><li>$m</li><li>$l</li><li>$m</li></ul><p>$c</p><div class="share" data-not>$a $a</div></div>
    <div id="comments"><h3>$s</h3><ol><li class="comment"><p>$a</p><p>$l</p></li><li class="comment"><p>$m</p></li></ol>
    <form>$s<p>$m</p></form></div></div><div id="sidebar"><h3>$s</h3><ul>$k</ul><p>$l</p></div><div id="footer">$s $a $m</div></body>""",
    """<body><div class="cookie-notice"><p>$m $m</p><a href="#">$s</a></div><div class="topbar">$a $a $a</div><section class="entry" data-main>
    <h1>$s</h1><p>$l</p><h3>$s</h3><p>$c</p><pre>$m</pre><aside data-not><p>$m</p><ul>$k</ul></aside><p>$l</p><table><tr><td>$s</td>
    <td>$s</td></tr><tr><td>$s</td><td>$m</td></tr></table></section><section class="related"><h2>$s</h2><ul>$k</ul></section>
    <section class="comments"><h2>$s</h2><div><p>$l</p></div><div><p>$m</p></div></section><footer><p>$m</p></footer></body>""",
    """<body><table><tr><td class="nav">$a<br>$a<br>$a</td><td data-main><h2>$s</h2><p>$l<p>$c<p>$m<p>$l</td><td class="promo">$m $a</td></tr>
    </table><center>$a | $a | $s</center></body>""",
    """<body><header><h2>$s</h2><form><label>$s</label></form></header><div class="breadcrumbs">$a &gt; $a &gt; $s</div><main>
    <div class="alert notice"><p>$m</p></div><div class="article-body" data-main><h1>$s</h1><h2>$s</h2><p>$c</p><p>$m</p><figure>
    <figcaption>$m</figcaption></figure><p>$l</p><dl><dt>$s</dt><dd>$m</dd></dl></div><div class="newsletter"><p>$m</p><form>$s</form></div>
    <div class="comments"><p>$l</p><p>$l</p><p>$m</p></div></main><aside><p>$l</p></aside><footer><div>$a $a $a</div><p>$s</p></footer></body>""",
    """<body><ul class="menu">$k</ul><div class="banner">$s</div><article data-main><h1>$s</h1><p>$m</p></article>
    <div class="sponsored"><p>$l</p></div><footer>$m</footer></body>""",
    """<body><div><div>$a $a $a $a</div><div data-main><h1>$s</h1><p>$l</p><p>$c</p><p>$l</p></div><div><ul>$k</ul></div><div>$s $a</div></div></body>""",
    """<body><nav><p>$a $a</p></nav><article data-main><h1>$s</h1><div class="ads" data-not>$m</div><p>$l</p><nav data-not><ol>$k</ol></nav><p>$m</p>
    <ol><li>$m</li><li>$m</li></ol><section><h2>$s</h2><p>$c</p></section><section class="comments" data-not><h2>$s</h2><p>$l</p><p>$m</p>
    <article data-not><p>$l</p></article></section><footer data-not><p>$s</p></footer></article><aside class="sidebar"><p>$l</p><p>$m</p></aside>
    <footer><p>$l</p></footer></body>""",
    """<body><header><p>$m</p></header><form><p>$m</p><p>$s</p></form><nav><ul>$k</ul></nav><div class="popup">$m</div><footer>$s</footer></body>""",
    """<body><nav><ul>$k</ul></nav><div class="ad">$m</div><article data-main><h1>$s</h1><p><b>$s<br></article><footer>$m</footer></body>""",
    """<body><nav><ul>$k</ul></nav><div class="ad">$l</div><article data-main><h1>$l</h1><p><b>$c<br><p>$c</p><p>$s</p></article><footer>$l</footer>""",
)
SYLLABLES = "an be con de en for gra hi in ja ko lu mer no or pa que ri so ta un ve wi yo é ñu ß ä".split()


def _words(draw: random.Random, least: int, most: int) -> str:
    return " ".join("".join(draw.choices(SYLLABLES, k=draw.randint(1, 4))) for _ in range(draw.randint(least, most)))


def _sentences(draw: random.Random, least: int, most: int) -> str:
    return " ".join(f"{_words(draw, 4, 9).capitalize()}, {_words(draw, 3, 9)}." for _ in range(draw.randint(least, most)))


def labelled(copies: int = 12, seed: int = 7) -> list[str]:
    """`copies` pages of each skeleton."""
    draw = random.Random(seed)

    def link() -> str:
        return f'<a href="/{draw.randint(1, 999)}">{_words(draw, 1, 3)}</a>'

    fill = {
        "s": lambda: _words(draw, 1, 6), "m": lambda: _sentences(draw, 1, 2), "l": lambda: _sentences(draw, 3, 8),
        "c": lambda: _sentences(draw, 8, 30), "a": link,
        "k": lambda: "".join(f"<li>{link()}</li>" for _ in range(draw.randint(2, 8))),
    }
    return [re.sub(r"\$([smlcak])", lambda m: fill[m[1]](), skeleton) for _ in range(copies) for skeleton in SKELETONS]
