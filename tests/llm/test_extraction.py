from __future__ import annotations

import itertools
import random
import time

import pytest

from filelens.llm import extraction
from filelens.llm.extraction import main_text

LONG = "The committee met on Tuesday and, after a long debate, agreed to publish the figures of the last three years in full."
SHORT = "It passed."


@pytest.mark.parametrize("seed", range(60))
def test_the_cut_is_the_cheapest_labelling(seed):
    draw = random.Random(seed)
    size = draw.randint(1, 9)
    prices = [draw.choice([-300, -90, -40, 0, 30, 80, 250]) for _ in range(size)]
    edges = [(a, b, draw.choice([10, 50, 150])) for a, b in itertools.combinations(range(size), 2) if draw.random() < 0.5]

    def cost(kept):
        own = sum(-p if k and p < 0 else p if not k and p > 0 else 0 for p, k in zip(prices, kept, strict=True))
        return own + sum(w for a, b, w in edges if kept[a] != kept[b])

    every = list(itertools.product([False, True], repeat=size))
    least = min(map(cost, every))
    best = max((k for k in every if cost(k) == least), key=sum)
    assert extraction.cheapest(prices, edges) == list(best)


def page(article: str, before: str = "", after: str = "", wrap: str = "article") -> str:
    name = wrap.split()[0]
    return (
        '<!DOCTYPE html><html class="with-sidebar"><head><title>Title</title><meta name="a" content="b"><style>p{}</style></head>'
        '<body class="page ad-free"><header><a href="/">Site</a><p>News since 1901, every day for everyone who reads.</p></header>'
        '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">World and politics today</a></li></ul></nav>'
        f"{before}<{wrap}>{article}</{name}>{after}"
        f"<footer><p>{LONG} &copy; 2024 Example. All rights reserved.</p></footer></body></html>"
    )


BODY = f"<h1>Figures out</h1><p>{LONG}</p><p>{SHORT}</p><p>{LONG}</p>"
TEXT = f"Figures out {LONG} {SHORT} {LONG}"


@pytest.mark.parametrize(
    "around",
    [
        f'<div class="ad">{LONG}</div>',
        f"<aside><h2>More</h2><p>{LONG}</p></aside>",
        f'<div id="sidebar"><p>{LONG} {LONG}</p></div>',
        '<div class="cookie-notice"><p>We use cookies.</p><button>Accept</button></div>',
        f'<section id="comments"><h2>2 comments</h2><article><p>{LONG}</p></article><div class="comment"><p>{LONG}</p></div></section>',
        '<form action="/s"><label>Search this site for anything.</label><input name="q"><select><option>All</option></select></form>',
        '<script>var t = "<p>no</p>"; if (a < b) { }</script><noscript><p>Enable scripts.</p></noscript>',
        '<!-- a <p>comment</p> --><div hidden><p>Never shown to anybody who reads this.</p></div>',
        '<div class="related-posts"><ul><li><a href="/x">Another story that you may like</a></li></ul></div>',
    ],
)
def test_what_stands_around_goes(around):
    assert main_text(page(BODY, before=around)) == TEXT
    assert main_text(page(BODY, after=around)) == TEXT
    middle = BODY.replace(f"<p>{SHORT}</p>", f"<p>{SHORT}</p>{around}")
    assert main_text(page(middle)) == TEXT


@pytest.mark.parametrize("wrap", ["article", "main", 'div role="main"', 'div class="post-content"', "div"])
def test_articles_under_any_element(wrap):
    """Without an element that tells, the blocks' own prices and neighbours decide."""
    assert main_text(page(BODY, wrap=wrap)) == TEXT


def test_white_space_references_and_lines():
    body = "<h1>A&nbsp;&amp;amp; B</h1><p>caf&eacute; &#8211;\n\t x<b>y</b>z<br>new&#x20;line&hellip;<p>1 &lt; 2 &unknown; &copy 3<ul><li>one<li>two</ul>"
    assert main_text(page(body)) == "A &amp; B café – xyz new line… 1 < 2 &unknown; © 3 one two"


def test_broken_markup():
    assert main_text(f"<article><p>{LONG}<p><b>{SHORT}<p>{LONG} a < b <3 & c</div></span></article><p>x</p") == f"{LONG} {SHORT} {LONG} a < b <3 & c"
    assert main_text(f"<article><p>{LONG}</p><a href='cut off") == LONG
    assert main_text(f'<article><p title="5 > 4" class=x>{LONG}</p><script>never ended <p>{LONG}</p>') == LONG
    assert main_text("<table><tr><td>a<td>b<tr><td>c</table>") in ("", "a b c")
    assert main_text(None) == main_text("") == main_text("<p> \n </p>") == main_text("<!-- never ended") == ""


def test_long_and_deep_pages_take_linear_time():
    began = time.time()
    many = "".join(f"<p>{LONG}</p>" if i % 3 else f"<div class=ad><a href=x>{SHORT}</a></div>" for i in range(20_000))
    assert main_text(f"<body>{many}</body>").count(LONG) == 13_333
    assert main_text("<div>" * 50_000 + LONG) == LONG
    assert main_text("</div>" * 50_000 + "<p title='" * 3000 + LONG) == ""
    assert time.time() - began < 60


def test_odd_rows(spark):
    shape = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, None, None, "t", 1), (2, "u", "", None, 2), (None, "v", f"<p>{LONG}", "x", 3), (3, "u", page(BODY), "", 4), (3, "u", page(BODY), "", 4)]
    frame = extraction.extract(spark.createDataFrame(rows, shape))
    assert frame.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(
        [(1, None, "", 0), (2, "u", "", 0), (None, "v", LONG, len(LONG)), *[(3, "u", TEXT, len(TEXT))] * 2], key=str)
    assert extraction.extract(spark.createDataFrame([], shape)).count() == 0


def test_query_equals_its_sql(spark, given):
    from filelens.llm.queries import ORACLE, QUERIES
    from parity.check import _rows, connect
    from tests.llm.conftest import SF_DIR

    frame = QUERIES["op12_minimum_cut"](spark, SF_DIR)
    result = connect(SF_DIR).execute(ORACLE["op12_minimum_cut"])
    names = [d[0] for d in result.description]
    assert _rows(frame.columns, [tuple(r) for r in frame.collect()]) == _rows(names, result.fetchall())
