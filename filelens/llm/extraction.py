"""Main text of web pages by a minimum cut.

A page is read into blocks of text and the elements above them. A classifier prices both
labels of a block from the nearest telling element (article, navigation, advert,
comments, ...), the share of its letters in links, its length and its wording. The prices
are capacities to the two terminals of a flow network; edges between neighbours in the
page and between blocks under one element are the price of telling them apart, the closer
in the document tree the higher. The maximal flow gives the labelling of all blocks that
is cheapest as a whole: a one-word paragraph stays with its article, a long advert does
not. Where two labellings cost the same, text is kept.

Markup need not be well formed: elements left open end where an element above them ends
or where another may not stand inside them; what is cut off inside a tag is no text.

Rows: null and empty html give an empty text; repeated rows get a row each; pages of any
length are read whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from filelens.llm import text as tx

# Prices are in hundredths of a logarithm of odds.
SMOOTH = 150  # between neighbours under one element
INSIDE, MAYBE_INSIDE, MAYBE_OUTSIDE, OUTSIDE = 500, 200, -900, -1200

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMES = re.compile(r"[^a-z0-9]+")
_LEGAL = re.compile(
    r"©|copyright|all rights reserved|cookie|privacy policy|terms of (?:use|service)|newsletter|subscribe|sign up|log ?in\b", re.I
)

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_NO_TEXT = frozenset("head noscript template svg canvas object audio video select datalist button map".split())
_IN_HEAD = frozenset("meta link script style title base noscript template".split())
# Which elements end an open one of some kind, looked for up to a barrier.
_ENDS_P = _BLOCKS - frozenset("body html caption dd dt li legend summary tbody td tfoot th thead tr figcaption".split())
_P_BARRIER = frozenset("table td th caption object template button html".split())
_ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tr": (frozenset(["tr"]), frozenset("tbody thead tfoot table".split())),
    "tbody": (frozenset("tbody thead tfoot".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot".split()), frozenset(["table"])),
}

# What elements tell by their kind, role, or a part of their class or id.
_OUTSIDE_TAGS = frozenset("nav aside footer menu dialog".split())
_OUTSIDE_ROLES = frozenset(
    "navigation complementary banner contentinfo search dialog alert alertdialog menu menubar toolbar".split()
)
_TALK = frozenset("comment comments commentlist disqus respond replies reply".split())
_AROUND = frozenset(
    "ad ads advert adverts advertisement adsense banner promo promotion promoted sponsor sponsored sidebar widget widgets cookie "
    "cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup share sharing social related "
    "recommended recommendations trending teaser breadcrumb breadcrumbs pagination pager menu navbar nav navigation toolbar "
    "topbar footer login alert".split()
)
_ABOVE = frozenset("header masthead".split())
_WITHIN = frozenset("article post entry content story main articlebody".split())


class Element:
    """An open element: what it tells of the text below it, and the last blocks there."""

    __slots__ = ("tag", "bias", "silent", "inline", "direct", "below")

    def __init__(self, tag: str, bias: int, silent: bool, inline: bool = False):
        self.tag, self.bias, self.silent, self.inline = tag, bias, silent, inline
        self.direct = self.below = -1


@dataclass
class Page:
    """Blocks of text, the price of leaving each out (negative: of keeping it), and the
    price of telling two of them apart."""

    texts: list[str]
    prices: list[int]
    edges: list[tuple[int, int, int]]


def _attributes(told: str) -> dict[str, str]:
    found = {}
    for name, double, single, bare in _ATTRIBUTE.findall(told):
        found.setdefault(name.lower(), references.unescape(double or single or bare))
    return found


def names_of(told: str) -> set[str]:
    """The parts of classes and ids; what one says it has or lacks is not what it is."""
    found = set()
    for name in told.lower().split():
        for part in _NAMES.split(name):
            if part in ("with", "has", "no", "without"):
                break
            found.add(part)
    return found


def bias_of(tag: str, told: str, above: int) -> int:
    """What an element tells of its text, under an element that tells ``above``."""
    if above == OUTSIDE:
        return OUTSIDE
    held = _attributes(told) if told.strip(" /") else {}
    style = held.get("style", "").replace(" ", "").lower()
    if "hidden" in held or "display:none" in style or held.get("aria-hidden") == "true":
        return OUTSIDE
    role = held.get("role", "").lower()
    names = set() if tag in ("html", "body") else names_of(f"{held.get('class', '')} {held.get('id', '')}")
    if tag in _OUTSIDE_TAGS or role in _OUTSIDE_ROLES or names & _TALK:
        return OUTSIDE
    if names & _AROUND:
        return MAYBE_OUTSIDE
    if tag in ("article", "main") or role in ("article", "main") or held.get("itemprop", "").lower() == "articlebody":
        return INSIDE
    if tag == "form":
        return MAYBE_OUTSIDE
    if (tag == "header" or names & _ABOVE) and above < MAYBE_INSIDE:
        return MAYBE_OUTSIDE
    if above == 0 and names & _WITHIN:
        return MAYBE_INSIDE
    return above


def price(tag: str, text: str, linked: int, bias: int) -> int:
    """The price of leaving a block out."""
    words = text.count(" ") + 1
    told = min(max(90 * math.log2(words / 8), -200), 300) - 500 * linked / len(text)
    if tag in ("p", "pre", "blockquote"):
        told += 80
    elif tag[0] == "h" and tag[1:].isdigit():
        told += 130 if tag == "h1" else 50
    elif tag in ("li", "td", "th", "dt", "dd"):
        told -= 50
    if text[-1] in ".!?…":
        told += 50
    if words < 40 and _LEGAL.search(text):
        told -= 200
    return round(told) + bias


class Reader:
    """Reads one page into blocks."""

    def __init__(self, html: str):
        self.html = html
        self.page = Page([], [], [])
        self.stack = [Element("", 0, False)]
        self.open: Counter[str] = Counter()
        self.pieces: list[str] = []
        self.linked = 0  # letters of the block that stand in links
        self.link = 0  # depth at which the open link began
        self.lowest = self.last = 1  # depth of the last block, and the least since

    def read(self) -> Page:
        html, at = self.html, 0
        while (start := html.find("<", at)) >= 0:
            self.text(html[at:start])
            at = self.markup(start)
        self.text(html[at:])
        self.flush()
        return self.page

    def text(self, piece: str) -> None:
        if not piece or self.stack[-1].silent:
            return
        if "&" in piece:
            piece = references.unescape(piece)
        self.pieces.append(piece)
        if self.link:
            self.linked += len("".join(piece.split()))

    def flush(self) -> None:
        """End the block."""
        if not self.pieces:
            return
        text = " ".join("".join(self.pieces).split())
        self.pieces, linked, self.linked = [], self.linked, 0
        if not text:
            return
        page, top, depth = self.page, self.stack[-1], len(self.stack)
        at = len(page.texts)
        page.texts.append(text)
        page.prices.append(price(top.tag or "body", text, min(linked, len(text)), top.bias))
        if at:
            apart = self.last + depth - 2 * self.lowest
            page.edges.append((at - 1, at, 2 * SMOOTH // max(apart, 2)))
        parent = self.stack[-2] if depth > 1 else top
        for near in {top.direct, parent.below} - {-1, at - 1}:
            page.edges.append((near, at, SMOOTH))
        top.direct = parent.below = at
        self.last = self.lowest = depth

    def push(self, element: Element) -> None:
        self.stack.append(element)
        self.open[element.tag] += 1

    def pop(self, depth: int) -> None:
        """Leave all elements above ``depth``."""
        self.flush()
        while len(self.stack) > depth:
            self.open[self.stack.pop().tag] -= 1
        self.lowest = min(self.lowest, depth)
        if self.link > depth:
            self.link = 0

    def end_open(self, kinds: frozenset[str], barrier: frozenset[str]) -> None:
        """End the innermost element of some kinds, unless a barrier is further in."""
        if any(self.open[kind] for kind in kinds):
            for depth in range(len(self.stack) - 1, 0, -1):
                tag = self.stack[depth].tag
                if tag in kinds:
                    return self.pop(depth)
                if tag in barrier:
                    return None
        return None

    def markup(self, start: int) -> int:
        """Read what begins with '<'; the place after it."""
        html = self.html
        if html.startswith("<!--", start):
            end = html.find("-->", start + 2)
            return end + 3 if end >= 0 else len(html)
        following = html[start + 1 : start + 2]
        if following in ("!", "?") or (following == "/" and not html[start + 2 : start + 3].isalpha()):
            end = html.find(">", start)
            return end + 1 if end >= 0 else len(html)
        found = _TAG.match(html, start) or _LOOSE_TAG.match(html, start)
        if found is None:
            if following == "/" or (following.isascii() and following.isalpha()):
                return len(html)  # cut off inside a tag
            self.text("<")
            return start + 1
        closing, tag, told = found[1], found[2].lower(), found[3]
        if closing:
            self.end(tag)
            return found.end()
        self.begin(tag, told)
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, found.end())
            if end is None:
                return len(html)
            after = html.find(">", end.start())
            return after + 1 if after >= 0 else len(html)
        return found.end()

    def begin(self, tag: str, told: str) -> None:
        if self.open["head"] and tag not in _IN_HEAD and tag != "head":
            self.end_open(frozenset(["head"]), frozenset())
        if tag == "br":
            self.text(" ")
        if tag in _VOID and tag != "hr" or tag in _RAW:
            return
        if tag == "a":
            self.link = len(self.stack)
        if tag in _BLOCKS:
            self.flush()
            if tag in _ENDS_P:
                self.end_open(frozenset(["p"]), _P_BARRIER)
            if tag in _ENDS:
                self.end_open(*_ENDS[tag])
            if tag != "hr":
                self.push(Element(tag, bias_of(tag, told, self.stack[-1].bias), self.stack[-1].silent))
        elif tag in _NO_TEXT:
            self.push(Element(tag, self.stack[-1].bias, True))
        else:
            # An element inside a line counts only if it tells something of its own.
            top = self.stack[-1]
            bias = bias_of(tag, told, top.bias) if "=" in told or "hidden" in told else top.bias
            if bias != top.bias:
                self.flush()
                self.push(Element(tag, bias, top.silent, True))

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        if tag in _BLOCKS or tag in _NO_TEXT:
            self.flush() if tag in _BLOCKS else None
            self.end_open(frozenset([tag]), frozenset())
        elif self.stack[-1].inline and self.open[tag]:
            depth = len(self.stack) - 1
            while self.stack[depth].inline and self.stack[depth].tag != tag:
                depth -= 1
            if self.stack[depth].inline:
                self.pop(depth)


def cheapest(prices: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The labelling that costs least: kept ones pay where their price is negative, the
    others where it is positive, and each edge between the two pays its own. A minimum
    cut, by blocking flows along shortest paths; of several the one that keeps most."""
    size = len(prices)
    source, sink = size, size + 1
    links: list[list[int]] = [[] for _ in range(size + 2)]
    heads: list[int] = []
    room: list[int] = []

    def connect(one: int, two: int, there: int, back: int) -> None:
        links[one].append(len(heads))
        heads.append(two)
        room.append(there)
        links[two].append(len(heads))
        heads.append(one)
        room.append(back)

    for node, told in enumerate(prices):
        if told > 0:
            connect(source, node, told, 0)
        elif told < 0:
            connect(node, sink, -told, 0)
    for one, two, apart in edges:
        connect(one, two, apart, apart)

    def distances() -> list[int]:
        """Steps to the sink through links with room."""
        far, wave = [-1] * (size + 2), [sink]
        far[sink] = 0
        while wave:
            ahead = []
            for node in wave:
                for link in links[node]:
                    if room[link ^ 1] and far[heads[link]] < 0:
                        far[heads[link]] = far[node] + 1
                        ahead.append(heads[link])
            wave = ahead
        return far

    while (far := distances())[source] >= 0:
        turn = [0] * (size + 2)
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                least = min(room[link] for link in path)
                for link in path:
                    room[link] -= least
                    room[link ^ 1] += least
                # Go on from the first link that is full now.
                cut = next(i for i, link in enumerate(path) if not room[link])
                node = heads[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[node] < len(links[node]):
                link = links[node][turn[node]]
                if room[link] and far[heads[link]] == far[node] - 1:
                    break
                turn[node] += 1
            else:
                if node == source:
                    break
                node = heads[path.pop() ^ 1]
                turn[node] += 1
                continue
            path.append(link)
            node = heads[link]
    return [steps < 0 for steps in far[:size]]


def main_text(html: str | None) -> str:
    """The text of a page without what stands around it."""
    page = Reader(html or "").read()
    kept = cheapest(page.prices, page.edges)
    return " ".join(text for text, stays in zip(page.texts, kept, strict=True) if stays)


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html) for html in tx.column(batch, "html")]
        given = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url")]
        yield pa.record_batch(
            [*given, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
        )
    tx.release()


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``."""
    given = pages.selectExpr("CAST(page_id AS LONG) AS page_id", "url", "html")
    return given.mapInArrow(_look, "page_id long, url string, text string, n_chars long")
