"""Main text of web pages: blocks labelled content or boilerplate by a minimum cut."""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed word lists of the classifier.
INLINE = set("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rp rt s samp small span strike strong
sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover
munderover mspace semantics""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("script style template head title svg annotation annotation-xml iframe object canvas audio video select option textarea button datalist input label".split())
IMPLIED = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"td", "th", "tr", "p"}}
CLOSES_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
OUTSIDE_TAGS = set("nav aside form footer menu dialog fieldset".split())
OUTSIDE_ROLES = set("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
OUTSIDE_WORDS = set("""ad ads adv advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs cookie
cookies consent gdpr notice notices alert popup modal overlay promo promotion promoted sponsor sponsored sidebar sidebars rail widget widgets
menu menus nav navbar navigation topbar toolbar masthead footer foot copyright comment comments commentlist disqus respond replies
reply discussion share sharing social related recommended recommendation recommendations newsletter subscribe subscription signup login
register search pagination pager skip toc tagcloud teaser""".split())
OFTEN_TOPICS = set("discussion search register social foot skip reply replies".split())  # of the former: as likely what a section is about
ABOUT = {"has", "with", "without", "no"}
HEADER_WORDS = {"header", "head", "topper"}
CONTENT_WORDS = set("article content contents post entry story main body text prose".split())

# Weights of the linear classifier, in log-odds for content. No labelled pages exist, so they are set by hand.
BIAS, OUTSIDE, INSIDE, HEADER, PARAGRAPH, HEADING, LENGTH, LINKS = -0.5, -9.0, 3.0, -5.0, 1.0, 0.3, 0.6, -5.0
DOUBTFUL = -2.5  # a name that speaks against a part of an article, but may be its topic: the blocks beside it decide
WRAPPER = 0.9  # share of the page's text from which an element says nothing about it
NEXT, NEAR = 0.4, 0.6  # smoothness of neighbours in page order, and of blocks close to each other in the tree

_SPACE = re.compile(r"\s+")


class Element(NamedTuple):
    """An element that cuts text into blocks, and what it says about itself."""

    tag: str
    parent: int
    depth: int
    outside: bool
    doubtful: bool  # outside by a name alone that inside an article may be a topic
    inside: bool
    header: bool


class Block(NamedTuple):
    text: str
    element: int  # number of the innermost element
    links: float  # share of the text in links


class Blocks(HTMLParser):
    """Cuts a page into blocks of text at the borders of all but inline elements. An element is kept as its parent's number,
    so a page takes memory by its length however deep it nests."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements = [Element("", 0, 0, False, False, False, False)]
        self.blocks: list[Block] = []
        self.stack = [0]
        self.open: Counter = Counter()  # tags in the stack
        self.anchors = self.linked = 0
        self.dropping: list[str] = []
        self.dropped: Counter = Counter()  # tags being dropped
        self.parts: list[str] = []

    def words(self, named: dict) -> set[str]:
        found: set[str] = set()
        for name in ("class", "id"):
            for part in (named.get(name) or "").split():
                ws = [w.lower() for w in re.split(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])", part) if w]
                # "has-sidebar" and "page-with-search" say what is below or missing, not what the element is.
                found |= set(ws[: next((k for k, w in enumerate(ws) if w in ABOUT), len(ws))])
        return found

    def drop(self, tag: str) -> None:
        self.dropping.append(tag)
        self.dropped[tag] += 1

    def close_to(self, tag: str) -> None:
        while (ended := self.elements[self.stack.pop()].tag) != tag:
            self.open[ended] -= 1
        self.open[tag] -= 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closing = IMPLIED.get(tag, {"p"} if tag in CLOSES_P else ())
        while self.dropping and self.dropping[-1] in closing:
            self.dropped[self.dropping.pop()] -= 1
        if self.dropping:
            if tag not in VOID:
                self.drop(tag)
            return
        if tag == "body":
            return
        if tag in DROPPED:
            if tag not in VOID:
                if tag not in ("annotation", "annotation-xml"):  # parts of a formula, which stays in its line
                    self.end_block()
                self.drop(tag)
            return
        if tag in INLINE and not attrs:
            if tag == "br":
                self.parts.append(" ")
            return
        named = dict(reversed(attrs))  # of an attribute that is given twice, the first counts
        hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in (named.get("style") or "").replace(" ", "")
        if tag in INLINE:
            if hidden and tag not in VOID:
                self.drop(tag)
            elif tag == "a":
                self.anchors += 1
            elif tag == "br":
                self.parts.append(" ")
            return
        self.end_block()
        if tag in VOID:
            return
        if hidden:
            self.drop(tag)
            return
        while self.elements[self.stack[-1]].tag in closing:
            self.open[self.elements[self.stack.pop()].tag] -= 1
        words, role = self.words(named), (named.get("role") or "").lower()
        against = words & OUTSIDE_WORDS
        certain = tag in OUTSIDE_TAGS or role in OUTSIDE_ROLES
        outside = tag != "html" and (certain or bool(against) or tag == "noscript")
        doubtful = outside and not certain and (tag in HEADINGS or against <= OFTEN_TOPICS)
        inside = tag in ("article", "main") or role in ("main", "article") or bool(words & CONTENT_WORDS) and not words & HEADER_WORDS
        header = tag == "header" or bool(words & HEADER_WORDS) and not words & CONTENT_WORDS
        above = self.stack[-1]
        self.stack.append(len(self.elements))
        self.open[tag] += 1
        self.elements.append(Element(tag, above, self.elements[above].depth + 1, outside, doubtful, inside, header))

    def handle_endtag(self, tag: str) -> None:
        if self.dropping:
            if self.dropped[tag]:
                while (ended := self.dropping.pop()) != tag:
                    self.dropped[ended] -= 1
                self.dropped[tag] -= 1
                return
            if tag in INLINE or not self.open[tag]:
                return
            self.dropping, self.dropped = [], Counter()  # an element around ends, and with it what was left open in it
        if tag in INLINE:
            if tag == "a" and self.anchors:
                self.anchors -= 1
            return
        self.end_block()
        if self.open[tag]:
            self.close_to(tag)

    def handle_data(self, data: str) -> None:
        if not self.dropping:
            self.parts.append(data)
            if self.anchors:
                self.linked += len(data)

    def end_block(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.blocks.append(Block(text, self.stack[-1], min(1.0, self.linked / len(text))))
        self.parts, self.linked, self.anchors = [], 0, 0


class Page(NamedTuple):
    blocks: list[Block]
    elements: list[Element]
    scores: list[float]


def read_page(html: str) -> Page:
    """Blocks of a page, and each one's log-odds for being content."""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.end_block()
    blocks, elements = parser.blocks, parser.elements
    marks = _marks(blocks, elements)
    scores = []
    for text, k, links in blocks:
        tag = elements[k].tag
        score = BIAS + LENGTH * math.log(text.count(" ") + 1) + LINKS * links + marks[k]
        scores.append(score + PARAGRAPH * (tag in ("p", "pre", "blockquote")) + HEADING * (tag[:1] == "h"))
    return Page(blocks, elements, scores)


def _marks(blocks: list[Block], elements: list[Element]) -> list[float]:
    """Per element, what it and those around it say about text in it.

    Elements that are boilerplate by tag or name but hold nearly all text of the page, or most of it and everything that
    is marked as content, are wrappers, and their mark is left out.
    """
    n = len(elements)
    size = [0] * n
    for b in blocks:
        size[b.element] += len(b.text)
    for k in range(n - 1, 0, -1):  # parents come before their children
        size[elements[k].parent] += size[k]
    neutral: set[int] = set()
    while True:
        outside, doubtful, inside, header, content = ([False] * n for _ in range(5))
        marked = []
        for k in range(1, n):
            e = elements[k]
            within = inside[e.parent]
            out = e.outside and k not in neutral and not (within and (e.doubtful or e.tag == "noscript"))
            if out:
                marked.append(k)
            content[k] = e.inside and not out
            outside[k] = outside[e.parent] or out
            doubtful[k] = doubtful[e.parent] or within and e.doubtful and e.tag != "noscript"
            inside[k] = within or content[k]
            header[k] = header[e.parent] or e.header and not within
        held = [int(c) for c in content]
        for k in range(n - 1, 0, -1):
            held[elements[k].parent] += held[k]
        every = max(1, size[0])
        wrappers = {k for k in marked if size[k] >= WRAPPER * every or size[k] >= 0.5 * every and held[k] == held[0] > 0}
        if not wrappers:
            return [OUTSIDE * outside[k] + DOUBTFUL * doubtful[k] + INSIDE * inside[k] + HEADER * header[k] for k in range(n)]
        neutral |= wrappers


def edges_of(blocks: list[Block], elements: list[Element]) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block with the next one in page order, the stronger the nearer they are in the tree,
    and with the last block before that hangs on the same element."""
    edges, last = [], {}
    for k, block in enumerate(blocks):
        if k:
            a, b, steps = blocks[k - 1].element, block.element, 0
            while a != b:  # to the element around both; in page order these are no more steps than there are tags between
                if elements[a].depth >= elements[b].depth:
                    a = elements[a].parent
                else:
                    b = elements[b].parent
                steps += 1
            edges.append((k - 1, k, NEXT + NEAR / (1 + steps)))
        parent = elements[block.element].parent
        if last.get(parent, k - 1) != k - 1:
            edges.append((last[parent], k, NEAR / 3))
        last[parent] = k
    return edges


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling (True: content) of least cost: the capacity of each block that goes against its score, and
    the weight of each edge whose ends differ. Blocks without a preference follow the boilerplate side.

    A block whose capacity outweighs all its open edges keeps its own side in some optimum; it is settled at once
    and its edges become terminal capacities of its neighbours. What is left is solved by maximum flow.
    """
    scores = list(scores)
    near: list[dict[int, float]] = [{} for _ in scores]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * len(scores)
    todo = deque(range(len(scores)))
    while todo:
        k = todo.popleft()
        if label[k] is None and abs(scores[k]) >= sum(near[k].values()):
            label[k] = scores[k] > 0
            for other, w in near[k].items():
                scores[other] += w if label[k] else -w
                del near[other][k]
                todo.append(other)
    rest = [k for k, l in enumerate(label) if l is None]
    if rest:
        content = _max_flow(rest, scores, near)
        for k in rest:
            label[k] = k in content
    return [bool(l) for l in label]


def _max_flow(nodes: list[int], scores: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes on the source (content) side of a minimum cut, by shortest augmenting levels."""
    source, sink = -1, -2
    left: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for k in nodes:
        left[k] = dict(near[k])
    for k in nodes:
        if scores[k] > 0:
            left[source][k], left[k][source] = scores[k], 0.0
        else:
            left[k][sink], left[sink][k] = -scores[k], 0.0
    tiny = 1e-12
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            k = queue.popleft()
            for other, room in left[k].items():
                if room > tiny and other not in level:
                    level[other] = level[k] + 1
                    queue.append(other)
        if sink not in level:
            return {k for k in level if k >= 0}
        ways = {k: iter(list(left[k])) for k in level}
        path = [source]
        while path:
            k = path[-1]
            if k == sink:
                flow = min(left[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    left[a][b] -= flow
                    left[b][a] += flow
                cut = next(i for i, (a, b) in enumerate(zip(path, path[1:])) if left[a][b] <= tiny)
                del path[cut + 1 :]
                continue
            for other in ways[k]:
                if left[k][other] > tiny and level.get(other) == level[k] + 1:
                    ways[k] = _again(other, ways[k])
                    path.append(other)
                    break
            else:
                path.pop()
                level[k] = -1


def _again(first: int, rest: Iterator[int]) -> Iterator[int]:
    yield first
    yield from rest


def content_blocks(html: str | None) -> tuple[list[str], int, int]:
    """Texts of the content blocks in page order, how many blocks the page has, and of how many the cut turned the label
    that their own score gives."""
    blocks, elements, scores = read_page(html or "")
    keep = minimum_cut(scores, edges_of(blocks, elements))
    return [b.text for b, k in zip(blocks, keep) if k], len(blocks), sum((s > 0) != k for s, k in zip(scores, keep))


def main_text(html: str | None) -> str:
    """The content blocks of a page in page order, one per line; null and pages without any give an empty text."""
    return "\n".join(content_blocks(html)[0])


def extract_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars, n_blocks, n_turned)`` per row of ``pages(page_id, url, html)``; the last two count the
    blocks of the page and those whose label the cut turned.

    Each page is parsed whole in its own row; nothing is shuffled. Null html is empty and gives an empty text; null
    or repeated ids and urls are passed on, other columns are left out. Time and memory grow with the length of a page,
    however deep it nests. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [content_blocks(h) for h in batch.column(2).to_pylist()]
            texts = ["\n".join(kept) for kept, _, _ in found]
            counts = [pa.array(c, pa.int64()) for c in ([len(t) for t in texts], [n for _, n, _ in found], [n for _, _, n in found])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), *counts], names=names)

    names = ["page_id", "url", "text", "n_chars", "n_blocks", "n_turned"]
    columns = [F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")]
    return pages.select(*columns).mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_turned long")
