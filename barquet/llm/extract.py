"""Main text of web pages by tree scoring.

A page becomes a tree of its elements, without those that never hold the article
(scripts, styles, menus, page headers, footers) and without what its own attributes hide. What a class, id or role
names as advert, notice, comment and the like is marked, and goes as well unless it holds
the main part of the text (see `_settle`); words after `no`, `has`, `with` and such tell of the
page's layout and mark nothing. Forms and asides are weighed like marked elements: one may
wrap a whole page. Every paragraph passes points
(one, one for each comma, up to three for its length) to its parent, half of them to the
grandparent, a third of that half and so on further up; a container's points are
discounted by the share of its text that stands in links. The best container is kept
with the siblings that score well, are plain paragraphs or headings; if it lies in an
`article` (or `main`), that element is kept whole.

Text is decoded, white space inside a block becomes one space, blocks are joined by one
space. `<br>` is white space. Null or empty html, and a page without text, give an empty
text; broken markup is read as far as it goes; repeated rows are extracted again; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|[^<]+|<",
    re.S,
)
# A tag with a quote that never ends.
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
# Only attributes with one of these are looked at one by one.
_MAY_HIDE = re.compile(r"hidden|display", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their content is no markup: it ends at their end tag.
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
DROPPED = RAW | frozenset(
    "head nav footer button select option svg canvas object audio video menu dialog "
    "fieldset label datalist map".split()
)
# Weighed like elements with an unwanted name: a form may wrap a whole page.
WEIGHED = frozenset(("aside", "form"))
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote td dd li figcaption".split()) | HEADINGS
WHOLE = frozenset(("article", "main"))
# An open element of these ends when one of the named begins.
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"},
}
UNWANTED = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs byline "
    "comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu modal nav "
    "navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted "
    "promotion recommended related replies respond search share sharing sidebar signup social sponsor "
    "sponsored subscribe subscription toolbar toc widget widgets alert hidden".split()
)
# In a class or id, words from these on tell what the page has beside the element.
LAYOUT = frozenset("no not has have with without show hide".split())
STATES = frozenset("open closed enabled disabled".split())
REPLIES = frozenset("comment comments commentlist disqus replies respond".split())
WANTED = frozenset("article body content entry main post story text blog".split())
TAG_POINTS = {
    "article": 25, "main": 15, "section": 3, "div": 5, "td": 3, "blockquote": 3, "pre": 3,
    "ul": -3, "ol": -3, "dl": -3, "li": -3, "th": -5,
}


class Node:
    """An element: its name, its children (nodes and text in order), its parent."""

    __slots__ = ("tag", "words", "parent", "items", "points", "chars", "linked", "marked")

    def __init__(self, tag: str, words: frozenset, parent: "Node | None", marked: bool = False):
        self.tag, self.words, self.parent, self.marked = tag, words, parent, marked
        self.items: list = []
        self.points = 0.0
        self.chars = self.linked = 0


def _words_of(attributes: str) -> frozenset:
    found = set()
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = re.split(r"[^a-z0-9]+", name)
            if not STATES.isdisjoint(words):
                continue
            for word in words:
                if word in LAYOUT:
                    break
                found.add(word)
    return frozenset(found)


def _dropped(tag: str, attributes: str) -> bool:
    if tag in ("html", "body", *WHOLE):
        return False
    return tag in DROPPED or _hidden(attributes)


def _hidden(attributes: str) -> bool:
    """Whether an element's own attributes hide it; what a title or a class says does not."""
    if not _MAY_HIDE.search(attributes):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _NOT_SHOWN.search(value):
            return True
    return False


def parse(html: str) -> Node:
    """The tree without dropped elements, which are open like others until an end tag or
    another element ends them."""
    root = here = Node("html", frozenset(), None)
    at = 0
    open_tags: dict[str, int] = {}

    def closed(node: Node) -> Node:
        """The parent of an open element, which ends with all that is open inside it."""
        end, inner = node.parent, here
        while inner is not end:
            open_tags[inner.tag] -= 1
            inner = inner.parent
        return end

    while at < len(html):
        m = _TOKEN.match(html, at)
        if m[0] == "<":
            m = _LOOSE.match(html, at) or m
        at = m.end()
        closing, tag, attributes = m.groups()
        if tag is None:
            if m[0] == "<" or m[0][0] != "<":
                here.items.append(m[0])
            continue
        tag = tag.lower()
        if not closing and tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if here.tag == "head" and not closing and tag not in VOID:
            here = closed(here)
        if tag in ("html", "body"):
            continue
        if closing:
            if open_tags.get(tag):  # an end without its element ends nothing
                node = here
                while node.tag != tag:
                    node = node.parent
                here = closed(node)
            continue
        if tag == "br" or tag == "hr" or tag == "wbr":
            here.items.append("" if tag == "wbr" else " ")
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS:
            node = here  # a block ends an open paragraph
            while node is not root and (node.tag not in BLOCKS or node.tag in HEADINGS and tag not in HEADINGS):
                node = node.parent
            if node.tag == "p":
                here = closed(node)
        if (ends := ENDED_BY.get(tag)) is not None and any(open_tags.get(x) for x in ends):
            node = here
            while node is not root and node.tag not in ends and node.tag not in ("ul", "ol", "dl", "table"):
                node = node.parent
            if node.tag in ends and node is not root:
                here = closed(node)
        words = _words_of(attributes) if attributes else frozenset()
        dropped, marked = _dropped(tag, attributes), tag in WEIGHED or tag not in WHOLE and not UNWANTED.isdisjoint(words)
        if (dropped or marked) and attributes.endswith("/"):
            continue
        node = Node(tag, words, here, marked)
        if not dropped:
            here.items.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        here = node
    return root


def _order(root: Node) -> list[Node]:
    """All nodes, parents first; no recursion, whatever the depth."""
    found, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or node.tag in WHOLE
        if node.tag == "header" or "header" in node.words and node.tag not in WHOLE:
            # A page header goes; of an article's, headings stay.
            node.items = [x for x in node.items if inside and isinstance(x, Node) and x.tag in HEADINGS]
        found.append(node)
        todo.extend((x, inside) for x in reversed(node.items) if isinstance(x, Node))
    return found


def _own_text(node: Node) -> str:
    """Text of a node and of its inline children."""
    parts, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x is node or x.tag not in BLOCKS and not x.marked:
            todo.extend(reversed(x.items))
    return " ".join("".join(parts).split())


def text_of(nodes: list[Node]) -> str:
    """Decoded text of whole subtrees; blocks are set apart by white space."""
    parts: list[str] = []
    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(unescape(x) if "&" in x else x)
        else:
            if x.tag in BLOCKS:
                parts.append(" ")
                todo.append(" ")
            todo.extend(reversed(x.items))
    return " ".join("".join(parts).split())


def _score(nodes: list[Node]) -> dict[int, Node]:
    """Points of all containers; nothing passes out of a marked element."""
    for node in reversed(nodes):
        node.points = 0.0
        inner = [x for x in node.items if isinstance(x, str) or not x.marked]
        node.chars = sum(len(x.strip()) if isinstance(x, str) else x.chars for x in inner)
        node.linked = node.chars if node.tag == "a" else sum(x.linked for x in inner if not isinstance(x, str))
    for node in nodes:
        if node.tag not in BLOCKS:
            continue
        leaf = not any(isinstance(x, Node) and x.tag in BLOCKS and not x.marked for x in node.items)
        if node.tag in PARAGRAPHS or leaf:
            text = _own_text(node)
            if not text:
                continue
            up = node.parent if (node.tag in PARAGRAPHS or node.parent is None) and not node.marked else node
            if up is not None:
                up.points += 1 + text.count(",") + min(len(text) // 100, 3)
    # Bottom-up, each node once: half of what paragraphs gave a node, and a third of what
    # reached it from below, go on to its parent.
    scored: dict[int, Node] = {}
    passed: dict[int, float] = {}
    for node in reversed(nodes):
        own, below = node.points, passed.get(id(node), 0.0)
        if not own and id(node) not in passed:
            continue
        node.points = own + below
        scored[id(node)] = node
        if not node.marked and node.parent is not None:
            passed[id(node.parent)] = passed.get(id(node.parent), 0.0) + 0.5 * own + below / 3
    return scored


def _settle(root: Node) -> None:
    """Drop marked elements, but keep those around the best container if its text outweighs
    what is not marked: by any margin where the marked element has a word of articles in its
    names too or holds the one article, otherwise twice, for comments eight times; four times that
    outside an article that is not marked. A marked element that holds `main` stays if that has text."""
    nodes = _order(root)
    if not any(x.marked for x in nodes):
        return
    scored = _score(nodes)
    region: dict[int, Node] = {}
    inside: dict[int, bool] = {}
    best: dict[int, float] = {}
    located = False
    for x in nodes:
        up = x.parent
        region[id(x)] = x if x.marked or up is None else region[id(up)]
        inside[id(x)] = x.tag in WHOLE or up is not None and inside[id(up)]
        if id(x) in scored and x.chars:
            of = id(region[id(x)])
            best[of] = max(best.get(of, 0.0), x.points * (1 - x.linked / x.chars))
        if x.tag in WHOLE and UNWANTED.isdisjoint(x.words):
            located |= region[id(x)] is root and x.points > 0
    # Bottom-up: articles and mains a node holds, itself left out, and mains with text.
    wholes: dict[int, int] = {}
    mains: dict[int, int] = {}
    full: dict[int, bool] = {}
    for x in reversed(nodes):
        if x.parent is None:
            continue
        named = x.tag in WHOLE and UNWANTED.isdisjoint(x.words)
        up = id(x.parent)
        wholes[up] = wholes.get(up, 0) + wholes.get(id(x), 0) + named
        mains[up] = mains.get(up, 0) + mains.get(id(x), 0) + (named and x.tag == "main")
        here = full.get(id(x), False) or named and x.tag == "main" and bool(x.chars)
        full[id(x)] = here
        full[up] = full.get(up, False) or here

    def margin(x: Node) -> float:
        if mains.get(id(x)):
            return 1e-9
        if wholes.get(id(x)) == 1:
            least = 1.0
        elif not REPLIES.isdisjoint(x.words):
            least = 8.0
        else:
            least = 2.0 if WANTED.isdisjoint(x.words) else 1.0
        return least if inside[id(x)] or not located else 4 * least

    # Top-down: the largest margin among a marked element and the marked ones around it.
    needed: dict[int, float] = {}
    most, chosen = 0.0, root
    for x in nodes:
        around = needed.get(id(x.parent), 0.0) if x.parent is not None else 0.0
        needed[id(x)] = max(around, margin(x)) if x.marked else around
        if x.marked and best.get(id(x)) and (weight := best[id(x)] / needed[id(x)]) > most:
            most, chosen = weight, x
    if most > max(best.get(id(root), 0.0), 1.0):
        while chosen is not None:
            chosen.marked, chosen = False, chosen.parent
    for x in nodes:
        if full.get(id(x)):
            x.marked = False
    for x in nodes:
        x.items = [y for y in x.items if isinstance(y, str) or not y.marked]


def main_nodes(root: Node) -> list[Node]:
    """The best container and the siblings kept with it, in page order."""
    _settle(root)
    nodes = _order(root)
    scored = _score(nodes)
    if not scored:
        return [root]

    def final(node: Node) -> float:
        points = node.points + TAG_POINTS.get(node.tag, 0) + 10 * bool(node.words & WANTED)
        return points * (1 - node.linked / node.chars) if node.chars else 0.0

    best = max((n for n in nodes if id(n) in scored), key=final)
    for tag in ("article", "main"):
        up = best
        while up is not None and up.tag != tag:
            up = up.parent
        if up is not None:
            return [up]
    if best.parent is None:
        return [best]
    least = max(3.0, 0.2 * final(best))
    kept = []
    for x in best.parent.items:
        if not isinstance(x, Node):
            continue
        density = x.linked / x.chars if x.chars else 0.0
        if x is best or x.tag in HEADINGS or (x.tag == "p" and density < 0.25) or (
            id(x) in scored and final(x) >= least
        ):
            kept.append(x)
    return kept


def main_text(html: str | None) -> str:
    return text_of(main_nodes(parse(html))) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())],
                names=["page_id", "url", "text"],
            )

    return pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    ).mapInArrow(run, "page_id long, url string, text string")
