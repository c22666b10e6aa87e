"""Main text of web pages by tree scoring.

The markup becomes a light tree of elements. Paragraphs pass points for length and commas to their
ancestors, discounted by link density; the best container and those siblings that score or read like
it are kept, and their blocks make the text. Beside a container that no name marks as the article, all
siblings of few links are kept, however short.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import batch_column

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr br img".split())
DROPPED = frozenset("head nav footer aside form script style noscript template iframe object embed applet svg math "
                    "canvas audio video button select option textarea input label fieldset dialog menu title "
                    "noembed noframes xmp map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre td blockquote dd li".split())
#: What a start tag closes, and at which elements the search for it stops.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
          "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
          "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
#: Names of class, id or role that mark what is not the article, and those that mark it.
UNWANTED = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
                     "sidebar sidenav nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer "
                     "comment comments disqus respond reply replies cookie cookies consent gdpr notice notices alert "
                     "popup modal overlay newsletter subscribe signup login share sharing social related recommended "
                     "recommendations pagination pager widget widgets toolbar skip complementary contentinfo search "
                     "disclaimer copyright legal".split())
#: Of these, names that say what an element is even beside one that marks the article.
CERTAIN = frozenset("ad ads comment comments sidebar footer nav".split())
#: Words behind an unwanted one that only say how its element is laid out, and words before it that say something
#: of the page rather than of the element (a page that has a sidebar, an article without comments).
LAYOUT = frozenset("area bar block body box button buttons column container content form group holder icons inner item "
                   "items links list main outer panel posts row section text top bottom left right wrap wrapper".split())
STATE = frozenset("has have with without no not is hide hidden show shown enable enabled disable disabled".split())
_NEVER_UNWANTED = HEADINGS | {"html", "body", "article", "main"}
WANTED = frozenset("article content main body post entry story text prose maincontent articlebody".split())
_BOILERPLATE = re.compile(r"©|\bcopyright\b|\ball rights reserved\b", re.IGNORECASE)
_SENTENCE_END = re.compile(r"[.!?…:;。！？।؟][\"'”’»)\]]*\Z")

MIN_PARAGRAPH, COMMA_POINTS, CHARS_PER_POINT, MOST_LENGTH_POINTS = 1, 1.0, 100, 3.0
SIBLING_SHARE, LINK_LIST_DENSITY = 0.2, 0.5
#: Share of a paragraph's points below which ancestors get nothing more, and of the page's paragraph text from
#: which an element is kept although its name speaks against it.
LEAST_SHARE, MOST_TEXT = 1e-6, 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
                    r"|<(/?)([a-zA-Z][^\s/>]*+)[^>]*>?", re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?",
                        re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_SPACE = re.compile(r"\s+")


class Node:
    """An element: what lies in it in page order (nodes and texts), and its totals.

    ``named`` says that its names speak against it: 2 if one is certain, 1 if another is, else 0.
    """

    __slots__ = ("tag", "parent", "items", "hint", "drop", "named", "score", "chars", "linked", "last", "inside")

    def __init__(self, tag: str, parent, hint: int = 0, drop: bool = False, named: int = 0):
        self.tag, self.parent, self.hint, self.drop, self.named = tag, parent, hint, drop, named
        self.items: list = []
        self.score = 0.0
        self.chars = self.linked = 0
        self.last = -1
        self.inside = False


def _against(name: str) -> int:
    """Whether one name (a class, an id, a role) marks what is not the article: 2 certainly, 1 otherwise, 0 not.

    The name as a whole counts, or its last word (``site-footer``), or its first where only words of layout
    follow (``comments-area``); not a word among others (``legal-news``), nor one that a state goes before
    (``has-sidebar``).
    """
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[0] in STATE:
        return 0
    hit = words[-1] if words[-1] in UNWANTED else words[0] if LAYOUT.issuperset(words[1:]) else ""
    return 2 if hit in CERTAIN else 1 if hit in UNWANTED else 0


def _hints(tag: str, attributes: str) -> tuple[int, bool, int]:
    """Points for what class, id and role say, whether the element is hidden or never text, and ``named``."""
    hint, drop, against, wanted = 25 if tag in ("article", "main") else 0, tag in DROPPED, 0, False
    if attributes and not attributes.isspace():
        for attribute, *values in _ATTRIBUTE.findall(attributes):
            value, attribute = "".join(values), attribute.lower()
            if attribute == "hidden" or attribute == "aria-hidden" and value == "true":
                drop = True
            elif attribute == "style":
                drop |= "display:none" in value.replace(" ", "").lower()
            else:
                for name in value.split():
                    against = max(against, _against(name))
                    wanted = wanted or not WANTED.isdisjoint(w.lower() for w in _WORD.findall(name))
        if wanted:
            hint += 25
            against = against if against == 2 else 0
        if tag in _NEVER_UNWANTED:
            against = 0
    return hint, drop, against


class _Open:
    """The elements open at a point of a page, with the places of each tag and of the blocks among them."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag not in INLINE:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """Closes the element at a place and all in it."""
        while len(self.nodes) > place:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            if node.tag not in INLINE:
                self.blocks.pop()

    def end(self, tag: str) -> None:
        """An end tag closes the last element of its tag; an inline one not across a block. Others are passed over."""
        places = self.places.get(tag)
        if places and (tag not in INLINE or places[-1] > self.blocks[-1]):
            self.cut(places[-1])

    def make_room(self, tag: str) -> None:
        """Where a block element goes: an open p ends, and items end before their like."""
        last = self.nodes[self.blocks[-1]].tag
        if last == "p" or last in HEADINGS and tag in HEADINGS:
            self.cut(self.blocks[-1])
        if tag in CLOSES:
            kinds, stops = CLOSES[tag]
            stop = max((self.places[s][-1] for s in stops if self.places.get(s)), default=0)
            inner = [places[at] for k in kinds if (places := self.places.get(k))
                     and (at := bisect_right(places, stop)) < len(places)]
            if inner:
                self.cut(min(inner))


def parse(page: str) -> Node:
    """The tree of a page; broken markup is closed where the next element demands it.

    Every tag takes constant or logarithmic time beside the elements it closes, however deep or broken the page.
    """
    root = Node("#root", None)
    opened, at, end = _Open(root), 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        node = opened.nodes[-1]
        if found is None:
            node.items.append(page[at:])
            break
        if found.start() > at:
            node.items.append(page[at:found.start()])
        at = found.end()
        tag = found[2] or found[5]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1] or found[4]:
            opened.end(tag)
            continue
        if tag in VOID:
            node.items.append(Node(tag, node))
            continue
        if tag not in INLINE:
            opened.make_room(tag)
            node = opened.nodes[-1]
        new = Node(tag, node, *_hints(tag, found[3] or ""))
        node.items.append(new)
        if tag in RAW:
            close = re.compile(f"</{tag}\\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
        elif not (found[3] or "").endswith("/"):
            opened.push(new)
    return root


def _settle_names(root: Node) -> list[Node]:
    """Drops elements that their names speak against; returns these.

    One that holds most of the page's paragraph text stays, unless its name is certain.
    """
    order, named = [root], []
    for node in order:  # parents before their children
        for item in node.items:
            if isinstance(item, Node) and not item.drop:
                order.append(item)
                if item.named:
                    named.append(item)
    if named:
        held = {id(node): sum(len(x) for x in node.items if isinstance(x, str)) if node.tag in PARAGRAPHS else 0
                for node in order}
        for node in reversed(order[1:]):
            held[id(node.parent)] += held[id(node)]
        for node in named:
            node.drop = node.named == 2 or held[id(node)] <= MOST_TEXT * held[id(root)]
    return [node for node in named if node.drop]


def _blocks(top: Node, in_article: bool) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """(element, text, linked characters) of every block of text below, in page order; and the elements passed.

    Dropped elements are passed over; a header keeps only its headings where it belongs to an
    article, and nothing elsewhere. A line break is white space within its block.
    """
    out, pieces, linked, passed = [], [], 0, [top]
    owner = top
    stack = [(top, iter(top.items), 0, in_article, False, top)]  # last: the block that a node's text belongs to

    def flush():
        nonlocal pieces, linked
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                out.append((owner, text, min(linked, len(text))))
            pieces, linked = [], 0

    while stack:
        node, items, link, article, only_headings, block = stack[-1]
        for item in items:
            if isinstance(item, str):
                if not only_headings:
                    pieces.append(item)
                    if link:
                        linked += len(item)
                continue
            if item.tag in VOID:
                if item.tag == "hr":
                    flush()
                elif item.tag == "br":
                    pieces.append(" ")
                continue
            if item.drop or item.tag == "header" and not article:
                if item.tag not in INLINE:
                    flush()
                continue
            passed.append(item)
            if item.tag not in INLINE:
                flush()
                owner = block = item
            stack.append((item, iter(item.items), link or item.tag == "a", article or item.tag in ("article", "main"),
                          (only_headings or item.tag == "header") and item.tag not in HEADINGS, block))
            break
        else:
            stack.pop()
            if node.tag not in INLINE:
                flush()
                owner = stack[-1][5] if stack else top
    flush()
    return out, passed


def _link_list(node: Node) -> bool:
    """A menu within the article: a list or table that is mostly links."""
    return (node.tag in ("ul", "ol", "table", "dl") and node.chars > 0
            and node.linked > LINK_LIST_DENSITY * node.chars
            and sum(1 for x in node.items if isinstance(x, Node)) > 1)


def _reads(node: Node, density: float, blocks: list) -> bool:
    """Whether a neighbour of the best container reads like a part of the article: few links, and sentences."""
    if density >= 0.25:
        return False
    if node.tag in ("p", "pre", "blockquote") or node.tag in HEADINGS:
        return True
    text = blocks[node.last][1]
    return bool(_SENTENCE_END.search(text)) and not _BOILERPLATE.search(text)


def main_text(page: str | None) -> str:
    """The article's blocks joined by blank lines; empty for NULL, empty or text-free pages.

    Character references are decoded, white space within a block is one space; nothing else is
    changed or cut. A page whose best container holds no paragraph yields whatever lies outside the
    unwanted parts. If names leave nothing at all, the page is read again without regard to them.
    """
    if not page:
        return ""
    root = parse(page)
    dropped = _settle_names(root)
    blocks, passed = _blocks(root, False)
    if not blocks and dropped:
        for node in dropped:
            node.drop = False
        blocks, passed = _blocks(root, False)
    touched = {}
    for number, (node, text, linked) in enumerate(blocks):
        node.chars += len(text)
        node.linked += linked
        node.last = number
        if len(text) < MIN_PARAGRAPH or linked > LINK_LIST_DENSITY * len(text):
            continue
        points = (1 + COMMA_POINTS * text.count(",") + min(len(text) / CHARS_PER_POINT, MOST_LENGTH_POINTS)
                  if node.tag in PARAGRAPHS or node.tag not in HEADINGS else 1)
        up, level = (node.parent if node.tag in PARAGRAPHS | HEADINGS else node), 1.0
        while up is not None and level * LEAST_SHARE < 1:
            up.score += points / level
            touched[id(up)] = up
            level = 2.0 if level == 1 else level * 3 if level > 2 else 6.0
            up = up.parent
    if not touched:
        return "\n\n".join(text for _, text, _ in blocks)
    for node in reversed(passed[1:]):
        node.parent.chars += node.chars
        node.parent.linked += node.linked
        node.parent.last = max(node.parent.last, node.last)

    def value(node):
        return (node.score + node.hint) * (1 - node.linked / node.chars if node.chars else 1)

    top = max(touched.values(), key=value)
    kept = {id(top)}
    if top.parent is not None:
        least = SIBLING_SHARE * value(top)
        for item in top.parent.items:
            if isinstance(item, Node) and not item.drop and item is not top and item.chars:
                # beside a container that nothing marks, another one may hold a part of the article
                plain = not top.hint or item.tag in ("p", "pre", "blockquote") or item.tag in HEADINGS
                if plain and _reads(item, item.linked / item.chars, blocks) or id(item) in touched and value(item) >= least:
                    kept.add(id(item))
    barred = set()
    for node in passed:  # parents before their children
        up = node.parent
        node.inside = id(node) in kept or up is not None and up.inside
        if _link_list(node) or up is not None and id(up) in barred:
            barred.add(id(node))
    return "\n\n".join(text for node, text, _ in blocks if node.inside and id(node) not in barred)


def _start(_):
    def work(pages):
        texts = [main_text(p) for p in pages]
        return texts, [len(t) for t in texts]

    return work


def extract(pages: DataFrame, page: str = "html", into: str = "extracted") -> DataFrame:
    """``pages`` plus a struct ``into``: text and n_chars (code points).

    NULL and empty pages have an empty text; repeated pages repeat their text. A column that is called like
    ``into`` gives way to it.
    """
    return pages.withColumn(into, batch_column(
        F.col(page), "text string, n_chars long", {"text": pa.string(), "n_chars": pa.int64()}, _start, None))
