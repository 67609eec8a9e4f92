"""Main text of web pages by wrapper induction over the pages of a host.

Pages are parsed into DOM trees; runs of like siblings (same tag and class) become one list node. Each page's tree is
aligned with its host's reference tree (the page with the smallest id) by simple tree matching, which gives every text
block the place of the reference node it matched. A text that stands at the same place in at least CONSTANT of the
host's different contents belongs to the template; the rest are varying slots. Pages with the same kept texts, whatever
their menus, adverts and footers, are one content, and so are pages that share more than half of the characters of
both; in a marked article the larger part never counts as template. Page-varying menus, adverts and notices
are told apart from content slots by element names and roles, and by weighing class and id words with the part's
own statistics: a name of reader comments, adverts or consent boxes goes ("comment-body"); a part whose name may also be
one of an article's ("notices", "discussion", "related-work") goes only if it is link-heavy or mostly not prose. If a page marks an article or main element, the content is inside it; otherwise it is
the body without link-heavy blocks. All walks over trees are iterative, so markup may be nested at any depth. Trees are matched exactly
whatever their size: equal trees share one shape and pairs of shapes are compared once, a list of children is compared row by row,
and only about the root of its rows is held at a time.

Defined results: null and empty html give the empty text; unclosed and misnested tags are repaired as browsers do;
where a host has fewer than LEAST_PAGES different contents, template stands in all of them, and a host with fewer than
UNANIMOUS has none; a null url forms a host of its own; repeated rows are extracted alike; br counts as white space,
and so do cells of a table row.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from collections.abc import Generator, Iterator, Sequence
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, store, tidied
from .graph import connected_components

#: A text at one place in this share of a host's different contents is template, if there are LEAST_PAGES of them.
CONSTANT, LEAST_PAGES = 0.6, 5
#: With fewer contents, but at least so many, it has to stand in all of them: two alone don't tell a notice from a quotation.
UNANIMOUS = 3
#: Share of a block's characters inside links from which it is a menu (only where no article is marked), and of a part's
#: whose name holds a telling word; characters from which a text is prose even if it doesn't end like a sentence.
LINKS, PART_LINKS, PART_CHARS = 0.6, 0.4, 60
#: Compared pairs of shapes that are remembered; beyond that they are worked out again, with the same results.
REMEMBERED = 1 << 18

# Element kinds of HTML.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",))
RAW = frozenset(("script", "style", "xmp", "iframe", "noembed", "noframes", "textarea", "title",))
BLOCK = frozenset(
    ("address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
        "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu",
        "nav", "ol", "p", "pre", "search", "section", "summary", "table", "caption", "thead", "tbody", "tfoot", "tr", "ul",)
)
DROPPED = frozenset(
    ("nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "button", "select", "option", "textarea",
        "input", "label", "fieldset", "svg", "canvas", "object", "embed", "audio", "video", "map", "head", "title", "dialog", "menu", "search",
        "noembed", "noframes",)
)
DROPPED_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form", "status",))
#: Words of class and id names: the first kind names reader comments, adverts and consent boxes, and decides unless the name
#: says more; the second is also used for parts of articles ("notices", "discussion") and only makes a part doubtful.
DECIDING_WORDS = frozenset(
    ("ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "sponsor", "sponsors", "sponsored", "comment",
        "comments", "commentlist", "disqus", "respond", "cookie", "cookies", "consent", "gdpr", "newsletter",)
)
DOUBTFUL_WORDS = frozenset(
    ("advertorial", "promo", "promos", "promotion", "promoted", "banner", "banners", "nav", "navbar", "navigation", "navi", "menu", "menus", "topbar",
        "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "aside", "footer", "foot", "header", "masthead", "notice", "notices", "notification",
        "notifications", "alert", "popup", "modal", "overlay", "discussion", "replies", "reply", "subscribe", "subscription", "signup", "login",
        "share", "sharing", "social", "related", "recommended", "recommendations", "pagination", "pager", "toolbar", "widget", "widgets", "form",
        "search", "skip", "copyright", "disclaimer",)
)
TELLING_WORDS = DECIDING_WORDS | DOUBTFUL_WORDS
#: Words that make a doubtful name one of content, as in "article-header-body"; a deciding word beside them still decides.
KEPT_WORDS = frozenset(("article", "content", "main", "body", "post", "entry", "story", "text",))
#: Words that say nothing beside a telling one, as in "comment-list".
NEUTRAL_WORDS = frozenset(("area", "bar", "block", "bottom", "box", "button", "buttons", "container", "group", "header", "holder", "inner", "item",
    "items", "left", "link", "links", "list", "main", "menu", "outer", "panel", "post", "right", "row", "section", "site", "slot", "text", "title",
    "top", "unit", "wrap", "wrapper", "js", "author", "meta", "date", "reader", "user", "thread",))
SEPARATORS = {"td", "th", "br"}
#: A start tag closes an open element of these names, searching no further than the names in the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
#: End tags of the formatting kind don't close what lies outside their block.
SCOPE = frozenset(("article", "section", "main", "div", "body", "table", "td", "th", "li", "blockquote", "nav", "header", "footer", "aside", "form",))

OPENING = re.compile(r"<(?:(?=[!?])|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+))")
COMMENT_END = re.compile(r"--!?>")
STOPS = re.compile(r"""[>"']""")
ATTR = re.compile(r"""([^\s=/"'>]++)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?""")
NAMES = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")


class Node:
    __slots__ = ("tag", "kind", "children", "dropped", "doubtful", "text", "linked")

    def __init__(self, tag: str, kind: str, dropped: bool, doubtful: bool = False):
        self.tag, self.kind, self.dropped, self.doubtful = tag, kind, dropped, doubtful
        self.children: list[Node] = []
        self.text: str | None = None  # of text blocks
        self.linked = 0


@lru_cache(4096)
def _names(value: str) -> frozenset[str]:
    return frozenset(x.lower() for x in NAMES.findall(value))


@lru_cache(4096)
def describe(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """(kind, dropped, doubtful): the kind is what alignment compares; a doubtful part's own statistics decide."""
    found = {m[0].lower(): entities.unescape(m[1] or m[2] or m[3] or "") for m in ATTR.findall(attrs)} if attrs.strip() else {}
    kind = tag + "".join(f".{c}" for c in sorted(found.get("class", "").split()))
    if tag in DROPPED or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return kind, True, False
    if tag not in ("html", "body", "article", "main") and found.get("role", "").lower() in DROPPED_ROLES:
        return kind, True, False
    doubtful = False
    for name in [*found.get("class", "").split(), found.get("id", "")]:
        words = _names(name)
        telling = words & TELLING_WORDS
        if not telling or tag in ("html", "body", "main", "article"):  # there such names speak of the page ("has-sidebar", "comments-open")
            continue
        if words & DECIDING_WORDS and not words - TELLING_WORDS - NEUTRAL_WORDS - KEPT_WORDS:
            return kind, True, False
        doubtful |= not words & KEPT_WORDS
    return kind, False, doubtful


def _tag_end(page: str, p: int) -> int:
    """Where the tag that is open at p ends: at the first > outside quoted values; if there is none, at the first >; else -1."""
    at = p
    while m := STOPS.search(page, at):
        if m[0] == ">":
            return m.start()
        at = page.find(m[0], m.end()) + 1
        if not at:
            break
    return page.find(">", p)


class Builder:
    """DOM of one page; text blocks are leaf nodes."""

    def __init__(self, page: str):
        self.root = Node("#root", "#root", False)
        self.stack = [self.root]
        self.places = [0]  # of the blocks (and dropped elements) on the stack
        self.open: dict[str, int] = {}  # elements on the stack by name
        self.buffer: list[str] = []
        self.links = self.linked = 0
        p = 0
        while m := OPENING.search(page, p):
            if m.start() > p:
                self.chars(page[p : m.start()])
            if (name := m["name"]) is None:
                p = self.skip(page, m.end())
                continue
            stop = _tag_end(page, m.end())
            if stop < 0:  # the page ends inside a tag
                p = len(page)
                break
            attrs, p, name = page[m.end() : stop], stop + 1, name.lower()
            if m["close"]:
                self.end(name)
                continue
            self.start(name, attrs)
            if name in RAW and not attrs.endswith("/"):
                stop = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(page, p)
                p = stop.end() if stop else len(page)
                self.end(name)
        if p < len(page):
            self.chars(page[p:])
        self.flush()

    @staticmethod
    def skip(page: str, p: int) -> int:
        """The end of a comment, declaration or instruction that begins before p."""
        if page.startswith("!--", p):
            if page.startswith((">", "->"), p + 3):
                return page.index(">", p) + 1
            stop = COMMENT_END.search(page, p + 3)
            return stop.end() if stop else len(page)
        stop = page.find(">", p)
        return stop + 1 if stop >= 0 else len(page)

    def chars(self, text: str) -> None:
        if self.stack[-1].dropped:
            return
        text = entities.unescape(text) if "&" in text else text
        self.buffer.append(text)
        if self.links:
            self.linked += len(text.strip())

    def flush(self) -> None:
        if self.buffer:
            if text := " ".join("".join(self.buffer).split()):
                node = Node("#text", "#text", False)
                node.text, node.linked = text, self.linked
                self.block().children.append(node)
            self.buffer = []
        self.linked = 0

    def block(self) -> Node:
        return self.stack[self.places[-1]]

    def start(self, name: str, attrs: str) -> None:
        if name in BLOCK:
            self.flush()
            if name not in ("html", "head", "body"):
                self.close({"p"}, {"button", "table", "td", "th", "li", "div", "article", "section", "blockquote"})
        elif name in SEPARATORS:
            self.buffer.append(" ")
        if name in CLOSES:
            self.close(*CLOSES[name])
        if name == "body":
            self.close({"head"}, set())
        if name in VOID:
            return
        kind, dropped, doubtful = describe(name, attrs)
        inside = self.stack[-1].dropped
        # an inline element that is left out doesn't end the block around it
        if dropped and not inside and name in BLOCK:
            self.flush()
        node = Node(name, kind, dropped or inside, doubtful)
        if name in BLOCK:
            self.block().children.append(node)
        if name in BLOCK or node.dropped:
            self.places.append(len(self.stack))
        self.stack.append(node)
        self.open[name] = self.open.get(name, 0) + 1
        self.links += name == "a"

    def close(self, names: set[str], bounds: set[str]) -> None:
        if not any(self.open.get(n) for n in names):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in names:
                self.cut(i)
                return
            if self.stack[i].tag in bounds:
                return

    def cut(self, i: int) -> None:
        gone = self.stack[i:]
        if any(n.tag in BLOCK for n in gone):
            self.flush()
        for n in gone:
            self.open[n.tag] -= 1
            self.links -= n.tag == "a"
        while self.places[-1] >= i:
            self.places.pop()
        del self.stack[i:]

    def end(self, name: str) -> None:
        if not self.open.get(name):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == name:
                self.cut(i)
                return
            if name not in BLOCK and self.stack[i].tag in SCOPE:
                return


def top_down(root: Node) -> list[Node]:
    """All nodes, each before its children."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(reversed(node.children))
    return order


def is_prose(text: str) -> bool:
    """Long enough for a sentence, or ended like one."""
    return len(text) >= PART_CHARS or text[-1] in ".!?…:;" and " " in text


def weigh(root: Node) -> None:
    """Drops doubtful parts that are link-heavy or mostly not prose (headings don't count against a part that has some)."""
    order = top_down(root)
    if not any(n.doubtful for n in order):
        return
    heading = ("h1", "h2", "h3", "h4", "h5", "h6")
    sums: dict[int, tuple[int, int, int]] = {}  # characters outside headings, those in links, and those of prose
    for node in reversed(order):
        own = (len(node.text), node.linked, len(node.text) * is_prose(node.text)) if node.text is not None else (0, 0, 0)
        parts = [(0, x[1], 0) if c.tag in heading else x for c in node.children for x in (sums.pop(id(c)),)]
        sums[id(node)] = total = tuple(map(sum, zip(own, *parts, strict=True)))
        if node.doubtful:
            chars, linked, prose = total
            node.dropped |= linked > 0 and linked >= PART_LINKS * chars or 2 * prose <= chars


def skeleton(root: Node) -> list:
    """[kind, children]: nested, with runs of like siblings merged into one list node."""
    made: dict[int, list] = {}
    for node in reversed(top_down(root)):
        merged: list[list] = []
        for c in node.children:
            s = made.pop(id(c))
            if merged and merged[-1][0] == s[0]:
                merged[-1][1] = union(merged[-1][1], s[1])
            else:
                merged.append(s)
        made[id(node)] = [node.kind, merged]
    return made[id(root)]


def flat(shape: list) -> list[tuple[str, int]]:
    """A skeleton as (kind, number of children), top down: what is stored of it."""
    out, stack = [], [shape]
    while stack:
        kind, children = stack.pop()
        out.append((kind, len(children)))
        stack.extend(reversed(children))
    return out


def nested(rows: list) -> list:
    """The skeleton that flat() gave."""
    root: list = ["", []]
    open_nodes = [(root, 1)]
    for kind, n in rows:
        while not open_nodes[-1][1]:
            open_nodes.pop()
        parent, left = open_nodes[-1]
        open_nodes[-1] = parent, left - 1
        node = [kind, []]
        parent[1].append(node)
        open_nodes.append((node, n))
    return root[1][0]


def union(a: list, b: list) -> list:
    """Children of a list node: those of all its members, in order, each kind once."""
    out = [[k, list(c)] for k, c in a]
    stack = [(out, b)]
    while stack:
        mine, others = stack.pop()
        by_kind = {}
        for node in mine:
            by_kind.setdefault(node[0], node)
        for k, c in others:
            if (same := by_kind.get(k)) is None:
                by_kind[k] = node = [k, list(c)]
                mine.append(node)
            else:
                same[1] = [[k2, list(c2)] for k2, c2 in same[1]]
                stack.append((same[1], c))
    return out


class Shape:
    """A skeleton's kinds, order and ancestry: equal trees are one Shape."""

    __slots__ = ("kind", "children", "size")

    def __init__(self, kind: str, children: tuple[Shape, ...]):
        self.kind, self.children = kind, children
        self.size = 1 + sum(c.size for c in children)


def _shapes(root: list, memo: dict) -> dict[int, Shape]:
    """id of every node of a skeleton -> its shape. memo: the shapes made so far, by kind and children."""
    order, stack, made = [], [root], {}
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(node[1])
    for node in reversed(order):
        key = node[0], tuple(made[id(c)] for c in node[1])
        if (shape := memo.get(key)) is None:
            memo[key] = shape = Shape(*key)
        made[id(node)] = shape
    return made


def _alike(a: Sequence[Shape], b: Sequence[Shape]) -> int:
    """How many first children are the same. No other mapping of them has more nodes, and the way back through a whole table
    would end in it, since it leaves out later children first."""
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x is not y), min(len(a), len(b)))


def _places(b: Sequence[Shape]) -> dict[str, dict[Shape, np.ndarray]]:
    """Where the shapes of each kind stand."""
    out: dict[str, dict[Shape, list[int]]] = {}
    for j, y in enumerate(b):
        out.setdefault(y.kind, {}).setdefault(y, []).append(j)
    return {kind: {y: np.array(at) for y, at in same.items()} for kind, same in out.items()}


def _next_row(last: np.ndarray, x: Shape, places: dict[str, dict[Shape, np.ndarray]]) -> Generator:
    """Nodes mapped at most between some children, of which x is the last, and the first j others; last: the same without x.
    Asks for what pairs of shapes have in common."""
    same = places.get(x.kind)
    if same is None:
        return last
    w = np.zeros(len(last) - 1, np.int32)
    for y, at in same.items():
        w[at] = x.size if x is y else 1 if not (x.children and y.children) else (yield x, y)
    row = last.copy()
    np.maximum(last[1:], last[:-1] + w, out=row[1:])
    return np.maximum.accumulate(row)


def _mapped_nodes(x: Shape, y: Shape) -> Generator:
    """How many nodes of two shapes of one kind can be mapped."""
    n = _alike(x.children, y.children)
    a, b = x.children[n:], y.children[n:]
    row, places = np.zeros(len(b) + 1, np.int32), _places(b)
    for c in a:
        row = yield from _next_row(row, c, places)
    return 1 + sum(c.size for c in x.children[:n]) + int(row[-1])


def _mapped_children(p: Sequence[Shape], q: Sequence[Shape]) -> Generator:
    """Which children are mapped on which, by their numbers; of mappings with as many nodes the one that leaves out later children
    of p, then of q. Rows on the way back are worked out again from the last one that was kept."""
    n = _alike(p, q)
    a, b, out = p[n:], q[n:], [(i, i) for i in range(n)]
    step, places = isqrt(len(a)) + 1, _places(b)
    kept = [np.zeros(len(b) + 1, np.int32)]
    i, j = len(a), len(b)
    row = kept[0]
    for k in range(i - i % step if j else 0):
        row = yield from _next_row(row, a[k], places)
        if (k + 1) % step == 0:
            kept.append(row)
    while i and j:
        first = (i - 1) // step * step
        rows = [kept[first // step]]
        for x in a[first:i]:
            rows.append((yield from _next_row(rows[-1], x, places)))
        while i > first and j:
            row, above = rows[i - first], rows[i - first - 1]
            if row[j] != above[j]:
                j = int(np.searchsorted(row, row[j])) - 1
                out.append((n + i - 1, n + j))
            i -= 1
    return out


def _answered(work: Generator, known: dict):
    """The result of work, whose questions for pairs of shapes are answered from known or worked out, at any depth."""
    stack, pairs, value = [work], [None], None
    while stack:
        try:
            pair = stack[-1].send(value)
        except StopIteration as done:
            stack.pop()
            value = done.value
            if (pair := pairs.pop()) is not None:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[pair] = value
            continue
        if (value := known.get(pair)) is None:
            stack.append(_mapped_nodes(*pair))
            pairs.append(pair)
    return value


def match(a: list, b: list, memo: dict) -> int:
    """Simple tree matching: nodes of a that can be mapped on b, keeping order and ancestry."""
    x, y = (_shapes(node, memo)[id(node)] for node in (a, b))
    return _answered(_mapped_nodes(x, y), {}) if x.kind == y.kind else 0


def align(a: list, b: list, memo: dict, out: dict) -> None:
    """The mapping behind match(): id of a's nodes -> place in b (the number of the node there, top down)."""
    number, stack = {}, [b]
    while stack:
        node = stack.pop()
        number[id(node)] = len(number)
        stack.extend(reversed(node[1]))
    mine, others, known = _shapes(a, memo), _shapes(b, memo), {}
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        out[id(x)] = number[id(y)]
        p, q = x[1], y[1]
        stack.extend((p[i], q[j]) for i, j in _answered(_mapped_children([mine[id(c)] for c in p], [others[id(c)] for c in q]), known))


def blocks(page: str, reference: list | None) -> list[tuple[str, str, bool, bool]]:
    """(place, text, kept by structure, in a marked article) of every text block of the page that isn't in a dropped
    element, in order. The place is that of the reference node matched, or the path of kinds (its check sum) where none is."""
    root = Builder(page).root
    weigh(root)
    shape = skeleton(root)
    places: dict[int, int] = {}
    if reference is not None:
        align(shape, reference, {}, places)
    found: list[tuple[Node, str, bool, bool]] = []
    stack = [(root, shape, 0, False, False)]  # node, list node, check sum of the path, in an article, in a main element
    while stack:
        node, part, path, article, main = stack.pop()
        path = zlib.crc32(node.kind.encode("utf-8", "surrogatepass"), path)
        if node.text is not None:
            at = places.get(id(part))
            found.append((node, f"?{path}" if at is None else str(at), article, main))
            continue
        if node.dropped:
            continue
        article, main = article or node.tag == "article", main or node.tag == "main"
        it, below = 0, []
        last: dict[str, int] = {}
        for k, (kind, _) in enumerate(part[1]):
            last[kind] = k
        for c in node.children:
            # the list node of a child: children were merged in order, by kind
            k = next((k for k in range(it, last[c.kind] + 1) if part[1][k][0] == c.kind), None)
            if k is None:
                k = next(k for k in range(len(part[1])) if part[1][k][0] == c.kind)
            it = k
            below.append((c, part[1][k], path, article, main))
        stack.extend(reversed(below))
    marked = 2 if any(f[2] for f in found) else 3
    if not any(f[marked] for f in found):
        marked = 0
    out = []
    for row in found:
        node, place = row[:2]
        inside = not marked or row[marked]
        menu = not marked and node.linked >= LINKS * len(node.text) and node.linked > 0
        out.append((place, node.text, inside and not menu, bool(marked) and inside))
    return out


@lru_cache(256)
def _reference(raw: str) -> list:
    return nested(json.loads(raw))


def _host(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _copies(texts: DataFrame) -> DataFrame:
    """Stored (content, component) of a host's contents that share more than half of the characters of both with another.
    texts: host, content, key and size of its different texts. Every text is led by the host's smallest content that
    holds it, and a content is held against its leaders only, so the work grows with the texts."""
    leads = texts.groupBy("host", "key").agg(F.min("content").alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = texts.join(leads, ["host", "key"]).filter("content <> lead").groupBy("content", "lead").agg(F.sum("size").alias("shared"))
    totals = texts.groupBy("content").agg(F.sum("size").alias("total"))
    near = shared.join(totals, "content").filter("2 * shared > total").select("content", "lead", "shared")
    near = near.join(totals.withColumnRenamed("content", "lead"), "lead").filter("2 * shared > total").select(F.col("content").alias("a"), F.col("lead").alias("b"))
    return connected_components(near).withColumnRenamed("node", "content")


def extract(pages: DataFrame, constant: float = CONSTANT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, host, text (content blocks joined by blank lines) and template (texts left out as template)."""
    source = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("host", _host(F.col("url")))
    # the host's reference page: found by id first, so that no html is gathered by host
    html_hash = F.xxhash64("html")
    first = source.groupBy("host").agg(F.min(F.struct("page_id", html_hash.alias("hash"))).alias("f")).select("host", F.col("f.page_id").alias("first_id"), F.col("f.hash").alias("first_hash"))
    first = store(first, "first")
    chosen = F.broadcast(first) if small(first) else first
    refs = source.join(chosen, "host").filter(F.col("page_id").eqNullSafe(F.col("first_id")) & (html_hash == F.col("first_hash"))).select("host", "html").dropDuplicates(["host"])
    ref_schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("reference", T.StringType())])

    def to_reference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [json.dumps(flat(skeleton(Builder(h).root))) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=ref_schema.names)

    references = store(refs.mapInArrow(tidied(to_reference), ref_schema), "references")
    references = F.broadcast(references) if small(references) else references
    block = T.StructType([T.StructField("slot", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kept", T.BooleanType()), T.StructField("marked", T.BooleanType())])
    schema = T.StructType(
        [pages.schema["page_id"], T.StructField("url", pages.schema["url"].dataType), T.StructField("host", T.StringType()), T.StructField("digest", T.LongType()), T.StructField("blocks", T.ArrayType(block))]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    digest8 = lambda s: int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, hosts, texts, refs = batch.columns
            texts, refs = texts.to_pylist(), refs.to_pylist()
            begin, held, made, digests = 0, 0, [], []
            for i, page in enumerate(texts):
                found = blocks(page, _reference(refs[i]) if refs[i] else None) if page else []
                made.append([{"slot": digest8(place + "\0" + text), "text": text, "kept": kept, "marked": marked} for place, text, kept, marked in found])
                digests.append(digest8("\0".join(text for _, text, kept, _ in found if kept)))
                held += len(page)
                if held > 4 << 20 or i == len(texts) - 1:
                    n = i + 1 - begin
                    yield pa.RecordBatch.from_arrays([ids.slice(begin, n), urls.slice(begin, n), hosts.slice(begin, n), pa.array(digests, pa.int64()), pa.array(made, out.field(4).type)], schema=out)
                    begin, held, made, digests = i + 1, 0, [], []

    parsed = store(source.join(references, "host", "left").select("page_id", "url", "host", "html", "reference").mapInArrow(tidied(run), schema), "blocks")
    # different contents of a host, and in how many of them each (place, text) stands
    kept = F.filter("blocks", lambda b: b["kept"])
    contents = parsed.withColumn("content", F.xxhash64("host", "digest"))
    same = _copies(contents.select("host", "content", F.explode(F.array_distinct(F.transform(kept, lambda b: F.struct(F.xxhash64(b["text"]).alias("key"), F.char_length(b["text"]).alias("size"))))).alias("t")).select("host", "content", "t.*").distinct())
    same = F.broadcast(same) if small(same) else same
    counted = lambda rows: rows.distinct().join(same, "content", "left").withColumn("content", F.coalesce("component", "content")).drop("component").distinct()
    different = counted(contents.select("host", "content")).groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min(UNANIMOUS, least_pages))
    slots = counted(contents.select("host", "content", F.explode(F.array_distinct(F.transform(kept, lambda b: b["slot"]))).alias("slot"))).groupBy("host", "slot").agg(F.count("*").alias("n")).filter(F.col("n") >= 2)
    fixed = slots.join(different, "host").filter(F.col("n") >= F.when(F.col("pages") >= least_pages, constant * F.col("pages")).otherwise(F.col("pages"))).groupBy("host").agg(F.collect_list("slot").alias("fixed"))
    fixed = store(fixed, "fixed")  # a page holds few such slots, and each is in most pages of its host
    fixed = F.broadcast(fixed) if small(fixed) else fixed
    joined = parsed.join(fixed, "host", "left").withColumn("fixed", F.coalesce("fixed", F.array().cast("array<bigint>")))
    size = lambda pred: F.aggregate(F.filter("blocks", lambda b: b["marked"] & pred(b)), F.lit(0), lambda n, b: n + F.char_length(b["text"]))
    in_fixed = lambda b: F.array_contains(F.col("fixed"), b["slot"])
    joined = joined.withColumn("larger", (F.size("fixed") > 0) & (2 * size(in_fixed) > size(lambda b: b["kept"])))
    is_fixed = lambda b: in_fixed(b) & ~(b["marked"] & F.col("larger"))
    content = F.filter("blocks", lambda b: b["kept"] & ~is_fixed(b))
    template = F.filter("blocks", lambda b: b["kept"] & is_fixed(b))
    return joined.select("page_id", "url", "host", F.array_join(F.transform(content, lambda b: b["text"]), "\n\n").alias("text"), F.transform(template, lambda b: b["text"]).alias("template"))


def main_text(pages: DataFrame) -> DataFrame:
    """op7: the main text of every page and its length in code points."""
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
