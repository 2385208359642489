"""A small, forgiving HTML tree and simple tree matching."""

from __future__ import annotations

import html
import math
import re
from itertools import product

import numpy as np

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe"))
#: Elements that begin and end a block of text; others run on within it.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: A start tag of a key closes an open element of the value's tags, up to the nearest container.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+(?=>)|[^>]*)>""", re.S)
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


class Node:
    __slots__ = ("tag", "attrs", "kids", "up", "label")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None) -> None:
        self.tag, self.attrs, self.up = tag, attrs, up
        self.kids: list[Node | str] = []
        self.label = tag + "." + attrs.get("class", "") if attrs else tag


class _Builder:
    """Where a parse stands, with the number of open elements of each tag, so that an end
    tag without a start costs nothing however deep the markup is."""

    def __init__(self) -> None:
        self.root = self.here = Node("html", {}, None)
        self.open: dict[str, int] = {}

    def leave(self, upto: Node) -> None:
        """Closes what is open up to and with upto."""
        while True:
            x, self.here = self.here, self.here.up
            self.open[x.tag] -= 1
            if x is upto:
                return

    def end(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        node = self.here
        while node.tag != tag:
            if tag not in BLOCKS and node.tag in BLOCKS:  # an inline end tag does not close the blocks around it
                return
            node = node.up
        self.leave(node)

    def make_room(self, tag: str) -> None:
        """Closes what a start tag ends without saying so."""
        node, last = self.here, None
        if tag in _CLOSES:
            if not any(self.open.get(t) for t in _CLOSES[tag]):
                return
            while node is not self.root and node.tag not in _HOLDS[tag]:
                if node.tag in _CLOSES[tag]:
                    last = node
                node = node.up
        elif tag in BLOCKS and self.open.get("p"):  # a block ends an open paragraph and what is open in it
            while node is not self.root and node.tag not in BLOCKS:
                node = node.up
            last = node if node.tag == "p" else None
        if last is not None:
            self.leave(last)

    def start(self, tag: str, attrs: dict[str, str], leaf: bool) -> None:
        self.make_room(tag)
        node = Node(tag, attrs, self.here)
        self.here.kids.append(node)
        if not leaf:
            self.here = node
            self.open[tag] = self.open.get(tag, 0) + 1


def parse(source: str) -> Node:
    build, at, n, last = _Builder(), 0, len(source), source.rfind(">")
    while at < n:
        m = _TOKEN.search(source, at) if at <= last or source.find("<!", at) >= 0 else None
        text = source[at : m.start()] if m else source[at:]
        if text:
            build.here.kids.append(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, rest = m[2].lower(), m[3]
        if m[1]:
            build.end(tag)
        elif tag == "body":
            while build.here is not build.root:
                build.leave(build.here)
        elif tag not in ("html", "head"):
            attrs = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(rest)} if rest and not rest.isspace() else {}
            build.start(tag, attrs, tag in RAW or tag in VOID or rest.endswith("/"))
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = end.end() if end else n
    return build.root


def text_of(raw: str) -> str:
    return " ".join((html.unescape(raw) if "&" in raw else raw).split())


def _elements(node: Node) -> list[Node]:
    return [k for k in node.kids if isinstance(k, Node)]


class _Shapes:
    """Numbers for trees of equal labels, so that the match of two shapes is worked out once."""

    def __init__(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.of: dict[int, int] = {}
        self.weights: dict[tuple[int, int], int] = {}

    def __call__(self, node: Node) -> int:
        todo = [node]
        while todo:
            x = todo[-1]
            if id(x) not in self.of:
                kids = _elements(x)
                if missing := [k for k in kids if id(k) not in self.of]:
                    todo.extend(missing)
                    continue
                self.of[id(x)] = self.ids.setdefault((x.label, *(self.of[id(k)] for k in kids)), len(self.ids))
            todo.pop()
        return self.of[id(node)]

    def weight(self, a: Node, b: Node) -> int:
        """What match(a, b) returns. Weights of children are worked out first, on a list of our
        own, so that the depth of the markup is no bound."""
        todo = [(a, b)]
        while todo:
            p, q = todo[-1]
            key = self(p), self(q)
            if p.label != q.label or key in self.weights:
                todo.pop()
                continue
            x, y = _elements(p), _elements(q)
            if [k.label for k in x] == [k.label for k in y]:
                needed = zip(x, y)
            else:
                needed = product({self(k): k for k in x}.values(), {self(k): k for k in y}.values())
            missing = [(k, l) for k, l in needed if k.label == l.label and (self(k), self(l)) not in self.weights]
            if missing:
                todo.extend(missing)
                continue
            self.weights[key] = 1 + sum(self.weights[self(k), self(l)] for k, l in _aligned(x, y, self))
        return self.weights[self(a), self(b)] if a.label == b.label else 0


def _aligned(x: list[Node], y: list[Node], shapes: _Shapes) -> list[tuple[Node, Node]]:
    """The pairs of the heaviest order-preserving match, at any length. Rows of the table are
    kept at every `step`-th and made again on the way back, so memory grows with n ** 1.5."""
    if not x or not y:
        return []
    if [k.label for k in x] == [k.label for k in y]:
        return list(zip(x, y))
    n, m, out = len(x), len(y), []
    while n and m and shapes(x[n - 1]) == shapes(y[m - 1]):  # a whole tree each: no other partner is heavier
        n, m = n - 1, m - 1
        out.append((x[n], y[m]))
    if not n or not m:
        return out
    place: dict[int, int] = {}
    column = np.array([place.setdefault(shapes(q), len(place)) for q in y[:m]])
    kinds = list({shapes(q): q for q in y[:m]}.values())
    weights: dict[int, np.ndarray] = {}
    for p in x[:n]:
        if shapes(p) not in weights:
            weights[shapes(p)] = np.array([shapes.weight(p, q) for q in kinds], np.int64)

    def after(row: np.ndarray, i: int) -> np.ndarray:
        new = row.copy()
        np.maximum(row[1:], row[:-1] + weights[shapes(x[i])][column], out=new[1:])
        return np.maximum.accumulate(new)

    step = math.isqrt(n) + 1
    row, kept = np.zeros(m + 1, np.int64), []
    for i in range(n):
        if i % step == 0:
            kept.append(row)
        row = after(row, i)
    i, j = n, m
    while i and j:
        first = (i - 1) // step * step
        rows = [kept[first // step]]
        for k in range(first, i):
            rows.append(after(rows[-1], k))
        while i > first and j:
            here, above = rows[i - first], rows[i - 1 - first]
            w = weights[shapes(x[i - 1])][column[j - 1]]
            if w and here[j] == above[j - 1] + w:
                i, j = i - 1, j - 1
                out.append((x[i], y[j]))
            elif here[j] == above[j]:
                i -= 1
            else:
                j -= 1
    return out


def match(a: Node, b: Node, found: dict[int, Node], shapes: _Shapes | None = None) -> int:
    """Simple tree matching: the size of the largest order-preserving match of equal labels.
    found gets, for nodes of a by identity, the node of b that each is aligned with. Children
    whose labels agree one by one are paired in order. Trees may be of any depth."""
    shapes, todo, size = shapes or _Shapes(), [(a, b)] if a.label == b.label else [], 0
    while todo:
        p, q = todo.pop()
        found[id(p)] = q
        size += 1
        todo.extend(_aligned(_elements(p), _elements(q), shapes))
    return size
