"""Main text of web pages by wrapper induction.

Of each host up to three pages, those with the smallest hashes of their html, are
references; a page goes with the first reference that shares most of its element paths. Its
tree is aligned with that reference by simple tree matching, so each of its texts belongs to
a slot, the place of an element in the reference. Over the host's distinct pages (copies of
a page count once) the texts of each slot are counted. From these counts a wrapper is made:

* A text that stands in one slot on `least` pages and on `share` of the pages is a constant
  node, which is template. (Not on pages of whose region it would take more than half:
  these are near copies of each other, not a template.)
* The other texts are varying slots. The region is the innermost container that holds
  three fifths of the varying words outside links, at every step down from the root; it is
  what a page's content is read from. A page's title before it (h1) belongs to it.

Names decide where slots can't: of containers on one line with the region, that which the
page marks as its article is taken; within it, elements whose tag or role says menu, footer,
sidebar, form or dialog are left out, and those whose whole class or id does (`ad`, `comments`,
`cookie`), as these vary from page to page like the content does. Other names (`notice`,
`related-work`, `side-effects`) only count where the element is links or controls. Pages of hosts with fewer than `least`
distinct pages, or without the region, are read by their marks alone.

Edge cases: null or empty html gives an empty text; a page without url has its own
(null) host; broken markup is read as far as it goes, in any depth and length; repeated
pages are aligned alike; an empty table gives an empty result; other columns are not read.
A host with a third of all pages is pre-aggregated before the shuffles, whose keys hold
the texts' hashes too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store, table
from .dom import BLOCKS, RAW, Node, match, parse, text_of
from .url_filter import host_of

_SKIP_TAGS = RAW - {"title"} | {"title", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "input", "object", "audio", "video", "canvas"}
_SKIP_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
_SKIP_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|sidebar|side|cookies?|consent|gdpr|notices?|alert|banner|popup|modal|overlay|comments?|commentlist|disqus|repl(?:y|ies)|respond|nav|navbar|navigation|menu|breadcrumbs?|footer|header|masthead|share|sharing|social|newsletter|subscribe|subscription|signup|login|related|recommend\w*|widget|pagination|pager|toolbar|skip-link|copyright)(?:$|[\s_-]|\d)", re.I)
#: Whole names that mean no content wherever they stand. Within an article other names only count where the element's shape agrees.
_SURE_NAMES = frozenset("ad ads advert adverts advertisement adsense sponsor sponsored promo sidebar cookie cookies consent gdpr popup modal overlay comments commentlist comment-list disqus respond nav navbar navigation menu breadcrumb breadcrumbs pagination pager share sharing social newsletter subscribe signup login toolbar skip-link masthead".split())
_MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article-?(?:body|content|text)|post-?(?:body|content)|entry-?content|main-?content|story-?body)(?:$|[\s_-])", re.I)
#: Wrappers up to this many characters of reference trees are sent to the executors; beyond it they are joined.
BROADCAST_CHARS = 32 << 20
REFERENCES, LEAST, SHARE, PART = 3, 3, 0.3, 0.6
_CONTAINERS = frozenset("article main section div center".split())


class _Shapes:
    """Of each element of a page the words, those in links, and whether it has a control; counted once, when first asked for."""

    def __init__(self, page: Node) -> None:
        self.page = page
        self.of: dict[int, list[int]] | None = None

    def unlike_content(self, node: Node) -> bool:
        """Links, or something to fill in or press, rather than text."""
        if self.of is None:
            each = list(_elements(self.page))
            self.of, linked = {}, set()
            for x in each:
                if x.tag == "a" or x.up is not None and id(x.up) in linked:
                    linked.add(id(x))
                n = 0 if x.tag in RAW else len(_own_text(x).split())
                self.of[id(x)] = [n, n if id(x) in linked else 0, int(x.tag in ("form", "input", "button", "select", "textarea"))]
            for x in reversed(each):  # children come after their parents
                if x is not self.page:
                    up = self.of[id(x.up)]
                    for k, v in enumerate(self.of[id(x)]):
                        up[k] += v
        words, links, controls = self.of[id(node)]
        return controls > 0 or 2 * links >= words


def _dropped(node: Node, inside: bool, shapes: _Shapes | None = None) -> bool:
    """inside: within an element that is marked as article, where a header is a title's. shapes: given within
    what the page is read from, where a name alone does not drop text."""
    if node.tag in _SKIP_TAGS or (node.tag == "header" and not inside):
        return True
    a = node.attrs
    if not a:
        return False
    if a.get("role", "").lower() in _SKIP_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    names = f"{a.get('class', '')} {a.get('id', '')}"
    if inside and node.tag == "header":
        return False
    if not _SKIP_NAMES.search(names) or _MAIN_NAMES.search(names):
        return False
    return shapes is None or not _SURE_NAMES.isdisjoint(names.lower().split()) or shapes.unlike_content(node)


def _is_article(x: Node) -> bool:
    return x.tag == "article" or x.attrs.get("itemprop", "").lower() == "articlebody"


def _is_main(x: Node) -> bool:
    return x.tag == "main" or x.attrs.get("role", "").lower() == "main"


def _is_named(x: Node) -> bool:
    return bool(x.attrs) and bool(_MAIN_NAMES.search(f"{x.attrs.get('class', '')} {x.attrs.get('id', '')}"))


_MARKS = (_is_article, _is_main, _is_named)


def _marked(root: Node) -> list[Node]:
    """The elements that a page marks as its article, outermost ones."""
    for test in _MARKS:
        out, todo = [], [root]
        while todo:
            x = todo.pop()
            if x is not root and test(x):
                out.append(x)
            elif x is root or not _dropped(x, False):
                todo.extend(k for k in reversed(x.kids) if isinstance(k, Node))
        if out:
            return out
    return [root]


def _elements(root: Node) -> Iterator[Node]:
    """In document order."""
    todo = [root]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(k for k in reversed(x.kids) if isinstance(k, Node))


def _own_text(node: Node) -> str:
    return " ".join(t for k in node.kids if isinstance(k, str) and (t := text_of(k)))


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _paths(root: Node) -> set[int]:
    """Hashes of the ways of tags from the root to each element."""
    at = {id(root): hash(("html",))}
    for x in _elements(root):
        for k in x.kids:
            if isinstance(k, Node):
                at[id(k)] = hash((at[id(x)], k.label))
    return set(at.values())


class _Reference:
    def __init__(self, source: str) -> None:
        self.tree = parse(source)
        self.elements = list(_elements(self.tree))
        self.places = {id(x): i for i, x in enumerate(self.elements)}
        self.paths = _paths(self.tree)


class _References:
    """The last few reference trees that a task has parsed."""

    def __init__(self) -> None:
        self.kept: dict[str, _Reference] = {}

    def get(self, source: str) -> _Reference:
        if source not in self.kept:
            if len(self.kept) >= 256:
                self.kept.clear()
            self.kept[source] = _Reference(source)
        return self.kept[source]

    def best(self, page: Node, sources: list[str]) -> tuple[int, _Reference]:
        """The first reference that shares three fifths of the paths, else the one that shares most."""
        mine, scores = _paths(page), []
        for i, source in enumerate(sources):
            other = self.get(source).paths
            scores.append(len(mine & other) / len(mine | other))
            if scores[-1] >= PART:
                return i, self.get(source)
        i = max(range(len(sources)), key=lambda k: scores[k])
        return i, self.get(sources[i])


def aligned(page: Node, reference: _Reference) -> dict[int, Node]:
    """The page's element for each slot."""
    found: dict[int, Node] = {}
    match(page, reference.tree, found)
    return {reference.places[id(found[id(x)])]: x for x in _elements(page) if id(x) in found}


def slot_texts(elements: dict[int, Node]) -> Iterator[tuple[int, Node, str]]:
    """slot, element, text for the aligned elements that have text of their own."""
    for slot, x in elements.items():
        if x.tag not in RAW and (t := _own_text(x)):
            yield slot, x, t


def region(reference: _Reference, weights: dict[int, float]) -> int:
    """The slot of the innermost container that holds most of the varying words outside links."""
    total, linked = [0.0] * len(reference.elements), set()
    for i, x in enumerate(reference.elements):
        if x.tag == "a" or (x.up is not None and id(x.up) in linked):
            linked.add(id(x))
        elif x.tag not in RAW:
            total[i] = weights.get(i, 0.0)
    for i in range(len(reference.elements) - 1, 0, -1):  # children come after their parents
        total[reference.places[id(reference.elements[i].up)]] += total[i]
    here = 0
    while True:
        kids = [reference.places[id(k)] for k in reference.elements[here].kids if isinstance(k, Node) and k.tag in _CONTAINERS]
        down = max(kids, key=lambda k: (total[k], -k), default=None)
        if down is None or not total[down] or total[down] < PART * total[here]:
            return here
        here = down


def _within(x: Node | None, top: Node) -> bool:
    while x is not None and x is not top:
        x = x.up
    return x is top


def _size(root: Node) -> int:
    return sum(len(_own_text(x).split()) for x in _elements(root) if x.tag not in RAW)


def content(page: Node, chosen: Node | None, marks: bool = True) -> list[Node]:
    """Where a page's text is read from, given its element for the wrapper's region."""
    marked = _marked(page) if marks else [page]
    if chosen is None:
        return marked
    if marked != [page]:
        line = [x for x in marked if _within(chosen, x) or _within(x, chosen)]
        if line or 2 * _size(chosen) < sum(map(_size, marked)):
            return line or marked
    titles = [x for x in _elements(page) if x.tag == "h1"]
    return [titles[0], chosen] if len(titles) == 1 and not _within(titles[0], chosen) and not (marks and _dropped(titles[0], False)) else [chosen]


def main_text(page: Node, constant: set[int], tops: list[Node] | None = None, marks: bool = True) -> str:
    """constant: identities of elements whose own text is template. tops: the elements to read."""
    blocks: list[list[str]] = [[]]
    shapes = _Shapes(page)

    def walk(node: Node, inside: bool) -> None:
        stack: list[tuple[Node | str | None, bool, bool]] = [(node, inside, False)]
        while stack:
            x, within, still = stack.pop()
            if x is None:
                blocks.append([])
            elif isinstance(x, str):
                if not still:
                    blocks[-1].append(x)
            elif x.tag == "br":
                blocks[-1].append(" ")
            elif x is node or (not _dropped(x, within, None if node is page else shapes) if marks else x.tag not in RAW):
                if x.tag in BLOCKS:
                    blocks.append([])
                    stack.append((None, False, False))
                within = within or x.tag == "article"
                quiet = id(x) in constant
                stack.extend((k, within, quiet) for k in reversed(x.kids))

    for top in _marked(page) if tops is None else tops:
        blocks.append([])
        walk(top, top.tag == "article")
    return " ".join(t for b in blocks if b and (t := text_of("".join(b))))


def _no_template(tops: list[Node], constant: set[int]) -> bool:
    """Whether constants would take more than half of the words that the page is read for."""
    each = [(id(x) in constant, len(_own_text(x).split())) for top in tops for x in _elements(top) if x.tag not in RAW]
    return 2 * sum(n for fixed, n in each if fixed) > sum(n for _, n in each)


def references(pages: DataFrame) -> DataFrame:
    """host, refs: of each host up to REFERENCES distinct pages, those with the smallest hash
    of their html among equal remainders of it."""
    h = F.xxhash64("html")
    some = pages.filter("html IS NOT NULL").select("host", F.pmod(h, F.lit(REFERENCES)).alias("k"), F.struct(h.alias("h"), F.col("html").alias("ref")).alias("r"))
    each = some.groupBy("host", "k").agg(F.min("r").alias("r"))
    return each.groupBy("host").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["ref"]).alias("refs"))


def _joined(pages: DataFrame, wrappers: DataFrame, *columns: str) -> DataFrame:
    size = wrappers.agg(F.sum(F.aggregate("refs", F.lit(0).cast("long"), lambda a, r: a + F.length(r)))).first()[0] or 0
    right = (F.broadcast(wrappers) if size <= BROADCAST_CHARS else wrappers).alias("w")
    return pages.alias("p").join(right, F.col("p.host").eqNullSafe(F.col("w.host")), "left").select("p.*", *[f"w.{c}" for c in columns])


def slot_counts(pages: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """pages: host, html, refs. host, slots: of each host an array of (ref, slot, words, fixed): the
    varying words of a page in this slot, and the hash of the slot's constant text or null; slot
    -1 has the number of the reference's distinct pages as words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _References()
        for batch in batches:
            seen: list[tuple] = []
            for host, page, refs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if page and refs:
                    tree, digest = parse(page), _hash(page)
                    k, reference = trees.best(tree, refs)
                    seen.append((host, digest, k, -1, 0, 1))
                    seen.extend((host, digest, k, slot, _hash(t), t.count(" ") + 1) for slot, _, t in slot_texts(aligned(tree, reference)))
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], kind) for i, kind in enumerate(kinds)], names=["host", "digest", "ref", "slot", "th", "words"])

    each = pages.select("host", "html", "refs").mapInArrow(run, "host string, digest long, ref int, slot int, th long, words long")
    texts = each.distinct().groupBy("host", "ref", "slot", "th", "words").agg(F.count("*").alias("n"))
    slots = texts.groupBy("host", "ref", "slot").agg(F.sum(F.col("n") * F.col("words")).alias("words"), F.max(F.struct("n", "th", "words")).alias("top"))
    slots = store(slots, "pages-slots")
    whole = slots.filter("slot = -1").select("host", "ref", F.col("words").alias("pages")).alias("w")
    same = F.col("s.host").eqNullSafe(F.col("w.host")) & (F.col("s.ref") == F.col("w.ref"))
    constant = (F.col("slot") >= 0) & (F.col("top.n") >= least) & (F.col("top.n") >= share * F.col("pages"))
    left = F.col("words") - F.when(constant, F.col("top.n") * F.col("top.words")).otherwise(0)
    rated = slots.alias("s").join(whole, same).select("s.host", F.struct(F.col("s.ref"), "slot", left.alias("words"), F.when(constant, F.col("top.th")).alias("fixed")).alias("x"))
    return rated.groupBy("host").agg(F.collect_list("x").alias("slots"))  # bounded by the elements of a host's references


class _Wrapper:
    """What a host's slots say of one reference."""

    def __init__(self, reference: _Reference, slots: list[dict], least: int) -> None:
        pages = sum(s["words"] for s in slots if s["slot"] < 0)
        self.fixed = {s["slot"]: s["fixed"] for s in slots if s["fixed"] is not None}
        self.region = region(reference, {s["slot"]: s["words"] / pages for s in slots if s["slot"] >= 0}) if pages >= least else None


def extract(pages: DataFrame, least: int = LEAST, share: float = SHARE, marks: bool = True) -> DataFrame:
    """pages: page_id, url, html. Returns page_id, url, text. Without marks, slots alone decide."""
    p = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    refs = store(references(p), "pages-references")
    slots = store(slot_counts(_joined(p, refs, "refs"), least, share), "pages-templates")
    wrappers = refs.alias("r").join(slots.alias("f"), F.col("r.host").eqNullSafe(F.col("f.host")), "left").select("r.host", "refs", "slots")
    joined = _joined(p, store(wrappers, "pages-wrappers"), "refs", "slots").select("page_id", "url", "host", "html", "refs", "slots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, made = _References(), {}
        for batch in batches:
            texts = []
            for at, (host, page) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                tree, constant, chosen = parse(page or ""), set(), None
                if page and batch.column(4)[at].is_valid:
                    k, reference = trees.best(tree, batch.column(4)[at].as_py())
                    if (host, k) not in made:
                        if len(made) >= 256:
                            made.clear()
                        made[host, k] = _Wrapper(reference, [s for s in batch.column(5)[at].as_py() or () if s["ref"] == k], least)
                    wrapper = made[host, k]
                    if wrapper.region is not None:
                        elements = aligned(tree, reference)
                        some = {slot: x for slot, x in elements.items() if slot in wrapper.fixed}
                        constant = {id(x) for slot, x, t in slot_texts(some) if wrapper.fixed[slot] == _hash(t)}
                        chosen = elements.get(wrapper.region)
                tops = content(tree, chosen, marks)
                texts.append(main_text(tree, set() if constant and _no_template(tops, constant) else constant, tops, marks))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    schema = p.select("page_id", "url", F.lit("").alias("text")).schema
    return joined.mapInArrow(run, schema)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
