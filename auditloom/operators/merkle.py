"""A digest of very many entries as a tree, none of whose nodes needs them all.

An entry lies at the place that a digest of 64 hexadecimal digits gives it. Entries with the
same six first digits are a bucket; buckets with the same four are a node, these with the
same two another, and all of them the root. A node's digest is SHA-256 over its children,
`place:digest` in order, with commas between. Places are digests, so a bucket has one
entry in 16 million, and a node 256 children at most, whatever the table: no step has an order over all
rows, each is one aggregate with a shuffle by prefix. Equal entries are counted
first, so a row that is repeated very often is one leaf.

Two trees are compared from the root down, and only buckets that differ are opened. A
proof shows by four lists of children that an entry is in a root, without the other entries.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Digits of the places of buckets, nodes and root.
DEPTHS = (6, 4, 2, 0)


@dataclass(frozen=True)
class Tree:
    """leaves: keys, place, entry, copies, digest. nodes: keys, depth, prefix, entries, children, digest."""

    keys: tuple[str, ...]
    leaves: DataFrame
    nodes: DataFrame

    def stored(self) -> Tree:
        """The same tree, written once, so that comparisons read only the nodes that they open."""
        return Tree(self.keys, stored(self.leaves, "tree-leaves"), stored(self.nodes, "tree-nodes"))

    def roots(self) -> DataFrame:
        return self.nodes.filter("depth = 0").select(*self.keys, "entries", F.col("digest").alias("root"))


def _node(below: DataFrame, keys: tuple[str, ...], depth: int, child: str, entries: Column) -> DataFrame:
    line = F.concat(F.col(child), F.lit(":"), F.col("digest"))
    up = below.groupBy(*keys, F.substring(child, 1, depth).alias("prefix")).agg(entries.alias("entries"), F.array_join(F.sort_array(F.collect_list(line)), ",").alias("children"))
    return up.select(*keys, F.lit(depth).alias("depth"), "prefix", "entries", "children", F.sha2("children", 256).alias("digest"))


def tree(rows: DataFrame, *keys: str, entry: Column | str = "id", place: Column | None = None) -> Tree:
    """One tree for each value of keys. place: 64 hexadecimal digits; the entry's SHA-256 by default. A
    null entry counts as the empty text. Keys without rows have no tree."""
    entry = F.coalesce(F.col(entry) if isinstance(entry, str) else entry, F.lit(""))
    at = F.sha2(entry, 256) if place is None else place
    leaves = rows.groupBy(*keys, at.alias("place"), entry.alias("entry")).agg(F.count("*").alias("copies"))
    leaves = leaves.withColumn("digest", F.sha2(F.concat("entry", F.lit("*"), F.col("copies").cast("string")), 256))
    levels = [_node(leaves, keys, DEPTHS[0], "place", F.sum("copies"))]
    for depth in DEPTHS[1:]:
        levels.append(_node(levels[-1], keys, depth, "prefix", F.sum("entries")))
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    return Tree(keys, leaves, nodes)


def _same(a: str, b: str, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return out


def differences(new: Tree, old: Tree) -> DataFrame:
    """keys, place, entry, change (`new`, `gone`, or `count` if its copies differ), new_copies, old_copies. Of each
    level only the children of nodes that differ are compared; give trees whose tables are stored."""
    keys = list(new.keys)

    def unlike(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        return a.alias("a").join(b.alias("b"), _same("a", "b", [*keys, *on]), "full_outer").filter(~F.col("a.digest").eqNullSafe(F.col("b.digest")))

    open_: DataFrame | None = None
    for depth in reversed(DEPTHS):
        a, b = ((t.nodes.filter(F.col("depth") == depth).select(*keys, "prefix", "digest")) for t in (new, old))
        if open_ is not None:
            a, b = (_below(x, open_, keys, "prefix", shown) for x in (a, b))
        shown = depth
        pairs = unlike(a, b, ["prefix"])
        open_ = pairs.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in [*keys, "prefix"]])
    a, b = (_below(t.leaves, open_, keys, "place", DEPTHS[0]) for t in (new, old))
    met = unlike(a, b, ["place", "entry"])
    change = F.when(F.col("b.digest").isNull(), "new").when(F.col("a.digest").isNull(), "gone").otherwise("count")
    both = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in [*keys, "place", "entry"]]
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return met.select(*both, change.alias("change"), zero("a.copies").alias("new_copies"), zero("b.copies").alias("old_copies"))


def _below(rows: DataFrame, parents: DataFrame, keys: list[str], child: str, depth: int) -> DataFrame:
    """The rows whose place lies below one of the parents, which have `depth` digits."""
    r = rows.withColumn("_up", F.substring(child, 1, depth))
    p = parents.withColumnRenamed("prefix", "_up")
    return r.alias("r").join(p.alias("p"), _same("r", "p", [*keys, "_up"]), "left_semi").drop("_up")


def proofs(t: Tree, wanted: DataFrame) -> DataFrame:
    """keys, place, entry, copies and path (children of its bucket and of the nodes above it) for the wanted
    (keys, entry). Entries that are not in the tree have no proof."""
    keys = list(t.keys)
    w = wanted.select(*keys, F.coalesce("entry", F.lit("")).alias("entry")).distinct()
    out = t.leaves.alias("l").join(w.alias("w"), _same("l", "w", [*keys, "entry"]), "left_semi").select(*keys, "place", "entry", "copies")
    for depth in DEPTHS:
        node = t.nodes.filter(F.col("depth") == depth).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("prefix").alias("_prefix"), F.col("children").alias(f"_c{depth}"))
        on = F.substring("place", 1, depth) == F.col("_prefix")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(node, on).drop("_prefix", *[f"_{k}" for k in keys])
    return out.select(*keys, "place", "entry", "copies", F.array(*[f"_c{d}" for d in DEPTHS]).alias("path"))


def verified(root: str, place: str, entry: str, copies: int, path: list[str]) -> bool:
    """Whether the path leads from the entry to the root."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    child = f"{place}:{sha(f'{entry}*{copies}')}"
    for depth, children in zip(DEPTHS, path, strict=True):
        if child not in children.split(","):
            return False
        child = f"{place[:depth]}:{sha(children)}"
    return child == f":{root}"
