"""Near-duplicate vectors: small-world graphs per shard, every shard searched by all.

1. Equal vectors are one class (a digest of 128 bits), so copies cost no links.
2. Classes are dealt to shards by that digest: copies and near copies spread evenly. One
   task builds a shard's graph and writes it in parts.
3. Of every two shards the rows of one search the graph of the other, and each shard
   searches itself; so every vector meets all others once, and a link counts for both
   its ends. A search starts with a narrow beam. Where half of the beam are links it is
   doubled until that is over, so the size of a group sets no limit; a beam that comes near a
   quarter of the shard becomes a scan of the shard, which is exact.
4. Before a pair of shards is searched, a sample of both is searched and scanned: the beam
   widens until the searches find at least `recall` of the scanned links.
5. Candidates count if their cosine in double precision is at least the limit. No pair
   leaves its task: counts by class and the links of a spanning forest do.
6. Components of the forests' links give the smallest id that is reachable.

A pair of shards is one task: it holds both, a bounded number of bytes, whatever the
table. Shards are at least MIN_SHARDS, to have tasks for all cores, and else of at most
SHARD_BYTES; so work grows with the square of the table divided by the shard's size,
as searching every shard has it.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing and are kept; vectors of different length link with nothing common; vectors of one
direction and different length of arrow are linked; repeated rows are vectors of their own,
linked with each other; null ids take part, and are never the smallest while another is
there; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_skewed, small_batches, store, table
from .graph import components
from .hnsw import Graph

#: Bytes of vectors in a shard, and how many shards there are at least.
SHARD_BYTES, MIN_SHARDS = 16 << 20, 12
#: Beam that a search starts with, sampled vectors of an audit, and how much of their links it must find.
BEAM, SAMPLE, RECALL = 24, 256, 0.995
#: Nodes in a part of a stored graph.
PART = 512


def digested(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, vec, class (hex digest of the vector's bytes; null where it can't be compared)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(1)
            classes, flat, offsets = [], vec.values, vec.offsets.to_numpy()
            nulls = np.concatenate(([0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))))
            values = flat.fill_null(0).to_numpy(zero_copy_only=False) + 0.0  # one zero
            for ok, a, b in zip(vec.is_valid().to_pylist(), offsets[:-1], offsets[1:]):
                x = values[a:b]
                usable = ok and nulls[a] == nulls[b] and np.isfinite(x).all() and x.any()
                classes.append(hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest() if usable else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), vec, pa.array(classes, pa.string())], names=["id", "vec", "class"])

    src = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vec"))
    kind = dict(src.dtypes)["vec"]
    if kind not in ("array<float>", "array<double>"):
        src, kind = src.withColumn("vec", F.col("vec").cast("array<double>")), "array<double>"
    return small_batches(src).mapInArrow(run, f"id long, vec {kind}, class string")


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares can't overflow then
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def graphs(classes: DataFrame, shards: int) -> DataFrame:
    """dim, shard, part, payload: each shard's graph. classes: class, vec, rows."""

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("class")  # digests are random, so any prefix is a sample
        dim, shard = group["dim"][0].as_py(), group["shard"][0].as_py()
        raw = np.array(group["vec"].combine_chunks().flatten()).reshape(-1, dim)
        g = Graph.build(unit(raw).astype(np.float32))
        keys = np.array([bytes.fromhex(k) for k in group["class"].to_pylist()], "V16")
        rows = group["rows"].to_numpy()
        parts = range(0, len(raw), PART)
        payload = [_packed(keys=keys[k : k + PART], rows=rows[k : k + PART], raw=raw[k : k + PART], **{f"links{i}": x[k : k + PART] for i, x in enumerate(g.links)}) for k in parts]
        n = len(payload)
        return pa.table({"dim": pa.array([dim] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "part": pa.array(range(n), pa.int32()), "payload": pa.array(payload, pa.binary())})

    dealt = classes.select("class", "vec", "rows", F.size("vec").alias("dim"), F.pmod(F.xxhash64("class"), F.lit(shards)).cast("int").alias("shard"))
    return store(dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, part int, payload binary"), "vector-graphs")


class _Shard:
    def __init__(self, parts: list[bytes]) -> None:
        loaded = [np.load(io.BytesIO(p)) for p in parts]
        self.keys, self.rows, raw = (np.concatenate([x[k] for x in loaded]) for k in ("keys", "rows", "raw"))
        layers = sum(name.startswith("links") for name in loaded[0].files)
        self.exact = unit(raw)
        self.graph = Graph(self.exact.astype(np.float32), [np.concatenate([x[f"links{k}"] for x in loaded]) for k in range(layers)])


class Searcher:
    """Links of query vectors with the nodes of a shard."""

    def __init__(self, shard: _Shard, limit: float, beam: int = BEAM) -> None:
        self.shard, self.limit, self.beam = shard, limit, beam
        self.near = np.float32(limit) - np.float32(1e-4)  # single precision errs by less
        self.n = len(shard.keys)

    def scan(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of every link, without the graph."""
        found = [np.zeros((2, 0), np.int64)]
        step = max(1, (8 << 20) // self.n)
        for at in range(0, len(q), step):
            r, c = np.nonzero(q[at : at + step].astype(np.float32) @ self.shard.graph.unit.T >= self.near)
            found.append(self._verified(q, r + at, c))
        r, c = np.concatenate(found, axis=1)
        return r, c

    def _verified(self, q: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        keep = [np.zeros(0, np.int64)]
        for at in range(0, len(r), 1 << 16):
            x, y = r[at : at + (1 << 16)], c[at : at + (1 << 16)]
            keep.append(at + np.flatnonzero(np.einsum("nd,nd->n", q[x], self.shard.exact[y]) >= self.limit))
        k = np.concatenate(keep)
        return np.stack([r[k], c[k]])

    def links(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) of the links that searches find, in pieces."""
        todo, beam = np.arange(len(q)), self.beam
        while len(todo):
            if 4 * beam >= self.n:
                step = max(1, (8 << 20) // self.n)
                for at in range(0, len(todo), step):
                    r, c = self.scan(q[todo[at : at + step]])
                    yield todo[at : at + step][r], c
                return
            wider = []
            step = max(8, (4 << 20) // beam)
            for at in range(0, len(todo), step):
                own = todo[at : at + step]
                ids, sims = self.shard.graph.search(q[own].astype(np.float32), beam)
                hit = (ids >= 0) & (sims >= self.near)
                many = 2 * hit.sum(1) > beam
                wider.append(own[many])
                r, k = np.nonzero(hit & ~many[:, None])
                r, c = self._verified(q, own[r], ids[r, k])
                yield r, c
            todo, beam = np.concatenate(wider), 2 * beam

    def audit(self, samples: list[np.ndarray], recall: float) -> tuple[int, int]:
        """Widens the beam until searches of the samples find their links; links there are, and found."""
        q = np.concatenate(samples)
        true = len(self.scan(q)[0])
        while True:
            found = sum(len(r) for r, _ in self.links(q))
            if found >= recall * true or 4 * self.beam >= self.n:
                return true, found
            self.beam *= 2


class _Forest:
    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent[x]
        while (p != (up := self.parent[p])).any():
            p = up
        self.parent[x] = p
        return p

    def join(self, r: np.ndarray, c: np.ndarray) -> None:
        while len(r):
            a, b = self.roots(r), self.roots(c)
            apart = a != b
            r, c, a, b = r[apart], c[apart], a[apart], b[apart]
            # Of several that one root shall hang under, the least wins; the others come again.
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


_CELLS = "kind string, a string, b string, n long, m long"


def cell(parts: pa.Table, i: int, j: int, limit: float, recall: float, beam: int = BEAM) -> pa.Table:
    """What a pair of shards has: links (class, number), edge (class, class), audit (shard and beam, links, found)."""
    parts = parts.sort_by("part")
    of = lambda s: [p for p, x in zip(parts["payload"].to_pylist(), parts["shard"].to_pylist()) if x == s]
    own, other = of(i), of(j)
    none = pa.table({"kind": pa.array([], pa.string()), "a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "m": pa.array([], pa.int64())})
    if not own or not other:
        return none
    graph = _Shard(other)
    query = graph if i == j else _Shard(own)
    search = Searcher(graph, limit, beam)
    true, found = search.audit([query.exact[:SAMPLE], graph.exact[:SAMPLE]], recall)
    nq = len(query.keys)
    shift = 0 if i == j else nq
    counts, forest = np.zeros(shift + len(graph.keys), np.int64), _Forest(shift + len(graph.keys))
    for r, c in search.links(query.exact):
        if i == j:
            r, c = r[r < c], c[r < c]
        np.add.at(counts, r, graph.rows[c])
        np.add.at(counts, shift + c, query.rows[r])
        forest.join(r, shift + c)
    keys = query.keys if i == j else np.concatenate([query.keys, graph.keys])
    names = [x.tobytes().hex() for x in keys]
    linked = np.flatnonzero(counts)
    roots = forest.roots(linked) if len(linked) else linked
    edges = [(names[x], names[y]) for x, y in zip(linked, roots) if x != y]
    kind = ["links"] * len(linked) + ["edge"] * len(edges) + ["audit"]
    a = [names[x] for x in linked] + [x for x, _ in edges] + [f"{i} {j}"]
    b = [None] * len(linked) + [y for _, y in edges] + [str(search.beam)]
    n = [int(counts[x]) for x in linked] + [0] * len(edges) + [true]
    m = [0] * (len(linked) + len(edges)) + [found]
    return pa.table({"kind": kind, "a": a, "b": pa.array(b, pa.string()), "n": pa.array(n, pa.int64()), "m": pa.array(m, pa.int64())})


def searched(stored: DataFrame, shards: int, limit: float, recall: float = RECALL, beam: int = BEAM) -> DataFrame:
    """The cells of all pairs of shards, stored."""

    def run(key: tuple, parts: pa.Table) -> pa.Table:
        return cell(parts, key[1].as_py(), key[2].as_py(), limit, recall, beam)

    pairs = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.struct(F.least(k, F.col("shard")).alias("i"), F.greatest(k, F.col("shard")).alias("j")))
    dealt = stored.select("dim", "shard", "part", "payload", F.explode(pairs).alias("p")).select("dim", "shard", "part", "payload", "p.i", "p.j")
    return store(dealt.groupBy("dim", "i", "j").applyInArrow(run, _CELLS), "vector-cells")


def near_vectors(vectors: DataFrame, limit: float = 0.95, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL, shard_bytes: int = SHARD_BYTES, shards: int = MIN_SHARDS) -> tuple[DataFrame, DataFrame]:
    """id, n_links, component, kept for every row of vectors; and the audits: pair of shards, beam, links, found."""
    rows = store(digested(vectors, key, vector), "vector-rows")
    classes = store(rows.filter("class IS NOT NULL").groupBy("class").agg(F.first("vec").alias("vec"), F.count("*").alias("rows"), F.min("id").alias("least")), "vector-classes")
    width = 8 if "double" in dict(classes.dtypes)["vec"] else 4
    total = classes.agg(F.sum(F.size("vec").cast("long") * width)).first()[0] or 0
    shards = max(shards, -(-total // shard_bytes))
    cells = searched(graphs(classes, shards), shards, limit, recall)
    links = cells.filter("kind = 'links'").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("links"))
    roots = components(cells.filter("kind = 'edge'").select("a", "b")).select(F.col("node").alias("class"), "root")
    known = classes.select("class", "rows", "least").join(links, "class", "left").join(roots, "class", "left")
    known = store(known.select("class", "rows", "least", (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "class").alias("root")), "vector-known")
    tops = store(known.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("members")), "vector-components")
    known = store(join_skewed(known, tops, "root", "members", keep=("component",)), "vector-named")
    slim = rows.select("id", "class")
    met = join_skewed(slim.filter("class IS NOT NULL"), known, "class", "rows", keep=("n_links", "component")).select("id", "n_links", "component")
    alone = slim.filter("class IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = met.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))
    return out, cells.filter("kind = 'audit'").select(F.col("a").alias("shards"), F.col("b").cast("int").alias("beam"), F.col("n").alias("links"), F.col("m").alias("found"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")
