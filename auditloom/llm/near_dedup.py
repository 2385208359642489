"""Near-duplicate classes by bottom-k sketches.

A document's set holds the distinct five-word shingles of its lower-cased text, hashed
once to 64 bits; its sketch is the k smallest of them. Documents with one set are one
class from the start, so groups of copies cost no pairs. The other links:

1. Inverted lists of retained values. Two sets with similarity t share about t*k
   values of their sketches, so they meet in the list of one of each sketch's rarest
   k - c + 1 values, c lying 5.5 standard deviations below t*k (chance of a miss per
   pair at the very limit, the estimate below included, about 3 in ten million; none for
   sets under t*k, whose sketch is the set).
2. Lists of up to `short` classes give all their pairs. Pairs with too different
   sizes, or whose union sketch estimates a far lower similarity, are filtered; the
   full sets decide.
3. Classes that meet in a longer list go the exact way: all shingles of these classes,
   rarest first, and of them those that a linked pair must meet in. A list's class
   with the rarest start is its hub; every class of the list is held against it. Once
   those links have joined classes to components, only pairs from different components
   are left, and positions bound their common shingles before any set is read. So a
   large group of near copies costs stars, not squares, and no list is capped.

Components of all links give the smallest document id that is reachable.

Edge cases: null texts and texts without words are empty sets, linked with nothing;
with fewer words than five the whole sequence is one shingle; repeated rows (also under
one id) fall into one class; null ids take part, and are never the smallest while another
is there; an empty table gives an empty result. Other columns of docs are not read.
Class numbers are 64-bit digests of whole sets; where sets of one digest differ in size or
sketch, they get numbers of their own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import wordhash
from .common import join_skewed, small_batches, store, table
from .graph import components

WIDTH, K, SHORT = 5, 48, 32
#: Similarity as a fraction: linked if Q * common >= P * union.
P, Q = 3, 4
#: Class lists up to this length are sent to the executors to pick texts; longer ones are joined by a shuffle.
BROADCAST_ROWS = 300_000


def shingle_set(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    return np.unique(wordhash.chained(words, min(width, len(words)))) if len(words) else words


def digest(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def sets_of(texts: list[str | None]) -> Iterator[np.ndarray]:
    for at in range(0, len(texts), 500):
        h, counts = wordhash.batch_hashes(texts[at : at + 500])
        ends = np.cumsum(counts)
        for end, n in zip(ends, counts):
            yield shingle_set(h[end - n : end])


def signatures(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, th (hash of the text), class, n, sketch; class is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, sizes, sketches = [], [], []
            for s in sets_of(batch.column(2).to_pylist()):
                sizes.append(len(s))
                classes.append(digest(s) if len(s) else None)
                sketches.append(s[:k].view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in sketches]))).astype(np.int32)
            flat = np.concatenate(sketches) if sketches else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))], names=["doc_id", "th", "class", "n", "sketch"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return small_batches(src).mapInArrow(run, "doc_id long, th long, class long, n long, sketch array<long>")


def _pick_texts(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, text for the wanted classes."""
    need = store(reps.join(wanted.select("class").distinct(), "class").select("class", "doc_id", "th"), "dedup-wanted").alias("n")
    if need.count() <= BROADCAST_ROWS:
        need = F.broadcast(need)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").alias("d")
    met = d.join(need, (F.col("d.th") == F.col("n.th")) & F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")))
    return store(met.select("class", "text").groupBy("class").agg(F.first("text").alias("text")), "dedup-texts")


def full_sets(texts: DataFrame) -> DataFrame:
    """class, set (its sorted hashes, eight bytes each), hashed once for all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in sets_of(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["class", "set"])

    return store(small_batches(texts.select("class", "text")).mapInArrow(run, "class long, set binary"), "dedup-sets")


#: Pairs that one copy of a hub's set is held against.
SHARE = 256


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose full sets are similar enough. A set a with many pairs stands before
    each SHARE of them; the sets b stream past it, so a task holds one a and a batch of b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(0, np.uint64)
        for batch in batches:
            a, b, s = batch.columns
            found = []
            for i, (hub, other) in enumerate(zip(a.to_pylist(), b.to_pylist())):
                y = np.frombuffer(s[i].as_buffer(), np.uint64)
                if other is None:
                    x = y.copy()  # the next ones are held against it
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                if Q * common >= P * (len(x) + len(y) - common):
                    found.append((hub, other))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    pairs = store(pairs.select("a", "b"), "dedup-to-verify")
    degrees = pairs.groupBy("a").agg(F.count("*").alias("n"))
    share = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / SHARE)).alias("share")
    dealt = store(join_skewed(pairs, degrees, "a", "n", keep=("n",)).select("a", "b", share), "dedup-shares")
    s = lambda c: sets.select(F.col("class").alias(c), "set")
    hubs = dealt.select("a", "share").distinct().join(s("a"), "a").select("a", "share", F.lit(None).cast("long").alias("b"), "set")
    rows = hubs.unionByName(dealt.join(s("b"), "b").select("a", "share", "b", "set"))
    rows = rows.repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    return store(small_batches(rows.select("a", "b", "set")).mapInArrow(run, "a long, b long"), "dedup-links")


def _sizes_fit(n: Column, m: Column) -> Column:
    return (Q * n >= P * m) & (Q * m >= P * n)


def short_pairs(reps: DataFrame, postings: DataFrame) -> DataFrame:
    """a, b: pairs that meet in a short list and whose union sketch lets them pass."""
    a = postings.select("v", F.col("class").alias("a"), F.col("n").alias("na"))
    b = postings.select("v", F.col("class").alias("b"), F.col("n").alias("nb"))
    pairs = store(a.join(b, "v").filter((F.col("a") < F.col("b")) & _sizes_fit(F.col("na"), F.col("nb"))).select("a", "b").distinct(), "dedup-pairs")
    s = reps.select
    met = pairs.join(s(F.col("class").alias("a"), F.col("sketch").alias("sa")), "a").join(s(F.col("class").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.sort_array(F.transform(F.array_union("sa", "sb"), _unsigned)), 1, K)
    shared = F.size(F.array_intersect(F.transform(F.array_intersect("sa", "sb"), _unsigned), F.col("union")))
    # 5.5 standard deviations of an estimate from k values below the limit.
    least = P / Q - 5.5 * math.sqrt(P / Q * (1 - P / Q) / K)
    return met.withColumn("union", union).filter(shared >= least * F.size("union")).select("a", "b")


def _unsigned(x: Column) -> Column:
    """Signed order of the result is the unsigned order of x."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def exact_lists(sets: DataFrame) -> DataFrame:
    """h, class, n, pos for the shingles, rarest first, in which two linked classes must meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = np.frombuffer(packed.as_buffer(), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), cls), pa.int64()), pa.array(np.full(len(s), len(s)), pa.int64()), pa.array(s.view(np.int64))], names=["class", "n", "h"])

    each = store(small_batches(sets.select("class", "set")).mapInArrow(run, "class long, n long, h long"), "dedup-shingles")
    counts = store(each.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "dedup-shingle-counts")
    shared = join_skewed(each, counts, "h", "df", keep=("df",))
    w = W.partitionBy("class")
    pos = F.col("n") - F.count("*").over(w) + F.row_number().over(w.orderBy("df", "h")) - 1
    return store(shared.withColumn("pos", pos).filter(F.col("pos") <= F.col("n") - F.ceil(P * F.col("n") / Q)).select("h", "class", "n", "pos"), "dedup-prefixes")


def _bounds(a: str, b: str) -> Column:
    """Whether sets that first meet at these positions can be similar enough."""
    n, m, p, q = (F.col(x) for x in (f"n{a}", f"n{b}", f"p{a}", f"p{b}"))
    common = F.least(n - p, m - q)
    return _sizes_fit(n, m) & ((P + Q) * common >= P * (n + m)) & ((Q - P) * common >= P * (p + q))


def _side(df: DataFrame, x: str, *more: str) -> DataFrame:
    return df.select("h", F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), *more)


def hub_pairs(lists: DataFrame) -> DataFrame:
    hubs = lists.groupBy("h").agg(F.min(F.struct("pos", "class", "n")).alias("hub"), F.count("*").alias("size")).filter("size > 1")
    hubs = store(hubs.select("h", "size", F.col("hub.class").alias("a"), F.col("hub.n").alias("na"), F.col("hub.pos").alias("pa")), "dedup-hubs")
    met = join_skewed(_side(lists, "b"), hubs, "h", "size", keep=("a", "na", "pa")).filter((F.col("a") != F.col("b")) & _bounds("a", "b"))
    return met.select("a", "b").distinct()


def cross_pairs(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of a list whose classes are in different components so far."""
    r = lists.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    r = store(r, "dedup-rooted")
    main = r.groupBy("h", "root").agg(F.count("*").alias("c")).groupBy("h").agg(F.max(F.struct("c", "root")).getField("root").alias("main"), F.count("*").alias("parts"), F.sum("c").alias("size"))
    r = store(join_skewed(r, store(main.filter("parts > 1"), "dedup-mains"), "h", "size", keep=("main",)), "dedup-mixed")
    few = _side(r.filter("root <> main"), "a", F.col("root").alias("ra"), "main")
    met = few.join(_side(r, "b", F.col("root").alias("rb")), "h").filter((F.col("ra") != F.col("rb")) & ((F.col("rb") == F.col("main")) | (F.col("a") < F.col("b"))) & _bounds("a", "b"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and for each class root (a class of its component), rows (how many
    documents it has), least (their smallest id) and first (the document that goes before the others)."""
    sig = store(signatures(docs), "dedup-signatures")
    own = F.struct("n", F.xxhash64("sketch").alias("s"))
    one = lambda sig: store(sig.filter("n > 0").groupBy("class").agg(F.min(F.struct("doc_id", "th", "n", "sketch")).alias("r"), F.min(own).alias("x"), F.max(own).alias("y"), F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")).alias("first"), F.count("*").alias("rows")).select("class", "r.*", "least", "first", "rows", (F.col("x") != F.col("y")).alias("unlike")), "dedup-classes")
    reps = one(sig)
    if not reps.filter("unlike").isEmpty():
        mixed = reps.filter("unlike").select("class", F.lit(True).alias("unlike"))
        sig = sig.join(mixed, "class", "left").withColumn("class", F.when(F.col("unlike"), F.xxhash64("class", "n", "sketch")).otherwise(F.col("class"))).drop("unlike")
        sig = store(sig, "dedup-signatures")
        reps = one(sig)
    posted = reps.select("class", "n", F.explode("sketch").alias("v"))
    counts = store(posted.groupBy("v").agg(F.count("*").alias("size")).filter("size > 1"), "dedup-value-counts")
    shared = store(join_skewed(posted, counts, "v", "size", keep=("size",)), "dedup-postings")
    # A class's rarest values first; those that no other class retains come before all of these.
    w = W.partitionBy("class")
    kept = F.least("n", F.lit(K).cast("long"))
    pos = kept - F.count("*").over(w) + F.row_number().over(w.orderBy("size", "v")) - 1
    low = math.floor(K * P / Q - 5.5 * math.sqrt(K * P / Q * (1 - P / Q)))
    last = F.when(F.col("n") <= K * P // Q, F.col("n") - F.ceil(P * F.col("n") / Q)).otherwise(kept - low)
    lists = store(shared.withColumn("pos", pos).filter(F.col("pos") <= last).select("v", "class", "n"), "dedup-lists")
    sizes = store(lists.groupBy("v").agg(F.count("*").alias("size")).filter("size > 1"), "dedup-list-sizes")
    sized = join_skewed(lists, sizes, "v", "size", keep=("size",))
    pairs = store(short_pairs(reps, sized.filter(F.col("size") <= SHORT)), "dedup-candidates")
    long_ = store(sized.filter(F.col("size") > SHORT).select("class").distinct(), "dedup-long")
    either = pairs.select(F.explode(F.array("a", "b")).alias("class")).unionByName(long_)
    sets = full_sets(_pick_texts(docs, reps, either))
    links = verified(pairs, sets)
    exact = exact_lists(sets.join(long_, "class"))
    links = store(links.unionByName(verified(hub_pairs(exact), sets)), "dedup-links-so-far")
    more = verified(cross_pairs(exact, components(links)), sets)
    roots = components(links.unionByName(more) if not more.isEmpty() else links).select(F.col("node").alias("class"), "root")
    rooted = reps.select("class", "rows", "least", "first").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    return sig, store(rooted, "dedup-roots")


def with_classes(sig: DataFrame, found: DataFrame, *keep: str) -> DataFrame:
    """doc_id, th, n and the columns `keep` of each row's class; null for rows without words. A class of
    very many copies stays where it is."""
    rows = sig.select("doc_id", "th", "n", "class")
    met = join_skewed(rows.filter("n > 0"), found, "class", "rows", keep=keep).select("doc_id", "th", "n", *keep)
    return met.unionByName(rows.filter("n = 0").select("doc_id", "th", "n", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in keep]))


def survivors(docs: DataFrame) -> DataFrame:
    """doc_id, th, copies: of each component, and of each set-less row, the one document that
    stays; th is xxhash64 of its text, copies how many rows of docs are this very document."""
    sig, found = classes(docs.select("doc_id", "text"))
    # Components choose among their classes' first documents; no row of docs is joined with its class.
    first = store(found.groupBy("root").agg(F.min("first").alias("r")).select("r.doc_id", "r.th"), "dedup-first").alias("f")
    copies = sig.groupBy("doc_id", "th").agg(F.count("*").alias("copies")).alias("c")
    kept = first.join(copies, F.col("f.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("f.th") == F.col("c.th"))).select("f.doc_id", "f.th", "copies")
    return kept.unionByName(sig.filter("n = 0").select("doc_id", "th", F.lit(1).cast("long").alias("copies")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    sig, found = classes(docs.select("doc_id", "text"))
    # The smallest id of a component is that of its classes: rows take it with their class.
    components_ = store(found.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("classes")), "dedup-components")
    found = store(join_skewed(found, components_, "root", "classes", keep=("component",)), "dedup-class-components")
    out = with_classes(sig, found, "component")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
