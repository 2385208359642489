"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same number of copies, the source's
target over its size: a whole part that is taken as it is, and a fractional copy
probability. Pairs of fractional documents move mass, counted in words, from one
to the other in a random direction until one of them is integral; the direction's
odds keep each document's expected copies, and the moved words are equal on both
sides, so a source's words stay whole up to its last single residual. Documents
are dealt by a hash into groups of about `fan` rows, folded group by group, and
each group's one residual goes up a tree in which again `fan` residuals meet: a
hot source only has a wider tree. The draws hash the document ids, so that reruns
agree. Everything is DataFrame code.

Repeated rows are numbered, and the number enters the deal like the id does: very many
equal rows, or rows without an id, are dealt over as many groups as others.

Edge cases: a null text has size 0 and takes 0; null sources form one source,
ranked last; repeated rows (even with one id) are rows of their own; an empty
table gives an empty result; columns besides the named ones are never read. The targets'
windows go over one row for each source, not over documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, store, table, word_count


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sizes: source, size, n (rows of this size). source, source_size, n, target: the whole size shared by weight, no target above
    most times its source's size. One row for each source; the level at which the
    uncapped ones meet comes from running sums over the sources by cap over weight."""
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int")))
    by = W.orderBy((F.lit(most) * F.col("source_size") / F.col("w")), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(after))
    per = per.withColumn("met", F.when(F.col("level") * F.col("w") <= most * F.col("source_size"), F.col("level")))
    per = per.withColumn("at", F.max("met").over(whole))
    return per.select("source", "source_size", "n", F.least((most * F.col("source_size")).cast("double"), F.col("at") * F.col("w")).alias("target"))


def _unit(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _told(d: Column) -> Column:
    """What tells a row apart besides its id: without an id, its mark."""
    return F.when(d["doc_id"].isNull(), d["mark"]).otherwise(F.lit(0).cast("long"))


def _step(acc: Column, x: Column, seed: int) -> Column:
    """One meeting of the open document with the next one."""
    item = lambda d, p: F.struct(*[d[c].alias(c) for c in ("doc_id", "size", "mark", "k", "base")], p.alias("p"))
    out = lambda cur, done: F.struct(cur.alias("cur"), done.alias("done"))
    a, done = acc["cur"], acc["done"]
    s1, s2, p1, p2 = a["size"], x["size"], a["p"], x["p"]
    rise1, fall1, rise2, fall2 = (1 - p1) * s1, p1 * s1, (1 - p2) * s2, p2 * s2
    up, down = F.least(rise1, fall2), F.least(fall1, rise2)
    goes_up = _unit(F.lit(seed), a["doc_id"], x["doc_id"], s1, s2, _told(a), _told(x), a["k"], x["k"]) * (up + down) < down
    one, zero = F.lit(1.0), F.lit(0.0)
    both = lambda q1, q2: F.array(item(a, q1), item(x, q2))
    pair = F.when(goes_up & (rise1 <= fall2), both(one, p2 - rise1 / s2)).when(goes_up, both(p1 + fall2 / s1, zero)).when(fall1 <= rise2, both(zero, p2 + fall1 / s2)).otherwise(both(p1 - rise2 / s1, one))
    near = lambda d: (d["p"] <= 1e-12) | (d["p"] >= 1 - 1e-12)
    return F.when(a.isNull(), out(x, done)).otherwise(
        let(pair, lambda two: out(F.get(F.filter(two, lambda d: ~near(d)), F.lit(0)), F.concat(done, F.filter(two, near)))))


ITEM = "struct<doc_id:bigint,size:bigint,mark:bigint,k:bigint,base:bigint,p:double>"


def _fold(groups: DataFrame, seed: int) -> DataFrame:
    start = F.struct(F.lit(None).cast(ITEM).alias("cur"), F.array().cast(f"array<{ITEM}>").alias("done"))
    met = groups.groupBy("source", "bucket").agg(F.sort_array(F.collect_list("d")).alias("ds"))
    return met.select("source", "bucket", F.aggregate("ds", start, lambda a, x: _step(a, x, seed)).alias("r")).select("source", "bucket", "r.cur", "r.done")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 17, fan: int = 128, mark: str | None = None) -> DataFrame:
    """docs: doc_id bigint, source, size, and where named a bigint column `mark` that tells rows of
    one id and size apart, and deals those without an id. Returns doc_id, size, source, source_size, target, copies, mark for every
    row of docs."""
    told = (F.col(mark) if mark else F.lit(0)).cast("long").alias("mark")
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("size").cast("long").alias("size"), told)
    # Equal rows are summed before the shuffle and numbered after it.
    sizes = store(each.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("n")), "mix-sizes")
    rows = sizes.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
    targets = store(source_targets(sizes, weights, most).coalesce(1), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.select("source", F.floor(ratio).cast("long").alias("base"), (ratio - F.floor(ratio)).alias("p"), F.greatest(F.ceil(F.col("n") / fan), F.lit(1)).cast("long").alias("parts"))
    j = rows.alias("a").join(plan.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "base", "p", "parts")
    open_ = (F.col("size") > 0) & (F.col("p") > 1e-12) & (F.col("p") < 1 - 1e-12)
    settled = j.filter(~open_).select("source", "doc_id", "size", "mark", (F.col("base") + F.when(F.col("p") >= 1 - 1e-12, 1).otherwise(0)).alias("copies"))
    level = j.filter(open_).select("source", F.struct("doc_id", "size", "mark", "k", "base", "p").alias("d"), "parts")
    level = level.select("source", F.pmod(F.xxhash64(F.lit(seed), "d.doc_id", "d.size", _told(F.col("d")), "d.k"), F.col("parts")).alias("bucket"), "d")
    most_parts, depth, done = plan.agg(F.max("parts")).first()[0] or 1, 0, [settled]
    whole = lambda df: df.select("source", "d.doc_id", "d.size", "d.mark", (F.col("d.base") + F.round("d.p").cast("long")).alias("copies"))
    while True:
        folded = store(_fold(level, seed + depth), f"mix-level{depth}")
        done.append(whole(folded.select("source", F.explode("done").alias("d"))))
        level = folded.filter("cur is not null").select("source", F.floor(F.col("bucket") / fan).alias("bucket"), F.col("cur").alias("d"))
        if most_parts <= 1:
            break
        most_parts, depth = -(-most_parts // fan), depth + 1
    done.append(whole(level))  # a source's one residual goes to the nearer whole number
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("doc_id", "size", "a.source", "source_size", "target", F.col("copies").cast("long").alias("copies"), "mark")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
