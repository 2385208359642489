"""How filters interact: every order of them, what each removes, and its Shapley value.

Each document becomes one mask, a bit for each filter that it fails. What happens in any
order depends on the counts of the masks alone, so documents are summed to cells (part,
mask) and the orders are walked on these, part by part. The walk goes from permutation to
permutation by one swap of neighbours, so every order is visited once. A swap changes two
steps only: what stood before them and what is left after them stays the same, so only the
removals of these two are read anew from the cells. Shapley values are summed on the way.

Copies fail by their text's digest (SHA-256): all rows of a text but those with its
smallest id. Rows of one text are counted by partial sums, and the texts with very many rows
are sent to their rows, so no group meets in one task.

Edge cases: null texts are empty, null parts the empty string; a null id is no larger and no
smaller than others, so it is no copy and makes none, and has no labels; repeated rows under the smallest id
are all kept; a document counts as good or toxic if any row of labels says so, once; null
labels say nothing; texts of any length are read whole; an empty table gives no row.
Other columns of the tables are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_skewed, let, store, table, words

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def base_filters(text: Column) -> dict[str, Column]:
    """Filters that look at one text: whether it fails."""

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d"))

    n = let(words(text), counts)
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return {"A": n["n"] < 200, "B": 100 * n["d"] < 50 * n["n"], "C": 100 * capitals > 3 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text") -> DataFrame:
    """part, mask, good, toxic for every row of docs; bit k of mask is filter k's failure."""
    t = F.coalesce(F.col(text), F.lit(""))
    src = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), t.alias("t"))
    bits = [F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(base_filters(F.col("t")).values())]
    rows = store(src.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask")), "audit-rows")
    same = store(rows.groupBy("digest").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first")), "audit-texts")
    met = join_skewed(rows, same, "digest", "rows", keep=("first",))
    both = met.select("doc_id", "part", F.when(F.col("doc_id") > F.col("first"), F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))
    said = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).filter("good or toxic")
    return both.join(said, "doc_id", "left").select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def swaps(n: int) -> Iterator[int]:
    """The positions whose swaps with their right neighbours visit all orders of n things, each once
    (plain changes): the last thing runs through, then the others make one swap."""
    if n < 2:
        return
    inner = swaps(n - 1)
    down = True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + down  # while the last thing stands at the left, the others are one place further
        down = not down


def walk(cells: np.ndarray, names: str) -> Iterator[tuple[str, int, list[int], int]]:
    """cells: for every mask its documents, good and toxic ones. (order, step, [kept, removed,
    redundant, unique_fails, good_lost, toxic_lost], filter's Shapley sum) for every order and step."""
    n = len(names)
    # Of documents that fail none of a set of filters: sums over the masks that avoid it.
    sets = np.arange(1 << n)
    left = ((sets[:, None] & sets[None, :]) == 0).astype(np.int64) @ cells
    fails, only = left[0] - left[[1 << k for k in range(n)]], cells[[1 << k for k in range(n)], 0]
    order, before = list(range(n)), [(1 << k) - 1 for k in range(n)]  # before[i]: filters left of place i
    lost = [left[before[i]] - left[before[i] | 1 << order[i]] for i in range(n)]
    shapley, seen = [0] * n, []

    def visit() -> None:
        name = "".join(names[k] for k in order)
        for i, k in enumerate(order):
            shapley[k] += int(lost[i][0])
            removed, good, toxic = (int(x) for x in lost[i])
            seen.append((name, i, k, [int(left[before[i] | 1 << k][0]), removed, int(fails[k][0]) - removed, int(only[k]), good, toxic]))

    visit()
    for i in swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        before[i + 1] = before[i] | 1 << order[i]
        for j in (i, i + 1):
            lost[j] = left[before[j]] - left[before[j] | 1 << order[j]]
        visit()
    for name, i, k, counts in seen:
        yield name, i + 1, counts, shapley[k]


def interactions(masked: DataFrame, names: str = "ABCDE") -> DataFrame:
    """part, filter_order, step and the counts, for all orders of the filters in every part."""
    values = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    size = 1 << len(names)
    sums = masked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    # At most one entry for each mask: a part's cells are one small row.
    wide = sums.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cells = np.zeros((size, 3), np.int64)
                for c in found:
                    cells[c["mask"]] = c["n"], c["good"], c["toxic"]
                rows = list(walk(cells, names))
                yield pa.RecordBatch.from_pydict({"part": [part] * len(rows), "filter_order": [r[0] for r in rows], "step": pa.array([r[1] for r in rows], pa.int32()), **{v: [r[2][j] for r in rows] for j, v in enumerate(values)}, "shapley": [r[3] for r in rows]})

    return wide.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{v} long" for v in [*values, "shapley"]))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, min(doc_id) OVER (PARTITION BY t) first FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) good, coalesce(toxic, false) toxic, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
  + 4 * (100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) n, count(*) FILTER (good) good, count(*) FILTER (toxic) toxic FROM m GROUP BY part, mask),
f(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.x || q.x || r.x || s.x || t.x filter_order, [p.b, q.b, r.b, s.b, t.b] bs FROM f p JOIN f q ON q.b <> p.b JOIN f r ON r.b NOT IN (p.b, q.b) JOIN f s ON s.b NOT IN (p.b, q.b, r.b) JOIN f t ON t.b NOT IN (p.b, q.b, r.b, s.b)),
s AS (SELECT filter_order, i step, bs[i] b, list_sum(bs[1:i - 1]) before FROM (SELECT *, unnest([1, 2, 3, 4, 5]) i FROM o)),
x AS (SELECT part, filter_order, step, b,
  sum(CASE WHEN mask & (coalesce(before, 0) | b)::INT = 0 THEN n ELSE 0 END) kept, sum(CASE WHEN mask & coalesce(before, 0)::INT = 0 AND mask & b <> 0 THEN n ELSE 0 END) removed,
  sum(CASE WHEN mask & coalesce(before, 0)::INT <> 0 AND mask & b <> 0 THEN n ELSE 0 END) redundant, sum(CASE WHEN mask = b THEN n ELSE 0 END) unique_fails,
  sum(CASE WHEN mask & coalesce(before, 0)::INT = 0 AND mask & b <> 0 THEN good ELSE 0 END) good_lost, sum(CASE WHEN mask & coalesce(before, 0)::INT = 0 AND mask & b <> 0 THEN toxic ELSE 0 END) toxic_lost
  FROM c JOIN s ON true GROUP BY ALL)
SELECT part, filter_order, step::INTEGER step, kept::BIGINT kept, removed::BIGINT removed, redundant::BIGINT redundant, unique_fails::BIGINT unique_fails, good_lost::BIGINT good_lost, toxic_lost::BIGINT toxic_lost,
  (sum(removed) OVER (PARTITION BY part, b))::BIGINT shapley FROM x
"""
