"""Quality rules with thresholds taken from the data, per language and source.

Base figures come from whole texts. Ratios of them are held against fences that
mergeable quantile sketches give: a histogram with integer bounds (values under 128
exactly, above that the leading seven bits, so at most 1/64 relative error). Histograms of
any two parts add up, in any order, to the histogram of the whole: those of a
(lang, source) add up to that of the language and of the corpus, and a hot group is summed
map-side before the shuffle.

A fence lies REACH times a spread beyond the median. The spread is the distance of the
median and the quartile on that side, which junk of less than a quarter of a group does
not move. Median and spread of a group of n rows are drawn to those of its language as if
it had SHRINK more rows of that language, and a spread is at most twice the corpus's, so
that a dirty group cannot make its own fence. Where the quartile meets the median, as for
rates that most texts have none of, the spread is the weight of one event (a symbol, a
repeated line, a repeated window) in a text of the group's median length. No fence
is a constant; a rate's lower fence would lie under zero and is left out.

Edge cases: a null or blank text has zero words and fails the base rule; null lang or
source are groups of their own; a group of few rows has nearly the fences of its language;
repeated rows count as often as they occur; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import store, table, words

#: metric -> what one event adds to it in a text of one word; none for a mean, which has fences on both sides.
EVENTS = {"symbol_rate": 1000, "dup_line_rate": 10000, "repeat_rate": 3000, "word_length": 0}
REACH, SHRINK = 8, 50


def base_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs but the text, with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    keep = [c for c in docs.columns if c != text]
    w = docs.select(*keep, t.alias("_t"), words(t).alias("_w"))
    n = F.size("_w")
    # Trigrams as (hash, position), sorted: equal ones become neighbours. Coverage is then
    # the sum of min(3, gap) over their positions in order.
    grams = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    keyed = F.transform(grams, lambda i: F.struct(F.xxhash64(F.get("_w", i - 1), F.get("_w", i), F.get("_w", i + 1)).alias("h"), i.alias("i")))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = w.select(*keep, "_w", n.cast("long").alias("n_words"),
                 F.length(F.regexp_replace("_t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
                 (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
                 (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                 F.sort_array(keyed).alias("_g"))
    twice = F.filter("_g", lambda x, i: (F.get("_g", i - 1)["h"] == x["h"]) | F.coalesce(F.get("_g", i + 1)["h"] == x["h"], F.lit(False)))
    w = w.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate("_p", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
                          lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    return w.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.size("_p") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"))


def bucket(x: Column) -> Column:
    """Lower integer bound of x's histogram cell."""
    shift = F.greatest(F.length(F.bin(x)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift)


def rates(base: DataFrame) -> DataFrame:
    """The integer metrics that fences are for; rates are per thousand words or lines' share of words."""
    n = F.greatest("n_words", F.lit(1).cast("long"))
    per = lambda c, k: F.floor(F.col(c) * k / n).cast("long")
    return base.withColumns({"symbol_rate": per("n_symbols", 1000), "dup_line_rate": F.floor(F.col("n_dup_lines") * 10000 / n).cast("long"), "repeat_rate": per("n_repeat_words", 1000), "word_length": per("word_chars", 100)})


def sketch(rated: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """by, metric, cell, n: the mergeable histogram of every metric and of the words. Sums of sketches are sketches."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("cell")) for m in (*EVENTS, "n_words")])
    return rated.select(*by, F.explode(entries).alias("e")).groupBy(*by, "e.metric", "e.cell").agg(F.count("*").alias("n"))


def quartiles(sk: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, metric, n, q1, q2, q3 of sketches merged by `by`: cells are few, whatever the rows."""
    merged = sk.groupBy(*by, "metric", "cell").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*by, "metric")
    run = merged.withColumn("upto", F.sum("n").over(w.orderBy("cell"))).withColumn("all", F.sum("n").over(w))
    return run.groupBy(*by, "metric").agg(F.max("all").alias("n"), *[F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("cell"))).alias(f"q{k}") for k in (1, 2, 3)])


def fences(sk: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row for each group: low_<metric> and high_<metric>."""
    sk = store(sk, "quality-sketches")
    own, wide, whole = (quartiles(sk, by[:k]) for k in (len(by), 1, 0))
    words_ = own.filter("metric = 'n_words'").select(*by, F.greatest("q2", F.lit(1)).alias("length")).alias("w")
    same = lambda x, y, cols: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in cols]
    j = own.filter("metric != 'n_words'").alias("g").join(wide.alias("l"), same("g", "l", (*by[:1], "metric"))).join(F.broadcast(whole).alias("c"), F.col("g.metric") == F.col("c.metric"))
    j = j.join(words_, same("g", "w", by))
    drawn = lambda g, l: f"((g.n * ({g}) + {SHRINK} * ({l})) div (g.n + {SHRINK}))"
    spread = lambda a, b: F.expr(f"least({drawn(f'g.{b} - g.{a}', f'l.{b} - l.{a}')}, 2 * (c.{b} - c.{a}))")
    event = F.expr("case g.metric " + " ".join(f"when '{m}' then {e}" for m, e in EVENTS.items()) + " end div w.length")
    median = F.expr(drawn("g.q2", "l.q2"))
    q = j.select(*[F.col(f"g.{c}").alias(c) for c in by], F.col("g.metric").alias("metric"), (median + REACH * F.greatest(spread("q2", "q3"), event)).alias("high"),
                 F.when(F.col("g.metric").isin([m for m, e in EVENTS.items() if not e]), median - REACH * spread("q1", "q2")).otherwise(-1).alias("low"))
    pick = [F.max(F.when(F.col("metric") == m, F.col(k))).alias(f"{k}_{m}") for m in EVENTS for k in ("low", "high")]
    return q.groupBy(*by).agg(*pick)


def judge(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, base figures, base_failed, kept."""
    rated = store(rates(base_figures(docs.select("doc_id", *by, F.col(text).alias("text")))), "quality-base")
    limits = fences(sketch(rated, by), by)
    j = rated.alias("a").join(limits.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.lit(True)
    for m in EVENTS:
        inside = inside & F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}"))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, lang, source, coalesce(text, '') t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws FROM d),
g AS (SELECT rid, i, ws[i] || chr(10) || ws[i+1] || chr(10) || ws[i+2] g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) i FROM w)),
p AS (SELECT DISTINCT rid, i + unnest([0, 1, 2]) p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) k FROM g) WHERE k >= 2),
rep AS (SELECT rid, count(*) n FROM p GROUP BY rid),
b AS (SELECT w.rid, doc_id, lang, source, len(ws) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) word_chars,
  length(t) - length(translate(t, '#*$%&|<>', '')) n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) n_dup_lines,
  coalesce(rep.n, 0) n_repeat_words FROM w LEFT JOIN rep USING (rid)),
r AS (SELECT *, n_symbols * 1000 // greatest(n_words, 1) symbol_rate, n_dup_lines * 10000 // greatest(n_words, 1) dup_line_rate,
  n_repeat_words * 1000 // greatest(n_words, 1) repeat_rate, word_chars * 100 // greatest(n_words, 1) word_length FROM b),
u AS (SELECT rid, lang, source, 'symbol_rate' metric, symbol_rate v FROM r UNION ALL SELECT rid, lang, source, 'dup_line_rate', dup_line_rate FROM r
  UNION ALL SELECT rid, lang, source, 'repeat_rate', repeat_rate FROM r UNION ALL SELECT rid, lang, source, 'word_length', word_length FROM r
  UNION ALL SELECT rid, lang, source, 'n_words', n_words FROM r),
s AS (SELECT lang, source, metric, v, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) cell FROM u),
x AS (SELECT 'g' kind, lang, source, metric, cell FROM s UNION ALL SELECT 'l', lang, NULL, metric, cell FROM s UNION ALL SELECT 'c', NULL, NULL, metric, cell FROM s),
h AS (SELECT kind, lang, source, metric, cell, count(*) n FROM x GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY kind, lang, source, metric ORDER BY cell) upto, sum(n) OVER (PARTITION BY kind, lang, source, metric) total FROM h),
q AS (SELECT kind, lang, source, metric, max(total)::BIGINT n, min(cell) FILTER (upto * 4 >= total) q1, min(cell) FILTER (upto * 4 >= total * 2) q2, min(cell) FILTER (upto * 4 >= total * 3) q3 FROM c GROUP BY ALL),
z AS (SELECT g.lang, g.source, g.metric, (g.n * g.q2 + 50 * l.q2) // (g.n + 50) mid,
  least((g.n * (g.q3 - g.q2) + 50 * (l.q3 - l.q2)) // (g.n + 50), 2 * (a.q3 - a.q2)) up,
  least((g.n * (g.q2 - g.q1) + 50 * (l.q2 - l.q1)) // (g.n + 50), 2 * (a.q2 - a.q1)) down,
  CASE g.metric WHEN 'symbol_rate' THEN 1000 WHEN 'dup_line_rate' THEN 10000 WHEN 'repeat_rate' THEN 3000 ELSE 0 END // greatest(w.q2, 1) event
  FROM q g JOIN q l ON g.kind = 'g' AND l.kind = 'l' AND g.metric = l.metric AND g.lang IS NOT DISTINCT FROM l.lang
  JOIN q a ON a.kind = 'c' AND a.metric = g.metric
  JOIN q w ON w.kind = 'g' AND w.metric = 'n_words' AND g.lang IS NOT DISTINCT FROM w.lang AND g.source IS NOT DISTINCT FROM w.source WHERE g.metric <> 'n_words'),
f AS (SELECT lang, source, metric, mid + 8 * greatest(up, event) high, CASE metric WHEN 'word_length' THEN mid - 8 * down ELSE -1 END low FROM z),
v AS (SELECT u.rid, bool_and(u.v BETWEEN f.low AND f.high) inside FROM u JOIN f ON u.metric = f.metric AND u.lang IS NOT DISTINCT FROM f.lang AND u.source IS NOT DISTINCT FROM f.source GROUP BY u.rid)
SELECT doc_id, n_words::BIGINT n_words, word_chars::BIGINT word_chars, n_symbols::BIGINT n_symbols, n_dup_lines::BIGINT n_dup_lines, n_repeat_words::BIGINT n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND inside kept FROM b JOIN v USING (rid)
"""
