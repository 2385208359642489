"""Benchmark decontamination over a distributed positional inverted index.

Windows of ten consecutive words are taken from every benchmark item. For each window
its terms are ordered by how often the corpus has them, and its rarest term is its key.
The index stores the postings of all key terms: document, position, and as payload the
words around it, so that the lists of the window's other terms, adjusted by their
offsets, are intersected at the posting itself from the rarest on. Equality of all
offsets is an exact phrase match; all terms within a span of window plus slop is a
proximity match. A word that every document has is no window's key unless all ten are
like it, so a hot term costs no lists.

Edge cases: null texts have no words; an item of fewer than ten words is one window, an
item without words none; repeated items and repeated documents are each reported; an
empty benchmark or corpus gives zero hits or no rows; a document with a null id is kept.
All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import low, store, table, word_count, words

#: Separators: everything in ASCII but digits and letters (already in lower case).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Lists of terms or windows up to this many bytes are sent to the executors; longer ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: A term's list is dealt to this many tasks where it is shuffled.
SALTS = 16


def tokens(text: Column) -> Column:
    return words(low(text), GAP)


def _fits(df: DataFrame, text: Column) -> bool:
    """Whether df may be sent: the bytes of text, and for each row what an object of the join costs."""
    return (df.agg(F.sum(F.octet_length(text) + 100)).first()[0] or 0) <= BROADCAST_BYTES


def _joined_terms(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """postings (term, pos, ..) whose term is in terms (distinct). Shuffled, each term's postings are
    dealt by their position, so that a frequent one is no single task's."""
    if _fits(terms, F.col("term")):
        return postings.join(F.broadcast(terms), "term")
    dealt = terms.select("term", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return postings.withColumn("salt", F.pmod(F.col("pos"), F.lit(SALTS))).join(dealt, ["term", "salt"]).drop("salt")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """w (array of words), item_ids (distinct, as strings): every distinct window."""
    t = items.select(F.col("item_id").cast("string").alias("item"), tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("t") - size + 1, F.lit(1)))
    return t.select("item", F.explode(at).alias("i"), "t").select("item", F.slice("t", F.col("i"), size).alias("w")).groupBy("w").agg(F.collect_set("item").alias("item_ids"))


def keyed(corpus: DataFrame, wins: DataFrame) -> DataFrame:
    """windows with term, off: the term that the corpus has least often, and its place."""
    terms = store(wins.select(F.explode("w").alias("term")).distinct(), "leak-terms")
    every = corpus.select(F.explode(tokens(F.col("text"))).alias("term"))
    if _fits(terms, F.col("term")):
        seen = every.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    else:  # counted before the shuffle
        seen = every.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term")
    seen = store(seen, "leak-frequencies")
    each = wins.select("w", F.posexplode("w").alias("off", "term")).join(seen, "term")
    # A window with a term that the corpus lacks has no match: the inner join leaves it short.
    best = each.groupBy("w").agg(F.count("*").alias("met"), F.min(F.struct("n", "term", "off")).alias("k")).filter(F.col("met") == F.size("w"))
    return wins.join(best, "w").select("w", "item_ids", "k.term", "k.off")


def index(corpus: DataFrame, keys: DataFrame, reach: int = WINDOW - 1) -> DataFrame:
    """Postings of the key terms: doc_id, h (hash of the text), term, pos, low, near.
    near has the words from position low on, `reach` to either side of pos. Places are found
    first, without the text; it is cut at these places alone."""
    terms = keys.select("term").distinct()
    t = corpus.select("doc_id", F.xxhash64("text").alias("h"), tokens(F.col("text")).alias("t"))
    first = lambda pos: F.greatest(pos - reach, F.lit(0))
    if _fits(terms, F.col("term")):
        # In one stage, where a row refers to its text and does not copy it.
        hit = t.select("doc_id", "h", "t", F.posexplode("t").alias("pos", "term")).join(F.broadcast(terms), "term")
        return hit.select("doc_id", "h", "term", "pos", first(F.col("pos")).alias("low"), F.slice("t", first(F.col("pos")) + 1, 2 * reach + 1).alias("near"))
    places = _joined_terms(t.select("doc_id", "h", F.posexplode("t").alias("pos", "term")), terms)
    places = places.groupBy("doc_id", "h").agg(F.collect_set(F.struct("pos", "term")).alias("at")).alias("p")  # bounded by a text's words
    met = t.alias("d").join(places, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.h") == F.col("p.h")))
    cut = F.transform("at", lambda x: F.struct(x["term"].alias("term"), x["pos"].alias("pos"), first(x["pos"]).alias("low"), F.slice("t", first(x["pos"]) + 1, 2 * reach + 1).alias("near")))
    return met.select("d.doc_id", "d.h", F.explode(cut).alias("c")).select("doc_id", "h", "c.term", "c.pos", "c.low", "c.near")


def matches(postings: DataFrame, keys: DataFrame, slop: int | None = None) -> DataFrame:
    """doc_id, h, start, n, w, item_ids for each match. slop None: exact phrases; else every
    window whose terms all lie within its length plus slop words around the posting, for which
    the index must reach that far (found_in takes care of it)."""
    p, k = postings.alias("p"), (F.broadcast(keys) if _fits(keys, F.array_join("w", " ")) else keys).alias("k")
    same = F.col("p.term") == F.col("k.term")
    if slop is None:
        start = F.col("pos") - F.col("off")
        fits = (start >= F.col("low")) & (F.slice("near", F.greatest(start - F.col("low"), F.lit(0)) + 1, F.size("w")) == F.col("w"))
    else:
        start = F.greatest(F.col("pos") - F.size("w") - slop + 1, F.col("low"))
        at = F.sequence(F.lit(1), F.greatest(F.size("near") - F.size("w") - slop + 1, F.lit(1)))
        span = F.transform(at, lambda i: F.slice("near", i, F.size("w") + slop))
        fits = F.exists(span, lambda s: F.size(F.array_except("w", s)) == 0)
    return p.join(k, same & fits).select("doc_id", "h", start.alias("start"), F.size("w").alias("n"), "w", "item_ids")


def found_in(corpus: DataFrame, items: DataFrame, slop: int | None = None) -> DataFrame:
    """All exact matches of the items' windows in corpus (doc_id, text); with a slop, all
    proximity matches: spans of a window's length plus slop words that have all its terms."""
    wins = store(windows(items), "leak-windows")
    keys = store(keyed(corpus, wins), "leak-keys")
    return matches(store(index(corpus, keys, WINDOW - 1 + (slop or 0)), "leak-index"), keys, slop)


def report(corpus: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    corpus = corpus.select("doc_id", "text")
    found = found_in(corpus, items)
    # The spans of one document, merged in order of their starts.
    merged = F.aggregate(F.array_sort(F.collect_set(F.struct("start", "n"))), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit")),
                         lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["n"]).alias("end"),
                                               (a["hit"] + F.greatest(s["start"] + s["n"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("hit")), lambda a: a["hit"])
    per = found.groupBy("doc_id", "h").agg(merged.alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("ids")).alias("b")
    docs = corpus.select("doc_id", F.xxhash64("text").alias("h"), word_count(low(F.col("text")), GAP).alias("n_words")).alias("a")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return docs.join(per, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h")), "left").select(
        "a.doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "a.h")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') t FROM documents),
b AS (SELECT item_id::VARCHAR item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') t FROM benchmark),
w AS (SELECT DISTINCT item, least(len(t), 10) n, array_to_string(t[i:i + 9], ' ') w FROM (SELECT item, t, unnest(range(1, greatest(len(t) - 8, 2))) i FROM b WHERE len(t) > 0)),
l AS (SELECT DISTINCT n FROM w),
g AS (SELECT rid, n, i, array_to_string(t[i:i + n - 1], ' ') w FROM (SELECT rid, t, n, unnest(range(1, len(t) - n + 2)) i FROM d, l WHERE len(t) >= n)),
m AS (SELECT g.rid, g.i, g.n, w.item FROM g JOIN w ON g.n = w.n AND g.w = w.w),
p AS (SELECT rid, count(*) n_hit FROM (SELECT DISTINCT rid, i + unnest(range(0, n)) p FROM (SELECT DISTINCT rid, i, n FROM m)) GROUP BY rid),
k AS (SELECT rid, count(*) n_items, string_agg(item, ',' ORDER BY item) ids FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, len(t)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN k USING (rid)
"""
