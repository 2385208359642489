"""Many text patterns at once: a line meets only those that can match it.

Every match of a pattern holds one of its factors (`match.factors`). From each factor one gram, a
run of three, four or six characters, goes to a table (gram, factor, pattern). A line's own
grams that stand in that table are found in one pass each, by an expression that branches
letter by letter; an equi-join with the table, which the catalog's limits bound and which is
therefore sent, gives the patterns whose factor the line holds, and only these are
tried on it. Patterns without factors are not indexed.

Grams are compared in one spelling: small letters, every digit as 0, and the letters that
ignoring case takes for ASCII ones as these. That can offer a pattern too many, never too few.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import java_regex

#: Lengths of grams, the longest that a factor has first.
LENGTHS = (6, 4, 3)
_SPELLED = str.maketrans("123456789\u017f\u212a\u0131\u0130", "000000000skii")


def spelled(text: Column) -> Column:
    """A line as grams see it. Translation goes before the small letters, of which one capital has two."""
    return F.lower(F.translate(text, "".join(map(chr, _SPELLED)), "".join(map(chr, _SPELLED.values()))))


def grams(factors: list[list[str]]) -> list[tuple[str, str, int]]:
    """(gram, factor, pattern's place) of every factor: the gram that the fewest factors have."""
    texts = [[f.translate(_SPELLED).lower() for f in fs] for fs in factors]
    size = lambda f: next(n for n in LENGTHS if len(f) >= n)
    cut = lambda f: [f[k : k + size(f)] for k in range(len(f) - size(f) + 1)]
    seen = Counter(g for fs in texts for f in fs for g in set(cut(f)))
    return sorted({(min(cut(f), key=lambda g: (seen[g], g.count("0"), g)), f, k) for k, fs in enumerate(texts) for f in fs})


def branching(words: set[str]) -> str:
    """An expression for one of some words of one length, a choice for each letter."""
    if words == {""}:
        return ""
    by: dict[str, set[str]] = {}
    for w in words:
        by.setdefault(w[0], set()).add(w[1:])
    tails: dict[str, list[str]] = {}
    for c, rest in by.items():
        tails.setdefault(branching(rest), []).append(c)
    heads = [("[" + "".join(re.escape(c) for c in sorted(cs)) + "]" if len(cs) > 1 else re.escape(cs[0])) + t for t, cs in sorted(tails.items())]
    return heads[0] if len(heads) == 1 else "(?:" + "|".join(heads) + ")"


def _found(text: Column, known: set[str]) -> Column:
    """The distinct known grams of a text. Each place is looked at, so overlapping ones are all found."""
    out = F.array().cast("array<string>")
    for n in LENGTHS:
        own = {g for g in known if len(g) == n}
        if own:
            starts = "".join(re.escape(g) for g in sorted({g[0] for g in own}))
            out = F.concat(out, F.regexp_extract_all(text, F.lit(f"(?=[{starts}])(?=({branching(own)}))"), F.lit(1)))
    return F.array_distinct(out)


def may_hold(text: Column, known: set[str]) -> Column:
    """Whether a whole text has any known gram."""
    out = F.lit(False)
    for n in LENGTHS:
        own = {g for g in known if len(g) == n}
        if own:
            out = out | text.rlike(branching(own))
    return out


def indexed_hits(sources: DataFrame, patterns: list[tuple[int, int, str, str, list[str], int]], lines_of) -> DataFrame:
    """(rule order, pattern order, rule id, target, factors, longest line) of patterns against sources (path, text).
    path, line, text, hit as `match.regex_hits` gives them. lines_of: sources to a table of lines."""
    table = grams([p[4] for p in patterns])
    known = {g for g, _, _ in table}
    own = [[(f, g) for g, f, k in table if k == n] for n in range(len(patterns))]
    rows = [(g, f, own[k], *patterns[k][:4], java_regex(patterns[k][3]), patterns[k][5]) for g, f, k in table]
    index = sources.sparkSession.createDataFrame(rows, "gram string, factor string, all array<struct<factor:string,gram:string>>, rule_ord int, pattern_ord int, rule_id string, target string, java string, longest int")
    lines_ = lines_of(sources.filter(may_hold(spelled(F.col("text")), known)))
    lines_ = lines_.withColumn("_spelled", spelled(F.col("text"))).withColumn("gram", F.explode(_found(F.col("_spelled"), known)))
    met = lines_.join(F.broadcast(index), "gram").filter(F.contains("_spelled", F.col("factor")) & (F.length("text") <= F.col("longest")))
    # A pattern with several factors in a line counts for the first of them only.
    first = F.get(F.filter("all", lambda x: F.contains("_spelled", x["factor"])), F.lit(0))
    met = met.filter((first["factor"] == F.col("factor")) & (first["gram"] == F.col("gram")) & F.regexp_like("text", F.col("java")))
    flags = F.regexp_extract("java", r"^\(\?[A-Za-z]+\)", 0)
    body = F.substr("java", F.length(flags) + 1)
    before = F.call_function("regexp_extract", F.col("text"), F.concat(flags, F.lit("(?s:^(.*?))(?:"), body, F.lit(")")), F.lit(1))
    whole = F.call_function("regexp_extract", F.col("text"), F.col("java"), F.lit(0))
    hit = F.struct("rule_ord", "pattern_ord", "rule_id", "target", F.length(before).alias("start"), F.length(whole).alias("length"))
    return met.select("path", "line", "text", hit.alias("hit"))
