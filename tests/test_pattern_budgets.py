import random
import re
import time

import pytest
from pyspark.sql import functions as F

from auditloom.functions.cost import growth, longest_line
from auditloom.operators import facts as ft
from auditloom.operators import match, pattern_index
from auditloom.plans import rules as rl
from auditloom.plans import scan as sc


def catalog(*targets, builtin=False):
    base = rl.builtin().rules[0]
    rules = [{**base, "id": f"TEST-GEN-{k:03}", "patterns": [{"type": "regex", "target": t}]} for k, t in enumerate(targets)]
    return rl.Catalog([*(rl.builtin().rules if builtin else []), *rules])


@pytest.mark.parametrize("pattern, power", [
    ("abc", 1), ("^abc", 0), ("^.*x", 1), (".*x", 2), (r"\w+\s*=", 2), (r"\w+\w+=", 3), (".*.*.*x", 4), ("(a+)+$", None), ("(a|a)*b", None), ("(a|b)*c", 2), ("(ab|ac)*d", 2), ("(b|bc)*d", None), ("(a*)*b", None), (r"(.)\1x", None), ("(?:x?){50}y", None),
    ("a{1,30}b", 1), (r"foo(?!.*bar)", 2), (r"(\w*\d)+!", None), ("(?>a+)+b", 3), ("a++b", 2), ("", 1), ("(?i:a)b", None),
])
def test_growth_of_patterns(pattern, power):
    g = growth(pattern)
    assert (g and g[0]) == power
    assert (longest_line(pattern) == -1) == (power is None)


def test_no_pattern_within_its_bound_is_slow():
    """Patterns that are put together at random, on lines that make them go back, of the length that is allowed."""
    rng, tried = random.Random(2), 0
    piece = ["a", "a*", "a+", "(a|b)*", "(ab)*", "[ab]+", "b?", "(a|ab)", "a{0,9}", ".*", "(?!a+b)", "(a+)+", "(?:a|b|ab)+", "\\w*", "c"]
    for _ in range(1500):
        p = "".join(rng.choice(piece) for _ in range(rng.randint(1, 4))) + "!"
        most = longest_line(p, 200_000)
        if most <= 0:
            continue
        tried += 1
        for line in ("a" * min(most, 5000), "ab" * (min(most, 5000) // 2)):
            began = time.process_time()
            re.search(p, line)
            assert time.process_time() - began < 1.0, (p, most)
    assert tried > 300


WORDS = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet"]


def many(n, rng):
    forms = [r"(?i){a}_{b}\s*=", r"\b{a}{b}[0-9]{{3}}", r"(?:{a}|{b})-{a}", r"{a}\({b}", r"[0-9]{{4}}{a}", r"(?i)\b{a}\W{{1,3}}{b}\b", "{a}.{b}", r"x{{2}}{a}{b}"]
    return [rng.choice(forms).format(a=rng.choice(WORDS) + str(k % 7), b=rng.choice(WORDS)) for k in range(n)]


def hits(df):
    return sorted((r["path"], r["line"], r["text"], str(r["hit"])) for r in df.select("path", "line", "text", "hit").collect())


def test_indexed_patterns_find_what_all_patterns_find(spark):
    rng = random.Random(7)
    targets = [*many(120, rng), r"(?i)ſkip_ſet", "kelvin_(one|two|three)", "[0-9]{6}", "a.", "(?i)istanbul"]
    some = [w + d for w in WORDS for d in ("", "1", "2", "3")]
    glue = ["_", " = ", "-", "(", " ", "\n", "123", "4567", "xx", ". ", "SKIP_SET", "Kelvin_one", "kelvin_TWO", "İSTANBUL", "ıstanbul"]
    files = [(f"f{k}", "".join(rng.choice(some + glue) for _ in range(rng.randint(0, 40)))) for k in range(600)] + [("none", None), ("empty", ""), ("long", "alpha1_bravo = " * 3000)]
    df = spark.createDataFrame(files, "path string, text string")
    cat = catalog(*targets)
    assert len([t for t in targets if match.factors(t)]) > match.INDEXED
    want = hits(match.regex_hits(ft.line_table(df), cat))
    assert hits(match._in_bounds(df, cat).unionByName(match._or_fail(match._beyond_bounds(df, cat)))) == want and len(want) > 800
    index = [(i, j, r["id"], p["target"], match.factors(p["target"]), 1 << 30) for i, j, r, p in cat.patterns("regex") if match.factors(p["target"])]
    alone = match.regex_hits(ft.line_table(df), cat, only={x[:2] for x in index})
    assert len(hits(pattern_index.indexed_hits(df.filter("path <> 'long'"), index, ft.line_table))) == len(hits(alone.filter("path <> 'long'")))


def test_branching_expressions():
    rng = random.Random(1)
    for n in (3, 4, 6):
        words = {"".join(rng.choice("ab.[0") for _ in range(n)) for _ in range(40)}
        c = re.compile(pattern_index.branching(words))
        assert all(c.fullmatch(w) for w in words)
        assert not any(c.fullmatch(w) for w in {"".join(rng.choice("ab.[0") for _ in range(n)) for _ in range(200)} - words)


def test_a_slow_pattern_fails_its_file_within_two_seconds_and_names_it(spark):
    files = [("ok.txt", "verify = False\naaa!\n"), ("slow.txt", "fine\n" + "a" * 45 + "!\nverify = False\n"), ("also.txt", "aa\n"), ("none.txt", None)]
    df = spark.createDataFrame(files, "path string, text string").coalesce(1)
    cat = catalog("^(a|aa)+$", builtin=True)
    began = time.monotonic()
    found, failed = sc.scan_all(df, cat)
    bad = failed.collect()
    assert [r["path"] for r in bad] == ["slow.txt"] and "slow.txt" in bad[0]["error"] and "TEST-GEN-000" in bad[0]["error"]
    assert {(r["path"], r["rule_id"], r["start_line"]) for r in found.collect()} == {("ok.txt", "GDPR-ART32-002", 1), ("also.txt", "TEST-GEN-000", 1)}
    with pytest.raises(Exception, match="budget for slow.txt"):
        sc.scan(df, cat).collect()
    spent = time.monotonic()
    timed = match.timed_hits(ft.line_table(df), [(0, 0, "R", "^(a|aa)+$", -1)]).filter("error IS NOT NULL").collect()
    assert len(timed) == 1 and time.monotonic() - spent < match.SECONDS + 8 and began < spent


def test_catalogs_without_custom_patterns_run_in_the_jvm(spark):
    df = spark.createDataFrame([("a.txt", "verify = False")], "path string, text string")
    assert match.timed(df, rl.builtin()) is None
    plan = match.regex_findings(df, rl.builtin())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInPandas" not in plan
    found, failed = sc.scan_all(df, rl.builtin())
    assert found.count() == 1 and failed.count() == 0
    assert match.over_time_budget(None, df.filter(F.lit(False))).count() == 0
