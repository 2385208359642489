import random

import pytest
from pyspark.sql import functions as F

from auditloom.llm import decontamination as dc
from auditloom.llm import url_filter

from .test_operators import brute_judge

URLS = "page_id long, url string, at string, n int, k int"


def judged(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "a", 1, 2) for i, u in enumerate(urls)], URLS)
    out = url_filter.judge(df, url_filter.rule_table(spark, rules))
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}


@pytest.mark.parametrize("hot", [4, 1000])
def test_frequent_long_and_missing_urls(spark, monkeypatch, hot):
    monkeypatch.setattr("auditloom.llm.common.HOT_ROWS", hot)
    rules = [("block", "b.com", "/x"), ("allow", "a.b.com", "/x/y"), ("block", "net", "/")]
    urls = ["http://q.b.com/x/1"] * 50 + ["http://free.org/"] * 50 + [None] * 50 + ["nothing"] * 5 + ["http://" + "a." * 3000 + "b.com/x", "http://a.b.com/x/y" + "z" * 20000, "http://" + "n" * 5000 + ".net/" + "p/" * 5000, "http://A.B.COM/x/y?q"]
    assert judged(spark, urls, rules) == {i: brute_judge(u, rules) for i, u in enumerate(urls)}


def test_no_pages_and_no_rules(spark):
    assert judged(spark, [], [("block", "a", "/")]) == {} == judged(spark, [], [])
    assert judged(spark, ["http://a.b/c", None], []) == {0: ("a.b", "/c", None, "allow"), 1: ("", "", None, "allow")}


# -- decontamination --------------------------------------------------------

def tables(spark, docs, items):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], "doc_id long, text string, pos int, term string, h string"), spark.createDataFrame([(i, t, "z", 1) for i, t in items], "item_id long, text string, w string, off int")


def hits(out):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in out.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_plan_equals_the_sent_one(spark, monkeypatch, seed):
    rng = random.Random(seed)
    item = lambda: " ".join(rng.choice("abcdefghij") + str(rng.randrange(9)) for _ in range(rng.randint(3, 40)))
    items = [(i, item()) for i in range(30)] + [(None, None), (31, "")]
    docs = [(i if i % 7 else None, " ".join(item() if rng.random() < 0.7 else rng.choice(items)[1] or "" for _ in range(4))) for i in range(60)]
    docs += [(100, " ".join("common word" for _ in range(10_000)) + " " + items[0][1]), (101, None), (102, ""), *[(103, items[1][1])] * 3]
    docs.append((104, " ".join(item() for _ in range(1_000))))
    d, b = tables(spark, docs, items)
    sent = hits(dc.report(d, b))
    monkeypatch.setattr(dc, "BROADCAST_BYTES", -1)
    out = dc.report(d, b)
    assert hits(out) == sent and sum(n > 0 for _, _, n, *_ in sent) > 10 and len(sent) == len(docs)


def test_a_long_text_is_not_copied_for_each_word(spark, monkeypatch):
    """20,000 words against shuffled terms: the shuffle carries words, not texts."""
    monkeypatch.setattr(dc, "BROADCAST_BYTES", -1)
    text = " ".join(f"w{i % 500}" for i in range(20_000))
    d, b = tables(spark, [(1, text)], [(1, " ".join(text.split()[5:40]))])
    wins = dc.store(dc.windows(b), "w")
    keys = dc.store(dc.keyed(d, wins), "k")
    plan = dc.index(d, keys)._jdf.queryExecution().executedPlan().toString()
    before = [line for line in plan.splitlines() if "posexplode" in line and "Generate" in line]
    assert before and all("[doc_id#" in line and ", t#" not in line.split("posexplode")[1].split("]")[0].replace("posexplode(t#", "") for line in before)
    assert dc.report(d, b).first()["n_hit"] > 20


def test_proximity_equals_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(60))) for i in range(40)]
    items = [(i, " ".join(rng.sample("abcdefghijklmnop", 4))) for i in range(6)]
    d, b = tables(spark, docs, items)
    for slop in (0, 2, 5):
        want = {(i, frozenset(t.split())) for i, x in docs for _, t in items for s in [set(t.split())] if any(s <= set(x.split()[k : k + 4 + slop]) for k in range(61))}
        got = {(r["doc_id"], frozenset(r["w"])) for r in dc.found_in(d.select("doc_id", "text"), b, slop).select("doc_id", "w").distinct().collect()}
        assert got == want and want
