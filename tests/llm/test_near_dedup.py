import random
import re

import pytest
from pyspark.sql import functions as F

from auditloom.llm import near_dedup as nd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows):
    """component by id: every pair's full sets, no shortcuts."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, class string, n int")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(df).collect()]
    assert sorted(got, key=str) == brute(rows)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "Élan é"), (5, "Élan é"), (None, "a b c d e f g")]
    for g in range(12):
        base = [word() for _ in range(rng.choice((3, 12, 40, 150, 400)))]
        if g % 3 == 0:
            base = base + passage
        for _ in range(60 if g < 3 else 4):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 20)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows) * 7 % 5000, " ".join(w)))
    rows += [(9000 + i, " ".join(passage + [word() for _ in range(rng.randint(1, 30))])) for i in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    check(spark, corpus(seed))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(7, "a b c d e f g h"), (7, "a b c d e f g h"), (3, "A b c d e f g h")]])
def test_edges(spark, rows):
    check(spark, rows)


def test_query_on_the_small_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = nd.op1_near_dedup(spark, "/root/testdata/sf0.001").collect()
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=str) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_hot_values_are_sent_instead_of_shuffled(spark, monkeypatch):
    monkeypatch.setattr("auditloom.llm.common.HOT_ROWS", 4)
    check(spark, corpus(3))


def test_sets_of_one_digest_stay_apart(spark, monkeypatch):
    """With digests of three bits nearly all classes collide."""
    original = nd.signatures
    monkeypatch.setattr(nd, "signatures", lambda docs: original(docs).withColumn("class", F.pmod(F.col("class"), F.lit(8))))
    check(spark, corpus(4))


def test_measured_recall_near_the_limit(spark):
    """600 pairs with similarities from 0.75 to 0.8, far more than 32 shingles each: all are found."""
    rng, rows, linked = random.Random(5), [], 0
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    while linked < 600:
        a = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(150, 400))]
        b = list(a)
        for at in rng.sample(range(len(b)), len(b) // 40 + 1):
            b[at] = f"w{rng.randrange(10**6)}"
        x, y = shingles(a), shingles(b)
        if 0.75 <= len(x & y) / len(x | y) <= 0.8:
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
            linked += 1
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(linked)) == linked
