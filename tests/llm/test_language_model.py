import math
import zlib
from collections import Counter, defaultdict

import pytest

from auditloom.llm import language_model as lm

TEXTS = ["a b c a b", "A B c", "a b\td  a", None, "", "   ", "x y x y x y", "c b a a b c", "éa b", "a b c a b"]


def brute(train):
    """P(w|u) by definition, over strings."""
    toks = [[*("" if t is None else t.lower()).split(), "</s>"] for t in train]
    uni, bi = Counter(w for t in toks for w in t), Counter((u, w) for t in toks for u, w in zip(["<s>", *t], t))
    ctx, left = defaultdict(list), Counter()
    for (u, w), c in bi.items():
        ctx[u].append(c)
        left[w] += 1
    d = lm.discounts([sum(c == k for c in bi.values()) for k in (1, 2, 3, 4)])
    e = lm.discounts([sum(c == k for c in left.values()) for k in (1, 2, 3, 4)])
    D = lambda c, x: x[min(c, 3) - 1] if c else 0.0
    v, pairs = len(uni), len(bi)

    def low(w):
        if not pairs:
            return 1 / (v + 1)
        return (left[w] - D(left[w], e) + sum(D(c, e) for c in left.values()) / (v + 1)) / pairs

    def p(u, w):
        total = sum(ctx[u])
        if not total:
            return low(w)
        return (bi[u, w] - D(bi[u, w], d) + sum(D(c, d) for c in ctx[u]) * low(w)) / total

    return uni, p


@pytest.mark.parametrize("train", [TEXTS, TEXTS[:1], []])
def test_scores_equal_the_definition(spark, train):
    docs = spark.createDataFrame([(i, t, "n_tokens") for i, t in enumerate(train)], "doc_id long, text string, total string")
    probe = [*TEXTS, "never seen", "b b b"]
    model = lm.train(docs)
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame([(i, t, "") for i, t in enumerate(probe)], "doc_id long, text string, base string"), model).collect()}
    uni, p = brute(train)
    n, v = sum(uni.values()), len(uni)
    assert model["tokens"] == n and model["size"] == v
    for i, t in enumerate(probe):
        toks = [*(t or "").lower().split(), "</s>"]
        r = got[i]
        assert r["n_tokens"] == len(toks) and r["n_known"] == sum(w in uni for w in toks)
        assert r["base_score"] == pytest.approx(sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks))
        assert r["score"] == pytest.approx(sum(math.log10(p(u, w)) for u, w in zip(["<s>", *toks], toks)))
    if train:
        assert sum(p("a", w) for w in [*uni, "unknown"]) == pytest.approx(1)


def test_query_on_the_fold(spark):
    sf = "/root/testdata/sf0.001"
    rows = lm.op6_language_model(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    held = {d["doc_id"] for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 10 == 0}
    assert {r["doc_id"] for r in rows if r["held_out"]} == held
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
