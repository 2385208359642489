import itertools
import re

import numpy as np

from auditloom.llm import filter_audit as fa


def plain_way(docs, labels):
    """Every order applied to every document."""
    good = {d for d, q, t in labels if q == 1 and d is not None}
    toxic = {d for d, q, t in labels if t == 1 and d is not None}
    rows = []
    for i, (d, text, part) in enumerate(docs):
        t, w = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs)}
        rows.append((part or "", d, fails))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = mine
            for k, f in enumerate(order):
                gone = [r for r in alive if r[2][f]]
                alive = [r for r in alive if not r[2][f]]
                shapley[f] += len(gone)
                failing = sum(r[2][f] for r in mine)
                only = sum(r[2][f] and sum(r[2].values()) == 1 for r in mine)
                out[part, "".join(order), k + 1] = [len(alive), len(gone), failing - len(gone), only, sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone)]
        for (p, o, k), v in out.items():
            if p == part:
                v.append(shapley[o[k - 1]])
    return out


def collected(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def test_all_orders_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    docs = []
    for d in range(120):
        n = int(rng.choice([3, 199, 200, 260]))
        w = [f"w{x}" for x in rng.integers(0, int(rng.choice([5, 4000])), n)]
        text = " ".join(w) + (" SHOUTING LOUD TEXT" * int(rng.choice([0, 0, 9]))) + str(rng.choice(["", "", " #tag"]))
        docs.append((d, text, str(rng.choice(["en", "de"]))))
    docs += [(d + 200, docs[d][1], "en") for d in range(0, 60, 3)]  # copies, also in another part
    docs += [(0, docs[0][1], "de"), (0, docs[0][1], "de"), (None, docs[1][1], None), (500, None, None), (501, "", ""), (502, "", "fr"), (503, "x " * 50_000, "fr"), (None, None, "fr")]
    labels = [(d, int(d % 3 == 0), int(d % 5 == 0)) for d in range(0, 230)] + [(0, 0, 1), (500, None, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], "doc_id long, text string, lang string, part string, mask int, good int")
    lab = spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, text string")
    got = collected(fa.interactions(fa.masks(df, lab)))
    want = plain_way(docs, labels)
    assert set(got) == set(want) and len(got) == 600 * 4
    assert got == want


def test_shapley_sums_to_all_removed_and_copies_of_any_number(spark):
    n = 5_000
    df = spark.range(n).selectExpr("id AS doc_id", "concat('same text of everyone', repeat(' more', 3)) AS text", "'en' AS lang").repartition(3)
    got = collected(fa.interactions(fa.masks(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))))
    assert got["en", "EABCD", 1][:3] == [1, n - 1, 0] and got["en", "AEBCD", 2][:3] == [0, 0, n - 1]
    assert sum(got["en", "ABCDE", k][6] for k in range(1, 6)) == 120 * n


def test_one_swap_between_neighbouring_orders():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in fa.swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == len(list(fa.swaps(n))) + 1 == [1, 2, 6, 24, 120][n - 1]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert fa.interactions(fa.masks(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0
