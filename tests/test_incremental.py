import hashlib
import json

import pytest
from pyspark.sql import functions as F

from auditloom.operators import findings as fd
from auditloom.operators import merkle
from auditloom.plans import corpus, incremental
from auditloom.plans import rules as rl
from auditloom.plans import scan as sc

#: Rules of three engines; the first test takes all.
RULES = rl.Catalog(r for r in rl.builtin().rules if r["id"] in ("EUAIA-ART05-001", "EUAIA-ART05-003", "GDPR-ART05-002", "GDPR-ART05-003", "GDPR-ART32-002"))
PLACE = ("id", "rule_id", "path", "start_line", "end_line", "start_col", "target", "snippet")


def files(n=60, edit=()):
    """n template files; of those in edit the text is another template's."""
    out = []
    for k in range(n):
        name, text, _ = corpus.TEMPLATES[k % len(corpus.TEMPLATES)]
        if k in edit:
            text = text.replace("deepface", "fer") + "\nverify = False\n" if name.endswith((".txt", ".js")) else text + "\n# verify = False\n"
        out.append((f"r{k}/{name}", text))
    return out


def rows(df):
    return sorted(map(str, df.select(*PLACE).collect()))


@pytest.fixture
def store(spark, tmp_path):
    return incremental.Store(spark, f"file://{tmp_path}/store")


def counted(spark, seen):
    """A scan that says how many files it has parsed."""
    def engine(sources, catalog, marker):
        seen.append(sources.count())
        return sc.scan(sources, catalog, marker)

    return engine


def test_second_scan_parses_changed_files_and_equals_a_full_one(spark, store):
    seen = []
    df = lambda rows: spark.createDataFrame(rows, "path string, text string")
    every = rl.builtin()
    first, what = incremental.scan(store, df(files()), every, engine=counted(spark, seen))
    assert seen == [60] and rows(first) == rows(sc.scan(df(files()), every)) and {r["change"] for r in what.collect()} == {"new"}
    later = [f for f in files(edit=(17, 30)) if not f[0].startswith("r5/")] + [("r99/people.js", corpus.TEMPLATES[8][1]), ("r98/empty.txt", "")]
    second, what = incremental.scan(store, df(later), every, engine=counted(spark, seen))
    assert seen == [60, 4] and rows(second) == rows(sc.scan(df(later), every))
    changes = {r["path"]: r["change"] for r in what.collect()}
    assert {p: c for p, c in changes.items() if c != "same"} == {f"r17/{corpus.TEMPLATES[17][0]}": "changed", f"r30/{corpus.TEMPLATES[30 - 19][0]}": "changed", f"r5/{corpus.TEMPLATES[5][0]}": "gone", "r99/people.js": "new", "r98/empty.txt": "new"}
    third, _ = incremental.scan(store, df(later), every, engine=counted(spark, seen))
    assert seen[-1] == 0 and rows(third) == rows(second)
    fewer = RULES
    fourth, what = incremental.scan(store, df(later), fewer, engine=counted(spark, seen))
    assert seen[-1] == len(later) and rows(fourth) == rows(sc.scan(df(later), fewer)) and {r["change"] for r in what.collect()} == {"rules"}
    gone, _ = incremental.scan(store, df(later).limit(0), fewer)
    assert gone.count() == 0 and store.generations() == [0, 1, 2, 3, 4]


def test_texts_of_known_files_are_not_read(spark, store):
    """With digests at hand, a text that must not be read again can be absent."""
    known = [(p, t, hashlib.sha256(t.encode()).hexdigest(), len(t.encode())) for p, t in files(20)]
    schema = "path string, text string, sha256 string, size_bytes long"
    first, _ = incremental.scan(store, spark.createDataFrame(known, schema), RULES)
    bare = [(p, None if k else t + "\n", s if k else "other", n) for k, (p, t, s, n) in enumerate(known)]
    second, _ = incremental.scan(store, spark.createDataFrame(bare, schema), RULES)
    assert rows(second) == rows(first) and len(rows(first)) > 5


def test_a_run_that_died_leaves_the_last_scan(spark, store):
    df = spark.createDataFrame(files(12), "path string, text string")
    first, _ = incremental.scan(store, df, RULES)
    want = rows(first)

    def dies(sources, catalog, marker):
        return sc.scan(sources, catalog, marker).withColumn("id", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception, match="lost"):
        incremental.scan(store, spark.createDataFrame(files(12, edit=(8,)), "path string, text string"), RULES, engine=dies)
    assert store.generations() == [0] and rows(store.findings()) == want
    again, _ = incremental.scan(store, spark.createDataFrame(files(12, edit=(8,)), "path string, text string"), RULES)
    assert store.generations() == [0, 1] and rows(again) != want


def test_compaction_and_manifest(spark, store):
    df = lambda edit: spark.createDataFrame(files(25, edit), "path string, text string")
    for edit in ((), (3,), (3, 4)):
        last, _ = incremental.scan(store, df(edit), RULES)
    want = rows(last)
    entries = [{"path": p, "sha256": hashlib.sha256(t.encode()).hexdigest(), "size_bytes": len(t.encode())} for p, t in files(25, (3, 4))]
    entries.sort(key=lambda e: e["path"].split("/"))
    assert incremental.manifest_hash(store) == sc.fingerprint(entries)
    incremental.compacted(store)
    assert store.forget() == [0, 1, 2] and store.generations() == [3] and rows(store.findings()) == want
    again, what = incremental.scan(store, df((3, 4)), RULES)
    assert rows(again) == want and {r["change"] for r in what.collect()} == {"same"}


# -- digests and places -----------------------------------------------------

def test_scan_ids_and_manifests_by_definition(spark):
    ids = [("a", f"{k * 7919 % 1000:04}") for k in range(1000)] + [("b", "x"), ("b", "x"), (None, "y")]
    df = spark.createDataFrame(ids, "scan string, id string").repartition(5)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {k: sha("|".join(sorted(i for s, i in ids if s == k))) for k in ("a", "b", None)}
    assert {r["scan"]: r["scan_id"] for r in fd.scan_id(df, "scan").collect()} == want
    assert fd.scan_id(df).collect()[0][0] == sha("|".join(sorted(i for _, i in ids)))
    assert fd.scan_id(df.limit(0)).collect()[0][0] == sha(fd.EMPTY) and fd.scan_id(df.limit(0), "scan").count() == 0
    m = [("a/b.py", "00", 1), ("a-b/c.py", "11", 2), ("ä\n.py", "22", 3)]
    entries = spark.createDataFrame(m, "path string, sha256 string, size_bytes long")
    listed = [dict(zip(("path", "sha256", "size_bytes"), x)) for x in sorted(m, key=lambda x: x[0].split("/"))]
    assert fd.manifest_fingerprint(entries).first()[0] == sha(json.dumps(listed, separators=(",", ":"), sort_keys=True))
    assert fd.manifest_fingerprint(entries.limit(0)).first()[0] == sha("[]")


def test_places_equal_a_window(spark):
    from pyspark.sql import Window as W

    df = spark.range(5000).select((F.col("id") % 3).alias("scan"), F.when(F.col("id") % 50 == 0, None).otherwise(F.lit("k")).alias("part"), (F.col("id") * 7919 % 5003).alias("v"), F.col("id").alias("n"))
    for keys in ((), ("scan",), ("scan", "part")):
        got = {(r["n"], r["place"]) for r in fd.placed(df, *keys, order=[F.col("v")]).collect()}
        w = W.partitionBy(*keys).orderBy("v")
        assert got == {(r["n"], r["place"]) for r in df.withColumn("place", F.row_number().over(w)).collect()}
    assert fd.placed(df.limit(0), "scan", order=[F.col("v")]).count() == 0


def plain_root(entries):
    from collections import Counter

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    below = {}
    for e, n in Counter(entries).items():
        below.setdefault(sha(e)[:6], []).append(f"{sha(e)}:{sha(f'{e}*{n}')}")
    for depth in (4, 2, 0, None):
        level = {p: sha(",".join(sorted(c))) for p, c in below.items()}
        below = {}
        for p, d in level.items():
            below.setdefault(p[:depth], []).append(f"{p}:{d}")
    return level[""]


def test_trees_differences_and_proofs(spark):
    old = [f"e{k}" for k in range(700)] + ["hot"] * 500
    new = [e for e in old if e not in ("e5", "e600")] + ["x1", "x2", "hot"]
    df = spark.createDataFrame([("o", e) for e in old] + [("n", e) for e in new], "scan string, id string")
    t = merkle.tree(df, "scan")
    roots = {r["scan"]: (r["entries"], r["root"]) for r in t.roots().collect()}
    assert roots == {"o": (len(old), plain_root(old)), "n": (len(new), plain_root(new))}
    a, b = (merkle.tree(df.filter(F.col("scan") == s).select("id")) for s in ("n", "o"))
    got = {(r["entry"], r["change"], r["new_copies"], r["old_copies"]) for r in merkle.differences(a, b).collect()}
    assert got == {("e5", "gone", 0, 1), ("e600", "gone", 0, 1), ("x1", "new", 1, 0), ("x2", "new", 1, 0), ("hot", "count", 501, 500)}
    assert merkle.differences(a, a).count() == 0
    wanted = spark.createDataFrame([("n", "x1"), ("n", "hot"), ("n", "e5"), ("o", "e5")], "scan string, entry string")
    found = {(p["scan"], p["entry"]): p for p in merkle.proofs(t, wanted).collect()}
    assert set(found) == {("n", "x1"), ("n", "hot"), ("o", "e5")}
    for (s, e), p in found.items():
        root = roots[s][1]
        assert merkle.verified(root, p["place"], e, p["copies"], p["path"])
        assert not merkle.verified(root, p["place"], e + "!", p["copies"], p["path"]) and not merkle.verified("0" * 64, p["place"], e, p["copies"], p["path"])
        assert not merkle.verified(root, p["place"], e, p["copies"] + 1, p["path"])
    assert merkle.tree(df.limit(0), "scan").roots().count() == 0


def test_published_files(spark):
    version = json.dumps({"urls": [{"filename": "a.whl", "yanked": False, "digests": {"sha256": "1"}}, {"filename": "b.whl", "yanked": True, "digests": {"sha256": "2"}}, {"filename": "c.whl", "digests": {"sha256": "3"}}]})
    simple = json.dumps({"files": [{"filename": "d.whl", "yanked": "", "hashes": {"sha256": "4"}}, {"filename": "e.whl", "yanked": "broken", "hashes": {"sha256": "5"}}, {"filename": "a.whl", "yanked": False, "hashes": {"sha256": "1"}}]})
    answers = spark.createDataFrame([(version,), (simple,), ("no json",), (None,)], "payload string")
    listed = fd.published_files(answers)
    assert {(r["filename"], r["sha256"], r["yanked"]) for r in listed.collect()} == {("a.whl", "1", False), ("b.whl", "2", True), ("c.whl", "3", False), ("d.whl", "4", True), ("e.whl", "5", True)}
    mine = spark.createDataFrame([("a.whl", "1"), ("b.whl", "2"), ("c.whl", "9"), ("d.whl", "0"), ("f.whl", "1")], "filename string, sha256 string")
    assert {tuple(r) for r in fd.published_differences(mine, listed).collect()} == {("b.whl", "yanked"), ("c.whl", "changed"), ("d.whl", "yanked"), ("f.whl", "missing")}
