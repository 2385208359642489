import os

import pytest
from pyspark.sql import functions as F

from auditloom.operators import findings as fd
from auditloom.plans import incremental
from auditloom.plans import rules as rl
from auditloom.plans import scan as sc
from auditloom.sources import srctree, widetree
from auditloom.streaming import watch

WIDE = {**srctree.LIMITS, "maxEntries": 10**7, "maxTotalBytes": 1 << 40}


def listing(spark, root, excludes):
    found = widetree.entries(spark, str(root), excludes).cache()
    kept = {(r["path"], r["size"]) for r in found.filter("NOT folder AND reason IS NULL").collect()}
    left = {r["path"]: r["reason"] for r in widetree.exclusions(found).collect()}
    return found, kept, left


def test_wide_listing_equals_the_driver(spark, tmp_path):
    """A tree of 100,000 entries, of several depths, with entries of every kind."""
    for a in range(100):
        for b in range(8):
            d = tmp_path / f"p{a}" / ("tests" if b == 3 else "node_modules" if b == 5 else f"d{b}")
            d = d.joinpath(*["x"] * (a % 3))
            os.makedirs(d)
            for k in range(124):
                name = ("m%d.py", "r%d.md", "o%d.sarif", ".env.%d", "Dockerfile.%d")[k % 5] % k
                fd_ = os.open(d / name, os.O_CREAT | os.O_WRONLY)
                os.write(fd_, b"x" * (k % 7))
                os.close(fd_)
    os.symlink(tmp_path / "p0", tmp_path / "p1" / "node_modules" / "link")
    excludes = ["tests/**", "p7/d0/**"]
    kept, left = srctree.discover(str(tmp_path), excludes, WIDE)
    found, got, reasons = listing(spark, tmp_path, excludes)
    assert got == set(kept) and reasons == left and len(kept) > 40_000 and len(left) > 20_000
    few = found.filter("path LIKE 'p1/d_/%' OR path LIKE 'p2/d1/%'")
    read = {r["path"]: bytes(r["content"]) for r in widetree.contents(few, str(tmp_path)).collect()}
    assert read == {p: (tmp_path / p).read_bytes() for p, _ in kept if p.startswith(("p1/d", "p2/d1/"))} and len(read) > 300


def test_wide_listing_refuses_links_and_depth(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert widetree.entries(spark, str(tmp_path), []).count() == 2
    with pytest.raises(ValueError, match="deeper"):
        widetree.entries(spark, str(tmp_path), [], depth=1)
    os.symlink("/etc/hosts", tmp_path / "a" / "l.py")
    with pytest.raises(ValueError, match="a/l.py"):
        widetree.entries(spark, str(tmp_path), [])
    with pytest.raises(ValueError, match="no such folder"):
        widetree.entries(spark, str(tmp_path / "none"))


RULES = rl.Catalog(r for r in rl.builtin().rules if r["id"] in ("GDPR-ART32-002", "EUAIA-ART05-002"))
VERSIONS = [
    [("a.txt", "verify = False\n", 1), ("b.py", "compute_social_score(1)\n", 1), ("c.txt", "fine\n", 1)],
    [("a.txt", "x\nverify = False\n", 2), ("c.txt", "verify = False\n", 2), ("c.txt", "verify = False\nverify=False\n", 3), ("d.txt", "verify = False", 1)],
    [("b.py", None, 2), ("d.txt", "verify = False", 2), ("gone.txt", None, 1)],
    [("b.py", "x = 1\ncompute_social_score(2)\n", 3), ("a.txt", "x\nverify = False\n", 3)],
]


def test_replay_of_versions_equals_the_differences_of_full_scans(spark, tmp_path):
    schema = "path string, text string, version long"
    source = str(tmp_path / "in")
    for k, rows in enumerate(VERSIONS):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        for name in os.listdir(source):  # one file a batch, in order
            if name.startswith("part-"):
                os.rename(f"{source}/{name}", f"{source}/v{k}.parquet")
                os.utime(f"{source}/v{k}.parquet", (k + 1, k + 1))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    store, out = incremental.Store(spark, f"file://{tmp_path}/store"), str(tmp_path / "out")
    watch.watch(stream, store, RULES, out, str(tmp_path / "check")).awaitTermination()
    files, before = {}, None
    for k, rows in enumerate(VERSIONS):
        for path, text, _ in sorted(rows, key=lambda r: r[2]):
            files[path] = text
        now = sc.scan(spark.createDataFrame([(p, t) for p, t in files.items() if t is not None], "path string, text string"), RULES).select(*watch._KEPT)
        want = fd.baseline_diff(now, before if before is not None else now.limit(0), watch._KEPT)
        assert sorted(map(str, spark.read.parquet(f"{out}/batch={k}").collect())) == sorted(map(str, want.collect()))
        before = now
    assert store.generations() == [0, 1, 2, 3] and store.findings().count() == before.count() > 3
    # The last batch again, as after a failure: the same changes, and the same state.
    store.rewind(3)
    again = watch.advance(store, spark.createDataFrame(VERSIONS[3], schema), RULES)
    assert sorted(map(str, again.collect())) == sorted(map(str, spark.read.parquet(f"{out}/batch=3").collect()))
    assert store.findings().count() == before.count()
    touched = {r["path"]: r["text"] for r in watch.last_versions(spark.createDataFrame([("p", None, 2), ("p", "old", 1), ("q", "b", 1), ("q", "a", 1), ("q", None, 1)], schema)).collect()}
    assert touched == {"p": None, "q": "b"}
    assert incremental.scan(store, spark.createDataFrame([], "path string, text string"), RULES, gone=spark.createDataFrame([], "path string"))[0].filter(F.col("path") == "a.txt").count() == 1
