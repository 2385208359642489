import corpus_pipeline as cp
from auditloom.llm import decontamination, mixing, near_dedup, surrogates
from auditloom.llm.common import word_count
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(1)
    docs = docs.unionByName(extra)  # a repeated row
    seen = []
    for name, stage in cp.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        path = f"{cp.store.__globals__['shared_dir'](spark)}/test-{len(seen)}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        seen.append((name, before, docs))
    (_, whole, good), (_, _, one), (_, _, clean), (_, _, private), (_, _, mixed) = seen
    for _, before, after in seen[:4]:
        assert after.columns == before.columns
    assert 100 < good.count() < whole.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lost = whole.join(good, "doc_id", "left_anti").join(labels, "doc_id")
    assert lost.filter("quality = 1").count() <= 2
    kept = near_dedup.near_duplicates(good).filter("kept").select("doc_id").distinct()
    assert sorted(r[0] for r in kept.collect()) == sorted(r["doc_id"] for r in one.select("doc_id").collect())
    rep = decontamination.report(one, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert sorted(r["doc_id"] for r in rep.filter("NOT contaminated").collect()) == sorted(r["doc_id"] for r in clean.collect())
    assert private.filter(F.col("text").rlike(surrogates.UNION)).count() > 0
    old = {r["doc_id"]: r["text"] for r in clean.collect()}
    new = {r["doc_id"]: r["text"] for r in private.collect()}
    assert old.keys() == new.keys() and any(old[k] != new[k] for k in old)
    plan = mixing.mix(private.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    want = sorted((r["doc_id"], c) for r in plan.collect() for c in range(1, r["copies"] + 1))
    assert sorted((r["doc_id"], r["copy"]) for r in mixed.collect()) == want


def odd_rows(spark):
    text = " ".join(f"word{i % 37} here" for i in range(60)) + "."
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, None, None, "a", None), (3, text, "en", None, 5), (3, text, "en", None, 5), (4, text.upper(), "en", "b", 5),
            (5, text + " Call +1 (017) 555-7713 or a.b@mail1.example.com now.", "de", "b", 9), (6, "long " * 200_000, "en", "b", 1), (6, "other text", "en", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # Names that the stages themselves use.
    return df.selectExpr("*", "1 AS h", "2 AS len", "3 AS copies", "'x' AS class", "0.5D AS score", "4 AS size", "'y' AS kind", "5 AS n_entities", "6 AS c", "7 AS th")


def test_stages_take_odd_rows_and_clashing_columns(spark):
    for docs in (odd_rows(spark), odd_rows(spark).limit(0)):
        for k, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns + ["copy"] * (k == 4)
            rows = out.collect()
            assert len(rows) <= docs.count() * 3
            assert docs.count() == 0 or all(r["score"] == 0.5 and r["h"] == 1 and r["kind"] == "y" for r in rows)
    kept = cp.near_dedup_stage(spark, odd_rows(spark), SF).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "3", "6", "6", "None"]
    new = {r["doc_id"]: r["text"] for r in cp.private_data(spark, odd_rows(spark), SF).collect()}
    assert "555-7713" not in new[5] and new[None] is None and new[1] == ""
