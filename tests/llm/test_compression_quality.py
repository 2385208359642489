import random

import pytest
from pyspark.sql import functions as F

from auditloom.llm import compression_quality as cq


def corpus(spark, n=120):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["the", "house", "stands", "by", "river,", "and", "people", "walk", "there."]) for _ in range(80))
    bad = lambda: " ".join(rng.choice(["BUY", "$$$", "now!!!", "###", "click", "click", "***"]) for _ in range(80))
    rows = [(i, good() if i % 2 else bad(), 0.5) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, quality int")


def scores(df):
    return sorted((str(r["doc_id"]), r["text"] or "", r["score"]) for r in df.collect())


def test_whole_texts_enter_the_dictionaries(spark):
    """What tells a text's kind stands only after a long common beginning."""
    docs, labels = corpus(spark)
    long_ = docs.withColumn("text", F.concat(F.repeat(F.lit("same beginning of all texts "), 4000), F.repeat("text", 40)))
    model = cq.train(long_.select("doc_id", "text"), labels)
    got = cq.score(long_, model).collect()
    assert all((r["score"] > 0.5) == bool(r["doc_id"] % 2) for r in got) and set(map(len, model["dictionaries"].values())) == {2}


def test_repeated_rows_ties_and_clashing_columns(spark):
    docs, labels = corpus(spark)
    once = cq.train(docs.select("doc_id", "text"), labels)
    model = cq.train(docs.unionByName(docs).unionByName(docs).select("doc_id", "text"), labels.unionByName(labels).withColumn("text", F.lit("z")))
    assert model == once
    twice = cq.score(docs.unionByName(docs), model)
    assert twice.columns == ["doc_id", "text", "score"] and len(set(scores(twice))) * 2 == len(scores(twice))
    assert scores(twice)[::2] == scores(cq.score(docs.repartition(5), model))


@pytest.mark.parametrize("quality", [[], [1] * 30, [0] * 30, [None] * 30])
def test_missing_labels(spark, quality):
    docs, _ = corpus(spark, 30)
    model = cq.train(docs.select("doc_id", "text"), spark.createDataFrame(list(enumerate(quality)), "doc_id long, quality int"))
    got = {r["score"] for r in cq.score(docs, model).collect()}
    assert len(got) == 1 and 0 < got.pop() < 1 and cq.score(docs.limit(0), model).count() == 0
    assert 0 <= cq.score_text(None, model, {}) == cq.score_text(" \n", model, {}) <= 1


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = corpus(spark)
    turned = labels.withColumn("quality", F.when(cq.fold() == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert cq.train(docs.select("doc_id", "text"), labels) == cq.train(docs.select("doc_id", "text"), turned)
