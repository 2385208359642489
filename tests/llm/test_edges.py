import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm import common, language_model, queries

TABLES = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<float>, label int"}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_on_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline_leaves_one_table(spark):
    before = common.stored_count()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert common.stored_count() == before + 1 and out.count() > 0


def test_very_long_text_and_clashing_columns_of_counts(spark):
    long_ = "word1 Word2, ünï " * 60_000
    rows = [(1, long_, "x", 5), (2, None, "x", 5), (2, None, "x", 5), (3, "", "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, total string, part int")
    model = language_model.train(df.select("doc_id", "text", "total"))
    got = language_model.score(df, model).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {1: 180_001, 2: 1, 3: 1} and len(got) == 4 and all(r["total"] == "x" for r in got)
    assert model["tokens"] == 180_004 and all(r["score"] < 0 for r in got)


def test_seats_are_one_partition_each(spark):
    for n in (1, 4, 33):
        s = language_model.seats(spark, n)
        got = spark.createDataFrame([(x,) for x in s], "seat int").repartition(n, "seat").select(F.spark_partition_id().alias("p"), "seat").collect()
        assert sorted(r["p"] for r in got) == list(range(n)) and {r["seat"]: r["p"] for r in got} == {x: k for k, x in enumerate(s)}


def test_entry_without_the_folders(tmp_path):
    """The other queries remain, and a missing library of these operators is no reason to drop them."""
    import os
    import shutil

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r").returncode == 0
    code = "import sys; sys.modules['zstandard'] = None\ntry:\n    import __spark_entry__\nexcept ModuleNotFoundError as e:\n    assert e.name == 'zstandard'\nelse:\n    raise SystemExit(1)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
