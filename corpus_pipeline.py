"""Documents to a training mix in five stages, each on all that its predecessor kept.

Each stage's result is written as Parquet in the shared folder and read again. The
first four return the columns of documents; the last adds `copy`, as a document
that the mix takes several times stands there as often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import compression_quality, decontamination, mixing, near_dedup, surrogates
from auditloom.llm.common import drop_stored, store, stored_count, table, word_count

#: Key lists up to this length are sent to the executors; longer ones are joined by a shuffle.
BROADCAST_ROWS = 300_000


def _keys(df: DataFrame, name: str) -> DataFrame:
    df = store(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _names(docs: DataFrame, *without: str) -> list[str]:
    return [f"`{c}`" for c in docs.columns if c not in without]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = compression_quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return compression_quality.score(docs, model, out="_al_score").filter("_al_score >= 0.3").select(*_names(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    keys = _keys(near_dedup.survivors(docs), "kept-rows").alias("k")
    d = docs.alias("d")
    met = d.join(keys, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64("d.text") == F.col("k.th")))
    met = met.select("d.*", F.col("k.copies").alias("_al_copies"), F.col("k.th").alias("_al_th"))
    # Repeated rows are few; only they are compared with each other.
    again = met.filter("_al_copies > 1").dropDuplicates(["doc_id", "_al_th"])
    return met.filter("_al_copies = 1").unionByName(again).select(*_names(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    hit = decontamination.found_in(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    keys = _keys(hit.select("doc_id", "h").distinct(), "leaking-rows").alias("k")
    d = docs.alias("d")
    return d.join(keys, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64("d.text") == F.col("k.h")), "left_anti").select(*_names(docs))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    out = surrogates.replace(docs, counted="_al_entities")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_al_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*_names(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    sized = docs.withColumns({"_al_size": word_count(F.col("text")), "_al_mark": F.xxhash64("text")})
    plan = mixing.mix(sized.select("doc_id", "source", F.col("_al_size").alias("size"), "_al_mark"), mark="_al_mark")
    # Rows of one id, source and text are one document, which stands for all of them.
    per = plan.groupBy("doc_id", "source", "mark").agg(F.sum("copies").alias("c"), F.count("*").alias("rows")).filter("c > 0")
    per = _keys(per, "mix-plan").alias("p")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d._al_mark") == F.col("p.mark")) & F.col("d.source").eqNullSafe(F.col("p.source"))
    met = sized.alias("d").join(per, same).select("d.*", F.col("p.c").alias("_al_c"), F.col("p.rows").alias("_al_rows"))
    several = met.filter("_al_rows > 1").dropDuplicates(["doc_id", "source", "_al_mark"])
    out = met.filter("_al_rows = 1").unionByName(several)
    return out.select(*_names(docs, "copy"), F.explode(F.sequence(F.lit(1), F.col("_al_c").cast("int"))).alias("copy"))


STAGES = [("quality classifier", quality), ("near-duplicates", near_dedup_stage), ("benchmark decontamination", decontaminate), ("personal data", private_data), ("mixing", mix)]

ORACLE_SQL = None  # trained and hashed stages; tests hold the result against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. What a stage has stored on its way is deleted with its input, once its
    own result is written."""
    docs, before = table(spark, sf_dir, "documents"), stored_count()
    for k, (_, stage) in enumerate(STAGES):
        docs = store(stage(spark, docs, sf_dir), f"pipeline-stage{k}")
        if not docs.isEmpty():  # an empty table's files can't be told from others
            drop_stored(spark, before, but=docs)
    return docs
