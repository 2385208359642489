"""Findings on a stream of sources.

`text_findings` is a projection with an explode, so it needs no state, watermark or trigger
of its own; each micro-batch's findings are those that a batch scan of its rows gives.

`watch` runs all engines. What it must remember of a file, its last digest and findings, is
the store of `plans.incremental`: each micro-batch scans the files whose digest is not the
stored one, and writes what changed of their findings. A micro-batch that is run again after a
failure starts from the state before it, which the store keeps, and overwrites its own
output, so every change is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import MARKER, suppressed
from ..operators import facts as ft
from ..operators import findings as fd
from ..operators import match
from ..plans import incremental
from ..plans.rules import Catalog
from ..sources.tables import stored


def text_findings(stream: DataFrame, catalog: Catalog, marker: str = MARKER) -> DataFrame:
    """stream: path, text. path, line, rule_id, target, start, length for every match that the
    line itself does not suppress."""
    hits = match.regex_hits(ft.line_table(stream), catalog).withColumn("_s", suppressed(F.col("text"), marker, ",;#/"))
    kept = hits.filter(~F.array_contains("_s", F.col("hit.rule_id")) & ~F.array_contains("_s", "ALL"))
    return kept.select("path", "line", "hit.rule_id", "hit.target", "hit.start", "hit.length")


_KEPT = ("id", "rule_id", "path", "start_line")


def last_versions(batch: DataFrame) -> DataFrame:
    """path, text, version: of each path the row of the highest version (of equal ones the greatest text; a
    deletion, whose text is null, comes before a text). One sum per task, so a path that changes
    very often meets in no task."""
    return batch.groupBy("path").agg(F.max(F.struct("version", F.col("text").isNotNull().alias("there"), "text")).alias("m")).select("path", "m.text", "m.version")


def advance(store: incremental.Store, batch: DataFrame, catalog: Catalog, marker: str = MARKER) -> DataFrame:
    """change (`new` or `gone`) and the findings that differ since the store's last state, which becomes that of
    the batch. batch: path, text (null: deleted), version."""
    last = stored(last_versions(batch), "watch-batch")
    before = store.findings()
    there, away = last.filter("text IS NOT NULL"), last.filter("text IS NULL")
    touched = last.select("path")
    if before is not None:
        before = stored(before.join(touched, "path", "left_semi").select(*_KEPT), "watch-before")
    now, _ = incremental.scan(store, there.select("path", "text"), catalog, marker, gone=away)
    now = now.join(touched, "path", "left_semi").select(*_KEPT)
    return fd.baseline_diff(now, before if before is not None else now.limit(0), _KEPT)


def watch(stream: DataFrame, store: incremental.Store, catalog: Catalog, out: str, checkpoint: str, marker: str = MARKER, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query over stream (path, text, version). Its changes go to out/batch=<n>, as Parquet."""

    def one(batch: DataFrame, n: int) -> None:
        store.rewind(n)
        advance(store, batch, catalog, marker).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
