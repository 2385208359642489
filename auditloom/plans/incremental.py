"""Scans that parse only what has changed, on a store of findings.

A store is a folder of generations, one for each scan:

    <store>/manifest/gen=<n>   path, sha256, size_bytes, rules, since   all files of that scan
    <store>/findings/gen=<n>   the findings of the files that this scan has parsed

A file's findings follow from its path, its text, the rules and the marker of suppressions.
So a file is parsed again only if its digest, or the fingerprint of rules and marker,
differs from the last manifest's; `since` names the generation that has its findings.
Files that are gone are not in the new manifest, and with them go their findings. What a
scan returns is the findings of all generations that the manifest still refers to.

The manifest is written last. A run that dies before has left a generation without one,
which no reader sees and the next run overwrites, so a store is always that of the last
complete scan. One writer at a time. `compacted` writes all into one new generation, and
`forget` deletes those to which the manifest no longer refers.

Edge cases: paths are unique within a scan (of repeated ones every row is parsed if any changes); a null
text counts as empty; a first scan, an empty table and a scan without changes are ordinary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MARKER
from ..operators import findings as fd
from ..sources.tables import stored
from . import rules as rl
from . import scan as sc

#: Bytes of the list of changed files (paths and digests) up to which it is sent to the tasks that read texts.
SENT_BYTES = 32 << 20

_MANIFEST = "path string, sha256 string, size_bytes long, rules string, since int"


@dataclass
class Store:
    spark: SparkSession
    path: str

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, table: str, gen: int | None = None) -> str:
        return f"{self.path}/{table}" + (f"/gen={gen}" if gen is not None else "")

    def _exists(self, path: str) -> bool:
        return self._fs().exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))

    def generations(self, table: str = "manifest") -> list[int]:
        """Those that are complete, in order."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at(table))
        fs = self._fs()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(g for n in names if n.startswith("gen=") and self._exists(f"{self._at(table)}/{n}/_SUCCESS") for g in [int(n[4:])])

    def manifest(self, gen: int | None = None) -> DataFrame:
        gens = self.generations()
        if not gens:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(self._at("manifest", gens[-1] if gen is None else gen))

    def findings(self, gen: int | None = None) -> DataFrame | None:
        """The findings of the files in a manifest, the last one by default; None before the first scan."""
        m = self.manifest(gen)
        held = [r["since"] for r in m.select("since").distinct().collect()]  # as many as generations
        first = self.generations("findings")
        if not first:
            return None
        reader = self.spark.read.option("basePath", self._at("findings"))
        out = reader.parquet(*[self._at("findings", g) for g in held or first[-1:]])
        now = m.select("path", F.col("since").alias("gen"))
        return out.join(now, ["path", "gen"], "left_semi").drop("gen")

    def write(self, gen: int, manifest: DataFrame, found: DataFrame) -> None:
        found.write.mode("overwrite").parquet(self._at("findings", gen))
        manifest.write.mode("overwrite").parquet(self._at("manifest", gen))

    def rewind(self, gens: int) -> None:
        """Back to the state after `gens` scans, where later ones are to be made again."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for g in reversed([g for g in self.generations() if g >= gens]):
            self._fs().delete(path(self._at("manifest", g)), True)

    def forget(self, keep: int = 1) -> list[int]:
        """Deletes all manifests but the last `keep`, and the findings that none of these refers to."""
        gens = self.generations()
        kept = gens[-keep:]
        held = {r["since"] for g in kept for r in self.manifest(g).select("since").distinct().collect()}
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for g in gens[:-keep]:
            self._fs().delete(path(self._at("manifest", g)), True)
        gone = [g for g in self.generations("findings") if g not in held and g not in kept]
        for g in gone:
            self._fs().delete(path(self._at("findings", g)), True)
        return gone


def fingerprint(catalog: rl.Catalog, marker: str = MARKER) -> str:
    """What a file's findings depend on beside the file: the rules in their order, and the marker."""
    return hashlib.sha256(f"{marker}\n{sc.fingerprint(catalog.rules)}".encode()).hexdigest()


def _current(sources: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    given = set(sources.columns)
    digest = F.col("sha256") if "sha256" in given else F.sha2(text, 256)
    size = F.col("size_bytes") if "size_bytes" in given else F.octet_length(text).cast("long")
    return sources.select("path", digest.alias("sha256"), size.alias("size_bytes"))


def changes(now: DataFrame, before: DataFrame, rules: str) -> DataFrame:
    """now with since (null if it must be parsed) and change: `new`, `changed`, `rules` (same file, other rules) or `same`;
    and the files of before that are gone."""
    b = before.select(F.col("path").alias("_p"), F.col("sha256").alias("_sha"), F.col("rules").alias("_rules"), "since")
    met = now.join(b, F.col("path") == F.col("_p"), "full_outer")
    change = F.when(F.col("path").isNull(), "gone").when(F.col("_p").isNull(), "new").when(F.col("sha256") != F.col("_sha"), "changed").when(F.col("_rules") != rules, "rules").otherwise("same")
    return met.select(F.coalesce("path", "_p").alias("path"), "sha256", "size_bytes", F.when(change == "same", F.col("since")).alias("since"), change.alias("change"))


def scan(store: Store, sources: DataFrame, catalog: rl.Catalog, marker: str = MARKER, engine: Callable[..., DataFrame] = sc.scan, gone: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of sources (path, text, and if they are known sha256 and size_bytes, so that texts of files
    that stay are not even read), and the change of every file. The result is what a full scan gives.
    gone: if given, sources are only some of the files, and of the others those of `gone` (path) have been deleted."""
    rules = fingerprint(catalog, marker)
    gen = max([*store.generations(), -1]) + 1
    before = store.manifest()
    met = changes(_current(sources), before, rules)
    if gone is not None:
        absent = before.join(gone.select("path"), "path", "left_anti").join(sources.select("path"), "path", "left_anti")
        unseen = absent.select("path", "sha256", "size_bytes", "since", F.lit("unseen").alias("change"))
        met = met.join(absent.select("path"), "path", "left_anti").unionByName(unseen)
    met = stored(met, "scan-changes")
    todo = met.filter("change IN ('new', 'changed', 'rules')").select("path")
    n, size = met.filter("change IN ('new', 'changed', 'rules')").agg(F.count("*"), F.coalesce(F.sum(F.octet_length("path") + 64), F.lit(0))).first()
    if not store.generations():
        changed = sources
    else:
        todo = F.broadcast(todo) if size <= SENT_BYTES else todo
        changed = sources.join(todo, "path", "left_semi")
    found = engine(changed.select("path", F.coalesce("text", F.lit("")).alias("text")), catalog, marker)
    old = before.select("path", F.col("rules").alias("_rules")) if gone is not None else None
    kept = met.filter("change <> 'gone'")
    if old is not None:  # a file that was not seen keeps the rules it was scanned with
        kept = kept.join(old, "path", "left").withColumn("_rules", F.when(F.col("change") == "unseen", F.col("_rules")).otherwise(rules))
    else:
        kept = kept.withColumn("_rules", F.lit(rules))
    kept = kept.select("path", "sha256", "size_bytes", F.col("_rules").alias("rules"), F.coalesce("since", F.lit(gen)).cast("int").alias("since"))
    store.write(gen, kept, found)
    return store.findings(), met.select("path", "change")


def compacted(store: Store) -> None:
    """One new generation with all that the last manifest refers to."""
    gen = store.generations()[-1] + 1
    store.write(gen, store.manifest().withColumn("since", F.lit(gen)), store.findings())


def manifest_hash(store: Store) -> str:
    """Digest of the last scan's manifest, without reading any text."""
    return fd.manifest_fingerprint(store.manifest()).first()["manifest_hash"]
