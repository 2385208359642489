"""Trees of any size, listed and read by the executors.

`srctree` lists a tree on the driver, within its limits. Here the folders still to be listed
are a table, the frontier: each round deals it over the tasks, which list their folders,
and the folders found that are not left out are the next frontier. There are as many
rounds as the tree is deep; the driver sees counts alone. What lies in one folder
streams through one task. The tree must be mounted where executors run.

The rules are those of `srctree`: the same reasons in the same order, folders left out are
not listed, and a link or special file that no rule leaves out ends the listing with its name.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .srctree import DEFAULT_EXCLUDES, LIMITS, Entry, checked_path, read_stable, reasons
from .tables import stored

_ENTRY = "path string, folder boolean, size long, reason string"
#: Entries of a batch that goes from a task to the JVM, and bytes of files.
BATCH, BATCH_BYTES = 10_000, 8 << 20


def _listed(root: str, folder: str, excludes: list[str]) -> Iterator[tuple]:
    """(path, folder, size, reason) of what a folder holds; size -1 is neither file nor folder."""
    rules, prefix = reasons(excludes), f"{folder}/" if folder else ""
    with os.scandir(os.path.join(root, folder)) as found:
        for x in found:
            s = x.stat(follow_symlinks=False)
            is_dir = stat.S_ISDIR(s.st_mode)
            e = Entry(prefix + x.name, x.name, is_dir, s.st_size if is_dir or stat.S_ISREG(s.st_mode) else -1)
            yield e.path, is_dir, e.size, next((name for name, holds in rules if holds(e)), None)


def entries(spark: SparkSession, root: str, excludes: list[str] | None = None, depth: int = LIMITS["maxDepth"]) -> DataFrame:
    """path, folder, size, reason (null: kept) of everything below root that no folder left out hides."""
    root, excludes = checked_path(root), list(DEFAULT_EXCLUDES) if excludes is None else excludes
    if not os.path.isdir(root):
        raise ValueError(f"no such folder: {root}")

    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for frame in frames:
            for folder in frame["path"]:
                for row in _listed(root, folder, excludes):
                    rows.append(row)
                    if len(rows) >= BATCH:
                        yield pd.DataFrame(rows, columns=["path", "folder", "size", "reason"])
                        rows = []
        yield pd.DataFrame(rows, columns=["path", "folder", "size", "reason"])

    frontier = spark.createDataFrame([("",)], "path string")
    out = spark.createDataFrame([], _ENTRY)
    cores, waiting = spark.sparkContext.defaultParallelism, 1
    for level in range(depth + 2):
        if not waiting:
            return out
        if level > depth:
            break
        found = stored(frontier.repartition(max(1, min(waiting, 4 * cores))).mapInPandas(expand, _ENTRY), f"tree-level{level}")
        bad = found.filter("size < 0 AND (reason IS NULL OR reason = 'unsupported_or_generated_file')").orderBy("path").first()
        if bad:
            raise ValueError(f"neither file nor folder: {bad['path']}")
        out = out.unionByName(found)
        frontier = found.filter("folder AND size >= 0 AND reason IS NULL").select("path")
        waiting = frontier.count()
    raise ValueError(f"{root} is deeper than {depth}")


def exclusions(found: DataFrame) -> DataFrame:
    return found.filter("reason IS NOT NULL").select("path", "reason")


def contents(found: DataFrame, root: str, most: int = LIMITS["maxFileBytes"]) -> DataFrame:
    """path, content, size of the files that are kept. One that is larger than `most`, or changes while it is
    read, ends the job. Files are dealt evenly by a hash of their path."""
    root = checked_path(root)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for frame in frames:
            for path in frame["path"]:
                data = read_stable(os.path.join(root, path), most)
                rows.append((path, data, len(data)))
                held += len(data)
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "content", "size"])
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=["path", "content", "size"])

    files = found.filter("NOT folder AND reason IS NULL").select("path")
    n = max(1, -(-(found.filter("NOT folder AND reason IS NULL").agg(F.sum("size")).first()[0] or 0) // (32 << 20)), found.sparkSession.sparkContext.defaultParallelism)
    return files.repartition(n, "path").mapInPandas(read, "path string, content binary, size long")
