"""Tables between the steps of a plan, in the folder that driver and executors share, rows dealt over all cores, and slices of what Python gives back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A local session without one gets its own; a cluster
    must name one, since its machines do not see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="auditloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back: its lineage ends, lost executors cost nothing, and a value
    that depends on how rows were dealt stays what it was."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tasks for each core: a core that falls behind holds up few of them.
TASKS = 4


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows over all cores by a key that few rows share. A narrow table of any number of rows may be one task's, since files
    are cut by bytes; steps whose work grows with rows need more tasks than that."""
    return rows.repartition(max(TASKS * rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()), key)


#: What a step in Python holds of its results at a time: so many rows, or those of so many characters of sources. A slice
#: ends with the file that passes either bound.
SLICE_ROWS, SLICE_CHARS = 2_000, 1 << 20


def sliced(batches: Iterator[pa.RecordBatch], rows_of: Callable[[str, str], list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """rows_of(path, text) over batches of files, given back slice by slice: a batch of small files may have far more rows
    than files, so its results are never held whole."""
    rows: list[tuple] = []
    chars = 0
    for batch in batches:
        for path, text in zip(batch.column("path"), batch.column("text")):
            text = text.as_py()
            rows += rows_of(path.as_py(), text)
            chars += len(text)
            if len(rows) >= SLICE_ROWS or chars >= SLICE_CHARS:
                yield _batch(rows, schema)
                rows, chars = [], 0
    if rows:
        yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
