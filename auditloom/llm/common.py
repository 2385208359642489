"""What the training-data operators share: table access, shared-folder tables, words.

Words of a text are maximal runs of anything but blank, tab, line feed, vertical
tab, form feed and carriage return; a null text has none.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words, as a regular expression class shared by Java and Python.
BLANK = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a local session gets one
    of its own; a cluster has to name one, since its machines do not see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="auditloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths of the tables that this process has stored, in order.
_stored: list[str] = []


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back: it cuts the
    lineage, survives lost executors and lets later plans prune columns."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, since: int, but: DataFrame | None = None) -> None:
    """Deletes the tables stored since there were `since`, except the files that `but` reads."""
    kept = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for f in but.inputFiles()} if but is not None else set()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in _stored[since:]:
        if path.split(":", 1)[-1].lstrip("/") not in kept:
            at = hadoop(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            _stored.remove(path)


def stored_count() -> int:
    return len(_stored)


#: join_skewed takes keys with more rows than this, and more than one in HOT_SHARE of all, for hot.
HOT_ROWS, HOT_SHARE = 1_000, 100_000


def join_skewed(left: DataFrame, right: DataFrame, on: str, n: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """left joined with right, which has one row for each value of `on` and in column n how many
    rows of left have it. Rows of hot values stay where they are: their partners are sent to
    them. There are fewer than HOT_SHARE hot values whatever the data, which bounds what is
    sent. The others are joined by a shuffle. left is read twice and should be a stored table."""
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = right.filter(F.col(n) > max(HOT_ROWS, total // HOT_SHARE))
    right, few = right.select(on, *keep), F.broadcast(hot.select(on, *keep))
    if hot.isEmpty():
        return left.join(right, on)
    cold = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(right, on)
    return cold.unionByName(left.join(few, on))


#: Rows and bytes of a batch between the JVM and Python, of which both sides hold whole ones. Texts are
#: about 2 KB, some far longer; a batch ends with the row that passes either bound.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose steps in Python get batches of at most BATCH_ROWS rows and about BATCH_BYTES from now on in this session."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def low(text: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, then) -> Column:
    """then(value), with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words(text: Column, blank: str = f"{BLANK}+") -> Column:
    """Array of words. Only the first and last piece of a split can be empty. The text is
    split once, also where the optimizer shares no expressions (below an explode)."""

    def inner(pieces: Column) -> Column:
        first = F.when(F.element_at(pieces, 1) == "", 2).otherwise(1)
        last = F.size(pieces) - F.when(F.element_at(pieces, -1) == "", 1).otherwise(0)
        return F.slice(pieces, first, F.greatest(last - first + 1, F.lit(0)))

    return let(F.split(F.coalesce(text, F.lit("")), blank), inner)


def word_count(text: Column, blank: str = f"{BLANK}+") -> Column:
    def inner(pieces: Column) -> Column:
        edges = F.when(F.element_at(pieces, 1) == "", 1).otherwise(0) + F.when(F.element_at(pieces, -1) == "", 1).otherwise(0)
        return F.greatest(F.size(pieces) - edges, F.lit(0)).cast("long")

    return let(F.split(F.coalesce(text, F.lit("")), blank), inner)
