"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Everything that isn't a digit, a lower-case ASCII letter or beyond ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTROL = "spark.checkpoint.dir"
#: Of rows that go to a Python worker together.
BATCH_BYTES = 4 << 20
#: A key that holds more than this part of all rows is joined by broadcast: there are so many of them at most.
HEAVY = 10_000

_own: list[str] = []
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a session of one process (tests) names none, a temporary one; on a cluster that is an error.
    """
    base = spark.conf.get(CONTROL, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{CONTROL} must name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="vaneflow-"))
            atexit.register(shutil.rmtree, _own[0], True)
        base = f"file://{_own[0]}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def mark() -> int:
    """How many intermediate tables there are; release() takes it."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> None:
    """Delete the intermediate tables made after mark() gave `since`, but for those that `but` reads.

    Call it when the results that read them are written.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    read = but.inputFiles() if but is not None else []
    for made in _made[since:]:
        if not any(made.split(":", 1)[-1].lstrip("/") in f for f in read):
            path = jvm.org.apache.hadoop.fs.Path(made)
            path.getFileSystem(conf).delete(path, True)
            _made.remove(made)


def keep(df: DataFrame, name: str, *partition: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    df.write.partitionBy(*partition).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z; an empty array for null."""
    return F.filter(F.split(F.coalesce(lower_ascii(text), F.lit("")), NOT_WORD), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """In a Python worker, between batches: give freed memory back, which the allocators would keep for as long as the worker lives."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def bound_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session are of BATCH_BYTES at most, so that a worker holds few rows of long texts or
    of blocks at once; a bound that the session has of its own stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def broadcast_if_small(df: DataFrame, max_rows: int, size: Column | None = None, max_bytes: int = 64 << 20) -> tuple[DataFrame, bool]:
    """Mark for broadcast if a count, cut off at the limit, proves at most max_rows rows; else leave the join to shuffles.

    size: the bytes of a row's values, where they have no bound of their own; they are summed up as well.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    if small and size is not None:
        small = (df.agg(F.sum(size)).first()[0] or 0) <= max_bytes
    return (F.broadcast(df), True) if small else (df, False)


def join_counted(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """rows with the facts of their keys, however many rows share a key.

    facts is a written table with one row for each value of keys; its column `size` says how many rows hold the value.
    Values that more than 1 / HEAVY of all rows hold are broadcast, HEAVY of them at most whatever the size of the
    tables; the others meet by a shuffle, in which no task gets more than that part of the rows for one value.
    how: inner, or left.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    heavy = F.broadcast(facts.filter(F.col(size) > total // HEAVY))
    light = facts.filter(F.col(size) <= total // HEAVY)
    rest = rows.join(heavy.select(*keys), keys, "left_anti").join(light, keys, how)
    return rows.join(heavy, keys).unionByName(rest)


def text_hash(text: Column) -> Column:
    """Tells the texts of rows apart that share an id; null is not the empty text."""
    return F.xxhash64(text, text.isNull())
