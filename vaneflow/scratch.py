"""Intermediate tables of iterations, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONTROL = "spark.checkpoint.dir"
_own: list[str] = []
_made: list[str] = []


def path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names; in a temporary one where a session of one process names none."""
    base = spark.conf.get(CONTROL, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{CONTROL} must name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="vaneflow-"))
            atexit.register(shutil.rmtree, _own[0], True)
        base = f"file://{_own[0]}"
    made = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(made)
    return made


def keep(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write, and read again."""
    made = path(df.sparkSession, name)
    df.write.parquet(made)
    return df.sparkSession.read.schema(df.schema).parquet(made)


def mark() -> int:
    """How many tables there are; release() takes it."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, *but: DataFrame) -> None:
    """Delete the tables made after mark() gave `since`, but for those that `but` read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    read = [f for df in but for f in df.inputFiles()]
    for made in _made[since:]:
        if not any(made.split(":", 1)[-1].lstrip("/") in f for f in read):
            at = jvm.org.apache.hadoop.fs.Path(made)
            at.getFileSystem(conf).delete(at, True)
            _made.remove(made)
