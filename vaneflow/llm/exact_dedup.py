"""Exact deduplication by a keyed state that lasts.

Digests arrive as a stream; the state, in RocksDB on the executors' disks with its checkpoint in the shared folder, keeps
for every digest the stable identifier that stays, the group's size and a locator of the kept content, and never
expires.  Where the state reports a hit, the contents are fetched by their locators and their full bytes compared before
a row counts as a copy.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, join_counted, keep, lower_ascii, table, work_path

#: Disk-backed state; many small stores, so none takes disk in advance.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Places of contents to compare (a hash of 8 bytes each) are broadcast up to this count, proven by counting; beyond it
#: they are joined by a shuffle.
MAX_HITS_SENT = 1_000_000
DIGEST = ["digest", "n_bytes"]


def feed_schema(key: T.DataType | None = None) -> T.StructType:
    """Of arriving rows; key: the type of doc_id, long unless said."""
    types = {"digest": T.BinaryType(), "doc_id": key or T.LongType(), "n_bytes": T.LongType(), "locator": T.StringType()}
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


def locate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Column:
    """Where a row's content lies: file and row of a table of files; else its key and the hash of its text."""
    where = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    try:
        docs.select(where)
    except AnalysisException:
        return F.concat_ws("#", F.coalesce(F.col(key).cast("string"), F.lit("")), F.hex(F.xxhash64(F.col(text))))
    return where


def digest_state(feed: DataFrame) -> DataFrame:
    """From a stream (or table) of arriving rows the state per digest: keep_id (largest doc_id), group_size, locator of the kept content."""
    best = F.max(F.struct("doc_id", "locator"))
    state = feed.groupBy(*DIGEST).agg(best.alias("_best"), F.count("*").alias("group_size"))
    return state.select(*DIGEST, F.col("_best.doc_id").alias("keep_id"), F.col("_best.locator").alias("locator"), "group_size")


def run_state(spark: SparkSession, feed_path: str, checkpoint: str, out: str, key: T.DataType | None = None) -> DataFrame:
    """Feed everything that has arrived at feed_path to the state kept at checkpoint; returns the latest state of every digest.

    Calling it again with the same three paths takes up only what arrived meanwhile.  Each micro-batch's changed keys
    are written as a folder of their own, so that a batch that is run again after a failure overwrites itself.
    """
    old = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)

    def changed(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/b={number}")

    try:
        state = digest_state(spark.readStream.schema(feed_schema(key)).parquet(feed_path))
        kept = T.StructType([*state.schema.fields, T.StructField("batch", T.IntegerType())])
        none = spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in kept.fields))
        none.write.mode("overwrite").parquet(f"{out}/b=-1")  # so that a feed without rows has a state too
        write = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        write.trigger(availableNow=True).foreachBatch(changed).start().awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rows = spark.read.schema(kept).parquet(f"{out}/b=*")
    latest = F.max_by(F.struct("keep_id", "locator", "group_size"), "batch").alias("s")
    return rows.groupBy(*DIGEST).agg(latest).select(*DIGEST, "s.*")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of equal texts; texts are equal when identical after lower-casing A-Z only.

    One row per input row: doc_id, keep_id (largest doc_id of the group), group_size, kept, text_sha256.  The key may be
    of any type that has an order.  Null text counts as empty; a null key is less than any other, and stays only where
    all keys of the group are null.  Rows that repeat both key and text are one group like any other; each such row of
    keep_id counts as kept.  Texts are read whole, however long.  A row whose bytes differ from others of its digest is
    grouped by its bytes instead.  Other columns play no part, whatever their names.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    kind, norm = docs.schema[key].dataType, F.coalesce(lower_ascii(F.col(text)), F.lit(""))
    where = locate(docs, key, text)
    rows = docs.select(F.col(key).alias("doc_id"), norm.alias("_t"), where.alias("locator"))
    # staged once: the arriving feed, and the thin side of the later joins
    feed = work_path(spark, "digests")
    digest, n_bytes = F.unhex(F.sha2("_t", 256)).alias("digest"), F.octet_length("_t").cast("long").alias("n_bytes")
    rows.select(digest, "doc_id", n_bytes, "locator").write.option("compression", "zstd").parquet(feed)
    thin = spark.read.schema(feed_schema(kind)).parquet(feed)
    state = keep(run_state(spark, feed, work_path(spark, "dedup-state"), work_path(spark, "dedup-changes"), kind), "dedup-groups")

    # hits: rows whose digest the state holds more than once.  Their contents are fetched by their places and compared
    # whole: a digest's texts are all equal when the least and the greatest are, which is summed up before it moves.
    shared = state.filter("group_size > 1").select(*DIGEST, "group_size")
    hits = join_counted(thin.select(*DIGEST, F.xxhash64("locator").alias("_at")), shared, DIGEST, "group_size")
    places, _ = broadcast_if_small(keep(hits.select("_at").distinct(), "dedup-hits"), MAX_HITS_SENT)
    found = docs.select(norm.alias("_t"), F.xxhash64(where).alias("_at")).join(places, "_at", "left_semi")
    compared = found.groupBy(F.sha2("_t", 256).alias("text_sha256")).agg(F.min("_t").alias("_least"), F.max("_t").alias("_most"))
    bad = keep(compared.filter("_least != _most").select("text_sha256"), "dedup-strays")

    joined = join_counted(thin.drop("locator"), state.drop("locator"), DIGEST, "group_size")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    clean = joined.select("doc_id", "keep_id", "group_size", stays, F.lower(F.hex("digest")).alias("text_sha256"))
    return clean if bad.isEmpty() else _regroup(docs, norm, bad, clean, key)


def _regroup(docs: DataFrame, norm: Column, bad: DataFrame, clean: DataFrame, key: str) -> DataFrame:
    """Digests that more than one text has are grouped by digest and bytes."""
    again = docs.select(F.col(key).alias("doc_id"), norm.alias("_t")).withColumn("text_sha256", F.sha2("_t", 256))
    again = again.join(bad, "text_sha256", "left_semi")
    groups = again.groupBy("text_sha256", "_t").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    again = again.join(groups, ["text_sha256", "_t"]).select("doc_id", "keep_id", "group_size", stays, "text_sha256")
    return clean.join(bad, "text_sha256", "left_anti").unionByName(again)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""
