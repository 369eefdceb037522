"""Sharding by jump consistent hashing (Lamping & Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import table

OVERHEAD = 16
#: Sub-buckets of a shard: a shard's rows are numbered in so many tasks, not one.
SUB = 64


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every unsigned 64-bit key, without a ring table: all keys jump together until each is beyond the last shard."""
    key = keys.astype(np.uint64)
    at, to = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    active = np.arange(len(key))
    while len(active):
        at[active] = to[active]
        k = key[active] * np.uint64(2862933555777941757) + np.uint64(1)
        key[active] = k
        to[active] = ((at[active] + 1) * ((1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        active = active[to[active] < shards]
    return at.astype(np.int32)


def jump_column(key: Column, shards: int, whole: bool = True) -> Column:
    """The shard as a column; whole: the key is a whole number, else it is hashed.  A null key counts as 0."""

    @F.pandas_udf(T.IntegerType())
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards))

    number = key.cast("long") if whole else F.when(key.isNotNull(), F.xxhash64(key))
    return shard(F.coalesce(number, F.lit(0).cast("long")))


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and slot of every row.

    One row per input row: the key, size (UTF-8 bytes of the text, none if null, plus 16), text_crc32, law, shard,
    slot (gapless from 0 within the shard) and grown_shard, the shard if there were one more.  Law `key`: the key and
    the shard count alone decide.  Keys that aren't whole numbers are hashed.  Only key, size and checksum move, so very
    long texts cost no more than reading them.  Slots go by sub-bucket (checksums of the key as text and of the
    text, and size, summed up, so that neither null keys nor copies of a text share one), key, size and checksum; rows
    equal in all of these have slots next to each other, in no order of their own.  Rows are numbered within (shard, sub-bucket) groups, whose counts, SUB x shards rows at most, give the
    offsets.  Repeated keys and rows get slots of their own; a null text has size 16 and checksum 0; other columns play
    no part, whatever their names; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    size = (F.octet_length(body) + OVERHEAD).cast("long").alias("size")
    rows = docs.select(F.col(key).alias("doc_id"), size, F.crc32(body).alias("text_crc32"))
    place = lambda n: jump_column(F.col("doc_id"), n, isinstance(docs.schema[key].dataType, T.IntegralType))
    rows = rows.withColumns({"shard": place(shards), "grown_shard": place(shards + 1)})
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    rows = rows.withColumn("_sub", ((F.crc32(named) + F.col("text_crc32") + F.col("size")) % SUB).cast("int"))
    counts = rows.groupBy("shard", "_sub").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_sub").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("_rn", F.row_number().over(inside))
    slotted = numbered.join(F.broadcast(offsets), ["shard", "_sub"])  # SUB x shards rows
    slot = (F.col("_rn") - 1 + F.col("_offset")).cast("long").alias("slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Write the rows as one folder per shard."""
    whole = isinstance(docs.schema[key].dataType, T.IntegralType)
    placed = docs.withColumn("shard", jump_column(F.col(key), shards, whole))
    placed.write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"), 40)


OP7_SQL = """
WITH RECURSIVE t8(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t8 WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM t8 WHERE k = 8),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS hx, hex(encode(CAST(doc_id AS VARCHAR))) AS hk FROM documents),
crc AS (SELECT doc_id, n,
  xor(list_reduce(list_transform(range(n), lambda j: CAST('0x' || substr(hx, CAST(2 * j + 1 AS BIGINT), 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1]), 4294967295), 4294967295) AS text_crc32,
  xor(list_reduce(list_transform(range(length(hk) // 2), lambda j: CAST('0x' || substr(hk, CAST(2 * j + 1 AS BIGINT), 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1]), 4294967295), 4294967295) AS key_crc32
  FROM d, tab),
j(doc_id, n, key, b, j) AS (
  SELECT doc_id, s, CAST(doc_id AS HUGEINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM documents, (VALUES (40), (41)) v(s)
  UNION ALL
  SELECT doc_id, n, k, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / (CAST(k // 8589934592 AS DOUBLE) + 1.0))) AS BIGINT)
  FROM (SELECT doc_id, n, j, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM j WHERE j < n)),
placed AS (SELECT doc_id, CAST(max(b) FILTER (n = 40) AS INT) AS shard, CAST(max(b) FILTER (n = 41) AS INT) AS grown_shard FROM j WHERE j >= n GROUP BY doc_id)
SELECT doc_id, CAST(n + 16 AS BIGINT) AS size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY (key_crc32 + text_crc32 + n + 16) % 64, doc_id, n, text_crc32) - 1 AS slot, grown_shard
FROM crc JOIN placed USING (doc_id)
"""
