"""Benchmark decontamination by winnowed fingerprints (Schleimer, Wilkerson & Aiken, 2003)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, keep, table, text_hash, words

#: Words of a window, and of a hashed gram: SPAN - GRAM + 1 grams lie in a window, and their least hash is its fingerprint.
SPAN, GRAM = 10, 5
WIDTH = SPAN - GRAM + 1
#: Item windows are broadcast up to this count and MAX_SENT_BYTES, both proven; beyond, they are joined by a shuffle.
MAX_SENT, MAX_SENT_BYTES = 500_000, 64 << 20
#: Words of 64 bits of the filter that every task holds: as many as fingerprints, between these bounds (16 MB at most).
#: A larger benchmark makes the filter let more through; the join behind it is exact.
LEAST_FILTER, MOST_FILTER = 1 << 10, 1 << 21


def _places(n: Column, size: int) -> Column:
    """Where runs of `size` begin among n things, from 0."""
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def _hash(i: Column, n: int, short: bool) -> Column:
    """Of n words in a row, from their hashes; items shorter than a window have hashes of their own kind."""
    return F.xxhash64(*([F.lit(n)] if short else []), *(F.get("_wh", i + k) for k in range(n)))


def _hashed(df: DataFrame) -> DataFrame:
    """Adds hashes of the words of `_w`, and of all grams."""
    df = df.withColumn("_wh", F.transform("_w", lambda w: F.xxhash64(w)))
    return df.withColumn("_g", F.transform(_places(F.size("_wh"), GRAM), lambda i: _hash(i, GRAM, False)))


def item_windows(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows (item_id, n, window, print) of all items: SPAN consecutive words, or all words of a shorter item.

    print: the least hash of a gram in the window; of a shorter item the hash of its words.
    """
    ws = benchmark.select(F.col(key).cast("string").alias("item_id"), words(F.col(text)).alias("_w")).filter(F.size("_w") > 0)
    ws = _hashed(ws)
    window = lambda i, n: F.concat_ws(" ", F.slice("_w", i + 1, F.lit(n)))
    least = lambda i: F.array_min(F.slice("_g", i + 1, F.lit(WIDTH)))
    full = F.transform(_places(F.size("_w"), SPAN), lambda i: F.struct(F.lit(SPAN).alias("n"), window(i, SPAN).alias("window"), least(i).alias("print")))
    made = F.when(F.size("_w") >= SPAN, full)
    for n in range(1, SPAN):
        one = F.struct(F.lit(n).alias("n"), window(F.lit(0), n).alias("window"), _hash(F.lit(0), n, True).alias("print"))
        made = made.when(F.size("_w") == n, F.array(one))
    return ws.select("item_id", F.explode(made).alias("m")).select("item_id", "m.*").distinct()


def print_filter(prints: DataFrame) -> tuple[str, int]:
    """A bitmap of the fingerprints (column print), two bits each, as a session variable of that name; and its number of words.

    Spark hands the variable's value to the tasks as a constant, so that lambdas can look into it.
    """
    spark = prints.sparkSession
    n = LEAST_FILTER
    while n < MOST_FILTER and n < prints.count():
        n *= 2
    bits = prints.select(F.explode(F.array("print", F.shiftright("print", 32))).alias("p")).select(F.col("p").bitwiseAND(64 * n - 1).alias("p"))
    held = bits.select(F.shiftright("p", 6).alias("id"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("b")).groupBy("id").agg(F.bit_or("b").alias("b"))
    row = spark.range(n).join(held, "id", "left").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("bits"))
    name = f"prints_{uuid.uuid4().hex}"
    spark.sql(f"DECLARE VARIABLE {name} ARRAY<BIGINT>")
    spark.sql(f"SET VAR {name} = (SELECT bits FROM {{row}})", row=keep(row.select(F.transform("bits", lambda x: x["b"]).alias("bits")), "print-filter"))
    return name, n


def contaminated_words(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit (words inside an occurrence of an item's window), n_items and items_sha256
    (items with occurring windows), contaminated, text_hash (with doc_id, names the row).

    One pass over the documents.  Their grams meet the items' fingerprints in a bitmap; around a gram that passes, the
    windows whose least gram it is are taken out, with their words, and joined to the items' windows by fingerprint and
    words.  Equal windows have equal minima, so none is missed.  Items of fewer than SPAN words are looked for as they
    are, by a hash of all their words.

    Null and empty texts have no words; items without words have no windows; without windows no document is hit.  A very
    long text takes time in proportion to its words.  Repeated rows are judged each on its own; rows that share doc_id
    but not the text are kept apart; items that share an item_id count once.  Ids may be of any type and null; other
    columns play no part, whatever their names; an empty table gives no rows.
    """
    windows = keep(item_windows(benchmark), "item-windows")
    lengths = windows.filter(F.col("n") < SPAN).select("n").distinct().collect()  # SPAN - 1 values at most
    held, size = print_filter(windows.select("print").distinct())
    bits = F.expr(held)

    def passes(x: Column) -> Column:
        bit = lambda p: F.getbit(F.get(bits, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1
        return bit(x.bitwiseAND(64 * size - 1)) & bit(F.shiftright(x, 32).bitwiseAND(64 * size - 1))

    def found(hashes: Column) -> Column:
        """Places of the hashes that pass; most documents have none."""
        none = F.array().cast("array<int>")
        return F.when(F.exists(hashes, passes), F.array_compact(F.transform(hashes, lambda x, i: F.when(passes(x), i)))).otherwise(none)

    def taken(start: Column, n: int, mark: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(n).alias("n"), F.concat_ws(" ", F.slice("_w", start + 1, F.lit(n))).alias("window"), mark.alias("print"))

    def short(df: DataFrame, n: int, own: str) -> tuple[DataFrame, Column]:
        """With the hashes of all runs of n words as column `own`; and the windows at those that pass."""
        df = df.withColumn(own, F.transform(_places(F.size("_wh"), n), lambda i: _hash(i, n, True)))
        return df, F.transform(found(F.col(own)), lambda i: taken(i, n, F.get(own, i)))

    ident = [F.coalesce(F.col(key), F.lit("0").cast(docs.schema[key].dataType)).alias("_id"), F.xxhash64(F.col(text), F.col(text).isNull(), F.col(key).isNull()).alias("_h")]
    tagged = _hashed(docs.select(F.col(key).alias("doc_id"), text_hash(F.col(text)).alias("text_hash"), *ident, words(F.col(text)).alias("_w")))
    tagged = tagged.withColumn("_at", found(F.col("_g")))
    last = F.size("_w") - SPAN
    around = lambda p: F.filter(F.sequence(F.greatest(F.lit(0), p - WIDTH + 1), F.least(p, last)), lambda i: F.array_min(F.slice("_g", i + 1, F.lit(WIDTH))) == F.get("_g", p))
    starts = F.array_distinct(F.flatten(F.transform("_at", around)))
    none = F.array().cast("array<struct<start:int,n:int,window:string,print:bigint>>")
    cut = [F.when((last >= 0) & (F.size("_at") > 0), F.transform(starts, lambda i: taken(i, SPAN, F.array_min(F.slice("_g", i + 1, F.lit(WIDTH)))))).otherwise(none)]
    for n in sorted(r[0] for r in lengths):
        tagged, more = short(tagged, n, f"_s{n}")
        cut.append(more)
    passed = tagged.select("doc_id", "text_hash", "_id", "_h", F.size("_w").cast("long").alias("n_words"), F.concat(*cut).alias("places"))
    passed = keep(passed, "document-windows")
    docs.sparkSession.sql(f"DROP TEMPORARY VARIABLE {held}")

    places = passed.select("_id", "_h", F.explode("places").alias("p")).select("_id", "_h", "p.*")
    sent, _ = broadcast_if_small(windows, MAX_SENT, F.octet_length("window") + F.octet_length("item_id"), MAX_SENT_BYTES)
    hits = places.join(sent, ["print", "n", "window"]).select("_id", "_h", "start", (F.col("start") + F.col("n")).alias("end"), "item_id")
    hits = keep(hits, "item-hits")

    before = Window.partitionBy("_id", "_h").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = hits.groupBy("_id", "_h", "start").agg(F.max("end").alias("end"))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))))
    n_hit = covered.withColumn("_n", fresh).groupBy("_id", "_h").agg(F.sum("_n").alias("n_hit"))
    items = hits.groupBy("_id", "_h").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = passed.drop("places").join(n_hit.join(items, ["_id", "_h"]), ["_id", "_h"], "left")
    names, hit = F.coalesce(F.array_join("items", ","), F.lit("")), F.coalesce("n_hit", F.lit(0)).cast("long")
    n_items = F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items")
    return out.select("doc_id", "n_words", hit.alias("n_hit"), n_items, F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "text_hash")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


OP5_SQL = r"""
WITH lo AS (
  SELECT doc_id AS id, 0 AS item, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT item_id, 1, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT id, item, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lo),
iw AS (SELECT DISTINCT id AS item_id, n, array_to_string(ws[i + 1:i + n], ' ') AS win FROM (
  SELECT id, ws, least(len(ws), 10) AS n, unnest(range(len(ws) - least(len(ws), 10) + 1)) AS i FROM w WHERE item = 1 AND len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT id AS doc_id, i, n, array_to_string(ws[i + 1:i + n], ' ') AS win FROM (
  SELECT id, ws, n, unnest(range(greatest(len(ws) - n + 1, 0))) AS i FROM w, ns WHERE item = 0)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
nh AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN nh ON w.id = nh.doc_id LEFT JOIN it ON w.id = it.doc_id WHERE item = 0
"""
