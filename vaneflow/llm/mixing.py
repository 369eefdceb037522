"""Mixing sources to target weights by Pareto order sampling (Rosén, 1997).

Every document gets the certain whole copies that its source's target holds; what is left of the target is a sample of
fixed size in words: documents are ranked by random odds divided by inclusion odds, and taken from the lowest rank on.
Nothing but sums by source, and by source and range of ranks, is gathered; a document's fate follows from its own row
and its source's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_counted, keep, mark, release, table

WEIGHTS, MOST, SEED = (1, 2, 3), 3, 13
#: The sample ends before the document that no longer fits; so often is the gap filled by later ones that do.
FILLS = 5
KEYS = ["no_source", "source"]
WORD = r"[^\x20\x09-\x0D]+"
#: What is known of a source before the first round of its sample.
NO_CUTS = "array<struct<gap:double,rank:double>>"


def uniform(key: Column, text: Column, seed: int = SEED) -> Column:
    """A number between 0 and 1, both excluded, from the row's key and text."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return (F.conv(F.substring(F.sha2(named, 256), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (no_source, source, n, source_size) with the target of each, and what follows from it.

    Sources share all words by weight.  A source that would get more than `most` times its own words gets just that; the
    excess goes to the others by weight, until none is above.  In the order of most * source_size / weight the first are
    full, and the others share what these leave: the first place whose share is no more than its own limit parts them.
    There is one row per source, as in a table of weights; they are ordered in one task.
    """
    by_name = F.row_number().over(Window.orderBy(*KEYS))
    weighted = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(by_name - 1, F.lit(len(weights))) + 1))
    full = F.col("source_size") * most
    order = Window.orderBy(full / F.col("weight"), *KEYS)
    total, full_before = F.sum("source_size").over(Window.partitionBy()), F.sum(full).over(order.rowsBetween(Window.unboundedPreceding, -1))
    weight_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    shared = weighted.withColumn("_share", (total - F.coalesce(full_before, F.lit(0))) / weight_left).withColumn("_at", F.row_number().over(order))
    fits = F.when(F.col("_share") <= full / F.col("weight"), F.col("_at"))
    share = F.min_by("_share", fits).over(Window.partitionBy())
    named = shared.withColumn("target", F.least(full.cast("double"), share * F.col("weight"))).drop("_share", "_at")
    size = F.col("source_size")
    named = named.withColumn("whole", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long"))
    gap = F.col("target") - F.col("whole") * size
    chance = F.when(size > 0, gap / size).otherwise(0.0)
    return named.withColumns({"gap": gap, "odds": chance / (1 - chance), "cuts": F.array().cast(NO_CUTS)})


def picked() -> Column:
    """Is the row in its source's sample, as far as that has been drawn?"""
    return F.exists("cuts", lambda c: (F.col("size") <= c["gap"]) & (rank() < c["rank"]))


def ranges(n: Column) -> Column:
    """Into how many ranges the ranks of n documents are cut: about as many as a range then holds."""
    return F.ceil(F.sqrt(n))


def rank() -> Column:
    """Random odds over inclusion odds."""
    return F.col("u") / (1 - F.col("u")) / F.col("odds")


def _fill(rows: DataFrame, sources: DataFrame) -> DataFrame | None:
    """One round of every source's sample: of documents that fit its gap, those of lowest rank, as many as fit together.

    The sources with their cuts and gaps after it; None where nothing fits.
    """
    place = F.floor(ranges(F.col("n")) * rank() / (1 + rank())).alias("place")

    def candidates(known: DataFrame) -> DataFrame:
        joined = join_counted(rows, known, KEYS, "n")
        return joined.filter((F.col("size") > 0) & (F.col("size") <= F.col("gap")) & ~picked()).withColumn("place", place).withColumn("rank", rank())

    since = mark()
    open_ = sources.filter("gap >= 1")
    sums = candidates(open_).groupBy(*KEYS, "place").agg(F.sum("size").alias("words"), F.max("gap").alias("gap"))
    so_far = F.sum("words").over(Window.partitionBy(*KEYS).orderBy("place"))
    over = F.col("so_far") > F.col("gap")
    borders = sums.withColumn("so_far", so_far).groupBy(*KEYS).agg(F.min(F.when(over, F.col("place"))).alias("border"), F.coalesce(F.max(F.when(~over, F.col("so_far"))), F.lit(0)).alias("before"))
    borders = keep(borders, "mix-borders")
    if borders.isEmpty():
        return None
    # within the range of ranks where the gap ends; equal ranks (rows of one key and text) go together
    known = keep(open_.join(borders.filter("border is not null"), KEYS), "mix-known")
    ranked = candidates(known).filter(F.col("place") == F.col("border")).groupBy(*KEYS, "rank").agg(F.sum("size").alias("words"), F.max("gap").alias("gap"), F.max("before").alias("before"))
    so_far = F.col("before") + F.sum("words").over(Window.partitionBy(*KEYS).orderBy("rank"))
    ends = ranked.withColumn("so_far", so_far).groupBy(*KEYS).agg(F.min(F.when(over, F.col("rank"))).alias("end"), F.max(F.when(~over, F.col("so_far"))).alias("inside"))
    drawn = borders.join(ends, KEYS, "left")
    taken, end = F.coalesce("inside", "before"), F.coalesce("end", F.lit(float("inf")))
    cut = F.array(F.struct(F.col("gap"), end.alias("rank"))).cast(NO_CUTS)
    after = sources.join(drawn, KEYS, "left").withColumn("cuts", F.when(F.col("before").isNotNull(), F.concat("cuts", cut)).otherwise(F.col("cuts")))
    after = keep(after.withColumn("gap", F.col("gap") - F.coalesce(taken, F.lit(0))).select(*sources.columns), "mix-sources")
    release(rows.sparkSession, since, after)
    return after


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, size (its words), source_size, target (its source's words in the mix), taken (its own
    words there, repeats counted), source and copies.

    Sources in the order of their code points, null last, have the weights in turn.  Of a source whose target is r times
    its words every document has floor(r) copies, and one more if it is in the source's sample: documents ranked by
    odds(u) / odds(r - floor(r)), u a hash of key, text and seed, from the lowest on while their words fit.  The gap
    that the first one too long leaves is filled by later ones that do fit, FILLS - 1 times.  So a source's taken words
    are never above its target, and after each round they are less than one document below it, one that was left out;
    copies are whole, r + 1 at most and never more than `most`.

    Null texts and texts without words have no size, are never taken, and a source of such texts alone has target 0.
    Rows that repeat key and text share their rank and go into the sample together; rows that share the key alone, or
    have none, have ranks of their own.  Nothing depends on partitions or order, so reruns agree.  Texts are read whole,
    however long; of a source only sums move, so it may hold any part of the rows.  Other columns play no part,
    whatever their names; an empty table gives no rows.
    """
    since, kind = mark(), docs.schema[source].dataType
    name = F.col(source).cast("string")
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    named = [F.col(source).isNull().alias("no_source"), F.coalesce(name, F.lit("")).alias("source")]
    rows = keep(docs.select(F.col(key).alias("doc_id"), *named, size, uniform(F.col(key), F.col(text), seed).alias("u")), "mix-rows")
    sums = keep(rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), "mix-sums")
    sources = keep(targets(sums, weights, most), "mix-sources")
    for _ in range(FILLS):
        after = _fill(rows, sources)
        if after is None:
            break
        sources = after
    out = join_counted(rows, sources, KEYS, "n")
    copies = (F.col("whole") + F.when((F.col("size") > 0) & picked(), 1).otherwise(0)).alias("copies")
    shown = F.when(~F.col("no_source"), F.col("source").cast(kind)).alias("source")
    out = out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), shown, copies)
    release(docs.sparkSession, since, out)
    return out


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _fill_sql(k: int) -> str:
    """Round k: gaps g{k} and earlier picks p{k} give those of the next."""
    return f"""
r{k} AS (SELECT no_source, source, q, gap, sum(sum(size)) OVER (PARTITION BY no_source, source ORDER BY q) AS so_far
  FROM p{k} JOIN g{k} USING (no_source, source) WHERE NOT picked AND size > 0 AND gap >= 1 AND size <= gap GROUP BY no_source, source, q, gap),
e{k} AS (SELECT no_source, source, coalesce(min(q) FILTER (so_far > gap), CAST('inf' AS DOUBLE)) AS stop, coalesce(max(so_far) FILTER (so_far <= gap), 0) AS took FROM r{k} GROUP BY ALL),
p{k + 1} AS (SELECT p.* REPLACE (picked OR coalesce(size > 0 AND size <= gap AND q < stop, false) AS picked) FROM p{k} p JOIN g{k} USING (no_source, source) LEFT JOIN e{k} USING (no_source, source)),
g{k + 1} AS (SELECT no_source, source, gap - coalesce(took, 0) AS gap FROM g{k} LEFT JOIN e{k} USING (no_source, source)),"""


_DOCS_SQL = r"""
WITH d AS (SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
  (CAST(CAST('0x' || substr(sha256('13:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496 AS u FROM documents),
s AS (SELECT no_source, source, sum(size) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY no_source, source) - 1) % 3 AS weight FROM s),
c AS (SELECT *, row_number() OVER o AS place,
  CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS share
  FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, no_source, source)),
t AS (SELECT *, least(CAST(3 * source_size AS DOUBLE), weight * (SELECT arg_min(share, place) FROM c WHERE share <= 3 * source_size / weight)) AS target FROM c),
x AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
y AS (SELECT *, target - whole * CAST(source_size AS DOUBLE) AS gap, CASE WHEN source_size > 0 THEN (target - whole * CAST(source_size AS DOUBLE)) / source_size ELSE 0 END AS chance FROM x),
p0 AS (SELECT d.*, u / (1 - u) / (chance / (1 - chance)) AS q, false AS picked FROM d JOIN y USING (no_source, source)),
g0 AS (SELECT no_source, source, gap FROM y),"""

OP13_SQL = (
    _DOCS_SQL
    + reduce(lambda sql, k: sql + _fill_sql(k), range(FILLS), "")
    + f"""
z AS (SELECT 1)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * (whole + CAST(picked AS INT)) AS BIGINT) AS taken,
  CASE WHEN NOT no_source THEN source END AS source, CAST(whole + CAST(picked AS INT) AS BIGINT) AS copies FROM p{FILLS} JOIN y USING (no_source, source)
"""
)
