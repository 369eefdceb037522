"""Interval algebra on rows of (keys, start_s, end_s)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

A, B = "start_s", "end_s"


def merge(intervals: DataFrame, *keys: str) -> DataFrame:
    """Overlapping and touching intervals as one."""
    w = Window.partitionBy(*keys).orderBy(A, B)
    seen = F.max(B).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (seen.isNull() | (F.col(A) > seen)).cast("int")
    islands = intervals.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min(A).alias(A), F.max(B).alias(B)).drop("_island")


def intersect(left: DataFrame, right: DataFrame, *keys: str, touching: bool = False, bin_s: float | None = None) -> DataFrame:
    """Overlaps of the two sides; touching keeps those of no length.

    The keys make it an equi-join.  Without keys, or where a key holds many intervals, bin_s cuts time into bins that
    both sides are dealt to, so that only neighbours meet; each pair counts in the bin where its overlap begins.
    """
    return _meet(left, right, keys, touching, bin_s)


def _meet(left: DataFrame, right: DataFrame, keys: Iterable[str], touching: bool, bin_s: float | None, of_left: Iterable[str] = (), of_right: Iterable[str] = ()) -> DataFrame:
    """Overlaps with further columns of either side."""
    le, r = left.select(*keys, *of_left, F.col(A).alias("_la"), F.col(B).alias("_lb")), right.select(*keys, *of_right, F.col(A).alias("_ra"), F.col(B).alias("_rb"))
    on = list(keys)
    if bin_s is not None:
        bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_s), F.floor(F.col(b) / bin_s)))
        le, r, on = le.withColumn("_bin", bins("_la", "_lb")), r.withColumn("_bin", bins("_ra", "_rb")), [*keys, "_bin"]
    both = le.join(r, on) if on else le.join(r, (F.col("_la") <= F.col("_rb")) & (F.col("_ra") <= F.col("_lb")))
    out = both.withColumns({A: F.greatest("_la", "_ra"), B: F.least("_lb", "_rb")})
    out = out.filter(F.col(A) <= F.col(B) if touching else F.col(A) < F.col(B))
    if bin_s is not None:
        out = out.filter(F.col("_bin") == F.floor(F.col(A) / bin_s))
    return out.select(*keys, A, B, *of_left, *of_right)


def overlap_counts(left: DataFrame, right: DataFrame, *keys: str, touching: bool = False, bin_s: float | None = None) -> DataFrame:
    """(keys, start_s, end_s, n): the overlaps of `intersect`, counted.

    Equal intervals of a side are counted first and meet the other side as one, which stands for the product of both
    numbers; pairs grow with distinct intervals, not with copies.
    """
    def alike(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*keys, A, B).agg(F.count("*").alias(name))

    both = _meet(alike(left, "_ln"), alike(right, "_rn"), keys, touching, bin_s, ["_ln"], ["_rn"])
    return both.groupBy(*keys, A, B).agg(F.sum(F.col("_ln") * F.col("_rn")).alias("n"))


def clip(intervals: DataFrame, start: float | Column, end: float | Column) -> DataFrame:
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (start, end))
    return intervals.withColumns({A: F.greatest(F.col(A), lo), B: F.least(F.col(B), hi)}).filter(F.col(A) < F.col(B))


def measure(intervals: DataFrame, *keys: str) -> DataFrame:
    """Total length, overlaps once."""
    return merge(intervals, *keys).groupBy(*keys).agg(F.sum(F.col(B) - F.col(A)).alias("length_s"), F.count("*").alias("n_intervals"))


def covers(intervals: DataFrame, span: DataFrame, *keys: str) -> DataFrame:
    """Whether one interval alone, of the merged, covers the span of its key."""
    one = merge(intervals, *keys).groupBy(*keys).agg(F.count("*").alias("n"), F.min(A).alias("_a"), F.max(B).alias("_b"))
    joined = span.join(one, list(keys), "left")
    return joined.select(*keys, F.coalesce((F.col("n") == 1) & (F.col("_a") <= F.col(A)) & (F.col("_b") >= F.col(B)), F.lit(False)).alias("covered"))


def complement(intervals: DataFrame, span: DataFrame, *keys: str) -> DataFrame:
    """What the merged intervals leave of each span."""
    edges = span.select(*keys, F.col(A).alias(A), F.col(A).alias(B)).unionByName(merge(intervals, *keys)).unionByName(span.select(*keys, F.col(B).alias(A), F.col(B).alias(B)))
    w = Window.partitionBy(*keys).orderBy(A, B)
    gaps = edges.select(*keys, F.max(B).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(A), F.lead(A).over(w).alias(B))
    return gaps.filter(F.col(A) < F.col(B))


def at_times(rows: DataFrame, intervals: DataFrame, *keys: str) -> DataFrame:
    """Rows (with time_s) inside any interval of their key: a semi-join on a range."""
    other = intervals.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(A).alias("_a"), F.col(B).alias("_b"))
    on = F.col("time_s").between(F.col("_a"), F.col("_b"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(other, on, "left_semi")
