"""Fewer points for plots, chosen by rank within each key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite
from ..schema import KEY, in_time


def _ranked(samples: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Ranks from 0 (_i) and counts (_n)."""
    return samples.withColumns({"_i": F.row_number().over(in_time(*keys)) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})


def stride(samples: DataFrame, max_points: int, *keys: str) -> DataFrame:
    """Every n-th point and always the last, so there may be one more than max_points."""
    r = _ranked(samples, keys or tuple(KEY))
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / max_points))
    return r.filter((F.col("_n") <= max_points) | (F.col("_i") % step == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")


def _linspace(i: Column, n: Column, stop: Column, start: Column) -> Column:
    """The i-th of n whole steps from start to stop, cut towards zero."""
    return F.floor(start + i * F.try_divide((stop - start).cast("double"), (n - 1).cast("double")))


def _on_steps(i: Column, top: Column, n: int) -> Column:
    """Whether rank i is one of the n whole steps from 0 to top: the steps next to where it would be are looked at."""
    near = F.floor(F.try_divide(i * F.lit(float(n - 1)), top.cast("double")))
    step = lambda j: j.between(0, n - 1) & (_linspace(j, F.lit(n), top, F.lit(0)) == i)
    return F.when(top == 0, i == 0).otherwise(step(near - 1) | step(near) | step(near + 1) | step(near + 2))


def _bounded(chosen: DataFrame, max_points: int, keys: tuple[str, ...]) -> DataFrame:
    """At most max_points of the rows marked _keep, evenly by rank; where they are fewer, others are added evenly over all rows."""
    w = Window.partitionBy(*keys)
    r = chosen.withColumns({"_k": F.sum(F.col("_keep").cast("int")).over(w), "_r": F.sum(F.col("_keep").cast("int")).over(in_time(*keys).rowsBetween(Window.unboundedPreceding, 0)) - 1})
    r = r.withColumn("_even", _on_steps(F.col("_i"), F.col("_n") - 1, max_points))
    # additions count in order until the number is reached
    r = r.withColumn("_add", F.sum((F.col("_even") & ~F.col("_keep")).cast("int")).over(in_time(*keys).rowsBetween(Window.unboundedPreceding, 0)))
    few = F.col("_keep") | (F.col("_even") & (F.col("_add") <= max_points - F.col("_k")))
    many = F.col("_keep") & _on_steps(F.col("_r"), F.col("_k") - 1, max_points)
    out = r.filter((F.col("_n") <= max_points) | F.when(F.col("_k") > max_points, many).otherwise(few))
    return out.drop("_i", "_n", "_keep", "_k", "_r", "_even", "_add")


def steps(samples: DataFrame, max_points: int, *keys: str) -> DataFrame:
    """First, last, and both sides of every change."""
    keys = keys or tuple(KEY)
    w = in_time(*keys)
    r = _ranked(samples, keys)
    edge = lambda f: ~F.coalesce(f("v").over(w).eqNullSafe(F.col("v")), F.lit(False))
    return _bounded(r.withColumn("_keep", (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1) | edge(F.lag) | edge(F.lead)), max_points, keys)


def extrema(samples: DataFrame, max_points: int, *keys: str) -> DataFrame:
    """First, last, and the least and the greatest finite value of each of (max_points - 2) // 2 buckets of ranks; the first of equals."""
    keys, buckets = keys or tuple(KEY), max(1, (max_points - 2) // 2)
    r = _ranked(samples, keys)
    inner = F.col("_n") - 2
    # the bucket whose borders 1 + floor(j * (n - 2) / buckets) hold the rank
    guess = F.floor((F.col("_i") - 1) * buckets / F.greatest(inner, F.lit(1)))
    border = lambda j: 1 + F.floor(j * inner / buckets)
    bucket = F.when(border(guess + 1) <= F.col("_i"), guess + 1).when(border(guess) > F.col("_i"), guess - 1).otherwise(guess)
    r = r.withColumns({"_b": F.when(F.col("_i").between(1, F.col("_n") - 2), bucket), "_x": finite(F.col("v"))})
    w = Window.partitionBy(*keys, "_b")
    r = r.withColumns({"_lo": F.min(F.when(F.col("_x").isNotNull(), F.struct("_x", "_i"))).over(w)["_i"], "_hi": F.max(F.when(F.col("_x").isNotNull(), F.struct("_x", (-F.col("_i")).alias("_j")))).over(w)["_j"]})
    keep = (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1) | (F.col("_b").isNotNull() & ((F.col("_i") == F.col("_lo")) | (F.col("_i") == -F.col("_hi"))))
    return _bounded(r.withColumn("_keep", F.coalesce(keep, F.lit(False))).drop("_b", "_x", "_lo", "_hi"), max_points, keys)


def histogram2d(rows: DataFrame, x: str, y: str, bins: int, x_range: tuple[float, float], y_range: tuple[float, float]) -> DataFrame:
    """Counts of cells of a grid; the greatest values belong to the last cells, others outside the ranges to none."""
    cell = lambda c, r: F.least(F.lit(bins), F.width_bucket(F.col(c), F.lit(float(r[0])), F.lit(float(r[1])), F.lit(bins)))
    inside = F.col(x).between(*map(float, x_range)) & F.col(y).between(*map(float, y_range))
    return rows.filter(inside).groupBy(cell(x, x_range).alias("x_bin"), cell(y, y_range).alias("y_bin")).agg(F.count("*").alias("n"))


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def local_maxima(rows: DataFrame, order: str, value: str, top: int, *keys: str) -> DataFrame:
    """The highest peaks of a curve, or where it has none its highest points."""
    w = Window.partitionBy(*keys).orderBy(order)
    least = F.lit(-math.inf)
    peak = (F.col(value) >= F.coalesce(F.lag(value).over(w), least)) & (F.col(value) >= F.coalesce(F.lead(value).over(w), least))
    r = rows.withColumn("_p", peak).withColumn("_any", F.bool_or("_p").over(Window.partitionBy(*keys)))
    best = Window.partitionBy(*keys).orderBy(F.desc(value), order)
    return r.filter(F.col("_p") | ~F.col("_any")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).drop("_p", "_any")
