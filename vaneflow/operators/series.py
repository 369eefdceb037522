"""Time series of samples: windows, metrics, changes, runs and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite, round6, seconds, seconds_ms
from ..schema import KEY, ORDER, in_time

#: Whole-valued signals of at most so many values are discrete.
DISCRETE_VALUES = 20


def in_window(samples: DataFrame, start_s: float | None, end_s: float | None) -> DataFrame:
    """Samples of a closed window on the rounded clock; an open side is None."""
    t, out = seconds(F.col("ts_us")), samples
    out = out if start_s is None else out.filter(t >= start_s)
    return out if end_s is None else out.filter(t <= end_s)


def first_instance(samples: DataFrame) -> DataFrame:
    """Only each topic's first instance, which metrics and checks use."""
    least = samples.groupBy("log_id", "topic").agg(F.min("multi_id").alias("multi_id"))
    return samples.join(least, ["log_id", "topic", "multi_id"], "left_semi")


def select_signals(samples: DataFrame, signals: list[tuple[str, str]]) -> DataFrame:
    """Only these (topic, field) pairs: filters that reach the scan."""
    return samples.filter(F.col("topic").isin(*{t for t, _ in signals})).filter(F.concat_ws(".", "topic", "field").isin(*(f"{t}.{f}" for t, f in signals)))


def _edge(value: str, last: bool) -> Column:
    return (F.max_by if last else F.min_by)(value, F.struct(*ORDER))


def metrics(samples: DataFrame, *keys: str) -> DataFrame:
    """Per key: count, first and last time, rate; and of finite values start, end, least, greatest, mean, median, deviation and change.

    One pass and one shuffle.  A key without finite values has its count and nulls.
    """
    keys, x, t = keys or tuple(KEY), finite(F.col("v")), seconds(F.col("ts_us"))
    with_x = samples.withColumns({"_x": x, "_t": t})
    some = with_x.groupBy(*keys).agg(
        F.count("*").alias("count"), F.count("_x").alias("n_finite"), F.min("_t").alias("first_s"), F.max("_t").alias("last_s"),
        _edge("_x", False).alias("start"), _edge("_x", True).alias("end"), F.min("_x").alias("min"), F.max("_x").alias("max"),
        F.avg("_x").alias("mean"), F.median("_x").alias("median"), F.stddev_pop("_x").alias("std"),
    )
    rate = F.when((F.col("count") >= 2) & (F.col("last_s") > F.col("first_s")), (F.col("count") - 1) / (F.col("last_s") - F.col("first_s")))
    out = some.withColumns({"rate_hz": rate, "delta": F.col("end") - F.col("start")})
    return out.select(*keys, "count", "n_finite", *(round6(F.col(c)).alias(c) for c in ("first_s", "last_s", "rate_hz", "start", "end", "min", "max", "mean", "median", "std", "delta")))


def requested_metrics(samples: DataFrame, requested: DataFrame) -> DataFrame:
    """Metrics of requested (topic, field) rows; those without samples stay, with a warning."""
    found = metrics(first_instance(samples), "topic", "field")
    return requested.join(found, ["topic", "field"], "left").withColumn("warning", F.when(F.col("count").isNull(), F.concat(F.lit("no samples for "), F.col("topic"), F.lit("."), F.col("field"))))


def kinds(samples: DataFrame, *keys: str) -> DataFrame:
    """Whether each key is continuous: all finite, and more than DISCRETE_VALUES values if all are whole."""
    keys = keys or tuple(KEY)
    whole = F.col("v") == F.floor("v")
    agg = samples.groupBy(*keys).agg(F.bool_and(finite(F.col("v")).isNotNull()).alias("_all"), F.bool_and(whole).alias("_whole"), F.count_distinct("v").alias("n_values"))
    return agg.select(*keys, "n_values", (F.col("_all") & (~F.col("_whole") | (F.col("n_values") > DISCRETE_VALUES))).alias("is_continuous"))


def value_counts(samples: DataFrame, value: str = "v", *keys: str) -> DataFrame:
    return samples.groupBy(*(keys or KEY), value).agg(F.count("*").alias("count"))


def changes(samples: DataFrame, value: str = "v", *keys: str) -> DataFrame:
    """The timeline: each key's first value and every change, on the millisecond clock."""
    w = in_time(*keys)
    prev, first = F.lag(value).over(w), F.row_number().over(w) == 1
    marked = samples.withColumns({"_first": first, "previous": prev})
    kept = marked.filter(F.col("_first") | ~F.col("previous").eqNullSafe(F.col(value)))
    return kept.withColumns({"event": F.when(F.col("_first"), "initial_value").otherwise("value_changed"), "time_s": seconds_ms(F.col("ts_us"))}).drop("_first")


def transitions(samples: DataFrame, value: str = "v", with_first: bool = False, *keys: str) -> DataFrame:
    """Changes as from and to; with_first counts the first row as one, as metrics do and checks don't."""
    found = changes(samples, value, *keys)
    found = found if with_first else found.filter("event = 'value_changed'")
    return found.withColumns({"from_value": F.col("previous"), "to_value": F.col(value), "time_s": seconds(F.col("ts_us"))})


def merge_timelines(*timelines: DataFrame, by: list[str]) -> DataFrame:
    """Events of several timelines, equal ones once: the last timeline's."""
    tagged = [t.withColumn("_src", F.lit(i)) for i, t in enumerate(timelines)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.desc("_src"))
    return out.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_src")


def state_intervals(samples: DataFrame, start_s: float, end_s: float, value: str = "v", *keys: str) -> DataFrame:
    """Runs of one value, clipped to the window; the value before it is carried in, the last run closes at its end."""
    keys, t = keys or tuple(KEY), seconds(F.col("ts_us"))
    before = t <= start_s
    w = in_time(*keys)
    kept = samples.filter(t <= end_s).withColumn("_rn", F.when(before, F.row_number().over(Window.partitionBy(*keys, before).orderBy(*(F.desc(c) for c in ORDER)))))
    kept = kept.filter(F.col("_rn").isNull() | (F.col("_rn") == 1)).withColumn("_t", F.greatest(t, F.lit(float(start_s))))
    runs = kept.withColumn("_p", F.lag(value).over(w)).withColumn("_f", F.row_number().over(w) == 1).filter(F.col("_f") | ~F.col("_p").eqNullSafe(F.col(value)))
    ends = runs.withColumn("end_s", F.coalesce(F.lead("_t").over(w), F.lit(float(end_s))))
    return ends.filter(F.col("end_s") > F.col("_t")).select(*keys, F.col(value).alias("value"), F.col("_t").alias("start_s"), "end_s")


def true_windows(samples: DataFrame, flag: Column, *keys: str) -> DataFrame:
    """Runs of a true condition: from the first true sample to the first false one after it; an open run closes at the last sample.  An unknown condition is false."""
    keys, w = keys or tuple(KEY), in_time(*keys)
    marked = samples.withColumns({"_b": F.coalesce(flag, F.lit(False)), "_t": seconds(F.col("ts_us"))})
    edges = marked.withColumns({"_p": F.lag("_b").over(w), "_last": F.max("_t").over(Window.partitionBy(*keys))}).filter(F.col("_p").isNull() | (F.col("_b") != F.col("_p")))
    ends = edges.withColumn("end_s", F.coalesce(F.lead("_t").over(w), F.col("_last")))
    return ends.filter("_b").select(*keys, F.col("_t").alias("start_s"), "end_s")


def intervals_between(samples: DataFrame, *keys: str) -> DataFrame:
    """Seconds since the sample before, at the later sample."""
    return samples.withColumn("dt_s", round6((F.col("ts_us") - F.lag("ts_us").over(in_time(*keys))) / F.lit(1e6))).filter("dt_s is not null")


def sampling_period(samples: DataFrame, min_rate_hz: float = 100.0, *keys: str) -> DataFrame:
    """Median of the positive steps in seconds; null below the least rate or with unknown times."""
    keys = keys or tuple(KEY)
    steps = samples.withColumn("_d", F.col("ts_us") - F.lag("ts_us").over(in_time(*keys)))
    agg = steps.groupBy(*keys).agg(F.median(F.when(F.col("_d") > 0, F.col("_d"))).alias("_m"), F.bool_or(F.col("ts_us").isNull()).alias("_bad"))
    period = F.col("_m") / F.lit(1e6)
    return agg.select(*keys, F.when(~F.col("_bad") & (period <= 1.0 / min_rate_hz), period).alias("period_s"))


def spans(samples: DataFrame, *keys: str) -> DataFrame:
    """First and last time; equal ones are widened by a millisecond."""
    agg = samples.groupBy(*(keys or KEY)).agg(F.min("ts_us").alias("_a"), F.max("ts_us").alias("_b"))
    start, end = seconds(F.col("_a")), seconds(F.col("_b"))
    return agg.select(*(keys or KEY), start.alias("start_s"), F.when(start == end, end + 0.001).otherwise(end).alias("end_s"))


def plot_range(samples: DataFrame, pad: float = 0.05) -> DataFrame:
    """Per log the times shown: the span and a share of it on either side."""
    agg = samples.groupBy("log_id").agg((F.min("ts_us") / 1e6).alias("_a"), (F.max("ts_us") / 1e6).alias("_b"))
    return agg.select("log_id", (F.col("_a") - pad * (F.col("_b") - F.col("_a"))).alias("start_s"), (F.col("_b") + pad * (F.col("_b") - F.col("_a"))).alias("end_s"))


def field_flags(samples: DataFrame, threshold: float = 0.0, *keys: str) -> DataFrame:
    """Per field: has finite values, values beyond a threshold, any that aren't 0, more than one value, only 0 and 1."""
    x = finite(F.col("v"))
    return samples.groupBy(*(keys or KEY)).agg(
        F.bool_or(x.isNotNull()).alias("has_finite"), F.coalesce(F.max(F.abs(x)) > threshold, F.lit(False)).alias("has_nonzero"),
        F.coalesce(F.bool_or(x != 0), F.lit(False)).alias("is_truthy"), (F.count_distinct(x) > 1).alias("changes"),
        F.coalesce(F.bool_and(F.when(x.isNotNull(), x.isin(0.0, 1.0))), F.lit(False)).alias("is_boolean"),
    )


def upper_median_tolerance(samples: DataFrame, held: Column | None = None, *keys: str) -> DataFrame:
    """How far a replay may be off: a thousandth of the larger of the upper medians of the sizes and of the deviations; 1e-6 at least; 1e-9 for held signals."""
    keys, x = keys or tuple(KEY), F.abs(finite(F.col("v")))
    at = lambda v, k: F.when(F.row_number().over(Window.partitionBy(*k).orderBy(v)) == F.floor(F.count(v).over(Window.partitionBy(*k)) / 2) + 1, v)
    sized = samples.withColumns({"_x": finite(F.col("v")), "_a": x}).filter("_x is not null")
    mids = sized.withColumns({"_ma": at(F.col("_a"), keys), "_mx": at(F.col("_x"), keys)}).withColumns({"_ma": F.max("_ma").over(Window.partitionBy(*keys)), "_mx": F.max("_mx").over(Window.partitionBy(*keys))})
    dev = mids.withColumn("_d", F.abs(F.col("_x") - F.col("_mx")))
    dev = dev.withColumn("_md", at(F.col("_d"), keys))
    out = dev.groupBy(*keys).agg(F.max("_ma").alias("median_size"), F.max("_md").alias("median_deviation"))
    tol = F.greatest(F.lit(1e-6), F.greatest("median_size", "median_deviation") * 1e-3)
    return out.withColumn("tolerance", F.when(held, F.lit(1e-9)).otherwise(tol) if held is not None else tol)


def modes_in_order(samples: DataFrame, value: str = "v", *keys: str) -> DataFrame:
    """Distinct values in the order of their first occurrence."""
    firsts = samples.groupBy(*(keys or KEY), value).agg(F.min(F.struct(*ORDER)).alias("_o"))
    return firsts.groupBy(*(keys or KEY)).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(value).alias("x")))), lambda s: s["x"]).alias("modes"))
