"""As-of and interpolated joins, and union timelines.

Each is one union and one window pass over the key: a single shuffle, never a product of the sides.  A key whose series
is too long for one task can be cut into time buckets; the last and next values of the other side are then carried over
the buckets' borders from one row per bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PI = 3.141592653589793


def neighbours(left: DataFrame, right: DataFrame, keys: list[str], value: str = "v", bucket_us: int | None = None) -> DataFrame:
    """Left rows with prev_us, prev_v (right's last at or before) and next_us, next_v (right's first at or after)."""
    extra = [c for c in left.columns if c not in keys]
    side = F.struct(F.col("ts_us").alias("t"), F.col(value).alias("x"))
    a = left.select(*keys, "ts_us", F.lit(1).alias("_tag"), F.col("seq").alias("_seq"), F.lit(None).cast(right.select(side.alias("s")).schema["s"].dataType).alias("_r"), F.struct(*extra).alias("_l"))
    b = right.select(*keys, "ts_us", F.lit(0).alias("_tag"), F.col("seq").alias("_seq"), side.alias("_r"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"))
    both = a.unionByName(b)
    if bucket_us is None:
        return _filled(both, keys, None).select(*keys, "_l.*", *_names())
    both = both.withColumn("_b", F.floor(F.col("ts_us") / bucket_us))
    at = F.struct("ts_us", "_tag", "_seq")
    ends = both.filter("_tag = 0").groupBy(*keys, "_b").agg(F.max_by("_r", at).alias("_last"), F.min_by("_r", at).alias("_first"))
    buckets = both.select(*keys, "_b").distinct().join(ends, [*keys, "_b"], "left")  # a row for each key and bucket
    w = Window.partitionBy(*keys).orderBy("_b")
    carried = buckets.select(*keys, "_b", F.last("_last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    return _filled(both.join(carried, [*keys, "_b"]), [*keys, "_b"], ("_before", "_after")).select(*keys, "_l.*", *_names())


def _names() -> list[Column]:
    return [F.col("_prev.t").alias("prev_us"), F.col("_prev.x").alias("prev_v"), F.col("_next.t").alias("next_us"), F.col("_next.x").alias("next_v")]


def _filled(both: DataFrame, keys: list[str], carried: tuple[str, str] | None) -> DataFrame:
    """Right rows come before left rows of their time looking back, and after them looking ahead, so that a hit is both."""
    back = Window.partitionBy(*keys).orderBy("ts_us", "_tag", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("ts_us"), "_tag", F.desc("_seq")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({"_prev": F.last("_r", True).over(back), "_next": F.last("_r", True).over(ahead)}).filter("_tag = 1")
    return out if carried is None else out.withColumns({"_prev": F.coalesce("_prev", carried[0]), "_next": F.coalesce("_next", carried[1])})


def value_at(method: str, t: Column | None = None, clamped: bool = True) -> Column:
    """The right side's value at a left row of neighbours().

    prior: the last at or before; nearest: ties go to the earlier; linear; angle_wrap: linear along the shorter arc, in
    radians; discrete_hold: like prior, but inside the span only.  clamped keeps the end values beyond the span; else
    there is none there.  A NaN end breaks its segment.  quaternion_slerp is declared by policies, but gives null.
    """
    t = F.col("ts_us") if t is None else t
    p, n, pt, nt = F.col("prev_v"), F.col("next_v"), F.col("prev_us"), F.col("next_us")
    hit, inside = pt == t, p.isNotNull() & n.isNotNull()
    share = F.try_divide((t - pt).cast("double"), (nt - pt).cast("double"))
    sound = inside & ~F.isnan(p) & ~F.isnan(n)
    ends = F.coalesce(p, n)
    if method == "prior":
        return p
    if method == "discrete_hold":
        return F.when(hit | inside, p)
    if method == "nearest":
        near = F.when(inside, F.when(t - pt <= nt - t, p).otherwise(n))
        return F.coalesce(near, ends) if clamped else near
    if method == "linear":
        line = F.when(hit, p).when(sound, F.when(nt == pt, p).otherwise(p + share * (n - p)))
        return F.coalesce(line, F.when(~inside, ends)) if clamped else line
    if method == "angle_wrap":
        arc = (n - p) - F.lit(2 * PI) * F.floor((n - p + PI) / (2 * PI))
        x = p + share * arc
        return F.when(hit, p).when(sound, x - F.lit(2 * PI) * F.floor((x + PI) / (2 * PI)))
    if method == "quaternion_slerp":
        return F.lit(None).cast("double")
    raise ValueError(f"unknown method {method!r}")


def by_policy(method: Column) -> Column:
    """The method is a column of policies; of a quaternion's component there are values at its own times only."""
    names = ("discrete_hold", "linear", "angle_wrap")
    out = reduce(lambda acc, m: acc.when(method == m, value_at(m, clamped=False)), names[1:], F.when(method == names[0], value_at(names[0])))
    return out.when((method == "quaternion_slerp") & (F.col("prev_us") == F.col("ts_us")), F.col("prev_v"))


def align(left: DataFrame, right: DataFrame, keys: list[str], method: str = "linear", name: str = "right_v", clamped: bool = False, bucket_us: int | None = None) -> DataFrame:
    """Left rows with the right side's value; without clamping, rows outside its span have none."""
    return neighbours(left, right, keys, bucket_us=bucket_us).withColumn(name, value_at(method, clamped=clamped)).drop("prev_us", "prev_v", "next_us", "next_v")


def exact_at(left: DataFrame, right: DataFrame, keys: list[str], name: str = "right_v") -> DataFrame:
    """Values that aren't numbers meet at equal times only."""
    first = right.groupBy(*keys, "ts_us").agg(F.min_by("v", "seq").alias(name))
    return left.join(first, [*keys, "ts_us"], "left")


def errors(actual: DataFrame, setpoint: DataFrame, keys: list[str], method: str = "linear") -> DataFrame:
    """Actual minus setpoint at the actual's times inside the setpoint's span."""
    return align(actual, setpoint, keys, method, "setpoint").filter("setpoint is not null and v is not null").withColumn("error", F.col("v") - F.col("setpoint"))


def union_timeline(samples: DataFrame, fields: dict[str, str], keys: list[str], common_domain: bool = True) -> DataFrame:
    """One row per time of any of the signals, a column for each with its last value at or before.

    fields: column names by field.  With common_domain only times from the latest first sample to the earliest last one
    stay, so every column has a value.  The field list is given, so no pass is needed to find columns.
    """
    w = Window.partitionBy(*keys).orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    at = Window.partitionBy(*keys, "ts_us").orderBy(F.desc("seq"))
    whole = Window.partitionBy(*keys)
    own = samples.filter(F.col("field").isin(*fields))
    cols = {name: F.last(F.when(F.col("field") == f, F.col("v")), True).over(w) for f, name in fields.items()}
    start = F.greatest(*(F.min(F.when(F.col("field") == f, F.col("ts_us"))).over(whole) for f in fields)) if len(fields) > 1 else F.min("ts_us").over(whole)
    end = F.least(*(F.max(F.when(F.col("field") == f, F.col("ts_us"))).over(whole) for f in fields)) if len(fields) > 1 else F.max("ts_us").over(whole)
    out = own.withColumns(cols | {"_s": start, "_e": end, "_n": F.row_number().over(at)}).filter("_n = 1")
    names = list(fields.values())
    if common_domain:
        known = reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in names))
        out = out.filter(known & F.col("ts_us").between(F.col("_s"), F.col("_e")))
    return out.select(*keys, "ts_us", *names)


def onto_first(samples: DataFrame, first: str, others: dict[str, str], keys: list[str], first_name: str = "x") -> DataFrame:
    """All signals at the first one's times, interpolated and clamped: a join per signal, each along the same key."""
    left = samples.filter(F.col("field") == first).withColumn(first_name, F.col("v"))
    for f, name in others.items():
        left = align(left, samples.filter(F.col("field") == f), keys, "linear", name, clamped=True)
    return left
