"""Parameters against the predicates of a source: as bounds per branch, and one by one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import compare_by

# Parts of a parameter's name or of a predicate by the role that they show, the first that holds.
ROLES = [
    ("branch_selector", "name", ["enable", "circuit", "type", "mode", "sel", "switch"]),
    ("branch_selector", "predicate", ["if", "switch", "case"]),
    ("threshold", "name", ["rad", "alt", "dist", "speed", "min", "max", "lim", "thr"]),
    ("tuning_or_shaping", "name", ["gain", "p_", "i_", "d_", "tc", "damp"]),
]


def role(name: Column, predicate: Column) -> Column:
    """What a parameter does in a predicate."""
    of = {"name": F.lower(name), "predicate": F.lower(F.coalesce(predicate, F.lit("")))}
    has = lambda where, parts: reduce(lambda a, b: a | b, (of[where].contains(p) for p in parts))
    return reduce(lambda acc, r: F.when(has(r[1], r[2]), r[0]).otherwise(acc), reversed(ROLES), F.lit("unknown"))


def requirements(predicates: DataFrame, parameters: DataFrame) -> DataFrame:
    """(log, branch, name, role, predicate, actual, result) of predicates (branch, name, op, value, predicate) in every log
    that has the parameter (log, name, v); those that no log has stand once, without a log.

    unknown: no value on either side, or no operator; verification_required: the parameter doesn't select a branch, so
    its effect shows in samples alone; else satisfied or contradicted.
    """
    p = predicates.withColumn("role", role(F.col("name"), F.col("predicate")))
    both = p.join(parameters.select("log", "name", F.col("v").alias("actual")), "name", "left")
    holds = compare_by(F.col("op"), F.col("actual"), F.col("value"))
    result = F.when(F.col("actual").isNull() | F.col("name").isNull(), "unknown").when(F.col("role") != "branch_selector", "verification_required").when(holds, "satisfied").when(~holds, "contradicted").otherwise("unknown")
    return both.select("log", "branch", "name", "role", "predicate", "actual", result.alias("result"))


def requirement_counts(predicates: DataFrame, parameters: DataFrame) -> DataFrame:
    """(branch, name, role, result, n): the rows of `requirements`, counted, without a row for each predicate and log.

    Predicates that say the same of one branch and logs of one value are counted first and meet as one pair, which stands
    for the product of both numbers; so pairs grow with distinct predicates and values, not with rows.
    """
    p = predicates.groupBy("branch", "name", "op", "value", "predicate").agg(F.count("*").alias("_p"))
    logs = parameters.groupBy("name", "v").agg(F.count("*").alias("_logs"))
    alike = logs.select("name", F.struct("v", "_logs").alias("log"), "v")
    met = requirements(p.withColumn("branch", F.struct("branch", "_p")), alike)
    n = F.col("branch._p") * F.coalesce("log._logs", F.lit(1))
    return met.groupBy(F.col("branch.branch").alias("branch"), "name", "role", "result").agg(F.sum(n).alias("n"))


def envelopes(predicates: DataFrame) -> DataFrame:
    """(branch, name, low, low_open, high, high_open, barred, satisfiable): the values that all predicates (branch, name, op,
    value) of a branch on one parameter allow together.

    Each predicate is an interval or a barred value, and their intersection the greatest lower and the least upper end;
    an end that is open wins over a closed one at the same value.  What no value satisfies is found without any log.
    """
    op, v = F.col("op"), F.col("value")
    lows, highs = op.isin(">", ">=", "=="), op.isin("<", "<=", "==")
    low = F.max(F.when(lows, F.struct(v.alias("v"), (op == ">").cast("int").alias("open")))).alias("_low")
    high = F.min(F.when(highs, F.struct(v.alias("v"), (-(op == "<").cast("int")).alias("open")))).alias("_high")
    known = predicates.filter(op.isin(">", ">=", "<", "<=", "==", "!=") & v.isNotNull())
    agg = known.groupBy("branch", "name").agg(low, high, F.array_sort(F.collect_set(F.when(op == "!=", v))).alias("barred"))
    lo, hi = F.col("_low.v"), F.col("_high.v")
    lo_open, hi_open = F.coalesce(F.col("_low.open") == 1, F.lit(False)), F.coalesce(F.col("_high.open") == -1, F.lit(False))
    point = (lo == hi) & ~lo_open & ~hi_open & ~F.array_contains("barred", lo)
    fits = F.when(lo.isNull() | hi.isNull(), True).otherwise((lo < hi) | point)
    return agg.select("branch", "name", lo.alias("low"), lo_open.alias("low_open"), hi.alias("high"), hi_open.alias("high_open"), "barred", fits.alias("satisfiable"))


def gate(bounds: DataFrame, parameters: DataFrame, logs: DataFrame) -> DataFrame:
    """(log, branch, feasible, contradicted) of every branch in every log: false if a parameter lies outside its bounds or
    the bounds allow nothing, null if one isn't known, else true; contradicted: the parameters that rule it out.

    The branches' bounds, one row for each parameter, meet the logs' parameters by name; a branch that can't be satisfied
    is settled before.
    """
    dead = bounds.filter("not satisfiable").groupBy("branch").agg(F.array_sort(F.collect_set("name")).alias("_never"))
    n = bounds.groupBy("branch").agg(F.count("*").alias("_n"))
    v = F.col("v")
    over = F.coalesce(F.when(F.col("low_open"), v > F.col("low")).otherwise(v >= F.col("low")), F.lit(True))
    under = F.coalesce(F.when(F.col("high_open"), v < F.col("high")).otherwise(v <= F.col("high")), F.lit(True))
    inside = over & under & ~F.array_contains("barred", v)
    met = bounds.join(dead, "branch", "left_anti").join(parameters.select("log", "name", "v").filter("v is not null"), "name").withColumn("_ok", inside)
    per = met.groupBy("log", "branch").agg(F.count("*").alias("_seen"), F.bool_and("_ok").alias("_all"), F.array_sort(F.collect_set(F.when(~F.col("_ok"), F.col("name")))).alias("_bad"))
    every = logs.select("log").distinct().crossJoin(F.broadcast(n.join(dead, "branch", "left")))  # the declared branches
    rows = every.join(per, ["log", "branch"], "left")
    feasible = F.when(F.col("_never").isNotNull() | ~F.col("_all"), False).when(F.col("_seen") == F.col("_n"), True)
    return rows.select("log", "branch", feasible.alias("feasible"), F.coalesce("_never", "_bad", F.array().cast("array<string>")).alias("contradicted"))
