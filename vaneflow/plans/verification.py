"""Verification: candidate checks over a log to one verdict.

windows = available span, cut to the requested ones and to the branch's conditions; checks run in them all at once; roles
and results reduce to windows, branches and the mechanism, each a groupBy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import intervals, series, verdict


def windows_of(samples: DataFrame, requested: DataFrame | None, conditions: list[DataFrame], *keys: str) -> DataFrame:
    """Available span, then requested windows, then every condition's intervals, strictly overlapping parts only."""
    out = series.spans(samples, *keys)
    for part in ([requested] if requested is not None else []) + conditions:
        out = intervals.intersect(out, part, *keys)
    return out


def step_windows(timeline: DataFrame, condition: Column, span: DataFrame, *keys: str) -> DataFrame:
    """Windows of a condition on a timeline of changes, which hold until the next; unknown before the first."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("time_s")
    steps = timeline.withColumn("_e", F.lead("time_s").over(w)).join(span.select(*keys, F.col("start_s").alias("_s0"), F.col("end_s").alias("_s1")), list(keys))
    runs = steps.filter(F.coalesce(condition, F.lit(False))).select(*keys, F.greatest("time_s", "_s0").alias("start_s"), F.least(F.coalesce("_e", "_s1"), "_s1").alias("end_s"))
    return runs.filter("start_s < end_s")


def verify(candidate: DataFrame, windows: DataFrame, samples: DataFrame, parameters: DataFrame, topics: DataFrame) -> DataFrame:
    """(mechanism, verdict, ceiling, confidence, score) of candidates' checks (mechanism, branch_id, window, and the operands of a check)."""
    results = C.evaluate(candidate, windows, samples, parameters, topics)
    rich = results.drop("type").join(candidate.select("check_id", "mechanism", "branch_id", "window", "type", verdict.role(F.col("type")).alias("role")), "check_id")
    by_window = verdict.check_list(rich, "mechanism", "branch_id", "window")
    by_branch = verdict.branches(by_window, "mechanism", "branch_id")
    by_mechanism = verdict.mechanisms(by_branch, "mechanism")
    missing = rich.groupBy("mechanism").agg(F.coalesce(F.bool_or((F.col("role") == "evidence_availability") & (F.col("status") == "failed")), F.lit(False)).alias("_missing"), F.coalesce(F.bool_or((F.col("role") == "mechanism_defining") & (F.col("status") == "unresolved")), F.lit(False)).alias("_open"))
    score = verdict.confidence(rich, "mechanism")
    out = by_mechanism.join(missing, "mechanism").join(score, "mechanism")
    return out.select("mechanism", "verdict", verdict.ceiling(F.col("verdict"), F.col("_open"), F.col("_missing")).alias("ceiling"), "confidence", "score", "passed", "failed", "unresolved")
