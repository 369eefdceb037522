"""Verdicts: reductions of check results to branches, mechanisms and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANK = {"unresolved": 0, "low": 1, "medium": 2, "high": 3}


def from_counts(supported: Column, contradicted: Column) -> Column:
    return F.when((supported > 0) & (contradicted > 0), "mixed").when(supported > 0, "supported").when(contradicted > 0, "contradicted").otherwise("unresolved")


def ceiling(verdict: Column, unresolved_defining: Column, missing_signals: Column, most: Column | None = None) -> Column:
    """The highest confidence that a verdict allows."""
    own = F.when(verdict == "supported", F.when(unresolved_defining, "medium").otherwise("high")).when(verdict == "mixed", "medium").when(verdict.isin("contradicted", "excluded"), "low").otherwise("unresolved")
    if most is not None:
        rank = lambda c: F.coalesce(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))[c], F.lit(0))
        own = F.when(most.isNotNull() & (most != "") & (rank(most) < rank(own)), most).otherwise(own)
    return F.when(missing_signals, "low").otherwise(own)


def combine(verdicts: Column) -> Column:
    """Several verdicts (an array) as one: unresolved ones give way, different ones are mixed."""
    known = F.array_distinct(F.filter(verdicts, lambda v: v.isNotNull() & ~v.isin("", "unresolved")))
    return F.when(F.size(known) == 0, "unresolved").when(F.size(known) == 1, known[0]).otherwise("mixed")


def _any(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def check_list(results: DataFrame, *keys: str) -> DataFrame:
    """Results (role, status) of each key: an applicability check that fails excludes, defining ones support or contradict."""
    role, status = F.col("role"), F.col("status")
    a, d = role == "branch_applicability", role == "mechanism_defining"
    agg = results.groupBy(*keys).agg(
        _any(a & (status == "failed")).alias("_x"), _any(a & (status == "unresolved")).alias("_au"), _any(d & (status == "unresolved")).alias("_du"),
        F.count_if(d).alias("n_defining"), F.count_if(d & (status == "passed")).alias("supported"), F.count_if(d & (status == "failed")).alias("contradicted"),
    )
    verdict = F.when(F.col("_x"), "excluded").when(F.col("_au") | (F.col("n_defining") == 0) | F.col("_du"), "unresolved").otherwise(from_counts(F.col("supported"), F.col("contradicted")))
    return agg.select(*keys, "n_defining", "supported", "contradicted", F.col("_du").alias("unresolved_defining"), verdict.alias("verdict"))


def branches(windows: DataFrame, *keys: str, blocked: Column | None = None) -> DataFrame:
    """Verdicts of a branch's windows as the branch's."""
    v = F.col("verdict")
    agg = windows.groupBy(*keys).agg(_any(v == "supported").alias("_s"), _any(v.isin("contradicted", "mixed")).alias("_cm"), _any(v == "mixed").alias("_m"), _any(v == "contradicted").alias("_c"), F.bool_and(v == "excluded").alias("_x"), _any(blocked if blocked is not None else F.lit(False)).alias("_b"), _any(F.col("n_defining") > 0).alias("has_defining"))
    out = F.when(F.col("_b"), "unresolved").when(F.col("_s") & F.col("_cm"), "mixed").when(F.col("_s"), "supported").when(F.col("_m"), "mixed").when(F.col("_x"), "excluded").when(F.col("_c"), "contradicted").otherwise("unresolved")
    return agg.select(*keys, "has_defining", out.alias("verdict"))


def mechanisms(branch_verdicts: DataFrame, *keys: str) -> DataFrame:
    """Branches as the mechanism: excluded ones and those without defining checks don't count; contradicted needs all."""
    v, counts = F.col("verdict"), (F.col("verdict") != "excluded") & F.col("has_defining")
    agg = branch_verdicts.groupBy(*keys).agg(_any(counts & (v == "supported")).alias("_s"), _any(counts & v.isin("contradicted", "mixed")).alias("_cm"), _any(counts & (v == "mixed")).alias("_m"), F.coalesce(F.bool_and(F.when(counts, v == "contradicted")), F.lit(False)).alias("_c"))
    out = F.when(F.col("_s") & F.col("_cm"), "mixed").when(F.col("_s"), "supported").when(F.col("_m"), "mixed").when(F.col("_c"), "contradicted").otherwise("unresolved")
    return agg.select(*keys, out.alias("verdict"))


def graphs(results: DataFrame, *keys: str) -> DataFrame:
    """All alike, or mixed."""
    agg = results.groupBy(*keys).agg(F.count_distinct(F.coalesce("verdict", F.lit(""))).alias("_n"), F.min("verdict").alias("_v"))
    return agg.select(*keys, F.when((F.col("_n") == 1) & F.col("_v").isin("supported", "contradicted"), F.col("_v")).otherwise("mixed").alias("verdict"))


def confidence(results: DataFrame, *keys: str, missing: Column | None = None) -> DataFrame:
    """Share of resolved checks that passed, less for missing signals and unresolved checks; and its class."""
    status, lacks = F.col("status"), _any(missing) if missing is not None else F.lit(False)
    agg = results.groupBy(*keys).agg(F.count_if(status == "passed").alias("passed"), F.count_if(status == "failed").alias("failed"), F.count_if(status == "unresolved").alias("unresolved"), lacks.alias("_missing"))
    share = F.try_divide(F.col("passed").cast("double"), F.col("passed") + F.col("failed"))
    score = share * F.when(F.col("_missing"), 0.7).otherwise(1.0) * F.when(F.col("unresolved") > 0, F.greatest(F.lit(0.5), 1 - F.col("unresolved") * 0.1)).otherwise(1.0)
    out = agg.withColumn("score", F.coalesce(F.round(score, 6), F.lit(0.0)))
    level = F.when(F.col("passed") + F.col("failed") == 0, "low").when((F.col("score") >= 0.8) & ~F.col("_missing"), "high").when(F.col("score") >= 0.6, "medium").otherwise("low")
    return out.withColumn("confidence", level).drop("_missing")


def claim_effect(status: Column, supports: Column, contradicts: Column) -> Column:
    """A failed check always contradicts; one that passes supports, unless it has a text for contradiction only."""
    has = lambda c: c.isNotNull() & (c != "")
    return F.when(status == "failed", "contradicts").when(status == "passed", F.when(has(contradicts) & ~has(supports), "contradicts").otherwise("supports"))


def message(effect: Column, supports: Column, contradicts: Column, fallback: Column) -> Column:
    text = F.when(effect == "supports", supports).when(effect == "contradicts", contradicts)
    return F.coalesce(F.nullif(text, F.lit("")), fallback)


def role(check_type: Column) -> Column:
    """What a check's type decides."""
    return F.when(check_type == "custom", "advisory").when(check_type == "topic_field_present", "evidence_availability").when(check_type.isin("parameter_equals", "branch_parameter_satisfied"), "branch_applicability").otherwise("mechanism_defining")
