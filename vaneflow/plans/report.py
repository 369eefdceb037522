"""Reports: graphs' results laid over a verdict, what a report lacks, and what that costs its hypotheses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import verdict

# Messages.
MATCHED = "Primary-source reconstruction matched logged terminal output %s."
CONTRADICTED = "Primary-source reconstruction contradicted logged terminal output %s."
DOWNGRADED = "Confidence downgraded by validation: %s"
LACKS = {
    "source_refs": "Medium/high confidence mechanism has no source references.",
    "numeric_checks": "Medium/high confidence mechanism has no numeric checks.",
    "missing_required_signals": "Medium/high confidence mechanism is missing required signals.",
    "expected_logged_signature": "Mechanism has no expected logged signature.",
}


def merge_graphs(evaluations: DataFrame, results: DataFrame, key: str = "mechanism") -> DataFrame:
    """Evaluations (key, verdict, ceiling, evidence, contradictions) with the results (key, terminal_output, verdict) of their
    graphs.

    Graphs that are conclusive count as one verdict, mixed if they differ, and each is a line of evidence or contradiction.
    Both verdicts are combined; a supported one with contradictions is mixed, and so is a contradicted one with evidence.
    The ceiling is that of the new verdict, and at most the old one if the old verdict was supported, else medium.
    Evaluations without a conclusive graph stay as they are.  Results are summed up by key before they meet evaluations.
    """
    told = results.filter(F.col("verdict").isin("supported", "contradicted", "mixed"))
    supports = F.col("verdict") == "supported"
    line = F.when(supports, F.format_string(MATCHED, "terminal_output")).otherwise(F.format_string(CONTRADICTED, "terminal_output"))
    lines = told.groupBy(key).agg(F.array_sort(F.collect_set(F.when(supports, line))).alias("_for"), F.array_sort(F.collect_set(F.when(~supports, line))).alias("_against"))
    both = evaluations.join(verdict.graphs(told, key).withColumnRenamed("verdict", "_graph").join(lines, key), key, "left")
    evidence, contradictions = F.array_distinct(F.concat("evidence", "_for")), F.array_distinct(F.concat("contradictions", "_against"))
    joint = verdict.combine(F.array("verdict", "_graph"))
    one_sided = ((joint == "supported") & (F.size(contradictions) > 0)) | ((joint == "contradicted") & (F.size(evidence) > 0))
    new = F.when(one_sided, "mixed").otherwise(joint)
    most = F.when(F.col("verdict") == "supported", F.col("ceiling")).otherwise("medium")
    hit = F.col("_graph").isNotNull()
    put = {"verdict": new, "ceiling": verdict.ceiling(new, F.lit(False), F.lit(False), most), "evidence": evidence, "contradictions": contradictions}
    return both.select(*(F.when(hit, put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in evaluations.columns))


def violations(report: DataFrame) -> DataFrame:
    """(hypothesis, place, message) of hypotheses (hypothesis, confidence, source_refs, numeric_checks,
    missing_required_signals, expected_logged_signature: arrays): what each lacks; null arrays count as empty."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    sure = F.col("confidence").isin("high", "medium")
    bad = {
        "source_refs": sure & (size("source_refs") <= 0), "numeric_checks": sure & (size("numeric_checks") <= 0),
        "missing_required_signals": sure & (size("missing_required_signals") > 0), "expected_logged_signature": size("expected_logged_signature") <= 0,
    }
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(p).alias("place"), F.lit(LACKS[p]).alias("message"))) for p, c in bad.items())))
    return report.select("hypothesis", F.inline(found))


def enforce(report: DataFrame, found: DataFrame) -> DataFrame:
    """The report with violations' effects: hypotheses of high or medium confidence fall to low, with a line of contradicting
    evidence for the first, and are no longer confirmed but unconfirmed.

    report: as for violations(), with contradicting_evidence (array), confirmed and unconfirmed (booleans).
    """
    order = F.array_position(F.array(*map(F.lit, LACKS)), F.col("place"))
    first = found.groupBy("hypothesis").agg(F.min_by("message", order).alias("_first"))
    both = report.join(first, "hypothesis", "left")
    hit = F.col("_first").isNotNull() & F.col("confidence").isin("high", "medium")
    return both.withColumns({
        "contradicting_evidence": F.when(hit, F.array_append("contradicting_evidence", F.format_string(DOWNGRADED, "_first"))).otherwise(F.col("contradicting_evidence")),
        "confirmed": F.col("confirmed") & ~hit, "unconfirmed": F.col("unconfirmed") | hit, "confidence": F.when(hit, "low").otherwise(F.col("confidence")),
    }).drop("_first")
