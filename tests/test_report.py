"""Rules of reports at their edges."""

from pyspark.sql import functions as F

from vaneflow.operators import catalog
from vaneflow.plans import report


def test_graphs_laid_over_verdicts(spark):
    rows = [("none", "supported", "high", ["e"], []), ("open", "supported", "low", [], []), ("match", "unresolved", "unresolved", [], []), ("clash", "supported", "high", [], []), ("twice", "supported", "medium", ["e"], []), ("against", "contradicted", "low", ["e"], []), ("both", "unresolved", "low", [], [])]
    e = spark.createDataFrame(rows, "mechanism string, verdict string, ceiling string, evidence array<string>, contradictions array<string>")
    results = [("open", "t", "unresolved"), ("match", "t", "supported"), ("clash", "t", "contradicted"), ("twice", "t", "supported"), ("twice", "t", "supported"), ("against", "t", "contradicted"), ("both", "t", "supported"), ("both", "u", "contradicted")]
    got = {r.mechanism: (r.verdict, r.ceiling, len(r.evidence), len(r.contradictions)) for r in report.merge_graphs(e, spark.createDataFrame(results, "mechanism string, terminal_output string, verdict string")).collect()}
    assert got == {
        "none": ("supported", "high", 1, 0), "open": ("supported", "low", 0, 0), "match": ("supported", "medium", 1, 0), "clash": ("mixed", "medium", 0, 1),
        "twice": ("supported", "medium", 2, 0), "against": ("mixed", "medium", 1, 1), "both": ("mixed", "medium", 1, 1),
    }


def test_what_is_lacking_costs_confidence(spark):
    shape = "hypothesis string, confidence string, source_refs array<string>, numeric_checks array<string>, missing_required_signals array<string>, expected_logged_signature array<string>, contradicting_evidence array<string>, confirmed boolean, unconfirmed boolean"
    rows = [("good", "high", ["s"], ["n"], None, ["e"], [], True, False), ("bare", "high", None, [], ["m"], None, ["old"], True, False), ("low", "low", [], [], [], [], [], True, False)]
    df = spark.createDataFrame(rows, shape)
    found = report.violations(df)
    assert sorted((r.hypothesis, r.place) for r in found.collect()) == [("bare", "expected_logged_signature"), ("bare", "missing_required_signals"), ("bare", "numeric_checks"), ("bare", "source_refs"), ("low", "expected_logged_signature")]
    got = {r.hypothesis: (r.confidence, list(r.contradicting_evidence), r.confirmed, r.unconfirmed) for r in report.enforce(df, found).collect()}
    assert got == {"good": ("high", [], True, False), "bare": ("low", ["old", "Confidence downgraded by validation: " + report.LACKS["source_refs"]], False, True), "low": ("low", [], True, False)}


def test_image_keys(spark):
    rows = [(" a.svg ", "a"), ("a.SVG", "a"), ("x/y", ""), ("..", ""), (None, ""), ("b\0", "b"), ("c.png", "c.png")]
    df = spark.createDataFrame(rows, "image string, want string").withColumn("got", catalog.image_key(F.col("image")))
    assert all(r.want == r.got for r in df.collect())
