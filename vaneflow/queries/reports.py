"""Reports over customers as mechanisms, and pictures of parts as airframes."""

from pyspark.sql import functions as F

from ..operators import catalog
from ..plans import report
from ..sources.tables import table
from . import query


@query("""WITH e AS (SELECT c_custkey AS k, (['supported', 'contradicted', 'mixed', 'unresolved', 'excluded'])[c_custkey % 5 + 1] AS v, CASE WHEN c_custkey % 5 = 0 THEN (['high', 'medium', 'low'])[c_custkey % 3 + 1] ELSE 'low' END AS c, c_custkey % 2 AS ne, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS nc FROM customer),
g AS (SELECT o_custkey AS k, count(DISTINCT CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END) AS n, bool_and(o_orderstatus = 'F') AS yes, count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') AS f, count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O') AS a FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1),
j AS (SELECT e.*, g.k AS gk, CASE WHEN n = 1 THEN CASE WHEN yes THEN 'supported' ELSE 'contradicted' END ELSE 'mixed' END AS gv, ne + coalesce(f, 0) AS te, nc + coalesce(a, 0) AS tc FROM e LEFT JOIN g ON e.k = g.k),
b AS (SELECT *, CASE WHEN v = 'unresolved' THEN gv WHEN v = gv THEN v ELSE 'mixed' END AS w FROM j), d AS (SELECT *, CASE WHEN (w = 'supported' AND tc > 0) OR (w = 'contradicted' AND te > 0) THEN 'mixed' ELSE w END AS nv, CASE WHEN v = 'supported' THEN c ELSE 'medium' END AS most FROM b),
r AS (SELECT *, CASE nv WHEN 'supported' THEN 3 WHEN 'mixed' THEN 2 WHEN 'contradicted' THEN 1 WHEN 'excluded' THEN 1 ELSE 0 END AS own, CASE most WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS cap FROM d)
SELECT k AS mechanism, CASE WHEN gk IS NULL THEN v ELSE nv END AS verdict, CASE WHEN gk IS NULL THEN c ELSE (['unresolved', 'low', 'medium', 'high'])[least(own, cap) + 1] END AS ceiling, CAST(te AS INT) AS n_evidence, CAST(tc AS INT) AS n_contradictions FROM r""")
def graph_overlay(spark, d):
    """Customers' verdicts with those of their orders laid over."""
    at = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i.cast("int") + 1)
    k = F.col("c_custkey")
    some = lambda when, text: F.when(when, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    e = table(spark, d, "customer").select(k.alias("mechanism"), at(("supported", "contradicted", "mixed", "unresolved", "excluded"), k % 5).alias("verdict"), F.when(k % 5 == 0, at(("high", "medium", "low"), k % 3)).otherwise("low").alias("ceiling"), some(k % 2 == 1, "seen").alias("evidence"), some(k % 3 == 0, "unseen").alias("contradictions"))
    results = table(spark, d, "orders").select(F.col("o_custkey").alias("mechanism"), F.col("o_orderpriority").alias("terminal_output"), F.when(F.col("o_orderstatus") == "F", "supported").when(F.col("o_orderstatus") == "O", "contradicted").otherwise("unresolved").alias("verdict"))
    return report.merge_graphs(e, results).select("mechanism", "verdict", "ceiling", F.size("evidence").alias("n_evidence"), F.size("contradictions").alias("n_contradictions"))


def hypotheses(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    some = lambda when: F.when(when, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return p.select(k.alias("hypothesis"), F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "unresolved"))), (k % 4).cast("int") + 1).alias("confidence"), some(k % 3 > 0).alias("source_refs"), F.when(k % 5 > 0, F.array(F.lit("n"))).alias("numeric_checks"), some(k % 7 == 0).alias("missing_required_signals"), some(k % 11 > 0).alias("expected_logged_signature"), F.array().cast("array<string>").alias("contradicting_evidence"), (k % 2 == 0).alias("confirmed"), (k % 2 == 1).alias("unconfirmed"))


RULES = """h AS (SELECT p_partkey AS k, (['high', 'medium', 'low', 'unresolved'])[p_partkey % 4 + 1] AS c, p_partkey % 4 < 2 AS sure FROM part),
v AS (SELECT k, 1 AS n, 'source_refs' AS place, 'Medium/high confidence mechanism has no source references.' AS message FROM h WHERE sure AND k % 3 = 0 UNION ALL SELECT k, 2, 'numeric_checks', 'Medium/high confidence mechanism has no numeric checks.' FROM h WHERE sure AND k % 5 = 0
 UNION ALL SELECT k, 3, 'missing_required_signals', 'Medium/high confidence mechanism is missing required signals.' FROM h WHERE sure AND k % 7 = 0 UNION ALL SELECT k, 4, 'expected_logged_signature', 'Mechanism has no expected logged signature.' FROM h WHERE k % 11 = 0)"""


@query(f"WITH {RULES} SELECT k AS hypothesis, place, message FROM v")
def report_violations(spark, d):
    """What hypotheses lack."""
    return report.violations(hypotheses(spark, d))


@query(f"""WITH {RULES}, f AS (SELECT k, arg_min(message, n) AS m FROM v GROUP BY k), j AS (SELECT h.*, m, m IS NOT NULL AND sure AS hit FROM h LEFT JOIN f USING (k))
SELECT k AS hypothesis, CASE WHEN hit THEN 'low' ELSE c END AS confidence, CASE WHEN hit THEN 'Confidence downgraded by validation: ' || m ELSE '' END AS why, k % 2 = 0 AND NOT hit AS confirmed, k % 2 = 1 OR hit AS unconfirmed FROM j""")
def report_downgrades(spark, d):
    """What that costs them."""
    h = hypotheses(spark, d)
    return report.enforce(h, report.violations(h)).select("hypothesis", "confidence", F.array_join("contradicting_evidence", " ").alias("why"), "confirmed", "unconfirmed")


@query("""WITH a AS (SELECT s_suppkey AS a, CASE s_suppkey % 5 WHEN 0 THEN 'n' || s_nationkey || '.SVG' WHEN 1 THEN 'n' || s_nationkey WHEN 2 THEN '../x.svg' WHEN 3 THEN 'none' END AS image FROM supplier),
k AS (SELECT a, regexp_replace(image, '\\.SVG$', '') AS key FROM a WHERE regexp_replace(image, '\\.SVG$', '') IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey < 3)),
l AS (SELECT p_partkey AS id, p_partkey % 120 AS a, CASE p_partkey % 4 WHEN 0 THEN 'AirframeUnknown' WHEN 1 THEN 'old' WHEN 2 THEN '' END AS was FROM part), n AS (SELECT l.*, coalesce(key, 'AirframeUnknown') AS new FROM l LEFT JOIN k USING (a))
SELECT id, new AS airframe_image_key FROM n WHERE NOT (new = 'AirframeUnknown' AND coalesce(was, '') <> '') AND new <> coalesce(was, '')""")
def image_refresh(spark, d):
    """Logs whose picture changes: never back to the default."""
    k = F.col("p_partkey")
    logs = table(spark, d, "part").select(k.alias("id"), (k % 120).alias("airframe_id"), F.when(k % 4 == 0, catalog.DEFAULT_IMAGE).when(k % 4 == 1, "old").when(k % 4 == 2, "").alias("airframe_image_key"))
    s, nation = F.col("s_suppkey"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    image = F.when(s % 5 == 0, F.concat(nation, F.lit(".SVG"))).when(s % 5 == 1, nation).when(s % 5 == 2, "../x.svg").when(s % 5 == 3, "none")
    airframes = table(spark, d, "supplier").select(s.alias("airframe_id"), image.alias("image"))
    assets = table(spark, d, "nation").filter("n_regionkey < 3").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"))
    return catalog.refresh_images(logs, airframes, assets)
