"""Feasibility of a declared decision graph in every user's log: constants first, then samples where they leave it open."""

from pyspark.sql import functions as F

from ..operators import feasibility, graph
from ..sources.tables import event_samples
from . import query

BRANCHES = [("mode", "MODE == 1"), ("high", "click > LIMIT"), ("both", "(MODE == 1 || view < 30) && click > 20"), ("level", "LEVEL >= 40"), ("never", "LIMIT < 0 && click > 10"), ("wide", "click >= view"), ("chain", "TOP > 90 || TOP < 10"), ("odd", "fmax(click, view) > 3"), ("blind", "missing > 1")]
PRODUCERS = [("lv", "LEVEL", "LIMIT", 2.0, 0.0), ("top", "TOP", "LEVEL", 1.0, 5.0), ("zero", "TOP", None, None, 0.0)]
CONTROLS = [("lv", "mode"), ("top", "level"), ("zero", "never")]


def evaluate(spark, d):
    s = event_samples(spark, d)
    samples = s.select(F.col("multi_id").alias("log"), F.col("field").alias("signal"), "ts_us", "seq", "v")
    logs = samples.select("log").filter("log is not null").distinct()
    rows = logs.select("log", F.explode(F.array(F.struct(F.lit("MODE").alias("symbol"), (F.col("log") % 2).cast("double").alias("v")), F.struct(F.lit("LIMIT").alias("symbol"), (F.col("log") % 3 * 25).cast("double").alias("v")))).alias("c"))
    terms, opaque = feasibility.predicate_terms(spark.createDataFrame(BRANCHES, "branch string, predicate string"))
    producers = spark.createDataFrame(PRODUCERS, "operation string, symbol string, base string, factor double, offset double")
    controls = spark.createDataFrame([*CONTROLS, ("any", "odd")], "operation string, branch string")
    return feasibility.evaluate(terms, producers, controls, rows.select("log", "c.*"), samples, logs)


LOGS = """l AS (SELECT DISTINCT user_id AS log, CAST(user_id % 2 AS DOUBLE) AS mode, CAST(user_id % 3 * 25 AS DOUBLE) AS lim FROM events WHERE user_id IS NOT NULL),
c AS (SELECT *, CASE WHEN mode = 1 THEN 2 * lim END AS level FROM l), k AS (SELECT *, CASE WHEN level >= 40 THEN level + 5 END AS top FROM c),
static AS (SELECT log, b.branch, b.holds FROM k, LATERAL (VALUES ('mode', mode = 1), ('level', level >= 40), ('never', CASE WHEN lim < 0 THEN NULL ELSE false END), ('chain', top > 90 OR top < 10)) b(branch, holds) WHERE b.holds IS NOT NULL),
s AS (SELECT user_id AS log, event_type AS f, epoch_us(ts) AS us, arg_max(value, event_id) AS v FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL GROUP BY ALL),
e AS (SELECT log, f, min(us) AS a, max(us) AS z FROM s GROUP BY ALL),
needs AS (SELECT log, 'high' AS branch, 'click' AS f FROM k UNION ALL SELECT log, 'both', 'click' FROM k UNION ALL SELECT log, 'both', 'view' FROM k WHERE mode = 0 UNION ALL SELECT log, 'wide', unnest(['click', 'view']) FROM k),
span AS (SELECT log, branch, max(a) AS a, min(z) AS z FROM needs LEFT JOIN e USING (log, f) GROUP BY ALL HAVING count(*) = count(a) AND max(a) <= min(z)),
u AS (SELECT DISTINCT log, branch, us FROM span JOIN needs USING (log, branch) JOIN s USING (log, f) WHERE us BETWEEN span.a AND span.z UNION SELECT log, branch, a FROM span UNION SELECT log, branch, z FROM span),
x AS (SELECT u.*, p.v AS click, q.v AS view FROM u ASOF LEFT JOIN (SELECT * FROM s WHERE f = 'click') p ON u.log = p.log AND u.us >= p.us ASOF LEFT JOIN (SELECT * FROM s WHERE f = 'view') q ON u.log = q.log AND u.us >= q.us),
h AS (SELECT x.log, branch, us, CASE branch WHEN 'high' THEN click > lim WHEN 'both' THEN (mode = 1 OR view < 30) AND click > 20 ELSE click >= view END AS holds FROM x JOIN k USING (log)),
dyn AS (SELECT log, branch, CASE WHEN bool_and(holds) THEN 'always_true' WHEN NOT bool_or(holds) THEN 'always_false' ELSE 'unknown' END AS verdict FROM h GROUP BY ALL)"""


@query(f"""WITH {LOGS}, told AS (SELECT log, branch, CASE WHEN holds THEN 'always_true' ELSE 'always_false' END AS verdict, 'static' AS how, CAST(NULL AS DOUBLE) AS start_s, CAST(NULL AS DOUBLE) AS end_s FROM static
UNION ALL SELECT log, branch, verdict, 'dynamic', round(a / 1e6, 6), round(z / 1e6, 6) FROM dyn JOIN span USING (log, branch))
SELECT l.log, b.branch, coalesce(verdict, 'unknown') AS verdict, coalesce(how, 'none') AS how, start_s, end_s FROM l CROSS JOIN (VALUES {", ".join(f"('{b}')" for b, _ in BRANCHES)}) b(branch) LEFT JOIN told USING (log, branch)""")
def branch_verdicts(spark, d):
    """Verdicts of all branches: what constants fold is never looked for in samples."""
    return evaluate(spark, d).verdicts


@query(f"""WITH {LOGS}, p AS (SELECT *, lag(holds) OVER w AS was, max(us) OVER (PARTITION BY log, branch) AS z FROM h WINDOW w AS (PARTITION BY log, branch ORDER BY us)),
r AS (SELECT *, coalesce(lead(us) OVER (PARTITION BY log, branch ORDER BY us), z) AS until FROM p WHERE was IS NULL OR was <> holds)
SELECT log, branch, round(us / 1e6, 6) AS start_s, round(until / 1e6, 6) AS end_s FROM r WHERE holds""")
def branch_windows(spark, d):
    """When the branches that samples decide hold."""
    return evaluate(spark, d).windows


@query(f"""WITH {LOGS}, v AS (SELECT log, branch, holds FROM static UNION ALL SELECT log, branch, verdict = 'always_true' FROM dyn WHERE verdict <> 'unknown')
SELECT log, o.operation FROM (VALUES {", ".join(f"('{o}', '{b}')" for o, b in CONTROLS)}) o(operation, branch) JOIN v USING (branch) WHERE NOT holds""")
def dead_operations(spark, d):
    """Operations that can't run."""
    return evaluate(spark, d).dead


@query(f"""WITH {LOGS}, t AS (SELECT user_id AS log, epoch_us(ts) AS ts_us, event_id AS seq, value AS v FROM events WHERE user_id IS NOT NULL AND event_type = 'purchase'),
p AS (SELECT *, lag(holds) OVER w AS was, max(us) OVER (PARTITION BY log, branch) AS z FROM h WINDOW w AS (PARTITION BY log, branch ORDER BY us)),
r AS (SELECT *, coalesce(lead(us) OVER (PARTITION BY log, branch ORDER BY us), z) AS until FROM p WHERE was IS NULL OR was <> holds),
win AS (SELECT log, branch, us AS a, max(until) OVER (PARTITION BY log, branch ORDER BY us) AS b FROM r WHERE holds),
o AS (SELECT t.*, d.branch, CASE d.verdict WHEN 'always_true' THEN true WHEN 'always_false' THEN false ELSE CASE WHEN w.b >= ts_us THEN true WHEN ts_us BETWEEN g.a AND g.z THEN false END END AS on_
  FROM t JOIN dyn d USING (log) JOIN span g USING (log, branch) ASOF LEFT JOIN win w ON t.log = w.log AND d.branch = w.branch AND t.ts_us >= w.a WHERE d.branch IN ('high', 'wide')),
m AS (SELECT t.log, t.ts_us, t.seq, t.v, (SELECT holds FROM static WHERE branch = 'mode' AND log = t.log) AS mode, max(on_) FILTER (branch = 'high') AS high, max(on_) FILTER (branch = 'wide') AS wide FROM t LEFT JOIN o USING (log, seq) GROUP BY ALL),
q AS (SELECT *, mode AND high AS a, wide AND NOT mode AS b FROM m)
SELECT log, seq, CASE WHEN a IS NULL OR b IS NULL THEN 'unresolved' WHEN a OR b THEN 'value' ELSE 'inactive' END AS status, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a THEN v + 1 WHEN b THEN v * 2 END AS value FROM q""")
def decision_windows(spark, d):
    """A decision graph over purchases, with branches that are folded or looked up in their windows."""
    found = evaluate(spark, d)
    t = event_samples(spark, d).filter("field = 'purchase' and multi_id is not null").select(F.col("multi_id").alias("log"), "ts_us", "seq", "v")
    g = graph.DecisionGraph({}, {"up": ("v + 1", ["mode", "high"]), "double": ("v * 2", ["wide", "plain"])}, {"mode": "MODE == 1", "high": "click > LIMIT", "wide": "click >= view", "plain": "!mode_on"}, evaluated=["mode", "high", "wide"])
    rows = feasibility.states_at(t, found, ["mode", "high", "wide"]).withColumn("mode_on", F.col("branch_mode").cast("double"))
    return g.evaluate(rows, ["v", "mode_on"]).select("log", "seq", "status", "value")
