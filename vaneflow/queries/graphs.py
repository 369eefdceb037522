"""Closures, producers and decisions over time."""

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import graph
from ..sources.tables import event_samples, table
from . import query
from .alignment import UT, timeline
from .signals import S


def edges(spark, d):
    """Customers lead to nations, nations to regions, suppliers to nations."""
    n = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = table(spark, d, "customer").select(n("c", "c_custkey").alias("src"), n("n", "c_nationkey").alias("dst"))
    b = table(spark, d, "nation").select(n("n", "n_nationkey").alias("src"), n("r", "n_regionkey").alias("dst"))
    return a.unionByName(b).unionByName(table(spark, d, "supplier").select(n("s", "s_suppkey").alias("src"), n("n", "s_nationkey").alias("dst")))


ED = "e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


def seeds(spark, d):
    return table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("seed")).withColumn("node", F.col("seed"))


@query(f"WITH RECURSIVE {ED}, r(seed, node, depth) AS (SELECT 'c' || c_custkey, 'c' || c_custkey, 0 FROM customer UNION SELECT r.seed, e.dst, r.depth + 1 FROM r JOIN e ON r.node = e.src) SELECT seed, node, min(depth) AS depth FROM r GROUP BY ALL")
def reachability_closure(spark, d):
    return graph.closure(edges(spark, d), seeds(spark, d))


@query(f"WITH {ED} SELECT 'c' || c_custkey AS seed, 'r' || n_regionkey AS leaf FROM customer JOIN nation ON c_nationkey = n_nationkey")
def leaf_dependencies(spark, d):
    return graph.leaves(edges(spark, d), seeds(spark, d))


@query("SELECT 'c' || c_custkey AS node FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0 UNION SELECT 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 0 UNION SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey <> 0")
def unreachable_nodes(spark, d):
    e = edges(spark, d)
    return graph.unreachable(e.select(F.col("src").alias("node")).distinct(), e, spark.createDataFrame([("r0",)], "node string"))


@query(f"WITH {ED}, t AS (SELECT 'r' || n_regionkey AS terminal, 'n' || n_nationkey AS n FROM nation) SELECT terminal, count(*) AS n FROM (SELECT terminal, src, dst FROM e JOIN t ON e.dst = t.n UNION ALL SELECT dst, src, dst FROM e WHERE dst LIKE 'r%') GROUP BY ALL")
def split_by_terminal(spark, d):
    t = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.split_by_terminal(edges(spark, d), t).groupBy("terminal").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS place, l_quantity AS v, CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS active FROM lineitem),
g AS (SELECT k, max([line, place]) FILTER (active) AS a, max([line, place]) FILTER (active IS NULL) AS o, arg_max(v, [line, place]) FILTER (active) AS v FROM w GROUP BY k)
SELECT k, CASE WHEN o IS NOT NULL AND (a IS NULL OR o > a) THEN 'unresolved' WHEN a IS NULL THEN 'inactive' ELSE 'value' END AS status, CASE WHEN NOT (o IS NOT NULL AND (a IS NULL OR o > a)) THEN v END AS value FROM g""")
def last_writer(spark, d):
    w = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("place"), F.col("l_quantity").alias("value"), F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "N", False).alias("active"))
    return graph.last_writer(w, "k")


@query(f"""{UT}, o AS (SELECT multi_id, ts_us, x > 50 AS a, y > 50 AS b, x + 1 AS p, y + 2 AS q FROM t)
SELECT multi_id, ts_us, CASE WHEN NOT a AND NOT b THEN 'inactive' WHEN a AND b AND p <> q THEN 'unresolved' ELSE 'value' END AS status, round(CASE WHEN a AND b THEN CASE WHEN p = q THEN p END WHEN a THEN p WHEN b THEN q END, 6) AS value FROM o""")
def decision_graph(spark, d):
    g = graph.DecisionGraph({"LIMIT": 50.0}, {"p": ("x + 1", ["high_x"]), "q": ("y + 2", ["high_y"])}, {"high_x": "x > LIMIT", "high_y": "y > LIMIT"})
    return g.evaluate(timeline(spark, d), ["x", "y"]).select("multi_id", "ts_us", "status", F.round("value", 6).alias("value"))


@query(f"""{UT}, m AS (SELECT multi_id, ts_us, x, CASE WHEN x > 50 THEN x - y ELSE x + y END AS mid FROM t), o AS (SELECT *, mid * 2 + 1 AS far FROM m)
SELECT multi_id, ts_us, CASE WHEN far > 20 THEN 'value' WHEN far IS NULL THEN 'unresolved' ELSE 'inactive' END AS status, CASE WHEN far > 20 THEN round(far + x, 6) END AS value FROM o""")
def decision_chain(spark, d):
    """Symbols that build on each other, and one that goes round in a circle, which nothing depends on."""
    symbols = {"far": {"f": ("mid * 2 + 1", [])}, "mid": {"m": ("x - y", ["high_x"]), "n": ("x + y", ["low_x"])}, "round": {"r": ("round + 1", [])}}
    g = graph.DecisionGraph({"LIMIT": 50.0}, {"p": ("far + x", ["wide"])}, {"high_x": "x > LIMIT", "low_x": "x <= LIMIT", "wide": "far > 20"}, symbols)
    return g.evaluate(timeline(spark, d), ["x", "y"]).select("multi_id", "ts_us", "status", F.round("value", 6).alias("value"))


@query(f"""{UT}, o AS (SELECT multi_id, ts_us, round(ts_us / 1e6, 6) AS s, 'high_x' AS branch, x > 50 AS c FROM t UNION ALL SELECT multi_id, ts_us, round(ts_us / 1e6, 6), 'high_y', y > 50 FROM t),
e AS (SELECT *, lag(c) OVER w AS p, max(s) OVER (PARTITION BY multi_id, branch) AS l FROM o WINDOW w AS (PARTITION BY multi_id, branch ORDER BY ts_us)), r AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY multi_id, branch ORDER BY ts_us), l) AS e FROM e WHERE p IS NULL OR p <> c)
SELECT multi_id, branch, s AS start_s, e AS end_s FROM r WHERE c""")
def feasible_windows(spark, d):
    g = graph.DecisionGraph({"LIMIT": 50.0}, {}, {"high_x": "x > LIMIT", "high_y": "y > LIMIT"})
    return g.feasible_windows(timeline(spark, d), ["x", "y"], "multi_id")


@query(f"""{UT}, c AS (SELECT multi_id, round(ts_us / 1e6, 6) AS s, ts_us, x + y > 90 AND x < 2 * y AS c FROM t), e AS (SELECT *, lag(c) OVER w AS p, max(s) OVER (PARTITION BY multi_id) AS l FROM c WINDOW w AS (PARTITION BY multi_id ORDER BY ts_us)),
r AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY multi_id ORDER BY ts_us), l) AS e FROM e WHERE p IS NULL OR p <> c), k AS (SELECT multi_id, s AS start_s, e AS end_s FROM r WHERE c),
i AS (SELECT *, CASE WHEN start_s <= max(end_s) OVER (PARTITION BY multi_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM k),
m AS (SELECT *, sum(n) OVER (PARTITION BY multi_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS g FROM i) SELECT multi_id, min(start_s) AS start_s, max(end_s) AS end_s FROM m GROUP BY multi_id, g""")
def questioned_condition(spark, d):
    return graph.condition_windows(timeline(spark, d), "x + y > TOTAL && x < 2 * y", {"x": F.col("x"), "y": F.col("y"), "TOTAL": 90.0}, "multi_id")


@query(f"""WITH {S}, a AS (SELECT multi_id, ts_us, seq, v FROM s WHERE field = 'click'), o AS (SELECT multi_id, ts_us, CASE WHEN seq % 10 = 0 THEN v + 5 ELSE v END AS r FROM a WHERE seq % 3 <> 0), j AS (SELECT a.*, r FROM a ASOF LEFT JOIN o ON a.multi_id = o.multi_id AND a.ts_us >= o.ts_us),
t AS (SELECT *, coalesce(lead(ts_us) OVER (PARTITION BY multi_id ORDER BY ts_us, seq) - ts_us, 0) AS d FROM j)
SELECT multi_id, count(*) AS n, round(max(abs(v - r)), 6) AS max_error, round(coalesce(sum(CASE WHEN abs(v - r) <= 0.5 THEN d ELSE 0 END) / nullif(CAST(sum(d) AS DOUBLE), 0), 0), 6) AS matched_share FROM t WHERE r IS NOT NULL GROUP BY ALL""")
def replay_match_fraction(spark, d):
    a = event_samples(spark, d).filter("field = 'click'").select("multi_id", "seq", "ts_us", "v")
    o = a.filter("seq % 3 <> 0").withColumn("v", F.when(F.col("seq") % 10 == 0, F.col("v") + 5).otherwise(F.col("v")))
    r = graph.replay(o, a, ["multi_id"], F.lit(0.5))
    return r.select("multi_id", "n", F.round("max_error", 6).alias("max_error"), F.round("matched_share", 6).alias("matched_share"))


@query("""SELECT p_partkey, p_partkey % 4 = 0 AS makes, CASE p_partkey % 4 WHEN 0 THEN 'a.b' WHEN 1 THEN 'x.q' WHEN 2 THEN 'state.v' ELSE 'm.n' END AS lossy FROM part""")
def symbol_rules(spark, d):
    pairs = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(r).alias("r")) for p, r in (("a->b", "a.b[2]"), ("_x::q[1]", "x.q"), ("&state.v[0]", "state.v[1]"), ("m.n", "m.n.o"))))
    t = table(spark, d, "part").withColumn("s", pairs[(F.col("p_partkey") % 4).cast("int")])
    return t.select("p_partkey", scalar.produces(F.col("s.p"), F.col("s.r")).alias("makes"), scalar.normalize_symbol(F.col("s.p")).alias("lossy"))


@query("""WITH k AS (SELECT DISTINCT n_name AS n, n_regionkey AS r FROM nation), p AS (SELECT DISTINCT p_size AS z FROM part),
x AS (SELECT '_at->' || n || '[0]' AS reference, 'at.' || n || '[0]' AS symbol, 'observed' AS status FROM k UNION ALL SELECT n, CASE WHEN r <> 2 THEN 'at.' || n || '[0]' END, CASE WHEN r = 2 THEN 'ambiguous' ELSE 'observed' END FROM k UNION ALL SELECT 'size' || z, NULL, 'unavailable' FROM p)
SELECT * FROM x""")
def name_resolution(spark, d):
    """Nations' names as symbols, which some objects share; references by spelling, by last part, and of nothing."""
    n = table(spark, d, "nation")
    at = lambda prefix: F.concat(F.lit(prefix), "n_name", F.lit("[0]"))
    b = n.select(at("at.").alias("symbol")).unionByName(n.filter("n_regionkey = 2").select(at("by.").alias("symbol")))
    sizes = table(spark, d, "part").select(F.concat(F.lit("size"), F.col("p_size").cast("string")).alias("reference"))
    return graph.resolve_names(n.select(at("_at->").alias("reference")).unionByName(n.select(F.col("n_name").alias("reference"))).unionByName(sizes), b)


@query("""WITH w AS (SELECT l_orderkey AS f, l_partkey AS s, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT DISTINCT l_orderkey AS f, l_partkey AS s FROM lineitem WHERE l_returnflag = 'R'),
x AS (SELECT DISTINCT w.f AS a, r.f AS b FROM w JOIN r ON w.s = r.s AND w.f <> r.f), e AS (SELECT a, b FROM x UNION SELECT b, a FROM x), k AS (SELECT 7 AS f, 0 AS d UNION SELECT b, 1 FROM e WHERE a = 7)
SELECT w.f AS file, s AS symbol, CAST(min(d) AS INT) AS distance, max(n) AS n_writes FROM w JOIN k ON w.f = k.f GROUP BY ALL""")
def source_survey(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("symbol"), "l_returnflag")
    return graph.survey(li.drop("l_returnflag"), li.filter("l_returnflag = 'R'").drop("l_returnflag").distinct(), spark.createDataFrame([(7,)], "file long"))
