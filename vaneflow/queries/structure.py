"""Classes, files and parameters of a source, as the tables stand for them."""

from pyspark.sql import functions as F

from ..operators import gate, lineage
from ..sources.tables import table
from . import query


def _named(prefix, column):
    c = F.col(column) if isinstance(column, str) else column
    return F.concat(F.lit(prefix), c.cast("string"))


def class_bases(spark, d):
    """A supplier's class inherits from that of half its number, and every fourth from that of a third as well."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    half, third = F.floor(F.col("k") / 2), F.floor(F.col("k") / 3)
    return s.filter("k > 1").select(_named("s", "k").alias("class"), _named("s", half).alias("base")).unionByName(s.filter("k % 4 = 0").select(_named("s", "k").alias("class"), _named("s", third).alias("base")))


BASES = "b AS (SELECT s_suppkey AS c, s_suppkey // 2 AS p FROM supplier WHERE s_suppkey > 1 UNION SELECT s_suppkey, s_suppkey // 3 FROM supplier WHERE s_suppkey % 4 = 0)"


@query(f"""WITH RECURSIVE {BASES}, q AS (SELECT DISTINCT o_custkey % 97 + 1 AS c, o_orderkey % 60 AS m FROM orders), l(c, a, d) AS (SELECT DISTINCT c, c, 0 FROM q UNION SELECT l.c, b.p, l.d + 1 FROM l JOIN b ON l.a = b.c),
n AS (SELECT c, a, min(d) AS d FROM l GROUP BY ALL), f AS (SELECT p_partkey % 97 + 1 AS a, p_size AS m, count(*) AS n FROM part GROUP BY ALL),
h AS (SELECT q.c, q.m, n.d, sum(f.n) AS n, any_value(n.a) AS a FROM q JOIN n ON q.c = n.c JOIN f ON n.a = f.a AND q.m = f.m GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY c, m ORDER BY d) AS r FROM h)
SELECT 's' || q.c AS class, 'm' || q.m AS member, CASE WHEN n = 1 THEN 's' || a END AS owner, CAST(d AS INT) AS distance, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'exact' ELSE 'ambiguous' END AS status FROM q LEFT JOIN k ON q.c = k.c AND q.m = k.m AND r = 1""")
def member_resolution(spark, d):
    """Members that orders refer to, found in the lineage of their classes."""
    definitions = table(spark, d, "part").select(_named("s", F.col("p_partkey") % 97 + 1).alias("class"), _named("m", "p_size").alias("member"))
    references = table(spark, d, "orders").select(_named("s", F.col("o_custkey") % 97 + 1).alias("class"), _named("m", F.col("o_orderkey") % 60).alias("member"))
    return lineage.resolve_members(references, class_bases(spark, d), definitions)


def _files(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    uses = li.select(_named("o", "l_orderkey").alias("file"), _named("p", "l_partkey").alias("symbol"))
    defines = li.filter("l_linenumber = 1 and l_returnflag = 'R'").select(_named("o", "l_orderkey").alias("file"), _named("p", "l_partkey").alias("symbol"))
    return o.filter("o_orderstatus = 'P' and o_orderpriority < '2'").select(_named("o", "o_orderkey").alias("file")), uses, defines


FILES = """d AS (SELECT l_partkey AS s, min(l_orderkey) AS f, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R' GROUP BY ALL), e AS (SELECT DISTINCT l_orderkey AS a, f AS b FROM lineitem JOIN d ON l_partkey = s WHERE n = 1),
r(f) AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority < '2' UNION SELECT e.b FROM r JOIN e ON r.f = e.a)"""


@query(f"WITH RECURSIVE {FILES} SELECT 'o' || f AS file FROM r")
def admitted_files(spark, d):
    """Files let in one after the other, each because it alone defines what those before refer to."""
    return lineage.expand(*_files(spark, d))[0].select("file")


@query(f"""WITH RECURSIVE {FILES}, u AS (SELECT DISTINCT l_partkey AS s FROM lineitem JOIN r ON l_orderkey = r.f)
SELECT 'p' || u.s AS symbol, CASE WHEN n = 1 THEN 'admitted' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status, CASE WHEN n = 1 THEN 'o' || d.f END AS file FROM u LEFT JOIN d ON u.s = d.s""")
def expanded_references(spark, d):
    return lineage.expand(*_files(spark, d))[1]


@query("""WITH n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 <> 4 THEN '( r' || n_regionkey || ' )' END AS x FROM nation), c AS (SELECT c_custkey AS k, '( ' || n.x || ' + k1 )' AS x FROM customer JOIN n ON c_nationkey = n.k)
SELECT 'o' || o_orderkey AS root, '( ' || c.x || ' * 2 )' AS expression FROM orders LEFT JOIN c ON o_custkey = c.k""")
def grounded_expressions(spark, d):
    """What orders are written from, spelt out; nations of two producers leave it open."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    tokens = lambda *parts: F.array(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    made = [(o, _named("o", "o_orderkey"), tokens(_named("c", "o_custkey"), "*", "2")), (c, _named("c", "c_custkey"), tokens(_named("n", "c_nationkey"), "+", "k1")), (n, _named("n", "n_nationkey"), tokens(_named("r", "n_regionkey"))), (n.filter("n_nationkey % 5 = 4"), _named("n", "n_nationkey"), tokens("k1"))]
    producers = None
    for df, symbol, parts in made:
        one = df.select(symbol.alias("symbol"), parts.alias("tokens"))
        producers = one if producers is None else producers.unionByName(one)
    return lineage.ground(producers, o.select(_named("o", "o_orderkey").alias("root"), _named("o", "o_orderkey").alias("symbol")))


def _predicates(spark, d):
    p = table(spark, d, "part")
    op = F.element_at(F.array(*map(F.lit, (">", ">=", "<", "<=", "==", "!="))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.select(_named("b", F.col("p_partkey") % 150).alias("branch"), _named("P", F.col("p_partkey") % 5).alias("name"), op.alias("op"), F.col("p_size").cast("double").alias("value"), F.when(F.col("p_partkey") % 3 == 0, "if (x)").alias("predicate"))


def _values(spark, d):
    u = table(spark, d, "events").select(F.col("user_id").alias("log")).filter("log is not null").distinct()
    names = F.array(*(F.struct(F.lit(f"P{i}").alias("name"), (F.col("log") * (i + 1) % 50).cast("double").alias("v")) for i in range(4)))
    return u.select("log", F.inline(names)), u


P = """p AS (SELECT 'b' || (p_partkey % 150) AS branch, 'P' || (p_partkey % 5) AS name, (['>', '>=', '<', '<=', '==', '!='])[p_partkey % 6 + 1] AS op, CAST(p_size AS DOUBLE) AS value, CASE WHEN p_partkey % 3 = 0 THEN 'if (x)' END AS predicate FROM part),
u AS (SELECT DISTINCT user_id AS log FROM events WHERE user_id IS NOT NULL), v AS (SELECT log, 'P' || i AS name, CAST(log * (i + 1) % 50 AS DOUBLE) AS v FROM u, range(4) r(i)),
a AS (SELECT branch, name, max(value) FILTER (op IN ('>', '>=', '==')) AS low, min(value) FILTER (op IN ('<', '<=', '==')) AS high, list(value) FILTER (op = '!=') AS barred, list(value) FILTER (op = '>') AS above, list(value) FILTER (op = '<') AS below FROM p GROUP BY ALL),
e AS (SELECT *, coalesce(list_contains(above, low), false) AS low_open, coalesce(list_contains(below, high), false) AS high_open FROM a),
f AS (SELECT *, CASE WHEN low IS NULL OR high IS NULL THEN true ELSE low < high OR (low = high AND NOT low_open AND NOT high_open AND NOT coalesce(list_contains(barred, low), false)) END AS satisfiable FROM e)"""


@query(f"WITH {P} SELECT branch, name, low, low_open, high, high_open, coalesce(array_to_string(list_sort(list_distinct(list_transform(barred, lambda x: CAST(x AS INT)))), ','), '') AS barred, satisfiable FROM f")
def parameter_bounds(spark, d):
    """What a branch's predicates allow a parameter; some allow nothing."""
    return gate.envelopes(_predicates(spark, d)).withColumn("barred", F.array_join(F.transform("barred", lambda x: x.cast("int").cast("string")), ","))


@query(f"""WITH {P}, never AS (SELECT branch, string_agg(name, ',' ORDER BY name) AS names FROM f WHERE NOT satisfiable GROUP BY branch), n AS (SELECT branch, count(*) AS n FROM f GROUP BY branch),
m AS (SELECT log, f.branch, name, (low IS NULL OR v > low OR (v = low AND NOT low_open)) AND (high IS NULL OR v < high OR (v = high AND NOT high_open)) AND NOT coalesce(list_contains(barred, v), false) AS ok FROM f JOIN v USING (name) WHERE f.branch NOT IN (SELECT branch FROM never)),
g AS (SELECT log, branch, count(*) AS seen, bool_and(ok) AS good, string_agg(name, ',' ORDER BY name) FILTER (NOT ok) AS bad FROM m GROUP BY ALL)
SELECT u.log, n.branch, CASE WHEN names IS NOT NULL OR NOT good THEN false WHEN seen = n THEN true END AS feasible, coalesce(names, bad, '') AS contradicted FROM u CROSS JOIN n LEFT JOIN never USING (branch) LEFT JOIN g ON u.log = g.log AND n.branch = g.branch""")
def parameter_gate(spark, d):
    """Branches that a log's parameters rule out; those that nothing satisfies are never compared."""
    values, logs = _values(spark, d)
    return gate.gate(gate.envelopes(_predicates(spark, d)), values, logs).withColumn("contradicted", F.array_join("contradicted", ","))


@query(f"""WITH {P}, t AS (SELECT p.*, log, v FROM p LEFT JOIN v USING (name)), c AS (SELECT *, CASE op WHEN '>' THEN v > value WHEN '>=' THEN v >= value WHEN '<' THEN v < value WHEN '<=' THEN v <= value WHEN '==' THEN v = value ELSE v <> value END AS ok FROM t)
SELECT branch, name, CASE WHEN predicate IS NOT NULL THEN 'branch_selector' ELSE 'unknown' END AS role, CASE WHEN v IS NULL THEN 'unknown' WHEN predicate IS NULL THEN 'verification_required' WHEN ok THEN 'satisfied' ELSE 'contradicted' END AS result, count(*) AS n FROM c GROUP BY ALL""")
def parameter_requirements(spark, d):
    """Predicates one by one, in every log, counted."""
    return gate.requirement_counts(_predicates(spark, d), _values(spark, d)[0])


@query(f"""WITH RECURSIVE {BASES}, t AS (SELECT c_custkey AS k, 'v' || (c_custkey % 40) AS terminal, CASE WHEN c_custkey % 3 = 1 THEN c_custkey % 97 + 1 END AS c, CASE WHEN c_custkey % 3 = 2 THEN 'f' || (c_nationkey % 12) END AS file FROM customer),
tt AS (SELECT DISTINCT terminal, c, file FROM t), w AS (SELECT 'v' || (p_partkey % 45) AS s, 'f' || (p_size % 12) AS f, p_partkey % 97 + 1 AS o, CASE WHEN p_size % 2 = 0 THEN 'i' || (p_partkey % 45 % 5 * p_size % 3) END AS id, p_partkey % 45 % 4 = 0 AS pub FROM part WHERE p_partkey % 45 <> 7),
l(c, a) AS (SELECT DISTINCT c, c FROM tt WHERE c IS NOT NULL UNION SELECT l.c, b.p FROM l JOIN b ON l.a = b.c),
z AS (SELECT *, CAST(substr(terminal, 2) AS INT) % 4 = 0 AS logged FROM tt), h AS (SELECT z.*, w.* FROM z JOIN w ON z.terminal = w.s AND w.pub = z.logged),
n AS (SELECT terminal, c, file, count(*) AS n FROM h GROUP BY ALL), fc AS (SELECT terminal, c, file, f, count(*) AS n FROM h GROUP BY ALL),
kin AS (SELECT DISTINCT h.terminal, h.c, h.f FROM h WHERE h.file IS NULL AND EXISTS (SELECT 1 FROM l WHERE l.c = h.c AND l.a = h.o)),
top AS (SELECT terminal, c, arg_min(f, (-n, f)) AS spot FROM kin JOIN fc USING (terminal, c, f) WHERE fc.file IS NULL GROUP BY ALL),
s AS (SELECT h.*, coalesce(h.file, top.spot) AS spot FROM h LEFT JOIN top ON h.terminal = top.terminal AND h.c = top.c AND h.file IS NULL WHERE top.spot IS NULL OR EXISTS (SELECT 1 FROM kin WHERE kin.terminal = h.terminal AND kin.c = h.c AND kin.f = h.f)),
i AS (SELECT * FROM s WHERE spot IS NULL OR f = spot OR abs(CAST(substr(f, 2) AS INT) - CAST(substr(spot, 2) AS INT)) = 1),
g AS (SELECT terminal, c, file, count(DISTINCT id) AS ids, count(DISTINCT f) AS files, any_value(spot) AS spot FROM i GROUP BY ALL),
br AS (SELECT i.terminal, i.c, i.file, arg_min(i.f, (-fc.n, i.f)) AS best FROM i JOIN fc ON i.terminal = fc.terminal AND i.f = fc.f AND i.c IS NOT DISTINCT FROM fc.c AND i.file IS NOT DISTINCT FROM fc.file WHERE i.spot IS NOT NULL GROUP BY ALL),
o AS (SELECT z.terminal, z.c, z.file, CASE WHEN n.n IS NULL THEN 'absent' WHEN files IS NULL THEN 'absent_in_scope' WHEN ids = 1 OR (ids = 0 AND files = 1) THEN 'valid' ELSE 'ambiguous' END AS status, logged, coalesce(n.n, 0) AS n_writers, best
  FROM z LEFT JOIN n ON z.terminal = n.terminal AND z.c IS NOT DISTINCT FROM n.c AND z.file IS NOT DISTINCT FROM n.file LEFT JOIN g ON z.terminal = g.terminal AND z.c IS NOT DISTINCT FROM g.c AND z.file IS NOT DISTINCT FROM g.file LEFT JOIN br ON z.terminal = br.terminal AND z.c IS NOT DISTINCT FROM br.c AND z.file IS NOT DISTINCT FROM br.file)
SELECT terminal, 's' || c AS class, file, status, logged, n_writers, CASE WHEN status = 'valid' THEN best END AS resolved_file FROM o""")
def terminal_validation(spark, d):
    """Terminals of customers against parts as writers: by class, by file, or by neither."""
    c, p = table(spark, d, "customer"), table(spark, d, "part")
    k = F.col("c_custkey")
    t = c.select(_named("v", k % 40).alias("terminal"), F.when(k % 3 == 1, _named("s", k % 97 + 1)).alias("class"), F.when(k % 3 == 2, _named("f", F.col("c_nationkey") % 12)).alias("file"))
    pk = F.col("p_partkey")
    w = p.filter(pk % 45 != 7).select(_named("v", pk % 45).alias("symbol"), _named("f", F.col("p_size") % 12).alias("file"), _named("s", pk % 97 + 1).alias("owner"), F.when(F.col("p_size") % 2 == 0, _named("i", pk % 45 % 5 * F.col("p_size") % 3)).alias("identity"), (pk % 45 % 4 == 0).alias("published"))
    logged = c.select((k % 40).alias("n")).filter("n % 4 = 0").distinct().select(_named("v", "n").alias("symbol"))
    files = p.select((F.col("p_size") % 12).alias("n")).distinct()
    return lineage.validate_terminals(t, w, logged, class_bases(spark, d), files.select(_named("f", "n").alias("file"), _named("f", F.col("n") + 1).alias("includes")))
