"""Slices of assignments that the tables stand for: orders are written from customers, these from nations and suppliers, and so on."""

from pyspark.sql import functions as F

from ..operators import slices
from ..sources.tables import table
from . import query


def _named(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def assignments(spark, d):
    """(write_id, target, reads, conditions, external)."""
    strings = lambda *c: F.array(*c).cast("array<string>")

    def write(df, kind, target, reads, conditions=None, external=False):
        conditions = strings() if conditions is None else conditions
        return df.select(F.concat(F.lit(kind), target).alias("write_id"), target.alias("target"), reads.alias("reads"), conditions.alias("conditions"), F.lit(external).alias("external"))

    o, c, s, n = (table(spark, d, t) for t in ("orders", "customer", "supplier", "nation"))
    urgent = F.when(F.col("o_orderpriority") < "3", F.array("o_orderpriority")).otherwise(strings())
    k, nation = _named("c", "c_custkey"), _named("n", "c_nationkey")
    third, twice = F.col("c_custkey") % 3, F.col("c_custkey") % 7 == 0
    parts = [
        write(o, "a", _named("o", "o_orderkey"), F.array(_named("c", "o_custkey")), urgent),
        write(c.filter(third == 0), "a", k, F.array(nation), F.array("c_mktsegment")),
        write(c.filter(third == 0), "b", k, F.array(F.concat(F.lit("s"), (F.col("c_custkey") % 10 + 1).cast("string"))), strings(F.lit("poor"))),
        write(c.filter(third == 1), "a", k, F.array(nation, F.lit("k1"))),
        write(c.filter(third == 2), "a", k, F.array(nation)),
        write(c.filter((third == 2) & twice), "b", k, F.array(F.lit("k1"))),
        write(s, "a", _named("s", "s_suppkey"), F.array(_named("n", "s_nationkey")), F.when(F.col("s_suppkey") % 2 == 0, strings(F.lit("supplied"))).otherwise(strings())),
        write(n.filter("n_nationkey % 5 != 4"), "a", _named("n", "n_nationkey"), F.array(_named("r", "n_regionkey"))),
        write(n.filter("n_nationkey % 5 = 4"), "a", _named("n", "n_nationkey"), F.array(F.concat(F.lit("n"), ((F.col("n_nationkey") + 1) % 25).cast("string")))),
        write(n.filter("n_regionkey = 1"), "b", F.lit("r1"), F.array(_named("n", "n_nationkey")), F.array("n_name")),
        write(n.filter("n_nationkey = 0"), "b", F.lit("r4"), strings(F.lit("r0")), None, True),
        write(n.filter("n_nationkey = 3"), "b", F.lit("r2"), F.array(F.lit("n3"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def known(spark, d):
    return table(spark, d, "region").filter("r_regionkey in (0, 3)").select(_named("r", "r_regionkey").alias("symbol")).unionByName(table(spark, d, "region").filter("r_regionkey = 0").select(F.lit("k1").alias("symbol")))


WRITES = """w AS (SELECT 'o' || o_orderkey AS target, ['c' || o_custkey] AS reads, CASE WHEN o_orderpriority < '3' THEN [o_orderpriority] ELSE [] END AS conditions, false AS external FROM orders
UNION ALL SELECT 'c' || c_custkey, ['n' || c_nationkey], [c_mktsegment], false FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'c' || c_custkey, ['s' || (c_custkey % 10 + 1)], ['poor'], false FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'c' || c_custkey, ['n' || c_nationkey, 'k1'], [], false FROM customer WHERE c_custkey % 3 = 1
UNION ALL SELECT 'c' || c_custkey, ['n' || c_nationkey], [], false FROM customer WHERE c_custkey % 3 = 2
UNION ALL SELECT 'c' || c_custkey, ['k1'], [], false FROM customer WHERE c_custkey % 3 = 2 AND c_custkey % 7 = 0
UNION ALL SELECT 's' || s_suppkey, ['n' || s_nationkey], CASE WHEN s_suppkey % 2 = 0 THEN ['supplied'] ELSE [] END, false FROM supplier
UNION ALL SELECT 'n' || n_nationkey, [CASE WHEN n_nationkey % 5 <> 4 THEN 'r' || n_regionkey ELSE 'n' || ((n_nationkey + 1) % 25) END], [], false FROM nation
UNION ALL SELECT 'r1', ['n' || n_nationkey], [n_name], false FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'r4', ['r0'], [], true UNION ALL SELECT 'r2', ['n3'], [], false),
known AS (SELECT * FROM (VALUES ('r0'), ('r3'), ('k1')) t(symbol))"""


@query(f"""WITH RECURSIVE {WRITES}, e AS (SELECT DISTINCT target, unnest(reads) AS read, conditions FROM w),
r(seed, symbol, conds, path) AS (SELECT 'o' || o_orderkey, 'o' || o_orderkey, CAST([] AS VARCHAR[]), ['o' || o_orderkey] FROM orders
  UNION ALL SELECT seed, read, list_sort(list_distinct(list_concat(conds, conditions))), list_append(path, read) FROM r JOIN e ON symbol = target WHERE NOT list_contains(path, read) AND symbol NOT IN (FROM known)),
f AS (SELECT DISTINCT seed, symbol, conds FROM r)
SELECT seed, symbol, array_to_string(conds, ' & ') AS conditions FROM f x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE x.seed = y.seed AND x.symbol = y.symbol AND len(y.conds) < len(x.conds) AND list_has_all(x.conds, y.conds))""")
def conditional_slices(spark, d):
    """What every order depends on, and under which conditions."""
    seeds = table(spark, d, "orders").select(_named("o", "o_orderkey").alias("seed"), _named("o", "o_orderkey").alias("symbol"))
    return slices.conditional_reach(assignments(spark, d), known(spark, d), seeds).select("seed", "symbol", F.array_join("conditions", " & ").alias("conditions"))


def _settle(k: int, stuck: bool) -> str:
    """A round: of writes whose reads have all settled, and of symbols all of whose writes are such; stuck: conditional ones with others."""
    return f"""
v{k} AS (SELECT o.target, plain, external, (SELECT count(*) FROM unnest(o.reads) t(x) LEFT JOIN p{k} ON symbol = x WHERE status IS NULL) AS left_, (SELECT count(*) FROM unnest(o.reads) t(x) JOIN p{k} ON symbol = x WHERE status <> 'resolved') AS bad
  FROM o WHERE target NOT IN (SELECT symbol FROM p{k})),
u{k} AS (SELECT target, any_value(plain) AS plain, bool_or(external) AS external, bool_and(left_ = 0) AS done, bool_or(left_ = 0 AND bad = 0 AND NOT external) AS fine FROM v{k} GROUP BY target),
p{k + 1} AS (SELECT * FROM p{k} UNION ALL SELECT target, CASE WHEN NOT fine THEN 'unbindable' WHEN plain THEN 'resolved' ELSE 'conditional' END,
  CASE WHEN fine THEN NULL WHEN NOT plain THEN 'ambiguous_writes' WHEN external THEN 'external_call' ELSE 'unsupported_rhs' END FROM u{k} WHERE done{" OR NOT plain" if stuck else ""}),"""


ROUNDS = [False] * 8 + [True] + [False] * 4


@query(f"""WITH {WRITES}, g AS (SELECT target, count(*) AS n, count(DISTINCT conditions) AS ways, min(len(conditions)) AS least FROM w WHERE target NOT IN (FROM known) GROUP BY target),
o AS (SELECT w.*, n = 1 AND least = 0 AS plain FROM w JOIN g USING (target) WHERE n = 1 OR (ways = n AND least > 0)),
p0 AS (SELECT symbol, 'resolved' AS status, CAST(NULL AS VARCHAR) AS blocker FROM known UNION ALL SELECT DISTINCT x, 'unbindable', 'no_write_site' FROM (SELECT unnest(reads) AS x FROM w) WHERE x NOT IN (FROM known) AND x NOT IN (SELECT target FROM w)
  UNION ALL SELECT target, 'unbindable', 'ambiguous_writes' FROM g WHERE NOT (n = 1 OR (ways = n AND least > 0))),{"".join(_settle(k, s) for k, s in enumerate(ROUNDS))}
z AS (SELECT 1)
SELECT symbol, status, blocker FROM p{len(ROUNDS)} UNION ALL SELECT DISTINCT target, 'cycle', 'cycle' FROM o WHERE target NOT IN (SELECT symbol FROM p{len(ROUNDS)})""")
def slice_statuses(spark, d):
    """Which symbols can be bound."""
    return slices.slices(assignments(spark, d), known(spark, d)).drop("expression")


@query("""WITH a AS (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS top FROM supplier),
x AS (SELECT DISTINCT top, o_custkey, c_nationkey FROM lineitem JOIN a ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT DISTINCT 's' || s_suppkey AS seed, 'n' || c_nationkey || '.q' AS sink FROM a JOIN x USING (top)""")
def forward_sinks(spark, d):
    """Where suppliers' quantities end up, suppliers of one nation being names of one object."""
    li, o, c, s = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    q = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"), F.lit(".q"))
    steps = [(li, q("s", "l_suppkey"), q("o", "l_orderkey")), (o, q("o", "o_orderkey"), q("c", "o_custkey")), (c, q("c", "c_custkey"), q("n", "c_nationkey"))]
    edges = None
    for df, a, b in steps:
        one = df.select(a.alias("reads"), b.alias("writes")).distinct()
        edges = one if edges is None else edges.unionByName(one)
    from pyspark.sql import Window

    after = F.lag("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    pairs = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("a"), F.concat(F.lit("s"), after.cast("string")).alias("b")).filter("b is not null")
    seeds = s.select(_named("s", "s_suppkey").alias("seed"), q("s", "s_suppkey").alias("symbol"))
    return slices.forward_sinks(edges, seeds, pairs)
