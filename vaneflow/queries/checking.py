"""Checks, verdicts, parameters and messages."""

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import checks as C
from ..operators import parameters as P
from ..operators import verdict
from ..plans import verification
from ..schema import CHECKS
from ..sources.tables import event_samples, micros, table
from . import query

A, B = 1704500000.0, 1705500000.0


def samples(spark, d):
    """Each user is a log of their own."""
    return event_samples(spark, d).withColumns({"topic": F.concat(F.lit("user"), F.col("multi_id").cast("string")), "multi_id": F.lit(0).cast("long")})


def windows(spark):
    return spark.createDataFrame([("main", A, B, 0), ("bad", B, A, 1), ("late", 1706000000.0, 1706500000.0, 2)], "name string, start_s double, end_s double, position int")


def per_user(spark, d, type_, **operands):
    """The same check for every user with an id, the user's signal where an operand begins with a dot."""
    u = F.col("user_id").cast("string")
    of = {"check_id": F.concat(F.lit(f"{type_}_"), u), "type": F.lit(type_)} | {k: F.concat(F.lit("user"), u, F.lit(v)) if isinstance(v, str) and v.startswith(".") else F.lit(v) for k, v in operands.items()}
    users = table(spark, d, "events").select("user_id").filter("user_id is not null").distinct()
    return users.select(*(of.get(n, F.lit(None)).cast(CHECKS[n].dataType).alias(n) for n in CHECKS.names))


def run(spark, d, type_, **operands):
    return getattr(C, type_)(C.with_windows(per_user(spark, d, type_, **operands), windows(spark)), samples(spark, d)).select("check_id", "status", "actual")


W = f"w AS (SELECT user_id AS u, event_type AS f, event_id AS seq, epoch_us(ts) AS us, value AS v FROM events WHERE round(epoch_us(ts) / 1e6, 6) BETWEEN {A} AND {B}), u AS (SELECT DISTINCT user_id AS u FROM events WHERE user_id IS NOT NULL)"


def status(passed: str) -> str:
    return f"CASE WHEN ({passed}) IS NULL THEN 'unresolved' WHEN {passed} THEN 'passed' ELSE 'failed' END"


@query(f"WITH {W}, g AS (SELECT u, round(avg(v), 6) AS m FROM w WHERE f = 'click' GROUP BY u) SELECT 'threshold_' || u AS check_id, {status('m >= 45')} AS status, m AS actual FROM u LEFT JOIN g USING (u)")
def threshold_checks(spark, d):
    return run(spark, d, "threshold", signal=".click", metric="mean", op=">=", value=45.0)


@query(f"WITH {W}, g AS (SELECT u, round(median(v), 6) AS m FROM w WHERE f = 'view' GROUP BY u) SELECT 'threshold_' || u AS check_id, {status('m NOT BETWEEN 20 AND 60')} AS status, m AS actual FROM u LEFT JOIN g USING (u)")
def threshold_outside(spark, d):
    return run(spark, d, "threshold", signal=".view", metric="median", op="outside", lower=20.0, upper=60.0, window="main")


LAG = f"WITH {W}, q AS (SELECT u, us, seq, floor(v / 50) AS v FROM w WHERE f = 'click'), l AS (SELECT *, lag(v) OVER (PARTITION BY u ORDER BY us, seq) AS p FROM q)"


def coarse(spark, d):
    return samples(spark, d).withColumn("v", F.floor(F.col("v") / 50).cast("double"))


@query(f"{LAG}, g AS (SELECT u, coalesce(bool_or(p IS NOT NULL AND p <> v AND p = 0 AND v = 1), false) AS hit, count(*) FILTER (p IS NOT NULL AND p <> v) AS n FROM l GROUP BY u) SELECT 'transition_occurs_' || u AS check_id, {status('hit')} AS status, CAST(coalesce(n, 0) AS DOUBLE) AS actual FROM u LEFT JOIN g USING (u)")
def transition_checks(spark, d):
    c = C.with_windows(per_user(spark, d, "transition_occurs", signal=".click", from_value=0.0, to_value=1.0), windows(spark))
    return C.transition_occurs(c, coarse(spark, d)).select("check_id", "status", "actual")


@query(f"{LAG}, g AS (SELECT u, count(*) FILTER (p IS NOT NULL AND p <> v) AS n FROM l GROUP BY u) SELECT 'no_transition_' || u AS check_id, {status('n = 0')} AS status, CAST(coalesce(n, 0) AS DOUBLE) AS actual FROM u LEFT JOIN g USING (u)")
def no_transition_checks(spark, d):
    c = C.with_windows(per_user(spark, d, "no_transition", signal=".click"), windows(spark))
    return C.no_transition(c, coarse(spark, d)).select("check_id", "status", "actual")


@query(f"{LAG}, g AS (SELECT u, bool_or(v = 2) AS a, bool_and(v = 2) AS b, count(*) FILTER (v = 2) AS n FROM q GROUP BY u) SELECT 'state_equals_' || u AS check_id, {status('a')} AS any_status, {status('b')} AS all_status, CAST(coalesce(n, 0) AS DOUBLE) AS actual FROM u LEFT JOIN g USING (u)")
def state_equals_any_all(spark, d):
    one = lambda mode: C.state_equals(C.with_windows(per_user(spark, d, "state_equals", signal=".click", value=2.0, mode=mode), windows(spark)), coarse(spark, d))
    return one("any").select("check_id", F.col("status").alias("any_status"), "actual").join(one("all").select("check_id", F.col("status").alias("all_status")), "check_id")


@query(f"{LAG}, g AS (SELECT u, count(*) FILTER (v = 9) AS n FROM q GROUP BY u) SELECT 'state_not_equals_' || u AS check_id, {status('n = 0')} AS status, CAST(coalesce(n, 0) AS DOUBLE) AS actual FROM u LEFT JOIN g USING (u)")
def state_not_equals_checks(spark, d):
    c = C.with_windows(per_user(spark, d, "state_not_equals", signal=".click", value=9.0), windows(spark))
    return C.state_not_equals(c, coarse(spark, d)).select("check_id", "status", "actual")


ERR = f"""WITH {W}, a AS (SELECT * FROM w WHERE f = 'click'), b AS (SELECT * FROM w WHERE f = 'view'), p AS (SELECT a.*, b.us AS pt, b.v AS pv FROM a ASOF JOIN b ON a.u = b.u AND a.us >= b.us), n AS (SELECT p.*, b.us AS nt, b.v AS nv FROM p ASOF JOIN b ON p.u = b.u AND p.us <= b.us),
e AS (SELECT u, v - CASE WHEN pt = nt THEN pv ELSE pv + (us - pt) / CAST(nt - pt AS DOUBLE) * (nv - pv) END AS e FROM n), g AS (SELECT u, max(abs(e)) AS m, max(-e) AS b FROM e GROUP BY u)"""


@query(f"{ERR} SELECT 'tracks_setpoint_' || u AS check_id, {status('m <= 200')} AS status, round(m, 6) AS actual FROM u LEFT JOIN g USING (u)")
def tracks_setpoint(spark, d):
    return run(spark, d, "tracks_setpoint", actual=".click", setpoint=".view", max_error=200.0)


@query(f"{ERR} SELECT 'diverges_from_setpoint_' || u AS check_id, {status('b >= 50')} AS status, round(b, 6) AS actual FROM u LEFT JOIN g USING (u)")
def diverges_from_setpoint(spark, d):
    return run(spark, d, "diverges_from_setpoint", actual=".click", setpoint=".view", min_error=50.0, direction="below")


def delta(f: str) -> str:
    return f"SELECT u, count(*) AS n, arg_max(v, us) - arg_min(v, us) AS d FROM w WHERE f = '{f}' GROUP BY u"


@query(f"WITH {W}, g AS ({delta('click')}) SELECT 'monotonic_change_' || u AS check_id, {status('CASE WHEN n >= 2 THEN d <= -5 END')} AS status, round(d, 6) AS actual FROM u LEFT JOIN g USING (u)")
def monotonic_delta(spark, d):
    return run(spark, d, "monotonic_change", signal=".click", direction="decrease", min_delta=5.0)


@query(f"WITH {W}, g AS ({delta('click')}), h AS ({delta('view')}) SELECT 'same_direction_change_' || u AS check_id, {status('CASE WHEN g.n >= 2 AND h.n >= 2 THEN abs(g.d) >= 1 AND abs(h.d) >= 1 AND g.d * h.d > 0 END')} AS status, round(CASE WHEN g.n >= 2 THEN g.d END, 6) AS actual FROM u LEFT JOIN g USING (u) LEFT JOIN h USING (u)")
def same_direction(spark, d):
    return run(spark, d, "same_direction_change", first=".click", second=".view", min_delta=1.0)


def part_parameters(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("P_"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_retailprice").alias("v"))


@query("""SELECT 'c' || p_partkey AS check_id, CASE WHEN p_retailprice >= 1000 THEN 'passed' ELSE 'failed' END AS status, p_retailprice AS actual FROM part UNION ALL SELECT 'none', 'unresolved', NULL""")
def parameter_checks(spark, d):
    p = part_parameters(spark, d)
    null = {n: F.lit(None).cast(CHECKS[n].dataType) for n in CHECKS.names}
    c = p.select(F.concat(F.lit("c"), F.substring("name", 3, 20)).alias("check_id"), F.col("name").alias("parameter")).unionByName(spark.createDataFrame([("none", "P_none")], "check_id string, parameter string"))
    c = c.withColumns({k: v for k, v in null.items() if k not in ("check_id", "parameter")} | {"type": F.lit("branch_parameter_satisfied"), "source_predicate": F.lit("_param.get() >= 1000")})
    return C.branch_parameter_satisfied(c, p).select("check_id", "status", "actual")


@query("""SELECT 'c' || p_partkey AS check_id, CASE p_partkey % 7 WHEN 3 THEN 'unresolved' WHEN 6 THEN 'unresolved' WHEN 0 THEN CASE WHEN p_retailprice >= 1000 THEN 'passed' ELSE 'failed' END WHEN 1 THEN CASE WHEN p_retailprice < 950.5 THEN 'passed' ELSE 'failed' END WHEN 4 THEN CASE WHEN p_retailprice > 990 THEN 'passed' ELSE 'failed' END WHEN 5 THEN CASE WHEN p_retailprice <= 1200 THEN 'passed' ELSE 'failed' END ELSE CASE WHEN p_retailprice > -3 THEN 'passed' ELSE 'failed' END END AS status, p_retailprice AS actual FROM part""")
def parameter_predicates(spark, d):
    """Of a source predicate the comparison about the check's own parameter counts, wherever it stands."""
    p = part_parameters(spark, d)
    texts = F.array(F.lit("speed > 1 && _param.get() >= 1000"), F.concat(F.lit("(mode == 2 || "), "name", F.lit(" < 950.5f)")), F.concat(F.lit("ns::"), "name", F.lit(" > -3")), F.lit("speed > 1"), F.lit("_self->param.get() > 990"), F.concat(F.lit("(int)"), "name", F.lit(".get() <= static_cast<float>(1200)")), F.concat("name", F.lit("_LONGER == 1")))
    null = {n: F.lit(None).cast(CHECKS[n].dataType) for n in CHECKS.names}
    c = p.select("*", F.substring("name", 3, 20).alias("k")).select(F.concat(F.lit("c"), "k").alias("check_id"), F.col("name").alias("parameter"), texts[(F.col("k").cast("long") % 7).cast("int")].alias("source_predicate"))
    c = c.withColumns({k: v for k, v in null.items() if k not in c.columns} | {"type": F.lit("branch_parameter_satisfied")})
    return C.branch_parameter_satisfied(c, p).select("check_id", "status", "actual")


@query(f"WITH {W}, g AS (SELECT u, max(abs(v - 900.0)) AS m FROM w WHERE f = 'click' GROUP BY u) SELECT 'tracks_parameter_value_' || u AS check_id, {status('m <= 899')} AS status, round(m, 6) AS actual FROM u LEFT JOIN g USING (u)")
def tracks_parameter(spark, d):
    c = C.with_windows(per_user(spark, d, "tracks_parameter_value", signal=".click", parameter="P_0", max_error=899.0), windows(spark))
    return C.tracks_parameter_value(c, samples(spark, d), spark.createDataFrame([("P_0", 900.0)], "name string, v double")).select("check_id", "status", "actual")


@query("SELECT f AS check_id, CASE WHEN f IN (SELECT DISTINCT event_type FROM events) THEN 'passed' ELSE 'failed' END AS status FROM (VALUES ('click'), ('view'), ('absent')) t(f)")
def field_present_checks(spark, d):
    t = event_samples(spark, d).select("topic", "field").distinct().unionByName(spark.createDataFrame([("events", "timestamp")], "topic string, field string"))
    c = spark.createDataFrame([(f, "topic_field_present", f"events.{f}") for f in ("click", "view", "absent")], "check_id string, type string, signal string")
    return C.topic_field_present(c, t).select("check_id", "status")


@query(f"""WITH {W}, a AS (SELECT * FROM w WHERE f = 'click'), b AS (SELECT * FROM w WHERE f = 'view'), p AS (SELECT a.u, a.us, a.v, b.us AS pt, b.v AS pv FROM a ASOF LEFT JOIN b ON a.u = b.u AND a.us >= b.us), n AS (SELECT p.*, b.us AS nt, b.v AS nv FROM p ASOF LEFT JOIN b ON p.u = b.u AND p.us <= b.us),
y AS (SELECT u, v, coalesce(CASE WHEN pt = nt THEN pv ELSE pv + (us - pt) / CAST(nt - pt AS DOUBLE) * (nv - pv) END, pv, nv) AS y FROM n), g AS (SELECT u, bool_or(greatest(v, y) + 20 >= 110) AS hit, max(greatest(v, y) + 20) AS m FROM y WHERE y IS NOT NULL GROUP BY u)
SELECT 'derived_expression_' || u AS check_id, {status('hit')} AS status, round(m, 6) AS actual FROM u LEFT JOIN g USING (u)""")
def derived_expression_check(spark, d):
    """The expression over every user's signals, a check each."""
    of = lambda field: F.regexp_replace("signal", "click$", field)
    c = per_user(spark, d, "derived_expression", signal=".click", expression="max(x, y) + RTL_ALT", op=">=", value=110.0, mode="any", window="main")
    c = c.withColumn("variables", F.create_map(F.lit("x"), of("click"), F.lit("y"), of("view")))
    return C.derived_expressions(C.with_windows(c, windows(spark)), samples(spark, d), spark.createDataFrame([("RTL_ALT", 20.0)], "name string, v double")).select("check_id", "status", "actual")


# ---- verdicts, over lines of orders: an order is a mechanism, its lines' suppliers' parities branches, lines checks

R = "r AS (SELECT l_orderkey AS mechanism, l_suppkey % 2 AS branch, CASE WHEN l_returnflag = 'A' THEN 'failed' WHEN l_returnflag = 'N' THEN 'passed' ELSE 'unresolved' END AS status, CASE WHEN l_linenumber % 4 = 0 THEN 'branch_applicability' ELSE 'mechanism_defining' END AS role FROM lineitem)"
CL = """c AS (SELECT mechanism, branch, count(*) FILTER (role = 'mechanism_defining') AS nd, CASE WHEN coalesce(bool_or(role = 'branch_applicability' AND status = 'failed'), false) THEN 'excluded' WHEN bool_or(role = 'branch_applicability' AND status = 'unresolved') OR count(*) FILTER (role = 'mechanism_defining') = 0 OR bool_or(role = 'mechanism_defining' AND status = 'unresolved') THEN 'unresolved'
WHEN bool_or(role = 'mechanism_defining' AND status = 'passed') AND bool_or(role = 'mechanism_defining' AND status = 'failed') THEN 'mixed' WHEN bool_or(role = 'mechanism_defining' AND status = 'passed') THEN 'supported' WHEN bool_or(role = 'mechanism_defining' AND status = 'failed') THEN 'contradicted' ELSE 'unresolved' END AS verdict FROM r GROUP BY ALL)"""


def results(spark, d):
    t = table(spark, d, "lineitem")
    st = F.when(F.col("l_returnflag") == "A", "failed").when(F.col("l_returnflag") == "N", "passed").otherwise("unresolved")
    return t.select(F.col("l_orderkey").alias("mechanism"), (F.col("l_suppkey") % 2).alias("branch"), st.alias("status"), F.when(F.col("l_linenumber") % 4 == 0, "branch_applicability").otherwise("mechanism_defining").alias("role"))


@query(f"WITH {R}, {CL} SELECT mechanism, branch, verdict FROM c")
def verdict_check_lists(spark, d):
    return verdict.check_list(results(spark, d), "mechanism", "branch").select("mechanism", "branch", "verdict")


@query(f"""WITH {R}, {CL}, m AS (SELECT mechanism, bool_or(ok AND verdict = 'supported') AS s, bool_or(ok AND verdict IN ('contradicted', 'mixed')) AS cm, bool_or(ok AND verdict = 'mixed') AS m, bool_and(verdict = 'contradicted') FILTER (ok) AS c FROM (SELECT *, verdict <> 'excluded' AND nd > 0 AS ok FROM c) GROUP BY ALL)
SELECT mechanism, CASE WHEN s AND cm THEN 'mixed' WHEN s THEN 'supported' WHEN m THEN 'mixed' WHEN c THEN 'contradicted' ELSE 'unresolved' END AS verdict FROM m""")
def verdict_rollup(spark, d):
    b = verdict.branches(verdict.check_list(results(spark, d), "mechanism", "branch"), "mechanism", "branch")
    return verdict.mechanisms(b, "mechanism")


@query(f"""WITH {R}, g AS (SELECT mechanism, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'unresolved') AS unresolved FROM r GROUP BY ALL),
s AS (SELECT *, coalesce(round(CASE WHEN passed + failed > 0 THEN passed / CAST(passed + failed AS DOUBLE) END * CASE WHEN unresolved > 0 THEN greatest(0.5, 1 - unresolved * 0.1) ELSE 1 END, 6), 0) AS score FROM g)
SELECT *, CASE WHEN passed + failed = 0 THEN 'low' WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS confidence FROM s""")
def confidence_score(spark, d):
    return verdict.confidence(results(spark, d), "mechanism")


@query("""SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'contradicts' WHEN 'N' THEN CASE WHEN l_linestatus = 'F' THEN 'contradicts' ELSE 'supports' END END AS effect FROM lineitem""")
def claim_effects(spark, d):
    t = table(spark, d, "lineitem")
    st = F.when(F.col("l_returnflag") == "A", "failed").when(F.col("l_returnflag") == "N", "passed").otherwise("unresolved")
    f = F.col("l_linestatus") == "F"
    return t.select("l_orderkey", "l_linenumber", verdict.claim_effect(st, F.when(~f, "yes"), F.when(f, "no")).alias("effect"))


@query("""WITH g AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS n, min(o_orderstatus) AS s FROM orders GROUP BY ALL) SELECT o_custkey, CASE WHEN n = 1 AND s = 'F' THEN 'contradicted' WHEN n = 1 AND s = 'O' THEN 'supported' ELSE 'mixed' END AS verdict FROM g""")
def verdict_of_graphs(spark, d):
    v = F.when(F.col("o_orderstatus") == "F", "contradicted").when(F.col("o_orderstatus") == "O", "supported").otherwise("unresolved")
    return verdict.graphs(table(spark, d, "orders").select("o_custkey", v.alias("verdict")), "o_custkey")


@query("""WITH g AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS l FROM orders GROUP BY ALL), k AS (SELECT o_custkey, list_filter(l, lambda x: x <> 'P') AS l FROM g)
SELECT o_custkey, CASE WHEN len(l) = 0 THEN 'unresolved' WHEN len(l) = 1 THEN CASE l[1] WHEN 'F' THEN 'contradicted' ELSE 'supported' END ELSE 'mixed' END AS verdict, CASE WHEN len(l) = 1 AND l[1] = 'O' THEN 'high' WHEN len(l) = 1 THEN 'low' WHEN len(l) > 1 THEN 'medium' ELSE 'unresolved' END AS ceiling FROM k""")
def verdicts_combined(spark, d):
    v = F.when(F.col("o_orderstatus") == "F", "contradicted").when(F.col("o_orderstatus") == "O", "supported").otherwise("unresolved")
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(v).alias("vs")).withColumn("verdict", verdict.combine(F.col("vs")))
    return g.select("o_custkey", "verdict", verdict.ceiling(F.col("verdict"), F.lit(False), F.lit(False)).alias("ceiling"))


@query(f"""WITH {W}, c AS (SELECT u, round(avg(v), 6) AS m FROM w WHERE f = 'click' GROUP BY u), v AS ({delta('view')}), f AS (SELECT DISTINCT user_id AS u FROM events WHERE event_type = 'click'),
s AS (SELECT u.u, {status('m >= 45')} AS a, {status('CASE WHEN n >= 2 THEN d >= 0 END')} AS b, CASE WHEN f.u IS NULL THEN 'failed' ELSE 'passed' END AS p FROM u LEFT JOIN c USING (u) LEFT JOIN v USING (u) LEFT JOIN f ON u.u = f.u),
n AS (SELECT *, list_filter([a, b, p], lambda x: x = 'passed').len() AS passed, list_filter([a, b, p], lambda x: x = 'failed').len() AS failed, list_filter([a, b, p], lambda x: x = 'unresolved').len() AS unresolved, 'unresolved' IN (a, b) AS o FROM s),
d AS (SELECT *, CASE WHEN o THEN 'unresolved' WHEN a <> b THEN 'mixed' WHEN a = 'passed' THEN 'supported' ELSE 'contradicted' END AS verdict,
  coalesce(round(CASE WHEN passed + failed > 0 THEN passed / CAST(passed + failed AS DOUBLE) END * CASE WHEN unresolved > 0 THEN greatest(0.5, 1 - unresolved * 0.1) ELSE 1 END, 6), 0) AS score FROM n)
SELECT CAST(u AS VARCHAR) AS mechanism, verdict, CASE WHEN p = 'failed' THEN 'low' WHEN verdict = 'supported' THEN 'high' WHEN verdict = 'mixed' THEN 'medium' WHEN verdict = 'contradicted' THEN 'low' ELSE 'unresolved' END AS ceiling,
  CASE WHEN passed + failed = 0 THEN 'low' WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS confidence, score, passed, failed, unresolved FROM d""")
def verification_pipeline(spark, d):
    """Checks of every user as one mechanism each, from windows to verdict and confidence."""
    kinds = [per_user(spark, d, "threshold", signal=".click", metric="mean", op=">=", value=45.0), per_user(spark, d, "monotonic_change", signal=".view"), per_user(spark, d, "topic_field_present", signal=".click")]
    c = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    c = c.withColumns({"mechanism": F.regexp_extract("check_id", r"(\d+)$", 1), "branch_id": F.lit("b"), "window": F.lit("main")})
    t = samples(spark, d).select("topic", "field").distinct()
    topics = t.unionByName(t.select("topic", F.lit("timestamp").alias("field")).distinct())
    return verification.verify(c, windows(spark), samples(spark, d), spark.createDataFrame([], "name string, v double"), topics)


# ---- parameters and messages

@query("""SELECT 'S' || s_suppkey AS name, s_acctbal AS v, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal WHEN s_suppkey % 3 = 0 THEN 1.0 WHEN s_suppkey % 5 = 0 THEN 2.0 END AS default_v, CASE WHEN s_suppkey % 2 = 0 THEN 'airframe' WHEN s_suppkey % 3 = 0 THEN 'system' WHEN s_suppkey % 5 = 0 THEN 'metadata' ELSE 'none' END AS default_source,
CASE WHEN s_suppkey % 2 = 0 THEN 'default' WHEN s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 THEN 'non_default' ELSE 'unknown' END AS status, s_suppkey % 7 = 0 AS changed FROM supplier""")
def param_defaults_priority(spark, d):
    return defaults(spark, d)


def defaults(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_acctbal").alias("v"), F.col("s_suppkey").alias("k"))
    each = lambda n, v: s.filter(F.col("k") % n == 0).select("name", v.alias("v"))
    return P.with_defaults(s.drop("k"), each(2, F.col("v")), each(3, F.lit(1.0)), each(5, F.lit(2.0)), each(7, F.col("v")))


@query("""SELECT count(*) AS total, count(*) FILTER (s_suppkey % 2 <> 0 AND (s_suppkey % 3 = 0 OR s_suppkey % 5 = 0)) AS non_default, count(*) FILTER (s_suppkey % 2 <> 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0) AS unknown, count(*) FILTER (s_suppkey % 7 = 0) AS changed FROM supplier""")
def param_status_counts(spark, d):
    return P.status_counts(defaults(spark, d))


E_ = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARNING' ELSE 'INFO' END"


def log_messages(spark, d):
    e = table(spark, d, "events").withColumn("ts_us", micros(F.col("ts")))
    level = F.when(F.col("event_type") == "error", "3").when(F.col("event_type") == "view", "4").otherwise("6")
    text = F.concat(F.col("event_type"), F.when(F.col("event_id") % 10 == 0, "\t").otherwise(""))
    half = e.withColumns({"level": level, "message": text})
    return P.messages(half.filter("event_id % 2 = 1"), half.filter("event_id % 2 = 0"))


@query(f"SELECT epoch_us(ts) AS ts_us, {E_} AS level, event_type AS message, CASE WHEN event_id % 2 = 1 THEN 'event' ELSE 'logged_message' END AS source, round(epoch_us(ts) / 1e6, 6) AS time_s FROM events WHERE event_id % 10 <> 0")
def messages_union_levels(spark, d):
    return log_messages(spark, d)


@query("SELECT message, count(*) AS n FROM (SELECT event_type AS message FROM events WHERE event_id % 10 <> 0 AND event_type IN ('error', 'view') UNION ALL SELECT printf('dropout of %d ms', user_id) FROM events) GROUP BY ALL")
def warnings_with_dropouts(spark, d):
    drops = table(spark, d, "events").select(micros(F.col("ts")).alias("ts_us"), F.col("user_id").alias("duration_ms"))
    return P.warnings(log_messages(spark, d), drops).groupBy("message").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN event_id % 2 = 1 THEN 'event' ELSE 'logged_message' END AS source, count(*) FILTER (event_type = 'error') AS errors FROM events WHERE event_id % 10 <> 0 GROUP BY ALL")
def error_count(spark, d):
    return P.error_count(log_messages(spark, d), "source")


@query("""WITH t AS (SELECT DISTINCT user_id AS m, event_type AS f FROM events), r(signal, m, f) AS (VALUES ('events.click', NULL, 'click'), ('events[3].click', 3, 'click'), ('events[99999].click', 99999, 'click'), ('events.absent', NULL, 'absent')),
g AS (SELECT signal, count(*) AS n, min(t.m) AS m FROM r JOIN t ON r.f = t.f AND (r.m IS NULL OR r.m = t.m) GROUP BY ALL)
SELECT r.signal, CASE WHEN n = 1 THEN g.m ELSE -1 END AS multi_id, CASE WHEN n IS NULL THEN 'unavailable' WHEN n = 1 THEN 'observed' ELSE 'ambiguous' END AS status FROM r LEFT JOIN g USING (signal)""")
def resolve_signals(spark, d):
    refs = spark.createDataFrame([("events.click",), ("events[3].click",), ("events[99999].click",), ("events.absent",)], "signal string")
    return P.resolve(refs, event_samples(spark, d)).withColumn("multi_id", F.coalesce("multi_id", F.lit(-1)))


@query("SELECT user_id AS multi_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS fields, max(n) AS sample_count FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL")
def topic_instances(spark, d):
    from ..sources.tables import topic_catalogue

    return P.observed_instances(topic_catalogue(event_samples(spark, d))).select("multi_id", F.array_join("fields", ",").alias("fields"), "sample_count")


@query("""SELECT coalesce(a.t, b.t) AS topic, a.t IS NOT NULL AS is_available, a.t IS NOT NULL AS has_fields, b.t IS NOT NULL AS is_missing FROM (SELECT DISTINCT event_type AS t FROM events) a FULL JOIN (VALUES ('gone')) b(t) ON a.t = b.t""")
def topic_rows(spark, d):
    t = table(spark, d, "events").select(F.col("event_type").alias("topic")).distinct()
    return P.topic_rows(t, t, spark.createDataFrame([("gone",)], "topic string"))


@query("""SELECT coalesce(s.k, c.k) AS servo, kind, channels FROM (SELECT CAST(s_suppkey AS BIGINT) AS k, CAST(s_nationkey AS VARCHAR) AS kind FROM supplier) s FULL JOIN (SELECT c_custkey % 80 AS k, string_agg(c_custkey, ',' ORDER BY c_custkey) AS channels FROM customer GROUP BY ALL) c ON s.k = c.k""")
def actuator_mapping(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("servo"), F.col("s_nationkey").cast("string").alias("kind"))
    o = table(spark, d, "customer").select((F.col("c_custkey") % 80).alias("servo"), F.col("c_custkey").alias("channel"), F.col("c_name").alias("function"))
    return P.actuator_mapping(s, o).select("servo", "kind", F.array_join("channels", ",").alias("channels"))


@query("SELECT user_id, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS v, CASE WHEN count(DISTINCT value) = 1 THEN 'observed' ELSE 'unknown' END AS status FROM events GROUP BY ALL")
def sole_value(spark, d):
    return P.observed_kind(table(spark, d, "events").withColumn("v", F.col("value")), "user_id")


@query("SELECT p_partkey, printf('v%d.%d.%d', p_size, p_partkey % 256, 7) || CASE WHEN p_partkey % 256 < 64 THEN '-dev' WHEN p_partkey % 256 < 128 THEN '-alpha' WHEN p_partkey % 256 < 192 THEN '-beta' WHEN p_partkey % 256 < 255 THEN '-rc' ELSE '' END AS version FROM part")
def firmware_versions(spark, d):
    p = table(spark, d, "part")
    packed = F.shiftleft(F.col("p_size").cast("long"), 24) + (F.col("p_partkey") % 256) * 65536 + 7 * 256 + F.col("p_partkey") % 256
    return p.select("p_partkey", scalar.firmware_version(packed).alias("version"))


@query("SELECT 'events' AS topic, 'e[' || n || '].x' AS field, CAST(n AS INT) AS n FROM (SELECT DISTINCT user_id AS n FROM events)")
def indexed_fields(spark, d):
    e = table(spark, d, "events").select(F.lit("events").alias("topic"), F.concat(F.lit("e["), F.col("user_id").cast("string"), F.lit("].x")).alias("field"))
    return P.indexed_fields(e.unionByName(table(spark, d, "events").select(F.lit("events").alias("topic"), F.col("event_type").alias("field"))), "e", ".x")


@query("SELECT user_id AS log_id, CASE WHEN event_type = 'click' AND NOT bool_or(event_type = 'view') OVER (PARTITION BY user_id) THEN 'view' WHEN event_type = 'error' THEN 'fault' ELSE event_type END AS field, CAST(1 AS BIGINT) AS n FROM events")
def renamed_fields(spark, d):
    e = event_samples(spark, d).select(F.col("multi_id").alias("log_id"), "topic", "field", "seq")
    return P.renamed(e, {("events", "click"): "view", ("events", "error"): "fault"}).select("log_id", "field", F.lit(1).cast("long").alias("n"))


@query("WITH h AS (SELECT DISTINCT l_partkey AS dependency, l_orderkey AS input FROM lineitem) SELECT dependency, min(input) AS input FROM h GROUP BY dependency HAVING count(*) = 1")
def only_matches(spark, d):
    li = table(spark, d, "lineitem")
    return P.only_matches(li.select(F.col("l_partkey").alias("dependency")).distinct(), li.select(F.col("l_orderkey").alias("input"), F.array("l_partkey").alias("provenance")))


@query("""WITH m AS (SELECT o_orderkey AS c, count(l_orderkey) FILTER (l_partkey % 50 = 0) AS missing FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT o_orderkey AS candidate, CASE o_orderstatus WHEN 'F' THEN 'excluded' WHEN 'P' THEN 'unresolved' ELSE CASE WHEN missing > 0 THEN 'unresolved' ELSE 'supported' END END AS status FROM orders JOIN m ON o_orderkey = c""")
def candidate_applicability(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    holds = F.when(F.col("o_orderstatus") == "F", False).when(F.col("o_orderstatus") == "O", True)
    parts = li.select(F.col("l_partkey").alias("signal")).distinct()
    return P.applicability(o.select(F.col("o_orderkey").alias("candidate")), li.select(F.col("l_orderkey").alias("candidate"), F.col("l_partkey").alias("signal")), parts.filter("signal % 50 <> 0"), o.select(F.col("o_orderkey").alias("candidate"), holds.alias("holds")))
