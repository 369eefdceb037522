"""Candidates compiled to plans."""

import datetime as dt
from collections import Counter

import pytest

from vaneflow.plans import compile as plan
from vaneflow.queries import QUERIES, SQL
from vaneflow.schema import CHECKS


@pytest.mark.parametrize(
    "text, want",
    [("((a > 1))", ["a > 1"]), ("(a > 1) && (b  < 2 && c)", ["a > 1", "b < 2", "c"]), ("a || b && c", ["a || b && c"]), ("(a || b) && c", ["a || b", "c"]), ("(a) > (b)", ["(a) > (b)"]), ("", [""])],
)
def test_conjuncts(text, want):
    assert plan.conjuncts_of(text) == want


def branches(spark, rows):
    return spark.createDataFrame([("m", b, p) for b, p in rows], "mechanism string, branch_id string, predicates array<string>")


@pytest.mark.parametrize("n", [3, 12])
def test_disjunctions_stay_as_many_as_they_are(spark, n):
    """No branch for each choice, and a conjunct that branches share is one node."""
    texts = [f"x > {i} || y < {i}" for i in range(n)]
    nodes, uses = plan.factor(branches(spark, [("a", texts), ("b", [" && ".join(f"({t})" for t in texts)]), ("c", texts[:1])]))
    assert nodes.count() == n and uses.count() == 2 * n + 1 and nodes.filter("alternatives").count() == n


def test_branch_plans(spark):
    rows = [("both", ["x > 0", "y > 0"]), ("off", ["MODE == 2 && x > 0"]), ("on", ["MODE == 1"]), ("never", ["x > 50"]), ("lost", ["nothing > 1", "x > 0"]), ("shape", ["x + y > 1"]), ("choice", ["x > 50 || y > 50"]), ("none", []), ("apart", ["x > 0", "x <= 0"])]
    samples = [(1, "x", t * 1_000_000, t, float(v)) for t, v in enumerate([0, 1, 1, 0, 1, 1])] + [(1, "y", t * 1_000_000, 10 + t, float(v)) for t, v in ((0, 1), (2, 0), (4, 1), (5, 0))]
    args = [spark.createDataFrame([(1, "MODE", 1.0)], "log long, symbol string, v double"), spark.createDataFrame(samples, "log long, signal string, ts_us long, seq long, v double"), spark.createDataFrame([(1, 0.0, 5.5)], "log long, start_s double, end_s double")]
    plans, windows = plan.branch_plans(branches(spark, rows), *args)
    got = {r.branch_id: (r.applicable, list(r.excluded_by), list(r.unresolved)) for r in plans.collect()}
    assert got == {
        "both": (True, [], []), "off": (False, ["MODE == 2"], []), "on": (True, [], []), "never": (False, ["x > 50"], []), "lost": (True, [], ["nothing > 1"]),
        "shape": (True, [], ["x + y > 1"]), "choice": (True, [], []), "none": (True, [], []), "apart": (False, ["no window"], []),
    }
    spans = {}
    for w in windows.collect():
        spans.setdefault(w.branch_id, []).append((w.start_s, w.end_s))
    whole = [(0.0, 5.5)]
    assert {b: sorted(s) for b, s in spans.items()} == {"both": [(1.0, 2.0), (4.0, 5.0)], "on": whole, "lost": [(1.0, 3.0), (4.0, 5.0)], "shape": whole, "choice": whole, "none": whole}
    strict, _ = plan.branch_plans(branches(spark, rows), *args, narrow_by_alternatives=True)
    assert {r.branch_id: list(r.excluded_by) for r in strict.filter("not applicable").collect()} == {"off": ["MODE == 2"], "never": ["x > 50"], "choice": ["x > 50 || y > 50"], "apart": ["no window"]}


def as_by_sql(spark, d, name, logs):
    """Rows of a query on events of logs {log: [(type, second, value)]}, equal to those of its SQL."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(log, kind, v, dt.datetime(2024, 1, 8, tzinfo=dt.UTC) + dt.timedelta(seconds=s)) for log, of in logs.items() for kind, s, v in of]
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, user_id long, event_type string, value double, ts timestamp").write.parquet(f"file://{d}/events.parquet")
    found = QUERIES[name](spark, f"file://{d}")
    got = Counter(map(tuple, found.collect()))
    with duckdb.connect() as c:
        c.execute("SET timezone = 'UTC'")
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet/*.parquet'")
        assert got == Counter(c.execute(f"SELECT {', '.join(found.columns)} FROM ({SQL[name]})").fetchall())
    return [dict(zip(found.columns, r, strict=True)) for r in got.elements()]


CLICKS, VIEWS = [("click", 0, 30.0), ("click", 5, 10.0), ("click", 9, 40.0)], [("view", 1, 20.0), ("view", 6, 70.0), ("view", 8, 20.0)]
SPARSE = {1: CLICKS + VIEWS, 2: CLICKS + VIEWS, 3: VIEWS, 4: CLICKS, 5: CLICKS + [("view", 20, 20.0), ("view", 22, 90.0)], 7: [("error", 1, 1.0), ("error", 3, 1.0)], 9: [("error", 1, 1.0)]}


def test_sparse_logs_have_no_window(spark, tmp_path):
    """A signal that other logs have, or a time that signals don't share, excludes; what no log has stays unresolved."""
    got = {(r["log"], r["branch_id"]): (r["excluded_by"], r["unresolved"]) for r in as_by_sql(spark, tmp_path, "branch_applicability", SPARSE)}
    assert got[3, "gated"] == got[5, "twelve"] == got[7, "twelve"] == ("no window", "") and got[3, "twelve"] == got[1, "twelve"] == ("", "")
    assert got[3, "lost"] == ("no window", "missing.v > 1") and got[9, "free"] == ("no window", "click + view > 3")


def test_windows_of_sparse_logs(spark, tmp_path):
    """Neither a log without the signal nor one of a single instant has a window."""
    got = Counter((r["log"], r["branch_id"]) for r in as_by_sql(spark, tmp_path, "factored_branches", {k: v for k, v in SPARSE.items() if k != 3}))
    assert got[4, "shared"] == got[7, "lost"] == got[5, "twelve"] == got[9, "free"] == 0 and got[1, "free"] == got[1, "twelve"] == got[7, "free"] == got[4, "lost"] == 1


def broadcast_columns(plan):
    """Columns of what a physical plan broadcasts."""
    name = plan.getClass().getSimpleName()
    own = [[plan.output().apply(i).name() for i in range(plan.output().size())]] if name == "BroadcastExchangeExec" else []
    inner = [plan.initialPlan()] if name == "AdaptiveSparkPlanExec" else [plan.children().apply(i) for i in range(plan.children().size())]
    return own + [c for p in inner for c in broadcast_columns(p)]


def test_only_what_is_declared_is_broadcast(spark, monkeypatch):
    """Tables that grow with logs don't pass through the driver, however small their files are."""
    plans, keep = [], plan.scratch.keep
    monkeypatch.setattr(plan.scratch, "keep", lambda df, name: plans.append(df) or keep(df, name))
    samples = spark.createDataFrame([(log, s, t, t, float(t % 3)) for log in range(8) for s in "xy" for t in range(4)], "log long, signal string, ts_us long, seq long, v double")
    constants, spans = samples.selectExpr("log", "'MODE' as symbol", "1D as v").distinct(), samples.selectExpr("log", "0D as start_s", "1D as end_s").distinct()
    rows = branches(spark, [("a", ["MODE == 1", "x > 1 || y > MODE"]), ("b", ["x > 1", "y < x"])])
    found = plan.branch_plans(rows, constants, samples, spans, narrow_by_alternatives=True, apart_excludes=True)
    sent = [c for df in [*plans, *found] for c in broadcast_columns(df._jdf.queryExecution().executedPlan())]
    assert sent and not [c for c in sent if "log" in c]


def test_compile_checks(spark):
    def check(check_id, **of):
        return tuple(({"check_id": check_id, "type": "derived_expression"} | of).get(n) for n in CHECKS.names)

    rows = [
        check("helper", expression="h(x) > P", variables={"x": "t.a"}),
        check("recursive", expression="loop(x)", variables={"x": "t.a"}),
        check("call", expression="system(x)", variables={"x": "t.a"}),
        check("syntax", expression="x[1]", variables={"x": "t.a"}),
        check("expected", expression="x", expected_expression="y +", variables={"x": "t.b"}),
        check("names", expression="M_PI + z", variables={}),
        check("dotted", expression="t.a.f > 1", variables={"t.a.f": "t.a"}),
        check("none", expression=" "),
        check("ambiguous", type="threshold", signal="u.y"),
        check("two", type="tracks_setpoint", actual="t.a", setpoint="gone.b"),
        check("plain", type="parameter_equals", parameter="P", signal="word"),
        check("custom", type="custom"),
    ]
    bindings = spark.createDataFrame([("t.a",), ("t.b",), ("u.y[0]",), ("u.y[1]",)], "symbol string")
    helpers = {"h": (["v"], "fabsf(v) * 2"), "loop": (["v"], "loop(v)")}
    c = plan.compile_checks(spark.createDataFrame(rows, CHECKS), bindings, spark.createDataFrame([("P",)], "name string"), helpers)
    got = {r.check_id: (r.executable, list(r.unresolved)) for r in c.collect()}
    assert got == {
        "helper": (True, []), "recursive": (False, ["expression: unsupported syntax"]), "call": (False, ["expression: unsupported syntax"]), "syntax": (False, ["expression: unsupported syntax"]),
        "expected": (False, ["expected_expression: invalid syntax"]), "names": (False, ["expression: unknown z"]), "dotted": (True, []), "none": (False, ["expression: missing"]),
        "ambiguous": (False, ["signal u.y is ambiguous"]), "two": (False, ["setpoint gone.b is unavailable"]), "plain": (True, []), "custom": (False, ["custom"]),
    }
    assert {r.check_id: r.expression for r in c.collect()}["helper"] == "(fabsf((x)) * 2) > P"
    assert Counter(r.role for r in c.collect()) == Counter({"mechanism_defining": 10, "branch_applicability": 1, "advisory": 1})
