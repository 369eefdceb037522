"""Feasibility of branches against evaluation at every time."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vaneflow.operators import feasibility

OPS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
TERMS = "branch string, clause int, n int, left string, op string, right string, literal double"
PRODUCERS = "operation string, symbol string, base string, factor double, offset double"


@pytest.mark.parametrize(
    "text, want",
    [
        ("a > 3", [(0, 0, "a", ">", None, 3.0)]),
        ("3 <= a.b && !c", [(0, 0, "a.b", ">=", None, 3.0), (1, 0, "c", "==", None, 0.0)]),
        ("(a || b == -1) && p->x.get() < q", [(0, 0, "a", "!=", None, 0.0), (0, 1, "b", "==", None, -1.0), (1, 0, "p.x", "<", "q", None)]),
        ("!(a > 1 && b)", [(0, 0, "a", "<=", None, 1.0), (0, 1, "b", "==", None, 0.0)]),
        ("M == Mode::AUTO", [(0, 0, "M", "==", "Mode.AUTO", None)]),
        ("a + b > 3", None),
        ("(a && b) || c", None),
        ("f(a) > 2", None),
        ("1 < 2", None),
        ("a >", None),
    ],
)
def test_terms_of(text, want):
    assert feasibility.terms_of(text) == want


def kleene(values, any_):
    if any_ in values:
        return any_
    return None if None in values else not any_


def brute_static(terms, producers, controls, constants):
    """One log's constants, and its branches, by going round until nothing changes."""
    known = dict(constants)
    names = sorted({t[0] for t in terms})

    def branch(b):
        clauses = {}
        for _, c, _, left, op, right, literal in (t for t in terms if t[0] == b):
            x, y = known.get(left), literal if right is None else known.get(right)
            clauses.setdefault(c, []).append(None if x is None or y is None else OPS[op](x, y))
        return kleene([kleene(v, True) for v in clauses.values()], False)

    while True:
        verdict = {b: branch(b) for b in names}
        before = len(known)
        for symbol in {p[1] for p in producers} - set(known):
            own = []
            for op, _, base, factor, offset in (p for p in producers if p[1] == symbol):
                runs = kleene([verdict.get(b) for o, b in controls if o == op], False)
                value = offset if base is None else factor * known[base] + offset if base in known else None
                if runs is not False:
                    own.append(value if runs else None)
            if own and None not in own and len(set(own)) == 1:
                known[symbol] = own[0]
        if len(known) == before:
            return known, verdict


def random_graph(r):
    symbols = ["P", "Q", "s0", "s1", "s2", "s3", "x", "y"]
    terms = []
    for b in range(8):
        for c in range(r.randint(1, 2)):
            for n in range(r.randint(1, 2)):
                right = r.choice(symbols) if r.random() < 0.3 else None
                terms.append((f"b{b}", c, n, r.choice(symbols), r.choice(list(OPS)), right, None if right else float(r.randint(-1, 3))))
    producers = [(f"o{i}", f"s{r.randrange(4)}", r.choice([None, "P", "Q", "s0", "s1"]), float(r.randint(0, 2)), float(r.randint(-1, 2))) for i in range(6)]
    controls = sorted({(f"o{r.randrange(6)}", f"b{r.randrange(8)}") for _ in range(7)})
    return terms, producers, controls


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_evaluate(spark, seed, tmp_path):
    r = random.Random(seed)
    terms, producers, controls = random_graph(r)
    logs = [1, 2, 3]
    constants = [(g, p, float(r.randint(-1, 3))) for g in logs for p in ("P", "Q") if r.random() < 0.8]
    samples = [(g, s, r.randint(0, 20) * 500_000, i, float(r.randint(-1, 3))) for i, (g, s) in enumerate((g, s) for g in (1, 2) for s in ("x", "y") for _ in range(8))]
    samples += [(1, "x", 7_000_000, 900, math.nan), (1, "y", 7_000_000, 901, None), (2, "unused", 1, 902, 5.0)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    df(samples, "log long, signal string, ts_us long, seq long, v double").write.parquet(f"{tmp_path}/s")
    stored = spark.read.parquet(f"{tmp_path}/s")
    found = feasibility.evaluate(df(terms, TERMS), df(producers, PRODUCERS), df(controls, "operation string, branch string"), df(constants, "log long, symbol string, v double"), stored, df([(g,) for g in logs], "log long"))
    verdicts = {(v.log, v.branch): (v.verdict, v.how) for v in found.verdicts.collect()}
    windows = {}
    for w in found.windows.collect():
        windows.setdefault((w.log, w.branch), []).append((w.start_s, w.end_s))
    dead = set()
    for g in logs:
        known, static = brute_static(terms, producers, controls, [(p, v) for h, p, v in constants if h == g])
        series = {}
        for h, s, t, _, v in sorted(samples, key=lambda x: x[2:4]):
            if h == g and v is not None and not math.isnan(v):
                series.setdefault(s, {})[t] = v
        for b, verdict in static.items():
            if verdict is not None:
                want = ("always_true" if verdict else "always_false", "static")
                spans = []
            else:
                clauses = {}
                for _, c, _, left, op, right, literal in (t for t in terms if t[0] == b):
                    clauses.setdefault(c, []).append((left, op, right, literal))
                value = lambda name, at: known[name] if name in known else series[name][max(t for t in series[name] if t <= at)]  # noqa: E731, B023
                fixed = lambda t: None if t[0] not in known or (t[2] and t[2] not in known) else OPS[t[1]](known[t[0]], known[t[2]] if t[2] else t[3])  # noqa: E731, B023
                left = {c: [t for t in ts if fixed(t) is None] for c, ts in clauses.items() if not any(fixed(t) for t in ts)}
                needs = {n for ts in left.values() for t in ts for n in (t[0], t[2]) if n and n not in known}
                want, spans = ("unknown", "none"), []
                if all(n in series for n in needs):
                    start, end = max(min(series[n]) for n in needs), min(max(series[n]) for n in needs)
                    if start <= end:
                        times = sorted({start, end} | {t for n in needs for t in series[n] if start <= t <= end})
                        holds = [all(any(OPS[op](value(a, t), value(right, t) if right else lit) for a, op, right, lit in ts) for ts in left.values()) for t in times]
                        want = ("always_true" if all(holds) else "always_false" if not any(holds) else "unknown", "dynamic")
                        for i, on in enumerate(holds):
                            if on and (i == 0 or not holds[i - 1]):
                                stop = next((times[j] for j in range(i, len(times)) if not holds[j]), times[-1])
                                spans.append((times[i] / 1e6, stop / 1e6))
            assert verdicts[g, b] == want, (g, b)
            assert sorted(windows.get((g, b), [])) == spans, (g, b)
            if want[0] == "always_false":
                dead |= {(g, o) for o, c in controls if c == b}
    assert {tuple(x) for x in found.dead.collect()} == dead


def test_signals_of_folded_branches_are_not_read(spark, tmp_path, capfd):
    """The scan's filter names only what constants leave open."""
    spark.createDataFrame([(1, s, t, t, 1.0) for s in ("x", "y", "z") for t in (1, 2)], "log long, signal string, ts_us long, seq long, v double").write.parquet(f"{tmp_path}/s")
    terms, opaque = feasibility.predicate_terms(spark.createDataFrame([("a", "P == 1 && x > 0"), ("b", "P == 2 && y > 0"), ("c", "P == 1 || z > 0"), ("d", "x + y > 3")], "branch string, predicate string"))
    assert [r.branch for r in opaque.collect()] == ["d"]
    seen = []
    keep = feasibility.scratch.keep

    def spy(df, name):
        if name == "open-samples":
            seen.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    feasibility.scratch.keep = spy
    try:
        none = spark.createDataFrame([], PRODUCERS)
        found = feasibility.evaluate(terms, none, spark.createDataFrame([], "operation string, branch string"), spark.createDataFrame([(1, "P", 1.0)], "log long, symbol string, v double"), spark.read.parquet(f"{tmp_path}/s"), spark.createDataFrame([(1,)], "log long"))
    finally:
        feasibility.scratch.keep = keep
    assert {r.branch: r.verdict for r in found.verdicts.collect()} == {"a": "always_true", "b": "always_false", "c": "always_true"}
    assert "EqualTo(signal,x)" in seen[0] or "In(signal, [x])" in seen[0], seen[0]


def test_states_at_the_edges_of_windows(spark):
    verdicts = spark.createDataFrame([(1, "a", "unknown", "dynamic", 1.0, 9.0), (1, "b", "always_true", "static", None, None), (1, "c", "unknown", "none", None, None)], "log long, branch string, verdict string, how string, start_s double, end_s double")
    windows = spark.createDataFrame([(1, "a", 2.0, 3.0), (1, "a", 5.0, 5.5)], "log long, branch string, start_s double, end_s double")
    found = feasibility.Feasible(verdicts, windows, None)
    times = [0, 1, 2, 2.5, 3, 3.1, 5, 5.5, 6, 9, 10]
    rows = spark.createDataFrame([(1, int(t * 1e6)) for t in times] + [(2, 0)], "log long, ts_us long")
    got = {(r.log, r.ts_us / 1e6): (r.branch_a, r.branch_b, r.branch_c) for r in feasibility.states_at(rows, found, ["a", "b", "c"]).collect()}
    on = {2, 2.5, 3, 5, 5.5}
    assert got == {(1, t): (None if t in (0, 10) else t in on, True, None) for t in times} | {(2, 0.0): (None, None, None)}
