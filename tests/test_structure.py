"""Lineages, terminals, expansion of files, spelt-out expressions and bounds of parameters."""

import random

from pyspark.sql import functions as F

from vaneflow.operators import gate, lineage


def test_members_come_from_the_nearest_class(spark):
    bases = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("x", "y"), ("y", "x"), ("d", None)], "class string, base string")
    defs = spark.createDataFrame([("a", "m"), ("b", "n"), ("c", "n"), ("b", "o"), ("a", "o"), ("x", "p"), ("x", "p"), ("d", "q"), ("a", "q")], "class string, member string")
    refs = spark.createDataFrame([("d", m) for m in "mnoqz"] + [("y", "p"), ("a", "n")], "class string, member string")
    got = {(r[0], r[1]): r[2:] for r in lineage.resolve_members(refs, bases, defs).collect()}
    assert got == {("d", "m"): ("a", 2, "exact"), ("d", "n"): (None, 1, "ambiguous"), ("d", "o"): ("b", 1, "exact"), ("d", "q"): ("d", 0, "exact"), ("d", "z"): (None, None, "missing"), ("y", "p"): (None, 1, "ambiguous"), ("a", "n"): (None, None, "missing")}


def test_terminals(spark):
    writers = [("a.x", "f1", "C", "i1", False), ("a.x", "f2", "D", "i1", False), ("b.y", "f1", "C", None, False), ("b.y", "f2", "D", None, False), ("b.y", "f2", "D", None, False), ("t[0].z", "f3", None, None, True), ("u.v", "f1", None, None, True), ("q", "f5", "Base", None, False), ("q", "f6", "Other", None, False)]
    logged = [("t[0].z",), ("t[1].z",), ("u[0].v",)]
    terminals = [("a.x", None, None), ("b.y", None, None), ("b.y", None, "f2"), ("b.y", "D", None), ("b.y", None, "f9"), ("t.z", None, None), ("t[0].z", None, None), ("u.v", None, None), ("none", None, None), ("q", "Derived", None), ("q", "Stranger", None), ("q", None, "h5"), ("", None, None)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = lineage.validate_terminals(df(terminals, "terminal string, class string, file string"), df(writers, "symbol string, file string, owner string, identity string, published boolean"), df(logged, "symbol string"), df([("Derived", "Base")], "class string, base string"), df([("f5", "h5")], "file string, includes string"))
    assert {(r["terminal"], r["class"], r["file"]): (r.status, r.logged, r.n_writers, r.resolved_file) for r in got.collect()} == {
        ("a.x", None, None): ("valid", False, 2, None), ("b.y", None, None): ("ambiguous", False, 3, None), ("b.y", None, "f2"): ("valid", False, 3, "f2"), ("b.y", "D", None): ("valid", False, 3, "f2"),
        ("b.y", None, "f9"): ("absent_in_scope", False, 3, None), ("t.z", None, None): ("ambiguous", True, 0, None), ("t[0].z", None, None): ("valid", True, 1, None), ("u.v", None, None): ("valid", True, 1, None),
        ("none", None, None): ("absent", False, 0, None), ("q", "Derived", None): ("valid", False, 2, "f5"), ("q", "Stranger", None): ("ambiguous", False, 2, None), ("q", None, "h5"): ("valid", False, 2, "f5"), ("", None, None): ("absent", False, 0, None),
    }


def test_expansion_is_the_naive_fixpoint(spark):
    r = random.Random(4)
    uses = [(f"f{r.randrange(60)}", f"s{r.randrange(80)}") for _ in range(200)]
    defines = [(f"f{i}", f"s{r.randrange(70)}") for i in range(60)]
    owners = {s: {f for f, t in defines if t == s} for _, s in uses}
    seeds = {f"f{i}" for i in range(6)}
    files, before = set(seeds), None
    while files != before:
        before = set(files)
        files |= {next(iter(owners[s])) for f, s in uses if f in files and len(owners[s]) == 1}
    want = {s: ("admitted", next(iter(owners[s]))) if len(owners[s]) == 1 else ("ambiguous" if owners[s] else "missing", None) for f, s in uses if f in files}
    sizes = []
    admitted, refs = lineage.expand(spark.createDataFrame([(f,) for f in sorted(seeds)], "file string"), spark.createDataFrame(uses, "file string, symbol string"), spark.createDataFrame(defines, "file string, symbol string"), sizes)
    assert {x.file for x in admitted.collect()} == files and admitted.count() == len(files) > len(seeds) + 3
    assert {x.symbol: (x.status, x.file) for x in refs.collect()} == want
    assert sum(n for n, _ in sizes) == len(files) and sum(n for _, n in sizes) == len(want)  # each is joined once


def brute_ground(producers, symbol, depth, path=()):
    own = [t for s, t in producers if s == symbol]
    if not own:
        return symbol
    if symbol in path or len(own) > 1 or depth == 0:
        return None
    parts = [brute_ground(producers, t, depth - 1, (*path, symbol)) for t in own[0]]
    return None if None in parts else f"( {' '.join(parts)} )"


def test_grounding(spark):
    r = random.Random(6)
    producers = [(f"x{r.randrange(30)}", [r.choice([f"x{r.randrange(30)}", "+", "1", "leaf"]) for _ in range(r.randint(1, 3))]) for _ in range(26)]
    producers += [(f"d{i}", [f"d{i + 1}", "*", "2"]) for i in range(9)] + [("loop", ["loop"])]
    roots = [f"x{i}" for i in range(30)] + [f"d{i}" for i in range(10)] + ["loop", "free"]
    got = {g.root: g.expression for g in lineage.ground(spark.createDataFrame(producers, "symbol string, tokens array<string>"), spark.createDataFrame([(x, x) for x in roots], "root string, symbol string")).collect()}
    assert got == {x: brute_ground(producers, x, 6) for x in roots}
    assert got["d3"] is not None and got["d2"] is None and got["loop"] is None


OPS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def test_bounds_are_what_predicates_allow(spark):
    r = random.Random(9)
    predicates = [(f"b{r.randrange(60)}", f"P{r.randrange(2)}", r.choice(list(OPS)), float(r.randint(0, 3))) for _ in range(200)]
    bounds = gate.envelopes(spark.createDataFrame(predicates, "branch string, name string, op string, value double"))
    tried = [x / 4 for x in range(-4, 20)]
    for b in bounds.collect():
        own = [(op, v) for c, n, op, v in predicates if (c, n) == (b.branch, b.name)]
        assert b.satisfiable == any(all(OPS[op](x, v) for op, v in own) for x in tried), (b, own)
    logs = [1, 2, 3]
    values = [(g, n, float(r.randint(0, 3))) for g in logs for n in ("P0", "P1") if (g, n) != (3, "P1")]
    got = {(g.log, g.branch): (g.feasible, list(g.contradicted)) for g in gate.gate(bounds, spark.createDataFrame(values, "log long, name string, v double"), spark.createDataFrame([(g,) for g in logs], "log long")).collect()}
    sat = {(b.branch, b.name): b.satisfiable for b in bounds.collect()}
    for (g, branch), (feasible, bad) in got.items():
        names = sorted({n for c, n, _, _ in predicates if c == branch})
        never = [n for n in names if not sat[branch, n]]
        actual = {n: next((v for h, m, v in values if (h, m) == (g, n)), None) for n in names}
        out = [n for n in names if actual[n] is not None and not all(OPS[op](actual[n], v) for c, m, op, v in predicates if (c, m) == (branch, n))]
        assert bad == (never or out)
        assert feasible == (False if never or out else None if None in actual.values() else True)
    assert len(got) == 3 * len({p[0] for p in predicates})


def test_roles(spark):
    rows = [("SYS_ENABLE", None, "branch_selector"), ("NAV_RAD", "switch (x)", "branch_selector"), ("NAV_RAD", "x > 1", "threshold"), ("MC_ROLL_P_X", None, "tuning_or_shaping"), ("ZZ", None, "unknown")]
    df = spark.createDataFrame(rows, "name string, predicate string, want string").select("want", gate.role(F.col("name"), F.col("predicate")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_requirements_are_counted_without_their_rows(spark, monkeypatch):
    predicates = [("b", "P_mode", ">", 1.0, None), ("b", "P_mode", ">", 1.0, None), ("b", "P_mode", "<", 2.0, "if (x)"), (None, "Q", "==", 3.0, "if (y)"), ("c", "none", ">", 1.0, "if (x)"), ("c", "none", ">", 1.0, "if (x)"), ("c", None, ">", 1.0, None), ("c", "Q", None, 1.0, "if (z)"), ("c", "Q", ">", None, "case")]
    p = spark.createDataFrame(predicates, "branch string, name string, op string, value double, predicate string")
    v = spark.createDataFrame([(i, n, x) for i in range(40) for n, x in (("P_mode", float(i % 3)), ("Q", 3.0 if i % 2 else None))], "log long, name string, v double")
    by = ["branch", "name", "role", "result"]
    want = sorted(map(tuple, gate.requirements(p, v).groupBy(*by).agg(F.count("*").alias("n")).collect()), key=str)
    each, rows = gate.requirements, []
    monkeypatch.setattr(gate, "requirements", lambda *a: rows.append(each(*a).count()) or each(*a))
    assert sorted(map(tuple, gate.requirement_counts(p, v).select(*by, "n").collect()), key=str) == want
    assert rows == [2 * 3 + 3 * 2 + 1 + 1]


def test_a_symbol_is_spelt_out_once_for_all_roots(spark, monkeypatch):
    keep, rows = lineage.scratch.keep, []

    def counted(df, name):
        out = keep(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(lineage.scratch, "keep", counted)
    producers = spark.createDataFrame([("a", ["b", "*", "b"]), ("b", ["1"])], "symbol string, tokens array<string>")
    got = lineage.ground(producers, spark.createDataFrame([(f"r{i}", "a") for i in range(50)], "root string, symbol string"))
    assert [g.expression for g in got.collect()] == ["( ( 1 ) * ( 1 ) )"] * 50
    assert max(rows) <= 3


def test_expansion_sends_no_definitions_through_the_driver(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    write, plans = DataFrameWriter.parquet, []

    def seen(self, path, *a, **k):
        if "expand-files" in path and not path.endswith("r-0"):
            plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    pairs = lambda rows: spark.createDataFrame(rows, "file string, symbol string")
    files, _ = lineage.expand(spark.createDataFrame([("a",)], "file string"), pairs([("a", "x"), ("b", "y")]), pairs([("b", "x"), ("c", "y")]))
    assert sorted(map(tuple, files.collect())) == [("a", 0), ("b", 1), ("c", 2)]
    assert len(plans) == 3 and not any("BroadcastHashJoin" in p for p in plans)
