"""Which branches of a decision graph can run, found from constants first and from samples only where these leave it open.

The graph is tables, the same for all logs:
  terms (branch, clause, n, left, op, right, literal): a branch holds when every clause does, and a clause when any term
    does; a term compares a symbol with a literal or with another symbol (`predicate_terms` makes them of texts);
  producers (operation, symbol, base, factor, offset): symbol = factor * base + offset; without base the offset alone;
  controls (operation, branch): an operation runs when all its branches hold.
Constants (log, symbol, v) are parameters and enums of each log.  Truth is three-valued; null is unknown.
"""

from __future__ import annotations

import ast
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions.expressions import COMPARED, UnsupportedExpression, lower_source, parse
from ..functions.scalar import compare_by, finite, seconds
from . import series

FLIPPED = {">": "<", "<": ">", ">=": "<=", "<=": ">=", "==": "==", "!=": "!="}
NEGATED = {">": "<=", "<": ">=", ">=": "<", "<=": ">", "==": "!=", "!=": "=="}
TERM = "struct<clause:int,n:int,left:string,op:string,right:string,literal:double>"
#: Stands for the base of a constant; every log knows it.
ONE = ""


def terms_of(text: str) -> list[tuple[int, int, str, str, str | None, float | None]] | None:
    """(clause, n, left, op, right, literal) of a predicate; None if it isn't a conjunction of alternatives of comparisons."""
    plain = re.sub(r"\.get\(\)", "", text.replace("->", ".").replace("::", "."))
    try:
        tree = parse(lower_source(plain))
        clauses = [_alternatives(c, False) for c in _parts(tree, ast.And)]
    except (UnsupportedExpression, ValueError):
        return None
    return [(i, n, *term) for i, c in enumerate(clauses) for n, term in enumerate(c)]


def _parts(node: ast.expr, kind: type) -> list[ast.expr]:
    return [p for v in node.values for p in _parts(v, kind)] if isinstance(node, ast.BoolOp) and isinstance(node.op, kind) else [node]


def _alternatives(node: ast.expr, negated: bool) -> list[tuple[str, str, str | None, float | None]]:
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return _alternatives(node.operand, not negated)
    parts = _parts(node, ast.And if negated else ast.Or)
    if len(parts) > 1:
        return [t for p in parts for t in _alternatives(p, negated)]
    match node:
        case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in COMPARED:
            sign = COMPARED[type(op)]
        case ast.Name() | ast.Attribute():
            a, sign, b = node, "!=", ast.Constant(0.0)
        case _:
            raise UnsupportedExpression("no comparison")
    x, y = _side(a), _side(b)
    if isinstance(x, float):
        x, y, sign = y, x, FLIPPED[sign]
    if isinstance(x, float):
        raise UnsupportedExpression("two literals")
    sign = NEGATED[sign] if negated else sign
    return [(x, sign, None, y) if isinstance(y, float) else (x, sign, y, None)]


def _side(node: ast.expr) -> float | str:
    match node:
        case ast.Constant(value=bool() | int() | float() as v):
            return float(v)
        case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=int() | float() as v)):
            return -float(v)
        case ast.Name() | ast.Attribute():
            return ast.unparse(node)
    raise UnsupportedExpression("neither symbol nor literal")


def predicate_terms(branches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (branch, predicate) the terms, and the branches whose predicates are of another shape and so stay unknown."""

    @F.pandas_udf(f"array<{TERM}>")
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else terms_of(t) for t in texts], dtype=object)

    texts = branches.select("predicate").distinct().withColumn("_terms", split("predicate"))
    rows = branches.join(texts, "predicate", "left")
    return rows.filter("_terms is not null").select("branch", F.inline("_terms")), rows.filter("_terms is null").select("branch", "predicate")


class Static(NamedTuple):
    """What constants decide: values (log, symbol, v), truth of terms (log, branch, clause, n, holds), verdicts of branches
    (log, branch, holds), and operations (log, operation) that can't run."""

    values: DataFrame
    terms: DataFrame
    branches: DataFrame
    dead: DataFrame


def propagate(terms: DataFrame, producers: DataFrame, controls: DataFrame, constants: DataFrame, logs: DataFrame) -> Static:
    """Constants put through the graph, log by log, until nothing new is known.

    A clause holds when one term does and fails when all do; a branch fails when one clause does and holds when all do.
    An operation with a branch that fails is dead, and runs for sure when all its branches hold.  A symbol is constant
    when the producers that aren't dead all run for sure and give one value; a given constant wins over its producers.
    Each round knows at least one symbol more, so a chain of n symbols takes n rounds; each is written.  The declared
    graph is broadcast; what there is of each log is merged by its keys, since even small files of it are large tables in
    the driver's memory.
    """
    since = scratch.mark()
    made = producers.select("operation", "symbol", F.coalesce("base", F.lit(ONE)).alias("base"), F.when(F.col("base").isNull(), 0.0).otherwise(F.coalesce("factor", F.lit(1.0))).alias("factor"), F.coalesce("offset", F.lit(0.0)).alias("offset"))
    made = made.join(controls.groupBy("operation").agg(F.count("*").alias("n_controls")), "operation", "left").fillna(0, ["n_controls"])
    n_made = made.groupBy("symbol").agg(F.count("*").alias("n_made"))
    n_terms = terms.groupBy("branch", "clause").agg(F.count("*").alias("n_terms"))
    n_clauses = terms.groupBy("branch").agg(F.count_distinct("clause").alias("n_clauses"))
    one = logs.select("log", F.lit(ONE).alias("symbol"), F.lit(1.0).alias("v")).distinct()
    known = scratch.keep(constants.select("log", "symbol", finite(F.col("v").cast("double")).alias("v")).filter("v is not null").groupBy("log", "symbol").agg(F.min("v").alias("v")).unionByName(one), "constants")
    while True:
        before = scratch.mark()
        left = F.broadcast(terms).join(known.select("log", F.col("symbol").alias("left"), F.col("v").alias("_l")), "left")
        right = known.select("log", F.col("symbol").alias("right"), F.col("v").alias("_r"))
        both = left.filter("right is not null").join(right.hint("merge"), ["log", "right"]).unionByName(left.filter("right is null").withColumn("_r", F.col("literal")))
        held = scratch.keep(both.select("log", "branch", "clause", "n", compare_by(F.col("op"), F.col("_l"), F.col("_r")).alias("holds")).filter("holds is not null"), "terms")
        clause = held.groupBy("log", "branch", "clause").agg(F.bool_or("holds").alias("_any"), F.count("*").alias("_n")).join(F.broadcast(n_terms), ["branch", "clause"])
        clause = clause.filter("_any or _n = n_terms")
        branch = clause.groupBy("log", "branch").agg(F.bool_and("_any").alias("_all"), F.count("*").alias("_n")).join(F.broadcast(n_clauses), "branch")
        branch = scratch.keep(branch.filter("not _all or _n = n_clauses").select("log", "branch", F.col("_all").alias("holds")), "branches")
        states = F.broadcast(controls).join(branch, "branch").groupBy("log", "operation").agg(F.bool_and("holds").alias("_all"), F.count("*").alias("_on"))
        dead = states.filter("not _all").select("log", "operation")
        valued = F.broadcast(made).join(known.withColumnRenamed("symbol", "base"), "base").withColumn("_v", F.col("factor") * F.col("v") + F.col("offset"))
        sure = valued.join(states.filter("_all").hint("merge"), ["log", "operation"], "left").filter("n_controls = 0 or _on = n_controls")
        gone = dead.join(F.broadcast(made.select("operation", "symbol")), "operation").groupBy("log", "symbol").agg(F.count("*").alias("_gone"))
        found = sure.groupBy("log", "symbol").agg(F.count("*").alias("_sure"), F.min("_v").alias("v"), F.max("_v").alias("_most")).join(F.broadcast(n_made), "symbol").join(gone.hint("merge"), ["log", "symbol"], "left")
        found = found.filter((F.col("v") == F.col("_most")) & (F.col("_sure") == F.col("n_made") - F.coalesce("_gone", F.lit(0)))).select("log", "symbol", "v")
        new = scratch.keep(found.join(known.select("log", "symbol").hint("merge"), ["log", "symbol"], "left_anti"), "constants-new")
        if new.isEmpty():
            break
        known = scratch.keep(known.unionByName(new), "constants")
        scratch.release(terms.sparkSession, before, known)
    dead = scratch.keep(dead, "dead")
    scratch.release(terms.sparkSession, since, known, held, branch, dead)
    return Static(known, held, branch, dead)


def open_terms(terms: DataFrame, static: Static, logs: DataFrame) -> DataFrame:
    """(log, branch, clause, n, ...) of the terms that samples have to decide: of branches that are open, in clauses without
    a term that holds, and not known themselves."""
    rows = logs.select("log").distinct().crossJoin(F.broadcast(terms))  # the declared graph for each log
    rows = rows.join(static.branches.hint("merge"), ["log", "branch"], "left_anti")
    rows = rows.join(static.terms.filter("holds").select("log", "branch", "clause").distinct().hint("merge"), ["log", "branch", "clause"], "left_anti")
    return rows.join(static.terms.select("log", "branch", "clause", "n").hint("merge"), ["log", "branch", "clause", "n"], "left_anti")


class Feasible(NamedTuple):
    """verdicts (log, branch, verdict, how, start_s, end_s): always_true, always_false or unknown; how: static, dynamic or
    none; the span in which samples tell.  windows (log, branch, start_s, end_s): when a branch that samples decided
    holds.  dead (log, operation): what can't run."""

    verdicts: DataFrame
    windows: DataFrame
    dead: DataFrame


def evaluate(terms: DataFrame, producers: DataFrame, controls: DataFrame, constants: DataFrame, samples: DataFrame, logs: DataFrame, partly: bool = False) -> Feasible:
    """Verdicts and windows of every branch in every log.

    samples: (log, signal, ts_us, seq, v), values hold until the next; null and non-finite ones are left out, and of
    several at one time the last counts.  Only the signals of open terms are read: their names, from the declared graph,
    go into the scan's filter.  Terms, clauses and branches are summed up as changes over time, so a branch is one pass
    over the times of its own signals, however its clauses combine.  It is judged between the latest first and the
    earliest last sample of these; there the windows give its verdict, elsewhere it is unknown.  Branches without terms,
    or with a signal that isn't logged, are unknown; partly: one with some signals logged is judged between these, and
    the others' terms stay unknown there.
    """
    static = propagate(terms, producers, controls, constants, logs)
    open_ = scratch.keep(open_terms(terms, static, logs), "open-terms")
    fixed = static.values.select("log", F.col("symbol").alias("_symbol"), F.col("v").alias("_c"))
    for side in ("left", "right"):
        open_ = open_.join(fixed.withColumnsRenamed({"_symbol": side, "_c": f"{side}_c"}).hint("merge"), ["log", side], "left")
    open_ = scratch.keep(open_.withColumn("right_c", F.coalesce("right_c", "literal")), "open-terms")
    sides = [open_.filter(f"{s} is not null and {s}_c is null").select("log", "branch", "clause", "n", "op", "left_c", "right_c", F.lit(s).alias("side"), F.col(s).alias("signal")) for s in ("left", "right")]
    sides = scratch.keep(sides[0].unionByName(sides[1]), "open-signals")
    wanted = [r[0] for r in sides.select("signal").distinct().collect()]  # names of the declared graph

    values = samples.filter(F.col("signal").isin(wanted)).select("log", "signal", "ts_us", "seq", finite(F.col("v")).alias("v")).filter("v is not null")
    values = scratch.keep(values.groupBy("log", "signal", "ts_us").agg(F.max_by("v", "seq").alias("v")), "open-samples")
    ends = values.groupBy("log", "signal").agg(F.min("ts_us").alias("_from"), F.max("ts_us").alias("_to"))
    reach = sides.select("log", "branch", "signal").distinct().join(ends.hint("merge"), ["log", "signal"], "left")
    lacks = F.bool_or(F.col("_from").isNull())
    span = reach.groupBy("log", "branch").agg(lacks.alias("_lacks"), F.max("_from").alias("_from"), F.min("_to").alias("_to")).filter(F.lit(partly) | ~F.col("_lacks")).filter("_from <= _to").drop("_lacks")
    span = scratch.keep(span, "open-spans")

    keys = ["log", "branch", "clause", "n"]
    rows = values.join(sides.join(span.select("log", "branch").hint("merge"), ["log", "branch"]).hint("merge"), ["log", "signal"])
    time = Window.partitionBy(*keys).orderBy("ts_us")
    held = {s: F.coalesce(F.last(F.when(F.col("side") == s, F.col("v")), True).over(time), F.col(f"{s}_c")) for s in ("left", "right")}
    terms_now = rows.withColumns({f"_{s}": c for s, c in held.items()}).dropDuplicates([*keys, "ts_us"])
    terms_now = terms_now.select(*keys, "ts_us", compare_by(F.col("op"), F.col("_left"), F.col("_right")).alias("holds"))
    n_terms = open_.groupBy("log", "branch", "clause").agg(F.count("*").alias("n_terms"))
    clauses = _combine(terms_now, ["log", "branch", "clause"], "n", n_terms, "n_terms", any_=True)
    n_clauses = open_.groupBy("log", "branch").agg(F.count_distinct("clause").alias("n_clauses"))
    branches = _combine(clauses, ["log", "branch"], "clause", n_clauses, "n_clauses", any_=False)
    # the state at the span's start holds from there on, and its end closes it
    inside = branches.join(span.hint("merge"), ["log", "branch"])
    inside = inside.withColumn("ts_us", F.greatest("ts_us", "_from")).filter(F.col("ts_us") <= F.col("_to")).select("log", "branch", "ts_us", "_at", "holds", F.lit(False).alias("_end"))
    last = span.select("log", "branch", F.col("_to").alias("ts_us"), F.lit(None).cast("long").alias("_at"), F.lit(None).cast("boolean").alias("holds"), F.lit(True).alias("_end"))
    closing = inside.unionByName(last).groupBy("log", "branch", "ts_us").agg(F.max_by("holds", "_at").alias("holds"), F.bool_or("_end").alias("_end"))
    carried = F.last("holds", False).over(Window.partitionBy("log", "branch").orderBy("ts_us").rowsBetween(-1, -1))
    closing = closing.withColumn("holds", F.when(F.col("_end") & F.col("holds").isNull(), carried).otherwise(F.col("holds")))
    closing = scratch.keep(closing.select("log", "branch", "ts_us", F.lit(0).alias("seq"), "holds"), "branch-states")
    windows = series.true_windows(closing, F.col("holds"), "log", "branch")

    told = closing.groupBy("log", "branch").agg(F.bool_and(F.col("holds").isNotNull()).alias("_known"), F.bool_and("holds").alias("_all"), F.bool_or("holds").alias("_any"))
    dynamic = span.join(told.hint("merge"), ["log", "branch"]).select(
        "log", "branch",
        F.when(F.col("_known") & F.col("_all"), "always_true").when(F.col("_known") & ~F.col("_any"), "always_false").otherwise("unknown").alias("verdict"),
        F.lit("dynamic").alias("how"), seconds(F.col("_from")).alias("start_s"), seconds(F.col("_to")).alias("end_s"),
    )
    nothing = F.lit(None).cast("double")
    folded = static.branches.select("log", "branch", F.when(F.col("holds"), "always_true").otherwise("always_false").alias("verdict"), F.lit("static").alias("how"), nothing.alias("start_s"), nothing.alias("end_s"))
    decided = scratch.keep(folded.unionByName(dynamic), "verdicts")
    every = logs.select("log").distinct().crossJoin(F.broadcast(terms.select("branch").union(controls.select("branch")).distinct()))
    rest = every.join(decided.hint("merge"), ["log", "branch"], "left_anti").select("log", "branch", F.lit("unknown").alias("verdict"), F.lit("none").alias("how"), nothing.alias("start_s"), nothing.alias("end_s"))
    verdicts = decided.unionByName(rest)
    dead = F.broadcast(controls).join(decided.filter("verdict = 'always_false'"), "branch").select("log", "operation").distinct()
    return Feasible(verdicts, windows, dead)


def _combine(parts: DataFrame, keys: list[str], part: str, counts: DataFrame, n: str, any_: bool) -> DataFrame:
    """(keys, ts_us, holds) of alternatives (any_) or conjunctions of parts that change over time, from their changes alone."""
    w = Window.partitionBy(*keys, part).orderBy("ts_us")
    yes, no = F.col("holds").cast("int"), (~F.col("holds")).cast("int")
    change = lambda c: F.coalesce(c, F.lit(0)) - F.coalesce(F.lag(c).over(w), F.lit(0))
    moved = parts.withColumns({"_yes": change(yes), "_no": change(no)}).groupBy(*keys, "ts_us").agg(F.sum("_yes").alias("_yes"), F.sum("_no").alias("_no"))
    over = Window.partitionBy(*keys).orderBy("ts_us").rowsBetween(Window.unboundedPreceding, 0)
    now = moved.withColumns({"_yes": F.sum("_yes").over(over), "_no": F.sum("_no").over(over)}).join(counts.hint("merge"), keys)
    decides, other, value = ("_yes", "_no", True) if any_ else ("_no", "_yes", False)
    holds = F.when(F.col(decides) > 0, F.lit(value)).when(F.col(other) == F.col(n), F.lit(not value))
    return now.select(*keys, "ts_us", F.col("ts_us").alias("_at"), holds.alias("holds"))


def states_at(timeline: DataFrame, found: Feasible, branches: list[str], log: str = "log") -> DataFrame:
    """The timeline (log, ts_us, ...) with a column branch_<name> for each branch: what is folded, and what its windows say.

    In a window, both ends included, it holds; elsewhere inside the span that samples tell it doesn't; outside that span,
    and of unknown branches without windows, it is unknown.  Windows meet the times as an as-of join in one pass by log.
    """
    b = F.col("branch")
    windows = found.windows.filter(b.isin(branches)).select(F.col("log").alias(log), (F.round(F.col("start_s") * 1e6)).cast("long").alias("ts_us"), "branch", (F.round(F.col("end_s") * 1e6)).cast("long").alias("_until"))
    marked = timeline.withColumn("_row", F.lit(1)).unionByName(windows.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(log).orderBy("ts_us", "_row", "_until").rowsBetween(Window.unboundedPreceding, 0)
    inside = {f"_in_{n}": F.coalesce(F.max(F.when((F.col("_row") == 0) & (b == n), F.col("_until"))).over(w) >= F.col("ts_us"), F.lit(False)) for n in branches}
    rows = marked.withColumns(inside).filter("_row = 1").drop("_row", "_until", "branch")
    told = F.struct("verdict", "start_s", "end_s")
    known = found.verdicts.filter(b.isin(branches)).groupBy(F.col("log").alias(log)).agg(*(F.max(F.when(b == n, told)).alias(f"_told_{n}") for n in branches))
    rows = rows.join(known.hint("merge"), log, "left")
    t = seconds(F.col("ts_us"))
    for n in branches:
        of = F.col(f"_told_{n}")
        state = F.when(of["verdict"] == "always_true", True).when(of["verdict"] == "always_false", False).when(F.col(f"_in_{n}"), True).when(t.between(of["start_s"], of["end_s"]), False)
        rows = rows.withColumn(f"branch_{n}", state).drop(f"_told_{n}", f"_in_{n}")
    return rows
