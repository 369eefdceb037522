"""Graphs of facts: closures over edge tables, and evaluation of small decision graphs over time."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions.expressions import compile_expression, lower_source, names_of
from ..functions.scalar import exact_symbol, normalize_symbol
from . import intervals, series


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, node, depth): everything that edges (src, dst) reach from seeds (seed, node), at its least depth, the seeds at 0.

    Breadth first, a join and an anti-join per level; cycles end by themselves.  Every level is a folder of one table,
    written once, so that rounds don't pile up and survive lost executors.
    """
    spark, path = edges.sparkSession, scratch.path(edges.sparkSession, "closure")
    first = seeds.select("seed", "node", F.lit(0).alias("depth")).distinct()

    def read(level: str) -> DataFrame:
        return spark.read.schema(first.schema).parquet(f"{path}/level-{level}")

    first.write.parquet(f"{path}/level-0")
    depth = 0
    while max_depth is None or depth < max_depth:
        step = read(str(depth)).join(edges.select(F.col("src").alias("node"), "dst"), "node").select("seed", F.col("dst").alias("node")).distinct()
        fresh = step.join(read("*"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth + 1))
        depth += 1
        fresh.write.parquet(f"{path}/level-{depth}")
        if read(str(depth)).isEmpty():
            break
    return read("*")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def unreachable(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes from which no target is reached: what validation of a graph reports."""
    back = closure(reverse(edges), targets.select(F.col("node").alias("seed"), "node"))
    return nodes.join(back.select("node").distinct(), "node", "left_anti")


def leaves(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, leaf): reached nodes that lead nowhere, the observed inputs of each seed."""
    got = closure(edges, seeds)
    return got.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("seed", F.col("node").alias("leaf")).distinct()


def split_by_terminal(edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """(terminal, src, dst): each terminal's own edges; graphs may overlap."""
    back = closure(reverse(edges), terminals.select(F.col("node").alias("seed"), "node"))
    return edges.join(back.select(F.col("seed").alias("terminal"), F.col("node").alias("dst")), "dst").select("terminal", "src", "dst")


def sinks(assignments: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Forward slice of symbols: what is produced from the seeds but read by nothing further."""
    return leaves(assignments.select(F.col("reads").alias("src"), F.col("writes").alias("dst")), seeds) if max_depth is None else closure(assignments.select(F.col("reads").alias("src"), F.col("writes").alias("dst")), seeds, max_depth)


def resolve_names(references: DataFrame, bindings: DataFrame) -> DataFrame:
    """Each reference's binding: exact spelling first, else the lossy one, else a unique suffix; observed, ambiguous or unavailable."""
    r = references.select("reference", exact_symbol(F.col("reference")).alias("_e"), normalize_symbol(F.col("reference")).alias("_n")).distinct()
    b = bindings.select("symbol", exact_symbol(F.col("symbol")).alias("_be"), normalize_symbol(F.col("symbol")).alias("_bn"), F.element_at(F.split(normalize_symbol(F.col("symbol")), r"\."), -1).alias("_bs"))
    hits = [r.join(b, r["_e"] == b["_be"]).select("reference", "symbol", F.lit(0).alias("how")), r.join(b, r["_n"] == b["_bn"]).select("reference", "symbol", F.lit(1).alias("how")), r.join(b, r["_n"] == b["_bs"]).select("reference", "symbol", F.lit(2).alias("how"))]
    found = reduce(DataFrame.unionByName, hits).distinct()
    best = found.groupBy("reference").agg(F.min("how").alias("how"))
    one = found.join(best, ["reference", "how"]).groupBy("reference", "how").agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("symbol"))
    out = references.select("reference").distinct().join(one, "reference", "left")
    return out.select("reference", F.when(F.col("n") == 1, F.col("symbol")).alias("symbol"), F.when(F.col("n").isNull(), "unavailable").when(F.col("n") == 1, "observed").otherwise("ambiguous").alias("status"))


def survey(writes: DataFrame, reads: DataFrame, anchors: DataFrame, max_hops: int = 1) -> DataFrame:
    """(file, symbol, distance, n_writes): files that hold an anchor, and hop by hop those that produce what they read or consume what they write.

    A hop reads both tables for the symbols of the files that the last one found; pairs of files that nobody asks about aren't made.
    """
    spark, since, at = writes.sparkSession, scratch.mark(), scratch.path(writes.sparkSession, "survey")
    first = anchors.select("file", F.lit(0).alias("distance")).filter("file is not null").distinct()
    read = lambda hop: spark.read.schema(first.schema).parquet(f"{at}/hop-{hop}")
    first.write.parquet(f"{at}/hop-0")

    def meet(own: DataFrame, other: DataFrame, new: DataFrame) -> DataFrame:
        """Files of the other side that share a symbol with the new files."""
        symbols = scratch.keep(own.join(new.select("file"), "file", "left_semi").select("symbol").distinct(), "survey-symbols")
        return other.join(symbols, "symbol", "left_semi").select("file")

    for hop in range(max_hops):
        new = read(hop)
        others = meet(writes, reads, new).unionByName(meet(reads, writes, new)).filter("file is not null").distinct()
        others.join(read("*").select("file"), "file", "left_anti").withColumn("distance", F.lit(hop + 1)).write.parquet(f"{at}/hop-{hop + 1}")
        if read(hop + 1).isEmpty():
            break
    near = read("*")
    scratch.release(spark, since, near)
    return writes.join(near, "file").groupBy("file", "symbol").agg(F.min("distance").alias("distance"), F.count("*").alias("n_writes"))


def kleene_and(*conditions: Column) -> Column:
    """Any false is false, whatever is unknown: what activity of operations needs."""
    return reduce(lambda a, b: a & b, conditions)


def sole_producer(values: Mapping[str, tuple[Column, Column]]) -> Column:
    """struct(status, value, producer) of {name: (active, value)}: exactly one active producer, or several of one value; else unresolved, or inactive if none can be."""
    items = F.array(*(F.struct(F.lit(n).alias("producer"), a.alias("active"), v.cast("double").alias("value")) for n, (a, v) in values.items()))
    on = F.filter(items, lambda x: F.coalesce(x["active"], F.lit(False)))
    open_ = F.exists(items, lambda x: x["active"].isNull())
    same = F.size(F.array_distinct(F.transform(on, lambda x: x["value"]))) == 1
    none = F.lit(None)
    return F.struct(
        F.when(open_, "unresolved").when(F.size(on) == 0, "inactive").when(same, F.when(on[0]["value"].isNull(), "unresolved").otherwise("value")).otherwise("unresolved").alias("status"),
        F.when(~open_ & same, F.try_element_at(on, F.lit(1))["value"]).otherwise(none).alias("value"),
        F.when(~open_ & (F.size(on) == 1), F.try_element_at(on, F.lit(1))["producer"]).otherwise(none).alias("producer"),
    )


def last_writer(writes: DataFrame, *keys: str) -> DataFrame:
    """Per key the value of the last active writer by (line, place); blocked if a later writer's activity is unknown."""
    at = F.struct("line", "place")
    agg = writes.groupBy(*keys).agg(F.max(F.when(F.col("active"), at)).alias("_on"), F.max(F.when(F.col("active").isNull(), at)).alias("_open"), F.max_by("value", F.when(F.col("active"), at)).alias("_v"))
    blocked = F.col("_open").isNotNull() & (F.col("_on").isNull() | (F.col("_open") > F.col("_on")))
    return agg.select(*keys, F.when(blocked, "unresolved").when(F.col("_on").isNull(), "inactive").otherwise("value").alias("status"), F.when(~blocked, F.col("_v")).alias("value"))


class DecisionGraph:
    """A small graph of expressions: evidence columns, branches (conditions) and operations with the branches that control them.

    `symbols` are values on the way: each has operations of its own, which may use evidence, parameters and other
    symbols, and takes its sole active producer's value; one whose producers can't be told, or that depends on itself,
    is unknown.  The graph is kept on the driver and becomes columns: symbols in the order in which they depend on each
    other, then branches and operations, all projections over a union timeline.  `evaluated` names branches whose state
    the timeline brings along as branch_<name> (feasibility.states_at: folded, or looked up in windows); where it is
    unknown the branch's own expression counts.
    """

    def __init__(self, parameters: Mapping[str, float], operations: Mapping[str, tuple[str, list[str]]], branches: Mapping[str, str], symbols: Mapping[str, Mapping[str, tuple[str, list[str]]]] | None = None, evaluated: Iterable[str] = ()):
        self.parameters, self.operations, self.branches, self.symbols = dict(parameters), dict(operations), dict(branches), dict(symbols or {})
        self.evaluated = set(evaluated)

    def order(self) -> tuple[list[str], list[str]]:
        """Symbols so that each comes after those that it uses; and those that use themselves, by whatever way, or such a one."""
        uses = {}
        for s, producers in self.symbols.items():
            texts = [t for text, by in producers.values() for t in (text, *(self.branches[b] for b in by))]
            uses[s] = {n for t in texts for n in names_of(lower_source(t))} & set(self.symbols)
        done: list[str] = []
        while ready := [s for s in self.symbols if s not in done and uses[s] <= set(done)]:
            done += ready
        return done, [s for s in self.symbols if s not in done]

    def _env(self, known: list[str]) -> dict:
        return {n: F.col(n) for n in known} | self.parameters

    def _producers(self, operations: Mapping[str, tuple[str, list[str]]], known: list[str]) -> dict[str, tuple[Column, Column]]:
        env = self._env(known)
        def condition(b: str) -> Column:
            own = compile_expression(self.branches[b], env).cast("boolean")
            return F.coalesce(F.col(f"branch_{b}"), own) if b in self.evaluated else own

        return {o: (kleene_and(F.lit(True), *map(condition, by)), compile_expression(text, env)) for o, (text, by) in operations.items()}

    def with_symbols(self, timeline: DataFrame, evidence: list[str]) -> DataFrame:
        """The timeline with a column for each symbol, null where its value is unknown."""
        ordered, circular = self.order()
        for s in circular:
            timeline = timeline.withColumn(s, F.lit(None).cast("double"))
        known = [*evidence, *circular]
        for s in ordered:
            timeline = timeline.withColumn(s, sole_producer(self._producers(self.symbols[s], known))["value"])
            known.append(s)
        return timeline

    def evaluate(self, timeline: DataFrame, evidence: list[str]) -> DataFrame:
        """The output at every time: status, value and producer."""
        rows = self.with_symbols(timeline, evidence)
        output = sole_producer(self._producers(self.operations, [*evidence, *self.symbols]))
        return rows.withColumn("output", output).select("*", "output.*").drop("output")

    def feasible_windows(self, timeline: DataFrame, evidence: list[str], *keys: str) -> DataFrame:
        """(keys, branch, start_s, end_s): when each branch is true."""
        env = self._env([*evidence, *self.symbols])
        rows = self.with_symbols(timeline, evidence).withColumn("seq", F.lit(0))
        one = lambda b: series.true_windows(rows, compile_expression(self.branches[b], env).cast("boolean"), *keys).withColumn("branch", F.lit(b))
        return reduce(DataFrame.unionByName, map(one, self.branches))


def replay(outputs: DataFrame, actual: DataFrame, keys: list[str], tolerance: Column, share: float = 0.95) -> DataFrame:
    """Recomputed outputs (ts_us, seq, v) against what was logged: share of the time, step by step, in which they agree within the tolerance."""
    from . import asof

    both = asof.align(actual, outputs, keys, "prior", "replayed")
    w = Window.partitionBy(*keys).orderBy("ts_us", "seq")
    step = F.coalesce(F.lead("ts_us").over(w) - F.col("ts_us"), F.lit(0))
    known = both.withColumns({"_step": step, "_ok": F.abs(F.col("v") - F.col("replayed")) <= tolerance}).filter("replayed is not null")
    agg = known.groupBy(*keys).agg(F.sum("_step").alias("_all"), F.sum(F.when(F.col("_ok"), F.col("_step")).otherwise(0)).alias("_good"), F.max(F.abs(F.col("v") - F.col("replayed"))).alias("max_error"), F.count("*").alias("n"))
    frac = F.coalesce(F.try_divide(F.col("_good").cast("double"), F.col("_all")), F.lit(0.0))
    return agg.select(*keys, "n", "max_error", frac.alias("matched_share"), (frac >= share).alias("matched"))


def condition_windows(timeline: DataFrame, text: str, env: Mapping[str, Column | float], *keys: str) -> DataFrame:
    """Merged windows in which a condition holds."""
    return intervals.merge(series.true_windows(timeline.withColumn("seq", F.lit(0)), compile_expression(text, env).cast("boolean"), *keys), *keys)
