"""Declarative checks over windows of signals.

Every evaluator takes the checks of its type joined to what they look at, and returns one row per check: check_id, status
(passed, failed or unresolved) and the actual value.  Checks and windows are tables; all checks of a type are one plan.
"""

from __future__ import annotations

import ast
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import CONSTANTS, UnsupportedExpression, comparison_of, compile_expression, lower_source, names_of, parse, split_top, with_aliases
from ..functions.scalar import compare_by, field_present, finite, literal_key, parse_signal, seconds
from ..schema import CHECKS, ORDER
from . import asof, series

RESULT = ["check_id", "type", "status", "actual"]


def _status(passed: Column, known: Column | None = None) -> Column:
    out = F.when(passed, "passed").when(~passed, "failed").otherwise("unresolved")
    return out if known is None else F.when(known, out).otherwise("unresolved")


def _result(df: DataFrame, passed: Column, actual: Column) -> DataFrame:
    return df.select("check_id", "type", _status(passed).alias("status"), actual.cast("double").alias("actual"))


def with_windows(checks: DataFrame, windows: DataFrame) -> DataFrame:
    """Each check's window: the named one (the last of its name, if it is a proper one), or the first if the check names none."""
    w = Window.partitionBy("name").orderBy(F.desc("position"))
    proper = windows.filter("start_s is not null and end_s is not null and end_s >= start_s").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    first = proper.agg(F.min_by(F.struct("start_s", "end_s"), "position").alias("_first"))
    out = checks.join(proper.select(F.col("name").alias("window"), F.struct("start_s", "end_s").alias("_own")), "window", "left").crossJoin(F.broadcast(first))  # one row
    pick = F.when(F.coalesce(F.col("window"), F.lit("")) == "", F.col("_first")).otherwise(F.col("_own"))
    return out.withColumns({"start_s": pick["start_s"], "end_s": pick["end_s"]}).drop("_own", "_first")


def with_parameters(checks: DataFrame, parameters: DataFrame, *operands: str) -> DataFrame:
    """Operands given by a parameter's name (columns like value_param) as numbers; null where there is none of the name."""
    for o in operands:
        p = parameters.select(F.col("name").alias(f"{o}_param"), F.col("v").alias("_p"))
        checks = checks.join(p, f"{o}_param", "left").withColumn(o, F.coalesce(o, "_p")).drop("_p")
    return checks


def samples_of(checks: DataFrame, samples: DataFrame, signal: str = "signal") -> DataFrame:
    """The first instance's samples of each check's signal in its window; a check without any stays, with a null time."""
    parsed = checks.withColumn("_s", parse_signal(F.col(signal))).withColumns({"topic": F.col("_s.topic"), "field": F.col("_s.field")}).drop("_s")
    own = series.first_instance(samples).withColumn("time_s", seconds(F.col("ts_us"))).select("topic", "field", "time_s", *ORDER, "v")
    got = parsed.join(own, ["topic", "field"]).filter(F.col("time_s").between(F.col("start_s"), F.col("end_s")))
    return checks.join(got.select("check_id", "time_s", *ORDER, "v"), "check_id", "left")


def _per_check(rows: DataFrame, **aggs: Column) -> DataFrame:
    """Aggregates of each check's samples, its operands along."""
    keep = [c for c in rows.columns if c not in ("time_s", *ORDER, "v")]
    return rows.groupBy("check_id").agg(*(F.any_value(c).alias(c) for c in keep if c != "check_id"), F.count("time_s").alias("_n"), *(a.alias(n) for n, a in aggs.items()))


def _x() -> Column:
    return finite(F.col("v"))


def _edge(last: bool) -> Column:
    """The first or the last finite value."""
    return (F.max_by if last else F.min_by)(_x(), F.when(_x().isNotNull(), F.struct(*ORDER)))


def threshold(checks: DataFrame, samples: DataFrame) -> DataFrame:
    """metric op value; between and outside take both ends in."""
    d = _per_check(samples_of(checks, samples), _count=F.count(_x()), _min=F.min(_x()), _max=F.max(_x()), _mean=F.avg(_x()), _median=F.median(_x()), _std=F.stddev_pop(_x()), _start=_edge(False), _end=_edge(True))
    values = {"count": F.when(F.col("_count") > 0, F.col("_count")).otherwise(F.col("_n")).cast("double"), "delta": F.col("_end") - F.col("_start")} | {m: F.col(f"_{m}") for m in ("min", "max", "mean", "median", "std", "start", "end")}
    metric = F.coalesce("metric", F.lit("mean"))
    actual = F.round(reduce(lambda acc, kv: F.when(metric == kv[0], kv[1]).otherwise(acc), values.items(), F.lit(None).cast("double")), 6)
    op = F.coalesce("op", F.lit(">="))
    inside = F.when(F.col("lower").isNotNull() & F.col("upper").isNotNull(), actual.between(F.col("lower"), F.col("upper")))
    passed = F.when(F.col("_n") > 0, F.when(op == "between", inside).when(op == "outside", ~inside).otherwise(compare_by(op, actual, F.col("value"))))
    return _result(d, passed, actual)


def _moves(checks: DataFrame, samples: DataFrame) -> DataFrame:
    rows = samples_of(checks, samples)
    w = Window.partitionBy("check_id").orderBy(*ORDER)
    return rows.withColumn("_p", F.lag("v").over(w)).withColumn("_move", (F.row_number().over(w) > 1) & F.col("time_s").isNotNull() & ~F.col("_p").eqNullSafe(F.col("v")))


def transition_occurs(checks: DataFrame, samples: DataFrame) -> DataFrame:
    """Any change from one value to another; either may be left open."""
    fit = F.col("_move") & (F.col("from_value").isNull() | (F.col("_p") == F.col("from_value"))) & (F.col("to_value").isNull() | (F.col("v") == F.col("to_value")))
    d = _per_check(_moves(checks, samples), _hit=F.coalesce(F.bool_or(fit), F.lit(False)), _moved=F.count_if("_move"))
    return _result(d, F.when(F.col("_n") > 0, F.col("_hit")), F.col("_moved"))


def no_transition(checks: DataFrame, samples: DataFrame) -> DataFrame:
    d = _per_check(_moves(checks, samples), _moved=F.count_if("_move"))
    return _result(d, F.when(F.col("_n") > 0, F.col("_moved") == 0), F.col("_moved"))


def state_equals(checks: DataFrame, samples: DataFrame) -> DataFrame:
    """Any sample of the value, or with mode all every one."""
    same = F.coalesce(F.col("v") == F.col("value"), F.lit(False))
    d = _per_check(samples_of(checks, samples), _any=F.bool_or(F.when(F.col("time_s").isNotNull(), same)), _all=F.bool_and(F.when(F.col("time_s").isNotNull(), same)), _same=F.count_if(same & F.col("time_s").isNotNull()))
    return _result(d, F.when(F.col("_n") > 0, F.when(F.col("mode") == "all", F.col("_all")).otherwise(F.col("_any"))), F.col("_same"))


def state_not_equals(checks: DataFrame, samples: DataFrame) -> DataFrame:
    same = F.coalesce(F.col("v") == F.col("value"), F.lit(False)) & F.col("time_s").isNotNull()
    d = _per_check(samples_of(checks, samples), _same=F.count_if(same))
    return _result(d, F.when(F.col("_n") > 0, F.col("_same") == 0), F.col("_same"))


def _errors(checks: DataFrame, samples: DataFrame) -> DataFrame:
    """Actual less setpoint, interpolated inside its span, for every check."""
    a, s = samples_of(checks, samples, "actual").filter("time_s is not null"), samples_of(checks, samples, "setpoint").filter("time_s is not null")
    num = lambda d: d.select("check_id", *ORDER, _x().alias("v")).filter("v is not null")
    err = asof.errors(num(a), num(s), ["check_id"]).select("check_id", "error")
    return checks.join(err, "check_id", "left")


def _error_stats(checks: DataFrame, samples: DataFrame) -> DataFrame:
    e = _errors(checks, samples)
    keep = [c for c in checks.columns if c != "check_id"]
    return e.groupBy("check_id").agg(*(F.any_value(c).alias(c) for c in keep), F.max("error").alias("_above"), F.max(-F.col("error")).alias("_below"), F.max(F.abs("error")).alias("_abs"))


def tracks_setpoint(checks: DataFrame, samples: DataFrame) -> DataFrame:
    d = _error_stats(checks, samples)
    return _result(d, F.col("_abs") <= F.col("max_error"), F.round("_abs", 6))


def diverges_from_setpoint(checks: DataFrame, samples: DataFrame) -> DataFrame:
    d = _error_stats(checks, samples)
    most = F.when(F.col("direction") == "below", F.col("_below")).when(F.col("direction") == "above", F.col("_above")).otherwise(F.col("_abs"))
    return _result(d, most >= F.col("min_error"), F.round(most, 6))


def monotonic_change(checks: DataFrame, samples: DataFrame) -> DataFrame:
    """The last value less the first; what lies between doesn't count."""
    d = _per_check(samples_of(checks, samples), _k=F.count(_x()), _start=_edge(False), _end=_edge(True))
    delta, least = F.col("_end") - F.col("_start"), F.coalesce("min_delta", F.lit(0.0))
    passed = F.when(F.col("_k") >= 2, F.when(F.coalesce("direction", F.lit("increase")) == "increase", delta >= least).otherwise(delta <= -least))
    return _result(d, passed, F.round(delta, 6))


def same_direction_change(checks: DataFrame, samples: DataFrame) -> DataFrame:
    """Both signals change by the least amount, with one sign; unknown if either has fewer than two samples."""
    one = lambda side, name: _per_check(samples_of(checks, samples, side), _k=F.count(_x()), _a=_edge(False), _b=_edge(True)).select("check_id", F.when(F.col("_k") >= 2, F.col("_b") - F.col("_a")).alias(name))
    d = checks.join(one("first", "_d1"), "check_id").join(one("second", "_d2"), "check_id")
    least = F.coalesce("min_delta", F.lit(0.0))
    known = F.col("_d1").isNotNull() & F.col("_d2").isNotNull()  # a false half of an `and` would hide what is unknown
    passed = F.when(known, (F.abs("_d1") >= least) & (F.abs("_d2") >= least) & (F.col("_d1") * F.col("_d2") > 0))
    return _result(d, passed, F.round("_d1", 6))


def parameter_equals(checks: DataFrame, parameters: DataFrame) -> DataFrame:
    """A parameter op a literal, numbers with a tolerance if the check has one, others as texts."""
    p = parameters.select(F.col("name").alias("parameter"), F.col("v").alias("_v"), F.col("v").cast("string").alias("_text"))
    d = checks.join(p, "parameter", "left")
    op = F.coalesce("op", F.lit("=="))
    number = F.coalesce(F.col("value"), F.col("value_text").try_cast("double"))
    words = F.when(op == "==", literal_key(F.col("_text")) == literal_key(F.col("value_text"))).when(op == "!=", literal_key(F.col("_text")) != literal_key(F.col("value_text")))
    return _result(d, F.when(F.col("_v").isNotNull(), F.coalesce(compare_by(op, F.col("_v"), number, F.col("max_error")), words)), F.col("_v"))


def branch_parameter_satisfied(checks: DataFrame, parameters: DataFrame) -> DataFrame:
    """Like parameter_equals; operator and literal come from the branch's source where the check has none.

    Of the source's comparisons it is the first that is about the check's parameter: one that names it, or reads one.
    """

    @F.pandas_udf("op string, literal string")
    def about(predicate: pd.Series, parameter: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([comparison_of(t or "", n or "") for t, n in zip(predicate, parameter, strict=True)], columns=["op", "literal"])

    asked = checks.select(F.col("source_predicate").alias("_text"), F.col("parameter").alias("_parameter")).distinct().withColumn("_about", about("_text", "_parameter"))
    c = checks.join(asked, F.col("source_predicate").eqNullSafe(F.col("_text")) & F.col("parameter").eqNullSafe(F.col("_parameter")), "left").drop("_text", "_parameter")
    text = F.col("_about.literal")
    literal = F.when(text == "true", "1").when(text == "false", "0").otherwise(text)
    found = {"op": F.coalesce("op", "_about.op"), "value": F.coalesce("value", literal.try_cast("double")), "value_text": F.coalesce("value_text", text)}
    return parameter_equals(c.withColumns(found).drop("_about"), parameters)


def tracks_parameter_value(checks: DataFrame, samples: DataFrame, parameters: DataFrame) -> DataFrame:
    p = parameters.select(F.col("name").alias("parameter"), F.col("v").alias("_p"))
    rows = samples_of(checks.join(p, "parameter", "left"), samples)
    d = _per_check(rows, _off=F.max(F.abs(_x() - F.col("_p"))))
    return _result(d, F.col("_off") <= F.coalesce("max_error", F.lit(0.0)), F.round("_off", 6))


def topic_field_present(checks: DataFrame, topics: DataFrame) -> DataFrame:
    """A field, or one flattened from it, is logged along with times."""
    fields = topics.groupBy("topic").agg(F.collect_set("field").alias("_fields"))  # a topic's fields are few
    d = checks.withColumn("_s", parse_signal(F.col("signal"))).withColumn("topic", F.col("_s.topic")).join(fields, "topic", "left")
    there = F.coalesce(field_present(F.col("_s.field"), F.col("_fields")) & F.array_contains("_fields", "timestamp"), F.lit(False))
    return _result(d, F.when(F.col("_s").isNotNull(), there), there.cast("int"))


def required_signals(signals: DataFrame, topics: DataFrame) -> DataFrame:
    """(signal, present)."""
    d = topic_field_present(signals.select(F.col("signal").alias("check_id"), F.lit("required").alias("type"), "signal"), topics)
    return d.select(F.col("check_id").alias("signal"), (F.col("status") == "passed").alias("present"))


def derived_expression(check: dict, samples: DataFrame, parameters: dict[str, float], variables: dict[str, str], window: tuple[float, float]) -> DataFrame:
    """One check of derived_expressions(): its variables and window given apart."""
    spark = samples.sparkSession
    row = check | {"type": "derived_expression", "variables": variables}
    one = spark.createDataFrame([tuple(row.get(n) for n in CHECKS.names)], CHECKS).withColumns({"start_s": F.lit(window[0]), "end_s": F.lit(window[1])})
    return derived_expressions(one, samples, spark.createDataFrame(list(parameters.items()), "name string, v double"))


def derived_expressions(checks: DataFrame, samples: DataFrame, parameters: DataFrame) -> DataFrame:
    """Checks whose expressions run over signals: all at the times of the first one named, the others interpolated.

    `variables` says what a name is: a parameter, a number or a signal; a name without an entry is a parameter.  Any or
    all results are to hold, alone or compared to a value or a second expression; without signals there is one result.
    What can't be compiled, or has an unknown name or value, is unresolved; names of a choice need be known only where
    it takes them.  Each distinct expression is a compiled column, collected as declared text; checks stay rows.
    """
    spark = checks.sparkSession
    c = checks.withColumn("_expected", F.coalesce("expected_expression", F.lit("")))
    texts = c.groupBy("expression", "_expected").agg(F.array_distinct(F.flatten(F.collect_list(F.map_keys("variables"))))).collect()
    if not texts:
        return _result(checks, F.lit(None).cast("boolean"), F.lit(None))
    table, actual, other = [], F.lit(None).cast("double"), F.lit(None).cast("double")
    truth = F.lit(None).cast("boolean")
    for i, (text, expected, keys) in enumerate(texts):
        try:
            names, choice = _names(text or "", expected, sorted(k for k in keys if not k.isidentifier()))
            at = {n: F.try_element_at("_env", F.lit(p)) for p, n in enumerate(names)}
            env = {n: F.coalesce(v, F.lit(CONSTANTS[n])) if n in CONSTANTS else v for n, v in at.items()}
            x, y = compile_expression(text or "", env), compile_expression(expected, env).cast("double") if expected else None
        except UnsupportedExpression:
            continue
        hit = F.col("_i") == i
        actual, truth, other = F.when(hit, x.cast("double")).otherwise(actual), F.when(hit, x.cast("boolean")).otherwise(truth), other if y is None else F.when(hit, y).otherwise(other)
        table.append((i, text, expected, names, [] if choice else [p for p, n in enumerate(names) if n not in CONSTANTS]))
    ids = spark.createDataFrame(table, "_i int, _text string, _other string, _names array<string>, _required array<int>")
    c = c.join(F.broadcast(ids), (F.col("expression") == F.col("_text")) & (F.col("_expected") == F.col("_other")), "left")  # the declared expressions

    named = c.select("check_id", "start_s", "end_s", "variables", F.posexplode("_names").alias("_pos", "_name")).withColumn("signal", F.try_element_at("variables", F.col("_name")))
    p = parameters.select(F.col("name").alias("_key"), finite(F.col("v")).alias("_p"))
    named = named.withColumn("_key", F.coalesce("signal", "_name")).join(p, "_key", "left").withColumn("_p", F.coalesce("_p", finite(F.col("signal").try_cast("double"))))
    scalars = named.filter("_p is not null").groupBy("check_id").agg(F.map_from_entries(F.collect_list(F.struct("_pos", "_p"))).alias("_scalars"))
    signals = named.filter("_p is null and signal is not null").select(F.struct("check_id", "_pos").alias("check_id"), "signal", "start_s", "end_s")
    first = F.min("_pos").over(Window.partitionBy("check_id"))
    own = samples_of(signals, samples).select("check_id.*", *ORDER, _x().alias("v")).filter("v is not null").withColumn("_own", (F.col("_pos") == first).cast("int"))
    # one pass over a check's series: looking back and ahead, other series' rows come before the first one's of their time
    back = Window.partitionBy("check_id").orderBy("ts_us", "_own", "seq").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("check_id").orderBy(F.desc("ts_us"), "_own", F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    places = range(max((len(t[3]) for t in table), default=0))
    of = lambda p: F.when(F.col("_pos") == p, F.struct(F.col("ts_us").alias("t"), "v"))
    rows = own.withColumns({f"_b{p}": F.last(of(p), True).over(back) for p in places} | {f"_a{p}": F.last(of(p), True).over(ahead) for p in places}).filter("_own = 1")
    for p in places:
        near = rows.withColumns({"prev_us": F.col(f"_b{p}.t"), "prev_v": F.col(f"_b{p}.v"), "next_us": F.col(f"_a{p}.t"), "next_v": F.col(f"_a{p}.v")})
        rows = near.withColumn(f"_y{p}", F.when(F.col("_pos") == p, F.col("v")).otherwise(asof.value_at("linear")))
    known = F.filter(F.array(*(F.struct(F.lit(p).alias("p"), F.col(f"_y{p}").alias("y")) for p in places)), lambda e: e["y"].isNotNull()) if places else F.array().cast("array<struct<p:int,y:double>>")
    rows = rows.select("check_id", F.map_from_entries(known).alias("_series"))
    empty = F.create_map().cast("map<int,double>")
    d = c.join(scalars, "check_id", "left").join(rows, "check_id", "left").withColumn("_env", F.map_concat(F.coalesce("_scalars", empty), F.coalesce("_series", empty)))
    d = d.withColumns({"_actual": actual, "_truth": truth, "_other": other})

    literal = F.coalesce("value", F.col("value_text").try_cast("double"), F.col("value_text").try_cast("boolean").cast("double"))
    compared = F.when(F.col("_expected") != "", compare_by(F.coalesce("op", F.lit("==")), F.col("_actual"), F.col("_other"), F.col("max_error"))).when(F.coalesce("op", F.lit("")) != "", compare_by(F.col("op"), F.col("_actual"), literal)).otherwise(F.col("_truth"))
    known = F.col("start_s").isNotNull() & (F.size(F.array_except("_required", F.map_keys("_env"))) == 0)
    agg = d.withColumn("_one", F.when(known, compared)).groupBy("check_id").agg(F.any_value("type").alias("type"), F.any_value("mode").alias("mode"), F.count_if(F.col("_one").isNull()).alias("_bad"), F.bool_and("_one").alias("_all"), F.bool_or("_one").alias("_any"), F.max("_actual").alias("_max"))
    return _result(agg, F.when(F.col("_bad") == 0, F.when(F.col("mode") == "all", F.col("_all")).otherwise(F.col("_any"))), F.round("_max", 6))


def _names(text: str, expected: str, dotted: list[str]) -> tuple[list[str], bool]:
    """Names of both expressions in the order in which they occur, and whether either holds a choice."""
    names, choice = [], False
    for t in filter(None, (text, expected)):
        plain, table = with_aliases(lower_source(t), dotted)
        names += [table.get(n, n) for n in names_of(plain)]
        choice = choice or any(isinstance(n, ast.IfExp) for n in ast.walk(parse(plain)))
    return list(dict.fromkeys(names)), choice


def evaluate(checks: DataFrame, windows: DataFrame, samples: DataFrame, parameters: DataFrame, topics: DataFrame) -> DataFrame:
    """All checks of a table: a union of one plan for each type.  Unknown types are unresolved."""
    lacking = {f.name: F.lit(None).cast(f.dataType) for f in CHECKS if f.name not in checks.columns}
    c = with_windows(checks.withColumns(lacking) if lacking else checks, windows)
    by_name = {"threshold": ("value", "lower", "upper"), "derived_expression": ("value",)}  # operands that may be a parameter's name
    of = lambda t: with_parameters(c.filter(F.col("type") == t), parameters, *by_name.get(t, ()))
    by_samples = {"threshold": threshold, "transition_occurs": transition_occurs, "no_transition": no_transition, "state_equals": state_equals, "state_not_equals": state_not_equals, "tracks_setpoint": tracks_setpoint, "diverges_from_setpoint": diverges_from_setpoint, "monotonic_change": monotonic_change, "same_direction_change": same_direction_change}
    runs = {t: lambda d, f=f: f(d, samples) for t, f in by_samples.items()} | {t: lambda d, f=f: f(d, parameters) for t, f in {"parameter_equals": parameter_equals, "branch_parameter_satisfied": branch_parameter_satisfied}.items()}
    runs |= {"tracks_parameter_value": lambda d: tracks_parameter_value(d, samples, parameters), "topic_field_present": lambda d: topic_field_present(d, topics), "derived_expression": lambda d: derived_expressions(d, samples, parameters)}
    asked = {r[0] for r in checks.filter(F.col("type").isin(*runs)).select("type").distinct().collect()}  # types without checks are not planned
    parts = [f(of(t)) for t, f in runs.items() if t in asked]
    parts.append(c.filter(~F.coalesce("type", F.lit("")).isin(*runs)).select("check_id", "type", F.lit("unresolved").alias("status"), F.lit(None).cast("double").alias("actual")))
    return reduce(DataFrame.unionByName, parts)


def predicate_parts(predicate: str) -> list[str]:
    """Conjuncts of a predicate; one with an alternative stays whole."""
    return [predicate] if len(split_top(predicate, "||")) > 1 else split_top(predicate, "&&")
