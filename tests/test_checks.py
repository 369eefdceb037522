"""Checks, verdicts, graphs, catalogue and readers."""

import struct

import pytest
from pyspark.sql import functions as F

from vaneflow.functions import scalar
from vaneflow.operators import catalog, checks, graph, parameters, search, verdict
from vaneflow.plans import plots, verification
from vaneflow.schema import CHECKS
from vaneflow.sources import readers, sinks, ulog
from vaneflow.streaming import changes as streams

from .test_series import samples


def table(spark, *rows):
    return spark.createDataFrame([tuple(r.get(n) for n in CHECKS.names) for r in rows], CHECKS)


@pytest.fixture(scope="module")
def log(spark):
    return (
        samples(spark, "vtol_vehicle_status", vehicle_vtol_state=([10, 12, 14], [1, 1, 4]))
        .unionByName(samples(spark, "vehicle_air_data", baro_alt_meter=([12, 13, 14, 15], [100, 98, 94, 90])))
        .unionByName(samples(spark, "tecs_status", altitude_sp=([12, 13, 14, 15], [100] * 4), throttle_sp=([12, 13, 14, 15], [0.9, 0.95, 0.92, 0.91])))
    )


def test_three_checks_pass(spark, log):
    c = table(
        spark,
        {"check_id": "a", "type": "transition_occurs", "signal": "vtol_vehicle_status.vehicle_vtol_state", "from_value": 1.0, "to_value": 4.0, "window": "w1"},
        {"check_id": "b", "type": "diverges_from_setpoint", "actual": "vehicle_air_data.baro_alt_meter", "setpoint": "tecs_status.altitude_sp", "direction": "below", "min_error": 5.0, "window": "w2"},
        {"check_id": "c", "type": "threshold", "signal": "tecs_status.throttle_sp", "metric": "mean", "op": ">=", "value": 0.8, "window": "w2"},
        {"check_id": "d", "type": "threshold", "signal": "tecs_status.absent", "value": 0.8, "window": "w2"},
        {"check_id": "e", "type": "threshold", "signal": "tecs_status.throttle_sp", "value": 0.8, "window": "no such"},
        {"check_id": "f", "type": "custom"},
        {"check_id": "g", "type": "monotonic_change", "signal": "vehicle_air_data.baro_alt_meter", "direction": "decrease", "min_delta": 10.0, "window": "w2"},
        {"check_id": "h", "type": "state_equals", "signal": "vtol_vehicle_status.vehicle_vtol_state", "value": 4.0, "mode": "all", "window": "w1"},
        {"check_id": "i", "type": "parameter_equals", "parameter": "P", "op": "==", "value": 20.1, "max_error": 0.2},
        {"check_id": "j", "type": "topic_field_present", "signal": "tecs_status.throttle_sp"},
    )
    w = spark.createDataFrame([("w1", 10.0, 14.5, 0), ("w2", 12.0, 15.0, 1)], "name string, start_s double, end_s double, position int")
    topics = log.select("topic", "field").distinct().unionByName(log.select("topic", F.lit("timestamp").alias("field")).distinct())
    got = {r.check_id: (r.status, r.actual) for r in checks.evaluate(c, w, log, spark.createDataFrame([("P", 20.0)], "name string, v double"), topics).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "passed", "b": "passed", "c": "passed", "d": "unresolved", "e": "unresolved", "f": "unresolved", "g": "passed", "h": "failed", "i": "passed", "j": "passed"}
    assert got["b"][1] == 10.0
    r = verification.verify(c.filter("check_id in ('a', 'b', 'c')").withColumns({"mechanism": F.lit("m"), "branch_id": F.lit("b")}), w, log, spark.createDataFrame([], "name string, v double"), topics).first()
    assert (r.verdict, r.score, r.confidence, r.ceiling) == ("supported", 1.0, "high", "high")


def test_derived_expression(spark):
    s = samples(spark, "vehicle_local_position", z=([1, 2], [90, 95]))
    check = {"check_id": "x", "expression": "max(alt + RTL_RETURN_ALT, 100)", "op": ">=", "value": 110.0, "mode": "all"}
    run = lambda c, p={"RTL_RETURN_ALT": 20.0}: checks.derived_expression(c, s, p, {"alt": "vehicle_local_position.z"}, (0.0, 9.0)).first()  # noqa: E731, B006
    assert (run(check).status, run(check).actual) == ("passed", 115.0)
    assert run(check | {"value": 112.0}).status == "failed" and run(check | {"value": 112.0, "mode": "any"}).status == "passed"
    assert run(check, {}).status == "unresolved" and run(check | {"expression": "alt / 0"}).status == "unresolved" and run(check | {"expression": "open("}).status == "unresolved"
    assert run(check | {"op": None, "value": None, "expected_expression": "alt + 20"}).status == "passed"


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("mechanism_defining", "passed")], "supported"), ([("mechanism_defining", "failed")], "contradicted"), ([("mechanism_defining", "passed"), ("mechanism_defining", "failed")], "mixed"), ([("branch_applicability", "failed"), ("mechanism_defining", "passed")], "excluded"),
        ([("branch_applicability", "unresolved"), ("mechanism_defining", "passed")], "unresolved"), ([("mechanism_defining", "passed"), ("mechanism_defining", "unresolved")], "unresolved"), ([("evidence_availability", "passed")], "unresolved"), ([("branch_applicability", "passed"), ("mechanism_defining", "passed")], "supported"),
    ],
)
def test_check_lists(spark, rows, want):
    assert verdict.check_list(spark.createDataFrame([("k", *r) for r in rows], "k string, role string, status string"), "k").first().verdict == want


@pytest.mark.parametrize(("verdicts", "want"), [(["supported", "contradicted"], "mixed"), (["supported", "excluded"], "supported"), (["contradicted", "contradicted"], "contradicted"), (["contradicted", "unresolved"], "unresolved"), (["mixed"], "mixed"), (["excluded"], "unresolved")])
def test_mechanisms(spark, verdicts, want):
    df = spark.createDataFrame([("k", v, True) for v in verdicts] + [("k", "contradicted", False)], "k string, verdict string, has_defining boolean")
    assert verdict.mechanisms(df, "k").first().verdict == want


def test_effects(spark):
    df = spark.createDataFrame([("failed", "s", None, "contradicts"), ("failed", None, None, "contradicts"), ("passed", None, "c", "contradicts"), ("passed", None, None, "supports"), ("passed", "s", "c", "supports"), ("unresolved", "s", "c", None)], "status string, s string, c string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", verdict.claim_effect(F.col("status"), F.col("s"), F.col("c"))).collect())


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    got = {r.node: r.depth for r in graph.closure(e, spark.createDataFrame([("s", "a")], "seed string, node string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.node for r in graph.closure(e, spark.createDataFrame([("s", "a")], "seed string, node string"), 1).collect()} == {"a", "b"}
    assert [r.leaf for r in graph.leaves(e, spark.createDataFrame([("s", "b")], "seed string, node string")).collect()] == ["d"]


def test_producers(spark):
    df = spark.createDataFrame([(True, 1.0, False, 2.0), (True, 1.0, True, 1.0), (True, 1.0, True, 2.0), (False, 1.0, False, 2.0), (None, 1.0, False, 2.0), (True, None, False, 2.0)], "a boolean, x double, b boolean, y double")
    got = [r.o for r in df.select(graph.sole_producer({"p": (F.col("a"), F.col("x")), "q": (F.col("b"), F.col("y"))}).alias("o")).collect()]
    assert [(o.status, o.value) for o in got] == [("value", 1.0), ("value", 1.0), ("unresolved", None), ("inactive", None), ("unresolved", None), ("unresolved", None)]


def test_symbols(spark):
    df = spark.createDataFrame([(" _a->b::c[0] ",), ("&x",), (None,)], "s string")
    assert [r[0] for r in df.select(scalar.normalize_symbol(F.col("s"))).collect()] == ["a.b.c", "x", ""]
    assert [r[0] for r in df.select(scalar.exact_symbol(F.col("s"))).collect()] == ["_a.b.c[0]", "x", ""]
    pairs = spark.createDataFrame([("q", "q[0]", True), ("q[0]", "q", False), ("q[0]", "q[1]", False), ("q[0]", "q[0]", True), ("a.b", "a", False)], "p string, r string, want boolean")
    assert all(r.got == r.want for r in pairs.withColumn("got", scalar.produces(F.col("p"), F.col("r"))).collect())
    sig = spark.createDataFrame([("wind[1].north", True), ("wind.north", True), ("status_s.x", False), ("Wind.north", False), ("wind", False)], "s string, want boolean")
    assert all(r.got == r.want for r in sig.withColumn("got", scalar.is_signal(F.col("s"))).collect())


def test_signal_resolution(spark):
    t = spark.createDataFrame([("airspeed_wind", 0, "windspeed_north"), ("airspeed_wind", 1, "windspeed_north"), ("vehicle_status", 0, "nav_state")], "topic string, multi_id long, field string")
    refs = spark.createDataFrame([("vehicle_status.nav_state",), ("airspeed_wind.windspeed_north",), ("airspeed_wind[1].windspeed_north",), ("gone.x",)], "signal string")
    assert {r.signal: r.status for r in parameters.resolve(refs, t).collect()} == {"vehicle_status.nav_state": "observed", "airspeed_wind.windspeed_north": "ambiguous", "airspeed_wind[1].windspeed_north": "observed", "gone.x": "unavailable"}


def test_policies(spark):
    rows = [("bool", "x", None, False, None, "discrete_hold"), ("float32", "reset_counter", None, False, None, "discrete_hold"), ("float32", "delta_q_reset", None, False, 4, "discrete_hold"), ("float32", "q", "Quaternion", False, 4, "quaternion_slerp"), ("uint8", "x", "wrap", False, None, "discrete_hold"), ("float32", "yaw", "[rad] heading -pi..pi", False, None, "angle_wrap"), ("float32", "yawspeed", "[rad/s]", False, None, "linear"), ("float32", "x", None, False, None, "linear"), ("float32", "m", None, True, None, "discrete_hold")]
    rows += [("float32", "yaw", "in radians -PI..+PI", False, None, "angle_wrap"), ("float32", "azimuth", "[rad]", False, None, "angle_wrap"), ("float32", "scroll", "(rad)", False, None, "linear"), ("float32", "wind_angle_ratio", "[rad]", False, None, "linear"), ("float32", "v", "[metres/sec]", False, None, "linear"), ("float32", "z", "down, in m", False, None, "linear"), ("float32", "heading_rate", "radians / s", False, None, "linear"), ("float32", "cog_rad", "(rad)", False, None, "angle_wrap"), ("float32", "v", "allow to wrap [rad]", False, None, "linear"), ("float32", "orientation_q", None, False, 4, "quaternion_slerp"), ("float32", "r", "quaterion", False, 4, "quaternion_slerp"), ("float32", "sensor_ids", None, False, None, "discrete_hold"), ("float32", "v", "+PI limit, radian", False, None, "angle_wrap")]
    df = spark.createDataFrame(rows, "t string, n string, c string, e boolean, a int, want string")
    got = df.withColumn("p", scalar.signal_policy(F.col("t"), F.col("n"), F.col("c"), F.col("e"), F.col("a"))).collect()
    assert [r.p.method for r in got] == [r.want for r in got] and got[7].p.confidence == "low"


def test_defaults_by_priority(spark):
    make = lambda d: spark.createDataFrame(list(d.items()), "name string, v double")
    p = make({"FW_AIRSPD_TRIM": 15.0, "NAV_ACC_RAD": 10.0, "SYS_AUTOSTART": 4001.0, "VT_FW_PERM_STAB": 1.0})
    got = {r.name: (r.default_source, r.status) for r in parameters.with_defaults(p, make({"NAV_ACC_RAD": 10.0, "SYS_AUTOSTART": 4001.0}), make({"FW_AIRSPD_TRIM": 15.0, "NAV_ACC_RAD": 5.0}), make({"VT_FW_PERM_STAB": 0.0}), make({"X": 1.0})).collect()}
    assert got == {"FW_AIRSPD_TRIM": ("system", "default"), "NAV_ACC_RAD": ("airframe", "default"), "SYS_AUTOSTART": ("airframe", "default"), "VT_FW_PERM_STAB": ("metadata", "non_default")}


def test_catalogue_search_is_literal(spark):
    logs = spark.createDataFrame([(1, "a 100% b_c", True), (2, "a 1000 bxc", True), (3, "100% b_c", False)], "id int, search_text string, source_available boolean").withColumns({"upload_date": F.lit(None).cast("timestamp"), "log_date": F.lit(None).cast("timestamp")})
    assert [r.id for r in catalog.filtered(logs, "100% B_C").collect()] == [1]
    assert [r.id for r in catalog.filtered(logs, "", ("2020-01-01", "")).collect()] == []
    assert len(catalog.filtered(logs, "", ("no date", "")).collect()) == 2


def test_path_boosts(spark):
    paths = {"src/lib/a.cpp": 30.0, "src/modules/x/FooTest.cpp": -70.0, "src/drivers/vendor/x.c": -65.0, "docs/latest.cpp": 0.0, "examples/a.cpp": -40.0}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.b for r in df.withColumn("b", search.path_boost(F.col("p"))).collect()} == paths


def build_ulog():
    def msg(kind, body):
        return struct.pack("<HB", len(body), ord(kind)) + body

    out = ulog.MAGIC + b"\1" + struct.pack("<Q", 0)
    out += msg("F", b"vec:float x;float y;") + msg("F", b"att:uint64_t timestamp;float[2] q;vec v;char[4] name;uint8_t[4] _padding0;")
    out += msg("P", bytes([11]) + b"float P_ONE" + struct.pack("<f", 1.5)) + msg("A", struct.pack("<BH", 1, 7) + b"att")
    body = lambda t: struct.pack("<HQffff4s", 7, t, 1.0, 2.0, 3.0, 4.0, b"ab\0\0")
    out += msg("D", body(1000)) + msg("D", body(2000)) + msg("L", b"4" + struct.pack("<Q", 1500) + b"careful") + msg("O", struct.pack("<H", 30))
    return out


def test_ulog(spark, tmp_path):
    data = build_ulog()
    (tmp_path / "a.ulg").write_bytes(data)
    (tmp_path / "b.ulg").write_bytes(data[:-2])
    (tmp_path / "c.ulg").write_bytes(b"junk")
    got = ulog.read_ulogs(spark, f"file://{tmp_path}").withColumn("log_id", F.regexp_extract("log_id", r"(\w)\.ulg$", 1)).cache()
    s = ulog.samples(got).filter("log_id = 'a'")
    assert {(r.field, r.v, r.v_str) for r in s.filter("ts_us = 1000").collect()} == {("q[0]", 1.0, None), ("q[1]", 2.0, None), ("v.x", 3.0, None), ("v.y", 4.0, None), ("name", None, "ab")}
    assert {r.multi_id for r in s.collect()} == {1} and s.count() == 10
    assert [(r.name, r.v) for r in ulog.parameters(got).filter("log_id = 'a'").collect()] == [("P_ONE", 1.5)]
    assert {r.log_id for r in got.filter("kind = 'error'").collect()} == {"b", "c"}
    assert [(r.v, r.v_str) for r in got.filter("kind = 'message' and log_id = 'a'").collect()] == [(4.0, "careful")]
    assert ulog.samples(ulog.read_ulogs(spark, f"file://{tmp_path}", {"none"})).count() == 0


def test_missions_and_metadata(spark, tmp_path):
    texts = spark.createDataFrame([("p", '{"mission": {"items": [{"type": "SimpleItem", "command": 16, "frame": 3, "params": [0, 0, 0, 0, 1.5, 2.5, null], "Altitude": 9}, {"type": "ComplexItem", "complexItemType": "survey"}]}}'), ("w", "QGC WPL 110\n0 1 3 16 0 0 0 0 1 2 3 1\nbad\n"), ("x", "junk")], "path string, text string")
    assert {r.path: (r.format, r.n_items) for r in readers.missions(texts).collect()} == {"p": ("plan", 2), "w": ("wpl", 1), "x": ("unknown", 0)}
    items = readers.plan_items(texts, {16: "WAYPOINT"}).orderBy("item").collect()
    assert (items[0].command_name, items[0].lat, items[0].alt, items[1].type) == ("WAYPOINT", 1.5, 9.0, "survey")
    (tmp_path / "p.xml").write_text('<parameters><group><parameter name="A" default="1"><short_desc>one</short_desc></parameter><parameter name="A" default="2"/></group></parameters>')
    assert [(r.name, r.default) for r in readers.parameter_metadata(spark, f"file://{tmp_path}/p.xml").collect()] == [("A", "2")]
    enum = spark.createDataFrame([("a", "nothing"), ("b", "MAV_CMD_X = 3, MAV_CMD_Y = 4")], "path string, text string")
    assert {(r.value, r.name) for r in readers.enum_names(enum, "MAV_CMD_").collect()} == {(3, "MAV_CMD_X"), (4, "MAV_CMD_Y")}
    msg = spark.createDataFrame([("m", "uint64 timestamp # time\nfloat32[4] q # Quaternion\nuint8 MODE_A = 1\n")], "path string, text string")
    assert [(r.type, r.array_size, r.name) for r in readers.message_fields(msg).orderBy("line").collect()] == [("uint64", None, "timestamp"), ("float32", 4, "q")]
    assert [(r.label, r.value) for r in readers.message_constants(msg).collect()] == [("MODE_A", 1)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("B", 1.0, "default"), ("A", 1.5, "non_default")], "name string, v double, status string")
    sinks.write_parameter_file(rows, f"file://{tmp_path}/p")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/p").collect()][1:] == ["1\t1\tA\t1.5\t9", "1\t1\tB\t1\t6"]
    s = samples(spark, "one", x=([1, 2], [1, 2])).unionByName(samples(spark, "two", x=([1], [1])))
    sinks.write_samples(s, f"file://{tmp_path}/s")
    back = spark.read.parquet(f"file://{tmp_path}/s").filter("topic = 'one'")
    assert back.count() == 2 and "PartitionFilters: [isnotnull(topic" in back._jdf.queryExecution().toString()


def test_plot_points_take_the_first_topic(spark):
    s = samples(spark, "vehicle_angular_velocity", **{"xyz[0]": ([1, 2], [1, 2])}).unionByName(samples(spark, "vehicle_attitude", rollspeed=([1], [9])))
    got = plots.points(s)
    assert {(r.plot_id, r.topic) for r in got.collect()} == {("rates", "vehicle_angular_velocity")}


def test_stream_of_changes(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.createDataFrame([(1, "x", 0, 10, 1.0), (1, "x", 1, 20, 1.0), (1, "x", 2, 30, 2.0)], "multi_id long, field string, seq long, ts_us long, v double")
    rows.write.parquet(f"file://{tmp_path}/in")
    out = []
    run = lambda: streams.changes(streams.read_samples(spark, f"file://{tmp_path}/in")).writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).foreachBatch(lambda b, n: out.extend(b.collect())).start().awaitTermination()
    run()
    spark.createDataFrame([(1, "x", 3, 40, 2.0), (1, "x", 4, 50, 3.0)], rows.schema).write.mode("append").parquet(f"file://{tmp_path}/in")
    run()
    assert [(r.ts_us, r.event) for r in out] == [(10, "initial_value"), (30, "value_changed"), (50, "value_changed")]


def test_verify_runs_derived_expressions_and_parameter_operands(spark, log):
    base = {"window": "w2", "mechanism": "m", "branch_id": "b"}
    rows = [
        {"check_id": "d1", "type": "derived_expression", "expression": "sp - alt", "op": ">=", "value": 10.0, "variables": {"sp": "tecs_status.altitude_sp", "alt": "vehicle_air_data.baro_alt_meter"}},
        {"check_id": "d2", "type": "derived_expression", "expression": "sp - alt", "op": "<=", "value": 5.0, "mode": "all", "variables": {"sp": "tecs_status.altitude_sp", "alt": "vehicle_air_data.baro_alt_meter"}},
        {"check_id": "d3", "type": "derived_expression", "expression": "x + P_ALT", "op": ">", "value": 110.0, "variables": {"x": "vehicle_air_data.baro_alt_meter"}},
        {"check_id": "d4", "type": "derived_expression", "expression": "x + P_NONE", "op": ">", "value": 110.0, "variables": {"x": "vehicle_air_data.baro_alt_meter"}},
        {"check_id": "d5", "type": "derived_expression", "expression": "p * 2", "expected_expression": "q", "variables": {"p": "P_ALT", "q": "40"}},
        {"check_id": "d6", "type": "derived_expression", "expression": "open(", "variables": {}},
        {"check_id": "d7", "type": "derived_expression", "expression": "sp - alt", "op": ">=", "value_param": "P_ALT", "variables": {"sp": "tecs_status.altitude_sp", "alt": "vehicle_air_data.baro_alt_meter"}},
        {"check_id": "t1", "type": "threshold", "signal": "tecs_status.throttle_sp", "op": "<=", "value_param": "P_ALT"},
        {"check_id": "t2", "type": "threshold", "signal": "tecs_status.throttle_sp", "op": "outside", "lower": 1.0, "upper_param": "P_ALT"},
        {"check_id": "t3", "type": "threshold", "signal": "tecs_status.throttle_sp", "op": "outside", "lower": 1.0, "upper_param": "P_NONE"},
    ]
    c = table(spark, *(base | r for r in rows)).withColumns({"mechanism": F.col("check_id"), "branch_id": F.lit("b")})
    w = spark.createDataFrame([("w2", 12.0, 15.0, 0)], "name string, start_s double, end_s double, position int")
    parameters_ = spark.createDataFrame([("P_ALT", 20.0)], "name string, v double")
    topics = log.select("topic", "field").distinct()
    got = {r.check_id: (r.status, r.actual) for r in checks.evaluate(c, w, log, parameters_, topics).collect()}
    assert got == {"d1": ("passed", 10.0), "d2": ("failed", 10.0), "d3": ("passed", 120.0), "d4": ("unresolved", None), "d5": ("passed", 40.0), "d6": ("unresolved", None), "d7": ("failed", 10.0), "t1": ("passed", 0.92), "t2": ("passed", 0.92), "t3": ("unresolved", 0.92)}
    verdicts = {r.mechanism: r.verdict for r in verification.verify(c, w, log, parameters_, topics).collect()}
    want = {"passed": "supported", "failed": "contradicted", "unresolved": "unresolved"}
    assert verdicts == {k: want[v[0]] for k, v in got.items()}


def test_temperature_and_altitude_keep_every_topic(spark):
    s = samples(spark, "sensor_baro", temperature=([1], [20])).unionByName(samples(spark, "battery_status", temperature=([1], [30])))
    s = s.unionByName(samples(spark, "vehicle_gps_position", alt=([1], [1000]))).unionByName(samples(spark, "vehicle_air_data", baro_alt_meter=([1], [2])))
    s = s.unionByName(samples(spark, "airspeed", air_temperature_celsius=([1], [9]))).unionByName(samples(spark, "esc_status", **{"esc[0].esc_temperature": ([1], [40]), "esc[1].esc_temperature": ([1], [0])}))
    s = s.unionByName(samples(spark, "vehicle_global_position", alt=([1], [3]))).unionByName(samples(spark, "position_setpoint_triplet", **{"current.alt": ([1], [4])}))
    got = {(r.plot_id, r.topic) for r in plots.points(s).collect()}
    assert got == {("temperature", "sensor_baro"), ("temperature", "battery_status"), ("temperature", "airspeed"), ("temperature", "esc_status"), ("altitude", "vehicle_gps_position"), ("altitude", "vehicle_air_data"), ("altitude", "vehicle_global_position"), ("altitude", "position_setpoint_triplet")}


def test_a_survey_follows_only_the_files_that_it_found(spark, monkeypatch):
    monkeypatch.setattr(graph, "closure", None)  # closing all pairs of files isn't needed
    writes = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c"), (4, "d"), (9, "z")], "file long, symbol string")
    reads = spark.createDataFrame([(1, "b"), (2, "c"), (4, "c"), (8, "z"), (None, "a")], "file long, symbol string")
    found = {h: sorted((r.file, r.symbol, r.distance, r.n_writes) for r in graph.survey(writes, reads, spark.createDataFrame([(1,)], "file long"), h).collect()) for h in (1, 5)}
    assert found == {1: [(1, "a", 0, 1), (2, "b", 1, 2)], 5: [(1, "a", 0, 1), (2, "b", 1, 2), (3, "c", 2, 1), (4, "d", 3, 1)]}
