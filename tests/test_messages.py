"""Message definitions, units of comments, and airframes."""

from pyspark.sql import functions as F

from vaneflow.functions import units
from vaneflow.operators import airframe
from vaneflow.sources import messages

TEXTS = [
    ("d/VehicleStatus.msg", "uint64 timestamp\nuint8 ARMING_STATE_INIT = 0\nuint8 ARMING_STATE_ARMED = 2\nuint8 arming_state\nuint8 mode # NAV_ kinds, one of NAV\nuint8 NAV_MANUAL = 0\nuint8 NAV_AUTO = 3\n# TOPICS vehicle_status vehicle_status_copy"),
    ("d/Outer.msg", "Inner[2] inner\nfloat32 x # in m\nint32 LIMIT = 4"),
    ("d/Inner.msg", "float32[3] v\nOuter back\nuint8 LIMIT = 5\nuint8 LIMIT_A = 5"),
]


def test_definitions_are_flattened_without_cycles(spark):
    t = spark.createDataFrame(TEXTS, "path string, text string")
    got = {(r.topic, r.field) for r in messages.schema(t).collect()}
    assert {("vehicle_status", "arming_state"), ("vehicle_status_copy", "mode"), ("outer", "x"), ("outer", "inner.v"), ("inner", "v"), ("inner", "back.x")} <= got
    assert not any(f.count("inner.back") for topic, f in got if topic == "outer")


def test_enums_and_aliases(spark):
    t = spark.createDataFrame(TEXTS, "path string, text string")
    enums = messages.field_enums(t)
    got = {(r.topic, r.field, r.label, r.value) for r in enums.collect()}
    assert ("vehicle_status", "arming_state", "ARMING_STATE_ARMED", 2) in got and ("vehicle_status", "mode", "NAV_AUTO", 3) in got
    alias = {(r.field, r.alias, r.value) for r in messages.enum_aliases(enums).filter("topic = 'vehicle_status'").collect()}
    assert alias == {("arming_state", "ARMING_STATE_INIT", 0), ("arming_state", "ARMING_STATE_ARMED", 2), ("arming_state", "INIT", 0), ("arming_state", "ARMED", 2), ("mode", "NAV_MANUAL", 0), ("mode", "NAV_AUTO", 3), ("mode", "MANUAL", 0), ("mode", "AUTO", 3)}
    declared = {(r.owner, r.label, r.value) for r in messages.declared_constants(t).collect()}
    assert ("outer", "LIMIT", 4) in declared and ("inner", "LIMIT", 5) in declared and ("vehicle_status_copy", "NAV_AUTO", 3) in declared


def test_units(spark):
    cases = {"yaw [rad/s] (m)": ("rad/s", "rate"), "heading (Radian)": ("rad", "angle"), "height, in metres": ("m", "physical"), "units: hPa": ("hPa", "physical"), "within mind": (None, "none"), None: (None, "none"), "[foo] (deg)": ("deg", "physical")}
    df = spark.createDataFrame([(k,) for k in cases], "c string").select("c", units.unit_of(F.col("c")).alias("u"))
    assert {r.c: (r.u.unit, r.u.kind) for r in df.collect()} == cases
    assert spark.range(1).select(units.units_agree(F.lit("Meters"), F.lit("m")), units.units_agree(F.lit("m"), F.lit("s")), units.units_agree(F.lit("m"), F.lit("furlong")), units.canonical_unit(F.lit("unitless"))).first()[:] == (True, False, None, "unitless")


def test_airframe(spark):
    p = spark.createDataFrame([("a", "CA_SV_CS_COUNT", 3.0), ("a", "CA_SV_CS0_TYPE", 1.0), ("a", "CA_SV_CS1_TYPE", 9.0), ("a", "PWM_MAIN_FUNC1", 201.0), ("a", "PWM_AUX_FUNC2", 202.0), ("a", "PWM_MAIN_FUNC3", 203.0), ("a", "PWM_MAIN_FUNC4", 208.0), ("a", "PWM_MAIN_FUNC5", 101.0), ("a", "SYS_AUTOSTART", 13000.0), ("b", "PWM_MAIN_FUNC1", 201.0)], "log_id string, name string, v double")
    types = airframe.surfaces(p, spark.createDataFrame([(1, "aileron")], "code long, label string"))
    outs = airframe.outputs(p, spark.createDataFrame([(0, None, "disabled"), (101, 12, "motor"), (201, 8, "servo")], "start long, count long, function string"))
    got = {(r.log_id, r.servo): (r.control_surface, r.source_parameter, [c.parameter for c in r.output_channels]) for r in airframe.surface_mapping(types, outs).collect()}
    assert got == {("a", 1): ("aileron", "CA_SV_CS0_TYPE", ["PWM_MAIN_FUNC1"]), ("a", 2): ("unknown", "CA_SV_CS1_TYPE", ["PWM_AUX_FUNC2"]), ("a", 3): ("unknown", "CA_SV_CS2_TYPE", ["PWM_MAIN_FUNC3"]), ("a", 8): ("unknown", None, ["PWM_MAIN_FUNC4"]), ("b", 1): ("unknown", None, ["PWM_MAIN_FUNC1"])}
    level = airframe.mapping_confidence(types, outs)
    assert {r.log_id: r.confidence for r in level.collect()} == {"a": "medium", "b": "low"}
    lines = [r.line for r in airframe.evidence(p, spark.createDataFrame([("a", "actuator_servos")], "log_id string, topic string"), types, outs).filter("log_id = 'a'").orderBy("place").collect()]
    assert lines[0] == "ULog contains actuator_servos topic." and lines[1] == "CA_SV_CS_COUNT=3" and lines[2] == "CA_SV_CS0_TYPE=1 (aileron) maps to servo_1." and "PWM_MAIN_FUNC5=101 maps output channel to motor_1." in lines and len(lines) == 10
    logs = spark.createDataFrame([("a", "v1", "h", "VTOL "), ("c", None, None, None)], "log_id string, firmware_version string, git_hash string, vehicle_type string")
    ctx = {r.log_id: r for r in airframe.context(logs, p, airframe.surface_mapping(types, outs), level).collect()}
    assert (ctx["a"].vehicle_type, ctx["a"].sys_autostart) == ("vtol", 13000) and ctx["a"].control_surface_summary.startswith('{"vehicle_type":"vtol"') and ctx["c"].control_surface_summary == "unknown"
