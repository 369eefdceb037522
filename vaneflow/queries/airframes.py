"""Units of comments, and control surfaces from parameters."""

from pyspark.sql import functions as F

from ..functions import scalar, units
from ..operators import airframe
from ..sources.tables import table
from . import query


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'm' WHEN 1 THEN 'rad' WHEN 2 THEN 'm/s' WHEN 3 THEN 'deg/s' WHEN 5 THEN 'V' WHEN 6 THEN 'degC' END AS unit,
CASE p_partkey % 8 WHEN 0 THEN 'physical' WHEN 1 THEN 'angle' WHEN 2 THEN 'physical' WHEN 3 THEN 'rate' WHEN 5 THEN 'physical' WHEN 6 THEN 'physical' ELSE 'none' END AS kind, CASE p_partkey % 8 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN false WHEN 5 THEN false WHEN 6 THEN false END AS metres FROM part""")
def unit_labels(spark, d):
    texts = ("altitude [ Meters ]", "yaw (radians), -PI..+PI", "speed, in metres/sec", "Unit: degrees  per second".replace("  ", " "), "no unit in mind", "[parsecs] (V) in m", "in Celsius", "within metersquare")
    p = table(spark, d, "part").withColumn("text", F.array(*map(F.lit, texts))[(F.col("p_partkey") % 8).cast("int")]).withColumn("u", units.unit_of(F.col("text")))
    return p.select("p_partkey", "u.unit", "u.kind", units.units_agree(F.col("u.unit"), F.lit("metres")).alias("metres"))


POLICIES = [
    ("bool", "armed", "[m]", False, None, "discrete_hold", None, "high"), ("float32", "mode", None, True, None, "discrete_hold", None, "high"), ("float32", "reset_count", "in m", False, None, "discrete_hold", None, "high"),
    ("float32", "delta_heading", "[rad]", False, None, "discrete_hold", None, "high"), ("float32", "q_d", None, False, 4, "quaternion_slerp", "quaternion", "high"), ("uint8", "yaw", "[rad]", False, None, "discrete_hold", None, "high"),
    ("float32", "yaw", "in radians -PI..+PI", False, None, "angle_wrap", "rad", "high"), ("float32", "yawspeed", "[rad/s] about yaw", False, None, "linear", "rad/s", "high"), ("float32", "vx", "North velocity, in metres/sec.", False, None, "linear", "m/s", "high"),
    ("float32", "scroll", "(rad)", False, None, "linear", "rad", "high"), ("float32", "ratio", "no unit", False, None, "linear", None, "low"), ("string", "text", None, False, None, "discrete_hold", None, "low"),
]


@query(f"""SELECT p_partkey, {", ".join(f"CASE p_partkey % {len(POLICIES)} " + " ".join(f"WHEN {i} THEN '{r[at]}'" for i, r in enumerate(POLICIES) if r[at]) + f" END AS {name}" for at, name in ((5, "method"), (6, "unit"), (7, "confidence")))} FROM part""")
def signal_policies(spark, d):
    """How fields of nine kinds are resampled."""
    rows = F.array(*(F.struct(*(F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, (("type", "string"), ("name", "string"), ("comment", "string"), ("is_enum", "boolean"), ("size", "int")), strict=False))) for r in POLICIES))
    p = table(spark, d, "part").withColumn("f", rows[(F.col("p_partkey") % len(POLICIES)).cast("int")])
    return p.select("p_partkey", scalar.signal_policy(F.col("f.type"), F.col("f.name"), F.col("f.comment"), F.col("f.is_enum"), F.col("f.size")).alias("p")).select("p_partkey", "p.*")


def surface_tables(spark, d):
    """Nations as logs: suppliers' keys say surfaces' types, customers' the functions of output channels."""
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("log_id"), text("CA_SV_CS", (F.col("s_suppkey") % 4).cast("string"), "_TYPE").alias("name")).agg(F.max(F.col("s_suppkey") % 5).cast("double").alias("v"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("log_id"), text("PWM_MAIN_FUNC", (F.col("c_custkey") % 8 + 1).cast("string")).alias("name")).agg(F.max(198 + F.col("c_custkey") % 12).cast("double").alias("v"))
    labels = spark.createDataFrame([(1, "aileron"), (2, "elevator"), (3, "rudder")], "code long, label string")
    definitions = spark.createDataFrame([(0, None, "disabled"), (101, 12, "motor"), (201, 8, "servo")], "start long, count long, function string")
    p = s.unionByName(c)
    return airframe.surfaces(p, labels), airframe.outputs(p, definitions)


SURFACES = """t AS (SELECT s_nationkey AS l, s_suppkey % 4 + 1 AS servo, max(s_suppkey % 5) AS k FROM supplier GROUP BY ALL), f AS (SELECT c_nationkey AS l, c_custkey % 8 + 1 AS ch, max(198 + c_custkey % 12) AS id FROM customer GROUP BY ALL),
s AS (SELECT l, id - 200 AS servo, string_agg('PWM_MAIN_FUNC' || ch, ',' ORDER BY ch) AS channels FROM f WHERE id BETWEEN 201 AND 208 GROUP BY ALL)"""


@query(f"""WITH {SURFACES} SELECT coalesce(t.l, s.l) AS log_id, CAST(coalesce(t.servo, s.servo) AS INT) AS servo, CASE k WHEN 1 THEN 'aileron' WHEN 2 THEN 'elevator' WHEN 3 THEN 'rudder' ELSE 'unknown' END AS control_surface,
CASE WHEN k IS NOT NULL THEN 'CA_SV_CS' || (t.servo - 1) || '_TYPE' END AS source_parameter, k AS source_value, coalesce(channels, '') AS channels FROM t FULL JOIN s ON t.l = s.l AND t.servo = s.servo""")
def control_surface_mapping(spark, d):
    m = airframe.surface_mapping(*surface_tables(spark, d))
    return m.select("log_id", "servo", "control_surface", "source_parameter", "source_value", F.array_join(F.transform("output_channels", lambda c: c["parameter"]), ",").alias("channels"))


@query(f"""WITH {SURFACES}, d AS (SELECT t.l, bool_and(s.servo IS NOT NULL) AS every FROM t LEFT JOIN s ON t.l = s.l AND t.servo = s.servo GROUP BY ALL), logs AS (SELECT l FROM t UNION SELECT l FROM f)
SELECT logs.l AS log_id, CASE WHEN every THEN 'medium' WHEN NOT every THEN 'medium-low' ELSE 'low' END AS confidence FROM logs LEFT JOIN d ON logs.l = d.l""")
def surface_confidence(spark, d):
    return airframe.mapping_confidence(*surface_tables(spark, d))
