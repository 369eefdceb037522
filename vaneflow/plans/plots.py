"""Plot products: declared families of series over samples, all error-isolated by being rows, none evaluated per plot on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.scalar import display_scale, display_unit, finite, seconds, validated_airspeed, vtol_style
from ..operators import asof, downsample, series

MAX_POINTS = 800


@dataclass(frozen=True)
class Plot:
    """A plot: the first topic that is logged, or with union all of them, the fields, and what is kept of them.

    any_nonzero: only fields with values beyond a threshold; changing: only fields that change; steps: keep every change.
    """

    id: str
    title: str
    topics: tuple[str, ...]
    fields: tuple[str, ...]
    any_nonzero: float | None = None
    changing: bool = False
    steps: bool = False
    union: bool = False
    bands: tuple[float, ...] = field(default=())


# Topics and fields of the log format's messages.
PLOTS = [
    Plot("altitude", "Altitude", ("vehicle_gps_position", "vehicle_air_data", "vehicle_global_position", "position_setpoint_triplet"), ("alt", "baro_alt_meter", "current.alt"), union=True),
    Plot("roll", "Roll angle", ("vehicle_attitude",), ("roll",)),
    Plot("pitch", "Pitch angle", ("vehicle_attitude",), ("pitch",)),
    Plot("yaw", "Yaw angle", ("vehicle_attitude",), ("yaw",)),
    Plot("rates", "Angular rates", ("vehicle_angular_velocity", "vehicle_attitude"), ("xyz[0]", "xyz[1]", "xyz[2]", "rollspeed", "pitchspeed", "yawspeed")),
    Plot("velocity", "Velocity", ("vehicle_local_position",), ("vx", "vy", "vz")),
    Plot("manual_control", "Manual control", ("manual_control_setpoint",), ("x", "y", "z", "r", "roll", "pitch", "yaw", "throttle")),
    Plot("actuator_controls", "Torque and thrust", ("vehicle_torque_setpoint", "actuator_controls_0"), ("xyz[0]", "xyz[1]", "xyz[2]", "control[0]", "control[1]", "control[2]", "control[3]")),
    Plot("actuator_outputs", "Actuator outputs", ("actuator_outputs", "actuator_motors"), tuple(f"{p}[{i}]" for p in ("output", "control") for i in range(16)), changing=True),
    Plot("motor_rpm", "Motor speeds", ("esc_status",), tuple(f"esc[{i}].esc_rpm" for i in range(8)), any_nonzero=0.001),
    Plot("raw_rc", "Raw radio channels", ("input_rc",), tuple(f"values[{i}]" for i in range(18))),
    Plot("vibration", "Vibration", ("vehicle_imu_status", "estimator_status"), ("accel_vibration_metric", "vibe[2]"), bands=(4.905, 9.81)),
    Plot("distance", "Distance sensor", ("distance_sensor",), ("current_distance", "variance")),
    Plot("temperature", "Temperature", ("sensor_baro", "sensor_accel", "airspeed", "battery_status"), ("temperature", "air_temperature_celsius"), union=True),
    Plot("temperature", "Temperature", ("esc_status",), tuple(f"esc[{i}].esc_temperature" for i in range(8)), any_nonzero=0.001, union=True),
    Plot("battery", "Power", ("battery_status",), ("voltage_v", "current_a", "discharged_mah", "remaining")),
    Plot("estimator_flags", "Estimator flags", ("estimator_status_flags", "estimator_status"), ("filter_fault_flags", "innovation_check_flags", "solution_status_flags"), any_nonzero=0.0, steps=True),
    Plot("failsafe_flags", "Failsafe flags", ("failsafe_flags", "vehicle_status_flags"), ("battery_warning", "manual_control_signal_lost", "gcs_connection_lost", "fd_critical_failure"), any_nonzero=0.0, steps=True),
    Plot("cpu", "Processor and memory", ("cpuload",), ("load", "ram_usage")),
    Plot("gps_uncertainty", "GPS uncertainty", ("vehicle_gps_position",), ("eph", "epv", "hdop", "vdop", "s_variance_m_s")),
]


def points(samples: DataFrame, plots: list[Plot] = PLOTS, start_s: float | None = None, end_s: float | None = None, max_points: int = MAX_POINTS) -> DataFrame:
    """(log_id, plot_id, topic, multi_id, field, unit, time_s, value) of all plots in one pass over the samples that they need."""
    spark = samples.sparkSession
    spec = [(p.id, t, i, f, p.any_nonzero, p.changing, p.steps, p.union) for p in plots for i, t in enumerate(p.topics) for f in p.fields]
    table = spark.createDataFrame(spec, "plot_id string, topic string, candidate int, field string, least double, changing boolean, steps boolean, union boolean")
    needed = sorted({s[1] for s in spec})
    own = series.in_window(samples.filter(F.col("topic").isin(needed)), start_s, end_s).withColumn("v", finite(F.col("v"))).filter("v is not null")
    joined = own.join(F.broadcast(table), ["topic", "field"])  # the declared fields
    first = joined.groupBy("log_id", "plot_id").agg(F.min("candidate").alias("_first"))
    joined = joined.join(first, ["log_id", "plot_id"]).filter(F.col("union") | (F.col("candidate") == F.col("_first")))
    w = Window.partitionBy("log_id", "plot_id", "topic", "multi_id", "field")
    rich = joined.withColumns({"_most": F.max(F.abs("v")).over(w), "_lo": F.min("v").over(w), "_hi": F.max("v").over(w)})
    rich = rich.filter(F.col("least").isNull() | (F.col("_most") > F.col("least"))).filter(~F.col("changing") | (F.col("_lo") < F.col("_hi")))
    keys = ("log_id", "plot_id", "topic", "multi_id", "field")
    out = downsample.stride(rich.filter("not steps"), max_points, *keys).unionByName(downsample.steps(rich.filter("steps"), max_points, *keys))
    return out.select(*keys, display_unit(F.col("topic"), F.col("field")).alias("unit"), F.round(seconds(F.col("ts_us")), 6).alias("time_s"), F.round(display_scale(F.col("topic"), F.col("field"), F.col("v")), 6).alias("value"))


def wide(samples: DataFrame, topic: str, fields: dict[str, str], finite_only: bool = True) -> DataFrame:
    """One row per message of a topic with the fields as columns; by default only rows in which all are finite."""
    keys = ["log_id", "multi_id", "ts_us"]
    own = samples.filter((F.col("topic") == topic) & F.col("field").isin(*fields))
    agg = own.groupBy(*keys).agg(F.min("seq").alias("seq"), *(F.max(F.when(F.col("field") == f, finite(F.col("v")))).alias(n) for f, n in fields.items()))
    return agg.na.drop(subset=list(fields.values())) if finite_only else agg


def local_position(samples: DataFrame) -> DataFrame:
    """(log_id, trace, ts_us, x, y): estimated and set positions east and north, and GPS fixes projected around the log's anchor."""
    est = wide(samples, "vehicle_local_position", {"x": "north", "y": "east"}).withColumn("trace", F.lit("estimated"))
    sp = wide(samples, "vehicle_local_position_setpoint", {"x": "north", "y": "east"}).withColumn("trace", F.lit("setpoint"))
    gps = wide(samples, "vehicle_gps_position", {"fix_type": "fix_type", "lat": "lat", "lon": "lon"}).filter("fix_type > 2").withColumns({"lat": F.col("lat") * 1e-7, "lon": F.col("lon") * 1e-7})
    refs = wide(samples, "vehicle_local_position", {"ref_timestamp": "ref_timestamp", "ref_lat": "ref_lat", "ref_lon": "ref_lon"}).filter("ref_timestamp != 0")
    anchor = refs.groupBy("log_id").agg(F.min_by(F.struct(F.col("ref_lat").alias("lat"), F.col("ref_lon").alias("lon")), "ts_us").alias("_r"))
    fixes = gps.groupBy("log_id").agg(F.min_by(F.struct("lat", "lon"), "ts_us").alias("_g"))
    at = fixes.join(anchor, "log_id", "left").select("log_id", F.coalesce("_r", "_g").alias("_a"))
    p = gps.join(at, "log_id").withColumn("_p", geo.project(F.col("lat"), F.col("lon"), F.col("_a.lat"), F.col("_a.lon")))
    shown = [d.select("log_id", "trace", "ts_us", F.col("east").alias("x"), F.col("north").alias("y")) for d in (est, sp)]
    return reduce(DataFrame.unionByName, [*shown, p.select("log_id", F.lit("gps").alias("trace"), "ts_us", F.col("_p.y").alias("x"), F.col("_p.x").alias("y"))])


def flow(samples: DataFrame) -> DataFrame:
    """Angles of attack and sideslip: attitude as of each velocity, the velocity in the body's frame; zeros outside forward flight."""
    vel = wide(samples, "vehicle_local_position", {"vx": "n", "vy": "e", "vz": "d"})
    left = vel
    for f in ("roll", "pitch", "yaw"):
        angle = samples.filter((F.col("topic") == "vehicle_attitude") & (F.col("field") == f)).select("log_id", "ts_us", "seq", "v")
        left = asof.neighbours(left, angle, ["log_id"]).withColumn(f, asof.value_at("linear")).drop("prev_us", "prev_v", "next_us", "next_v")
    state = samples.filter((F.col("topic") == "vtol_vehicle_status") & (F.col("field") == "vehicle_vtol_state")).select("log_id", "ts_us", "seq", "v")
    left = asof.neighbours(left, state, ["log_id"]).withColumn("style", vtol_style(asof.value_at("nearest")))
    body = geo.ned_to_body(F.col("n"), F.col("e"), F.col("d"), F.col("roll"), F.col("pitch"), F.col("yaw"))
    out = left.withColumn("_b", body).withColumn("_f", geo.flow_angles(F.col("_b.forward"), F.col("_b.right"), F.col("_b.down")))
    fly = F.col("style").isin("fixed_wing", "transition")
    zero = lambda c: F.when(fly, F.col(c)).otherwise(0.0)
    return out.select("log_id", "ts_us", "style", zero("_f.attack").alias("attack"), zero("_f.sideslip").alias("sideslip"), zero("_f.speed").alias("speed"))


def airspeed(samples: DataFrame) -> DataFrame:
    """(log_id, ts_us, airspeed): measured where it is validated, else estimated."""
    w = wide(samples, "airspeed_validated", {"true_airspeed_m_s": "m", "true_ground_minus_wind_m_s": "e", "airspeed_sensor_measurement_valid": "ok"}, False)
    return w.select("log_id", "ts_us", validated_airspeed(F.col("m"), F.col("e"), F.coalesce(F.col("ok") != 0, F.lit(False))).alias("airspeed"))


def vector_norms(samples: DataFrame, topic: str, fields: list[str]) -> DataFrame:
    w = wide(samples, topic, {f: f"c{i}" for i, f in enumerate(fields)})
    return w.select("log_id", "multi_id", "ts_us", geo.norm(*(F.col(f"c{i}") for i in range(len(fields)))).alias("norm"))


def attitudes(samples: DataFrame) -> DataFrame:
    """Euler angles of quaternion topics as further samples, in radians."""
    w = wide(samples, "vehicle_attitude", {f"q[{i}]": f"q{i}" for i in range(4)}).withColumn("_e", geo.quaternion_euler(*(F.col(f"q{i}") for i in range(4))))
    pair = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.radians(F.col(f"_e.{n}")).alias("v")) for n in ("roll", "pitch", "yaw"))))
    return w.select("log_id", F.lit("vehicle_attitude").alias("topic"), "multi_id", "seq", "ts_us", pair.alias("p")).select("log_id", "topic", "multi_id", "p.field", "seq", "ts_us", "p.v")


def odometry_latency(samples: DataFrame) -> DataFrame:
    """(log_id, ts_us, latency_ms) between sampling and logging."""
    own = samples.filter((F.col("topic") == "vehicle_visual_odometry") & (F.col("field") == "timestamp_sample"))
    return own.select("log_id", "ts_us", ((F.col("ts_us") - F.col("v")) * 1e-3).alias("latency_ms"))


def overlays(samples: DataFrame, dropouts: DataFrame, changes: DataFrame, styles: dict[int, str], start_s: float, end_s: float, first_changes: int = 80) -> DataFrame:
    """(log_id, kind, label, start_s, end_s): flight modes' backgrounds (unknown codes left out), dropouts, and the first changes of parameters, clipped to the window."""
    spark = samples.sparkSession
    names = spark.createDataFrame(sorted(styles.items()), "code int, label string")
    modes = series.state_intervals(samples.filter((F.col("topic") == "vehicle_status") & (F.col("field") == "nav_state")), start_s, end_s)
    modes = modes.join(F.broadcast(names), F.col("value").cast("int") == F.col("code")).select("log_id", F.lit("mode").alias("kind"), "label", "start_s", "end_s")  # the styles' table
    a, b = F.col("ts_us") / 1e6, F.col("ts_us") / 1e6 + F.col("duration_ms") / 1e3
    drops = dropouts.select("log_id", F.lit("dropout").alias("kind"), F.lit("dropout").alias("label"), F.greatest(a, F.lit(float(start_s))).alias("start_s"), F.least(b, F.lit(float(end_s))).alias("end_s")).filter("start_s < end_s")
    w = Window.partitionBy("log_id").orderBy("ts_us", "name")
    few = changes.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= first_changes)
    marks = few.select("log_id", F.lit("parameter").alias("kind"), F.col("name").alias("label"), (F.col("ts_us") / 1e6).alias("start_s"), (F.col("ts_us") / 1e6).alias("end_s")).filter(F.col("start_s").between(start_s, end_s))
    return modes.unionByName(drops).unionByName(marks)


def band(value: Column, limits: tuple[float, ...]) -> Column:
    """How many limits a value reaches."""
    return reduce(lambda a, b: a + b, (F.when(value >= x, 1).otherwise(0) for x in limits))
