"""Scalar functions: clocks, coercions, comparisons, names, units, texts and dates.  Null in, null out unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import unit_of

# ---- clocks: three roundings of microseconds, which operators keep apart


def seconds(ts_us: Column) -> Column:
    return F.round(ts_us / F.lit(1e6), 6)


def seconds_exact(ts_us: Column) -> Column:
    return ts_us / F.lit(1e6)


def seconds_ms(ts_us: Column) -> Column:
    return F.round(ts_us / F.lit(1e6), 3)


# ---- coercions


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_float(text: Column) -> Column:
    """A finite number out of a text or number; words for truth and the like are none."""
    return finite(F.trim(text.cast("string")).try_cast("double"))


def safe_int(text: Column) -> Column:
    """Cut towards zero."""
    x = safe_float(text)
    return F.when(F.abs(x) < 9.2e18, F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))).cast("long")


def round6(x: Column) -> Column:
    return F.round(x, 6)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def clean_text(data: Column) -> Column:
    """Bytes as UTF-8 without closing NULs."""
    return F.regexp_replace(F.decode(data, "UTF-8"), r"\x00+$", "")


def first_clean(*columns: Column) -> Column:
    """The first that isn't blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


# ---- comparisons


def compare(left: Column, op: str, right: Column, tolerance: float | None = None) -> Column:
    """Six operators by name; == and != with a tolerance if one is given.  An unknown operator is an error."""
    if tolerance is not None and op in ("==", "!="):
        near = F.abs(left - right) <= tolerance
        return near if op == "==" else ~near
    table = {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right, "==": left == right, "!=": left != right}
    if op not in table:
        raise ValueError(f"unknown operator {op!r}")
    return table[op]


def compare_by(op: Column, left: Column, right: Column, tolerance: Column | None = None) -> Column:
    """The operator is a column; null where it is unknown."""
    near = F.abs(left - right) <= F.coalesce(tolerance, F.lit(0.0)) if tolerance is not None else left == right
    out = F.when(op == ">", left > right).when(op == ">=", left >= right).when(op == "<", left < right).when(op == "<=", left <= right)
    return out.when(op == "==", near).when(op == "!=", ~near)


def literal_key(text: Column) -> Column:
    """Texts compare trimmed and without regard to case; true and false words, and numbers, as one spelling."""
    t = F.lower(F.trim(text))
    return F.coalesce(F.when(t.isin("true", "false"), t), t.try_cast("double").cast("string"), t)


def predicate_matches(actual: Column, op: str, expected: Column | None = None) -> Column:
    """Ordered operators, `isfinite`, `bit_set` and `bit_clear` (of an integer mask)."""
    if op == "isfinite":
        return finite(actual).isNotNull()
    if op in ("bit_set", "bit_clear"):
        masked = actual.cast("long").bitwiseAND(expected.cast("long"))
        return masked != 0 if op == "bit_set" else masked == 0
    return compare(actual, op, expected)


def values_equal(value: Column, default: Column) -> Column:
    """Numbers within 1e-5, or else equal texts."""
    a, b = safe_float(value), safe_float(default)
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= 1e-5).otherwise(F.trim(value.cast("string")) == F.trim(default.cast("string")))


def display_value(value: Column, decimals: Column) -> Column:
    """Rounded to as many decimals as its row says, 0 to 8."""
    return reduce(lambda acc, n: F.when(decimals == n, F.round(value, n)).otherwise(acc), range(9), value)


# ---- names


def exact_symbol(name: Column) -> Column:
    """One spelling for what is the same value: separators as dots, no blanks, no outer & or *."""
    dotted = F.replace(F.replace(F.replace(F.trim(F.coalesce(name, F.lit(""))), F.lit("->"), F.lit(".")), F.lit("::"), F.lit(".")), F.lit(" "), F.lit(""))
    return F.regexp_replace(dotted, r"^[&*]+|[&*]+$", "")


def normalize_symbol(name: Column) -> Column:
    """The lossy form for search: also without indices and one leading underscore."""
    return F.regexp_replace(F.regexp_replace(exact_symbol(name), r"\[[^\]]+\]", ""), "^_", "")


def produces(producer: Column, reference: Column) -> Column:
    """An aggregate supplies its indexed elements; an element supplies neither the aggregate nor a sibling."""
    p, r = F.split(exact_symbol(producer), r"\."), F.split(exact_symbol(reference), r"\.")
    base = lambda x: F.regexp_replace(x, r"\[[^\]]+\]", "")
    index = lambda x: F.regexp_extract(x, r"(\[[^\]]+\])", 1)
    each = F.zip_with(p, r, lambda a, b: (base(a) == base(b)) & ((index(a) == "") | (index(a) == index(b))))
    return (F.size(p) == F.size(r)) & F.forall(each, lambda x: F.coalesce(x, F.lit(False)))


SIGNAL = r"^([a-z][a-z0-9_]*)(?:\[(\d+)\])?\.(.+)$"
STRICT_SIGNAL = r"^[a-z][a-z0-9_]*(\[\d+\])?(\.[A-Za-z_][A-Za-z0-9_]*(\[\d+\])?)+$"


def is_signal(name: Column) -> Column:
    """topic, perhaps an instance, and fields; types, whose names end in _s, are none."""
    topic = F.regexp_extract(name, r"^([^.\[]*)", 1)
    return F.coalesce(name.rlike(STRICT_SIGNAL) & ~topic.endswith("_s"), F.lit(False))


def parse_signal(name: Column) -> Column:
    """struct(topic, multi_id, field); null where the name is none, multi_id null where it has no instance."""
    topic = F.regexp_extract(F.trim(name), SIGNAL, 1)
    instance = F.nullif(F.regexp_extract(F.trim(name), SIGNAL, 2), F.lit("")).cast("long")
    return F.when(F.trim(name).rlike(SIGNAL) & ~topic.endswith("_s"), F.struct(topic.alias("topic"), instance.alias("multi_id"), F.regexp_extract(F.trim(name), SIGNAL, 3).alias("field")))


def signal_name(topic: Column, multi_id: Column, field: Column) -> Column:
    return F.format_string("%s[%d].%s", topic, multi_id, field)


def field_present(field: str | Column, fields: Column) -> Column:
    """The field itself, or any that is flattened from it."""
    f = F.lit(field) if isinstance(field, str) else field
    return F.exists(fields, lambda x: (x == f) | x.startswith(F.concat(f, F.lit("."))))


def is_parameter_name(name: Column) -> Column:
    return name.rlike("^[A-Z][A-Z0-9_]*$") & name.contains("_") & (F.length(name) <= 16)


def enum_key(label: Column) -> Column:
    """Labels meet without their namespace and regard to case."""
    return F.upper(F.trim(F.element_at(F.split(label, "::"), -1)))


# ---- resampling policy of a field, from its type, name and comment

# Types, names and words of the message definitions.
DISCRETE_ENDS = ["_counter", "_count", "reset_count", "_id", "_ids", "_index", "_indices", "_bitfield", "_bitmask", "_flags", "_flag"]
INTEGERS = ["int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "char", "byte"]
FLOATS = ["float32", "float64"]
RESET_WORDS = ["amount by which", "reset delta"]
QUATERNION_WORDS = ["quaternion", "quaterion"]
ANGLE_NAMES = ["heading", "yaw", "roll", "pitch", "cog_rad", "course", "bearing", "azimuth"]
RADIANS = ["rad", "radian", "radians"]
RATE_UNITS = ["rad/s", "radian/s", "radians/s", "deg/s", "degree/s", "degrees/s"]
SIGNED_PI = r"[-+]\s*PI\b"


def _any_of(words: list[str], test: Callable[[str], Column]) -> Column:
    return reduce(lambda a, b: a | b, map(test, words))


def is_absolute_angle(name: Column, comment: Column) -> Column:
    """In radians, not a rate, and cyclic: by a range with PI in the comment, or by a part of the name."""
    text = F.lower(comment)
    close = F.regexp_replace(comment, r"\s", "")
    rate = _any_of(RATE_UNITS, F.lower(close).contains) | text.rlike(r"per\s+second")
    radians = F.arrays_overlap(F.split(text, "[^a-z0-9_]+"), F.array(*map(F.lit, RADIANS)))
    named = F.concat(F.lit("_"), F.lower(name), F.lit("_"))
    angle = _any_of([a for a in ANGLE_NAMES if "_" not in a], lambda a: named.contains(f"_{a}_")) | _any_of([a for a in ANGLE_NAMES if "_" in a], lambda a: named.startswith(f"_{a}_"))
    return ~rate & radians & (angle | close.contains("PI..") | comment.rlike(SIGNED_PI))


def signal_policy(type_: Column, name: Column, comment: Column, is_enum: Column, array_size: Column) -> Column:
    """struct(method, unit, confidence): the first rule that holds, as a CASE of nine."""
    name, comment = F.coalesce(name, F.lit("")), F.coalesce(comment, F.lit(""))
    text, unit = F.lower(comment), unit_of(comment)
    as_ = lambda method, u=None, c="high": F.struct(F.lit(method).alias("method"), (u if isinstance(u, Column) else F.lit(u).cast("string")).alias("unit"), F.lit(c).alias("confidence"))
    reset = name.startswith("delta_") | _any_of(RESET_WORDS, text.contains)
    shaped = name.isin("q", "q_d") | name.startswith("q_") | name.endswith("_q") | _any_of(QUATERNION_WORDS, text.contains)
    quaternion = (type_ == "float32") & (array_size == 4) & shaped
    hold, is_float = as_("discrete_hold"), type_.isin(FLOATS)
    return (
        F.when(type_ == "bool", hold).when(is_enum, hold).when(_any_of(DISCRETE_ENDS, name.endswith), hold).when(reset, hold)
        .when(F.coalesce(quaternion, F.lit(False)), as_("quaternion_slerp", "quaternion")).when(type_.isin(INTEGERS), hold)
        .when(is_float & is_absolute_angle(name, comment), as_("angle_wrap", F.coalesce(unit["unit"], F.lit("rad"))))
        .when(is_float & (unit["kind"] != "none"), as_("linear", unit["unit"]))
        .when(is_float, as_("linear", None, "low")).otherwise(as_("discrete_hold", None, "low"))
    )


# ---- units

# Factors of a topic's field, and labels of units by field.
SCALES = [("battery_status", "remaining", 10.0), ("battery_status", "discharged_mah", 0.01), ("battery_status", "internal_resistance_estimate", 1000.0), ("estimator_status", "time_slip", 1e6), ("vehicle_gps_position", "alt", 0.001)]
ANGLES = [("vehicle_attitude", "roll"), ("vehicle_attitude", "pitch"), ("vehicle_attitude", "yaw"), ("vehicle_attitude", "rollspeed"), ("vehicle_attitude", "pitchspeed"), ("vehicle_attitude", "yawspeed")]
UNITS = {
    "m": ["x", "y", "z", "alt", "altitude_msl_m", "baro_alt_meter", "current.alt", "dist_bottom", "current_distance", "variance", "eph", "epv", "hdop", "vdop"],
    "m/s": ["vx", "vy", "vz", "vel_m_s", "height_rate", "height_rate_setpoint", "true_airspeed_m_s", "true_ground_minus_wind_m_s", "indicated_airspeed_m_s", "true_airspeed_sp", "s_variance_m_s"],
    "C": ["temperature", "air_temperature_celsius"],
    "V": ["voltage_v", "ocv_estimate", "voltage5v_v"],
    "A": ["current_a"],
    "mAh / 100": ["discharged_mah"],
    "0=empty, 10=full": ["remaining"],
    "mOhm": ["internal_resistance_estimate"],
    "us": ["time_slip"],
}
UNIT_SHAPES = [("m/s^2", "^accelerometer_m_s2|^accel_vibration_metric$"), ("gauss", "^magnetometer_ga"), ("C", r"\.esc_temperature$"), ("V", "^sensors3v3"), ("RPM", r"\.esc_rpm$")]


def display_scale(topic: Column, field: Column, value: Column) -> Column:
    """A signal's value in the unit that it is shown in."""
    out = reduce(lambda acc, a: acc.when((topic == a[0]) & (field == a[1]), F.degrees(value)), ANGLES[1:], F.when((topic == ANGLES[0][0]) & (field == ANGLES[0][1]), F.degrees(value)))
    return reduce(lambda acc, s: acc.when((topic == s[0]) & (field == s[1]), value * s[2]), SCALES, out).otherwise(value)


def display_unit(topic: Column, field: Column) -> Column:
    angle = F.concat_ws(".", topic, field).isin([f"{t}.{f}" for t, f in ANGLES])
    out = F.when(angle & field.endswith("speed"), "deg/s").when(angle, "deg")
    out = reduce(lambda acc, kv: acc.when(field.isin(kv[1]), kv[0]), UNITS.items(), out)
    return reduce(lambda acc, kv: acc.when(field.rlike(kv[1]), kv[0]), UNIT_SHAPES, out)


def unit_hint(field: Column, hints: dict[str, str]) -> Column:
    """By the name before any index."""
    return F.create_map(*(F.lit(x) for kv in hints.items() for x in kv))[F.split(field, r"\[")[0]]


# ---- release types, levels, states


def release_suffix(kind: Column) -> Column:
    """Ranges of the version's last byte."""
    return F.when(kind < 64, "-dev").when(kind < 128, "-alpha").when(kind < 192, "-beta").when(kind < 255, "-rc").otherwise("")


def firmware_version(packed: Column) -> Column:
    """major.minor.patch and suffix out of four bytes."""
    at = lambda n: F.shiftright(packed.cast("long"), n).bitwiseAND(255)
    return F.concat(F.format_string("v%d.%d.%d", at(24), at(16), at(8)), release_suffix(at(0)))


LEVELS = ["EMERGENCY", "ALERT", "CRITICAL", "ERROR", "WARNING", "NOTICE", "INFO", "DEBUG"]


def level_name(level: Column) -> Column:
    """0-7 as number, digit or name; UNKNOWN otherwise."""
    n = level.cast("string").try_cast("int")
    return F.when(n.between(0, 7), F.array(*map(F.lit, LEVELS))[n]).when(F.upper(level.cast("string")).isin(LEVELS), F.upper(level.cast("string"))).otherwise("UNKNOWN")


def vtol_style(state: Column) -> Column:
    return F.when(state == 1, "transition").when(state.isin(2, 4), "fixed_wing").when(state == 3, "multirotor")


def vehicle_style(kind: Column) -> Column:
    return F.when(kind == 1, "multirotor").when(kind == 2, "fixed_wing")


def validated_airspeed(measured: Column, estimated: Column, valid: Column) -> Column:
    """The measured speed where its flag is set, the estimated one elsewhere; the other where that isn't finite."""
    m, e = finite(measured), finite(estimated)
    return F.when(valid, F.coalesce(m, e)).otherwise(F.coalesce(e, m))


# ---- texts and dates


def search_text(*columns: Column) -> Column:
    return F.concat_ws(" ", *(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns))


def split_csv(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != "")


def to_iso(text: Column) -> Column:
    """ISO 8601 in UTC out of a few usual formats; texts that are none stay."""
    formats = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    return F.coalesce(F.date_format(F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats)), "yyyy-MM-dd'T'HH:mm:ss'Z'"), text)


def iso_from_epoch(sec: Column) -> Column:
    return F.when(sec > 0, F.date_format(F.timestamp_seconds(sec), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def date_bound(text: str, end: bool = False) -> Column | None:
    """The start of a day, or of the next for an end; None for what is no date."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text or ""):
        return None
    day = F.try_to_timestamp(F.lit(text), F.lit("yyyy-MM-dd")).cast("date")
    return F.date_add(day, 1) if end else day


def local_log_id(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.concat_ws(":", F.lit("local"), F.element_at(parts, -2), F.element_at(parts, -1))


def plain_id(text: Column) -> Column:
    """An id without path separators; null otherwise."""
    return F.when(F.trim(text).rlike(r"^[^/\\\x00]+$") & ~F.trim(text).isin(".", ".."), F.trim(text))


def stable_id(prefix: str, *columns: Column) -> Column:
    """The prefix and twelve digits of a hash over the values, sorted by their names."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 12))


def distinct_in_order(values: Column) -> Column:
    """Distinct, blanks dropped, first places kept."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def decode_range(code: Column, ranges: list[tuple[int, int, str]]) -> Column:
    """The label of the range [start, start + count) that holds the code, with the place in it from 1 where it has several."""
    first = F.lit(None).cast("string")
    for start, count, label in reversed(ranges):
        named = F.lit(label) if count == 1 else F.concat(F.lit(label + " "), (code - start + 1).cast("string"))
        first = F.when((code >= start) & (code < start + count), named).otherwise(first)
    return first


def questioned_units(text: Column) -> Column:
    """`signal: u; reference: u` as a map."""
    return F.str_to_map(F.regexp_replace(F.trim(text), r"\s*([:;])\s*", "$1"), F.lit(";"), F.lit(":"))
