"""What parameters say about an airframe: control surfaces, their output channels, and a log's context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lines of evidence.
TOPIC_LINE = "ULog contains %s topic."
COUNT_LINE = "%s=%s"
SURFACE_LINE = "%s=%s (%s) maps to servo_%s."
CHANNEL_LINE = "%s=%s maps output channel to %s_%s."
# Names of parameters.
SURFACE, SURFACE_COUNT = r"^CA_SV_CS(\d+)_TYPE$", "CA_SV_CS_COUNT"
OUTPUT = r"^(PWM_(?:MAIN|AUX|FMU)_FUNC)(\d+)$"
AUTOSTART = "SYS_AUTOSTART"
EVIDENCE_TOPICS = ["actuator_servos", "actuator_motors", "vtol_vehicle_status"]


def surfaces(parameters: DataFrame, labels: DataFrame) -> DataFrame:
    """(log_id, servo, source_parameter, source_value, control_surface): surfaces that have a type, or that the count asks for.

    parameters: log_id, name, v; labels: code, label, few.  A code without a label is unknown.
    """
    typed = parameters.withColumn("_i", F.nullif(F.regexp_extract("name", SURFACE, 1), F.lit("")).cast("int")).filter("_i is not null")
    count = parameters.filter(F.col("name") == SURFACE_COUNT).filter("v >= 1")
    asked = count.select("log_id", F.explode(F.sequence(F.lit(0), F.col("v").cast("int") - 1)).alias("_i"))
    all_ = typed.select("log_id", "_i").unionByName(asked).distinct().join(typed.select("log_id", "_i", F.col("v").cast("long").alias("source_value")), ["log_id", "_i"], "left")
    named = all_.join(labels.select(F.col("code").alias("source_value"), "label"), "source_value", "left")
    parameter = F.concat(F.lit("CA_SV_CS"), F.col("_i").cast("string"), F.lit("_TYPE"))
    return named.select("log_id", (F.col("_i") + 1).alias("servo"), parameter.alias("source_parameter"), "source_value", F.coalesce("label", F.lit("unknown")).alias("control_surface"))


def outputs(parameters: DataFrame, definitions: DataFrame) -> DataFrame:
    """(log_id, parameter, channel, function_id, function, actuator_index) of output channels.

    definitions: start, count, function; a null count is an exact code, which comes before ranges.  Codes are few, so
    their ranges are a join on the code.
    """
    found = parameters.withColumn("_c", F.nullif(F.regexp_extract("name", OUTPUT, 2), F.lit("")).cast("int")).filter("_c is not null")
    codes = definitions.select(F.explode(F.sequence(F.col("start"), F.col("start") + F.coalesce("count", F.lit(1)) - 1)).alias("function_id"), "start", "count", "function")
    first = F.min(F.struct(F.col("count").isNotNull().alias("ranged"), "start", "function")).alias("d")
    known = codes.groupBy("function_id").agg(first)
    out = found.select("log_id", F.col("name").alias("parameter"), F.col("_c").alias("channel"), F.col("v").cast("long").alias("function_id")).join(known, "function_id", "left")
    index = F.when(F.col("d.ranged"), F.col("function_id") - F.col("d.start") + 1)
    return out.select("log_id", "parameter", "channel", "function_id", F.coalesce("d.function", F.lit("unknown")).alias("function"), index.alias("actuator_index"))


def surface_mapping(types: DataFrame, channels: DataFrame) -> DataFrame:
    """Servos of either side: their surface, unknown without a type, and their output channels by name."""
    per = channels.filter("function = 'servo'").groupBy("log_id", F.col("actuator_index").cast("int").alias("servo"))
    per = per.agg(F.array_sort(F.collect_list(F.struct("parameter", "function_id"))).alias("output_channels"))
    both = types.join(per, ["log_id", "servo"], "full_outer")
    none = F.array().cast("array<struct<parameter:string,function_id:bigint>>")
    return both.select("log_id", "servo", F.coalesce("control_surface", F.lit("unknown")).alias("control_surface"), "source_parameter", "source_value", F.coalesce("output_channels", none).alias("output_channels"))


def mapping_confidence(types: DataFrame, channels: DataFrame) -> DataFrame:
    """(log_id, confidence): medium if every typed servo has a channel, medium-low if not, low without types."""
    driven = channels.filter("function = 'servo'").select("log_id", F.col("actuator_index").cast("int").alias("servo"), F.lit(True).alias("_driven")).distinct()
    typed = types.join(driven, ["log_id", "servo"], "left").groupBy("log_id").agg(F.bool_and(F.coalesce("_driven", F.lit(False))).alias("_all"))
    logs = types.select("log_id").unionByName(channels.select("log_id")).distinct()
    level = F.when(F.col("_all"), "medium").when(~F.col("_all"), "medium-low").otherwise("low")
    return logs.join(typed, "log_id", "left").select("log_id", level.alias("confidence"))


def evidence(parameters: DataFrame, topics: DataFrame, types: DataFrame, channels: DataFrame) -> DataFrame:
    """(log_id, place, line): what a mapping rests on; topics first, then the count, surfaces, and channels."""
    of = lambda c: F.col(c).cast("string")
    logged = topics.filter(F.col("topic").isin(EVIDENCE_TOPICS)).select("log_id", "topic").distinct()
    place = F.array_position(F.array(*map(F.lit, EVIDENCE_TOPICS)), F.col("topic")).cast("int")
    count = parameters.filter(F.col("name") == SURFACE_COUNT)
    driven = channels.filter(F.col("function").isin("servo", "motor"))
    parts = [
        logged.select("log_id", F.struct(F.lit(0), place, F.lit("")).alias("place"), F.format_string(TOPIC_LINE, of("topic")).alias("line")),
        count.select("log_id", F.struct(F.lit(1), F.lit(0), F.lit("")).alias("place"), F.format_string(COUNT_LINE, F.lit(SURFACE_COUNT), F.col("v").cast("long").cast("string")).alias("line")),
        types.select("log_id", F.struct(F.lit(2), "servo", F.lit("")).alias("place"), F.format_string(SURFACE_LINE, of("source_parameter"), F.coalesce(of("source_value"), F.lit("None")), of("control_surface"), of("servo")).alias("line")),
        driven.select("log_id", F.struct(F.lit(3), F.lit(0), "parameter").alias("place"), F.format_string(CHANNEL_LINE, of("parameter"), of("function_id"), of("function"), of("actuator_index")).alias("line")),
    ]
    shape = "struct<part:int,number:int,name:string>"
    out = [p.select("log_id", F.col("place").cast(shape).alias("place"), "line") for p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def context(logs: DataFrame, parameters: DataFrame, mapping: DataFrame, confidence: DataFrame) -> DataFrame:
    """A row per log (log_id, firmware_version, git_hash, vehicle_type): with sys_autostart and a summary of its surfaces as JSON."""
    start = parameters.filter(F.col("name") == AUTOSTART).groupBy("log_id").agg(F.max(F.col("v").cast("long")).alias("sys_autostart"))
    per = mapping.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("servo", "control_surface", "output_channels"))).alias("servos"))
    out = logs.join(start, "log_id", "left").join(per, "log_id", "left").join(confidence, "log_id", "left")
    kind = F.lower(F.trim(F.coalesce(F.nullif("vehicle_type", F.lit("")), F.lit("unknown")))).alias("vehicle_type")
    summary = F.when(F.col("servos").isNull(), "unknown").otherwise(F.to_json(F.struct(kind, "servos", F.coalesce("confidence", F.lit("low")).alias("confidence"))))
    return out.select("log_id", "firmware_version", "git_hash", kind, "sys_autostart", F.substring(summary, 1, 2000).alias("control_surface_summary"))
