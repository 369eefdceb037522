"""Parameters, messages and topics of logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import level_name, seconds, values_equal


def with_defaults(parameters: DataFrame, airframe: DataFrame, system: DataFrame, metadata: DataFrame, changed: DataFrame) -> DataFrame:
    """Every parameter with its default, the airframe's first, then the system's, then the metadata's, and where it comes from."""
    side = lambda d, n: d.select("name", F.col("v").alias(n))
    d = parameters.join(side(airframe, "_a"), "name", "left").join(side(system, "_s"), "name", "left").join(side(metadata, "_m"), "name", "left")
    d = d.join(changed.select("name").distinct().withColumn("changed", F.lit(True)), "name", "left")
    default = F.coalesce("_a", "_s", "_m")
    source = F.when(F.col("_a").isNotNull(), "airframe").when(F.col("_s").isNotNull(), "system").when(F.col("_m").isNotNull(), "metadata").otherwise("none")
    status = F.when(default.isNull(), "unknown").when(values_equal(F.col("v").cast("string"), default.cast("string")), "default").otherwise("non_default")
    return d.select("name", "v", default.alias("default_v"), source.alias("default_source"), status.alias("status"), F.coalesce("changed", F.lit(False)).alias("changed"))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "non_default").alias("non_default"), F.count_if(F.col("status") == "unknown").alias("unknown"), F.count_if("changed").alias("changed"))


def observed_instances(topics: DataFrame) -> DataFrame:
    """Per (topic, instance): its fields and samples."""
    return topics.groupBy("topic", "multi_id").agg(F.array_sort(F.collect_set("field")).alias("fields"), F.max("sample_count").alias("sample_count"))


def topic_rows(available: DataFrame, fields: DataFrame, missing: DataFrame) -> DataFrame:
    """All topics that are available, have fields or are missed, each with flags."""
    flag = lambda d, n: d.select("topic").distinct().withColumn(n, F.lit(True))
    out = flag(available, "is_available").join(flag(fields, "has_fields"), "topic", "full_outer").join(flag(missing, "is_missing"), "topic", "full_outer")
    return out.fillna(False, ["is_available", "has_fields", "is_missing"])


def with_euler_fields(topics: DataFrame) -> DataFrame:
    """Topics' fields, with the angles where all four quaternion components are there."""
    f = topics.groupBy("topic").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    q = F.array(*(F.lit(f"q[{i}]") for i in range(4)))
    full = F.size(F.array_intersect(q, F.col("fields"))) == 4
    return f.withColumn("fields", F.when(full, F.array_sort(F.array_union("fields", F.array(F.lit("roll"), F.lit("pitch"), F.lit("yaw"))))).otherwise(F.col("fields")))


def messages(events: DataFrame, texts: DataFrame) -> DataFrame:
    """Events and logged texts as one, those that end in a tab left out, level names, in time order by their columns."""
    cols = ["ts_us", "level", "message"]
    both = events.select(*cols, F.lit("event").alias("source")).unionByName(texts.filter(~F.col("message").endswith("\t")).select(*cols, F.lit("logged_message").alias("source")))
    return both.withColumns({"level": level_name(F.col("level")), "time_s": seconds(F.col("ts_us"))}).orderBy(F.asc_nulls_last("ts_us"), "source", "message")


def warnings(messages_: DataFrame, dropouts: DataFrame) -> DataFrame:
    """Messages of at least warning level, and dropouts."""
    bad = messages_.filter(F.col("level").isin("EMERGENCY", "ALERT", "CRITICAL", "ERROR", "WARNING")).select("ts_us", "message")
    return bad.unionByName(dropouts.select("ts_us", F.format_string("dropout of %d ms", F.col("duration_ms")).alias("message")))


def error_count(messages_: DataFrame, *keys: str) -> DataFrame:
    return messages_.groupBy(*keys).agg(F.count_if(F.col("level").isin("EMERGENCY", "ALERT", "CRITICAL", "ERROR")).alias("errors"))


def resolve(references: DataFrame, topics: DataFrame) -> DataFrame:
    """Signals by name: observed, ambiguous if several instances fit, unavailable."""
    from ..functions.scalar import parse_signal

    r = references.withColumn("_p", parse_signal(F.col("signal"))).select("signal", F.col("_p.topic").alias("topic"), F.col("_p.multi_id").alias("_m"), F.col("_p.field").alias("field"))
    t = topics.select("topic", "field", "multi_id").distinct()
    hit = r.join(t, ["topic", "field"]).filter(F.col("_m").isNull() | (F.col("_m") == F.col("multi_id")))
    n = hit.groupBy("signal").agg(F.count("*").alias("n"), F.min("multi_id").alias("multi_id"))
    return references.select("signal").distinct().join(n, "signal", "left").select("signal", F.when(F.col("n") == 1, F.col("multi_id")).alias("multi_id"), F.when(F.col("n").isNull(), "unavailable").when(F.col("n") == 1, "observed").otherwise("ambiguous").alias("status"))


def suffix_resolve(references: DataFrame, fields: DataFrame) -> DataFrame:
    """(topic, field) to the schema's field: exact, or the only one that ends in it."""
    r, f = references.select("topic", "field").distinct(), fields.select("topic", F.col("field").alias("known")).distinct()
    j = r.join(f, "topic").filter((F.col("known") == F.col("field")) | F.col("known").endswith(F.concat(F.lit("."), F.col("field"))))
    agg = j.groupBy("topic", "field").agg(F.max(F.when(F.col("known") == F.col("field"), F.col("known"))).alias("_e"), F.count("*").alias("_n"), F.min("known").alias("_k"))
    return agg.select("topic", "field", F.coalesce("_e", F.when(F.col("_n") == 1, F.col("_k"))).alias("resolved")).filter("resolved is not null")


def actuator_mapping(servos: DataFrame, outputs: DataFrame) -> DataFrame:
    """Servo kinds and output channels by servo, either side may be missing; channels in order."""
    channels = outputs.groupBy("servo").agg(F.array_sort(F.collect_list(F.struct("channel", "function"))).alias("channels"))
    return servos.join(channels, "servo", "full_outer").select("servo", "kind", F.transform("channels", lambda c: c["channel"]).alias("channels"))


def observed_kind(values: DataFrame, *keys: str) -> DataFrame:
    """The only value there is, else unknown."""
    agg = values.groupBy(*keys).agg(F.count_distinct("v").alias("_n"), F.min("v").alias("_v"))
    return agg.select(*keys, F.when(F.col("_n") == 1, F.col("_v")).alias("v"), F.when(F.col("_n") == 1, "observed").otherwise("unknown").alias("status"))


def latest_by(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key: what merging of files and caches needs."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order.desc()))).filter("_n = 1").drop("_n")


def indexed_fields(topics: DataFrame, prefix: str, suffix: str = "") -> DataFrame:
    """Fields `prefix[n]suffix` of each topic with their n, the elements of arrays."""
    n = F.regexp_extract("field", rf"^{re.escape(prefix)}\[(\d+)\]{re.escape(suffix)}$", 1)
    return topics.select("topic", "field", F.nullif(n, F.lit("")).cast("int").alias("n")).filter("n is not null").distinct()


def renamed(samples: DataFrame, names: dict[tuple[str, str], str]) -> DataFrame:
    """Fields of older logs under their newer names ((topic, old): new), where the log doesn't have the newer one itself."""
    spark = samples.sparkSession
    table = F.broadcast(spark.createDataFrame([(t, o, n) for (t, o), n in names.items()], "topic string, field string, _new string"))  # the declared names
    own = samples.join(table, ["topic", "field"], "left")
    have = samples.select("log_id", "topic", F.col("field").alias("_new")).distinct().withColumn("_has", F.lit(True))
    out = own.join(have, ["log_id", "topic", "_new"], "left")
    return out.withColumn("field", F.when(F.col("_new").isNotNull() & F.col("_has").isNull(), F.col("_new")).otherwise(F.col("field"))).select(*samples.columns)


def only_matches(dependencies: DataFrame, inputs: DataFrame) -> DataFrame:
    """(dependency, input): inputs whose provenance holds the dependency, where there is just one.

    An input may have several rows, each with a part of its provenance.  Where the least and the largest input are one there
    is no other, so a dependency takes two values and no list of inputs.
    """
    hit = inputs.select("input", F.explode("provenance").alias("dependency"))
    one = hit.groupBy("dependency").agg(F.min("input").alias("input"), F.max("input").alias("_last")).filter("input = _last")
    return one.select("dependency", "input").join(dependencies.select("dependency"), "dependency", "left_semi")


def applicability(candidates: DataFrame, required: DataFrame, available: DataFrame, predicates: DataFrame) -> DataFrame:
    """(candidate, status): excluded if a parameter predicate is false, unresolved if a signal is missing or a predicate unknown, else supported."""
    lacks = required.join(available, "signal", "left_anti").groupBy("candidate").agg(F.count("*").alias("_missing"))
    p = predicates.groupBy("candidate").agg(F.bool_or(~F.col("holds")).alias("_false"), F.bool_or(F.col("holds").isNull()).alias("_open"))
    out = candidates.join(lacks, "candidate", "left").join(p, "candidate", "left")
    status = F.when(F.coalesce("_false", F.lit(False)), "excluded").when((F.coalesce("_missing", F.lit(0)) > 0) | F.coalesce("_open", F.lit(False)), "unresolved").otherwise("supported")
    return out.select("candidate", status.alias("status"))
