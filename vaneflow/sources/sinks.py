"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import gps_degrees, valid_fix


def parameter_lines(rows: DataFrame, non_default_only: bool = False) -> DataFrame:
    """Parameters as tab-separated lines for ground stations: vehicle, component, name, value, type (6 whole, 9 real)."""
    d = rows.filter("status = 'non_default'") if non_default_only else rows
    whole = F.col("v") == F.floor("v")
    text = F.when(whole, F.col("v").cast("long").cast("string")).otherwise(F.col("v").cast("string"))
    return d.select("name", F.concat_ws("\t", F.lit("1"), F.lit("1"), "name", text, F.when(whole, "6").otherwise("9")).alias("line"))


def write_parameter_file(rows: DataFrame, path: str, non_default_only: bool = False) -> None:
    lines = parameter_lines(rows, non_default_only)
    head = rows.sparkSession.createDataFrame([("", "# Vehicle-Id\tComponent-Id\tName\tValue\tType")], "name string, line string")
    head.unionByName(lines).repartitionByRange(1, "name").sortWithinPartitions("name").select("line").write.text(path)  # one small file


def gps_track(fixes: DataFrame) -> DataFrame:
    """(log_id, seq, lat, lon, alt) of sound fixes, whichever units the log has."""
    p = fixes.withColumn("_p", gps_degrees(F.col("version"), F.col("lat"), F.col("lon"), F.col("alt")))
    return p.filter(valid_fix(F.col("fix_type"), F.col("_p.lat"), F.col("_p.lon"), F.col("_p.alt"))).select("log_id", "seq", "_p.lat", "_p.lon", "_p.alt")


def kml_coordinates(track: DataFrame) -> DataFrame:
    """(log_id, coordinates): lon,lat,alt of each point in order."""
    point = F.format_string("%.9f,%.9f,%.3f", F.col("lon"), F.col("lat"), F.col("alt"))
    return track.groupBy("log_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", point.alias("p")))), lambda x: x["p"]), " ").alias("coordinates"))


def kml(track: DataFrame) -> DataFrame:
    head, tail = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><LineString><altitudeMode>absolute</altitudeMode><coordinates>', "</coordinates></LineString></Placemark></Document></kml>"
    return kml_coordinates(track).select("log_id", F.concat(F.lit(head), F.col("coordinates"), F.lit(tail)).alias("kml"))


def write_samples(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by topic, so that readers see the topics that they ask for only, and sorted by signal and time."""
    samples.repartition("topic", "log_id").sortWithinPartitions("log_id", "multi_id", "field", "ts_us", "seq").write.mode(mode).partitionBy("topic").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def replace_record(records: DataFrame, path: str, key: str) -> None:
    """One folder per record; writing a record again takes its place only."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)


def fact_key(*columns: Column) -> Column:
    """Where facts of a file's content are kept: equal content has an equal key, whatever the commit."""
    return F.sha2(F.concat_ws("\x1f", *columns), 256)
