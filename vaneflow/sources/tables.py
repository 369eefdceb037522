"""Driver tables as samples and other inputs of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp, with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: users are instances of one topic, event types its fields."""
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("events").alias("log_id"), F.lit("events").alias("topic"), F.col("user_id").alias("multi_id"), F.col("event_type").alias("field"), F.col("event_id").alias("seq"), micros(F.col("ts")).alias("ts_us"), F.col("value").alias("v"), F.col("event_type").alias("v_str"))


def topic_catalogue(samples: DataFrame) -> DataFrame:
    return samples.groupBy("log_id", "topic", "multi_id", "field").agg(F.count("*").alias("sample_count"))
