"""Streams of samples: windows with late data, sessions and changes as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def windowed(samples: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Counts and sums of event-time windows; the same function serves batches and streams."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return samples.withWatermark(time, late).groupBy(w, "field").agg(F.count("*").alias("n"), F.sum("v").alias("sum_v")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "field", "n", "sum_v")


def sessions(samples: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    return samples.withWatermark(time, late).groupBy(F.session_window(time, gap), "multi_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "multi_id", "n")


class _Changes(StatefulProcessor):
    """Keeps each key's last value; state lasts from batch to batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "v double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.last.exists()
        before = self.last.get()[0] if known else None
        # a micro-batch's rows of a key come in any order, so they are sorted together, once
        pdf = pd.concat(list(rows)).sort_values(["ts_us", "seq"])
        last = pdf["v"].shift()
        last.iloc[0] = before
        moved = (pdf["v"] != last).to_numpy()
        moved[0] |= not known
        out = pdf.loc[moved, ["ts_us", "v"]].copy()
        for name, value in zip(("multi_id", "field"), key, strict=True):
            out.insert(0 if name == "multi_id" else 1, name, value)
        out["event"] = "value_changed"
        if not known:
            out.iloc[0, out.columns.get_loc("event")] = "initial_value"
        self.last.update((float(pdf["v"].iloc[-1]),))
        yield out

    def close(self) -> None:
        pass


def changes(samples: DataFrame) -> DataFrame:
    """Changes of each (multi_id, field) of a stream, in the order in which batches bring them.  Needs the RocksDB state store."""
    return samples.groupBy("multi_id", "field").transformWithStateInPandas(_Changes(), "multi_id long, field string, ts_us long, v double, event string", "Update", "None")
