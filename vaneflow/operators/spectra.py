"""Spectra: native transforms for short windows, Arrow batches for long series, and packed samples."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPECTRUM = "frequency_hz double, amplitude double"
SPECTROGRAM = "time_s double, frequency_hz double, power_db double"


def dft(rows: DataFrame, signal: str, n: int) -> DataFrame:
    """Amplitudes of a row's array of n values, one row per frequency index: sums of products with tables of sines, all in expressions."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n // 2))).alias("k")
    wide = rows.select("*", k)

    def part(f) -> Column:
        return F.aggregate(F.transform(F.col(signal), lambda x, i: x.cast("double") * f(i * F.col("k") * F.lit(2 * math.pi / n))), F.lit(0.0), lambda a, x: a + x)

    size = F.sqrt(F.pow(part(F.cos), 2.0) + F.pow(part(F.sin), 2.0)) / n
    edge = (F.col("k") == 0) | (F.lit(n % 2 == 0) & (F.col("k") == n // 2))
    return wide.withColumn("amplitude", F.when(edge, size).otherwise(size * 2)).drop(signal)


def _steps(ts: np.ndarray, min_rate_hz: float) -> float | None:
    d = np.diff(ts)
    d = d[d > 0]
    if not len(d) or not np.isfinite(ts).all():
        return None
    period = float(np.median(d)) * 1e-6
    return period if period <= 1 / min_rate_hz else None


def spectrum_of(ts_us: np.ndarray, x: np.ndarray, min_rate_hz: float = 100.0) -> tuple[np.ndarray, np.ndarray] | None:
    """One-sided amplitudes; None for series too slow, too short or not finite."""
    period = _steps(ts_us.astype(float), min_rate_hz)
    if period is None or len(x) < 2 or not np.isfinite(x).all():
        return None
    a = np.abs(np.fft.rfft(x)) / len(x)
    a[1 : len(a) - (len(x) % 2 == 0)] *= 2
    return np.fft.rfftfreq(len(x), period), a


def spectrum_points(amplitudes: np.ndarray, max_points: int) -> np.ndarray:
    """First, last, peak, and the highest of even parts, at most max_points."""
    n = len(amplitudes)
    if n <= max_points:
        return np.arange(n)
    chosen = {0, n - 1, int(amplitudes.argmax())}
    for part in np.array_split(np.arange(n), max(1, max_points - len(chosen))):
        if len(chosen) < max_points and len(part):
            chosen.add(int(part[amplitudes[part].argmax()]))
    for i in np.linspace(0, n - 1, max_points, dtype=int):
        if len(chosen) >= max_points:
            break
        chosen.add(int(i))
    return np.array(sorted(chosen))


def amplitude_spectrum(samples: DataFrame, keys: list[str], max_points: int = 2400, min_rate_hz: float = 100.0) -> DataFrame:
    """Per key (frequency_hz, amplitude).  A transform needs its series whole; long logs go by segments, see spectrogram."""
    schema = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys) + ", " + SPECTRUM

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_us", "seq"])
        got = spectrum_of(pdf["ts_us"].to_numpy(), pdf["v"].to_numpy(float), min_rate_hz)
        if got is None:
            return pd.DataFrame(columns=[*keys, "frequency_hz", "amplitude"])
        at = spectrum_points(got[1], max_points)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "frequency_hz": got[0][at], "amplitude": got[1][at]})

    return samples.select(*keys, "ts_us", "seq", "v").groupBy(*keys).applyInPandas(run, schema)


def band_mean(spectrum: DataFrame, start_hz: float, *keys: str) -> DataFrame:
    """Mean amplitude from start_hz on, without the last frequency."""
    top = spectrum.groupBy(*keys).agg(F.max("frequency_hz").alias("_top"))
    return spectrum.join(top, list(keys)).filter((F.col("frequency_hz") >= start_hz) & (F.col("frequency_hz") < F.col("_top"))).groupBy(*keys).agg(F.avg("amplitude").alias("mean_amplitude"))


def spectrogram(samples: DataFrame, keys: list[str], axes: list[str], window: int = 256, overlap: int = 128, min_rate_hz: float = 100.0, max_time_bins: int | None = None) -> DataFrame:
    """Power densities in dB, summed over the axes, of overlapping Hann windows.

    Samples are dealt to the windows that hold them by their rank, and each window is transformed on its own, so a long
    series is many small tasks.
    """
    step = window - overlap
    w = Window.partitionBy(*keys).orderBy("ts_us", "seq")
    ranked = samples.withColumns({"_i": F.row_number().over(w) - 1, "_d": F.when(F.col("ts_us") > F.lag("ts_us").over(w), F.col("ts_us") - F.lag("ts_us").over(w))})
    whole = ranked.groupBy(*keys).agg(F.count("*").alias("_n"), F.median("_d").alias("_m"))
    ranked = ranked.join(whole, keys).filter((F.col("_n") >= window) & (F.col("_m") * 1e-6 <= 1 / min_rate_hz))
    last = F.floor((F.col("_n") - window) / step)
    low, high = F.greatest(F.lit(0), F.ceil((F.col("_i") - window + 1) / step)), F.least(F.floor(F.col("_i") / step), last)
    seg = ranked.filter(low <= high).withColumn("segment", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    if max_time_bins is not None:
        count = last + 1
        spread = F.transform(F.sequence(F.lit(0), F.lit(max_time_bins - 1)), lambda j: F.floor(j * (count - 1) / F.lit(max(1, max_time_bins - 1))))
        seg = seg.filter((count <= max_time_bins) | F.array_contains(spread, F.col("segment").cast("long")))
    # a window's samples, window of them, lie in one row; Python transforms many rows at once
    each = F.array_sort(F.collect_list(F.struct("_i", "ts_us", *(F.col(a).cast("double").alias(a) for a in axes))))
    rows = seg.groupBy(*keys, "segment").agg(each.alias("_w"), F.any_value("_m").alias("_m"))
    rows = rows.select(*keys, "_m", F.col("_w")[window // 2]["ts_us"].alias("_at"), *(F.col("_w")[a].alias(f"_x{i}") for i, a in enumerate(axes)))
    schema = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys) + ", " + SPECTROGRAM

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hann, n = np.hanning(window), window // 2 + 1
        for b in batches:
            if not len(b):
                continue
            rate = 1e6 / b["_m"].to_numpy(float)
            power = np.zeros((len(b), n))
            for i in range(len(axes)):
                x = np.stack(b[f"_x{i}"].to_list()).astype(float)
                p = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * hann)) ** 2 / (rate * (hann @ hann))[:, None]
                p[:, 1:-1] *= 2
                power += p
            out = {k: np.repeat(b[k].to_numpy(), n) for k in keys}
            db = 10 * np.log10(np.maximum(power, np.finfo(float).tiny))
            yield pd.DataFrame(out | {"time_s": np.repeat(b["_at"].to_numpy() * 1e-6, n), "frequency_hz": (np.arange(n) / window * rate[:, None]).ravel(), "power_db": db.ravel()})

    return rows.mapInPandas(run, schema)


def unpack_fifo(packed: DataFrame, axes: list[str]) -> DataFrame:
    """One row per packed sample: the i-th of n at ts - (n - i - 1) * dt, values times scale.

    packed: keys, ts_us, dt_us, n, scale and an array for each axis.  A log with any row of bad metadata (no positive
    dt, n beyond an array, scale not finite) is left out whole.
    """
    sizes = F.least(*(F.size(a) for a in axes)) if len(axes) > 1 else F.size(axes[0])
    bad = (F.col("dt_us") <= 0) | (F.col("n") < 1) | (F.col("n") > sizes) | F.isnan("scale") | (F.abs("scale") == float("inf"))
    bad = F.coalesce(bad, F.lit(True))
    sound = packed.groupBy("log_id").agg(F.bool_or(bad).alias("_bad")).filter("not _bad").select("log_id")
    zipped = F.arrays_zip(*(F.slice(a, 1, F.col("n")).alias(a) for a in axes))
    rows = packed.join(sound, "log_id", "left_semi").select("log_id", "ts_us", "dt_us", "n", "scale", F.posexplode(zipped).alias("i", "z"))
    return rows.select("log_id", (F.col("ts_us") - (F.col("n") - F.col("i") - 1) * F.col("dt_us")).alias("ts_us"), "i", *((F.col("z")[a] * F.col("scale")).alias(a) for a in axes))

