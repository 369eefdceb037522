"""Series, as-of joins, intervals and downsampling on small fixtures and against plain Python."""

import bisect
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vaneflow.functions import geo, scalar
from vaneflow.operators import asof, downsample, intervals, series, spectra

RELAXED = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
COLS = "log_id string, topic string, multi_id long, field string, seq long, ts_us long, v double"


def samples(spark, topic, **fields):
    rows = []
    for f, (times, values) in fields.items():
        rows += [("log", topic, 0, f, i, int(t * 1e6), None if v is None else float(v)) for i, (t, v) in enumerate(zip(times, values, strict=True))]
    return spark.createDataFrame(rows, COLS)


def test_metrics_of_a_window(spark):
    s = samples(spark, "att", roll=([12, 12.5, 13, 18, 18.5], [0, 0.1, 0.4, 0.7, 1])).unionByName(samples(spark, "status", nav=([12, 13, 14, 18], [3, 3, 4, 4])))
    got = {r.field: r for r in series.metrics(series.in_window(s, 12.5, 18.0)).collect()}
    roll, nav = got["roll"], got["nav"]
    assert (roll["count"], roll.rate_hz, roll.start, roll.end, roll.min, roll.max, roll.mean, roll.median, roll["std"], roll.delta) == (3, 0.363636, 0.1, 0.7, 0.1, 0.7, 0.4, 0.4, 0.244949, 0.6)
    assert (nav["count"], nav.rate_hz) == (3, 0.4)
    inside = series.in_window(s.filter("field = 'nav'"), 12.5, 18.0)
    assert [(r.time_s, r.v) for r in series.transitions(inside, with_first=True).orderBy("ts_us").collect()] == [(13.0, 3.0), (14.0, 4.0)]
    assert [(r.time_s, r.v) for r in series.transitions(inside).collect()] == [(14.0, 4.0)]
    assert {r.v: r["count"] for r in series.value_counts(inside).collect()} == {3.0: 1, 4.0: 2}


def test_timeline(spark):
    s = samples(spark, "status", arming=([1, 2, 3], [1, 2, 2]), nav=([1, 2, 3], [0, 0, 3])).unionByName(samples(spark, "mission", seq_current=([1.5, 2.5, 3.5], [0, 1, 1])))
    got = [(r.time_s, r.field, r.event, r.v) for r in series.changes(s).orderBy("time_s", "field").collect()]
    assert got == [(1.0, "arming", "initial_value", 1.0), (1.0, "nav", "initial_value", 0.0), (1.5, "seq_current", "initial_value", 0.0), (2.0, "arming", "value_changed", 2.0), (2.5, "seq_current", "value_changed", 1.0), (3.0, "nav", "value_changed", 3.0)]


def test_stride_keeps_the_last_point(spark):
    s = samples(spark, "vehicle_attitude", roll=(range(10), range(10)))
    got = downsample.stride(s, 4).orderBy("ts_us").select("ts_us", F.round(scalar.display_scale(F.col("topic"), F.col("field"), F.col("v")), 6).alias("d")).collect()
    assert [(r.ts_us // 10**6, r.d) for r in got] == [(0, 0.0), (3, 171.887339), (6, 343.774677), (9, 515.662016)]
    assert downsample.stride(samples(spark, "t", x=(range(12), range(12))), 5).count() == 5
    assert downsample.stride(samples(spark, "t", x=(range(11), range(11))), 5).count() == 5


def test_nan_infinity_and_words_are_no_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), ("inf",), ("true",), (None,), (" 2 ",)], "x string")
    assert [r[0] for r in df.select(scalar.safe_float(F.col("x"))).collect()] == [1.5, None, None, None, None, 2.0]
    s = samples(spark, "t", x=([1, 2, 3], [1, math.nan, 3]))
    r = series.metrics(s).first()
    assert (r["count"], r.n_finite, r.max, r.mean) == (3, 2, 3.0, 2.0)


def test_three_clocks(spark):
    r = spark.createDataFrame([(1_234_567,)], "us long").select(scalar.seconds(F.col("us")).alias("a"), scalar.seconds_ms(F.col("us")).alias("b"), scalar.seconds_exact(F.col("us")).alias("c")).first()
    assert tuple(r) == (1.234567, 1.235, 1.234567)


def test_sampling_period(spark):
    s = samples(spark, "t", x=([0, 0.001, 0.002, 0.002, 1.002], [0] * 5))
    assert series.sampling_period(s).first().period_s == pytest.approx(0.001)
    assert series.sampling_period(samples(spark, "t", x=([0, 1, 2], [0] * 3))).first().period_s is None


SERIES = st.lists(st.tuples(st.integers(0, 60), st.integers(-5, 5)), min_size=0, max_size=25, unique_by=lambda x: x[0])


@RELAXED
@given(SERIES, SERIES, st.sampled_from([None, 7]))
def test_neighbours_are_bisection(spark, left, right, bucket):
    right = sorted(right)
    times = [t for t, _ in right]
    make = lambda rows: spark.createDataFrame([("k", t, i, float(v)) for i, (t, v) in enumerate(rows)], "k string, ts_us long, seq long, v double")
    got = {r.ts_us: r for r in asof.neighbours(make(left), make(right), ["k"], bucket_us=bucket).collect()}
    assert len(got) == len(left)
    for t, _ in left:
        p, n = bisect.bisect_right(times, t) - 1, bisect.bisect_left(times, t)
        assert got[t].prev_us == (times[p] if p >= 0 else None) and got[t].next_us == (times[n] if n < len(times) else None)


def test_methods_differ_beyond_the_span(spark):
    make = lambda rows: spark.createDataFrame([("k", t, i, v) for i, (t, v) in enumerate(rows)], "k string, ts_us long, seq long, v double")
    left, right = make([(0, 0.0), (10, 0.0), (15, 0.0), (20, 0.0), (30, 0.0)]), make([(10, 1.0), (20, 3.0)])
    at = lambda m, **o: [r.x for r in asof.align(left, right, ["k"], m, "x", **o).orderBy("ts_us").collect()]
    assert at("linear", clamped=True) == [1.0, 1.0, 2.0, 3.0, 3.0] and at("linear") == [None, 1.0, 2.0, 3.0, None]
    assert at("prior") == [None, 1.0, 1.0, 3.0, 3.0] and at("discrete_hold") == [None, 1.0, 1.0, 3.0, None]
    assert at("nearest", clamped=True) == [1.0, 1.0, 1.0, 3.0, 3.0] and at("quaternion_slerp") == [None] * 5
    nan = make([(10, 1.0), (20, math.nan)])
    assert [r.x for r in asof.align(left, nan, ["k"], "linear", "x").orderBy("ts_us").collect()][2] is None
    turn = make([(10, 3.0), (20, -3.0)])
    assert abs([r.x for r in asof.align(left, turn, ["k"], "angle_wrap", "x").orderBy("ts_us").collect()][2]) == pytest.approx(math.pi, abs=1e-6)


SPANS = st.lists(st.tuples(st.integers(0, 40), st.integers(0, 8)).map(lambda x: (float(x[0]), float(x[0] + x[1]))), max_size=15)


def merged(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def table(spark, spans):
    return spark.createDataFrame([("k", a, b) for a, b in spans], "k string, start_s double, end_s double")


@RELAXED
@given(SPANS, SPANS)
def test_interval_algebra(spark, left, right):
    a, b = table(spark, left), table(spark, right)
    rows = lambda df: sorted((r.start_s, r.end_s) for r in df.collect())
    assert rows(intervals.merge(a, "k")) == merged(left)
    strict = sorted((max(x[0], y[0]), min(x[1], y[1])) for x in left for y in right if max(x[0], y[0]) < min(x[1], y[1]))
    touching = sorted((max(x[0], y[0]), min(x[1], y[1])) for x in left for y in right if max(x[0], y[0]) <= min(x[1], y[1]))
    assert rows(intervals.intersect(a, b, "k")) == strict == rows(intervals.intersect(a, b, "k", bin_s=5.0))
    assert rows(intervals.intersect(a, b, "k", touching=True)) == touching
    if left:
        assert intervals.measure(a, "k").first().length_s == pytest.approx(sum(y - x for x, y in merged(left)))


def test_covering_and_gaps(spark):
    span = table(spark, [(0.0, 10.0)])
    assert intervals.covers(table(spark, [(0.0, 4.0), (4.0, 11.0)]), span, "k").first().covered is True
    assert intervals.covers(table(spark, [(0.0, 4.0), (5.0, 11.0)]), span, "k").first().covered is False
    assert [(r.start_s, r.end_s) for r in intervals.complement(table(spark, [(2.0, 4.0), (6.0, 7.0)]), span, "k").orderBy("start_s").collect()] == [(0.0, 2.0), (4.0, 6.0), (7.0, 10.0)]


def test_state_intervals_carry_in_and_close(spark):
    s = samples(spark, "t", x=([1, 2, 4, 6, 9], [1, 2, 2, 3, 4]))
    assert [(r.value, r.start_s, r.end_s) for r in series.state_intervals(s, 3.0, 8.0).orderBy("start_s").collect()] == [(2.0, 3.0, 6.0), (3.0, 6.0, 8.0)]


def test_true_windows(spark):
    s = samples(spark, "t", x=(range(6), [0, 1, 1, 0, None, 1]))
    assert [(r.start_s, r.end_s) for r in series.true_windows(s, F.col("v") > 0).orderBy("start_s").collect()] == [(1.0, 3.0), (5.0, 5.0)]


@RELAXED
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=60), st.integers(4, 20))
def test_downsampling_keeps_ends_and_extremes(spark, values, most):
    s = samples(spark, "t", x=(range(len(values)), values))
    for f in (downsample.extrema, downsample.steps):
        got = [(r.ts_us // 10**6, r.v) for r in f(s, most).orderBy("ts_us").collect()]
        assert len(got) <= max(most, 1) and got[0] == (0, values[0]) and got[-1] == (len(values) - 1, values[-1])
        if len(values) <= most:
            assert len(got) == len(values)


def test_spectrum(spark):
    t = np.arange(4096) / 1000
    x = 2 * np.sin(2 * np.pi * 50 * t) - 0.75 * np.sin(2 * np.pi * 125 * t)
    got = spectra.amplitude_spectrum(samples(spark, "t", x=(t, x)).drop("log_id", "topic", "multi_id"), ["field"], 64).toPandas()
    assert len(got) <= 64
    top = got.sort_values("amplitude")["frequency_hz"].tolist()
    assert abs(top[-1] - 50) < 0.25 and any(abs(f - 125) < 0.25 for f in got["frequency_hz"])


def test_spectrogram(spark):
    t = np.arange(1024) / 1000 + 5
    x = np.sin(2 * np.pi * 50 * t) + 0.5 * np.sin(2 * np.pi * 120 * t)
    got = spectra.spectrogram(samples(spark, "t", x=(t, x)).drop("log_id", "topic", "multi_id"), ["field"], ["v"], max_time_bins=3).toPandas()
    assert got["time_s"].nunique() == 3 and len(got) == 3 * 129 and got["time_s"].min() == pytest.approx(5.128)


def test_fifo(spark):
    rows = [("log", 100, 10, 2, 0.5, [-2.0, -4.0, 9.0]), ("log", 300, 20, 3, -2.0, [1.0, 2.0, 3.0]), ("bad", 300, 0, 3, 1.0, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "log_id string, ts_us long, dt_us int, n int, scale double, x array<double>")
    assert [(r.ts_us, r.x) for r in spectra.unpack_fifo(df, ["x"]).orderBy("ts_us").collect()] == [(90, -1.0), (100, -2.0), (260, -2.0), (280, -4.0), (300, -6.0)]


def test_geometry(spark):
    one = spark.range(1)
    q = one.select(geo.quaternion_euler(F.lit(math.cos(0.25)), F.lit(0.0), F.lit(0.0), F.lit(math.sin(0.25))).alias("e")).first().e
    assert q.yaw == pytest.approx(math.degrees(0.5)) and q.roll == pytest.approx(0)
    b = one.select(geo.ned_to_body(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(math.pi / 2)).alias("b")).first().b
    assert b.forward == pytest.approx(1) and b.right == pytest.approx(0)
    p = one.select(geo.project(F.lit(0.001), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("p")).first().p
    assert p.x == pytest.approx(math.radians(0.001) * 6_371_000) and p.y == 0
    assert one.select(geo.project(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("p")).first().p.x == 0


def test_upper_median(spark):
    r = series.upper_median_tolerance(samples(spark, "t", x=(range(4), [1, 2, 30, 40]))).first()
    assert r.median_size == 30.0 and r.tolerance == pytest.approx(0.03)
    assert series.upper_median_tolerance(samples(spark, "t", x=(range(2), [0, 0]))).first().tolerance == pytest.approx(1e-6)


@pytest.mark.parametrize(("touching", "bin_s"), [(False, 24.0), (True, 3.0), (False, None)])
def test_overlaps_are_counted_with_their_copies(spark, touching, bin_s):
    a = spark.createDataFrame([(k, float(i), float(i + 2)) for k in "uv" for i in range(6) for _ in range(i + 1)], "k string, start_s double, end_s double")
    b = spark.createDataFrame([("u", float(i), float(i + 3)) for i in range(0, 9, 2) for _ in range(4)], "k string, start_s double, end_s double")
    want = intervals.intersect(a, b, "k", touching=touching, bin_s=bin_s).groupBy("k", "start_s", "end_s").agg(F.count("*").alias("n"))
    got = intervals.overlap_counts(a, b, "k", touching=touching, bin_s=bin_s)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5
