"""Series, downsampling, spectra and arithmetic."""

from pyspark.sql import functions as F

from ..functions import geo, scalar
from ..functions.expressions import compile_expression
from ..operators import downsample, series, spectra
from ..sources.tables import event_samples, micros, table
from . import query

START, END = 1704500000.0, 1705500000.0
S = "s AS (SELECT user_id AS multi_id, event_type AS field, epoch_us(ts) AS ts_us, round(epoch_us(ts) / 1e6, 6) AS t, event_id AS seq, value AS v FROM events)"
USER = ("multi_id",)
KEYS = ("multi_id", "field")


@query(f"""WITH {S}, l AS (SELECT *, lag(field) OVER w AS p, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY multi_id ORDER BY ts_us, seq))
SELECT multi_id, CASE WHEN rn = 1 THEN 'initial_value' ELSE 'value_changed' END AS event, field AS value, round(ts_us / 1e6, 3) AS time_s FROM l WHERE rn = 1 OR p IS DISTINCT FROM field""")
def timeline_changes(spark, d):
    return series.changes(event_samples(spark, d), "v_str", *USER).select("multi_id", "event", F.col("v_str").alias("value"), "time_s")


@query(f"""WITH {S}, l AS (SELECT *, lag(field) OVER (PARTITION BY multi_id ORDER BY ts_us, seq) AS p FROM s)
SELECT p AS from_state, field AS to_state, count(*) AS n FROM l WHERE p IS NOT NULL AND p <> field GROUP BY ALL""")
def transitions_from_to(spark, d):
    t = series.transitions(event_samples(spark, d), "v_str", False, *USER)
    return t.groupBy(F.col("from_value").alias("from_state"), F.col("to_value").alias("to_state")).agg(F.count("*").alias("n"))


@query(f"""WITH {S}, l AS (SELECT *, lag(field) OVER w AS p, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY multi_id ORDER BY ts_us, seq))
SELECT multi_id, count(*) AS n FROM l WHERE rn = 1 OR p <> field GROUP BY ALL""")
def transitions_with_first(spark, d):
    return series.transitions(event_samples(spark, d), "v_str", True, *USER).groupBy("multi_id").agg(F.count("*").alias("n"))


@query(f"""WITH {S}, k AS (SELECT *, row_number() OVER (PARTITION BY multi_id, t <= {START} ORDER BY ts_us DESC) AS rn FROM s WHERE t <= {END}),
c AS (SELECT multi_id, field, ts_us, seq, greatest(t, {START}) AS t FROM k WHERE t > {START} OR rn = 1),
r AS (SELECT * FROM (SELECT *, lag(field) OVER w AS p, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY multi_id ORDER BY ts_us, seq)) WHERE rn = 1 OR p <> field)
SELECT * FROM (SELECT multi_id, field AS value, t AS start_s, coalesce(lead(t) OVER (PARTITION BY multi_id ORDER BY ts_us, seq), {END}) AS end_s FROM r) WHERE end_s > start_s""")
def state_intervals(spark, d):
    return series.state_intervals(event_samples(spark, d), START, END, "v_str", *USER)


@query(f"""WITH {S}, w AS (SELECT * FROM s WHERE t BETWEEN {START} AND {END}), a AS (SELECT multi_id, field, count(*) AS count, count(v) AS n_finite, min(t) AS first_s, max(t) AS last_s, arg_min(v, ts_us) AS st, arg_max(v, ts_us) AS en, min(v) AS mi, max(v) AS ma, avg(v) AS me, median(v) AS md, stddev_pop(v) AS sd FROM w GROUP BY ALL)
SELECT multi_id, field, count, n_finite, first_s, last_s, CASE WHEN count >= 2 AND last_s > first_s THEN round((count - 1) / (last_s - first_s), 6) END AS rate_hz, round(st, 6) AS "start", round(en, 6) AS "end", round(mi, 6) AS min, round(ma, 6) AS max, round(me, 6) AS mean, round(md, 6) AS median, round(sd, 6) AS std, round(en - st, 6) AS delta FROM a""")
def signal_metrics(spark, d):
    return series.metrics(series.in_window(event_samples(spark, d), START, END), *KEYS)


@query(f"""WITH {S}, f AS (SELECT * FROM s WHERE multi_id = (SELECT min(multi_id) FROM s)), r(field) AS (VALUES ('click'), ('view'), ('absent')),
a AS (SELECT field, count(*) AS count, round(avg(v), 6) AS mean FROM f GROUP BY field)
SELECT r.field, coalesce(count, 0) AS count, mean, CASE WHEN count IS NULL THEN 'no samples for events.' || r.field END AS warning FROM r LEFT JOIN a USING (field)""")
def requested_metrics(spark, d):
    wanted = spark.createDataFrame([("events", f) for f in ("click", "view", "absent")], "topic string, field string")
    return series.requested_metrics(event_samples(spark, d), wanted).select("field", F.coalesce("count", F.lit(0)).alias("count"), "mean", "warning")


@query("SELECT user_id AS multi_id, event_type AS value, count(*) AS count FROM events GROUP BY ALL")
def value_counts(spark, d):
    return series.value_counts(event_samples(spark, d), "v_str", *USER).withColumnRenamed("v_str", "value")


@query("""SELECT event_type AS field, count(DISTINCT value) AS n_values, NOT (bool_and(value = floor(value)) AND count(DISTINCT value) <= 20) AS is_continuous FROM events GROUP BY ALL""")
def continuous_or_discrete(spark, d):
    return series.kinds(event_samples(spark, d), "field")


@query(f"""WITH {S} SELECT multi_id, seq, round((ts_us - p) / 1e6, 6) AS dt_s FROM (SELECT *, lag(ts_us) OVER (PARTITION BY multi_id ORDER BY ts_us, seq) AS p FROM s) WHERE p IS NOT NULL""")
def delta_t_regularity(spark, d):
    return series.intervals_between(event_samples(spark, d), *USER).select("multi_id", "seq", "dt_s")


@query(f"""WITH {S}, g AS (SELECT multi_id, ts_us - lag(ts_us) OVER (PARTITION BY multi_id ORDER BY ts_us, seq) AS g FROM s)
SELECT multi_id, round(median(g) / 1e6, 3) AS period_s FROM g WHERE g > 0 GROUP BY ALL""")
def sampling_period(spark, d):
    return series.sampling_period(event_samples(spark, d), 1e-9, *USER).select("multi_id", F.round("period_s", 3).alias("period_s")).filter("period_s is not null")


@query(f"""WITH {S}, a AS (SELECT multi_id, field, round(min(ts_us) / 1e6, 6) AS a, round(max(ts_us) / 1e6, 6) AS b FROM s GROUP BY ALL)
SELECT multi_id, field, a AS start_s, round(CASE WHEN a = b THEN b + 0.001 ELSE b END, 6) AS end_s FROM a""")
def signal_spans(spark, d):
    return series.spans(event_samples(spark, d), *KEYS).withColumn("end_s", F.round("end_s", 6))


@query("""SELECT round(min(epoch_us(ts)) / 1e6 - 0.05 * (max(epoch_us(ts)) / 1e6 - min(epoch_us(ts)) / 1e6), 3) AS start_s, round(max(epoch_us(ts)) / 1e6 + 0.05 * (max(epoch_us(ts)) / 1e6 - min(epoch_us(ts)) / 1e6), 3) AS end_s FROM events""")
def plot_range(spark, d):
    return series.plot_range(event_samples(spark, d)).select(F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"))


@query("""SELECT user_id AS multi_id, event_type AS field, count(value) > 0 AS has_finite, max(abs(value)) > 100 AS has_nonzero, bool_or(value <> 0) AS is_truthy, count(DISTINCT value) > 1 AS changes, bool_and(value IN (0, 1)) AS is_boolean FROM events GROUP BY ALL""")
def field_flags(spark, d):
    return series.field_flags(event_samples(spark, d), 100.0, *KEYS)


@query("""WITH m AS (SELECT event_type AS field, list_sort(list(abs(value)))[count(*) // 2 + 1] AS ma, list_sort(list(value))[count(*) // 2 + 1] AS mx, list(value) AS l FROM events GROUP BY ALL),
dv AS (SELECT field, ma, list_sort(list_transform(l, lambda x: abs(x - mx)))[len(l) // 2 + 1] AS md FROM m)
SELECT field, round(ma, 6) AS median_size, round(md, 6) AS median_deviation, round(greatest(1e-6, greatest(ma, md) * 1e-3), 9) AS tolerance FROM dv""")
def replay_tolerance(spark, d):
    out = series.upper_median_tolerance(event_samples(spark, d), None, "field")
    return out.select("field", F.round("median_size", 6).alias("median_size"), F.round("median_deviation", 6).alias("median_deviation"), F.round("tolerance", 9).alias("tolerance"))


@query(f"""WITH {S}, b AS (SELECT *, v > 50 AS b, max(t) OVER (PARTITION BY multi_id) AS l, lag(v > 50) OVER w AS p FROM s WINDOW w AS (PARTITION BY multi_id ORDER BY ts_us, seq)),
e AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY multi_id ORDER BY ts_us, seq), l) AS e FROM b WHERE p IS NULL OR p <> b)
SELECT multi_id, t AS start_s, e AS end_s FROM e WHERE b""")
def predicate_windows(spark, d):
    return series.true_windows(event_samples(spark, d), F.col("v") > 50, *USER)


@query("""WITH f AS (SELECT user_id AS multi_id, event_type AS x, min(ts) AS t FROM events GROUP BY ALL) SELECT multi_id, string_agg(x, ',' ORDER BY t) AS modes FROM f GROUP BY ALL""")
def modes_in_order(spark, d):
    return series.modes_in_order(event_samples(spark, d), "v_str", *USER).select("multi_id", F.array_join("modes", ",").alias("modes"))


@query(f"""WITH {S}, a AS (SELECT multi_id, field, ts_us, 'one' AS who FROM s WHERE field = 'click'), b AS (SELECT multi_id, field, ts_us, 'two' AS who FROM s WHERE v > 100)
SELECT multi_id, field, ts_us, max(who) AS who FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def merged_timelines(spark, d):
    s = event_samples(spark, d).select("multi_id", "field", "ts_us", "v")
    a, b = (x.drop("v").withColumn("who", F.lit(n)) for x, n in ((s.filter("field = 'click'"), "one"), (s.filter("v > 100"), "two")))
    return series.merge_timelines(a, b, by=["multi_id", "field", "ts_us"])


RANKED = f"WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY multi_id ORDER BY ts_us, seq) - 1 AS i, count(*) OVER (PARTITION BY multi_id) AS n FROM s)"


@query(f"{RANKED} SELECT multi_id, seq, v FROM r WHERE i % CAST(greatest(1, ceil(n / 20.0)) AS BIGINT) = 0 OR i = n - 1")
def downsample_stride(spark, d):
    return downsample.stride(event_samples(spark, d), 20, *USER).select("multi_id", "seq", "v")


_BOUND = """, k AS (SELECT *, sum(CAST(keep AS INT)) OVER (PARTITION BY multi_id) AS c, sum(CAST(keep AS INT)) OVER w - 1 AS rk, list_contains(list_transform(range(20), lambda j: CAST(floor(j * ((n - 1) / 19.0)) AS BIGINT)), i) AS even FROM m WINDOW w AS (PARTITION BY multi_id ORDER BY ts_us, seq)),
f AS (SELECT *, sum(CAST(even AND NOT keep AS INT)) OVER (PARTITION BY multi_id ORDER BY ts_us, seq) AS added FROM k)
SELECT multi_id, seq, v FROM f WHERE n <= 20 OR CASE WHEN c > 20 THEN keep AND list_contains(list_transform(range(20), lambda j: CAST(floor(j * ((c - 1) / 19.0)) AS BIGINT)), rk) ELSE keep OR (even AND added <= 20 - c) END"""


@query(f"""{RANKED}, b AS (SELECT *, CASE WHEN i BETWEEN 1 AND n - 2 THEN (SELECT max(j) FROM range(9) g(j) WHERE 1 + floor(j * (n - 2) / 9) <= i) END AS b FROM r),
x AS (SELECT *, CASE WHEN b IS NOT NULL THEN arg_min(i, [v, i]) OVER (PARTITION BY multi_id, b) END AS lo, CASE WHEN b IS NOT NULL THEN arg_max(i, [v, -i]) OVER (PARTITION BY multi_id, b) END AS hi FROM b),
m AS (SELECT *, coalesce(i = 0 OR i = n - 1 OR i = lo OR i = hi, false) AS keep FROM x){_BOUND}""")
def downsample_extrema(spark, d):
    return downsample.extrema(event_samples(spark, d), 20, *USER).select("multi_id", "seq", "v")


@query(f"""WITH {S}, q AS (SELECT multi_id, seq, ts_us, floor(v / 40) AS v FROM s), r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY multi_id) AS n, lag(v) OVER w AS p, lead(v) OVER w AS x FROM q WINDOW w AS (PARTITION BY multi_id ORDER BY ts_us, seq)),
m AS (SELECT *, i = 0 OR i = n - 1 OR p IS DISTINCT FROM v OR x IS DISTINCT FROM v AS keep FROM r){_BOUND}""")
def downsample_step(spark, d):
    return downsample.steps(event_samples(spark, d).withColumn("v", F.floor(F.col("v") / 40)), 20, *USER).select("multi_id", "seq", F.col("v").cast("double").alias("v"))


@query("""SELECT least(20, 1 + CAST(floor(l_quantity / 2.5) AS BIGINT)) AS x_bin, 1 + CAST(floor((l_discount + 0.00275) / 0.0055) AS BIGINT) AS y_bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY ALL""")
def hist2d(spark, d):
    return downsample.histogram2d(table(spark, d, "lineitem"), "l_quantity", "l_discount", 20, (0, 50), (-0.00275, 0.10725))


@query(f"""{RANKED}, p AS (SELECT *, v >= coalesce(lag(v) OVER w, '-inf'::DOUBLE) AND v >= coalesce(lead(v) OVER w, '-inf'::DOUBLE) AS p FROM r WINDOW w AS (PARTITION BY multi_id ORDER BY ts_us)),
a AS (SELECT *, bool_or(p) OVER (PARTITION BY multi_id) AS a FROM p), k AS (SELECT multi_id, seq, v, row_number() OVER (PARTITION BY multi_id ORDER BY v DESC, ts_us) AS rank FROM a WHERE p OR NOT a) SELECT * FROM k WHERE rank <= 3""")
def local_peaks(spark, d):
    return downsample.local_maxima(event_samples(spark, d), "ts_us", "v", 3, *USER).select("multi_id", "seq", "v", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100")
def page_of_orders(spark, d):
    o = table(spark, d, "orders")
    return downsample.page(o, [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc()], 50, 100).select("o_orderkey", "o_totalprice")


@query("""WITH x AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), k AS (SELECT unnest(range(33)) AS k),
p AS (SELECT vec_id, k, sum(CAST(x AS DOUBLE) * cos(i * k * 2 * pi() / 64)) AS c, sum(CAST(x AS DOUBLE) * sin(i * k * 2 * pi() / 64)) AS s FROM x, k GROUP BY ALL)
SELECT vec_id, CAST(k AS INT) AS k, round(sqrt(c * c + s * s) / 64 * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END, 6) AS amplitude FROM p""")
def dft_spectrum(spark, d):
    return spectra.dft(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 64).withColumn("amplitude", F.round("amplitude", 6))


def vector_samples(spark, d):
    """Each vector as a signal of 1 kHz."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return e.select(F.col("vec_id").alias("multi_id"), (F.col("i") * 1000).cast("long").alias("ts_us"), F.col("i").cast("long").alias("seq"), F.col("x").cast("double").alias("v"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), k AS (SELECT unnest(range(33)) AS k),
p AS (SELECT vec_id, k, sum(CAST(x AS DOUBLE) * cos(i * k * 2 * pi() / 64)) AS c, sum(CAST(x AS DOUBLE) * sin(i * k * 2 * pi() / 64)) AS s FROM x, k GROUP BY ALL)
SELECT vec_id AS multi_id, round(k * 1000 / 64.0, 6) AS frequency_hz, round(sqrt(c * c + s * s) / 64 * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END, 6) AS amplitude FROM p""")
def fft_spectrum(spark, d):
    return spectra.amplitude_spectrum(vector_samples(spark, d), ["multi_id"]).select("multi_id", F.round("frequency_hz", 6).alias("frequency_hz"), F.round("amplitude", 6).alias("amplitude"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), g AS (SELECT vec_id, i - 16 * s AS j, s, x FROM x, (SELECT unnest(range(3)) AS s) WHERE i BETWEEN 16 * s AND 16 * s + 31),
m AS (SELECT *, CAST(x AS DOUBLE) - avg(CAST(x AS DOUBLE)) OVER (PARTITION BY vec_id, s) AS y, 0.5 - 0.5 * cos(2 * pi() * j / 31) AS w FROM g), k AS (SELECT unnest(range(17)) AS k),
p AS (SELECT vec_id, s, k, sum(y * w * cos(2 * pi() * j * k / 32)) AS a, sum(y * w * sin(2 * pi() * j * k / 32)) AS b, sum(w * w) AS ww FROM m, k GROUP BY ALL)
SELECT vec_id AS multi_id, round((16 * s + 16) * 0.001, 6) AS time_s, round(k * 1000 / 32.0, 6) AS frequency_hz, round(10 * log10(greatest((a * a + b * b) / (1000 * ww) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END, 2.2250738585072014e-308)), 3) AS power_db FROM p WHERE k > 0""")
def spectrogram_windows(spark, d):
    s = spectra.spectrogram(vector_samples(spark, d), ["multi_id"], ["v"], 32, 16)
    return s.filter("frequency_hz > 0").select("multi_id", F.round("time_s", 6).alias("time_s"), F.round("frequency_hz", 6).alias("frequency_hz"), F.round("power_db", 3).alias("power_db"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), k AS (SELECT unnest(range(33)) AS k),
p AS (SELECT vec_id, k, sum(CAST(x AS DOUBLE) * cos(i * k * 2 * pi() / 64)) AS c, sum(CAST(x AS DOUBLE) * sin(i * k * 2 * pi() / 64)) AS s FROM x, k GROUP BY ALL)
SELECT vec_id AS multi_id, round(avg(sqrt(c * c + s * s) / 64 * 2), 6) AS mean_amplitude FROM p WHERE k * 1000 / 64.0 >= 40 AND k < 32 GROUP BY ALL""")
def spectrum_band_mean(spark, d):
    s = spectra.amplitude_spectrum(vector_samples(spark, d), ["multi_id"])
    return spectra.band_mean(s, 40.0, "multi_id").withColumn("mean_amplitude", F.round("mean_amplitude", 6))


@query("""WITH p AS (SELECT vec_id, embedding[1:5] AS e, unnest(range(5)) AS i FROM embeddings) SELECT vec_id * 1000 - (5 - i - 1) * 10 AS ts_us, CAST(i AS INT) AS i, round(CAST(e[i + 1] AS DOUBLE) * 0.5, 6) AS x FROM p""")
def fifo_unnest(spark, d):
    e = table(spark, d, "embeddings").select(F.lit("one").alias("log_id"), (F.col("vec_id") * 1000).alias("ts_us"), F.lit(10).alias("dt_us"), F.lit(5).alias("n"), F.lit(0.5).alias("scale"), F.col("embedding").cast("array<double>").alias("x"))
    return spectra.unpack_fifo(e, ["x"]).select("ts_us", "i", F.round("x", 6).alias("x"))


@query("SELECT vec_id, round(sqrt(CAST(embedding[1] AS DOUBLE)**2 + CAST(embedding[2] AS DOUBLE)**2 + CAST(embedding[3] AS DOUBLE)**2), 6) AS norm FROM embeddings")
def vector_norm(spark, d):
    x = [F.col("embedding")[i].cast("double") for i in range(3)]
    return table(spark, d, "embeddings").select("vec_id", F.round(geo.norm(*x), 6).alias("norm"))


_Q = "WITH q AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM embeddings)"


@query(f"""{_Q}, n AS (SELECT vec_id, a / l AS w, b / l AS x, c / l AS y, d / l AS z FROM (SELECT *, sqrt(a*a + b*b + c*c + d*d) AS l FROM q))
SELECT vec_id, round(degrees(atan2(2 * (w*x + y*z), 1 - 2 * (x*x + y*y))), 5) AS roll, round(degrees(asin(greatest(-1, least(1, 2 * (w*y - z*x))))), 5) AS pitch, round(degrees(atan2(2 * (w*z + x*y), 1 - 2 * (y*y + z*z))), 5) AS yaw FROM n""")
def quaternion_euler(spark, d):
    e = geo.quaternion_euler(*(F.col("embedding")[i].cast("double") for i in range(4)))
    return table(spark, d, "embeddings").select("vec_id", e.alias("e")).select("vec_id", *(F.round(F.col(f"e.{n}"), 5).alias(n) for n in ("roll", "pitch", "yaw")))


@query(f"""{_Q}, p AS (SELECT vec_id, radians(40 + a) AS la, radians(10 + b) AS lo, radians(40) AS l0, radians(10) AS o0 FROM q), k AS (SELECT *, acos(greatest(-1, least(1, sin(l0) * sin(la) + cos(l0) * cos(la) * cos(lo - o0)))) AS c FROM p), z AS (SELECT *, CASE WHEN abs(c) < 1e-12 THEN 1 ELSE c / sin(c) END AS k FROM k)
SELECT vec_id, round(k * (cos(l0) * sin(la) - sin(l0) * cos(la) * cos(lo - o0)) * 6371000, 2) AS x, round(k * cos(la) * sin(lo - o0) * 6371000, 2) AS y FROM z""")
def geo_projection(spark, d):
    e = lambda i: F.col("embedding")[i].cast("double")
    p = geo.project(e(0) + 40, e(1) + 10, F.lit(40.0), F.lit(10.0))
    return table(spark, d, "embeddings").select("vec_id", p.alias("p")).select("vec_id", F.round("p.x", 2).alias("x"), F.round("p.y", 2).alias("y"))


@query("""WITH q AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS n, CAST(embedding[2] AS DOUBLE) AS e, CAST(embedding[3] AS DOUBLE) AS d, CAST(embedding[4] AS DOUBLE) AS r, CAST(embedding[5] AS DOUBLE) AS p, CAST(embedding[6] AS DOUBLE) AS y FROM embeddings)
SELECT vec_id, round(n * cos(p) * cos(y) + e * cos(p) * sin(y) - d * sin(p), 6) AS forward, round(n * (sin(r) * sin(p) * cos(y) - cos(r) * sin(y)) + e * (sin(r) * sin(p) * sin(y) + cos(r) * cos(y)) + d * sin(r) * cos(p), 6) AS "right", round(n * (cos(r) * sin(p) * cos(y) + sin(r) * sin(y)) + e * (cos(r) * sin(p) * sin(y) - sin(r) * cos(y)) + d * cos(r) * cos(p), 6) AS down FROM q""")
def body_rotation(spark, d):
    b = geo.ned_to_body(*(F.col("embedding")[i].cast("double") for i in range(6)))
    return table(spark, d, "embeddings").select("vec_id", b.alias("b")).select("vec_id", *(F.round(F.col(f"b.{n}"), 6).alias(n) for n in ("forward", "right", "down")))


@query("""SELECT l_orderkey, l_linenumber, round((l_extendedprice * (1 - l_discount)) / (1 + l_tax), 6) AS net, CASE WHEN l_quantity > 25 THEN l_quantity * 2 ELSE greatest(l_quantity, 10) END AS boosted, (l_quantity >= 10 AND NOT l_tax = 0) OR l_discount > 0.09 AS flag FROM lineitem""")
def derived_expression(spark, d):
    t = table(spark, d, "lineitem")
    env = {"price": F.col("l_extendedprice"), "disc": F.col("l_discount"), "tax": F.col("l_tax"), "qty": F.col("l_quantity")}
    return t.select("l_orderkey", "l_linenumber", F.round(compile_expression("(price * (1.f - disc)) / (1 + tax)", env), 6).alias("net"), compile_expression("qty > 25 ? qty * 2 : fmaxf(qty, 10)", env).alias("boosted"), compile_expression("(qty >= 10 && !(tax == 0)) || disc > 0.09", env).alias("flag"))


@query("""SELECT l_orderkey, l_linenumber, (l_quantity - 30) - 7 * floor((l_quantity - 30) / 7) AS floored, CAST(CAST(l_partkey AS BIGINT) & 12 AS DOUBLE) AS masked, CAST((CAST(l_partkey AS BIGINT) | 1) << 2 AS DOUBLE) AS shifted, CASE WHEN l_tax = 0 THEN NULL ELSE round(l_quantity / l_tax, 4) END AS ratio, CASE WHEN l_quantity < 25 THEN NULL ELSE round(sqrt(l_quantity - 25), 6) END AS root FROM lineitem""")
def floored_mod_bitmask(spark, d):
    t = table(spark, d, "lineitem")
    env = {"q": F.col("l_quantity"), "p": F.col("l_partkey"), "t": F.col("l_tax")}
    c = lambda text: compile_expression(text, env)
    return t.select("l_orderkey", "l_linenumber", c("(q - 30) % 7").alias("floored"), c("p & 12").alias("masked"), c("(p | 1) << 2").alias("shifted"), F.round(c("q / t"), 4).alias("ratio"), F.round(c("sqrt(q - 25)"), 6).alias("root"))


@query("""SELECT event_id, round(epoch_us(ts) / 1e6, 6) AS t6, round(epoch_us(ts) / 1e6, 3) AS t3, least(greatest(value, 10.0), 100.0) AS clamped, (event_id & 5) <> 0 AS bit_set, abs(value - 50) <= 25 AS near FROM events""")
def clocks_and_clamps(spark, d):
    e = table(spark, d, "events")
    us = micros(F.col("ts"))
    return e.select("event_id", scalar.seconds(us).alias("t6"), scalar.seconds_ms(us).alias("t3"), scalar.clamp(F.col("value"), 10.0, 100.0).alias("clamped"), scalar.predicate_matches(F.col("event_id"), "bit_set", F.lit(5)).alias("bit_set"), scalar.compare(F.col("value"), "==", F.lit(50.0), 25.0).alias("near"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN value * 10 WHEN 1 THEN round(degrees(value), 6) WHEN 2 THEN value * 0.001 WHEN 3 THEN value * 1000000 ELSE value END AS shown, CASE event_id % 5 WHEN 0 THEN '0=empty, 10=full' WHEN 1 THEN 'deg' WHEN 2 THEN 'm' WHEN 3 THEN 'us' ELSE 'm/s' END AS unit FROM events""")
def unit_normalisation(spark, d):
    names = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(f).alias("f")) for t, f in (("battery_status", "remaining"), ("vehicle_attitude", "roll"), ("vehicle_gps_position", "alt"), ("estimator_status", "time_slip"), ("vehicle_local_position", "vx"))))
    e = table(spark, d, "events").withColumn("s", names[(F.col("event_id") % 5).cast("int")])
    shown = scalar.display_scale(F.col("s.t"), F.col("s.f"), F.col("value"))
    return e.select("event_id", F.when(F.col("event_id") % 5 == 1, F.round(shown, 6)).otherwise(shown).alias("shown"), scalar.display_unit(F.col("s.t"), F.col("s.f")).alias("unit"))
