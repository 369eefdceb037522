"""As-of joins, union timelines and interval algebra."""

from pyspark.sql import functions as F

from ..operators import asof, intervals, series
from ..sources.tables import event_samples, micros, table
from . import query
from .signals import END, START, USER, S

C = f"WITH {S}, a AS (SELECT multi_id, seq, ts_us, v FROM s WHERE field = 'click'), b AS (SELECT multi_id, seq, ts_us, v FROM s WHERE field = 'purchase')"
NB = f"""{C}, p AS (SELECT a.*, b.ts_us AS pt, b.v AS pv FROM a ASOF LEFT JOIN b ON a.multi_id = b.multi_id AND a.ts_us >= b.ts_us),
n AS (SELECT p.*, b.ts_us AS nt, b.v AS nv FROM p ASOF LEFT JOIN b ON p.multi_id = b.multi_id AND p.ts_us <= b.ts_us)"""


def pair(spark, d):
    s = event_samples(spark, d)
    return tuple(s.filter(F.col("field") == f).select("multi_id", "seq", "ts_us", "v") for f in ("click", "purchase"))


def aligned(spark, d, method, clamped=False, bucket_us=None):
    return asof.align(*pair(spark, d), ["multi_id"], method, "other", clamped, bucket_us).select("multi_id", "seq", F.round("other", 6).alias("other"))


@query(f"{NB} SELECT multi_id, seq, pv AS other FROM n")
def asof_prior(spark, d):
    return aligned(spark, d, "prior")


@query(f"{NB} SELECT multi_id, seq, pv AS other FROM n")
def asof_prior_in_buckets(spark, d):
    return aligned(spark, d, "prior", False, 3 * 86_400_000_000)


@query(f"{NB} SELECT multi_id, seq, CASE WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv WHEN ts_us - pt <= nt - ts_us THEN pv ELSE nv END AS other FROM n")
def asof_nearest(spark, d):
    return aligned(spark, d, "nearest", True)


LINEAR = "CASE WHEN pv IS NULL OR nv IS NULL THEN NULL WHEN pt = nt THEN pv ELSE pv + (ts_us - pt) / CAST(nt - pt AS DOUBLE) * (nv - pv) END"


@query(f"{NB} SELECT multi_id, seq, round({LINEAR}, 6) AS other FROM n")
def interp_linear(spark, d):
    return aligned(spark, d, "linear")


@query(f"{NB} SELECT multi_id, seq, round(coalesce({LINEAR}, pv, nv), 6) AS other FROM n")
def interp_linear_clamped(spark, d):
    return aligned(spark, d, "linear", True, 86_400_000_000)


@query(f"{NB} SELECT multi_id, seq, CASE WHEN nv IS NOT NULL THEN pv END AS other FROM n")
def policy_hold(spark, d):
    return aligned(spark, d, "discrete_hold")


@query(f"""{NB}, r AS (SELECT *, nv / 100 - pv / 100 AS dv, pv / 100 AS p FROM n), w AS (SELECT *, dv - 2 * pi() * floor((dv + pi()) / (2 * pi())) AS arc FROM r), x AS (SELECT *, p + CASE WHEN nt = pt THEN 0 ELSE (ts_us - pt) / CAST(nt - pt AS DOUBLE) END * arc AS x FROM w)
SELECT multi_id, seq, round(x - 2 * pi() * floor((x + pi()) / (2 * pi())), 5) AS other FROM x""")
def policy_angle_wrap(spark, d):
    a, b = pair(spark, d)
    return asof.align(a, b.withColumn("v", F.col("v") / 100), ["multi_id"], "angle_wrap", "other").select("multi_id", "seq", F.round("other", 5).alias("other"))


@query(f"""{NB}, e AS (SELECT multi_id, v - ({LINEAR}) AS e FROM n WHERE pv IS NOT NULL AND nv IS NOT NULL)
SELECT multi_id, count(*) AS n, round(max(abs(e)), 6) AS max_abs, round(max(e), 6) AS above, round(max(-e), 6) AS below FROM e GROUP BY ALL""")
def tracking_errors(spark, d):
    e = asof.errors(*pair(spark, d), ["multi_id"])
    return e.groupBy("multi_id").agg(F.count("*").alias("n"), F.round(F.max(F.abs("error")), 6).alias("max_abs"), F.round(F.max("error"), 6).alias("above"), F.round(F.max(-F.col("error")), 6).alias("below"))


UT = f"""WITH {S}, u AS (SELECT * FROM s WHERE field IN ('click', 'view')),
w AS (SELECT multi_id, ts_us, last_value(CASE WHEN field = 'click' THEN v END IGNORE NULLS) OVER k AS x, last_value(CASE WHEN field = 'view' THEN v END IGNORE NULLS) OVER k AS y,
 greatest(min(CASE WHEN field = 'click' THEN ts_us END) OVER g, min(CASE WHEN field = 'view' THEN ts_us END) OVER g) AS a, least(max(CASE WHEN field = 'click' THEN ts_us END) OVER g, max(CASE WHEN field = 'view' THEN ts_us END) OVER g) AS b
 FROM u WINDOW k AS (PARTITION BY multi_id ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY multi_id)),
t AS (SELECT multi_id, ts_us, x, y FROM w WHERE x IS NOT NULL AND y IS NOT NULL AND ts_us BETWEEN a AND b)"""


def timeline(spark, d):
    return asof.union_timeline(event_samples(spark, d), {"click": "x", "view": "y"}, ["multi_id"])


@query(f"{UT} SELECT * FROM t")
def union_timeline(spark, d):
    return timeline(spark, d)


@query(f"""{UT}, c AS (SELECT *, x > y + 20 AS c, round(ts_us / 1e6, 6) AS s FROM t), e AS (SELECT *, lag(c) OVER w AS p, max(s) OVER (PARTITION BY multi_id) AS l FROM c WINDOW w AS (PARTITION BY multi_id ORDER BY ts_us)),
r AS (SELECT multi_id, c, s, coalesce(lead(s) OVER (PARTITION BY multi_id ORDER BY ts_us), l) AS e FROM e WHERE p IS NULL OR p <> c) SELECT multi_id, s AS start_s, e AS end_s FROM r WHERE c""")
def union_timeline_predicate(spark, d):
    return series.true_windows(timeline(spark, d).withColumn("seq", F.lit(0)), F.col("x") > F.col("y") + 20, *USER)


@query(f"""{NB}, l AS (SELECT multi_id, seq, v, coalesce({LINEAR}, pv, nv) AS y FROM n) SELECT multi_id, seq, round(v + y, 6) AS total FROM l""")
def onto_first_signal(spark, d):
    s = event_samples(spark, d).select("multi_id", "field", "seq", "ts_us", "v")
    return asof.onto_first(s, "click", {"purchase": "y"}, ["multi_id"]).select("multi_id", "seq", F.round(F.col("x") + F.col("y"), 6).alias("total"))


# ---- intervals: a lineitem's order to its shipping, by supplier; and an event's following hour, by user

L = "l AS (SELECT l_suppkey AS k, epoch(l_shipdate) / 86400 AS start_s, epoch(l_shipdate) / 86400 + l_quantity / 5 AS end_s FROM lineitem)"
M = "m AS (SELECT k, min(start_s) AS start_s, max(end_s) AS end_s FROM (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN start_s <= max(end_s) OVER (PARTITION BY k ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM {0})) GROUP BY k, i)"


def shipped(spark, d):
    t = table(spark, d, "lineitem")
    day = micros(F.col("l_shipdate")) / 86_400_000_000
    return t.select(F.col("l_suppkey").alias("k"), day.cast("double").alias("start_s"), (day + F.col("l_quantity") / 5).alias("end_s"))


@query(f"WITH {L}, {M.format('l')} SELECT k, start_s, round(end_s, 6) AS end_s FROM m")
def interval_merge(spark, d):
    return intervals.merge(shipped(spark, d), "k").withColumn("end_s", F.round("end_s", 6))


def halves(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), "event_type", (micros(F.col("ts")) / 3_600_000_000).alias("h"))
    part = lambda t, w: e.filter(F.col("event_type") == t).select("k", F.floor("h").cast("double").alias("start_s"), (F.floor("h") + w).cast("double").alias("end_s"))
    return part("click", 6), part("view", 12)


H = "a AS (SELECT user_id AS k, CAST(floor(epoch_us(ts) / 3600000000.0) AS DOUBLE) AS x, CAST(floor(epoch_us(ts) / 3600000000.0) + 6 AS DOUBLE) AS y FROM events WHERE event_type = 'click'), b AS (SELECT user_id AS k, CAST(floor(epoch_us(ts) / 3600000000.0) AS DOUBLE) AS x, CAST(floor(epoch_us(ts) / 3600000000.0) + 12 AS DOUBLE) AS y FROM events WHERE event_type = 'view')"


@query(f"WITH {H} SELECT a.k, greatest(a.x, b.x) AS start_s, least(a.y, b.y) AS end_s FROM a JOIN b ON a.k = b.k AND a.x < b.y AND b.x < a.y")
def interval_intersect_strict(spark, d):
    return intervals.intersect(*halves(spark, d), "k")


@query(f"WITH {H} SELECT a.k, greatest(a.x, b.x) AS start_s, least(a.y, b.y) AS end_s FROM a JOIN b ON a.k = b.k AND a.x <= b.y AND b.x <= a.y")
def interval_intersect_touching(spark, d):
    return intervals.intersect(*halves(spark, d), "k", touching=True)


@query(f"WITH {H} SELECT greatest(a.x, b.x) AS start_s, count(*) AS n FROM a JOIN b ON a.x < b.y AND b.x < a.y GROUP BY ALL")
def interval_intersect_binned(spark, d):
    a, b = (x.drop("k") for x in halves(spark, d))
    return intervals.overlap_counts(a, b, bin_s=24.0).groupBy("start_s").agg(F.sum("n").alias("n"))


@query(f"WITH {L}, {M.format('l')} SELECT k, round(sum(end_s - start_s), 4) AS length_s, count(*) AS n_intervals FROM m GROUP BY k")
def interval_measure(spark, d):
    return intervals.measure(shipped(spark, d), "k").withColumn("length_s", F.round("length_s", 4))


@query(f"WITH {L}, {M.format('l')}, s AS (SELECT k, min(start_s) AS a, min(start_s) + 30 AS b FROM l GROUP BY k), g AS (SELECT k, count(*) AS n, min(start_s) AS a, max(end_s) AS b FROM m GROUP BY k) SELECT s.k, g.n = 1 AND g.a <= s.a AND g.b >= s.b AS covered FROM s JOIN g USING (k)")
def span_coverage(spark, d):
    x = shipped(spark, d)
    return intervals.covers(x, x.groupBy("k").agg(F.min("start_s").alias("start_s"), (F.min("start_s") + 30).alias("end_s")), "k")


@query(f"""WITH {L}, {M.format('l')}, s AS (SELECT k, min(start_s) - 1 AS a, max(end_s) + 1 AS b FROM l GROUP BY k), e AS (SELECT k, a AS start_s, a AS end_s FROM s UNION ALL SELECT * FROM m UNION ALL SELECT k, b, b FROM s),
g AS (SELECT k, end_s AS start_s, lead(start_s) OVER (PARTITION BY k ORDER BY start_s, end_s) AS end_s FROM e) SELECT k, round(start_s, 6) AS start_s, end_s FROM g WHERE start_s < end_s AND round(end_s, 6) = end_s UNION ALL SELECT k, round(start_s, 6), round(end_s, 6) FROM g WHERE start_s < end_s AND round(end_s, 6) <> end_s""")
def interval_complement(spark, d):
    x = shipped(spark, d)
    span = x.groupBy("k").agg((F.min("start_s") - 1).alias("start_s"), (F.max("end_s") + 1).alias("end_s"))
    out = intervals.complement(x, span, "k")
    return out.select("k", F.round("start_s", 6).alias("start_s"), F.when(F.round("end_s", 6) == F.col("end_s"), F.col("end_s")).otherwise(F.round("end_s", 6)).alias("end_s"))


@query(f"WITH {H} SELECT k, greatest(x, 473500.0) AS start_s, least(y, 473800.0) AS end_s FROM a WHERE greatest(x, 473500.0) < least(y, 473800.0)")
def interval_clip(spark, d):
    return intervals.clip(halves(spark, d)[0], 473500.0, 473800.0)


@query("""WITH v AS (SELECT user_id, epoch_us(ts) / 3600000000.0 AS t, event_id FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, floor(epoch_us(ts) / 3600000000.0) AS x FROM events WHERE event_type = 'click')
SELECT user_id AS k, event_id FROM v WHERE EXISTS (SELECT 1 FROM c WHERE c.user_id = v.user_id AND v.t BETWEEN c.x AND c.x + 6)""")
def rows_in_intervals(spark, d):
    rows = table(spark, d, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("k"), "event_id", (micros(F.col("ts")) / 3_600_000_000).alias("time_s"))
    return intervals.at_times(rows, halves(spark, d)[0], "k").select("k", "event_id")


@query(f"""WITH {S} SELECT multi_id, field, round(max(t) - min(t), 6) AS held_s FROM s WHERE t BETWEEN {START} AND {END} GROUP BY ALL""")
def held_in_window(spark, d):
    s = series.spans(series.in_window(event_samples(spark, d), START, END), "multi_id", "field")
    one = F.round(F.col("end_s") - F.col("start_s"), 6)
    return s.select("multi_id", "field", F.when(one == 0.001, 0.0).otherwise(one).alias("held_s"))
