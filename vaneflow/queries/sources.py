"""JSON, missions, exports, plots and streams."""

from pyspark.sql import functions as F

from .. import scratch
from ..functions import geo
from ..plans import plots
from ..sources import readers, sinks
from ..sources.tables import event_samples, micros, table
from ..streaming import changes as streams
from . import query
from .checking import defaults


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def plan_texts(spark, d):
    """A mission for each supplier: its orders of a nation as items."""
    s = table(spark, d, "supplier")
    item = lambda n: F.struct(F.lit("SimpleItem").alias("type"), F.lit(16 + n).alias("command"), F.lit(3).alias("frame"), F.array(*(F.lit(float(i)) for i in range(4)), F.col("s_nationkey") + F.lit(0.5 + n), F.col("s_suppkey") + F.lit(0.25), *([] if n else [F.lit(50.0)])).alias("params"), F.lit(33.0).alias("Altitude"))
    doc = F.struct(F.lit("Plan").alias("fileType"), F.struct(F.lit(5.0).alias("cruiseSpeed"), F.array(item(0), item(1)).alias("items")).alias("mission"))
    return s.select(F.col("s_suppkey").cast("string").alias("path"), F.to_json(doc).alias("text"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS path, i AS item, 16 + i AS command, 'MAV_CMD_' || (16 + i) AS command_name, s_nationkey + 0.5 + i AS lat, s_suppkey + 0.25 AS lon, CASE i WHEN 0 THEN 50.0 ELSE 33.0 END AS alt FROM supplier, (SELECT CAST(unnest(range(2)) AS INT) AS i)""")
def mission_items_json(spark, d):
    return readers.plan_items(plan_texts(spark, d)).select("path", "item", "command", "command_name", "lat", "lon", "alt")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS path, CASE WHEN l = 2 THEN -1 ELSE 16 END AS command, CASE WHEN l <> 2 THEN CAST(s_nationkey AS DOUBLE) END AS lat, CASE WHEN l = 2 THEN 'malformed line 2' END AS warning FROM supplier, (SELECT unnest(range(1, 4)) AS l)""")
def mission_items_text(spark, d):
    good = F.concat(F.lit("0\t1\t3\t16\t0\t0\t0\t0\t"), F.col("s_nationkey").cast("string"), F.lit("\t8.5\t100\t1"))
    text = F.concat_ws("\n", F.lit("QGC WPL 110"), good, F.lit("broken line"), good)
    t = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), text.alias("text"))
    return readers.wpl_items(t).select("path", F.coalesce("command", F.lit(-1)).alias("command"), "lat", "warning")


@query("""SELECT 'S' || s_suppkey AS name, concat_ws(chr(9), '1', '1', 'S' || s_suppkey, CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR), '6') AS line FROM supplier WHERE s_suppkey % 2 <> 0 AND (s_suppkey % 3 = 0 OR s_suppkey % 5 = 0)""")
def parameter_export(spark, d):
    rows = defaults(spark, d).withColumn("v", F.floor("v").cast("double"))
    return sinks.parameter_lines(rows, True)


@query("""WITH p AS (SELECT user_id, epoch_us(ts) AS t, printf('%.9f,%.9f,%.3f', CAST(event_id % 180 AS DOUBLE), CAST(event_id % 90 AS DOUBLE), value) AS p FROM events WHERE event_id % 5 > 2) SELECT CAST(user_id AS VARCHAR) AS log_id, string_agg(p, ' ' ORDER BY t) AS coordinates FROM p GROUP BY ALL""")
def kml_track(spark, d):
    e = table(spark, d, "events")
    f = e.select(F.col("user_id").cast("string").alias("log_id"), micros(F.col("ts")).alias("seq"), F.lit(1).alias("version"), ((F.col("event_id") % 90) * 1e7).alias("lat"), ((F.col("event_id") % 180) * 1e7).alias("lon"), (F.col("value") * 1000).alias("alt"), (F.col("event_id") % 5).alias("fix_type"))
    return sinks.kml_coordinates(sinks.gps_track(f))


@query("""SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS "end", event_type AS field, count(*) AS n, round(sum(value), 4) AS sum_v FROM events GROUP BY ALL""")
def windowed_events(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("field"), F.col("value").alias("v"))
    w = streams.windowed(e, "1 day")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "field", "n", F.round("sum_v", 4).alias("sum_v"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM g)
SELECT user_id AS multi_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, i""")
def sessions_of_users(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("multi_id"))
    return streams.sessions(e, "12 hours").select("multi_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT event_type AS field, count(*) AS n, round(sum(value), 4) AS sum_v FROM events GROUP BY ALL""")
def streamed_windows(spark, d):
    """The windows again, out of a stream that ends with what is there; append mode closes those that the watermark has passed, so their state is flushed by a complete one."""
    at = scratch.path(spark, "stream")
    src = event_samples(spark, d).select(F.timestamp_micros("ts_us").alias("ts"), "field", "v")
    src.write.parquet(f"{at}/in")
    agg = streams.windowed(streams.read_samples(spark, f"{at}/in"), "1 day")

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{at}/out/b={number}")

    agg.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    rows = spark.read.parquet(f"{at}/out")
    last = rows.groupBy("start", "field").agg(F.max_by(F.struct("n", "sum_v"), "b").alias("x"))
    return last.groupBy("field").agg(F.sum("x.n").alias("n"), F.round(F.sum("x.sum_v"), 4).alias("sum_v"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'view')
SELECT user_id AS multi_id, round(epoch_us(ts) / 1e6, 6) AS time_s, round(degrees(value), 6) AS value FROM r WHERE i % CAST(greatest(1, ceil(n / 10.0)) AS BIGINT) = 0 OR i = n - 1""")
def plot_points(spark, d):
    s = event_samples(spark, d).filter("field = 'view'").withColumns({"topic": F.lit("vehicle_attitude"), "field": F.lit("roll")})
    return plots.points(s, [p for p in plots.PLOTS if p.id == "roll"], max_points=10).select("multi_id", "time_s", "value")


@query("""SELECT c_custkey, round(sqrt(a*a + b*b + c*c), 6) AS speed, CASE WHEN c_nationkey % 3 = 0 THEN a ELSE b END AS airspeed FROM (SELECT *, c_acctbal AS a, c_custkey * 0.5 AS b, 3.0 AS c FROM customer)""")
def airspeed_choice(spark, d):
    from ..functions.scalar import validated_airspeed

    c = table(spark, d, "customer").withColumn("b", F.col("c_custkey") * 0.5)
    speed = F.round(geo.norm(F.col("c_acctbal"), F.col("b"), F.lit(3.0)), 6)
    return c.select("c_custkey", speed.alias("speed"), validated_airspeed(F.col("c_acctbal"), F.col("b"), F.col("c_nationkey") % 3 == 0).alias("airspeed"))
