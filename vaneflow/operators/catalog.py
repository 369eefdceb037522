"""The catalogue of logs: browsing, tags and synchronisation."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import date_bound

SORTS = ["upload_date", "log_date", "hardware", "software", "duration_s", "error_count"]
#: Tags are broadcast up to this count and these bytes of names, both proven; beyond, each meets its logs in SPREAD tasks.
TAGS_SENT, TAG_BYTES_SENT, SPREAD = 10_000, 16 << 20, 64


def filtered(logs: DataFrame, search: str = "", upload: tuple[str, str] = ("", ""), logged: tuple[str, str] = ("", "")) -> DataFrame:
    """Available logs that have every search term, as it is written and in either case, and lie in the dates; no date is none."""
    out = logs.filter("source_available")
    for term in search.lower().split():
        out = out.filter(F.contains(F.lower("search_text"), F.lit(term)))
    for column, (start, end) in (("upload_date", upload), ("log_date", logged)):
        if (a := date_bound(start)) is not None:
            out = out.filter(F.col(column) >= a)
        if (b := date_bound(end, True)) is not None:
            out = out.filter(F.col(column) < b)
    return out


def _with_tag(log_tags: DataFrame, tags: DataFrame, name: str) -> DataFrame:
    """log_tags with column `name` of tags (tag_id, name).  A tag has any number of logs, so a shuffle by tag alone would put them into one task."""
    n, size = tags.limit(TAGS_SENT + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(name)), F.lit(0))).first()
    if n <= TAGS_SENT and size <= TAG_BYTES_SENT:
        return log_tags.join(F.broadcast(tags), "tag_id")
    part = F.pmod(F.xxhash64("log_id"), F.lit(SPREAD)).cast("int")
    each = tags.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return log_tags.withColumn("_part", part).join(each, ["tag_id", "_part"]).drop("_part")


def having_all(logs: DataFrame, log_tags: DataFrame, tags: DataFrame, names: list[str]) -> DataFrame:
    """Logs with all the tags (relational division); names are alike in either case."""
    wanted = sorted({n.lower() for n in names})
    if not wanted:
        return logs
    named = _with_tag(log_tags, tags.filter(F.lower("name").isin(wanted)).select(F.col("id").alias("tag_id"), F.lower("name").alias("_n")), "_n")
    full = named.groupBy("log_id").agg(F.count_distinct("_n").alias("_k")).filter(F.col("_k") == len(wanted))
    return logs.join(full.select(F.col("log_id").alias("id")), "id", "left_semi")


def order_by(sort: str, direction: str) -> list[Column]:
    """Nulls last either way, then by id; an unknown column is the upload date."""
    c = F.col(sort if sort in SORTS else "upload_date")
    return [c.asc_nulls_last() if direction.lower() == "asc" else c.desc_nulls_last(), F.col("id").asc()]


def page(rows: DataFrame, sort: str, direction: str, limit: int = 50, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order_by(sort, direction)).offset(max(0, offset)).limit(min(max(1, limit), 500))


def with_tags(rows: DataFrame, log_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Rows with their tags' names in order: one join for all."""
    named = _with_tag(log_tags, tags.select(F.col("id").alias("tag_id"), "name"), "name").groupBy("log_id").agg(F.array_sort(F.collect_set(F.struct(F.lower("name").alias("k"), "name"))).alias("_t"))
    return rows.join(named.select(F.col("log_id").alias("id"), F.transform("_t", lambda x: x["name"]).alias("tags")), "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def tag_counts(tags: DataFrame, log_tags: DataFrame, logs: DataFrame) -> DataFrame:
    """Every tag's available logs, 0 for unused ones."""
    n = log_tags.join(logs.filter("source_available").select(F.col("id").alias("log_id")), "log_id").groupBy("tag_id").agg(F.count("*").alias("_n"))
    return tags.join(n, tags["id"] == n["tag_id"], "left").groupBy("name").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_logs"))


def add_tag(tags: DataFrame, name: str) -> DataFrame:
    """Tags with one more, unless it is there in either case."""
    new = tags.sparkSession.createDataFrame([(name.strip(),)], "name string")
    missing = new.join(tags.select(F.lower("name").alias("_n")), F.lower(new["name"]) == F.col("_n"), "left_anti")
    top = tags.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_m"))
    return tags.unionByName(missing.crossJoin(top).select((F.col("_m") + 1).cast(tags.schema["id"].dataType).alias("id"), "name"))  # one row by one row


def link_tag(log_tags: DataFrame, logs: DataFrame, tags: DataFrame, log_id, name: str) -> DataFrame:
    """One more link, if both ends exist and it doesn't."""
    new = logs.filter(F.col("id") == log_id).select(F.col("id").alias("log_id")).crossJoin(tags.filter(F.lower("name") == name.lower()).select(F.col("id").alias("tag_id")))  # one row by one row
    return log_tags.select("log_id", "tag_id").unionByName(new.join(log_tags, ["log_id", "tag_id"], "left_anti"))


def unlink_tag(log_tags: DataFrame, tags: DataFrame, log_id, name: str) -> DataFrame:
    gone = tags.filter(F.lower("name") == name.lower()).select(F.col("id").alias("tag_id"), F.lit(log_id).alias("log_id"))
    return log_tags.join(gone, ["log_id", "tag_id"], "left_anti")


def classify(current: DataFrame, incoming: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Each key as added, updated, unchanged or missing: a full outer join, nulls compared as values."""
    c = current.select(F.col(key), F.struct(*values).alias("_old"))
    i = incoming.select(F.col(key), F.struct(*values).alias("_new"))
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "missing").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return c.join(i, key, "full_outer").select(key, state.alias("change"), "_old", "_new")


def upsert(current: DataFrame, incoming: DataFrame, key: str, values: list[str], now: Column) -> DataFrame:
    """The table after a synchronisation: new rows, changed rows with their first created_at, others as they were; what no longer comes is kept as unavailable."""
    s = classify(current, incoming, key, values).join(current.select(key, "created_at", "updated_at", "source_available"), key, "left")
    pick = F.coalesce("_new", "_old")
    return s.select(key, *(pick[v].alias(v) for v in values), (F.col("change") != "missing").alias("source_available"), F.coalesce("created_at", now).alias("created_at"), F.when(F.col("change").isin("added", "updated") | ((F.col("change") == "missing") & F.col("source_available")), now).otherwise(F.col("updated_at")).alias("updated_at"))


def with_missing_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """These columns, found in either case, nulls for those that aren't there."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*(F.col(f"`{have[c.lower()]}`").cast(t).alias(c) if c.lower() in have else F.lit(None).cast(t).alias(c) for c, t in columns.items()))


def external_logs(logs: DataFrame, generated: DataFrame | None) -> DataFrame:
    """The outside catalogue's two tables as one, whichever columns they have."""
    a = with_missing_columns(logs, {"Id": "string", "Date": "timestamp", "OriginalFilename": "string", "Description": "string"})
    cols = {"Id": "string", "Duration": "double", "MavType": "string", "AutostartId": "int", "Hardware": "string", "Software": "string", "NumLoggedErrors": "int", "FlightModes": "string", "SoftwareVersion": "string", "StartTime": "long", "UUID": "string"}
    if generated is None:
        return a.select("*", *(F.lit(None).cast(t).alias(c) for c, t in cols.items() if c != "Id"))
    return a.join(with_missing_columns(generated, cols), "Id", "left")


class ClaimedBefore(ValueError):
    """The catalogue belongs to another source."""


def claim_source(spark: SparkSession, folder: str, kind: str, source: dict[str, str], logs: DataFrame | None = None) -> bool:
    """Bind a catalogue in a shared folder to one source of a kind; True if this call did, False if it is bound to it already.

    The claim is a file that is written apart and then given its name, which one writer alone can do: by a hard link in
    a local or mounted folder, by a rename that doesn't overwrite in Hadoop's other stores that have an atomic one.  Who
    comes second reads what the first claimed.  A different source raises ClaimedBefore, and so do rows of logs (log_path)
    from outside the source's log_dir while there is no claim yet.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_claim-{kind}.json")
    store = target.getFileSystem(conf)
    text = json.dumps(source, sort_keys=True)

    def claimed() -> str:
        stream = store.open(target)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    if not store.exists(target):
        if logs is not None and "log_dir" in source:
            apart = F.coalesce(F.regexp_extract("log_path", r"^(.*)/[^/]*$", 1), F.lit("")) != source["log_dir"].rstrip("/")
            if not logs.filter(apart).isEmpty():
                raise ClaimedBefore(f"the catalogue has logs from outside {source['log_dir']}")
        store.mkdirs(target.getParent())
        draft = jvm.org.apache.hadoop.fs.Path(f"{target.getParent()}/_claim-{uuid.uuid4().hex}.tmp")
        out = store.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if target.toUri().getScheme() in (None, "file"):
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            else:
                files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
                none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                files.rename(draft, target, none)
            return True
        except Exception:
            if not store.exists(target):
                raise
        finally:
            store.delete(draft, False)
    if claimed() != text:
        raise ClaimedBefore(f"the catalogue is bound to another source: {claimed()}")
    return False


# Fixed value: the picture of logs whose airframe has none.
DEFAULT_IMAGE = "AirframeUnknown"


def image_key(name: Column) -> Column:
    """The key of an image's name: trimmed, without .svg; empty where it isn't a plain file name."""
    plain = F.regexp_replace(F.rtrim(F.trim(F.coalesce(name, F.lit(""))), F.lit("\0")), r"(?i)\.svg$", "")
    return F.when(plain.contains("/") | plain.isin(".", ".."), "").otherwise(plain)


def refresh_images(logs: DataFrame, airframes: DataFrame, assets: DataFrame) -> DataFrame:
    """(id, airframe_image_key) of the logs whose picture changes: the airframe's image (airframes: airframe_id, image) if
    there is such a picture (assets: key), else the default; a log that has a picture is never put back to the default.

    Airframes, one row each, meet the pictures first, so a log takes part in one join.
    """
    keyed = airframes.select(F.trim(F.col("airframe_id").cast("string")).alias("_a"), image_key(F.col("image")).alias("_key")).filter("_key != ''")
    there = keyed.join(assets.select(F.col("key").alias("_key")).distinct(), "_key", "left_semi").groupBy("_a").agg(F.min("_key").alias("_key"))
    rows = logs.join(there, F.trim(F.col("airframe_id").cast("string")) == F.col("_a"), "left").withColumn("_new", F.coalesce("_key", F.lit(DEFAULT_IMAGE)))
    now = F.coalesce("airframe_image_key", F.lit(""))
    return rows.filter(~((F.col("_new") == DEFAULT_IMAGE) & (now != "")) & (F.col("_new") != now)).select("id", F.col("_new").alias("airframe_image_key"))
