"""Readers of missions, metadata and run records.  Files come through Spark, so any store that it reads will do; what can't be read becomes a row with an error, or none, never an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "struct<type:string,command:int,frame:int,autoContinue:boolean,params:array<double>,Altitude:double,complexItemType:string>"
PLAN = f"struct<fileType:string,mission:struct<cruiseSpeed:double,hoverSpeed:double,firmwareType:int,vehicleType:int,plannedHomePosition:array<double>,items:array<{ITEM}>>>"


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text)"""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _named(code: Column, names: dict[int, str], prefix: str) -> Column:
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv)) if names else F.create_map().cast("map<int,string>")
    return F.coalesce(table[code], F.concat(F.lit(prefix), code.cast("string")))


def plan_items(texts: DataFrame, commands: dict[int, str] | None = None, frames: dict[int, str] | None = None) -> DataFrame:
    """Items of JSON missions (path, text), one row each in order; complex ones keep their kind."""
    doc = texts.withColumn("_d", F.from_json("text", PLAN)).filter("_d.mission is not null")
    item = doc.select("path", F.posexplode("_d.mission.items").alias("item", "_i"))
    p = lambda n: F.try_element_at(F.col("_i.params"), F.lit(n))
    return item.select(
        "path", "item", F.coalesce("_i.complexItemType", "_i.type").alias("type"), F.col("_i.command").alias("command"), _named(F.col("_i.command"), commands or {}, "MAV_CMD_").alias("command_name"),
        _named(F.col("_i.frame"), frames or {}, "MAV_FRAME_").alias("frame_name"), *(p(n).alias(f"p{n}") for n in range(1, 5)), p(5).alias("lat"), p(6).alias("lon"), F.coalesce(p(7), F.col("_i.Altitude")).alias("alt"),
    )


def wpl_items(texts: DataFrame, commands: dict[int, str] | None = None) -> DataFrame:
    """Items of `QGC WPL` missions: twelve columns a line; other lines give rows with a warning."""
    lines = texts.filter(F.col("text").startswith("QGC WPL")).select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line", "_t")).filter("line > 0 and trim(_t) <> ''")
    c = lines.withColumn("_c", F.split(F.trim("_t"), r"\s+"))
    at = lambda n: F.try_element_at(F.col("_c"), F.lit(n)).try_cast("double")
    good = (F.size("_c") == 12) & F.forall("_c", lambda x: x.try_cast("double").isNotNull())
    v = lambda n, name, t="double": F.when(good, at(n)).cast(t).alias(name)
    return c.select("path", "line", v(1, "item", "int"), v(2, "current", "int"), v(3, "frame", "int"), v(4, "command", "int"), _named(F.when(good, at(4)).cast("int"), commands or {}, "MAV_CMD_").alias("command_name"), *(v(4 + n, f"p{n}") for n in range(1, 5)), v(9, "lat"), v(10, "lon"), v(11, "alt"), F.when(~good, F.concat(F.lit("malformed line "), F.col("line"))).alias("warning"))


def missions(texts: DataFrame) -> DataFrame:
    """(path, format, n_items): JSON plan, WPL text or unknown, by what the file begins with."""
    fmt = F.when(F.trim("text").startswith("{"), "plan").when(F.col("text").startswith("QGC WPL"), "wpl").otherwise("unknown")
    n = plan_items(texts).groupBy("path").count().unionByName(wpl_items(texts).filter("warning is null").groupBy("path").count())
    return texts.select("path", fmt.alias("format")).join(n, "path", "left").select("path", "format", F.coalesce("count", F.lit(0)).alias("n_items"))


def enum_names(texts: DataFrame, prefix: str) -> DataFrame:
    """(value, name) out of XML entries or C enums, the first text that has any."""
    xml = rf'<entry\s+value="(\d+)"\s+name="({prefix}\w+)"'
    code = rf"({prefix}\w+)\s*=\s*(\d+)"
    pairs = lambda pattern, v, n: F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(v)).alias("value"), F.regexp_extract_all("text", F.lit(pattern), F.lit(n)).alias("name"))
    got = texts.select("path", F.when(F.col("text").rlike(xml), pairs(xml, 1, 2)).otherwise(pairs(code, 2, 1)).alias("e")).filter(F.size("e") > 0)
    first = got.agg(F.min_by("e", "path").alias("e"))
    return first.select(F.explode("e").alias("e")).select(F.col("e.value").cast("int").alias("value"), "e.name")


def parameter_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Parameters of XML metadata; the last of a name counts."""
    schema = "_name string, _default string, _type string, short_desc string, long_desc string, unit string, decimal int, min double, max double"
    rows = spark.read.format("xml").option("rowTag", "parameter").schema(schema).load(path).withColumn("_at", F.monotonically_increasing_id())
    agg = rows.groupBy(F.col("_name").alias("name")).agg(F.max_by(F.struct("_default", "_type", "short_desc", "unit", "decimal", "min", "max"), "_at").alias("m"))
    return agg.select("name", F.col("m._default").alias("default"), F.col("m._type").alias("type"), F.col("m.short_desc").alias("short_desc"), F.col("m.unit").alias("unit"), F.col("m.decimal").alias("decimal"), F.col("m.min").alias("min"), F.col("m.max").alias("max"))


def airframes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Airframes of several XML files; what later files say takes the place of what earlier ones do, blanks don't."""
    out = None
    for i, p in enumerate(paths):
        one = spark.read.format("xml").option("rowTag", "airframe").schema("_id string, _name string, type string, class string").load(p).withColumn("_p", F.lit(i))
        out = one if out is None else out.unionByName(one)
    last = lambda c: F.max_by(F.col(c), F.when(F.trim(c) != "", F.col("_p")))
    return out.groupBy(F.col("_id").cast("int").alias("airframe_id")).agg(last("_name").alias("name"), last("type").alias("type"), last("class").alias("class"))


def script_tags(texts: DataFrame) -> DataFrame:
    """`# @tag value` lines of start scripts as a map per path."""
    tag = F.regexp_extract_all("text", F.lit(r"(?m)^#\s*@(\w+)\s+(.*?)\s*$"), F.lit(1))
    val = F.regexp_extract_all("text", F.lit(r"(?m)^#\s*@(\w+)\s+(.*?)\s*$"), F.lit(2))
    return texts.select("path", F.map_from_arrays(tag, val).alias("tags"))


def message_fields(texts: DataFrame) -> DataFrame:
    """Fields of .msg definitions (path, text): type, array size, name and comment."""
    line = texts.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line", "_t"))
    pattern = r"^\s*([a-zA-Z]\w*)(?:\[(\d+)\])?\s+([a-z]\w*)\s*(?:#\s*(.*))?$"
    g = lambda n: F.nullif(F.regexp_extract("_t", pattern, n), F.lit(""))
    return line.filter(F.col("_t").rlike(pattern)).select("path", "line", g(1).alias("type"), g(2).cast("int").alias("array_size"), g(3).alias("name"), g(4).alias("comment"))


def message_constants(texts: DataFrame) -> DataFrame:
    """Constants of .msg definitions: the enums of fields."""
    pattern = r"(?m)^\s*[a-zA-Z]\w*\s+([A-Z][A-Z0-9_]*)\s*=\s*(-?\d+)"
    names, values = (F.regexp_extract_all("text", F.lit(pattern), F.lit(n)) for n in (1, 2))
    z = texts.select("path", F.explode(F.arrays_zip(names.alias("label"), values.alias("value"))).alias("z"))
    return z.select("path", "z.label", F.col("z.value").cast("long").alias("value"))


def json_records(spark: SparkSession, path: str, schema: str, key: str, order: list[str], lines: bool = False) -> DataFrame:
    """Records of a folder of JSON files, or of lines; unreadable ones and those whose id isn't plain are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", str(not lines).lower()).json(path)
    return rows.filter(F.col(key).rlike(r"^[A-Za-z0-9._-]+$")).orderBy(*order)


def source_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, text) of a tree's files."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


ASSIGNMENT = r"(?m)^\s*(?:[\w:<>]+\s+)?([A-Za-z_][\w.\[\]>-]*)\s*=\s*([^=;][^;]*);"


def source_facts(texts: DataFrame) -> DataFrame:
    """Simple facts of C++ sources by patterns: assignments, parameter reads and topics read or written, one row each."""
    found = {"assignment": (ASSIGNMENT, 1, 2), "parameter": (r"(?:_param_|param_find\(\")(\w+)(\.get\(\)|\"\))", 1, 2), "publishes": (r"orb_publish\w*\(\s*ORB_ID\((\w+)\)(\s*,)", 1, 2), "subscribes": (r"ORB_ID[:(]+(\w+)\)?(\s*[})])", 1, 2)}
    out = None
    for kind, (pattern, a, b) in found.items():
        z = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(a)).alias("symbol"), F.regexp_extract_all("text", F.lit(pattern), F.lit(b)).alias("detail"))
        one = texts.select("path", F.lit(kind).alias("kind"), F.posexplode(z).alias("place", "z")).select("path", "kind", "place", "z.symbol", F.trim("z.detail").alias("detail"))
        out = one if out is None else out.unionByName(one)
    return out
