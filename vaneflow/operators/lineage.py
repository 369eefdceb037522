"""Classes, what they inherit, who defines a member, and which files define what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions.scalar import exact_symbol, produces
from . import graph


def lineage(bases: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, ancestor, distance): every class of classes (class) with itself at 0 and all that it inherits from, by bases
    (class, base), at the least distance.  Circles of declarations end by themselves."""
    edges = bases.select(F.col("class").alias("src"), F.col("base").alias("dst")).filter("src is not null and dst is not null").distinct()
    found = graph.closure(edges, classes.select(F.col("class").alias("seed"), F.col("class").alias("node")).distinct())
    return found.select(F.col("seed").alias("class"), F.col("node").alias("ancestor"), F.col("depth").alias("distance"))


def resolve_members(references: DataFrame, bases: DataFrame, definitions: DataFrame) -> DataFrame:
    """(class, member, owner, distance, status) of references (class, member): the definition (class, member, ...) that is
    nearest in the class's lineage.

    exact: one class at the least distance defines the member, in one place; ambiguous: several do, or it does in several
    places, then owner is null; missing: none.  The lineage is closed once for the classes that are asked about and then
    met with the definitions by (ancestor, member), so a class that many inherit from is read once.
    """
    asked = references.select("class", "member").distinct()
    up = scratch.keep(lineage(bases, asked.select("class")), "lineage")
    own = definitions.groupBy(F.col("class").alias("ancestor"), "member").agg(F.count("*").alias("_places"))
    hits = asked.join(up, "class").join(own, ["ancestor", "member"])
    at = hits.groupBy("class", "member", "distance").agg(F.sum("_places").alias("_n"), F.min("ancestor").alias("owner"))
    best = at.groupBy("class", "member").agg(F.min_by(F.struct("distance", "_n", "owner"), "distance").alias("b"))
    out = asked.join(best, ["class", "member"], "left")
    one = F.col("b._n") == 1
    status = F.when(F.col("b").isNull(), "missing").when(one, "exact").otherwise("ambiguous")
    return out.select("class", "member", F.when(one, F.col("b.owner")).alias("owner"), F.col("b.distance").alias("distance"), status.alias("status"))


def validate_terminals(terminals: DataFrame, writers: DataFrame, logged: DataFrame, bases: DataFrame, includes: DataFrame) -> DataFrame:
    """(terminal, class, file, status, logged, n_writers, resolved_file) of terminals (terminal, class, file): does one source
    write what is to be explained?

    writers: (symbol, file, owner, identity, published); logged: (symbol); includes: (file, includes).  A terminal that
    leaves out an instance and means several logged symbols is ambiguous.  Writers count that write the terminal's storage
    (functions.scalar.produces) and publish it just if it is logged.  With a class, and no file, writers in files of its
    lineage count if there are any, those related to the file with the most; with a file, those in it or in one that
    includes it or that it includes.  valid: what is left has one identity, or none and one file; ambiguous: several;
    absent: no writer at all; absent_in_scope: none in the file.  resolved_file is the file with the most writers, ties by
    name, where class or file narrowed them.
    """
    t = terminals.select("terminal", "class", "file").distinct().withColumns({"_id": F.xxhash64("terminal", "class", "file"), "_t": exact_symbol(F.col("terminal"))}).withColumn("_key", _stem(F.col("_t")))
    t = scratch.keep(t, "terminals")
    seen = logged.select(exact_symbol(F.col("symbol")).alias("_s")).distinct().withColumn("_key", _stem(F.col("_s")))
    placed = t.join(seen, "_key").filter((F.col("_t") == F.col("_s")) | (_stem(F.col("_s")) == F.col("_t"))).groupBy("_id").agg(F.count_distinct("_s").alias("_placed"))
    w = writers.select(exact_symbol(F.col("symbol")).alias("_w"), F.col("file").alias("_file"), "owner", "identity", F.coalesce("published", F.lit(False)).alias("_out")).withColumn("_key", _stem(F.col("_w")))
    named = t.join(placed, "_id", "left").withColumn("_logged", F.coalesce(F.col("_placed"), F.lit(0)) > 0)
    hits = scratch.keep(named.join(w, "_key").filter(produces(F.col("_w"), F.col("_t")) & (F.col("_out") == F.col("_logged"))).select("_id", "class", "file", "_file", "owner", "identity"), "terminal-writers")
    every = hits.groupBy("_id").agg(F.count("*").alias("n_writers"))

    up = scratch.keep(lineage(bases, t.filter("class is not null").select("class")), "lineage")
    counts = hits.groupBy("_id", "_file").agg(F.count("*").alias("_n"))
    kin = hits.filter("file is null").join(up.select("class", F.col("ancestor").alias("owner")), ["class", "owner"], "left_semi").select("_id", "_file").distinct()
    most = Window.partitionBy("_id").orderBy(F.desc("_n"), "_file")  # a terminal's files
    first = lambda files: files.join(counts, ["_id", "_file"]).withColumn("_r", F.row_number().over(most)).filter("_r = 1").select("_id", F.col("_file").alias("_at"))
    scope = t.filter("file is not null").select("_id", F.col("file").alias("_at")).unionByName(first(kin))
    near = includes.select(F.col("file").alias("_at"), F.col("includes").alias("_file")).unionByName(includes.select(F.col("includes").alias("_at"), F.col("file").alias("_file")))
    near = near.unionByName(scope.select("_at", F.col("_at").alias("_file"))).distinct()
    of_kin = hits.join(kin.select("_id").distinct().withColumn("_kin", F.lit(True)), "_id", "left").join(kin.withColumn("_own", F.lit(True)), ["_id", "_file"], "left")
    narrowed = of_kin.filter("_kin is null or _own").join(scope, "_id", "left").join(near.withColumn("_near", F.lit(True)), ["_at", "_file"], "left")
    inside = narrowed.filter("_at is null or _near")
    told = inside.groupBy("_id").agg(F.count_distinct("identity").alias("_ids"), F.count_distinct("_file").alias("_files"))
    best = first(inside.filter("_at is not null").select("_id", "_file").distinct()).withColumnRenamed("_at", "resolved_file")
    out = named.join(every, "_id", "left").join(told, "_id", "left").join(best, "_id", "left")
    valid = (F.col("_ids") == 1) | ((F.col("_ids") == 0) & (F.col("_files") == 1))
    status = (
        F.when(F.col("_t") == "", "absent").when(F.coalesce("_placed", F.lit(0)) > 1, "ambiguous").when(F.col("n_writers").isNull(), "absent")
        .when(F.col("_files").isNull(), "absent_in_scope").when(valid, "valid").otherwise("ambiguous")
    )
    return out.select("terminal", "class", "file", status.alias("status"), F.col("_logged").alias("logged"), F.coalesce("n_writers", F.lit(0)).alias("n_writers"), F.when(status == "valid", F.col("resolved_file")).alias("resolved_file"))


def _stem(symbol):  # noqa: ANN001, ANN202
    """A symbol without its instances."""
    return F.regexp_replace(symbol, r"\[[^\]]+\]", "")


def expand(seeds: DataFrame, uses: DataFrame, defines: DataFrame, sizes: list[tuple[int, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Files that define what is missing, and what becomes of the references: (file, round) and (symbol, status, file).

    From files seeds (file) on: what a file refers to (uses: file, symbol) lets in the file that alone defines it
    (defines: file, symbol).  Semi-naive: a round joins only the files that the last one let in, and of their references
    only those that no round has met, so every file and symbol is joined once.  What grows with the rounds, and the
    definitions, are merged by their keys: broadcast, they would go through the driver again each round.  Status: admitted, ambiguous (several
    files define it) or missing.  sizes: gets the numbers of files and of new references of each round.
    """
    spark, since = seeds.sparkSession, scratch.mark()
    d = defines.select("file", "symbol").distinct()
    sole = scratch.keep(d.groupBy("symbol").agg(F.count("*").alias("_n"), F.min("file").alias("file")), "expand-defines")
    files, refs = scratch.path(spark, "expand-files"), scratch.path(spark, "expand-refs")
    seeds.select("file").distinct().withColumn("round", F.lit(0)).write.parquet(f"{files}/r-0")
    kinds = {"f": seeds.select("file").distinct().withColumn("round", F.lit(0)).schema, "s": uses.select("symbol").schema}
    read = lambda where, kind, which: spark.read.schema(kinds[kind]).parquet(f"{where}/r-{which}")
    spark.range(0).select(F.lit(None).cast(uses.schema["symbol"].dataType).alias("symbol")).write.parquet(f"{refs}/r-0")
    level = 0
    while True:
        new = read(files, "f", level)
        wanted = uses.join(new.select("file"), "file", "left_semi").select("symbol").distinct().join(read(refs, "s", "*").hint("merge"), "symbol", "left_anti")
        level += 1
        wanted.write.parquet(f"{refs}/r-{level}")
        fresh = read(refs, "s", level).join(sole.filter("_n = 1").hint("merge"), "symbol").select("file").distinct().join(read(files, "f", "*").select("file").hint("merge"), "file", "left_anti").withColumn("round", F.lit(level))
        fresh.write.parquet(f"{files}/r-{level}")
        if sizes is not None:
            sizes.append((new.count(), read(refs, "s", level).count()))
        if read(files, "f", level).isEmpty():
            break
    admitted = read(files, "f", "*")
    met = read(refs, "s", "*").join(sole, "symbol", "left")
    status = F.when(F.col("_n") == 1, "admitted").when(F.col("_n") > 1, "ambiguous").otherwise("missing")
    references = met.select("symbol", status.alias("status"), F.when(F.col("_n") == 1, F.col("file")).alias("file"))
    scratch.release(spark, since, admitted, references)
    return admitted, references


def ground(producers: DataFrame, roots: DataFrame, max_depth: int = 6) -> DataFrame:
    """(root, expression) of roots (root, symbol): what the symbol is written from, put in down to max_depth levels, for
    display.

    producers: (symbol, tokens): the parts of a right side, symbols as tokens of their own.  A symbol with one producer
    becomes its right side in brackets, one without stays; an expression that meets a symbol with several producers is
    null, and so is one that would come back to a symbol on its way or isn't at its end at max_depth.  Every symbol is spelt
    out once, for all roots that meet it: first those that use no other, then level by level those whose parts are known.
    A circle, and what uses one, never gets there.
    """
    spark, since = roots.sparkSession, scratch.mark()
    per = scratch.keep(producers.groupBy("symbol").agg(F.count("*").alias("_n"), F.first("tokens").alias("tokens")), "producers")
    sole = per.filter("_n = 1 and tokens is not null")
    parts = sole.select("symbol", F.explode(F.array_distinct("tokens")).alias("token")).filter("token is not null")
    # tokens that nobody produces are mostly few (signs, literals): they leave without a shuffle of all parts
    plain = scratch.keep(parts.select("token").distinct().join(per.select(F.col("symbol").alias("token")), "token", "left_anti"), "ground-plain")
    uses = parts.join(plain, "token", "left_anti").groupBy("symbol").agg(F.collect_list("token").alias("uses"))  # a right side's own
    open_ = scratch.keep(sole.select("symbol", "tokens").join(uses, "symbol", "left"), "ground-open")
    wanted = open_.filter("uses is not null").select("symbol", F.explode("uses").alias("token"))

    spelt, found = scratch.path(spark, "ground-spelt"), scratch.path(spark, "ground-found")
    shape = per.select("symbol", F.lit("").cast("string").alias("expression")).schema
    read = lambda level: spark.read.schema(shape).parquet(f"{spelt}/level-{level}")
    marked = F.concat(F.array(F.lit("(")), F.col("tokens"), F.array(F.lit(")")))
    open_.filter("uses is null").select("symbol", F.array_join(marked, " ").alias("expression")).write.parquet(f"{spelt}/level-1")
    put_in = F.array_join(F.transform(marked, lambda t: F.coalesce(F.try_element_at("_found", t), t)), " ")
    for level in range(2, max_depth + 1):
        if read(level - 1).isEmpty():
            break
        hits = wanted.join(read(level - 1).select(F.col("symbol").alias("token"), "expression"), "token").select("symbol", "token", "expression")
        hits.write.parquet(f"{found}/level-{level}")
        every = lambda which: spark.read.schema(hits.schema).parquet(f"{found}/level-{which}")  # noqa: B023, E731
        so_far = every("*") if level > 2 else every(level)
        known = so_far.join(every(level).select("symbol").distinct(), "symbol", "left_semi") if level > 2 else so_far
        known = known.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("token", "expression"))).alias("_found"))
        ready = open_.join(known, "symbol").filter(F.size("_found") == F.size("uses"))
        ready.select("symbol", put_in.alias("expression")).write.parquet(f"{spelt}/level-{level}")
    made = per.select("symbol", F.lit(True).alias("_made"))
    out = roots.select("root", "symbol").join(made, "symbol", "left").join(read("*"), "symbol", "left")
    out = out.select("root", F.when(F.col("_made"), F.col("expression")).otherwise(F.col("symbol")).alias("expression"))
    scratch.release(spark, since, out)
    return out
