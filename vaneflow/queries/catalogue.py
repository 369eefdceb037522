"""The catalogue, search and ranking."""

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import catalog, search
from ..sources.tables import table
from . import query


def logs(spark, d):
    """Orders as logs."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("upload_date"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("log_date"), F.col("o_orderpriority").alias("hardware"), F.col("o_totalprice").alias("duration_s"), scalar.search_text(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey")).alias("search_text"), (F.col("o_orderkey") % 11 != 0).alias("source_available"))


def tags(spark, d):
    """Return flags and line states of an order's lines as its tags."""
    t = spark.createDataFrame([(1, "Alpha"), (2, "Nil"), (3, "Ret"), (4, "Fin"), (5, "Open"), (6, "unused")], "id int, name string")
    li = table(spark, d, "lineitem")
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    link = li.select(F.col("l_orderkey").alias("log_id"), F.explode(F.array(flag, F.when(F.col("l_linestatus") == "F", 4).otherwise(5))).alias("tag_id")).distinct()
    return t, link


LOGS = "logs AS (SELECT o_orderkey AS id, o_orderdate AS upload_date, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS log_date, o_orderpriority AS hardware, o_totalprice AS duration_s, concat_ws(' ', o_orderpriority, o_orderstatus, o_custkey) AS search_text, o_orderkey % 11 <> 0 AS ok FROM orders)"
TAGS = "tags(tag_id, name) AS (VALUES (1, 'Alpha'), (2, 'Nil'), (3, 'Ret'), (4, 'Fin'), (5, 'Open'), (6, 'unused')), lt AS (SELECT DISTINCT l_orderkey AS log_id, unnest([CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END, CASE l_linestatus WHEN 'F' THEN 4 ELSE 5 END]) AS tag_id FROM lineitem)"


@query(f"WITH {LOGS} SELECT id, upload_date, duration_s FROM logs WHERE ok AND contains(lower(search_text), 'urgent') AND contains(lower(search_text), 'o') AND upload_date >= DATE '1995-01-01' AND upload_date < DATE '1999-01-01' ORDER BY upload_date IS NULL, upload_date DESC, id LIMIT 50 OFFSET 10")
def catalog_search_page(spark, d):
    f = catalog.filtered(logs(spark, d), "URGENT o", ("1995-01-01", "1998-12-31"))
    return catalog.page(f, "upload_date", "desc", 50, 10).select("id", "upload_date", "duration_s")


@query(f"WITH {LOGS} SELECT id, log_date FROM logs WHERE ok ORDER BY log_date IS NULL, log_date ASC, id LIMIT 500 OFFSET 4000")
def catalog_nulls_last(spark, d):
    return catalog.page(catalog.filtered(logs(spark, d)), "log_date", "asc", 500, 4000).select("id", "log_date")


@query(f"WITH {LOGS} SELECT count(*) AS total, count(*) FILTER (ok AND contains(lower(search_text), '1-urgent')) AS found, count(*) FILTER (contains(search_text, '%')) AS literal FROM logs")
def catalog_counts(spark, d):
    x = logs(spark, d)
    n = lambda f: f.agg(F.count("*").alias("n"))
    parts = [n(x).withColumnRenamed("n", "total"), n(catalog.filtered(x, "1-urgent")).withColumnRenamed("n", "found"), n(catalog.filtered(x, "%")).withColumnRenamed("n", "literal")]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # single rows


@query(f"WITH {LOGS}, {TAGS} SELECT id FROM logs WHERE id IN (SELECT log_id FROM lt JOIN tags USING (tag_id) WHERE lower(name) IN ('alpha', 'fin', 'ret') GROUP BY log_id HAVING count(DISTINCT lower(name)) = 3)")
def catalog_tag_division(spark, d):
    t, link = tags(spark, d)
    return catalog.having_all(logs(spark, d), link, t, ["ALPHA", "Fin", "ret", "RET"]).select("id")


@query(f"WITH {LOGS}, {TAGS} SELECT name, count(CASE WHEN ok THEN 1 END) AS n_logs FROM tags LEFT JOIN lt USING (tag_id) LEFT JOIN logs ON lt.log_id = logs.id GROUP BY name")
def catalog_tag_counts(spark, d):
    t, link = tags(spark, d)
    return catalog.tag_counts(t, link, logs(spark, d))


@query(f"WITH {LOGS}, {TAGS} SELECT id, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS tags FROM logs LEFT JOIN lt ON id = log_id LEFT JOIN tags USING (tag_id) GROUP BY id")
def catalog_with_tags(spark, d):
    t, link = tags(spark, d)
    return catalog.with_tags(logs(spark, d), link, t).select("id", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {TAGS} SELECT log_id, tag_id FROM lt WHERE NOT (log_id = 1 AND tag_id = 2) UNION SELECT 1, 6 WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = 1)")
def catalog_tag_edits(spark, d):
    t, link = tags(spark, d)
    more = catalog.add_tag(t, "UNUSED")  # it is there in another case
    linked = catalog.link_tag(link, logs(spark, d), more, 1, "unused")
    return catalog.unlink_tag(linked, more, F.lit(1).cast("long"), "nil")


def snapshot(spark, d):
    """An earlier state: some orders missing, some with other values."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus")
    old = o.filter("id % 7 <> 0").withColumn("o_totalprice", F.when(F.col("id") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return old, o.filter("id % 13 <> 0")


CDC = "CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'added' WHEN o_orderkey % 13 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'updated' ELSE 'unchanged' END"


@query(f"SELECT o_orderkey AS id, {CDC} AS change FROM orders WHERE {CDC} IS NOT NULL")
def cdc_classify(spark, d):
    old, new = snapshot(spark, d)
    return catalog.classify(old, new, "id", ["o_totalprice", "o_orderstatus"]).select("id", "change")


@query(f"SELECT o_orderkey AS id, CASE WHEN {CDC} = 'missing' AND o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, {CDC} <> 'missing' AS source_available, CASE WHEN {CDC} = 'added' THEN 2 ELSE 1 END AS created_at, CASE WHEN {CDC} = 'unchanged' THEN 1 ELSE 2 END AS updated_at FROM orders WHERE {CDC} IS NOT NULL")
def cdc_soft_delete(spark, d):
    old, new = snapshot(spark, d)
    state = old.withColumns({"created_at": F.lit(1), "updated_at": F.lit(1), "source_available": F.lit(True)})
    return catalog.upsert(state, new, "id", ["o_totalprice", "o_orderstatus"], F.lit(2)).drop("o_orderstatus")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS "Id", o_orderpriority AS "OriginalFilename", CAST(NULL AS VARCHAR) AS "Description", CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS "Duration" FROM orders""")
def external_catalogue(spark, d):
    o = table(spark, d, "orders")
    a = o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("ORIGINALFILENAME"))
    g = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("duration"))
    return catalog.external_logs(a, g).select("Id", "OriginalFilename", "Description", "Duration")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, CASE WHEN o_custkey - 100 > 0 THEN strftime(make_timestamp((o_custkey - 100) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS from_epoch, 'local:' || o_orderstatus || ':' || o_orderkey AS log_id FROM orders""")
def dates_and_ids(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", scalar.to_iso(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("iso"), scalar.iso_from_epoch(F.col("o_custkey") - 100).alias("from_epoch"), scalar.local_log_id(F.concat_ws("/", F.lit("a/b"), "o_orderstatus", F.col("o_orderkey").cast("string"))).alias("log_id"))


# ---- search

@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, unnest(range(len(string_split(text, chr(10))))) + 1 AS line FROM documents) SELECT doc_id, CAST(line AS INT) AS line FROM l WHERE contains(lower(value), 'license')""")
def grep_lines(spark, d):
    return search.grep(table(spark, d, "documents"), "doc_id", "text", "LICENSE", True, True).select("doc_id", "line")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, unnest(range(len(string_split(text, chr(10))))) + 1 AS line FROM documents), h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS n FROM l WHERE regexp_matches(value, '[0-9]{4,}')) SELECT doc_id, CAST(line AS INT) AS line FROM h WHERE n <= 2""")
def grep_capped(spark, d):
    return search.grep(table(spark, d, "documents"), "doc_id", "text", "[0-9]{4,}", False, per_text=2).select("doc_id", "line")


@query("""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS value, unnest(range(len(string_split(html, chr(10))))) + 1 AS line FROM pages) SELECT page_id, CAST(line AS INT) AS line, length(value) AS n FROM l WHERE line BETWEEN 1 AND 3""")
def line_range(spark, d):
    return search.line_range(table(spark, d, "pages"), "page_id", "html", 1, 3).select("page_id", "line", F.length("value").cast("long").alias("n"))


@query("""WITH q(query) AS (VALUES ('the'), ('PARAM'), ('license')), m AS (SELECT doc_id, query, least(30, (2.0 + CASE WHEN regexp_full_match(query, '[A-Z][A-Z0-9_]{2,}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(text), 'param|orb_|uorb::') THEN 0.5 ELSE 0 END)) AS s FROM documents, q WHERE contains(lower(text), lower(query))),
f AS (SELECT doc_id, sum(s) AS score FROM m GROUP BY ALL) SELECT doc_id, score FROM f ORDER BY score DESC, doc_id LIMIT 20""")
def relevance_topk(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.explode(F.array(F.lit("the"), F.lit("PARAM"), F.lit("license"))).alias("query"))
    hits = docs.filter(F.contains(F.lower("text"), F.lower("query"))).withColumn("score", search.match_score(F.col("text"), F.col("query")))
    return search.rank_files(hits, "doc_id", 30, 20)


@query("""SELECT p, CASE WHEN p LIKE 'src/lib/%' OR p LIKE 'src/modules/%' THEN 30 WHEN p LIKE 'src/drivers/%' THEN 15 ELSE 0 END - CASE WHEN p LIKE 'test/%' OR p LIKE '%/test%' THEN 100 ELSE 0 END - CASE WHEN p LIKE '%/vendor/%' THEN 80 ELSE 0 END + 0.0 AS boost FROM (SELECT ['src/lib/', 'src/modules/vendor/', 'src/drivers/', 'test/', 'docs/'][1 + p_partkey % 5] || p_partkey || '.cpp' AS p FROM part)""")
def path_boosts(spark, d):
    heads = F.array(*map(F.lit, ("src/lib/", "src/modules/vendor/", "src/drivers/", "test/", "docs/")))
    p = table(spark, d, "part").select(F.concat(heads[(F.col("p_partkey") % 5).cast("int")], F.col("p_partkey").cast("string"), F.lit(".cpp")).alias("p"))
    return p.select("p", search.path_boost(F.col("p")).alias("boost"))


@query(r"""WITH t AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')) AS w FROM benchmark), q AS (SELECT w FROM t WHERE item_id = 0),
s AS (SELECT item_id, len(list_intersect(t.w, q.w)) AS n FROM t, q) SELECT item_id, CAST(CASE WHEN least(n * 8, 24) + least(n * 2, 8) > 0 THEN least(n * 8, 24) + least(n * 2, 8) ELSE 0 END AS INT) AS score FROM s""")
def overlap_scores(spark, d):
    b = table(spark, d, "benchmark").select("item_id", search.tokens(F.col("text")).alias("w"))
    q = b.filter("item_id = 0").select(F.col("w").alias("q"))
    none = F.array().cast("array<string>")
    kinds = ("functions", "phrases", "files")
    a, r = {"parameters": F.col("q"), "symbols": F.col("q")} | dict.fromkeys(kinds, none), {"parameters": F.col("w"), "symbols": F.col("w")} | dict.fromkeys(kinds, none)
    return b.crossJoin(F.broadcast(q)).select("item_id", search.overlap_score(a, r).alias("score"))  # one row


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM documents) SELECT doc_id, name FROM w WHERE name IN ('license', 'License', 'password', 'the')""")
def known_names(spark, d):
    known = spark.createDataFrame([(n,) for n in ("license", "License", "password", "the")], "name string")
    return search.anchors(table(spark, d, "documents"), "doc_id", "text", known).select("doc_id", "name")


@query("""SELECT o_custkey, CASE min(CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END) WHEN 1 THEN 'P' WHEN 2 THEN 'F' ELSE 'O' END AS status FROM orders GROUP BY ALL""")
def worst_status(spark, d):
    return search.worst_status(table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("status")), "o_custkey", ["P", "F", "O"])


@query("""(SELECT p_brand AS a, p_size AS b, 'left' AS side FROM part WHERE p_partkey % 2 = 0 EXCEPT ALL SELECT p_brand, p_size, 'left' FROM part WHERE p_partkey % 3 = 0) UNION ALL (SELECT p_brand, p_size, 'right' FROM part WHERE p_partkey % 3 = 0 EXCEPT ALL SELECT p_brand, p_size, 'right' FROM part WHERE p_partkey % 2 = 0)""")
def fact_difference(spark, d):
    p = table(spark, d, "part")
    one = lambda n: p.filter(F.col("p_partkey") % n == 0).select(F.col("p_brand").alias("a"), F.col("p_size").alias("b"))
    return search.fact_difference(one(2), one(3))
