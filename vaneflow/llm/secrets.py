"""Secret scanning with corpus-wide ownership frequency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, keep, table, text_hash

# The kinds in their order, with pattern and least length.
# Runs shorter than the least are never part of a longer match of `access` and `hex`, so their patterns ask for it;
# `assign` has to match short values too, since a dropped match still takes its characters.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
BARE = "[A-Za-z0-9+/_-]{32,}"
KINDS = ("assign", "access", "hex", "bare")
LEAST_VALUE = 6
#: A value that more owners, or more repositories, than these have is a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 8
#: Marks that no pattern matches: round matches, and in the place of those found before.  Where a text has them, another
#: stands in, equally long.
MARK, COVER, STAND_IN = "", "", ""
#: Offsets are summed up in runs of so many pieces, so that the work grows with their number, not its square.
RUN = 128


def _offsets(lengths: str) -> Column:
    """Of an array column of lengths: the sum of those before each, by way of the sums of runs."""
    last = F.floor((F.size(lengths) - 1) / RUN).cast("int")
    runs = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(lengths, c * RUN + 1, F.lit(RUN)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    inside = F.transform(runs, lambda run: F.aggregate(run, zero, step, lambda acc: acc["out"]))
    sums = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda a, b: a + b))
    before = F.aggregate(sums, zero, step, lambda acc: acc["out"])
    return F.flatten(F.zip_with(inside, before, lambda run, at: F.transform(run, lambda n: n + at)))


def with_spans(df: DataFrame, name: str, text: str, kind: int, pattern: str, value: Column | None = None) -> DataFrame:
    """Adds the leftmost non-overlapping matches in column `text` as structs of start, kind, end (code points, exclusive)
    and value; value: what a piece "p" holds of it, the whole if None.

    One pass of the pattern sets marks round the matches; the pieces between marks give the offsets, so that a text of
    very many matches takes time in proportion to them.
    """
    pieces, lengths, at = f"_{name}_pieces", f"_{name}_lengths", f"_{name}_at"
    df = df.withColumn(pieces, F.split(F.regexp_replace(F.col(text), pattern, f"{MARK}$0{MARK}"), MARK))
    df = df.withColumn(lengths, F.when(F.size(pieces) > 1, F.transform(pieces, lambda p: F.char_length(p))))
    df = df.withColumn(at, F.when(F.size(lengths) > 1, _offsets(lengths)))
    places = F.arrays_zip(F.col(pieces).alias("piece"), F.col(at).alias("start"), F.col(lengths).alias("length"))
    odd = F.filter(places, lambda z, i: i % 2 == 1)

    def one(z: Column) -> Column:
        what = z["piece"] if value is None else F.regexp_extract(z["piece"], ASSIGN, 2)
        return F.struct(z["start"].alias("start"), F.lit(kind).alias("kind"), (z["start"] + z["length"]).alias("end"), what.alias("value"))

    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return df.withColumn(name, F.coalesce(F.when(F.size(pieces) > 1, F.transform(odd, one)), none)).drop(lengths, at)


def _joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds `base` (assign, access and hex spans) and `bare`: other long runs with digits and letters of either case.

    A bare run that base spans overlap is no finding of its own.  Runs of access and hex lie within it whole; the
    characters of assign spans are covered, as long as they were, before bare runs are looked for.
    """
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), MARK + COVER, STAND_IN * 2)
    df = docs.withColumn("_clean", clean)
    df = with_spans(df, "_assign", "_clean", 0, ASSIGN, F.lit(2)).withColumn("_assign", F.filter("_assign", lambda s: F.char_length(s["value"]) >= LEAST_VALUE))
    df = with_spans(df, "_access", "_clean", 1, ACCESS)
    df = with_spans(df, "_hex", "_clean", 2, HEX)

    def cover(p: Column, i: Column) -> Column:
        own = (i % 2 == 1) & (F.char_length(F.regexp_extract(p, ASSIGN, 2)) >= LEAST_VALUE)
        return F.when(own, F.repeat(F.lit(COVER), F.char_length(p))).otherwise(p)

    covered = F.when(F.size("_assign") > 0, F.array_join(F.transform("__assign_pieces", cover), "")).otherwise(F.col("_clean"))
    df = with_spans(df.withColumn("_covered", covered), "_bare", "_covered", 3, f"[A-Za-z0-9+/_{COVER}-]{{32,}}")

    def alone(s: Column) -> Column:
        mixed = reduce(lambda a, b: a & b, (s["value"].rlike(x) for x in ("[0-9]", "[a-z]", "[A-Z]")))
        return mixed & ~F.contains(s["value"], F.lit(COVER)) & ~s["value"].rlike(f"{ACCESS}|{HEX}")

    df = df.withColumns({"base": F.concat("_assign", "_access", "_hex"), "bare": F.filter("_bare", alone)})
    return df.drop("_clean", "_covered", *(f"_{n}" for n in KINDS), *(f"__{n}_pieces" for n in KINDS))


def owners(each: DataFrame) -> DataFrame:
    """Over the corpus, for every candidate's hash: n_owners, n_repositories, n_places and whether it is a copied example.

    each: a row for every place of a candidate (hash, owner, repo).  Places are summed up before they move, so that a
    candidate in every document is a row for each of its owners and repositories.
    """
    places = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    counts = places.groupBy("hash").agg(F.countDistinct("owner").alias("n_owners"), F.countDistinct("repo").alias("n_repositories"), F.sum("n").alias("n_places"))
    return counts.withColumn("copied", (F.col("n_owners") > MAX_OWNERS) | (F.col("n_repositories") > MAX_REPOSITORIES))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: Column | None = None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.

    Base spans are those of the fixed patterns, and stay.  Over the whole corpus each candidate's hash is counted by
    distinct repositories (owner and language, unless another column says) and owners: one that more than MAX_OWNERS
    owners or MAX_REPOSITORIES repositories have is a copied example, any other looks like a live credential of its
    owner.  `spans` adds to the base the bare runs that look live.  Null text is empty; a null owner or repository
    counts as one of its own; rows that repeat are judged alike; ties of a span's start go by kind; other columns play
    no part, whatever their names; an empty table gives no rows.  Texts are scanned whole; one of very many matches
    takes time in proportion to them.
    """
    repo = F.concat_ws("/", F.col(owner), F.col("lang")) if repository is None else repository
    ident = {"doc_id": F.col(key), "owner": F.coalesce(F.col(owner).cast("string"), F.lit("")), "repo": F.coalesce(repo, F.lit("")), "h": text_hash(F.col(text)), "text": F.col(text)}
    hashed = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"], F.xxhash64(s["value"]).alias("hash")))
    own = docs.select(*(c.alias(n) for n, c in ident.items()))
    rows = keep(scan(own).select("doc_id", "owner", "repo", "h", hashed("base").alias("base"), hashed("bare").alias("bare")), "secret-candidates")
    each = rows.select("doc_id", "h", "owner", "repo", F.explode(F.concat("base", "bare")).alias("s")).select("doc_id", "h", "owner", "repo", "s.*")
    judged = join_counted(each, keep(owners(each), "secret-owners"), ["hash"], "n_places")
    # a document's spans come back to it in any order, once each, however often its row repeats
    one = F.struct("start", "kind", "end", "copied")
    flags = judged.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set(one).alias("found"))
    out = rows.join(flags, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    out = out.withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,end:int,copied:boolean>>")))
    spans = F.filter("found", lambda s: (s["kind"] < 3) | ~s["copied"])
    live = F.size(F.filter("found", lambda s: (s["kind"] < 3) & ~s["copied"])).cast("long")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(spans).alias("spans"), live.alias("n_live"), (F.size("base") - live).cast("long").alias("n_copied"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


_SQL_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo,
  translate(coalesce(text, ''), chr(57344) || chr(57346), chr(57345) || chr(57345)) AS t FROM documents),
k(kind, name, pat) AS (VALUES (0, 'assign', '{_SQL_ASSIGN}'), (1, 'access', 'AKIA[A-Z0-9]{{16,}}'), (2, 'hex', '[0-9a-f]{{24,}}')),
p AS (SELECT doc_id, kind, string_split(CASE kind
    WHEN 0 THEN regexp_replace(t, '{_SQL_ASSIGN}', chr(57344) || '\\0' || chr(57344), 'g')
    WHEN 1 THEN regexp_replace(t, 'AKIA[A-Z0-9]{{16,}}', chr(57344) || '\\0' || chr(57344), 'g')
    ELSE regexp_replace(t, '[0-9a-f]{{24,}}', chr(57344) || '\\0' || chr(57344), 'g') END, chr(57344)) AS ps FROM d, k),
u AS (SELECT doc_id, kind, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS v FROM p WHERE len(ps) > 1),
a AS (SELECT doc_id, string_agg(CASE WHEN i % 2 = 0 AND length(regexp_extract(v, '{_SQL_ASSIGN}', 2)) >= {LEAST_VALUE} THEN repeat(chr(57346), length(v)) ELSE v END, '' ORDER BY i) AS t
  FROM u WHERE kind = 0 GROUP BY doc_id),
b AS (SELECT doc_id, 3 AS kind, string_split(regexp_replace(coalesce(a.t, d.t), '[A-Za-z0-9+/_' || chr(57346) || '-]{{32,}}', chr(57344) || '\\0' || chr(57344), 'g'), chr(57344)) AS ps FROM d LEFT JOIN a USING (doc_id)),
w AS (SELECT * FROM u UNION ALL SELECT doc_id, kind, unnest(range(1, len(ps) + 1)), unnest(ps) FROM b WHERE len(ps) > 1),
o AS (SELECT *, CAST(sum(length(v)) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM w),
s AS (SELECT doc_id, kind, e - length(v) AS s, e, CASE kind WHEN 0 THEN regexp_extract(v, '{_SQL_ASSIGN}', 2) ELSE v END AS v FROM o WHERE i % 2 = 0),
f AS (SELECT s.*, owner, repo FROM s JOIN d USING (doc_id) WHERE CASE kind WHEN 0 THEN length(v) >= {LEAST_VALUE}
  WHEN 3 THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND NOT contains(v, chr(57346)) AND NOT regexp_matches(v, 'AKIA[A-Z0-9]{{16,}}|[0-9a-f]{{24,}}') ELSE TRUE END),
c AS (SELECT v, count(DISTINCT owner) > {MAX_OWNERS} OR count(DISTINCT repo) > {MAX_REPOSITORIES} AS copied FROM f GROUP BY v),
g AS (SELECT doc_id, kind, s, e, copied, ['assign', 'access', 'hex', 'bare'][kind + 1] || ':' || s || ':' || e AS name FROM f JOIN c USING (v)),
r AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(name, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS base, string_agg(name, ',' ORDER BY s, kind, e) FILTER (kind < 3 OR NOT copied) AS spans,
  count(*) FILTER (kind < 3 AND NOT copied) AS n_live, count(*) FILTER (kind < 3 AND copied) AS n_copied FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN r USING (doc_id)
"""
