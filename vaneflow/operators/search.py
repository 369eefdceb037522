"""Text search and ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grep(texts: DataFrame, key: str, text: str, query: str, fixed: bool = True, ignore_case: bool = False, per_text: int | None = None) -> DataFrame:
    """Lines that hold the query: (key, line, value), numbered from 1; at most per_text of each text if given."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("_i", "value"))
    if fixed:
        hit = F.contains(F.lower("value"), F.lit(query.lower())) if ignore_case else F.contains(F.col("value"), F.lit(query))
    else:
        hit = F.col("value").rlike(("(?i)" if ignore_case else "") + query)
    out = lines.filter(hit).select(key, (F.col("_i") + 1).alias("line"), "value")
    if per_text is None:
        return out
    w = Window.partitionBy(key).orderBy("line")
    return out.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_text).drop("_n")


def line_range(texts: DataFrame, key: str, text: str, first: int, last: int) -> DataFrame:
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("_i", "value")).select(key, (F.col("_i") + 1).alias("line"), "value").filter(F.col("line").between(first, last))


# What a match is worth, and what adds to it: the query as it is, a query that is a name in capitals, and
# words of lines about parameters or topics.
MATCH, HELD, NAMED, ABOUT = 1.0, 1.0, 2.0, 0.5
NAME = "^[A-Z][A-Z0-9_]{2,}$"
ABOUT_WORDS = ["param", "orb_", "uorb::"]


def match_score(value: Column, query: Column) -> Column:
    """The worth of a line that matches a query."""
    low = F.lower(value)
    about = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in ABOUT_WORDS))
    extras = [(F.contains(low, F.lower(query)), HELD), (query.rlike(NAME), NAMED), (about, ABOUT)]
    return reduce(lambda total, e: total + F.when(e[0], e[1]).otherwise(0.0), extras, F.lit(MATCH))


# What a path's beginnings, parts and endings are worth; of each group the first that fits counts.
PLACES = [("begins", "src/lib/", 30.0), ("begins", "src/modules/", 30.0), ("begins", "src/drivers/", 15.0), ("begins", "src/include/", 15.0), ("begins", "src/", 5.0)]
TESTS = [("begins", "test/", -100.0), ("holds", "/test", -100.0), ("holds", "_test", -100.0), ("holds", "/unit", -100.0)]
TEST_FILES = [("ends", "Test.cpp", -100.0), ("ends", "Test.hpp", -100.0), ("ends", "Test.h", -100.0), ("ends", "Tests.cpp", -100.0), ("ends", "Tests.hpp", -100.0), ("ends", "Tests.h", -100.0)]
FOREIGN = ["/catch2/", "/cmsis", "/libvnc/", "/third_party/", "/third-party/", "/vendor/", "/vendors/", "/external/", "/generated/", "/uavcan_drivers/"]
OTHERS = [[("holds", x, -80.0) for x in FOREIGN], [("begins", "examples/", -40.0), ("holds", "/examples/", -40.0)], [("holds", "/build", -5.0), ("holds", "/.git", -5.0)]]


def path_boost(path: Column) -> Column:
    """The worth of a path: the sum over the groups of fixed values, in lower case but for the names of test files."""
    fits = {"begins": F.startswith, "holds": F.contains, "ends": F.endswith}
    low = F.lower(path)

    def worth(*rules: tuple[Column, list]) -> Column:
        cases = [(fits[how](column, F.lit(part)), value) for column, group in rules for how, part, value in group]
        return reduce(lambda acc, case: F.when(case[0], case[1]).otherwise(acc), reversed(cases), F.lit(0.0))

    groups = [((low, PLACES),), ((low, TESTS), (path, TEST_FILES)), *(((low, g),) for g in OTHERS)]
    return reduce(lambda a, b: a + b, (worth(*g) for g in groups))


def rank_files(matches: DataFrame, key: str, cap: float, top: int, boost: Column | None = None) -> DataFrame:
    """Files by their queries' scores, each query's sum capped, and a boost: the best ones, ties by name."""
    per = matches.groupBy(key, "query").agg(F.least(F.sum("score"), F.lit(float(cap))).alias("_s"))
    out = per.groupBy(key).agg(F.sum("_s").alias("_t")).withColumn("score", F.col("_t") + (boost if boost is not None else F.lit(0.0))).drop("_t")
    return out.filter("score > 0").orderBy(F.desc("score"), key).limit(top)


# Points for each common item of a kind, and the most that they give; common symbols are strong evidence
# from so many points on.
OVERLAP = {"parameters": (8, 24), "functions": (6, 18), "symbols": (2, 8), "phrases": (6, 18), "files": (2, 8)}
STRONG = ["parameters", "functions"]
STRONG_SYMBOLS = 4


def overlap_score(query: dict[str, Column], record: dict[str, Column]) -> Column:
    """Relevance of a record: capped points for what it has in common with the query, by kind; 0 without strong evidence.

    query and record hold arrays by kind.
    """
    points = {kind: F.least(F.size(F.array_intersect(query[kind], record[kind])) * each, F.lit(most)) for kind, (each, most) in OVERLAP.items()}
    symbols = F.when(points["symbols"] >= STRONG_SYMBOLS, points["symbols"]).otherwise(0)
    strong = reduce(lambda a, b: a + b, (points[kind] for kind in STRONG), symbols)
    return F.when(strong > 0, reduce(lambda a, b: a + b, points.values())).otherwise(0)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda x: x != ""))


def anchors(texts: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """Tokens of texts that are known names (kind, name), exactly."""
    words = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))).alias("name"))
    return words.join(known, "name")


def worst_status(checks: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The worst of several statuses, worst first in the order."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("status"))
    return checks.groupBy(key).agg(F.min_by("status", rank).alias("status"))


def fact_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, each with its side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
