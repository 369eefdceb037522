"""Message definitions as a whole: nested fields flattened, enums of fields with their aliases, declared constants.

A definition is a file `Name.msg`.  Its topics are those that it lists, or its name in lower case with underscores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .readers import message_constants, message_fields


# Fixed value: a word of a comment that may be the beginning of labels.
CAPITALS = "[A-Z][A-Z0-9_]{2,}"


def _message(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.msg$", 1)


def snake(name: Column) -> Column:
    """CamelCase as lower case with underscores: a word begins at a capital behind a small letter or digit, or before a small letter."""
    return F.lower(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_"))


def topics(texts: DataFrame) -> DataFrame:
    """(message, topic) of definitions (path, text)."""
    listed = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^#\s*TOPICS\s+(.*)$"), F.lit(1)), lambda x: F.split(F.trim(x), r"\s+")))
    m = texts.select(_message(F.col("path")).alias("message"), listed.alias("_l"))
    return m.select("message", F.explode(F.when(F.size("_l") > 0, F.col("_l")).otherwise(F.array(snake(F.col("message"))))).alias("topic"))


def flat_fields(texts: DataFrame) -> DataFrame:
    """(message, field, owner, name, type, array_size, comment): fields of every definition, those of nested ones by their path.

    owner is the definition in which the field stands.  A definition inside itself ends its path there, so
    levels end when no field is nested, however deep.  Definitions are a source tree's, so a level is a small join.
    """
    own = message_fields(texts).withColumn("message", _message(F.col("path"))).drop("path", "line")
    names = own.select(F.col("message").alias("type")).distinct()
    front = own.select("message", F.array("message").alias("seen"), F.col("name").alias("field"), F.col("message").alias("owner"), "name", "type", "array_size", "comment")
    done = []
    while True:
        done.append(front.join(names, "type", "left_anti").drop("seen"))
        nested = front.join(names, "type", "left_semi").filter(~F.array_contains("seen", F.col("type")))
        if nested.isEmpty():
            break
        inner = own.select(F.col("message").alias("owner"), "name", F.col("type").alias("_t"), F.col("array_size").alias("_a"), F.col("comment").alias("_c"))
        down = nested.select("message", "seen", "field", F.col("type").alias("owner")).join(inner, "owner")
        front = down.select("message", F.array_append("seen", F.col("owner")).alias("seen"), F.concat_ws(".", "field", "name").alias("field"), "owner", "name", F.col("_t").alias("type"), F.col("_a").alias("array_size"), F.col("_c").alias("comment"))
    columns = ["message", "field", "owner", "name", "type", "array_size", "comment"]
    return reduce(DataFrame.unionByName, (d.select(*columns) for d in done))


def schema(texts: DataFrame) -> DataFrame:
    """(topic, field)."""
    return flat_fields(texts).join(topics(texts), "message").select("topic", "field").distinct()


def field_enums(texts: DataFrame) -> DataFrame:
    """(topic, field, label, value): constants of the field's definition whose labels begin with the field's name, or with a word in capitals of its comment."""
    constants = message_constants(texts).select(_message(F.col("path")).alias("owner"), "label", "value")
    own = F.upper(F.array_join(F.filter(F.split("name", "[^A-Za-z0-9]"), lambda w: w != ""), "_"))
    said = F.filter(F.split(F.coalesce("comment", F.lit("")), r"\W+"), lambda w: w.rlike(f"^{CAPITALS}$"))
    fields = flat_fields(texts).select("message", "field", "owner", F.explode(F.array_distinct(F.concat(F.array(own), said))).alias("prefix"))
    fits = (F.col("label") == F.col("prefix")) | F.startswith("label", F.concat("prefix", F.lit("_")))
    return fields.join(constants, "owner").filter(fits).join(topics(texts), "message").select("topic", "field", "label", "value").distinct()


def enum_aliases(enums: DataFrame) -> DataFrame:
    """(topic, field, alias, value): every label, and what is left of it without the words that all of the field's labels begin with, where one label alone has that rest."""
    key = ["topic", "field"]
    tokens = F.split("label", "_")
    # words that the least and the greatest share at their beginning are shared by all
    ends = enums.groupBy(*key).agg(F.min(tokens).alias("_a"), F.max(tokens).alias("_b"))
    same = F.zip_with("_a", "_b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    shared = F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size("_a"))
    rest = enums.join(ends.select(*key, shared.cast("int").alias("_n")), key).filter((F.col("_n") > 0) & (F.size(tokens) > F.col("_n")))
    short = rest.select(*key, F.array_join(F.slice(tokens, F.col("_n") + 1, F.size(tokens)), "_").alias("alias"), "value")
    one = short.groupBy(*key, "alias").agg(F.count("*").alias("_k"), F.min("value").alias("value")).filter("_k = 1").drop("_k")
    labels = enums.select(*key, F.col("label").alias("alias"), "value")
    return labels.unionByName(one.join(labels, [*key, "alias"], "left_anti"))


def declared_constants(texts: DataFrame) -> DataFrame:
    """(owner, label, value): constants by topic and by definition's name; a label with two values under one owner is left out."""
    named = message_constants(texts).select(_message(F.col("path")).alias("message"), "label", "value")
    owners = topics(texts).unionByName(texts.select(_message(F.col("path")).alias("message"), snake(_message(F.col("path"))).alias("topic"))).distinct()
    per = named.join(owners, "message").groupBy(F.col("topic").alias("owner"), "label").agg(F.count_distinct("value").alias("_k"), F.min("value").alias("value"))
    return per.filter("_k = 1").drop("_k")
