"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, then encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; run() writes a stage's rows to the
shared folder and reads them again as the next one's docs.

A row is named by its doc_id and the hash of its text, null-safely, so that of rows that share an id, or have none, a
stage drops the ones it means.  Rows that repeat both stand and fall together, but where a stage leaves one of a group.
Null texts count as empty.  Extra columns of documents stay as they are, whatever their names; empty tables give empty
results; texts are read whole, however long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaneflow.llm import decontaminate, exact_dedup, jaccard_join, quality, sentencepiece
from vaneflow.llm.common import broadcast_if_small, join_counted, keep, lower_ascii, mark, release, table, text_hash

#: Names of rows (an id and a hash) are broadcast up to this count and 64 MB, both proven; beyond, they are joined by a shuffle.
MAX_DROPPED_SENT = 1_000_000


def _named(docs: DataFrame, rows: DataFrame, name: Column, how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) the rows that `rows` names: (doc_id, name)."""
    own = [f"_{x}_{uuid.uuid4().hex}" for x in ("id", "name")]  # no name of docs, whatever those are
    listed = keep(rows.toDF(*own).distinct(), "named-rows")
    size = F.coalesce(F.octet_length(F.col(own[0]).cast("string")), F.lit(0)) + 16
    listed, _ = broadcast_if_small(listed, MAX_DROPPED_SENT, size)
    return docs.join(listed, F.col("doc_id").eqNullSafe(F.col(own[0])) & (name == F.col(own[1])), how)


def _once(docs: DataFrame, again: DataFrame, name: Column) -> DataFrame:
    """docs with one row for each name in `again` (doc_id, name), which more than one row of docs has."""
    if again.isEmpty():
        return docs
    tag, columns = f"_name_{uuid.uuid4().hex}", docs.columns
    one = _named(docs, again, name, "left_semi").withColumn(tag, name).dropDuplicates(["doc_id", tag])
    return _named(docs, again, name, "left_anti").select(*columns).unionByName(one.select(*columns))


def _digest() -> Column:
    return F.xxhash64(F.sha2(F.coalesce(lower_ascii(F.col("text")), F.lit("")), 256))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels, doesn't reject.

    The score comes from the text alone, so rows that repeat, and rows without an id, are judged like any other; empty
    texts get a score too.  Where there are no labels to learn from no document is rejected.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    if model is None:
        return docs
    return docs.filter(quality.score_column(model, F.col("text")) >= quality.THRESHOLD)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, lower-cased in A-Z, one row: one of the largest doc_id, or without an id where none has one."""
    found = keep(exact_dedup.exact_dedup(docs), "exact").select("doc_id", F.xxhash64("text_sha256").alias("name"), "kept")
    left = _named(docs, found.filter("not kept").select("doc_id", "name"), _digest(), "left_anti")
    again = keep(found.filter("kept").groupBy("doc_id", "name").count().filter("count > 1").select("doc_id", "name"), "repeated")
    return _once(left, again, _digest())


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row: of the least doc_id, a null one only where none has an id; ties by the text's hash.

    Texts without words are no copies of each other here.
    """
    found = keep(jaccard_join.similar_documents(docs).filter("class_node is not null").select("class_node", "doc_id", "text_hash"), "near")
    stays = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("stays")
    classes = keep(found.groupBy("class_node").agg(stays, F.count("*").alias("n")).filter("n > 1"), "near-classes")
    members = join_counted(found, classes, ["class_node"], "n")
    one = F.col("stays.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("stays.text_hash") == F.col("text_hash"))
    left = _named(docs, members.filter(~one).select("doc_id", "text_hash"), text_hash(F.col("text")), "left_anti")
    again = keep(members.filter(one).groupBy("doc_id", "text_hash").count().filter("count > 1").select("doc_id", "text_hash"), "repeated")
    return _once(left, again, text_hash(F.col("text")))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark's window; a benchmark without words takes none away."""
    found = decontaminate.contaminated_words(docs, table(spark, sf_dir, "benchmark"))
    return _named(docs, found.filter("contaminated").select("doc_id", "text_hash"), text_hash(F.col("text")), "left_anti")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled encodings of every document that is left, with their ids; of an empty text the one of no pieces."""
    return sentencepiece.encode_documents(docs, with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("jaccard_join", near_stage),
    ("decontamination", leak_stage),
    ("sentencepiece", encode_stage),
]

#: No SQL can express the classifier and the sampler; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encodings of what all stages leave of documents.  When a stage is written, all that it was made from is deleted."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, since, docs)
    return docs
