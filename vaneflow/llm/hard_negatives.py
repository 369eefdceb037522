"""Hard negatives by exact inner products, with candidates discarded early after an orthogonal PCA rotation.

A rotation by the principal axes leaves inner products as they are and moves most of a vector's length into its leading
components.  A pair's partial product over these, plus the product of what is left of both lengths, bounds its score;
where the bound falls short the pair goes, and what survives the last cut is computed from the whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, keep, mark, release, table, trim
from .vectors import matrix, of_one_length, whole_vectors

#: The rotation is fitted to so many rows, those of least hash; it decides on speed, never on results.
SAMPLE = 4096
#: Anchors are sent to all tasks a block at a time, of so many bytes as doubles.
ANCHOR_BYTES = 16 << 20
#: Pairs are looked at after these parts of the components.
CUTS = (0.25, 0.5)
#: Anchors and rows compared at once; a task's first rows are few, since there are no thresholds yet.
ANCHORS, ROWS, FIRST_ROWS = 1024, 2048, 128


class Rotation:
    """An orthogonal matrix, and a bound on what it and rounding change in an inner product, as a part of both lengths."""

    def __init__(self, sample: np.ndarray, width: int):
        moments = sample.T.astype(np.float64) @ sample if len(sample) else np.zeros((width, width))
        values, axes = np.linalg.eigh(moments)
        self.axes = axes[:, np.argsort(-values, kind="stable")]
        off = np.linalg.norm(self.axes @ self.axes.T - np.eye(width)) if width else 0.0
        self.slack = float(off) * 2 + 32 * (width + 16) * 2.0**-52
        self.cuts = sorted({min(width, max(1, int(width * c))) for c in CUTS} - {width}) if width else []

    def turn(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rotated rows, what is left of their lengths behind each cut [cuts, rows], and their lengths; lengths are rounded up."""
        y = x.astype(np.float64) @ self.axes
        left = [np.sqrt((y[:, c:] ** 2).sum(1)) * (1 + self.slack) for c in self.cuts]
        return y, np.array(left).reshape(len(self.cuts), len(x)), np.sqrt((y**2).sum(1)) * (1 + self.slack)


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of a with rows j of b, in whole numbers."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), 1 << 16):
        out[at : at + (1 << 16)] = np.einsum("ij,ij->i", a[i[at : at + (1 << 16)]], b[j[at : at + (1 << 16)]])
    return out


def survivors(rot: Rotation, q: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], low: np.ndarray, high: np.ndarray, barred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor i, row j), but for the barred ones, whose score may lie between low[i] and high[i]."""
    live, partial, at = ~barred & (low <= high)[:, None], 0.0, 0
    for n, cut in enumerate(rot.cuts):
        slack = rot.slack * q[2][:, None] * y[2][None, :]
        if n == 0 or live.mean() > 0.25:
            partial = partial + q[0][:, at:cut] @ y[0][:, at:cut].T
            rest = q[1][n][:, None] * y[1][n][None, :] + slack
            live &= (partial + rest >= low[:, None]) & (partial - rest <= high[:, None])
        else:  # few pairs are left: theirs alone
            i, j = np.nonzero(live)
            partial[i, j] += np.einsum("ij,ij->i", q[0][i, at:cut], y[0][j, at:cut])
            rest = q[1][n][i] * y[1][n][j] + slack[i, j]
            live[i, j] = (partial[i, j] + rest >= low[i]) & (partial[i, j] - rest <= high[i])
        at = cut
    return np.nonzero(live)


class Tops:
    """The k best of each list: by score downwards, then by id, null last."""

    def __init__(self, lists: int, k: int):
        self.k, self.least = k, np.full(lists, -np.inf)
        self.rows = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def add(self, where: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        if not len(where):
            return
        w, s, i, o = (np.concatenate(x) for x in zip(self.rows, (where, score, ids, none), strict=True))
        order = np.lexsort((i, o, -s, w))
        w, s, i, o = w[order], s[order], i[order], o[order]
        first = np.concatenate([[True], w[1:] != w[:-1]])
        rank = np.arange(len(w)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        full = rank == self.k - 1
        self.least[w[full]] = s[full]
        stay = rank < self.k
        self.rows = (w[stay], s[stay], i[stay], o[stay])

    def batch(self) -> pa.RecordBatch:
        w, s, i, o = self.rows
        return pa.RecordBatch.from_arrays([pa.array(w), pa.array(i, mask=o), pa.array(s)], ["list", "id", "score"])


TOPS = "list long, id long, score long"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """Ids, which are null, labels and vectors, a few rows at a time."""
    take = FIRST_ROWS
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, take)
            ids = part.column(0)
            yield pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False), part.column(1), matrix(part.column(2))
            at, take = at + take, min(ROWS, 2 * take)
        trim()


def _codes(labels: pa.Array, known: pa.Array) -> np.ndarray:
    """The labels' numbers among the anchors' labels, -1 for others."""
    return pc.fill_null(pc.index_in(labels, value_set=known), -1).to_numpy(zero_copy_only=False)


def _positives(rot: Rotation, sent, k: int) -> Callable:  # noqa: ANN001
    """For each anchor the k best rows of its label and another id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        q, tops = rot.turn(a["x"]), Tops(len(a["x"]), k)
        own = [np.flatnonzero(a["code"] == c) for c in range(len(a["labels"]))]
        for ids, none, labels, x in _chunks(batches):
            code, y = _codes(labels, a["labels"]), rot.turn(x)
            for c in np.unique(code[code >= 0]):
                js = np.flatnonzero(code == c)
                for at in range(0, len(own[c]), ANCHORS):
                    me = own[c][at : at + ANCHORS]
                    barred = (ids[js][None, :] == a["id"][me][:, None]) & ~none[js][None, :]
                    i, j = survivors(rot, (q[0][me], q[1][:, me], q[2][me]), (y[0][js], y[1][:, js], y[2][js]), tops.least[me], np.full(len(me), np.inf), barred)
                    i, j = me[i], js[j]
                    score = products(a["x"], x, i, j)
                    good = score >= tops.least[i]
                    tops.add(i[good], score[good], ids[j[good]], none[j[good]])
        yield tops.batch()

    return run


def _negatives(rot: Rotation, sent, k: int) -> Callable:  # noqa: ANN001
    """For each anchor's windows of scores the k best rows of another label inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        q, low, high = rot.turn(a["x"]), a["low"], a["high"]  # of windows [anchors, positives]; low above high where there is none
        tops = Tops(low.size, k)
        for ids, none, labels, x in _chunks(batches):
            code, y = _codes(labels, a["labels"]), rot.turn(x)
            for at in range(0, len(q[0]), ANCHORS):
                me = slice(at, at + ANCHORS)
                least = np.maximum(low[me], tops.least.reshape(low.shape)[me])
                least = np.where(least <= high[me], least, np.inf)
                most = np.where(np.isfinite(least), high[me], -np.inf)
                barred = code[None, :] == a["code"][me][:, None]
                i, j = survivors(rot, (q[0][me], q[1][:, me], q[2][me]), y, least.min(1), most.max(1), barred)
                score = products(a["x"][me], x, i, j)
                pair, window = np.nonzero((score[:, None] >= least[i]) & (score[:, None] <= high[me][i]))
                where = (i[pair] + at) * low.shape[1] + window
                tops.add(where, score[pair], ids[j[pair]], none[j[pair]])
        yield tops.batch()

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of what tasks found for each list, with their rank."""
    order = Window.partitionBy("list").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _mine_block(rows: DataFrame, anchors: DataFrame, rot: Rotation, n_pos: int, n_neg: int, low_pct: int, high_pct: int) -> DataFrame:
    """The negatives of one block of anchors, ANCHOR_BYTES of them: two scans of all rows."""
    sc = rows.sparkSession.sparkContext
    mine = anchors.orderBy("vec_id", "label", "x").toArrow()
    labels = pc.unique(mine["label"].combine_chunks())
    sent = {"id": mine["vec_id"].to_numpy(), "x": matrix(mine["x"].combine_chunks()), "labels": labels, "code": _codes(mine["label"].combine_chunks(), labels)}
    first = sc.broadcast(sent)
    got = _best(rows.mapInArrow(_positives(rot, first, n_pos), TOPS), n_pos).collect()  # n_pos rows an anchor
    low, high = np.ones((len(sent["id"]), n_pos)), np.zeros((len(sent["id"]), n_pos))
    lists = []
    for r in got:
        low[r.list, r.rank - 1], high[r.list, r.rank - 1] = -((-low_pct * r.score) // 100), (high_pct * r.score) // 100
        lists.append((r.list * n_pos + r.rank - 1, int(sent["id"][r.list]), r.id, r.score))
    second = sc.broadcast(sent | {"low": low, "high": high})
    best = _best(rows.mapInArrow(_negatives(rot, second, n_neg), TOPS), n_neg)
    named = rows.sparkSession.createDataFrame(lists, "list long, anchor_id long, positive_id long, positive_score long")
    out = best.join(F.broadcast(named), "list").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = keep(out, "negatives")
    first.destroy()
    second.destroy()
    return out


def hard_negatives(df: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", n_pos: int = 5, n_neg: int = 10, low_pct: int = 30, high_pct: int = 90) -> DataFrame:
    """For each anchor and each of its positives the first negatives: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    A row's score is the inner product of floor(256 * x) of its components with the anchor's, an exact whole number;
    higher ones come first, ties by id, null last.  Positives: the first n_pos rows of the anchor's label and another id.
    Negatives of a positive: the first n_neg rows of another label with low_pct * positive_score <= 100 * score <=
    high_pct * positive_score, fewer or none if there aren't so many.  is_anchor is a condition on the integer key,
    named vec_id.

    Rows with a null label, a null vector or a null or non-finite component take no part, nor do vectors of another
    length than that of the least id; components count as 2**24 beyond that.  Rows without an id are no anchors but may
    be positives and negatives.  Rows that repeat are rows each, but an anchor that repeats in id, label and vector is
    one anchor.  Labels may be of any type that casts to a string, and may hold any part of the rows.  Other columns
    play no part; an empty table, or one without anchors, gives no rows.

    Anchors go to all tasks in blocks of ANCHOR_BYTES; each block scans all rows twice, first for positives, then within
    the windows of scores that they set.  No pair leaves a task unless it is among the task's best of its list.
    """
    bound_batches(df.sparkSession)
    since = mark()
    labelled = df.filter(F.col(label).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(label).cast("string").alias(label), vector)
    rows, width = of_one_length(keep(whole_vectors(labelled, key, label, vector), "whole-vectors"))
    anchors = rows.filter("vec_id is not null").filter(is_anchor).dropDuplicates(["vec_id", "label", "x"])
    hashed = F.xxhash64("vec_id", "label", "x")
    total = anchors.count()
    blocks = -(-5 * total * max(1, width) * 8 // (4 * ANCHOR_BYTES))  # a quarter more than they need, since hashes deal unevenly
    anchors = keep(anchors.withColumn("block", F.pmod(hashed, F.lit(max(1, blocks))).cast("int")), "anchors", "block")
    sample = rows.orderBy(hashed).select("x").limit(SAMPLE).collect() if width else []
    rot = Rotation(matrix([bytes(r.x) for r in sample]), width)
    out = None
    for b in range(blocks):
        found = _mine_block(rows, anchors.filter(F.col("block") == b).drop("block"), rot, n_pos, n_neg, low_pct, high_pct)
        out = found if out is None else out.unionByName(found)
    if out is None:
        names = ("anchor_id long", "positive_id long", "rank int", "negative_id long", "positive_score long", "negative_score long")
        return df.sparkSession.createDataFrame([], ", ".join(names))
    release(df.sparkSession, since, out)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", noisy), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, id AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
