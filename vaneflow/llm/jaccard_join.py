"""Self-join of documents on the Jaccard similarity of word shingles, with Bayesian pruning (Satuluri & Parthasarathy, 2012)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, join_counted, keep, table, text_hash, trim
from .components import components

WORDS, THRESHOLD = 5, 0.8
#: MinHash values; BANDS bands of ROWS each make candidates: a pair at the threshold is missed once in 10 million times.
HASHES, BANDS = 128, 32
ROWS = HASHES // BANDS
#: Values compared between two looks at the posterior, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 32, 1e-6
#: A block of a group holds about so many members and shingles; larger groups are compared block by block.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 200_000
#: A block of a bucket, compared by MinHash values alone, holds about so many members.
BUCKET_MEMBERS = 2048
#: Sets of a block are compared as bits up to so many bytes, pair by pair beyond.
BITS_BYTES = 24 << 20
MAX_IDS_SENT = 1_000_000
BATCH = 1 << 20

_TOKEN = np.zeros(256, np.uint8)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = 1
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _family() -> tuple[np.ndarray, np.ndarray]:
    r = _mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (r[:HASHES] & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1), (r[HASHES:] & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes of 64 bits, which stand for the shingles: WORDS words in a row, lower-cased in A-Z; a text of fewer words, but not none, has one shingle."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    doc_start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    token = _TOKEN[buf]
    edge = np.diff(np.concatenate([[0], token]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    none = np.zeros(0, np.uint64)
    if not len(starts):
        return [none] * len(texts)
    weights = _mix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)
    lead = np.zeros(len(buf), np.int32)
    lead[starts] = starts
    place = np.arange(len(buf), dtype=np.int32) - np.maximum.accumulate(lead)
    value = (_LOWER[buf] + np.uint64(1)) * weights[place & 4095]
    if (far := np.flatnonzero(place >> 12)).size:  # words of over 4,096 bytes: their weights never repeat
        value[far] *= _mix((place[far] >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    value[token == 0] = 0
    h = _mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))
    n = np.bincount(np.searchsorted(doc_start, starts, "right") - 1, minlength=len(texts))
    at = np.cumsum(n) - n
    c = _mix(np.arange(7, 7 + WORDS, dtype=np.uint64)) | np.uint64(1)
    if len(h) >= WORDS:
        g = h[: len(h) - WORDS + 1] * c[0]
        for j in range(1, WORDS):
            g = g + h[j : len(h) - WORDS + 1 + j] * c[j]
        g = _mix(g)
    out = []
    for a, k in zip(at.tolist(), n.tolist(), strict=True):
        if k >= WORDS:
            s = np.sort(g[a : a + k - WORDS + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(_mix(np.array([int((h[a : a + k] * c[:k]).sum()) ^ k], np.uint64)) if k else none)
    return out


def minhash(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, best = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(best, ((x[i : i + 512, None] ^ b) * a).min(0), out=best)
    return best


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Shingle sets a few MB of text at a time, with the rows' first and last number."""
    data, at = [x.encode() if x else b"" for x in column.to_pylist()], 0
    while at < len(data):
        to, size = at, 0
        while to < len(data) and (to == at or size + len(data[to]) < BATCH):
            size += len(data[to])
            to += 1
        yield at, to, shingle_sets(data[at:to])
        at = to


def _node(s: np.ndarray) -> bytes:
    return hashlib.sha1(s.tobytes()).digest()[:16]


def _bands(m: np.ndarray) -> np.ndarray:
    m = m.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, r])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds node, bands and the lowest byte of each MinHash value; ids pass as they are."""
    a, b = _family()
    for batch in batches:
        for at, to, sets in _texts(batch.column(2)):
            values = [minhash(s, a, b) if len(s) else None for s in sets]
            made = [
                pa.array([_node(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([None if m is None else _bands(m) for m in values], pa.list_(pa.int64())),
                pa.array([None if m is None else m.astype(np.uint8).tobytes() for m in values], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], batch.column(1)[at:to], *made], ["doc_id", "text_hash", "node", "bands", "sig"])
        trim()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, sets in _texts(batch.column(0)):
            full = [s for s in sets if len(s)]
            made = [pa.array([_node(s) for s in full], pa.binary()), pa.array(list(map(len, full)), pa.int64()), pa.array([s.tobytes() for s in full], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["node", "n", "shingles"])
        trim()


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number n of compared values the fewest matches with P(similarity >= threshold) at the tolerance or more, under a uniform prior.

    The posterior after m matches is Beta(m + 1, n - m + 1), so that probability is P(Binomial(n + 1, threshold) <= m).
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        p = 0.0
        for m in range(n + 1):
            p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if p >= tolerance:
                out[n] = m
                break
    return out


def likely(sigs: np.ndarray, i: np.ndarray | int, js: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which of the pairs (i, js) are still likely after every look at more of their MinHash values."""
    live, matches = np.arange(len(js)), np.zeros(len(js), np.int64)
    for n in range(STEP, HASHES + 1, STEP):
        own = sigs[i, n - STEP : n] if np.ndim(i) == 0 else sigs[i[live], n - STEP : n]
        matches += (sigs[js[live], n - STEP : n] == own).sum(1)
        keep_ = matches >= least[n]
        live, matches = live[keep_], matches[keep_]
    return live


def _forest(sigs: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, least: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Pairs that tie all members which likely pairs join; members that are tied already are not compared again."""
    label = np.arange(len(sigs))
    for i in left.tolist():
        js = right[right > i] if same else right
        js = js[label[js] != label[i]]
        js = js[likely(sigs, i, js, least)]
        _, one = np.unique(label[js], return_index=True)
        for j in js[one].tolist():
            yield i, j
            label[label == label[j]] = label[i]


def _tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and pair of blocks: the nodes of each that likely pairs tie together."""
    least, held, tail = least_matches(), [], None

    def pairs(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        bucket, bi, bj, block = (t[c].to_numpy() for c in ("bucket", "bi", "bj", "block"))
        node = t["node"].combine_chunks()
        sigs = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, HASHES)
        new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(bucket)))
        two = first[size == 2]  # most buckets: one pair each, all at once
        two = two[(bi[two] == bj[two]) | (block[two] != block[two + 1])]
        live = two[likely(sigs, two, two + 1, least)]
        a, b = [live], [live + 1]
        for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own, places = block[at : at + n], np.arange(n)
            got = list(_forest(sigs[at : at + n], places[own == bi[at]], places[own == bj[at]], bi[at] == bj[at], least))
            if got:
                a.append(np.array([x for x, _ in got]) + at)
                b.append(np.array([x for _, x in got]) + at)
        return pa.RecordBatch.from_arrays([node.take(pa.array(np.concatenate(a))), node.take(pa.array(np.concatenate(b)))], ["a", "b"])

    # a group may go on in the next batch: what follows the last change of group is held back
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
        change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0))
        if tail is not None and (keys[:, 0] != tail).any():
            yield pairs(held)
            held = []
        if len(change):
            cut = int(change[-1]) + 1
            yield pairs([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
        tail = keys[:, -1]
    if held:
        yield pairs(held)


def linked_pairs(sigs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of members, i from left and j from right (i before j if they are the same block), that are alike enough: pruned by MinHash values, then verified exactly."""
    least, sizes = least_matches(), np.fromiter(map(len, sets), np.int64, len(sets))
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    names, ids = np.unique(every, return_inverse=True)
    bits = None
    if len(sets) * (len(names) + 7) // 8 <= BITS_BYTES and len(sets) > 2:
        bits = np.zeros((len(sets), -(-len(names) // 64)), np.uint64)
        np.bitwise_or.at(bits, (owner, ids >> 6), np.uint64(1) << (ids & 63).astype(np.uint64))
    for i in left:
        js = right[right > i] if same else right
        small, big = np.minimum(sizes[i], sizes[js]), np.maximum(sizes[i], sizes[js])
        js = js[small >= THRESHOLD * big]
        js = js[likely(sigs, i, js, least)]
        if not len(js):
            continue
        if bits is not None:
            both = np.concatenate([np.bitwise_count(bits[js[a : a + 64]] & bits[i]).sum(1, dtype=np.int64) for a in range(0, len(js), 64)])
        else:
            both = np.fromiter((len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in js), np.int64, len(js))
        js = js[both >= THRESHOLD * (sizes[i] + sizes[js] - both) - 1e-9]
        if len(js):
            yield np.full(len(js), i), js


def _verify(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links inside one pair of blocks: every member's linked documents, and a spanning forest.  No ids come here."""
    pdf = pdf.sort_values("node").reset_index(drop=True)
    sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
    sigs = np.stack([np.frombuffer(x, np.uint8) for x in pdf["sig"]])
    block, docs = pdf["block"].to_numpy(), pdf["n_docs"].to_numpy()
    bi, bj = pdf["bi"].iloc[0], pdf["bj"].iloc[0]
    links, root = np.zeros(len(pdf), np.int64), np.arange(len(pdf))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, js in linked_pairs(sigs, sets, np.flatnonzero(block == bi), np.flatnonzero(block == bj), bi == bj):
        links[i[0]] += docs[js].sum()
        links[js] += docs[i[0]]
        for j in js.tolist():
            x, y = find(int(i[0])), find(j)
            root[max(x, y)] = min(x, y)
    top = [find(x) for x in range(len(pdf))]
    out = pd.DataFrame({"node": pdf["node"], "links": links, "root": pdf["node"].to_numpy()[top]})
    out = out[links > 0]
    if len(pdf) > 64:
        trim()
    return out


def _paired(members: DataFrame, n_blocks: Column, *columns: str) -> DataFrame:
    """Members dealt into n_blocks blocks, each row once for every pair of blocks that its own is in."""
    blocked = members.withColumn("_nb", n_blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("_nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_o")
    return blocked.select(*columns, "block", other).withColumns({"bi": F.least("block", "_o"), "bj": F.greatest("block", "_o")}).drop("_o")


def candidates(nodes: DataFrame) -> DataFrame:
    """(node, comp): groups of nodes that hold all pairs which share a bucket and aren't pruned.

    Nodes that share a band's bucket are compared there by their MinHash values a few at a time; what leaves a bucket is
    a forest that ties the members of pairs which stay likely, so that groups don't grow along text that merely fills
    the same bucket.  A bucket of very many members is compared block by block.
    """
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = keep(banded.groupBy("bucket").agg(F.count("*").alias("n_members")).filter("n_members > 1"), "buckets")
    members = keep(join_counted(banded, shared, ["bucket"], "n_members"), "bucket-members")
    signed = members.join(nodes.select("node", "sig"), "node")
    rows = _paired(signed, F.ceil(F.col("n_members") / BUCKET_MEMBERS), "bucket", "node", "sig").select("bucket", "bi", "bj", "block", "node", "sig")
    dealt = rows.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    ties = dealt.mapInArrow(_tie, "a binary, b binary")
    return keep(components(ties, "candidates").withColumnRenamed("root", "comp"), "candidate-groups")


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id (least doc_id of those that links join to it), n_links (other documents
    of similarity THRESHOLD or more), n_same (the number of documents with the very same shingles), class_node (names
    the class even where no member has an id; null for texts without words) and text_hash (with doc_id, names the row).

    Documents of equal shingle sets stand as one node with a count.  Pairs that share a MinHash band's bucket are
    compared incrementally and dropped when they are unlikely to reach the threshold; shingle sets are made only for the
    nodes that remain, and verified exactly (over all shingles' 64-bit hashes, not a sample of them) within the groups that likely pairs tie
    together, block by block where a group is large.  Only counts and a spanning forest leave a task.  No bucket, group or number of partners is capped.

    Null, empty and wordless texts link to nothing and are classes of their own.  Ids may be of any type with an order;
    they never pass through Python.  A null id is never a class_id unless its class has no other.  Texts are read whole,
    however long; a text of fewer than WORDS words is one shingle.  Repeated rows are copies of each other; rows that
    share an id but not the text are documents of their own.  Other columns play no part, whatever their names; an empty
    table gives no rows.
    """
    rows = docs.select(F.col(key).alias("doc_id"), text_hash(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = keep(rows.mapInArrow(_sign, f"doc_id {kind}, text_hash long, node binary, bands array<long>, sig binary"), "signatures")
    worded = signed.filter("node is not null")
    one = F.min(F.struct("doc_id", "text_hash")).alias("one")  # the row that stands for its node
    per_node = worded.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_docs"), one, F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = keep(per_node, "nodes")
    group = candidates(nodes)

    chosen = keep(nodes.join(group, "node", "left_semi").select(F.col("one.doc_id").alias("_id"), F.col("one.text_hash").alias("_h")), "candidate-rows")
    chosen, _ = broadcast_if_small(chosen, MAX_IDS_SENT)
    texts = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_h")), "left_semi").select("text")
    sets = texts.mapInArrow(_sets, "node binary, n long, shingles binary").dropDuplicates(["node"])
    members = keep(sets.join(group, "node").join(nodes.select("node", "n_docs", "sig"), "node"), "candidate-sets")
    shape = members.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    n_blocks = F.greatest(F.ceil(F.col("m") / BLOCK_MEMBERS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    shape = keep(shape.select("comp", "m", n_blocks.alias("nb")), "candidate-shapes")
    paired = _paired(join_counted(members, shape, ["comp"], "m"), F.col("nb"), "comp", "node", "n_docs", "shingles", "sig")
    found = keep(paired.groupBy("comp", "bi", "bj").applyInPandas(_verify, "node binary, links long, root binary"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    if shape.filter("nb > 1").isEmpty():
        roots = found.select("node", "root")
    else:
        roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "classes")
    named = keep(roots.join(links, "node").join(nodes.select("node", "first_id"), "node"), "linked-nodes")
    classes = keep(named.groupBy("root").agg(F.min("first_id").alias("class_id"), F.count("*").alias("n_nodes")), "classes-named")
    linked = join_counted(named, classes, ["root"], "n_nodes").select("node", "root", "class_id", "links")

    class_id, class_node = F.coalesce("class_id", "first_id").alias("class_id"), F.coalesce("root", "node").alias("class_node")
    labels = nodes.join(linked, "node", "left").select("node", class_id, class_node, "n_docs", F.coalesce("links", F.lit(0)).alias("links"))
    out = join_counted(worded.select("doc_id", "text_hash", "node"), keep(labels, "node-labels"), ["node"], "n_docs")
    n_links = (F.col("links") + F.col("n_docs") - 1).cast("long").alias("n_links")
    out = out.select("doc_id", "class_id", n_links, F.col("n_docs").alias("n_same"), "class_node", "text_hash")
    alone = signed.filter("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_same"), F.lit(None).cast("binary").alias("class_node"), "text_hash")
    return out.unionByName(alone)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).drop("class_node", "text_hash")


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + 5], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b, k = x.n AND k = y.n AS same FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.root FROM r JOIN l ON r.doc_id = l.a)
SELECT doc_id, min(root) AS class_id, coalesce(any_value(m.links), 0) AS n_links, coalesce(any_value(m.same), 0) + 1 AS n_same
FROM r LEFT JOIN (SELECT a AS doc_id, count(*) AS links, count(*) FILTER (same) AS same FROM l GROUP BY a) m USING (doc_id) GROUP BY doc_id
"""
