"""Removal of repeated strings by sorted suffixes.

Every string of SPAN bytes is judged by its anchor, the gram of GRAM bytes in it with the least hash: equal strings
have equal anchors at equal places.  Anchors are the sampled suffixes of the sort: those whose gram no other place has
are done; those whose whole surroundings occur earlier are done as well.  For the others the suffixes that start at the
anchors, and the reversed prefixes that end there, are sorted gram by gram, with runs on disk and a priority queue over
their heads where they outgrow memory, and the lengths of common prefixes with the neighbour in either order are kept.
The suffixes at the other places of a string are then induced from their anchor's: two strings with their anchor at
offset d are equal when both neighbours' common lengths reach SPAN - d on the right and d on the left.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, table, trim

SPAN, GRAM = 100, 16
#: Gram starts in a string.
WIDTH = SPAN - GRAM + 1
#: Bytes hashed together; a longer document is cut into pieces that overlap by SPAN - 1 bytes.
PIECE = 1 << 20
#: Anchors gathered in a task before equal ones among them are settled and the rest leaves it.
FLUSH = 600_000
#: Text bytes for each bucket of grams.
BUCKET_BYTES = 24 << 20
#: A gram at so many different surroundings isn't sorted in one task; its strings are dealt by their own hashes.
HOT = 50_000
#: Bytes of suffix tuples held in memory; beyond, a sorted run goes to disk.
RUN_BYTES = 96 << 20

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_PLACE = np.uint64((1 << 21) - 1)
ANCHOR = np.dtype([("g", "<u8"), ("e", "<u8"), ("lo", "<u4"), ("n", "u1"), ("a", "u1"), ("d", "<u4")])
RESOLVED, COMPARE, HOT_KIND = 0, 1, 2
PACKED = "bucket int, kind int, anchors binary, ids binary, hashes binary"
JUDGED = "kind int, k long, h long, lo int, n int, a int, g long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _C[0])


def _ladder(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the GRAM bytes, and of the 64 bytes, that start at each place."""
    h, k, gram = _BYTE[buf], 1, None
    for c in _C[:6]:
        h = h[:-k] * c + (h[k:] ^ (h[k:] >> np.uint64(29)))
        k *= 2
        if k == GRAM:
            gram = _mix(h)
    return gram, h


def anchors(texts: list[bytes]) -> np.ndarray:
    """The anchors of all texts: gram, hash of the surroundings, first string start, starts more, offset of the gram, text number."""
    out = []
    pieces = [(d, at) for d, t in enumerate(texts) for at in range(0, max(1, len(t) - SPAN + 1), PIECE - SPAN + 1) if len(t) >= SPAN]
    i = 0
    while i < len(pieces):
        j, size = i, 0
        while j < len(pieces) and (j == i or size + min(PIECE, len(texts[pieces[j][0]]) - pieces[j][1]) <= PIECE):
            size += min(PIECE, len(texts[pieces[j][0]]) - pieces[j][1])
            j += 1
        cut = [texts[d][at : at + PIECE] for d, at in pieces[i:j]]
        length = np.fromiter(map(len, cut), np.int64, len(cut))
        start = np.cumsum(length) - length
        buf = np.frombuffer(b"".join(cut) + bytes(4 * SPAN), np.uint8)
        gram, h64 = _ladder(buf)
        low = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
        k = 1
        while 2 * k <= WIDTH:
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        low = np.minimum(low[: len(low) - (WIDTH - k)], low[WIDTH - k :])
        delta = np.zeros(len(buf) + 1, np.int8)
        delta[start] += 1
        delta[start + length - SPAN + 1] -= 1
        at = np.flatnonzero(np.cumsum(delta[:-1], dtype=np.int8))
        place = (low[at] & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        lo, hi, a = at[first], at[np.append(first[1:], len(at)) - 1], place[first]
        piece = np.searchsorted(start, lo, "right") - 1
        end = hi + SPAN
        e = h64[lo] * _C[3] + h64[lo + SPAN - 64] * _C[4] + h64[end - 64] * _C[5] + h64[end - SPAN] * _C[6] + _mix(((hi - lo) * 256 + (a - lo)).astype(np.uint64))
        x = np.empty(len(first), ANCHOR)
        x["g"], x["e"], x["n"], x["a"] = gram[a], _mix(e), hi - lo, a - lo
        x["lo"] = lo - start[piece] + np.array([p[1] for p in pieces[i:j]])[piece]
        x["d"] = np.array([p[0] for p in pieces[i:j]])[piece]
        out.append(x)
        i = j
    return np.concatenate(out) if out else np.zeros(0, ANCHOR)


def settle(x: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of anchors (with the id and text hash of each) which repeat the surroundings of an earlier one; and the number of its gram's different surroundings, 0 for those that repeat."""
    later, kinds = np.zeros(len(x), bool), np.ones(len(x), np.int64)
    order = np.argsort(x["g"], kind="stable")
    g = x["g"][order]
    same = g[1:] == g[:-1]
    shared = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(x) else order
    if not len(shared):
        return later, kinds
    s = shared[np.lexsort((x["lo"][shared], hashes[shared], ids[shared], x["e"][shared], x["g"][shared]))]
    new_g = np.concatenate([[True], x["g"][s][1:] != x["g"][s][:-1]])
    new = new_g | np.concatenate([[True], x["e"][s][1:] != x["e"][s][:-1]])
    # a place that comes twice, because its row does, is no copy of itself
    head = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    itself = (ids[s] == ids[s][head]) & (hashes[s] == hashes[s][head]) & (x["lo"][s] == x["lo"][s][head])
    later[s] = ~itself
    gram = np.cumsum(new_g) - 1
    kinds[s] = np.bincount(gram, new)[gram].astype(np.int64)
    kinds[s[~new]] = 0
    return later, kinds


def _bytes(texts: pd.Series) -> list[bytes]:
    return [t if isinstance(t, bytes) else t.encode() if isinstance(t, str) else b"" for t in texts]


def _anchor_rows(buckets: int):
    def flush(xs: list[np.ndarray], ids: list[int], hashes: list[int]) -> Iterator[pd.DataFrame]:
        x, i, h = np.concatenate(xs), np.array(ids, np.int64), np.array(hashes, np.int64)
        later, _ = settle(x, i[x["d"]], h[x["d"]])
        rows = []
        # what is settled here goes along in any bucket; the rest by gram
        for kind, part, deal in ((RESOLVED, x[later], lambda p: _mix(p["e"])), (COMPARE, x[~later], lambda p: p["g"])):
            bucket = (deal(part) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for own in np.split(part[order], np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(own):
                    d, own["d"] = np.unique(own["d"], return_inverse=True)
                    b = int(deal(own[:1])[0] % np.uint64(buckets))
                    rows.append((b, kind, own.tobytes(), i[d].tobytes(), h[d].tobytes()))
        yield pd.DataFrame(rows, columns=["bucket", "kind", "anchors", "ids", "hashes"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xs, ids, hashes, n = [], [], [], 0
        for b in batches:
            texts, at = _bytes(b["text"]), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= 8 * PIECE):
                    size += len(texts[to])
                    to += 1
                x = anchors(texts[at:to])
                x["d"] += len(ids)
                xs.append(x)
                ids += b["k"].iloc[at:to].tolist()
                hashes += b["h"].iloc[at:to].tolist()
                n, at = n + len(x), to
                if n >= FLUSH:
                    yield from flush(xs, ids, hashes)
                    xs, ids, hashes, n = [], [], [], 0
            trim()
        if n:
            yield from flush(xs, ids, hashes)

    return run


def _judge(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's anchors: those settled, those to compare, and those of grams too common to sort in one task."""
    xs, ids, hashes, kinds = [], [], [], []
    for kind, x, i, h in zip(pdf["kind"], pdf["anchors"], pdf["ids"], pdf["hashes"], strict=True):
        x = np.frombuffer(x, ANCHOR)
        xs.append(x)
        ids.append(np.frombuffer(i, np.int64)[x["d"]])
        hashes.append(np.frombuffer(h, np.int64)[x["d"]])
        kinds.append(np.full(len(x), kind))
    x, i, h, kind = map(np.concatenate, (xs, ids, hashes, kinds))
    open_ = np.flatnonzero(kind == COMPARE)
    later, n = settle(x[open_], i[open_], h[open_])
    out = np.full(len(x), -1)
    out[kind == RESOLVED] = RESOLVED
    out[open_] = np.where(later, RESOLVED, np.where(n < 2, -1, np.where(n > HOT, HOT_KIND, COMPARE)))
    s = out >= 0
    return pd.DataFrame({"kind": out[s].astype(np.int32), "k": i[s], "h": h[s], "lo": x["lo"][s].astype(np.int32), "n": x["n"][s].astype(np.int32), "a": x["a"][s].astype(np.int32), "g": x["g"][s].view(np.int64)})


TUPLE = np.dtype([("g", "<u8"), ("k", "<i8"), ("h", "<i8"), ("lo", "<u4"), ("n", "u1"), ("a", "u1"), ("right", "u1", (SPAN,)), ("left", "u1", (WIDTH - 1,))])
STRING = np.dtype([("w", "<u8", (2,)), ("k", "<i8"), ("h", "<i8"), ("s", "<u4")])


def _surroundings(buckets: int):
    """Suffix tuples of the anchors to compare: the bytes from the anchor on, and those before it, reversed.  For common grams each string by its hash."""

    def rows(kind: int, x: np.ndarray, deal: np.ndarray) -> list[tuple]:
        bucket = (deal % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        return [(int(bucket[o[0]]), kind, x[o].tobytes()) for o in np.split(order, cuts) if len(o)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tuples, strings = [], []
            for k, h, text, spots in zip(b["k"], b["h"], _bytes(b["text"]), b["spots"], strict=True):
                if spots is None or not len(spots):
                    continue
                kind, lo, n, a, g = (np.array(v) for v in zip(*((s["kind"], s["lo"], s["n"], s["a"], s["g"]) for s in spots), strict=True))
                buf = np.concatenate([np.zeros(SPAN, np.uint8), np.frombuffer(text, np.uint8), np.zeros(2 * SPAN, np.uint8)])
                at = np.flatnonzero(kind == COMPARE)
                if len(at):
                    t = np.zeros(len(at), TUPLE)
                    place = (lo + a)[at] + SPAN
                    t["g"], t["k"], t["h"], t["lo"], t["n"], t["a"] = g[at].astype(np.int64).view(np.uint64), k, h, lo[at], n[at], a[at]
                    t["right"] = buf[place[:, None] + np.arange(SPAN)]
                    t["right"][np.arange(SPAN) >= (n - a + SPAN)[at][:, None]] = 0
                    t["left"] = buf[place[:, None] - 1 - np.arange(WIDTH - 1)]
                    t["left"][np.arange(WIDTH - 1) >= a[at][:, None]] = 0
                    tuples.append(t)
                for i in np.flatnonzero(kind == HOT_KIND):
                    s = np.zeros(int(n[i]) + 1, STRING)
                    s["k"], s["h"], s["s"] = k, h, np.arange(lo[i], lo[i] + n[i] + 1)
                    s["w"] = np.stack([np.frombuffer(hashlib.blake2b(text[q : q + SPAN], digest_size=16).digest(), np.uint64) for q in s["s"].tolist()])
                    strings.append(s)
            out = []
            if tuples:
                t = np.concatenate(tuples)
                out += rows(COMPARE, t, t["g"])
            if strings:
                s = np.concatenate(strings)
                out += rows(HOT_KIND, s, s["w"][:, 0])
            if out:
                yield pd.DataFrame(out, columns=["bucket", "kind", "data"])

    return run


def _common(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of bytes with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int32)
    for a in range(1, len(rows), 1 << 16):
        differ = rows[a : a + (1 << 16)] != rows[a - 1 : min(a + (1 << 16), len(rows)) - 1]
        out[a : a + (1 << 16)] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def _order(t: np.ndarray, side: str) -> tuple[np.ndarray, np.ndarray]:
    """Tuples sorted by gram, then the bytes of one side; and the common lengths, 0 where a gram begins."""
    width = t[side].shape[1]
    key = np.empty((len(t), 8 + width), np.uint8)
    key[:, :8] = t["g"].astype(">u8").view(np.uint8).reshape(-1, 8)
    key[:, 8:] = t[side]
    order = np.argsort(key.view(f"V{8 + width}").ravel(), kind="stable")
    lcp = _common(t[side][order])
    g = t["g"][order]
    lcp[1:][g[1:] != g[:-1]] = 0
    if len(lcp):
        lcp[0] = 0
    return order, lcp


def repeats(t: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For whole grams of tuples, each offset's repeats: numbers of tuples whose string at that offset occurs earlier, and the starts."""
    t = t[np.lexsort((t["lo"], t["h"], t["k"]))]
    right, r_lcp = _order(t, "right")
    left, l_lcp = _order(t, "left")
    new_r, new_l = np.concatenate([[True], t["g"][right][1:] != t["g"][right][:-1]]), np.concatenate([[True], t["g"][left][1:] != t["g"][left][:-1]])
    r_run, l_run = np.empty(len(t), np.int64), np.empty(len(t), np.int64)
    back = t["a"].astype(np.int64)
    for d in range(WIDTH):
        own = np.flatnonzero((back >= d) & (back - t["n"] <= d))
        if len(own) < 2:
            continue
        r_run[right] = np.cumsum((r_lcp < SPAN - d) | new_r)
        l_run[left] = np.cumsum((l_lcp < d) | new_l)
        key = (r_run[own] << 32) | l_run[own]
        order = np.argsort(key, kind="stable")
        k = key[order]
        later = np.concatenate([[False], k[1:] == k[:-1]])
        head = np.maximum.accumulate(np.where(later, 0, np.arange(len(k))))
        i = own[order]
        start = (t["lo"][i] + back[i] - d).astype(np.int64)
        itself = (t["k"][i] == t["k"][i[head]]) & (t["h"][i] == t["h"][i[head]]) & (start == start[head])
        s = later & ~itself
        if s.any():
            yield t[["k", "h"]][i[s]], start[s]


class Runs:
    """Suffix tuples by gram: sorted runs, on disk beyond RUN_BYTES, and a priority queue over the runs' heads that gives whole grams."""

    def __init__(self, limit: int = RUN_BYTES):
        self.limit, self.held, self.size, self.files, self.dir = limit, [], 0, [], None

    def add(self, t: np.ndarray) -> None:
        self.held.append(t)
        self.size += t.nbytes
        if self.size > self.limit:
            self.dir = self.dir or tempfile.TemporaryDirectory(prefix="runs-")
            self.files.append(os.path.join(self.dir.name, f"{len(self.files)}.npy"))
            np.save(self.files[-1], self._sorted())
            self.held, self.size = [], 0

    def _sorted(self) -> np.ndarray:
        t = np.concatenate(self.held) if self.held else np.zeros(0, TUPLE)
        return t[np.argsort(t["g"], kind="stable")]

    def grams(self) -> Iterator[np.ndarray]:
        """Whole grams in order, gathered to about a quarter of the limit at a time."""
        runs = [np.load(f, mmap_mode="r") for f in self.files] + [self._sorted()]
        self.held = []
        keys = [np.array(r["g"]) for r in runs]
        if len(runs) == 1:
            step = max(1, self.limit // 4 // TUPLE.itemsize)
            at = 0
            while at < len(keys[0]):
                to = min(at + step, len(keys[0]))
                to = int(np.searchsorted(keys[0], keys[0][to - 1], "right"))
                yield runs[0][at:to]
                at = to
        else:
            heap = [(int(k[0]), r, 0) for r, k in enumerate(keys) if len(k)]
            heapq.heapify(heap)
            got, size = [], 0
            while heap:
                g, r, at = heapq.heappop(heap)
                to = int(np.searchsorted(keys[r], np.uint64(g), "right"))
                got.append(np.array(runs[r][at:to]))
                size += got[-1].nbytes
                if to < len(keys[r]):
                    heapq.heappush(heap, (int(keys[r][to]), r, to))
                if heap and heap[0][0] != g and size > self.limit // 4:
                    yield np.concatenate(got)
                    got, size = [], 0
            if got:
                yield np.concatenate(got)
        runs.clear()
        if self.dir:
            self.dir.cleanup()


def _spans(k: np.ndarray, h: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((start, h, k))
    k, h, start = k[order], h[order], start[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1]) | (start[1:] > start[:-1] + 1)])
    first = np.flatnonzero(new)
    return pd.DataFrame({"k": k[first], "h": h[first], "lo": start[first].astype(np.int32), "n": (start[np.append(first[1:], len(start)) - 1] - start[first]).astype(np.int32)})


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One partition: all tuples of its grams, streamed in."""
    runs, strings = Runs(), []
    for b in batches:
        for kind, data in zip(b["kind"], b["data"], strict=True):
            if kind == COMPARE:
                runs.add(np.frombuffer(data, TUPLE))
            else:
                strings.append(np.frombuffer(data, STRING))
    for t in runs.grams():
        found = list(repeats(t))
        if found:
            who, start = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            yield _spans(who["k"], who["h"], start)
    if strings:
        s = np.concatenate(strings)
        s = s[np.lexsort((s["s"], s["h"], s["k"], s["w"][:, 1], s["w"][:, 0]))]
        same = np.concatenate([[False], (s["w"][1:] == s["w"][:-1]).all(1)])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(s))))
        s = s[same & ~((s["k"] == s["k"][head]) & (s["h"] == s["h"][head]) & (s["s"] == s["s"][head]))]
        if len(s):
            yield _spans(s["k"], s["h"], s["s"].astype(np.int64))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for k, text, spans in zip(b["k"], _bytes(b["text"]), b["spans"], strict=True):
            if spans is None or not len(spans):
                out.append((k, len(text), 0, 0, hashlib.sha256(text).hexdigest(), text))
                continue
            lo, n = np.array([s["lo"] for s in spans], np.int64), np.array([s["n"] for s in spans], np.int64)
            depth = np.bincount(lo, minlength=len(text) + 1) - np.bincount(lo + n + SPAN, minlength=len(text) + 1)
            gone = np.cumsum(depth[: len(text)]) > 0
            rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
            edges = np.diff(np.concatenate([[0], gone.view(np.int8)]))
            out.append((k, len(text), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(rest).hexdigest(), rest))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])
        trim()


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"
CUT_COLUMNS = [x.split()[0] for x in CUT.split(", ")]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_bytes, the text's UTF-8 bytes without every byte that
    a string of SPAN bytes covers which also starts earlier (smaller doc_id, or the same document, earlier start).

    Strings are judged on the input and never cross documents.  Null text is empty; texts of fewer bytes lose nothing.
    Rows that share doc_id count as documents in the order of their texts' hashes; rows that repeat both are one
    document, judged alike.  A null doc_id sorts first.  Texts are read whole; a very long one takes memory in proportion
    to its length.  Keys may be of any type with an order and come back as they were.  Other columns play no part,
    whatever their names.  An empty table gives no rows.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        return _by_rank(docs, key, text)
    least = -(2**63)  # stands for null
    size, first = docs.agg(F.sum(F.octet_length(F.col(text))), F.min(F.col(key).cast("long"))).first()
    if first == least:
        return _by_rank(docs, key, text)
    size = size or 0
    buckets = 24 + size // BUCKET_BYTES
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(least)).alias("k"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    packed = rows.mapInPandas(_anchor_rows(buckets), PACKED).repartition(buckets, "bucket")
    judged = keep(packed.groupBy("bucket").applyInPandas(_judge, JUDGED), "anchors")

    # the texts move once: both joins find them dealt by their keys
    dealt = rows.repartition(buckets, "k", "h")
    spot = F.collect_list(F.struct("kind", "lo", "n", "a", "g")).alias("spots")
    spots = judged.filter(F.col("kind") != RESOLVED).groupBy("k", "h").agg(spot)
    tuples = dealt.join(spots.withColumnsRenamed({"k": "_k", "h": "_h"}), (F.col("k") == F.col("_k")) & (F.col("h") == F.col("_h")), "left").filter("spots is not null").select("k", "h", "text", "spots")
    compared = tuples.mapInPandas(_surroundings(buckets), "bucket int, kind int, data binary").repartition(buckets, "bucket").mapInPandas(_compare, "k long, h long, lo int, n int")
    gone = judged.filter(F.col("kind") == RESOLVED).select("k", "h", "lo", "n").unionByName(compared)
    spans = gone.groupBy("k", "h").agg(F.collect_list(F.struct("lo", "n")).alias("spans")).withColumnsRenamed({"k": "_k", "h": "_h"})
    full = dealt.join(spans, (F.col("k") == F.col("_k")) & (F.col("h") == F.col("_h")), "left").select("k", "text", "spans")
    return full.mapInPandas(_cut, CUT).withColumn("doc_id", F.when(F.col("doc_id") != least, F.col("doc_id")).cast(docs.schema[key].dataType))


def _by_rank(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The same for keys that aren't whole numbers: their ranks, from a sort of all keys, stand for them."""
    ids = docs.select(F.col(key).alias("_id")).filter("_id is not null").distinct().orderBy("_id")
    ranks = keep(ids.withColumn("_rank", F.monotonically_increasing_id()), "ranks")
    ranked = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(ranks, "_id", "left")
    out = remove_repeats(ranked.select("_rank", "text"), "_rank", "text").withColumnRenamed("doc_id", "_rank")
    return out.join(ranks, "_rank", "left").drop("_rank").withColumnRenamed("_id", "doc_id").select("doc_id", *CUT_COLUMNS[1:])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_bytes")


OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, CAST(2 * i + 1 AS BIGINT), 200)) AS g FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
cut AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM later),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM cut) GROUP BY doc_id, run),
gaps AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM runs),
kept AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, CAST(2 * p + 1 AS BIGINT), CAST(2 * (a - p) AS BIGINT)), '' ORDER BY a) AS head
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
