"""Product codes of vectors by Lloyd's algorithm with heaps (Hamerly & Drake, 2015).

Vectors are dealt into blocks.  A block keeps, for each part position and codebook entry, a binary heap of the parts that
the entry holds, keyed by how much nearer it is than the next entry (lower bound minus upper bound) plus the drift of
entries so far.  When codebooks have moved, a part is rescanned only if the drift that has gathered reaches its key;
those are the top of a heap, so a round touches no other part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, join_counted, keep, mark, release, table, trim
from .vectors import matrix, of_one_length, whole_vectors

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors of a block; places in heaps are numbers of 2 bytes.
BLOCK = 4096
#: What rounding can take from a bound, generously, as a part of the numbers that go into it.
ROUNDING = 1e-12


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances [parts, entries]: by products of doubles where these hold every sum exactly, else of integers."""
    peak = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * peak * peak < 1 << 53:
        x, c = x.astype(np.float64), c.astype(np.float64)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of every part (ties to the lower index), and lower minus upper bound: never above the true slack."""
    d = squared_distances(x, c)
    nearest = d.argmin(1)
    upper = np.sqrt(d[np.arange(len(x)), nearest].astype(np.float64))
    lower = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64)) if d.shape[1] > 1 else np.full(len(x), np.inf)
    return nearest.astype(np.uint8), lower * (1 - ROUNDING) - upper * (1 + ROUNDING)


def heaps(nearest: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of parts, one heap for each entry behind the other: a sorted run is a heap."""
    return np.lexsort((key, nearest)).astype(np.uint16)


def pop(heap: np.ndarray, size: np.ndarray, key: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """Parts whose key is at most their entry's drift: from each heap's root downwards, level by level, as far as keys allow."""
    start, popped = np.cumsum(size) - size, []
    entry = np.flatnonzero(size)
    at = np.zeros(len(entry), np.int64)
    while len(entry):
        member = heap[start[entry] + at]
        due = key[member] <= drift[entry]
        popped.append(member[due])
        entry, at = np.repeat(entry[due], 2), np.repeat(2 * at[due] + 1, 2)
        at[1::2] += 1
        inside = at < size[entry]
        entry, at = entry[inside], at[inside]
    return np.concatenate(popped) if popped else np.zeros(0, np.uint16)


def push(heap: np.ndarray, was: np.ndarray, nearest: np.ndarray, key: np.ndarray, popped: np.ndarray) -> np.ndarray:
    """The heaps with the popped parts put back under their new entries and keys; heaps that none left or joined stay as they are."""
    touched = np.zeros(256, bool)
    touched[was[popped]] = touched[nearest[popped]] = True
    rest = heap[~touched[was[heap]]]
    again = np.flatnonzero(touched[nearest])
    again = again[np.lexsort((key[again], nearest[again]))].astype(np.uint16)
    every = np.concatenate([rest, again])
    return every[np.argsort(nearest[every], kind="stable")]


def _sums(x: np.ndarray, entry: np.ndarray, k: int) -> np.ndarray:
    """[entries, components + 1] sums of the parts of each entry, and their count; exact, since a block's sums fit a double."""
    columns = [np.bincount(entry, x[:, j], k) for j in range(x.shape[1])] + [np.bincount(entry, minlength=k)]
    return np.stack(columns, 1).astype(np.int64)


def assign(x: np.ndarray, codebooks: np.ndarray, drift: np.ndarray, state: tuple[np.ndarray, ...] | None) -> tuple[tuple[np.ndarray, ...], np.ndarray, int]:
    """One assignment of a block x [vectors, parts, components]: its state (nearest, key, heap; by part position), how the
    entries' sums change, and how many parts were scanned."""
    n, parts, width = x.shape
    k = codebooks.shape[1]
    change, scanned = np.zeros((parts, k, width + 1), np.int64), 0
    nearest, key, heap = state or (np.zeros((parts, n), np.uint8), np.zeros((parts, n)), np.zeros((parts, n), np.uint16))
    for p in range(parts):
        if state is None:
            nearest[p], slack = scan(x[:, p], codebooks[p])
            key[p], heap[p] = slack, heaps(nearest[p], slack)
            change[p] = _sums(x[:, p], nearest[p], k)
            scanned += n
            continue
        was = nearest[p].copy()
        due = pop(heap[p], np.bincount(was, minlength=k), key[p], drift[p])
        scanned += len(due)
        if not len(due):
            continue
        nearest[p, due], slack = scan(x[due, p], codebooks[p])
        key[p, due] = slack + drift[p, nearest[p, due]] * (1 - ROUNDING)
        heap[p] = push(heap[p], was, nearest[p], key[p], due)
        moved = due[was[due] != nearest[p, due]]
        change[p] = _sums(x[moved, p], nearest[p, moved], k) - _sums(x[moved, p], was[moved], k)
    return (nearest, key, heap), change, scanned


def _parts(x: np.ndarray) -> np.ndarray:
    return x.reshape(len(x), PARTS, -1) if x.size else np.zeros((len(x), PARTS, 0), np.int64)


def _listed(column: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def _state(row: dict, n: int) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(row[c], t).reshape(PARTS, n).copy() for c, t in (("nearest", np.uint8), ("key", np.float64), ("heap", np.uint16)))


def _block(ids: pa.Array, labels: pa.Array, x: np.ndarray, got: tuple) -> pa.RecordBatch:
    (nearest, key, heap), change, scanned = got
    data = [pa.array([a.tobytes()], pa.binary()) for a in (x.astype("<i4"), nearest, key, heap, change)]
    return pa.RecordBatch.from_arrays([ids, labels, *data, pa.array([scanned], pa.int64())], ["vec_id", "label", "x", "nearest", "key", "heap", "change", "scanned"])


def _first(codebooks: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = matrix(part.column(2))
                yield _block(_listed(part.column(0)), _listed(part.column(1)), x, assign(_parts(x), codebooks, None, None))
            trim()

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, tuple]]:
    """The blocks of a written state."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names) if c not in ("vec_id", "label")}
            ids, labels = (batch.column(j).slice(i, 1) for j in (0, 1))
            n = len(ids[0])
            yield ids, labels, np.frombuffer(row["x"], "<i4").reshape(n, -1).astype(np.int64), _state(row, n)
        trim()


def _next(codebooks: np.ndarray, drift: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, x, state in _blocks(batches):
            yield _block(ids, labels, x, assign(_parts(x), codebooks, drift, state))

    return run


def _last(codebooks: np.ndarray, drift: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, x, state in _blocks(batches):
            (nearest, _, _), _, _ = assign(_parts(x), codebooks, drift, state)
            code = [bytes(row).hex() for row in np.ascontiguousarray(nearest.T)]
            off = _parts(x) - codebooks[np.arange(PARTS), nearest.T]
            made = [pa.array(code, pa.string()), pa.array((off * off).sum((1, 2)), pa.int64())]
            yield pa.RecordBatch.from_arrays([ids.flatten(), labels.flatten(), *made], ["vec_id", "label", "code", "error"])

    return run


def _add_up(slots: int):  # noqa: ANN202
    """A task's blocks' changes as (slot, value), and the parts scanned at slot -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, scanned = np.zeros(slots, np.int64), 0
        for batch in batches:
            for change in batch.column(0):
                total += np.frombuffer(change.as_py(), np.int64)
            scanned += int(np.sum(batch.column(1).to_numpy()))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(total[at], scanned), pa.int64())], ["slot", "value"])

    return run


def moved(codebooks: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the floors of their parts' means; entries without parts stay."""
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), codebooks)


def drifted(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How much each entry's slack can shrink at most: by its own move and the farthest of the others."""
    step = np.sqrt(((new - old).astype(np.float64) ** 2).sum(2)) * (1 + ROUNDING)
    if step.shape[1] == 1:
        return step
    two = np.partition(step, -2, axis=1)[:, -2:]
    return (step + np.where(step == two[:, 1:], np.where(two[:, :1] == two[:, 1:], two[:, 1:], two[:, :1]), two[:, 1:])) * (1 + ROUNDING)


def train(vectors: DataFrame, width: int, scanned: list[int] | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Run ROUNDS rounds over a written table of whole vectors: the blocks' last state, the final codebooks, and the drift
    that the state hasn't met yet.

    Every round is one pass over the blocks, which writes their new state to the shared folder.  Codebooks (PARTS x
    ENTRIES entries) and sums of that size are all that the driver sees.  scanned: gets the parts scanned in each round.
    """
    spark, kinds = vectors.sparkSession, [vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    schema = f"vec_id array<{kinds[0]}>, label array<{kinds[1]}>, x binary, nearest binary, key binary, heap binary, change binary, scanned long"
    seeds = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(ENTRIES).collect()
    codebooks = np.ascontiguousarray(_parts(matrix([bytes(r.x) for r in seeds])).transpose(1, 0, 2))
    sums = np.zeros((*codebooks.shape[:2], width // PARTS + 1), np.int64)
    drift, state = np.zeros(codebooks.shape[:2]), None
    for _ in range(ROUNDS):
        since = mark()
        done = vectors.mapInArrow(_first(codebooks), schema) if state is None else state.mapInArrow(_next(codebooks, drift), schema)
        new = keep(done, "codes-state")
        changes = new.select("change", "scanned").mapInArrow(_add_up(sums.size), "slot long, value long").groupBy("slot").agg(F.sum("value").alias("value"))
        got = dict(changes.collect())  # a number for each entry's component at most
        if scanned is not None:
            scanned.append(got.get(-1, 0))
        got.pop(-1, None)
        sums.reshape(-1)[list(got)] += np.array(list(got.values()), np.int64)
        if state is not None:
            release(spark, before, new)
        state, before = new, since
        after = moved(codebooks, sums)
        drift = (drift + drifted(codebooks, after)) * (1 + ROUNDING)
        codebooks = after
    return state, codebooks, drift


def compress(df: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """One row per usable row: vec_id, label, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds a null or non-finite component are dropped, and so are those of another length
    than the vector of the least vec_id; that length must be a multiple of PARTS.  Components become floor(256 * x), and
    count as 2**24 beyond that.  The first codebooks are the parts of the ENTRIES rows of least vec_id (nulls last; rows
    that share one in the order of their bytes); with fewer rows they have fewer entries.  Nearest entries are exact,
    with ties to the lower index, and means are floors of exact sums, so neither partitions nor retries change a
    result.  Repeated rows are coded alike.  label_error sums up error over equal labels, nulls together; a label may
    hold any part of the rows.  Ids and labels may be of any type; other columns play no part; an empty table gives no
    rows.
    """
    bound_batches(df.sparkSession)
    since = mark()
    vectors, width = of_one_length(keep(whole_vectors(df, key, label, vector), "whole-vectors"))
    if width % PARTS:
        raise ValueError(f"vectors of {width} components have no {PARTS} equal parts")
    kinds = [vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    out = "vec_id {}, label {}, code string, error long".format(*kinds)
    if vectors.isEmpty():
        empty = [F.lit(None).cast("long").alias("label_error"), F.lit(None).cast("string").alias("codebooks_sha256")]
        return vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), *empty).limit(0)
    state, codebooks, drift = train(vectors, width)
    coded = keep(state.mapInArrow(_last(codebooks, drift), out), "codes")
    release(df.sparkSession, since, coded)
    named = [F.col("label").isNull().alias("_none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_label")]
    rows = coded.select("*", *named)
    per_label = keep(rows.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "label-errors")
    digest = hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()
    joined = join_counted(rows, per_label, ["_none", "_label"], "_n")
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).drop("label")


def _round_sql(n: int) -> str:
    """Assignment to the codebooks c{n}, and the codebooks of the next round."""
    return f"""
d{n} AS (SELECT vec_id, p, k, list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts JOIN c{n} USING (p)),
a{n} AS (SELECT vec_id, p, min(d) AS d, arg_min(k, (d, k)) AS k FROM d{n} GROUP BY vec_id, p),
s{n} AS (SELECT p, k, i, sum(x) AS s, count(*) AS n FROM (SELECT p, k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n} JOIN parts USING (vec_id, p)) GROUP BY ALL),
m{n} AS (SELECT p, k, list(CAST(s - ((s % n) + n) % n AS BIGINT) // n ORDER BY i) AS w FROM s{n} GROUP BY p, k),
c{n + 1} AS (SELECT c.p, c.k, coalesce(m.w, c.w) AS w FROM c{n} c LEFT JOIN m{n} m ON c.p = m.p AND c.k = m.k),"""


OP11_SQL = f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, v[CAST(p * len(v) // 16 + 1 AS BIGINT):CAST((p + 1) * len(v) // 16 AS BIGINT)] AS v FROM e, range(16) r(p)),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM e QUALIFY k < 64),
c0 AS (SELECT p, k, v AS w FROM parts JOIN seeds USING (vec_id)),{_round_sql(0)}{_round_sql(1)}
d2 AS (SELECT vec_id, p, k, list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts JOIN c2 USING (p)),
a2 AS (SELECT vec_id, p, min(d) AS d, arg_min(k, (d, k)) AS k FROM d2 GROUP BY vec_id, p),
coded AS (SELECT vec_id, string_agg(lower(printf('%02x', k)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN e USING (vec_id), book
"""
