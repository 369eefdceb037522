"""Quality classifier: attention-based multiple-instance learning (Ilse, Tomczak & Welling, 2018)."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import keep, table, trim

#: Words of a passage, the instance of a bag.
PASSAGE_WORDS = 100
BUCKETS = 48
#: The fit's bound: so many labelled documents at most, those with the least hash of doc_id.
MAX_FIT_DOCS = 4000
#: And so many bytes of text; a document of more than MAX_DOC_BYTES is not fitted to (it is scored like any other).
MAX_FIT_BYTES, MAX_DOC_BYTES = 128 << 20, 1 << 20
HIDDEN, ATTENTION, STEPS, RATE, DECAY, SEED = 32, 16, 250, 0.02, 1e-4, 7
THRESHOLD = 0.3
#: Of every text where there is nothing to learn from.
NO_SCORE = 0.5

_MARKS = b"|#$%&*!?.,;:"
_KINDS = ("upper", "lower", "digit", "beyond", "mark", "control", *(chr(x) for x in _MARKS))


def _kind_tables() -> np.ndarray:
    t = np.zeros((len(_KINDS), 256), np.uint8)
    t[0, 65:91] = t[1, 97:123] = t[2, 48:58] = t[3, 128:] = 1
    t[4, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
    t[5, [*range(9), *range(11, 32), 127]] = 1
    for i, x in enumerate(_MARKS):
        t[6 + i, x] = 1
    return t


N_FEATURES = len(_KINDS) + 6 + BUCKETS


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every passage of every text: features [passages, N_FEATURES], and the number of passages of each text (1 at least).

    A passage is PASSAGE_WORDS words in a row.  Features: shares of kinds of bytes, word length, lines, distinct and
    repeated words, length, and shares of words in BUCKETS hash buckets.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    doc_start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    space = (buf == 32) | (buf == 10) | (buf == 9) | (buf == 13)
    edge = np.diff(np.concatenate([[True], space]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    doc = np.searchsorted(doc_start, starts, "right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    n_pass = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    out = np.zeros((int(n_pass.sum()), N_FEATURES), np.float32)
    if not len(starts):
        return out, n_pass
    first_pass = np.cumsum(n_pass) - n_pass
    nth = np.arange(len(starts)) - (np.cumsum(n_words) - n_words)[doc]
    passage = first_pass[doc] + nth // PASSAGE_WORDS
    head = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    rows, p0 = passage[head], starts[head]
    p1 = ends[np.concatenate([head[1:], [len(starts)]]) - 1]
    size, count = (p1 - p0).astype(np.float32), np.diff(np.concatenate([head, [len(starts)]])).astype(np.float32)
    cuts = np.ravel(np.column_stack([p0, p1]))
    kinds = _kind_tables()
    for k in range(len(_KINDS)):
        out[rows, k] = np.add.reduceat(kinds[k][buf], cuts, dtype=np.int32)[::2] / size
    weights = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    place = np.arange(len(buf)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(buf)]]))) if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(buf)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(buf)]])))])
    mixed = (buf.astype(np.uint64) + np.uint64(1)) * weights[place & 63]
    mixed[space] = 0
    h = np.add.reduceat(mixed, starts)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])])
    key = np.sort((passage.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(out))[rows]
    lines = np.add.reduceat((buf == 10).astype(np.int32), cuts)[::2]
    base = len(_KINDS)
    out[rows, base : base + 6] = np.column_stack([np.log1p(size), size / count / 10, lines / count, distinct / count, np.bincount(passage, same, len(out))[rows] / count, np.log1p(count)])
    where = passage * BUCKETS + (h >> np.uint64(33)).astype(np.int64) % BUCKETS
    out[:, base + 6 :] = np.bincount(where, minlength=len(out) * BUCKETS).reshape(-1, BUCKETS) / np.maximum(1, np.bincount(passage, minlength=len(out)))[:, None]
    return out, n_pass


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(m: dict[str, np.ndarray], x: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Score the bags: n passages each of the rows of x, weighted by gated attention."""
    seg, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    x = np.clip((x - m["mean"]) / m["scale"], -8, 8)
    h = np.tanh(x @ m["enc"] + m["enc0"])
    t, s = np.tanh(h @ m["v"]), _sigmoid(h @ m["u"])
    e = (t * s) @ m["w"]
    a = np.exp(e - np.maximum.reduceat(e, first)[seg])
    a /= np.add.reduceat(a, first)[seg]
    z = np.add.reduceat(a[:, None] * h, first)
    return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ m["c"] + m["c0"]), "seg": seg, "first": first}


def start(features: int) -> dict[str, np.ndarray]:
    """Weights before the first step."""
    r = np.random.default_rng(SEED)
    init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    m = {"enc": init(features, HIDDEN), "enc0": np.zeros(HIDDEN, np.float32)}
    m |= {"v": init(HIDDEN, ATTENTION), "u": init(HIDDEN, ATTENTION), "w": init(ATTENTION)}
    return m | {"c": init(HIDDEN), "c0": np.zeros(1, np.float32)}


def label_weights(y: np.ndarray) -> np.ndarray:
    """Both labels count alike, however rare one is."""
    share = y.mean()
    if not 0 < share < 1:
        return np.ones(len(y), y.dtype)
    return np.where(y == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)).astype(y.dtype)


def loss_and_gradient(m: dict[str, np.ndarray], x: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted cross entropy of the bags' scores, and its gradient by the learnt weights."""
    f = forward(m, x, n)
    p = np.clip(f["p"], 1e-12, 1 - 1e-12)
    loss = -float((weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / len(y))
    d = weight * (f["p"] - y) / len(y)
    dz = d[:, None] * m["c"]
    dh = f["a"][:, None] * dz[f["seg"]]
    da = (f["h"] * dz[f["seg"]]).sum(1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["first"])[f["seg"]])
    dg = de[:, None] * m["w"]
    dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
    dh += dt @ m["v"].T + ds @ m["u"].T
    dx = dh * (1 - f["h"] ** 2)
    grad = {"enc": f["x"].T @ dx, "enc0": dx.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ ds}
    return loss, grad | {"w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ d, "c0": d.sum(keepdims=True)}


def fit(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Learn encoder, attention and classifier together from the labels of whole documents (Adam, all bags a step)."""
    m, fixed = start(x.shape[1]), {"mean": x.mean(0), "scale": x.std(0) + 1e-3}
    weight = label_weights(y)
    mom = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in m.items()}
    for step in range(1, STEPS + 1):
        _, grad = loss_and_gradient(m | fixed, x, n, y, weight)
        for k, g in grad.items():
            g = g + DECAY * m[k]
            a, b = mom[k]
            a[...] = 0.9 * a + 0.1 * g
            b[...] = 0.999 * b + 0.001 * g * g
            m[k] = m[k] - RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in (m | fixed).items()}


def _bytes(texts: pd.Series) -> list[bytes]:
    return [x.encode() if isinstance(x, str) else b"" for x in texts]


def held_out(key: Column) -> Column:
    """The rows whose labels are never learnt from; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> dict[str, np.ndarray] | None:
    """Fit on labelled documents that aren't held out, those of the least hashes of doc_id: at most MAX_FIT_DOCS of them, of
    MAX_FIT_BYTES together; executors encode them, the driver sees features.

    Documents of more than MAX_DOC_BYTES (all rows of an id together) are left out before, so a long one takes no place
    from others.  Labels that contradict each other for an id count as the least, whatever the order of rows.  A passage
    has more than 2 * PASSAGE_WORDS bytes but for a text's last, so the bytes bound the passages too.  None, with a
    warning, where there is nothing to fit to.  Labels of one value only teach that value.
    """
    marks = labels.select(F.col(key).alias("doc_id"), F.col(label).alias("_y")).filter("doc_id is not null and _y in (0, 1)")
    marks = marks.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("_y").alias("_y"))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_t"))
    size = F.coalesce(F.octet_length("_t"), F.lit(0)).cast("long").alias("_n")
    sized = rows.select("doc_id", size).groupBy("doc_id").agg(F.sum("_n").alias("_n")).filter(F.col("_n") <= MAX_DOC_BYTES)
    chosen = keep(marks.join(sized, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_FIT_DOCS), "labelled")

    @F.pandas_udf(T.BinaryType())
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            x, n = encode(_bytes(s))
            at = np.cumsum(n) - n
            yield pd.Series([x[i : i + k].astype(np.float16).tobytes() for i, k in zip(at, n, strict=True)], dtype=object)

    so_far = F.sum("_n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over MAX_FIT_DOCS rows at most
    taken = keep(chosen.withColumn("_so_far", so_far).filter(F.col("_so_far") <= MAX_FIT_BYTES).select("doc_id", "_y"), "fitted")
    if taken.isEmpty():
        logging.getLogger(__name__).warning("no model: there are no labels of documents that may be fitted to")
        return None
    got = rows.join(F.broadcast(taken), "doc_id").select("doc_id", "_y", features("_t").alias("x")).toPandas()
    got = got.sort_values(["doc_id", "x"], kind="stable")
    bags = [np.frombuffer(b, np.float16).reshape(-1, N_FEATURES).astype(np.float32) for b in got["x"]]
    return fit(np.concatenate(bags), np.fromiter(map(len, bags), np.int64), got["_y"].to_numpy(np.float32))


def score_column(model: dict[str, np.ndarray] | None, text: Column) -> Column:
    """The score as a column, from the text alone; without a model NO_SCORE for every text."""
    if model is None:
        return F.lit(NO_SCORE)

    @F.pandas_udf(T.DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            if not len(s):
                yield pd.Series([], dtype="float64")
                continue
            # a few MB at a time, so that a batch of very long texts stays small
            data, out, at = _bytes(s), [], 0
            while at < len(data):
                to, size = at, 0
                while to < len(data) and (to == at or size + len(data[to]) < 1 << 20):
                    size += len(data[to])
                    to += 1
                x, n = encode(data[at:to])
                out.append(forward(model, x, n)["p"])
                at = to
            yield pd.Series(np.concatenate(out).astype(np.float64))
            trim()

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `score` (0 to 1, higher: label 1 likelier) and `predicted` (1 if score is THRESHOLD or more).

    Null texts count as empty; an empty text is a bag of one empty passage.  Texts are scored whole, however long, a
    few MB at a time.  Rows that repeat get the same score; ids play no part in it.  Without
    labels to learn from every text gets NO_SCORE and is taken for good.  Labels that contradict each
    other for one document count as the least.  Texts of more than MAX_DOC_BYTES are scored, but not fitted to.  Of the other
    columns `score` and `predicted` are replaced; an empty table gives no rows.
    """
    model = train(docs, labels, key, text)
    return docs.withColumn("score", score_column(model, F.col(text))).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
