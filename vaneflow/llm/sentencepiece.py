"""Encoding with sampled segmentations: Gumbel top-k without replacement over the piece lattice (Kool, van Hoof & Welling, 2019).

The vocabulary is that of a public SentencePiece model, whose path is a parameter.  It has merge ranks, not unigram
probabilities, so a piece of rank r weighs 1 / (r + SHIFT), normalised over the vocabulary; a character that is no piece
falls back to its bytes.  Texts are normalised as the model says: a space before the text, spaces as U+2581.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, table, trim

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, ALPHA, SHIFT, BYTE_LOGP = 3, 1.0, 3.0, math.log(1e-6)
SPACE = "▁"
BATCH = 1 << 19
#: Arcs of lattices that are kept from batch to batch, about.
MAX_ARCS = 2_000_000
#: A unit of the lattice: no piece crosses from other characters to a space; nor, in most vocabularies, from letters to others or back.
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
LETTER, OTHER = r"[^\W\d_]", rf"(?:[^\w{SPACE}]|[\d_])"
FINE_UNIT = re.compile(f"{SPACE}*{LETTER}+|{SPACE}*{OTHER}+|{SPACE}+")
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


_ALL = 2**64 - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from counters."""
    return ((_mix(x) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Vocabulary:
    """Pieces, their weights, and tables to look up every prefix of every piece by a hash."""

    def __init__(self, model: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        spelt = [bytes([int(x[3:5], 16)]) if sp.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(self.pieces)]
        self.letters, self.length = np.frombuffer(b"".join(spelt), np.uint8), np.fromiter(map(len, spelt), np.int32, n)
        self.start = np.cumsum(self.length, dtype=np.int32) - self.length
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        usual = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        weight = -np.log(np.arange(len(usual)) + SHIFT)
        weight -= np.log(np.exp(weight).sum())
        self.logp = np.full(n, np.nan)
        self.logp[usual] = alpha * weight
        self.byte_logp = alpha * BYTE_LOGP
        found: dict[int, int] = {}
        mixed = re.compile(f"{LETTER}{OTHER}|{OTHER}{LETTER}|[^{SPACE}]{SPACE}")
        self.unit = UNIT if any(mixed.search(self.pieces[i]) for i in usual) else FINE_UNIT
        self.longest = max(len(self.pieces[i]) for i in usual)
        for i in usual:
            h = 0
            for k, ch in enumerate(self.pieces[i], 1):
                h = (h * 0x9E3779B97F4A7C15 + ord(ch) + 1) & (2**64 - 1)
                found.setdefault(h, -1)
                if k == len(self.pieces[i]):
                    found[h] = i
        # an open table of hashes, twice as large as the prefixes at least, by their upper bits
        h, ids = np.array(list(found), np.uint64), np.array(list(found.values()), np.int32)
        bits = int(2 * len(h)).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.slots, self.slot_ids, left, step = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -2, np.int32), np.arange(len(h)), 0
        while len(left):
            at = (((h[left] * _M1) >> self.shift).astype(np.int64) + step) & ((1 << bits) - 1)
            _, one = np.unique(at, return_index=True)
            one = one[self.slot_ids[at[one]] == -2]
            self.slots[at[one]], self.slot_ids[at[one]] = h[left[one]], ids[left[one]]
            left, step = np.delete(left, one), step + 1
        self.probes = step

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the pieces, joined, with spaces as they are in texts."""
        n = self.length[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(n, dtype=np.int32) - n), n)
        at += np.arange(len(at), dtype=np.int32)
        return self.letters[at]

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """The id of each prefix's piece, -1 for a prefix that is none, -2 for what begins no piece."""
        at = ((h * _M1) >> self.shift).astype(np.int32)
        hit = self.slots[at] == h
        out = self.slot_ids[at]
        open_ = np.flatnonzero(~hit)
        taken = out[open_] != -2
        out[open_] = -2
        open_ = open_[taken]
        for step in range(1, self.probes):
            if not len(open_):
                break
            k = (at[open_] + step) & (len(self.slots) - 1)
            hit = self.slots[k] == h[open_]
            out[open_[hit]] = self.slot_ids[k[hit]]
            open_ = open_[~hit & (self.slot_ids[k] != -2)]
        return out


class Lattices:
    """Lattices of distinct units, with exact local probabilities: at every node those of the arcs that leave it, given all that may follow."""

    def __init__(self, vocab: Vocabulary, units: list[str]):
        size = np.fromiter(map(len, units), np.int64, len(units))
        cp = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        end = np.repeat(np.cumsum(size), size).astype(np.int32)
        at, h = np.arange(len(cp), dtype=np.int32), np.zeros(len(cp), np.uint64)
        # nodes in the order of their distance to the unit's end, so that each distance is a slice
        far = end - np.arange(len(cp), dtype=np.int32)
        order = np.argsort(far.astype(np.uint16) if len(far) and far.max() < 1 << 16 else far, kind="stable")
        rank = np.empty(len(cp), np.int32)
        rank[order] = np.arange(len(cp), dtype=np.int32)
        found, n_arcs = [], np.zeros(len(cp), np.int32)
        room = far
        for k in range(1, vocab.longest + 1):
            h = h * _GOLD + cp[at + (k - 1)]
            i = vocab.look_up(h)
            if k == 1:
                i = np.where(i == -2, -1, i)
                hit = np.ones(len(i), bool)  # a character that is no piece, written -1, stands for its bytes
            else:
                hit = i >= 0
            own = at[hit]
            found.append((own, i[hit], n_arcs[own], np.where(room[hit] == k, -1, rank[np.minimum(own + k, len(cp) - 1)])))
            n_arcs[own] += 1
            on = (i > -2) & (room > k)
            at, h, room = at[on], h[on], room[on]
            if not len(at):
                break
        counts = n_arcs[order]
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        self.piece, self.to = np.empty(int(self.first[-1]), np.int32), np.empty(int(self.first[-1]), np.int32)
        for own, ids, nth, to in found:  # arcs of a node lie together
            place = self.first[rank[own]] + nth
            self.piece[place], self.to[place] = ids, to
        del found
        node = np.repeat(np.arange(len(cp), dtype=np.int32), counts)
        odd = np.flatnonzero(self.piece < 0)
        code = (cp[order[node[odd]]] - np.uint64(1)).astype(np.int64)
        logp = vocab.logp[self.piece]
        logp[odd] = (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)) * vocab.byte_logp
        beta = np.zeros(len(cp) + 1)  # the last is the end's
        bounds = np.searchsorted(far[order], np.arange(1, (far.max() if len(far) else 0) + 2))
        for a, b in itertools.pairwise(bounds):
            lo, hi = self.first[a], self.first[b]
            v = logp[lo:hi] + beta[self.to[lo:hi]]
            cuts = self.first[a:b] - lo
            top = np.maximum.reduceat(v, cuts)
            beta[a:b] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, np.diff(np.append(cuts, hi - lo)))), cuts))
        logp += beta[self.to]
        logp -= beta[node]
        np.minimum(logp, 0.0, out=logp)
        self.local = logp
        # within each node, from its own arcs alone: what lies before an arc, and what all others have together
        p = np.exp(logp)
        self.cum, rest, after = p.copy(), np.zeros(len(p)), np.zeros(len(p))
        most = int(counts.max()) if len(counts) else 0
        starts, sizes = self.first[:-1], counts
        for k in range(1, most):
            own = starts[sizes > k] + k
            rest[own] = self.cum[own - 1]
            self.cum[own] += self.cum[own - 1]
            own = self.first[1:][sizes > k] - 1 - k
            after[own] = after[own + 1] + p[own + 1]
        rest += after
        with np.errstate(divide="ignore"):
            self.rest = np.log(rest)
        self.cum = self.cum.astype(np.float32)
        self.cum[self.first[1:] - 1] = 2.0  # rounding never leaves a node without an arc
        self.root = rank[np.cumsum(size) - size] if len(cp) else np.zeros(0, np.int32)
        # a character that is no piece: its byte's id, or the place of its several bytes' ids, below 0
        self.bytes_of: list[np.ndarray] = []
        for at, c in zip(odd.tolist(), code.tolist(), strict=True):
            b = vocab.byte_id[list(chr(c).encode("utf-8", "surrogatepass"))]
            if len(b) == 1:
                self.piece[at] = b[0]
            else:
                self.bytes_of.append(b.astype(np.int32))
                self.piece[at] = -len(self.bytes_of)

    def extend(self, other: Lattices) -> None:
        """Put another's lattices behind these; its units follow in their order."""
        nodes, n_arcs = len(self.first) - 1, int(self.first[-1])
        self.first = np.concatenate([self.first[:-1], other.first + n_arcs])
        self.to = np.concatenate([self.to, np.where(other.to >= 0, other.to + nodes, -1).astype(np.int32)])
        self.piece = np.concatenate([self.piece, np.where(other.piece < 0, other.piece - len(self.bytes_of), other.piece)])
        self.root = np.concatenate([self.root, other.root + nodes])
        for name in ("rest", "local", "cum"):
            setattr(self, name, np.concatenate([getattr(self, name), getattr(other, name)]))
        self.bytes_of += other.bytes_of

    def walk(self, unit: np.ndarray, seed: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a path through each unit (ancestral sampling): arcs of all paths, and how many each has, both in the order of back.  seed: a counter for each."""
        state, who, steps, arcs = self.root[unit], np.arange(len(unit), dtype=np.int32), [], []
        n, x = np.zeros(len(unit), np.int32), seed.copy()
        while len(who):
            x = x * np.uint64(0x5851F42D4C957F2D) + np.uint64(0x14057B7EF767814F)  # a congruential sequence of its own for each unit
            r = ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52
            arc = self.first[state]
            more = np.flatnonzero(self.cum[arc] <= r)
            while len(more):
                arc[more] += 1
                more = more[self.cum[arc[more]] <= r[more]]
            steps.append(who)
            arcs.append(arc)
            n[who] += 1
            state = self.to[arc]
            on = state >= 0
            state, who, x = state[on], who[on], x[on]
        back_n = n[back]
        placed = np.cumsum(back_n) - back_n
        off = np.empty(len(n), np.int64)
        off[back] = placed
        out = np.empty(int(n.sum()), np.int32)
        for k, (w, a) in enumerate(zip(steps, arcs, strict=True)):
            out[off[w] + k] = a
        return out, back_n

    def expand(self, arcs: np.ndarray) -> np.ndarray:
        """The ids of a path."""
        ids = self.piece[arcs]
        odd = np.flatnonzero(ids < 0) if self.bytes_of else ()
        if not len(odd):
            return ids
        parts, at = [], 0
        for i in odd.tolist():
            parts += [ids[at:i], self.bytes_of[-ids[i] - 1]]
            at = i + 1
        return np.concatenate([*parts, ids[at:]])


def _lse(x: np.ndarray) -> float:
    top = x.max() if len(x) else -np.inf
    return float(top + math.log(np.exp(x - top).sum())) if top > -np.inf else -np.inf


def _below(mu: float, bound: float, u: float) -> float:
    """A Gumbel of location mu, given that it is less than bound."""
    return mu - math.log(math.exp(min(mu - bound, 700.0)) - math.log(u))


def top_k(lat: Lattices, draws: list[tuple[np.ndarray, ...]], k: int, seed: int) -> list[tuple[np.ndarray, float, float, float]]:
    """k distinct segmentations (fewer if there are no more): arcs, log probability, perturbed log probability, log inclusion score.

    Best-first search over sets of segmentations.  A set is what agrees with a found path up to a piece and differs
    there; all sets of a path wait as one entry whose bound is the maximum of its sets' Gumbels, drawn below the bound
    of what it was split from.  Splitting a set off gives the path that has its maximum: draws[s] serves as the free
    part of the s-th path.  draws: arcs, unit of each arc, and log probability before each arc and after the last.  The bound of the next entry is the inclusion threshold.
    """
    count = itertools.count()

    def rnd() -> float:
        x = (seed + next(count) * 0x9E3779B97F4A7C15) & _ALL
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
        return (((x ^ (x >> 31)) >> 12) + 0.5) * 2.0**-52

    def entry(path: tuple[np.ndarray, ...], at: int, barred: list[int], bound: float) -> None:
        arcs, _, before = path
        # sets that differ far down the path weigh nothing: beyond e**-60 of the first they vanish in the sum
        to = min(len(arcs), at + 256)
        while to < len(arcs) and before[to] > before[at] - 60.0:
            to = min(len(arcs), to + 256)
        logq = lat.rest[arcs[at:to]] + before[at:to]
        if barred:
            others = [lat.local[a] for a in siblings(int(arcs[at])) if a not in barred and a != arcs[at]]
            logq[0] = before[at] + _lse(np.array(others))
        if (mu := _lse(logq)) > -np.inf:
            heapq.heappush(heap, (-_below(mu, bound, rnd()), next(count), (path, at, barred, logq)))

    def siblings(arc: int) -> range:
        node = bisect.bisect_right(lat.first, arc) - 1
        return range(int(lat.first[node]), int(lat.first[node + 1]))

    heap: list = []
    path = draws[0]
    top = -math.log(-math.log(rnd()))
    found = [(path[0], float(path[2][-1]), top)]
    if len(path[0]):
        entry(path, 0, [], top)
    while heap and len(found) < k:
        bound, _, (path, at, barred, logq) = heapq.heappop(heap)
        arcs, units, before = path
        bound = -bound
        share = np.exp(logq - logq.max()).cumsum()
        t = int(share.searchsorted(rnd() * share[-1], "right"))
        if t >= len(logq) or logq[t] == -np.inf:
            t = int(np.flatnonzero(logq > -np.inf)[-1])
        out = [*barred, int(arcs[at])] if t == 0 else [int(arcs[at + t])]
        rest = logq.copy()
        rest[t] = -np.inf
        if (mu := _lse(rest)) > -np.inf:
            heapq.heappush(heap, (-_below(mu, bound, rnd()), next(count), (path, at, barred, rest)))
        t += at
        choices = [a for a in siblings(int(arcs[t])) if a not in out]
        if not choices:
            continue
        new = [_pick(choices, [math.exp(lat.local[a]) for a in choices], rnd())]
        while (state := int(lat.to[new[-1]])) >= 0:
            arc, r = int(lat.first[state]), rnd()
            while lat.cum[arc] <= r:
                arc += 1
            new.append(arc)
        f_arcs, f_units, f_before = draws[len(found)]
        tail = int(f_units.searchsorted(units[t], "right"))
        ahead = before[t] + lat.local[new].cumsum()
        path = (
            np.concatenate([arcs[:t], np.array(new, np.int32), f_arcs[tail:]]),
            np.concatenate([units[:t], np.full(len(new), units[t], np.int32), f_units[tail:]]),
            np.concatenate([before[: t + 1], ahead[:-1], f_before[tail:] + (ahead[-1] - f_before[tail])]),
        )
        found.append((path[0], float(path[2][-1]), bound))
        entry(path, t, out, bound)
    kappa = -heap[0][0] if heap else -np.inf
    score = lambda phi: 0.0 if kappa == -np.inf else (phi - kappa if phi - kappa < -30 else math.log(-math.expm1(-math.exp(min(phi - kappa, 700.0)))))
    return [(p, phi, g, score(phi)) for p, phi, g in found]


def _pick(choices: list[int], weights: list[float], u: float) -> int:
    u *= sum(weights)
    for c, w in zip(choices, weights, strict=True):
        u -= w
        if u <= 0:
            return c
    return choices[-1]


def normalise(text: str | None) -> str:
    return (SPACE + text.replace(" ", SPACE)) if text else ""


def decode(vocab: Vocabulary, ids: np.ndarray) -> str:
    """The text of the ids; SentencePiece's own rule."""
    return vocab.spell(ids).tobytes().decode("utf-8", "replace")[1:]


class Known:
    """Lattices of units met so far, started anew beyond MAX_ARCS."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.ids, self.lattices = vocab, {}, None

    def of(self, units: list[str]) -> tuple[Lattices, np.ndarray]:
        """Lattices that hold these distinct units, and each one's number there."""
        if self.lattices is not None and self.lattices.first[-1] > MAX_ARCS:
            self.ids, self.lattices = {}, None
        new = [u for u in units if u not in self.ids]
        if new:
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
            more = Lattices(self.vocab, new)
            if self.lattices is None:
                self.lattices = more
            else:
                self.lattices.extend(more)
        return self.lattices, np.fromiter(map(self.ids.__getitem__, units), np.int32, len(units))


def sample_texts(vocab: Vocabulary, texts: list[str | None], keys: list[int], k: int = SAMPLES, known: Known | None = None) -> Iterator[list[tuple[np.ndarray, float, float, float]]]:
    """For every text its samples: ids, log probability, perturbed log probability, log inclusion score.

    Draws and sums depend on the row's key and text alone.
    """
    rows = [vocab.unit.findall(normalise(t)) for t in texts]
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    first = np.cumsum(n) - n
    if not n.any():
        for _ in n:
            yield [(np.zeros(0, np.int32), 0.0, 0.0, 0.0)]
        return
    coded = pa.array(list(itertools.chain.from_iterable(rows)), pa.string()).dictionary_encode()
    lat, ids = (known or Known(vocab)).of(coded.dictionary.to_pylist())
    unit = ids[coded.indices.to_numpy()]
    n_rows = len(rows)
    del rows
    seeds = _mix(np.array(keys, np.int64).view(np.uint64) * _GOLD + np.uint64(0x5EED))
    inside = (np.arange(len(unit)) - np.repeat(first, n)).astype(np.int32)
    draws = []
    by = np.argsort(unit, kind="stable")  # neighbours walk the same lattices
    back = np.empty(len(by), np.int64)
    back[by] = np.arange(len(by))
    counter, unit = _mix(np.repeat(seeds, n) + inside.astype(np.uint64) * _GOLD)[by], unit[by]
    for s in range(k):
        arcs, m = lat.walk(unit, _mix(counter + np.uint64((s + 1) * 0x9E3779B97F4A7C15 & _ALL)), back)
        draws.append((arcs, np.repeat(inside, m), np.concatenate([[0], np.cumsum(m)])))
    for i in range(n_rows):
        a, b = int(first[i]), int(first[i] + n[i])
        if a == b:
            yield [(np.zeros(0, np.int32), 0.0, 0.0, 0.0)]
            continue
        own = []
        for arcs, units, off in draws:  # sums of the row's own arcs, so that they don't depend on its neighbours
            mine = arcs[off[a] : off[b]]
            own.append((mine, units[off[a] : off[b]], np.concatenate([[0.0], lat.local[mine].cumsum()])))
        yield [(lat.expand(p), *rest) for p, *rest in top_k(lat, own, k, int(seeds[i]))]


def _batches(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Rows of about BATCH together."""
    at = 0
    while at < len(sizes):
        to, size = at, 0
        while to < len(sizes) and (to == at or size + sizes[to] < BATCH):
            size += sizes[to]
            to += 1
        yield at, to
        at = to


SCHEMA = "doc_id {key}, rank int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids_sha256 string, round_trip boolean"


def encode_documents(docs: DataFrame, k: int = SAMPLES, key: str = "doc_id", text: str = "text", model: str = MODEL, alpha: float = ALPHA, with_ids: bool = False) -> DataFrame:
    """One row per row of docs and sample (rank 1 to k by perturbed log probability, fewer if a text has fewer segmentations).

    ids_sha256: of the ids as little-endian 4-byte integers; round_trip: the decoded ids give the text, its U+2581 as
    spaces; with_ids adds the ids.  Samples of a row are distinct and depend on its key and text alone, to the last bit,
    so rows that repeat give the same samples, and rows that share a key but not the text their own.  An empty or null
    text has one sample of no pieces; a null key seeds like 0.  Keys may be of any type that casts to a string; those
    that aren't whole numbers seed by the hash of that string.  Ties of perturbed log probabilities have no chance to
    matter: they go in the order found.  Texts are segmented whole; a very long one takes memory in proportion to its
    length.  Other columns play no part, whatever their names; an empty table gives no rows.
    """
    kind, named = docs.schema[key].dataType.simpleString(), not isinstance(docs.schema[key].dataType, T.IntegralType)
    schema = SCHEMA.format(key=kind) + (", ids array<int>" if with_ids else "")
    fields = [pa.field("rank", pa.int32()), pa.field("n_pieces", pa.int64()), pa.field("log_prob", pa.float64()), pa.field("perturbed", pa.float64()), pa.field("log_inclusion", pa.float64()), pa.field("ids_sha256", pa.string()), pa.field("round_trip", pa.bool_())]
    if with_ids:
        fields.append(pa.field("ids", pa.list_(pa.int32())))

    vocab = Vocabulary(model, alpha)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(vocab)
        for batch in batches:
            seeds = batch.column(2).to_pylist()
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            keys = [int(seed, 16) if named else int(seed) for seed in seeds]
            for a, b in _batches(sizes):
                out: list[tuple] = []
                origin: list[int] = []
                texts = batch.column(1).slice(a, b - a).to_pylist()
                for at_row, own, samples in zip(range(a, b), texts, sample_texts(vocab, texts, keys[a:b], k, known), strict=True):
                    want = (" " + own.replace(SPACE, " ")).encode("utf-8", "surrogatepass") if own else b""
                    spelt, at = vocab.spell(np.concatenate([s[0] for s in samples])).tobytes(), 0
                    for rank, (pieces, phi, g, score) in enumerate(samples, 1):
                        to = at + int(vocab.length[pieces].sum())
                        pieces = pieces.astype("<i4", copy=False)
                        out.append((rank, len(pieces), phi, g, score, hashlib.sha256(pieces.tobytes()).hexdigest(), spelt[at:to] == want, pieces)[: len(fields)])
                        origin.append(at_row)
                        at = to
                made = [pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), fields, strict=True)]
                ids = batch.column(0).take(pa.array(origin, pa.int32()))  # as they came, whatever their type
                yield pa.RecordBatch.from_arrays([ids, *made], ["doc_id", *(f.name for f in fields)])
                del out, texts
                trim()

    bound_batches(docs.sparkSession)
    name = F.col(key).cast("string")
    seed = F.substring(F.sha2(name, 256), 1, 14) if named else name
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.coalesce(seed, F.lit("0")).alias("seed")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """Adds `decoded`, the text of a column of ids as SentencePiece spells it.

    Null and empty ids give an empty text; bytes that are no UTF-8 become U+FFFD; ids outside the vocabulary are an
    error.  All columns but an old `decoded` stay.
    """
    vocab = Vocabulary(model)

    @F.pandas_udf("string")
    def spell(column: pd.Series) -> pd.Series:
        return pd.Series(["" if x is None else decode(vocab, np.asarray(x, np.int64)) for x in column], dtype=object)

    return encoded.withColumn("decoded", spell(F.col(ids)))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
