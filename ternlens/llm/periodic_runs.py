"""Runs of periodic words, found by block convolution.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical), at least
``MIN_LENGTH`` words and ``EXPONENT`` periods long, that no neighbouring word extends.

Blocks.  At scale ``L`` (8, 16, 32, ...) the words are cut into blocks of ``L``.  A run of period ``q`` in [L, 2L) and
three periods contains a whole block and its copy ``q`` words on, so each block is laid over all
places of the two blocks behind it, and the places with no mismatch are the seeds.  (Periods below 8 take blocks of 8
against the block itself and the next one: a run has 24 words.)  With words numbered, the mismatch at distance ``d`` is the sum of
squared differences ``sum (x[i+t] - x[i+d+t])^2``: prefix sums of squares, less twice a cross-correlation, which a
number-theoretic transform gives exactly in integers modulo a prime.  One transform of a block, padded to ``2L``, serves it
both as block and as part of the windows before it, since moving by ``L`` places only changes signs.

Seeds.  A distance whose sum vanishes modulo the prime is compared word by word and extended both ways as far as words
``d`` apart are identical: that also tells a sum that is a multiple of the prime from zero.  Scales go up, so the smallest period of
a stretch is found first, and seeds that a found run explains (multiples of its period inside it) are taken out.

Many texts are laid out behind one another, a word of its own between two, sorted by length, so that each scale treats only texts
long enough for it.  The work is n log^2 n in a text's words and doesn't depend on what they are.

Defined results: null and empty texts have no words and no runs; texts of any length are read whole; repeated rows are each
returned; an empty table gives an empty table; extra columns are ignored; a null identifier is returned as it is.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternlens.llm.common import own

MIN_LENGTH, EXPONENT = 24, 3
BASE = MIN_LENGTH // 3
#: Words that are laid out together (a longer text: alone).
CHUNK = 1 << 15
#: Prime and the largest power of two that divides it less one; 3 and 31 generate their groups.
PRIMES = ((7340033, 20, 3), (2013265921, 27, 31))
RUNS_DDL = "array<struct<start:long,length:long,period:long>>"


class Transform:
    """Forward and backward number-theoretic transforms of the columns of a matrix with ``size`` rows (not scaled)."""

    def __init__(self, size: int):
        self.size = size
        bits = size.bit_length() - 1
        self.p, top, g = next(x for x in PRIMES if x[1] >= bits)
        root = pow(g, (self.p - 1) >> bits, self.p)
        self.ahead, self.back = self._powers(root), self._powers(pow(root, -1, self.p))

    def _powers(self, root: int) -> np.ndarray:
        """The first half of the powers of ``root``, by doubling."""
        out = np.ones(1, np.uint64)
        p = np.uint64(self.p)
        while len(out) < self.size // 2:
            out = np.concatenate([out, out * np.uint64(pow(root, len(out), self.p)) % p])
        return out

    def run(self, x: np.ndarray, back: bool = False, half: bool = False) -> np.ndarray:
        """Transform of ``x`` (values below the prime); ``half``: ``x`` is the upper half of the rows, zeros follow.

        Sums stay unreduced as long as a product with them fits into 64 bits.
        """
        p, powers = np.uint64(self.p), self.back if back else self.ahead
        rows, width, bound = self.size, x.shape[1], self.p
        y = x.reshape(-1, width)
        stride = width
        while rows > 1:
            w = powers[::self.size // rows][:rows // 2, None]
            out = np.empty((rows // 2, 2, stride), np.uint64)
            if half:
                a = y.reshape(rows // 2, stride)
                out[:, 0] = a
                turned = a * w
                half = False
            else:
                a, b = y.reshape(2, rows // 2, stride)
                np.add(a, b, out=out[:, 0])
                turned = a + np.uint64(-(-bound // self.p) * self.p)
                turned -= b
                turned *= w
                bound *= 2
            np.remainder(turned, p, out=out[:, 1])
            rows, stride = rows // 2, stride * 2
            if 3 * bound * self.p >= 1 << 64:
                out %= p
                bound = self.p
            y = out
        return (y % p).reshape(self.size, width)


_TRANSFORMS: dict[int, Transform] = {}


def transform(size: int) -> Transform:
    if size not in _TRANSFORMS:
        _TRANSFORMS[size] = Transform(size)
    return _TRANSFORMS[size]


def matches(x: np.ndarray, size: int, ahead: int) -> np.ndarray:
    """[k, j]: whether the block j of ``size`` words occurs ``ahead * size + k`` words on (modulo the prime)."""
    n = len(x)
    blocks = -(-n // size)
    t = transform(2 * size)
    p = np.uint64(t.p)
    padded = np.zeros((blocks + 2) * size, np.uint64)
    padded[:n] = x
    f = t.run(np.ascontiguousarray((padded % p).reshape(blocks + 2, size).T), half=True)
    one, two = f[:, ahead:ahead + blocks], f[:, ahead + 1:ahead + 1 + blocks]
    window = np.empty((2 * size, blocks), np.uint64)
    np.add(one[::2], two[::2], out=window[::2])
    np.subtract(one[1::2] + p, two[1::2], out=window[1::2])
    window[0] *= f[0, :blocks]
    window[1:] *= f[:0:-1, :blocks]
    window %= p
    cross = t.run(window, back=True)[:size]
    squares = np.concatenate([np.zeros(1, np.uint64), np.cumsum(padded * padded), ])
    sums = (squares[size:] - squares[:-size])[:(blocks + 1) * size].reshape(-1, size).T
    both = (sums[:, ahead:ahead + blocks] + sums[:1, :blocks]) % p
    both *= np.uint64(size)
    both %= p
    found = both == cross
    # words beyond the end aren't there
    last = n - (ahead + 1) * size - np.arange(blocks) * size
    for j in range(max(0, blocks - ahead - 2), blocks):
        found[max(0, int(last[j]) + 1):, j] = False
    return found


def same_ahead(x: np.ndarray, at: int, d: int) -> int:
    """The first place from ``at`` on that differs from the one ``d`` on."""
    step, end = 64, len(x) - d
    while at < end:
        stop = min(at + step, end)
        same = x[at:stop] == x[at + d:stop + d]
        if not same.all():
            return at + int(same.argmin())
        at, step = stop, step * 2
    return end


def same_before(x: np.ndarray, at: int, d: int) -> int:
    """The first place of the stretch before ``at`` whose places equal those ``d`` on."""
    step = 64
    while at > 0:
        start = max(0, at - step)
        same = x[start:at] == x[start + d:at + d]
        if not same.all():
            return at - int(same[::-1].argmin())
        at, step = start, step * 2
    return 0


def explained(found: np.ndarray, size: int, ahead: int, run: tuple[int, int, int]) -> None:
    """Takes the seeds out that lie in ``run`` (start, end, period) at multiples of its period."""
    start, end, q = run
    first = -(-max(start, 0) // size)
    k = -ahead * size % q
    whole = (end - (ahead + 2) * size + 1) // size  # the last block that has all distances inside
    if whole >= first:
        found[k::q, first:whole + 1] = False
    for j in range(max(first, whole + 1), (end - (ahead + 1) * size) // size + 1):
        found[k:max(0, end - (ahead + 1) * size - j * size + 1):q, j] = False


def runs(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs in ``x``: texts behind one another, by ascending size, each followed by a word of its own."""
    out: list[tuple[int, int, int]] = []
    spans: set[tuple[int, int]] = set()
    longest = int(sizes[-1]) if len(sizes) else 0
    size, ahead = BASE, 0
    while longest >= max(MIN_LENGTH, EXPONENT * ahead * size):
        base = int(starts[np.searchsorted(sizes, max(MIN_LENGTH, EXPONENT * ahead * size))])
        part = x[base:]
        found = matches(part, size, ahead)
        if not ahead:
            found[0] = False
        for s, e, q in out:
            if e - s >= (ahead + 1) * size and s >= base:
                explained(found, size, ahead, (s - base, e - base, q))
        for j, k in zip(*np.nonzero(found.T)):
            if not found[k, j]:
                continue
            at, d = int(j) * size, ahead * size + int(k)
            hi = same_ahead(part, at, d)
            if hi < at + size:  # a sum that is a multiple of the prime
                continue
            lo = same_before(part, at, d)
            found[k, -(-lo // size):hi // size] = False
            if hi - lo + d >= max(MIN_LENGTH, EXPONENT * d) and (lo + base, hi + d + base) not in spans:
                spans.add((lo + base, hi + d + base))
                out.append((lo + base, hi + d + base, d))
                explained(found, size, ahead, (lo, hi + d, d))
        size, ahead = size * (1 + ahead), 1
    return out


def text_runs(ids: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each text (words as numbers): its runs (start, length, period), by start and period."""
    order = sorted(range(len(ids)), key=lambda k: len(ids[k]))
    sizes = np.array([len(ids[k]) for k in order], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    top = max([int(a.max()) for a in ids if len(a)], default=0)
    x = np.concatenate([np.append(ids[k], top + 1 + n) for n, k in enumerate(order)]).astype(np.uint64) if ids else np.zeros(0, np.uint64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in ids]
    for s, e, q in runs(x, starts, sizes):
        n = int(np.searchsorted(starts, s, side="right")) - 1
        out[order[n]].append((s - int(starts[n]), e - s, q))
    for r in out:
        r.sort(key=lambda t: (t[0], t[2]))
    return out


def collapsed(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Numbers of the words that stay: a run keeps its first period."""
    keep = np.ones(n, bool)
    for s, length, q in found:
        keep[s + q:s + length] = False
    return np.nonzero(keep)[0]


def periodic_runs(docs: DataFrame, source: Callable[[object, int], np.ndarray | None] | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period), collapsed: the words left, joined by one blank.

    ``source(identifier, n)`` may name, for each of a text's ``n`` words, the word that is read in its place (None: all as they are).
    """
    def work(ids, texts):
        words = [t.encode().split() if t else [] for t in texts]
        number = defaultdict(count().__next__)
        coded, origin = [], []
        for i, w in zip(ids, words):
            x = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
            o = source(i, len(w)) if source is not None and w else None
            coded.append(x if o is None else x[o])
            origin.append(o)
        found = text_runs(coded)
        kept = []
        for w, o, r in zip(words, origin, found):
            if r or o is not None:
                at = collapsed(len(w), r)
                w = [w[k] for k in (at if o is None else o[at])]
            kept.append(b" ".join(w).decode())
        flat = np.array([t for r in found for t in r], np.int64).reshape(-1, 3)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], names=["start", "length", "period"])
        return pa.ListArray.from_arrays(pa.array(offsets), items), pa.array(kept, pa.string())

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            names = ids.to_pylist()
            lo = 0
            while lo < len(texts):
                hi, held = lo, 0
                while hi < len(texts) and (hi == lo or held + len(texts[hi] or "") // 6 <= CHUNK):
                    held += len(texts[hi] or "") // 6
                    hi += 1
                found, kept = work(names[lo:hi], texts[lo:hi])
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), found, kept], names=[id_col, "runs", "collapsed"])
                lo = hi
    kind = docs.schema[id_col].dataType.simpleString()
    return own(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, runs {RUNS_DDL}, collapsed string")


def planted(i, n: int) -> np.ndarray | None:
    """A source of words that makes a tenth of the texts periodic from a place on, by the identifier's crc32."""
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + np.arange(n - a) % p
    return out


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent, and digests of all runs and of the collapsed text."""
    best = F.expr("""try_element_at(array_sort(runs, (x, y) -> CASE
        WHEN x.length * y.period > y.length * x.period THEN -1 WHEN x.length * y.period < y.length * x.period THEN 1
        WHEN x.start < y.start THEN -1 WHEN x.start > y.start THEN 1
        WHEN x.period < y.period THEN -1 WHEN x.period > y.period THEN 1 ELSE 0 END), 1)""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
