"""N-gram Jaccard join by universe partitioning and the pigeonhole principle.

A text's set holds its different shingles of ``WORDS`` words (a shorter text: one, all its words), as 64-bit hashes.  Two sets of
``a <= b`` shingles whose Jaccard similarity reaches ``num / den`` differ in at most ``H(a, b) = (den - num)(a + b) / (den + num)`` elements.

Segments.  Sizes are cut into bands, each ``den / num`` times as wide as it starts.  A band cuts the universe of hashes into ``m`` segments,
one more than the largest H of a set of the band and any larger one.  So two similar sets have the same subset in some segment.
The smaller set is indexed under its own band; the larger one probes its own band and the one below, further bands hold no similar set.

Allocation.  Each segment of a probing set gets 0 (left out), 1 (equal subsets are looked up) or 2 (subsets that differ in one element, too);
the pigeonhole principle needs a total of ``H + 1`` for the pair's sizes.  Segments that can get 2 carry, in the index and
in the probe, the subsets with one element deleted: equal to the other's whole subset, these are the subsets one apart.  Costs
are the numbers of sets met under the keys, counted over the whole table; the costliest segments (empty subsets, passages that very many
texts share) are left out, and a deletion neighbourhood is paid for when that allows to leave out a costlier segment.

Verification.  Pairs are first held against a parity sketch (bits toggled by the elements: two sketches never differ in more bits
than the sets do), which drops no similar pair, and then on the sets themselves: the intersection is exact but for collisions of 64-bit
hashes, about one in 1e13 for a pair of texts.

Components.  Equal sets are one node.  Each node is compared with the set it meets under most keys, first.  Then all pairs that meet
under a key and are in different components are compared by their sketches, large buckets in blocks; of the pairs left, the closest that
would join a block's components are verified, and in a second round every pair that is still between two components.  Only
pairs already joined by links are spared, so no component is missed, and a big group of near copies isn't expanded into all pairs.

Defined results: null texts and texts without words have an empty set and are linked with nothing, component their own identifier;
repeated rows and equal sets are one component; a null identifier is given a component by the other members, null if there are none; an
identifier with several texts is returned for each, in the component of that text; an empty table gives an empty table; texts of
any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ternlens.llm.common import discard, own, releasing, staged
from ternlens.llm.components import merged

WORDS = 4
SIMILARITY = (85, 100)
#: One in so many nodes is looked at for keys that very many rows carry; these are dealt over SALTS tasks.
SAMPLE, HEAVY, HEAVY_SHARE, SALTS = 32, 32, 1e-3, 64
#: Rows of a block of a large bucket; nodes remembered by a task so that copies send their keys once.
BLOCK, SEEN = 256, 1_000_000
#: Pairs of rows that are looked at together.
PAIRS = 1 << 18
#: Flags of a node under a key: indexed whole or with a deletion; probing whole, whole also against deletions, with a deletion.
INDEX, INDEX_DELETED, PROBE, PROBE_NEAR, PROBE_DELETED = 1, 2, 4, 8, 16
_GOLD, _SEG = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(WORDS)]
_S32 = np.uint64(32)
#: The primes of XXH64.
_P = [np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]
#: Characters of texts whose words are hashed together.
TOGETHER = 500_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


def word_hashes(raw: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XXH64 of the words ``raw[start:start + length]``; at least 8 bytes follow the last word's start.

    Words of one length are hashed together, long ones (32 bytes and more) one by one.
    """
    eight = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), 8)
    order = np.argsort(np.minimum(length, 32).astype(np.uint8), kind="stable")
    edge = np.searchsorted(length[order], np.arange(33))
    hashed = np.empty(len(start), np.uint64)
    for size in range(1, 32):
        at = order[edge[size]:edge[size + 1]]
        if not len(at):
            continue
        h, here, rest = np.full(len(at), _P[4] + np.uint64(size)), start[at], size
        while rest >= 8:
            h ^= _turned(eight[here].view("<u8").ravel() * _P[1], 31) * _P[0]
            h = _turned(h, 27) * _P[0] + _P[3]
            here, rest = here + 8, rest - 8
        tail = eight[here].view("<u8").ravel()
        if rest >= 4:
            h ^= (tail & np.uint64(0xFFFFFFFF)) * _P[0]
            h = _turned(h, 23) * _P[1] + _P[2]
            tail, rest = tail >> _S32, rest - 4
        for _ in range(rest):
            h ^= (tail & np.uint64(0xFF)) * _P[4]
            h = _turned(h, 11) * _P[0]
            tail = tail >> np.uint64(8)
        h = (h ^ (h >> np.uint64(33))) * _P[1]
        h = (h ^ (h >> np.uint64(29))) * _P[2]
        hashed[at] = h ^ (h >> _S32)
    for k in order[edge[32]:].tolist():
        hashed[k] = xxhash.xxh64_intdigest(raw[start[k]:start[k] + length[k]])
    return hashed


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the sorted different shingle hashes; words are split at ASCII white space and lower-cased in A-Z."""
    out = []
    for lo, hi in _groups(texts, TOGETHER):
        coded = [(t or "").encode() for t in texts[lo:hi]]
        raw = b"".join([b"\n", b"\n".join(coded).lower(), b"\n" * 8])
        byte = np.frombuffer(raw, np.uint8)
        blank = (byte == 32) | (byte - np.uint8(9) < 5)
        turn = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        start, length = turn[::2], turn[1::2] - turn[::2]
        w = word_hashes(raw, start, length)
        first = np.searchsorted(start, np.cumsum([1, *(len(c) + 1 for c in coded)])).tolist()
        s = np.zeros(0, np.uint64)
        if len(w) >= WORDS:
            full = len(w) - WORDS + 1
            s = w[:full] * _POWERS[0]
            for k in range(1, WORDS):
                s += w[k:k + full] * _POWERS[k]
            s = _mix(s + np.uint64(WORDS))
        for a, z in zip(first, first[1:]):
            if z - a >= WORDS:
                own_ = s[a:z - WORDS + 1]
                own_.sort()
                new = np.ones(len(own_), bool)
                np.not_equal(own_[1:], own_[:-1], out=new[1:])
                out.append(own_[new])
            elif z > a:  # fewer words: one shingle of all
                out.append(_mix((w[a:z] * np.array(_POWERS[:z - a])).sum(keepdims=True) + np.uint64(z - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def shingles(text: str | None, hashes: dict) -> np.ndarray:
    """The set of one text, as ``shingle_sets`` finds it for many; ``hashes`` has the words' XXH64."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(len(w) - WORDS + 1, 1)
    s = w[:n] * _POWERS[0]
    for k in range(1, min(WORDS, len(w))):
        s += w[k:k + n] * _POWERS[k]
    s = _mix(s + np.uint64(len(w) if len(w) < WORDS else WORDS))
    s.sort()
    new = np.ones(n, bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s if new.all() else s[new]


class Segments:
    """The bands and segments of a similarity of ``num / den``."""

    def __init__(self, similarity: tuple[int, int] = SIMILARITY):
        self.num, self.den = similarity
        if not 0 < self.num <= self.den:
            raise ValueError("the similarity lies above 0 and at most at 1")
        low = [1]
        while low[-1] < 1 << 31:
            low.append(low[-1] * self.den // self.num + 1 if self.num < self.den else 2 * low[-1])
        self.low = np.array(low, np.int64)

    def apart(self, a: int, b: int) -> int:
        """Elements in which similar sets of the two sizes can differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def high(self, band: int) -> int:
        return int(self.low[band + 1]) - 1

    def bands(self, n: int) -> list[int]:
        """A set's own band and, if sets there can be similar, the one below."""
        band = int(np.searchsorted(self.low, n, side="right")) - 1
        below = band and self.den * self.high(band - 1) >= self.num * n
        return [band, band - 1] if below else [band]

    def count(self, band: int) -> int:
        return (self.den - self.num) * self.high(band) // self.num + 1

    @staticmethod
    def capable(m: int) -> int:
        """Segments (the first ones) that carry deletion neighbourhoods."""
        return 0 if m == 1 else 1 + m // 64

    def keys(self, s: np.ndarray, element: np.ndarray, band: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Keys of a set's whole subsets by segment, and of the subsets less one element by capable segment."""
        m = self.count(band)
        seg = ((s >> _S32) * np.uint64(m)) >> _S32
        edge = np.searchsorted(seg, np.arange(m + 1, dtype=np.uint64))
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(element)])
        salt = _mix(np.arange(m, dtype=np.uint64) * _SEG + np.uint64((band + 1) * int(_GOLD) & (1 << 64) - 1))
        total = run[edge[1:]] - run[edge[:-1]] + salt
        deleted = [_mix(total[j] - element[edge[j]:edge[j + 1]]) for j in range(self.capable(m))]
        return _mix(total), deleted

    def all_keys(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of a set under all its bands, and of each its tag: 4 * segment + 2 * (one element deleted) + (band below)."""
        element = _mix(s + _GOLD)
        keys, tags = [], []
        for below, band in enumerate(self.bands(len(s))):
            whole, deleted = self.keys(s, element, band)
            keys += [whole, *deleted]
            tags += [np.arange(len(whole)) * 4 + below, *[np.full(len(d), 4 * j + 2 + below) for j, d in enumerate(deleted)]]
        return np.concatenate(keys), np.concatenate(tags).astype(np.int32)

    def allocated(self, n: int, tags: np.ndarray, cost: np.ndarray) -> np.ndarray:
        """Flags of the keys (by tag) of a set of ``n`` elements that meet others, at a ``cost`` (sets met; 0 for all keys not named).

        Segments are allocated so that the sum of the costs is least.
        """
        flags = np.zeros(len(tags), np.int32)
        below, deleted, segment = tags & 1, tags & 2 > 0, tags >> 2
        flags[(below == 0) & ~deleted] |= INDEX
        flags[(below == 0) & deleted] |= INDEX_DELETED
        for k, band in enumerate(self.bands(n)):
            m = self.count(band)
            whole, gone = (below == k) & ~deleted, (below == k) & deleted
            price, near = np.zeros(m, np.int64), np.zeros(self.capable(m), np.int64)
            np.add.at(price, segment[whole], cost[whole])
            np.add.at(near, segment[gone], cost[gone])
            near += price[:len(near)]
            spare = m - self.apart(n, min(n, self.high(band))) - 1
            order, cheap = np.argsort(-price, kind="stable"), np.argsort(near, kind="stable")
            best = None
            for raised in range(len(near) + 1):
                up = cheap[:raised]
                lower = np.ones(m, bool)
                lower[up] = False
                rest = order[lower[order]]
                total = price[rest[spare + raised:]].sum() + near[up].sum()
                if best is None or total < best[0]:
                    best = (total, rest[:spare + raised], up)
            level = np.ones(m, np.int64)
            level[best[1]], level[best[2]] = 0, 2
            got = np.where(below == k, level[np.minimum(segment, m - 1)], 0)
            flags[whole & (got > 0)] |= PROBE
            flags[whole & (got > 1)] |= PROBE_NEAR
            flags[gone & (got > 1)] |= PROBE_DELETED
        return flags


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity bits (as bytes) by the elements' last bits; eight bits an element or more, a power of two."""
    size = 1 << max(6, (8 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1)


def sketch_distance(x: bytes, y: bytes) -> int:
    """Bits in which the sketches differ, the longer one folded to the length of the other."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    if len(b) > len(a):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def _groups(texts: list, most: int = 4_000_000):
    """Slices of texts of bounded length together."""
    lo = 0
    while lo < len(texts):
        hi, chars = lo, 0
        while hi < len(texts) and (hi == lo or chars < most):
            chars += len(texts[hi] or "")
            hi += 1
        yield lo, hi
        lo = hi


def signed(docs: DataFrame, similarity: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """id, th (hash of the text), n, node (hash of the set; null if empty), and once for a task's copies: keys, tags, bits (the sketch)."""
    def run(batches):
        segments, seen = Segments(similarity), set()
        for b in batches:
            ids, texts, th = b.column(0), b.column(1).to_pylist(), b.column(2)
            for lo, hi in _groups(texts):
                n, node, keys, tags, bits = [], [], [], [], []
                for s in shingle_sets(texts[lo:hi]):
                    n.append(len(s))
                    name = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None
                    node.append(name)
                    if name is None or name in seen:
                        for column in (keys, tags, bits):
                            column.append(None)
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    key, tag = segments.all_keys(s)
                    keys.append(key.view(np.int64))
                    tags.append(tag)
                    bits.append(sketch(s).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), th.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(tags, pa.list_(pa.int32())), pa.array(bits, pa.binary())],
                    names=["id", "th", "n", "node", "keys", "tags", "bits"])
    kind = docs.schema[id_col].dataType.simpleString()
    rows = own(docs, id_col, text_col).withColumn("th", F.xxhash64(F.col(text_col)))
    return rows.mapInArrow(run, f"id {kind}, th long, n long, node long, keys array<long>, tags array<int>, bits binary")


def meetings(keys: DataFrame) -> DataFrame:
    """key, node, tag, c (rows under the key), hub (its least node) of all keys under which different nodes meet.

    ``keys`` (key, node, tag) are shuffled once.  Keys that a sample shows under a large share of all nodes are dealt over several
    tasks; there are at most (keys a node) / HEAVY_SHARE of them, so they can be broadcast.
    """
    some = keys.filter(F.pmod("node", F.lit(SAMPLE)) == 0)
    total = some.agg((F.approx_count_distinct("node") * HEAVY_SHARE).alias("least"))
    heavy = (some.groupBy("key").agg(F.count("*").alias("k")).filter(F.col("k") >= HEAVY)
             .join(F.broadcast(total), F.col("k") >= F.col("least")).select("key", F.lit(True).alias("heavy")))
    heavy = staged(heavy, "heavy", slim=True)
    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int") + 1).otherwise(0).alias("salt")
    dealt = keys.join(F.broadcast(heavy), "key", "left").select("key", "node", "tag", salt)
    part = Window.partitionBy("key", "salt")
    met = dealt.select("key", "node", "tag", "salt", F.min("node").over(part).alias("hub"), F.max("node").over(part).alias("top"),
                       F.count("*").over(part).alias("c"))
    met = staged(met.filter("salt > 0 OR hub <> top").distinct(), "met")
    light = met.filter("salt = 0").select("key", "node", "tag", "c", "hub")
    # of a heavy key, the parts are put together: SALTS rows for each at most
    parts = met.filter("salt > 0").groupBy("key", "salt").agg(F.max("c").alias("c"), F.min("hub").alias("hub"), F.max("top").alias("top"))
    key = Window.partitionBy("key")
    whole = (parts.select("key", "salt", F.sum("c").over(key).alias("c"), F.min("hub").over(key).alias("hub"), F.max("top").over(key).alias("top"))
             .filter("hub <> top").select("key", "salt", "c", "hub"))
    out = staged(light.union(met.filter("salt > 0").select("key", "salt", "node", "tag").join(whole, ["key", "salt"])
                             .select("key", "node", "tag", "c", "hub")), "meetings")
    discard(heavy, met)
    return out


def allocations(met: DataFrame, names: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """node, n, bits, first (the node it meets under most keys), rows (key, flags) of the nodes that meet others."""
    hits = met.groupBy("node").agg(F.collect_list(F.struct("key", "tag", "c", "hub")).alias("hits"))

    def run(batches):
        segments = Segments(similarity)
        for b in batches:
            node, n, hits = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
            edge = hits.offsets.to_numpy()
            key, tag, c, hub = (hits.values.field(k).to_numpy() for k in range(4))
            first, flags = [], np.zeros(len(key), np.int32)
            for k in range(len(node)):
                at = slice(edge[k], edge[k + 1])
                flags[at] = segments.allocated(int(n[k]), tag[at], c[at] - 1)
                others, times = np.unique(hub[at][hub[at] != node[k]], return_counts=True)
                first.append(int(others[times.argmax()]) if len(others) else None)
            rows = pa.StructArray.from_arrays([pa.array(key), pa.array(flags)], names=["key", "flags"])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(first, pa.int64()), pa.ListArray.from_arrays(pa.array(edge), rows)],
                                             names=["node", "n", "bits", "first", "rows"])
    return (names.select("node", "n", "bits").join(hits, "node")
            .mapInArrow(run, "node long, n long, bits binary, first long, rows array<struct<key:long,flags:int>>"))


def near_pairs(pairs: DataFrame, live: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Those of ``pairs`` (a, b) that sizes and sketches allow to be similar."""
    num, den = similarity

    def run(batches):
        segments = Segments(similarity)
        for b in batches:
            na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
            near = [sketch_distance(x, y) <= segments.apart(int(p), int(q))
                    for x, y, p, q in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), na, nb)]
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))
    side = lambda c: live.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    sized = (pairs.join(side("a"), "a").join(side("b"), "b")
             .filter(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
             .select("a", "b", "n_a", "n_b", "bits_a", "bits_b"))
    return sized.mapInArrow(run, "a long, b long")


def sets(docs: DataFrame, names: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, cells (the whole set) of the nodes, from the text that ``names`` has for each."""
    def run(batches):
        for b in batches:
            node, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in _groups(texts):
                yield pa.RecordBatch.from_arrays(
                    [node.slice(lo, hi - lo), pa.array([s.view(np.int64) for s in shingle_sets(texts[lo:hi])], pa.list_(pa.int64()))],
                    names=["node", "cells"])
    texts = own(docs, id_col, text_col).select(F.col(id_col).alias("i"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    wanted = names.select("node", "id", "th").join(nodes, "node")
    return (texts.join(wanted, F.col("i").eqNullSafe(F.col("id")) & (F.col("h") == F.col("th"))).select("node", "text")
            .mapInArrow(run, "node long, cells array<long>").dropDuplicates(["node"]))


def verified(near: DataFrame, texts: tuple, similarity: tuple[int, int]) -> DataFrame:
    """Those of the pairs ``near`` (a, b) whose sets are similar (``texts``: arguments of ``sets`` but for the nodes)."""
    num, den = similarity
    docs, names, *columns = texts
    nodes = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    cells = staged(sets(docs, names, nodes, *columns), "sets")
    one, two = cells.toDF("a", "cells_a"), cells.toDF("b", "cells_b")
    both = F.size(F.array_intersect("cells_a", "cells_b"))
    out = staged(near.join(one, "a").join(two, "b")
                 .filter(both * den >= (F.size("cells_a") + F.size("cells_b") - both) * num).select("a", "b"), "links", slim=True)
    discard(cells)
    return out


def distances(bits: list[bytes], i: np.ndarray, j: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """Sketch distances of the pairs ``bits[i]``, ``bits[j]``."""
    size = np.array([len(x) for x in bits])
    out = np.zeros(len(i), np.int64)
    shape = size[i] * (1 << 32) + size[j]
    for s in np.unique(shape):
        at = np.nonzero(shape == s)[0]
        least = int(min(s >> 32, s & 0xFFFFFFFF))

        def folded(k):
            used, back = np.unique(k, return_inverse=True)
            rows = np.frombuffer(b"".join([bits[x] for x in used]), np.uint8).reshape(len(used), -1, least)
            return np.bitwise_xor.reduce(rows, axis=1), back
        (p, pi), (q, qi) = folded(i[at]), folded(j[at])
        step = max(1, most // least)
        for lo in range(0, len(at), step):
            differ = p[pi[lo:lo + step]] ^ q[qi[lo:lo + step]]
            out[at[lo:lo + step]] = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
    return out


def _block_pairs(t: pa.Table, edge: np.ndarray, segments: Segments, joining: bool) -> pa.RecordBatch:
    """Of groups of rows of ``t`` (two blocks of a bucket each; they start at ``edge``, which also has the last one's end), the pairs
    (a, b) between components whose sketches allow them to be similar, but for those that have been tried; ``joining``: of these
    the closest ones that would join a group's components."""
    node, n, label, flags = (t.column(c).to_numpy() for c in ("node", "n", "label", "flags"))
    left = t.column("left").to_numpy()
    same = t.column("x").to_numpy() == t.column("y").to_numpy()
    size = np.diff(edge)
    group = np.repeat(np.arange(len(size)), size)
    times = size[group]
    p = np.repeat(np.arange(edge[0], edge[-1]), times)
    q = np.arange(len(p)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(edge[group], times)
    ok = (label[p] != label[q]) & np.where(same[p], node[p] < node[q], left[p] & ~left[q])
    p, q = p[ok], q[ok]
    larger = (n[p] > n[q]) | ((n[p] == n[q]) & (node[p] > node[q]))
    small, large = np.where(larger, flags[q], flags[p]), np.where(larger, flags[p], flags[q])
    ok = (((small & INDEX > 0) & (large & (PROBE | PROBE_NEAR | PROBE_DELETED) > 0))
          | ((small & INDEX_DELETED > 0) & (large & PROBE_NEAR > 0)))
    ok &= np.minimum(n[p], n[q]) * segments.den >= np.maximum(n[p], n[q]) * segments.num
    p, q = p[ok], q[ok]
    pairs = []
    if len(p):
        used, at = np.unique(np.concatenate([p, q]), return_inverse=True)
        most = (segments.den - segments.num) * (n[p] + n[q]) // (segments.den + segments.num)
        far = distances(t.column("bits").take(pa.array(used)).to_pylist(), at[:len(p)], at[len(p):])
        near = far <= most
        p, q, share = p[near], q[near], far[near] / np.maximum(most[near], 1)
        which = group[p - edge[0]]
        order = np.lexsort((share, which))
        pairs = list(zip(*(v[order].tolist() for v in (which, p, q))))
    tried = t.column("tried").combine_chunks()
    begin, names = tried.offsets.to_numpy(), tried.values.to_numpy()
    parent: dict[tuple[int, int], tuple[int, int]] = {}

    def top(x):
        while (up := parent.get(x, x)) != x:
            x = up
        return x
    out = []
    for g, x, y in pairs:
        if node[x] > node[y]:
            x, y = y, x
        if begin[x] < begin[x + 1] and (names[begin[x]:begin[x + 1]] == node[y]).any():
            continue
        if joining:
            u, v = top((g, int(label[x]))), top((g, int(label[y])))
            if u == v:
                continue
            parent[u] = v
        out.append((int(node[x]), int(node[y])))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def _ended(t: pa.Table, last: bool) -> tuple[list[np.ndarray], int]:
    """Starts of the groups (key, x, y) of ``t`` that have ended, and the end, in parts of at most ``PAIRS`` pairs or one group;
    and the row from which on rows are left."""
    key, x, y = (t.column(c).to_numpy() for c in ("key", "x", "y"))
    edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    if last:
        edge = np.append(edge, len(key))
    part = (np.cumsum(np.diff(edge) ** 2) - 1) // PAIRS
    cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    return [edge[a:z + 1] for a, z in zip(cut, cut[1:]) if a < z], int(edge[-1])


def questions(rows: DataFrame, live: DataFrame, labels: DataFrame | None, tried: DataFrame, similarity: tuple[int, int],
              joining: bool) -> DataFrame:
    """Pairs (a, b) of nodes in different components that meet under a key as index and probe and may be similar by their sketches.

    ``rows``: key, node, n, flags; ``tried``: pairs (a, b) verified before.
    """
    if labels is not None:
        rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    else:
        rows = rows.withColumn("label", F.col("node"))
    probing = PROBE | PROBE_NEAR | PROBE_DELETED
    keys = (rows.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"),
                                    F.max(F.col("flags").bitwiseAND(INDEX | INDEX_DELETED) > 0).alias("index"),
                                    F.max(F.col("flags").bitwiseAND(probing) > 0).alias("probe"))
            .filter("lo <> hi AND index AND probe")
            .select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    not_with = tried.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("tried"))
    known = live.select("node", "bits").join(not_with, "node", "left")
    placed = (rows.join(keys, "key").join(known, "node").withColumn("me", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
              .select("key", F.least("me", "other").alias("x"), F.greatest("me", "other").alias("y"),
                      (F.col("me") <= F.col("other")).alias("left"), "node", "n", "label", "flags", "bits", "tried"))

    def run(batches):
        segments, held = Segments(similarity), []
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([*held, b]).combine_chunks()
                parts, rest = _ended(t, False)
                yield from (_block_pairs(t, edge, segments, joining) for edge in parts)
                held = t.slice(rest).to_batches()
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from (_block_pairs(t, edge, segments, joining) for edge in _ended(t, True)[0])
    return (placed.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
            .mapInArrow(run, "a long, b long").distinct())


def set_join(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
             ) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(id, n, node of every row; verified links (a, b) between nodes that join the components; node, label of linked nodes)."""
    rows = staged(signed(docs, similarity, id_col, text_col), "signed")
    met = meetings(rows.filter("keys IS NOT NULL").select("node", F.explode(F.arrays_zip("keys", "tags")).alias("k"))
                   .select(F.col("k.keys").alias("key"), "node", F.col("k.tags").alias("tag")))
    members = staged(rows.select("id", "th", "n", "node"), "members")
    names = (rows.filter("bits IS NOT NULL").groupBy("node").agg(F.min(F.struct("id", "th", "n", "bits")).alias("one"))
             .select("node", "one.*"))
    live = staged(allocations(met, names, similarity), "live")
    names = staged(names.join(live.select("node"), "node", "left_semi").select("node", "id", "th"), "names")
    discard(rows, met)
    texts = (docs, names, id_col, text_col)
    first = live.filter("first IS NOT NULL").select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b")).distinct()
    asked = staged(near_pairs(first, live, similarity), "near", slim=True)
    links = verified(asked, texts, similarity)
    found, labels = links, merged(None, links) if links.limit(1).count() else None
    tried = asked
    rows = staged(live.select("node", "n", F.explode("rows").alias("r")).select("r.key", "node", "n", "r.flags"), "rows")
    for joining in (True, False):
        asked = staged(questions(rows, live, labels, tried, similarity, joining), "near", slim=True)
        if not asked.limit(1).count():
            break
        links = verified(asked, texts, similarity)
        if links.limit(1).count():
            found, labels = found.union(links), merged(labels, links)
        tried = tried.union(asked)
    return members, (found if labels is not None else None), labels


@releasing
def linked_components(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, and ``set_id`` (equal for documents with equal sets; null if empty) for every row."""
    members, _, labels = set_join(docs, similarity, id_col, text_col)
    rows = members.select("id", "n", "node")
    rows = rows.join(labels, "node", "left") if labels is not None else rows.withColumn("label", F.lit(None).cast("long"))
    rows = rows.select("id", "n", "node", F.coalesce("label", "node").alias("label"))
    least = rows.filter("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("least"))
    return rows.join(least, "label", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least")).alias("component_id"), F.col("node").alias("set_id"))
