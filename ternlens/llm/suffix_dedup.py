"""Removal of repeated byte strings with suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else, in the same document or
another, is removed.

Which strings can be equal.  Of the ``LENGTH - GRAM + 1`` grams in a string, the one with the least hash is its
anchor; equal strings have equal anchors at the same place.  A text's starts fall into runs with one anchor, and
only runs whose anchor's hash occurs twice or more go on.  No string is missed; a hash collision only lets more in.

Shards.  The bytes of a run (its starts and LENGTH - 1 bytes after) are a region, named by its anchor's hash and a 64-bit hash of
its bytes.  Equal regions are counted and become one, so that a group of copies, however large, is one region; all its starts
repeat.  Only names move until here: bytes are read for one place of each distinct region whose anchor has others, so they
are sent once, whatever the number of copies and tasks.  These
regions are dealt by anchor, ``REGIONS`` to a shard, so a shard holds strings that could be equal to its own.  A shard gets a suffix array by
Larsson-Sadakane refinement (groups of equal prefixes are refined by the ranks ``h`` places on, with h doubling; sorted ones are left
alone), and the common prefixes of neighbours by Kasai's method, run for all regions side by side: a start repeats if a neighbour
shares LENGTH bytes.  Shards of one anchor are merged pair by pair, each pair in a task of its own, by binary search: the
strings of each are looked up in the sorted ones of the other.  So an anchor with any number of regions goes to no single task.

Defined results: null text counts as empty; texts shorter than LENGTH keep everything; repeated rows are copies of each other (all
their strings repeat) and each is returned; empty tables give an empty table; extra columns are ignored; texts of any
length are read whole, long ones in pieces that overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternlens.llm.common import collect_shuffles, discard, let_go, own, releasing, sliced, staged

LENGTH, GRAM = 200, 32
WINDOW = LENGTH - GRAM + 1
PIECE = 1 << 19
#: Bytes of a shard (ranks and places are packed with 21 bits each), and regions of one anchor in a shard (below these bytes).
BITS = 21
SHARD = (1 << BITS) - 2048
REGIONS = 4096
#: Bytes of small groups of regions that get one suffix array.
TOGETHER = 1 << 20
#: Strings that are compared at once (LENGTH bytes each).
CHECKED = 1 << 15
SENTINEL = 255  # not a byte of UTF-8
_LOW = np.uint64((1 << BITS) - 1)
_RNG = np.random.default_rng(20260101)
_BYTE_HASH = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_MASK64 = 2**64 - 1


# ---- anchors -------------------------------------------------------------------------------------------------

def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on (GRAM: a power of two)."""
    h, size = _BYTE_HASH[b], 1
    while size < GRAM:
        h = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_anchors(g: np.ndarray) -> np.ndarray:
    """Place of the least hash (leftmost) among the WINDOW grams from each place on."""
    m = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    size = 1
    while 2 * size <= WINDOW:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = WINDOW - size
    m = np.minimum(m[:len(m) - rest], m[rest:])
    return (m & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts with one anchor: text, first start, number of starts, anchor's hash."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    group: list[tuple[int, int, bytes]] = []
    held = 0

    def flush():
        nonlocal held
        if not group:
            return
        size = np.array([len(t) for _, _, t in group])
        b = np.frombuffer(b"".join(t for _, _, t in group), np.uint8)
        ends = np.cumsum(size)
        g = gram_hashes(b)
        anchor = window_anchors(g)
        last = np.repeat(ends - LENGTH, size)[:len(anchor)]
        at = np.arange(len(anchor))
        at = at[at <= last]
        a = anchor[at]
        first = np.nonzero(np.append(True, (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)))[0]
        count = np.diff(np.append(first, len(at)))
        which = np.searchsorted(ends, at[first], side="right")
        out[0].append(np.array([k for k, _, _ in group])[which])
        out[1].append(at[first] - (ends - size)[which] + np.array([lo for _, lo, _ in group])[which])
        out[2].append(count)
        out[3].append(g[a[first]])
        group.clear()
        held = 0

    for k, t in enumerate(texts):
        for lo in range(0, max(len(t) - LENGTH + 1, 0), PIECE):
            piece = t[lo:lo + PIECE + LENGTH - 1]
            group.append((k, lo, piece))
            held += len(piece)
            if held >= PIECE:
                flush()
    flush()
    if not out[0]:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    text, start, count, h = (np.concatenate(x) for x in out)
    order = np.argsort(text, kind="stable")
    return text[order], start[order], count[order], h[order]


# ---- suffix arrays -------------------------------------------------------------------------------------------

def words(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number (zeros beyond the end)."""
    w = np.concatenate([b, np.zeros(8, np.uint8)]).astype(np.uint64)
    for size in (1, 2, 4):
        w = (w[:-size] << np.uint64(8 * size)) | w[size:]
    return w[:len(b)]


def suffix_array(b: np.ndarray, w: np.ndarray, depth: int = 512) -> np.ndarray:
    """Places in the order of their suffixes, to ``depth`` bytes at least (Larsson-Sadakane)."""
    n, bits = len(b), np.uint64(BITS)
    place = np.arange(n, dtype=np.uint64)
    key = np.sort(((w >> np.uint64(24)) << bits) | place)
    sa = (key & _LOW).astype(np.int64)
    rank = np.zeros(n, np.uint64)
    slots, h = np.arange(n), 5
    while True:
        prefix = key >> bits
        new = np.append(True, prefix[1:] != prefix[:-1])
        # a group's rank is the slot of its first member
        rank[sa[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        if not len(slots) or h >= depth:
            return sa
        i = sa[slots]
        j = i + h
        second = np.where(j < n, rank[np.minimum(j, n - 1)] + np.uint64(1), np.uint64(0))
        key = np.sort((rank[i] << np.uint64(2 * BITS)) | (second << bits) | i.astype(np.uint64))
        sa[slots] = (key & _LOW).astype(np.int64)
        h *= 2


def common_prefixes(w: np.ndarray, sa: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For the starts of all regions: bytes shared with the suffix before it in ``sa`` (Kasai), up to LENGTH.

    Regions are lanes: step ``t`` treats the ``t``-th start of each, whose prefix is at most one byte
    shorter than that of the start before.  Eight bytes are compared at once.
    """
    n = len(w)
    slot = np.empty(n, np.int64)
    slot[sa] = np.arange(n)
    out = np.zeros(n, np.int32)
    lanes = np.argsort(-counts, kind="stable")
    starts, counts = starts[lanes], counts[lanes]
    h = np.zeros(len(starts), np.int64)
    for t in range(int(counts[0]) if len(counts) else 0):
        live = int(np.searchsorted(-counts, -t, side="left"))  # counts > t
        i = starts[:live] + t
        s = slot[i]
        j = sa[np.maximum(s - 1, 0)]
        g = np.maximum(h[:live] - 1, 0)
        g[s == 0] = 0
        todo = np.nonzero((s > 0) & (g < LENGTH))[0]
        while len(todo):
            x, y = i[todo] + g[todo], j[todo] + g[todo]
            inside = (x < n) & (y < n)
            differ = w[np.minimum(x, n - 1)] ^ w[np.minimum(y, n - 1)]
            same = np.where(inside, np.where(differ == 0, 8, 7 - (np.log2(np.maximum(differ, 1).astype(np.float64)) // 8).astype(np.int64)), 0)
            g[todo] += same
            todo = todo[(same == 8) & (g[todo] < LENGTH)]
        h[:live] = g
        out[i] = np.minimum(g, LENGTH)
    return out


def strings(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The LENGTH-byte strings at the places, as fixed-size values that sort by bytes."""
    flat = np.lib.stride_tricks.sliding_window_view(b, LENGTH)[at]
    return np.ascontiguousarray(flat).view(f"S{LENGTH}").ravel()


class Shard:
    """Regions of one shard, with the flags of their starts."""

    def __init__(self, regions: list[bytes]):
        size = np.array([len(r) for r in regions])
        self.counts = size - LENGTH + 1
        self.starts = np.cumsum(size + 1) - size - 1
        self.b = np.frombuffer(b"".join(r + bytes([SENTINEL]) for r in regions), np.uint8)
        w = words(self.b)
        self.sa = suffix_array(self.b, w)
        shared = common_prefixes(w, self.sa, self.starts, self.counts)
        slot = np.empty(len(self.b), np.int64)
        slot[self.sa] = np.arange(len(self.b))
        hit = np.nonzero(shared >= LENGTH)[0]
        before = self.sa[slot[hit] - 1]
        # an exact check of what was found: the order is cut at a depth
        same = np.zeros(len(hit), bool)
        for lo in range(0, len(hit), CHECKED):
            part = slice(lo, lo + CHECKED)
            same[part] = strings(self.b, hit[part]) == strings(self.b, before[part])
        self.flag = np.zeros(len(self.b), bool)
        self.flag[hit[same]] = True
        self.flag[before[same]] = True

    def places(self) -> np.ndarray:
        """All starts."""
        return np.repeat(self.starts, self.counts) + np.arange(self.counts.sum()) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)

    def merge(self, other: "Shard", step: int = 1 << 17) -> None:
        """Flag the starts of both whose strings are in the other one too, by binary search in the other's order."""
        is_start = np.zeros(len(other.b), bool)
        is_start[other.places()] = True
        order = other.sa[is_start[other.sa]]
        mine = self.places()
        for lo in range(0, len(order), step):
            part = order[lo:lo + step]
            sorted_strings = strings(other.b, part)
            for at in range(0, len(mine), step):
                some = mine[at:at + step]
                own_strings = strings(self.b, some)
                k = np.minimum(np.searchsorted(sorted_strings, own_strings), len(part) - 1)
                found = sorted_strings[k] == own_strings
                self.flag[some[found]] = True
                right = np.searchsorted(sorted_strings, own_strings[found], side="right")
                for a, z in set(zip(k[found].tolist(), right.tolist())):
                    other.flag[part[a:z]] = True

    def spans(self) -> list[list[int]]:
        """Of each region, the first and behind-last flagged starts, one after the other."""
        out = []
        for s, c in zip(self.starts, self.counts):
            edge = np.diff(np.concatenate([[0], self.flag[s:s + c].astype(np.int8), [0]]))
            out.append(np.nonzero(edge)[0].tolist())
        return out


def repeated(regions: list[list[bytes]]) -> list[list[list[int]]]:
    """Spans of repeated starts of the regions of each anchor."""
    out: list[list[list[int]]] = []
    small: list[list[bytes]] = []

    def flush():
        if small:
            spans = iter(Shard([r for group in small for r in group]).spans())
            out.extend([next(spans) for _ in group] for group in small)
            small.clear()

    held = 0
    for group in regions:
        size = sum(len(r) + 1 for r in group)
        if size > SHARD:
            flush()
            held = 0
            parts: list[list[bytes]] = [[]]
            room = SHARD
            for r in group:
                if room < len(r) + 1:
                    parts.append([])
                    room = SHARD
                parts[-1].append(r)
                room -= len(r) + 1
            shards = [Shard(p) for p in parts]
            for k, one in enumerate(shards):
                for two in shards[k + 1:]:
                    one.merge(two)
            out.append([s for shard in shards for s in shard.spans()])
            continue
        if held + size > TOGETHER:
            flush()
            held = 0
        small.append(group)
        held += size
    flush()
    return out


def merged_spans(one: list[bytes], two: list[bytes]) -> list[list[int]]:
    """Spans of repeated starts of the regions of two shards, of the first and then of the second."""
    def parts(regions: list[bytes]) -> list[Shard]:
        out, room = [], 0
        for r in regions:
            if room < len(r) + 1:
                out.append([])
                room = SHARD
            out[-1].append(r)
            room -= len(r) + 1
        return [Shard(p) for p in out]
    first, second = parts(one), parts(two)
    for a in first:
        for b in second:
            a.merge(b)
    return [s for shard in first + second for s in shard.spans()]


# ---- Spark ---------------------------------------------------------------------------------------------------

def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, and two hashes that name a row by identifier and text."""
    return own(docs, id_col, text_col).select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "id", "text", F.xxhash64("text").alias("k1"),
        F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.length("text")).alias("k2"))


def anchored(rows: DataFrame) -> DataFrame:
    """id, k1, k2, n_bytes, sha and the runs (h, d, s, c: parallel arrays of anchor, region, first start, starts) of each row."""
    def run(batches):
        let_go()
        for b in sliced(batches):
            texts = [t.encode() for t in b.column(1).to_pylist()]
            text, start, count, h = runs(texts)
            d = np.fromiter((xxhash.xxh3_64_intdigest(texts[k][s:s + n]) for k, s, n in zip(text.tolist(), start.tolist(), (count + LENGTH - 1).tolist())),
                            np.uint64, len(text))
            offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            lists = lambda v, kind: pa.ListArray.from_arrays(pa.array(offsets), pa.array(v, kind))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                 lists(h.view(np.int64), pa.int64()), lists(d.view(np.int64), pa.int64()), lists(start.astype(np.int32), pa.int32()),
                 lists(count.astype(np.int32), pa.int32())],
                names=["id", "k1", "k2", "n_bytes", "sha", "h", "d", "s", "c"])
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, k1 long, k2 long, n_bytes long, sha binary, "
                                "h array<long>, d array<long>, s array<int>, c array<int>")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, marks: h, d, s, c) to (h, d, content): the bytes of the marked regions."""
    for b in sliced(batches):
        h, d, content = [], [], []
        for t, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            raw = t.encode()
            for m in marks:
                h.append(m["h"])
                d.append(m["d"])
                content.append(raw[m["s"]:m["s"] + m["c"] + LENGTH - 1])
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(d, pa.int64()), pa.array(content, pa.binary())],
                                         names=["h", "d", "content"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, x, y, left, d, content), sorted by (h, x, y), to (h, d, spans): the shard x of an anchor itself, or merged with its shard y.

    Shards of several anchors are worked on together, about ``TOGETHER`` bytes at a time.
    """
    held: list[tuple] = []
    size = 0

    def work(rows):
        groups: dict[tuple, list[int]] = {}
        pairs: dict[tuple, tuple[list[int], list[int]]] = {}
        for k, (h, x, y, left, _, _) in enumerate(rows):
            if x == y:
                groups.setdefault((h, x), []).append(k)
            else:
                pairs.setdefault((h, x, y), ([], []))[not left].append(k)
        found = dict(zip((k for g in groups.values() for k in g),
                         (s for some in repeated([[rows[k][5] for k in g] for g in groups.values()]) for s in some)))
        for one, two in pairs.values():
            if one and two:
                found |= dict(zip(one + two, merged_spans([rows[k][5] for k in one], [rows[k][5] for k in two])))
        hit = [k for k, s in found.items() if s]
        return pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in hit], pa.int64()), pa.array([rows[k][4] for k in hit], pa.int64()),
                                           pa.array([found[k] for k in hit], pa.list_(pa.int32()))], names=["h", "d", "spans"])

    for b in sliced(batches):
        for row in zip(*(b.column(k).to_pylist() for k in range(6))):
            if size >= TOGETHER and held and held[-1][:3] != row[:3]:
                yield work(held)
                held, size = [], 0
            held.append(row)
            size += len(row[5]) + 1
    if held:
        yield work(held)


def marked_starts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all rows without texts; k1, k2, text, each once; k1, k2, starts: spans of repeated starts)."""
    rows = _keyed(docs, id_col, text_col)
    texts = rows.select("k1", "k2", "text").dropDuplicates(["k1", "k2"])
    all_runs = staged(anchored(rows), "anchored")
    base = staged(all_runs.select("id", "k1", "k2", "n_bytes", "sha"), "base", slim=True)
    anchors = all_runs.select("k1", "k2", F.explode(F.arrays_zip("h", "d", "s", "c")).alias("m")).select("k1", "k2", "m.*")
    # anchors that occur twice, in equal regions only or in several
    twice = staged(anchors.groupBy("h").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
                   .filter("n > 1").select("h", (F.col("low") != F.col("high")).alias("several")), "twice")
    collect_shuffles(docs.sparkSession)
    places = staged(anchors.join(twice, "h").select("k1", "k2", "h", "d", "s", "c", "several"), "places")
    discard(all_runs, twice)

    distinct = staged(places.filter("several").groupBy("h", "d")
                      .agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "s", "c")).alias("at")), "distinct")
    marks = (distinct.select("at.k1", "at.k2", F.struct("h", "d", "at.s", "at.c").alias("mark"))
             .groupBy("k1", "k2").agg(F.collect_list("mark").alias("marks")))
    contents = staged(texts.join(marks, ["k1", "k2"]).select("text", "marks")
                      .mapInArrow(_contents, "h long, d long, content binary"), "contents")
    collect_shuffles(docs.sparkSession)
    shards = staged(distinct.groupBy("h").agg(F.ceil(F.count("*") / REGIONS).cast("int").alias("shards")), "shards", slim=True)
    ddl = "h long, d long, spans array<int>"
    # an anchor of one shard stays where the join has put it; those of several are dealt by pairs of shards
    one = (contents.join(shards.filter("shards = 1"), "h")
           .select("h", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(True).alias("left"), "d", "content")
           .repartition("h").sortWithinPartitions("h").mapInArrow(_shards, ddl))
    found = one
    if shards.filter("shards > 1").limit(1).count():
        more = (contents.join(shards.filter("shards > 1"), "h").withColumn("me", F.pmod(F.xxhash64("d"), F.col("shards")).cast("int"))
                .withColumn("other", F.explode(F.expr("sequence(0, shards - 1)")))
                .select("h", F.least("me", "other").alias("x"), F.greatest("me", "other").alias("y"),
                        (F.col("me") <= F.col("other")).alias("left"), "d", "content")
                .repartition("h", "x", "y").sortWithinPartitions("h", "x", "y").mapInArrow(_shards, ddl))
        found = one.union(more)
    whole = distinct.filter("n > 1").select("h", "d", F.array(F.lit(0), F.col("at.c")).alias("spans"))
    # a region that occurs twice repeats as a whole; what was found in it then says no more
    spans = staged(whole.union(found.join(whole.select("h", "d"), ["h", "d"], "left_anti")), "spans")
    discard(distinct, contents, shards)
    alone = places.filter("NOT several").select("k1", "k2", F.array(F.col("s"), F.col("s") + F.col("c")).alias("spans"))
    starts = (places.filter("several").join(spans, ["h", "d"])
              .select("k1", "k2", F.transform("spans", lambda x: x + F.col("s")).alias("spans")).union(alone)
              .groupBy("k1", "k2").agg(F.collect_set("spans").alias("starts")))
    starts = staged(starts, "starts")
    discard(places, spans)
    return base, texts, starts


def covered(n: int, starts: list[list[int]]) -> np.ndarray:
    """Whether each of ``n`` bytes is covered by a string from one of the starts."""
    edge = np.zeros(n + 1, np.int32)
    for spans in starts:
        for a, z in zip(spans[::2], spans[1::2]):
            edge[a] += 1
            edge[z - 1 + LENGTH] -= 1
    return np.cumsum(edge[:n]) > 0


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(all rows; k1, k2, kept (binary), n_removed, n_spans of those that lose bytes)."""
    base, texts, starts = marked_starts(docs, id_col, text_col)

    def run(batches):
        for b in sliced(batches):
            kept, removed, spans = [], [], []
            for t, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                raw = np.frombuffer(t.encode(), np.uint8)
                gone = covered(len(raw), s)
                kept.append(raw[~gone].tobytes())
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(np.append(0, gone.astype(np.int8))) == 1).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()),
                                              pa.array(spans, pa.int64())], names=["k1", "k2", "kept", "n_removed", "n_spans"])
    out = (texts.join(starts, ["k1", "k2"]).select("k1", "k2", "text", "starts")
           .mapInArrow(run, "k1 long, k2 long, kept binary, n_removed long, n_spans long"))
    return base, out


@releasing
def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    base, out = cleaned(docs, id_col, text_col)
    out = out.select("k1", "k2", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return (base.join(out, ["k1", "k2"], "left")
            .select(F.col("id").alias(id_col), "n_bytes", zero("n_removed"), zero("n_spans"),
                    F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256")))


@releasing
def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with the repeated bytes taken out of the texts (and ``size_col``, if there, counted anew): the pipeline's form.

    A character cut in two by a removal goes as a whole.
    """
    _, out = cleaned(docs, id_col, text_col)

    def decode(batches):
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.decode("utf-8", "ignore") for x in b.column(2).to_pylist()], pa.string())],
                                             names=["k1", "k2", "kept"])
    out = out.select("k1", "k2", "kept").mapInArrow(decode, "k1 long, k2 long, kept string")
    text = F.coalesce(docs[text_col], F.lit(""))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(text).alias("k1"),
                        F.xxhash64(F.coalesce(docs[id_col].cast("string"), F.lit("null")), F.length(text)).alias("k2"))
    joined = keyed.join(out, ["k1", "k2"], "left")
    old = lambda c: F.col("row").getField(c)
    new = {text_col: F.coalesce("kept", old(text_col))}
    if size_col in docs.columns:
        new[size_col] = F.when(F.col("kept").isNotNull(), F.length("kept").cast("long")).otherwise(old(size_col))
    return joined.select(*[new.get(c, old(c)).alias(c) for c in docs.columns])
