"""Best-fit packing by exact-complement hashing.

Every document's tokens (with the end token) are one piece, or pieces of exactly the
capacity if it is longer, the first of which may be shorter.  The packing works on the
counts of pieces by length, at most ``capacity`` rows whatever the corpus' size, so the
plan is made on the driver from a bounded table:

1. For the longest length still available, its gap ``capacity - length`` is looked up in
   the hashed index of single lengths, then of pair sums, then of triple sums; a
   combination that fills the gap exactly is used as many times as the availability counts
   allow.  A combination ends only when one of its lengths runs out, so the number of
   patterns is bounded by the number of lengths too.
2. What has no exact complement is packed by best fit: the largest available length that
   fits, again and again.

The plan is a list of patterns (the lengths in one sequence, and how many such sequences).
Each piece gets a rank within its length without a global sort: ranks within hash buckets
of the identifier plus the running count of the buckets before, so that no length, however
frequent, is ranked in one task.  The rank decides sequence and place.

Defined results: a null or empty text is one piece, the end token alone; repeated rows are
packed each on their own; ties are ranked by identifier and then by the piece's CRC; an empty
table gives an empty table; extra columns are ignored; no piece is dropped.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ternlens.llm.bpe_automaton import Splitter, byte_symbols
from ternlens.llm.common import kept, own, staged
from ternlens.llm.segment_join import word_hashes

CAPACITY = 1024
END = 2
#: Hash buckets in which pieces of one length are ranked; the bucket table has capacity x BUCKETS rows at most.
BUCKETS = 64
#: Chunks that are encoded as one text; characters of the texts that are worked on together; chunks whose ids a task remembers.
TOGETHER, CHARS, ROWS = 1000, 2_000_000, 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class ChunkIds:
    """The ids of chunks, by the chunks' hashes in order; beyond ``ROWS`` chunks, those not used for longest go.

    ``tag`` (length and last bytes) tells apart the chunks of one hash, of which only the first is held.
    """

    def __init__(self):
        self.key, self.tag = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.count, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.turn = np.zeros(0, "<u4"), 0

    def rows(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each key, and whether the table has it."""
        if not len(self.key):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        row = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return row, self.key[row] == key

    def add(self, key: np.ndarray, tag: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """New chunks, in the order of their keys, with all their ids behind each other."""
        at = np.searchsorted(self.key, key)
        start = len(self.pool) + np.cumsum(count) - count
        for name, values in (("key", key), ("tag", tag), ("start", start), ("count", count), ("used", np.full(len(key), self.turn))):
            setattr(self, name, np.insert(getattr(self, name), at, values))
        self.pool = np.concatenate([self.pool, ids])

    def trim(self) -> None:
        self.turn += 1
        if len(self.key) > ROWS:
            keep = self.used > np.median(self.used)
            ids = self.pool[spans(self.start[keep], self.count[keep])]
            for name in ("key", "tag", "count", "used"):
                setattr(self, name, getattr(self, name)[keep])
            self.start, self.pool = np.cumsum(self.count) - self.count, ids


def spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All places of the spans, one behind the other."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


class IdSplitter(Splitter):
    """Texts to their ids as little-endian bytes; new chunks are encoded by the tokenizers library, many at once.

    A chunk's ids don't depend on its neighbours (see ``bpe_automaton``), so they are those in the whole text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task uses its own core only
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.four = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        blank = byte_symbols()[32]
        self.starts = np.array([(self.library.id_to_token(i) or "").startswith(blank) for i in range(len(self.four))])
        self.table = ChunkIds()
        super().__init__(special, lambda word, is_special: self._encode([word])[0], b"".join)

    def _encode(self, texts: list[str]) -> list[bytes]:
        four = self.four.__getitem__
        return [b"".join(map(four, e.ids)) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def blobs(self, texts: list[str]) -> list[bytes]:
        """The ids of each text (not empty); texts with special strings, and those with more white space at a blank, one by one."""
        out: list[bytes | None] = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if not any(s in t for s in self.special)]
        for k, blob in zip(plain, self._together([texts[k] for k in plain]) if plain else []):
            out[k] = blob
        self.learn([t for t, blob in zip(texts, out) if blob is None])
        return [b"".join(self.values(t)) if blob is None else blob for t, blob in zip(texts, out)]

    def learn(self, texts: list[str]) -> None:
        """Encode the chunks of texts that ``values`` is to split, as far as its table doesn't hold them."""
        chunks: set[str] = set()
        for t in texts:
            chunks.update(t.split(" "))
        table = self.later
        new = [c for c in chunks if c and c not in table and c not in table.old and not c[0].isspace() and not c[-1].isspace()
               and not any(s in c for s in self.special)]
        for c, ids in zip(new, self._encoded(new)):
            table.put(c, ids.tobytes())

    def _together(self, texts: list[str]) -> list[bytes | None]:
        """The ids of texts without special strings; None where a chunk behind a blank is empty or other white space touches it."""
        coded = [t.encode() for t in texts]
        raw = b"".join([b" " * 8, b" ".join(coded), b" " * 8])
        blank = np.flatnonzero(np.frombuffer(raw, np.uint8)[7:-7] == 32) + 7
        start, length = blank[:-1] + 1, np.diff(blank) - 1
        size = np.array([len(c) + 1 for c in coded])
        head = np.searchsorted(start, 8 + np.cumsum(size) - size)
        owner = np.repeat(np.arange(len(texts)), np.diff(np.append(head, len(start))))
        heads = [c[:n].decode() for c, n in zip(coded, length[head].tolist())]  # no blank before them
        slow = np.array([not h or h[-1].isspace() for h in heads])
        behind = np.ones(len(start), bool)
        behind[head] = False
        slow[owner[behind & (length == 0)]] = True
        behind &= length > 0
        start, length, owner = start[behind], length[behind], owner[behind]
        # different chunks: hash, and the last eight bytes and the length against collisions
        key = word_hashes(raw, start, length)
        last = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), 8)[start + length - 8].view("<u8").ravel()
        tag = (last >> (8 * (8 - np.minimum(length, 8))).astype(np.uint64)) * _ODD + length.astype(np.uint64)
        order = np.argsort(key)
        first = np.append(True, key[order[1:]] != key[order[:-1]])[:len(order)]
        one, which = order[first], np.empty(len(order), np.int64)
        which[order] = np.cumsum(first) - 1
        slow[owner[tag != tag[one][which]]] = True
        table = self.table
        table.trim()
        row, known = table.rows(key[one])
        if not known.all():
            self._add(raw, one[~known], start, length, key, tag)
            row, known = table.rows(key[one])
        good = known & (table.tag[row] == tag[one]) if len(table.key) else known
        slow[owner[~good[which]]] = True
        table.used[row[good]] = table.turn
        row, here = row[which], good[which]
        count = np.where(here, table.count[row], 0) if len(table.key) else np.zeros(len(row), np.int64)
        ids = table.pool[spans(table.start[row], count)].tobytes() if count.any() else b""
        edge = 4 * np.append(0, np.cumsum(count))[np.searchsorted(owner, np.arange(len(texts) + 1))]
        return [None if s else self.first[h] + ids[a:z] for s, h, a, z in zip(slow.tolist(), heads, edge.tolist(), edge[1:].tolist())]

    def _add(self, raw: bytes, new: np.ndarray, start: np.ndarray, length: np.ndarray, key: np.ndarray, tag: np.ndarray) -> None:
        """The chunks ``new`` (places in ``start``, in the order of their keys) into the table, but for those that white space touches."""
        a = start[new]
        chunks = [raw[x:y].decode() for x, y in zip(a.tolist(), (a + length[new]).tolist())]
        fit = np.array([not (c[0].isspace() or c[-1].isspace()) for c in chunks])
        new, chunks = new[fit], [c for c, f in zip(chunks, fit.tolist()) if f]
        if chunks:
            ids = list(self._encoded(chunks))
            self.table.add(key[new], tag[new], np.array([len(x) for x in ids], np.int64), np.concatenate(ids))

    def _encoded(self, chunks: list[str]) -> Iterator[np.ndarray]:
        """The ids of each chunk behind a blank.

        They are encoded as texts of ``TOGETHER`` chunks: each chunk stands behind a blank and has none inside, so
        the ids of the next chunk start at the next token that starts with a blank.
        """
        for k in range(0, len(chunks), TOGETHER):
            group = chunks[k:k + TOGETHER]
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(group)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.starts[ids]).tolist()
            if len(at) != len(group):
                raise ValueError("a vocabulary without byte-level blanks")
            yield from map(ids.__getitem__, map(slice, at, [*at[1:], len(ids)]))


@kept(maxsize=2)
def id_splitter(path: str) -> IdSplitter:
    """Kept by the Python worker from task to task."""
    return IdSplitter(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ``ids`` if asked for)."""
    def run(batches):
        sp = id_splitter(path)
        last, size = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for b in batches:
            ids, piece, start, length, crc, raw = [], [], [], [], [], []
            texts = b.column(1).to_pylist()
            done = 0
            for at_row, (i, t) in enumerate(zip(b.column(0).to_pylist(), texts)):
                if at_row == done:  # some texts at a time, so that the arrays of their chunks are bounded
                    chars = 0
                    while done < len(texts) and (done == at_row or chars < CHARS):
                        chars += len(texts[done] or "")
                        done += 1
                    blobs = iter(sp.blobs([x for x in texts[at_row:done] if x]))
                blob = next(blobs) + last if t else last
                first = len(blob) % size or size
                for k, (at, to) in enumerate([(0, first), *((x, x + size) for x in range(first, len(blob), size))]):
                    ids.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append((to - at) // 4)
                    crc.append(zlib.crc32(blob[at:to]))
                    if with_ids:
                        raw.append(np.frombuffer(blob[at:to], "<u4").astype("i4"))
            cols = [pa.array(ids, b.column(0).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(raw, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
    kind = docs.schema[id_col].dataType.simpleString()
    return own(docs, id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence, number of such sequences) that use ``counts`` up."""
    have = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        if not 1 <= n <= capacity:
            raise ValueError(f"piece length {n} is not in 1..{capacity}")
        have[n] += c
    out: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...]) -> None:
        each = {n: lengths.count(n) for n in lengths}
        times = min(int(have[n]) // k for n, k in each.items())
        out.append((lengths, times))
        for n, k in each.items():
            have[n] -= k * times

    def enough(lengths: tuple[int, ...]) -> bool:
        return all(have[n] >= lengths.count(n) for n in lengths)

    def pair(total: int, *rest: int) -> tuple[int, ...] | None:
        """Two available lengths of this sum, the most even on availability first."""
        a = np.arange(1, total // 2 + 1)
        if not len(a):
            return None
        found = a[(have[a] > 0) & (have[total - a] > 0)]
        for x in found[np.argsort(-np.minimum(have[found], have[total - found]), kind="stable")]:
            combo = (int(total - x), int(x))
            if enough((*rest, *combo)):
                return combo
        return None

    def complement(n: int) -> tuple[int, ...] | None:
        gap = capacity - n
        if gap == 0:
            return ()
        if have[gap] > 0 and enough((n, gap)):
            return (gap,)
        if combo := pair(gap, n):
            return combo
        lengths = np.nonzero(have[:gap])[0]
        for x in lengths[::-1]:
            x = int(x)
            if gap - x >= 2 and enough((n, x)) and (combo := pair(gap - x, n, x)):
                return (x, *combo)
        return None

    for n in range(capacity, 0, -1):
        while have[n] and (combo := complement(n)) is not None:
            use((n, *combo))
    while (left := np.nonzero(have)[0]).size:  # best fit: the fullest sequence that starts with the longest
        lengths, gap = [int(left[-1])], capacity - int(left[-1])
        have_now = have.copy()
        have_now[lengths[0]] -= 1
        while gap and (fits := np.nonzero(have_now[:gap + 1])[0]).size:
            lengths.append(int(fits[-1]))
            have_now[lengths[-1]] -= 1
            gap -= lengths[-1]
        use(tuple(lengths))
    return out


def packed(parts: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """``parts`` (rows of ``pieces``, read several times) with sequence_id and offset."""
    spark = parts.sparkSession
    keyed = parts.withColumn("__b", F.pmod(F.xxhash64(id_col, "piece"), F.lit(BUCKETS)).cast("int"))
    table = keyed.groupBy("length", "__b").agg(F.count("*").alias("n")).collect()  # capacity x BUCKETS rows at most
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for r in sorted(table, key=lambda r: (r["length"], r["__b"])):
        before[r["length"], r["__b"]] = counts.get(r["length"], 0)
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    # By length: the first rank, the first sequence, the ranks' step and the place of each pattern's slot.
    slots: dict[int, list[tuple[int, int, int]]] = {n: [] for n in counts}
    filled = dict.fromkeys(counts, 0)
    sequence = 0
    for lengths, times in plan(counts, capacity):
        at = 0
        for n in lengths:
            slots[n].append((filled[n], sequence, at))
            filled[n] += times
            at += n
        sequence += times
    starts = {n: [s[0] for s in v] for n, v in slots.items()}
    shared = spark.sparkContext.broadcast((before, slots, starts))

    def place(batches):
        before, slots, starts = shared.value
        for b in batches:
            seq, off = [], []
            for n, k, r in zip(*(b.column(x).to_pylist() for x in ("length", "__b", "__r"))):
                rank = before[n, k] + r - 1
                first, base, at = slots[n][bisect_right(starts[n], rank) - 1]
                seq.append(base + rank - first)
                off.append(at)
            rest = b.select([c for c in b.schema.names if c not in ("__b", "__r")])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
                                             names=[*rest.schema.names, "sequence_id", "offset"])

    order = Window.partitionBy("length", "__b").orderBy(F.col(id_col).asc_nulls_last(), "piece", "ids_crc32")
    ranked = keyed.withColumn("__r", F.row_number().over(order))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with sequence_id and offset; the texts are tokenised once."""
    return packed(staged(pieces(docs, path, capacity, end_id, id_col, text_col, with_ids), "pieces"), capacity, id_col)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, from pieces that carry their ids."""
    return (packed_pieces.groupBy("sequence_id")
            .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # capacity ids at most
            .select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids")))
