"""Byte-pair encoding and decoding by a tokenization automaton.

The automaton is compiled by successive merge gadgets.  Start: one state, one loop for
each byte.  The gadget of merge ``(u, v) -> w``, in rank order, does two things: after
``u`` the arc ``v`` goes away (the merge would have joined them), and wherever ``u v``
could be read, an arc ``w`` appears, whose state continues as ``v``'s.  A token sequence
is a correct encoding exactly if the final automaton reads it, and for every string it
reads exactly one.

Arcs are kept factored, since a full table of 50 257 states by 50 257 labels would be
2.5e9 cells: a state is the chain of pieces at a token's right edge, a label the chain at
its left edge, each piece with the rank of the gadget that uses it up.  Arc ``t`` leaves
state ``s`` unless a gadget joins a piece of ``s`` to a piece of ``t`` while both still
exist.  Cells of the table are filled from the gadgets when first read.

Encoding walks the byte prefixes of a pre-split word: the state after each prefix is
unique, so one table look-up per candidate arc finds it.  Decoding emits the arcs' labels.

Texts are split as the byte-level pattern splits them.  A text is cut at single blanks
between visible characters, where the pattern cuts for sure, so that a chunk is split
and encoded once per task and then looked up; runs of white space are split together with
their neighbours.  The look-up tables are emptied at ``CACHE`` entries, so that memory
is bounded.

Defined results: null text counts as empty (no tokens, empty decoding); repeated rows are
each returned; whole texts of any length; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import cached_property

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ternlens.llm.common import kept, own

CACHE = 350_000
CELLS = 1_000_000
MARKS = ".,;:!?"
NEVER = 1 << 60
#: FIXED VALUE: the byte-level split pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> dict[int, str]:
    """The visible character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class MergeAutomaton:
    """States and labels are token ids; state -1 is the start of a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {s: b for b, s in byte_symbols().items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {s: i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        to_bytes = lambda s: bytes(back[c] for c in s)
        self.label = {i: to_bytes(s) for s, i in vocab.items()}
        self.label |= {i: s.encode() for s, i in self.special.items()}
        self.gadget: dict[tuple[int, int], int] = {}
        self.right: dict[int, tuple] = {}
        self.left: dict[int, tuple] = {}
        self.arc: dict[bytes, int] = {}
        for b, s in byte_symbols().items():
            i = vocab[s]
            self.right[i] = self.left[i] = ((i, NEVER),)
            self.arc[bytes([b])] = i
        for rank, pair in enumerate(spec["model"]["merges"]):
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            self._add_gadget(vocab[u], vocab[v], vocab[u + v], rank)
        # the longest label by its first four bytes: where the search for the next arc starts
        self.reach: dict[bytes, int] = {}
        for label in self.arc:
            if len(label) > 3:
                self.reach[label[:4]] = max(len(label), self.reach.get(label[:4], 0))
        self._cells: dict[int, bool] = {}

    def _add_gadget(self, u: int, v: int, w: int, rank: int) -> None:
        # The new arc appears only where the automaton so far reads u v.
        if (u in self.right and v in self.right and self._reads(u, v)):
            if w not in self.right:
                self.right[w] = ((w, NEVER), (v, rank), *self.right[v][1:])
                self.left[w] = ((w, NEVER), (u, rank), *self.left[u][1:])
                self.arc[self.label[w]] = w
        self.gadget.setdefault((u, v), rank)

    def _reads(self, s: int, t: int) -> bool:
        gadget = self.gadget
        for a, a_end in self.right[s]:
            for b, b_end in self.left[t]:
                m = gadget.get((a, b))
                if m is not None and m < a_end and m <= b_end:
                    return False
        return True

    def cell(self, s: int, t: int) -> bool:
        """Whether arc ``t`` leaves state ``s`` in the compiled automaton."""
        key = s << 20 | t
        got = self._cells.get(key)
        if got is None:
            if len(self._cells) >= CELLS:
                self._cells.clear()
            got = self._cells[key] = self._reads(s, t)
        return got

    @cached_property
    def endings(self):
        """All labels in a matcher that names, for each byte of a word, the labels that end there, the longest first."""
        found = ahocorasick.Automaton()
        for label, t in self.arc.items():
            found.add_word(label.decode("latin-1"), (len(label) - 1, t))
        found.make_automaton()
        return found

    def states(self, word: bytes) -> tuple[list[int], list[int]]:
        """For every byte prefix of ``word``: its last token, and its number of tokens."""
        cells, cell = self._cells.get, self.cell
        last, count, known = [-1], [0], -1
        for end, (before, t) in self.endings.iter(word.decode("latin-1")):
            if end != known:  # the prefix up to here has no token yet
                s = last[end - before]
                if s < 0 or (ok := cells(s << 20 | t)) or (ok is None and cell(s, t)):
                    last.append(t)
                    count.append(count[end - before] + 1)
                    known = end
        return last, count

    def encode(self, word: bytes) -> list[int]:
        """The one path that reads ``word``: longest arc first, back where none goes on.

        A prefix has one correct encoding, so a place that led nowhere never needs another visit.
        """
        arc, cells, cell, reach, n = self.arc.get, self._cells.get, self.cell, self.reach.get, len(word)
        t = arc(word)
        if t is not None:  # the whole word is one arc from the start
            return [t]
        out: list[int] = []
        dead: set[int] = set()
        at, s, end = 0, -1, min(n, reach(word[:4], 3))
        while at < n:
            while end > at:
                t = arc(word[at:end])
                if t is not None and end not in dead and (
                        s < 0 or (ok := cells(s << 20 | t)) or (ok is None and cell(s, t))):
                    break
                end -= 1
            if end > at:
                out.append(t)
                at, s, end = end, t, min(n, end + reach(word[end:end + 4], 3))
            else:
                dead.add(at)
                t = out.pop()
                at, end, s = at - len(self.label[t]), at - 1, out[-1] if out else -1
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.label.__getitem__, ids))


@kept(maxsize=4)
def automaton(path: str) -> MergeAutomaton:
    """Compiled once per Python worker."""
    return MergeAutomaton(path)


class _Blank(Exception):
    """A chunk touches more white space than the single blank before it."""


class _Table(dict):
    """Values made on first use, in two generations of at most ``CACHE`` entries:
    what the last generation didn't use again goes."""

    def __init__(self, make: Callable):
        self.make = make
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[key] = value


class Splitter:
    """Texts as lists of values, one for each chunk.

    ``of_word(word, special)`` gives a pre-split word's value, ``joined(values)`` the
    value of a chunk from its words' values.
    """

    def __init__(self, special: dict[str, int], of_word: Callable, joined: Callable):
        self.split = regex.compile(PATTERN).findall
        self.special = special
        self.marks = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.of_word, self.joined = of_word, joined
        self.words = _Table(lambda w: of_word(w, False))
        self.specials = _Table(lambda w: of_word(w, True))
        self.first = _Table(self._chunk)
        self.later = _Table(self._later)

    def _chunk(self, chunk: str):
        return self.joined(list(map(self._word, self.split(chunk))))

    def _word(self, w: str):
        return self.later[w[1:]] if w[0] == " " and w[1:].isalpha() else self.words[w]

    def _later(self, chunk: str):
        if chunk.isalpha():  # letters only: one pre-split word with its blank
            return self.of_word(" " + chunk, False)
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Blank
        if chunk[-1] in MARKS and chunk[:-1].isalpha():  # a word and a mark behind it
            return self.joined([self.later[chunk[:-1]], self.words[chunk[-1]]])
        words = self.split(" " + chunk)
        if len(words) == 1:
            return self.of_word(words[0], False)
        return self.joined(list(map(self._word, words)))

    def _runs(self, parts: list[str]) -> Iterator[str]:
        """Chunks that meet at more than a single blank, put together again."""
        held = parts[0]
        for p in parts[1:]:
            if held and p and not held[-1].isspace() and not p[0].isspace():
                yield held
                held = p
            else:
                held += " " + p
        yield held

    def values(self, text: str) -> list:
        if self.marks and any(s in text for s in self.special):
            out = []
            for k, piece in enumerate(self.marks.split(text)):
                out += [self.specials[piece]] if k % 2 else self._plain(piece)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list:
        if not text:
            return []
        parts = text.split(" ")
        try:
            if not parts[0] or parts[0][-1].isspace():
                raise _Blank
            return [self.first[parts[0]], *map(self.later.__getitem__, parts[1:])]
        except _Blank:
            out = []
            for k, run in enumerate(self._runs(parts)):
                run = " " + run if k else run
                out.append((self.first[run] if len(run) < 64 else self._chunk(run)))
            return out


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded (text from the arcs' labels): the general interface."""
    def run(batches):
        auto = automaton(path)
        sp = Splitter(auto.special, lambda w, s: [auto.special[w]] if s else auto.encode(w.encode()),
                      lambda vs: [i for v in vs for i in v])
        for b in batches:
            ids = [[i for v in sp.values(t) for i in v] if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.list_(pa.int32())),
                 pa.array([auto.decode(x).decode("utf-8", "replace") for x in ids], pa.string())],
                names=[id_col, "ids", "decoded"])
    kind = docs.schema[id_col].dataType.simpleString()
    return own(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


@kept(maxsize=2)
def digest_splitter(path: str) -> Splitter:
    """Chunks to (number of ids, ids as decimal text, decoded bytes); kept by the Python worker from task to task."""
    auto = automaton(path)

    def of_word(word: str, special: bool) -> tuple:
        ids = [auto.special[word]] if special else auto.encode(word.encode())
        return len(ids), ",".join(map(str, ids)), auto.decode(ids)

    def joined(vs: list) -> tuple:
        return sum([v[0] for v in vs]), ",".join([v[1] for v in vs]), b"".join([v[2] for v in vs])

    return Splitter(auto.special, of_word, joined)


def encoding_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 without moving the ids out of the task.

    Each chunk's ids are kept as their decimal text, its decoding as bytes.
    """
    def run(batches):
        sp = digest_splitter(path)
        sha = hashlib.sha256
        for b in batches:
            n, ids_hash, text_hash = [], [], []
            for t in b.column(1).to_pylist():
                vs = sp.values(t) if t else []
                n.append(sum([v[0] for v in vs]))
                ids_hash.append(sha(",".join([v[1] for v in vs]).encode()).hexdigest())
                raw = b"".join([v[2] for v in vs])
                text_hash.append(sha(raw.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()),
                 pa.array(text_hash, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
    kind = docs.schema[id_col].dataType.simpleString()
    return own(docs, id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
