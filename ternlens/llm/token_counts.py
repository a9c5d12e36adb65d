"""Exact token counts by prefix dynamic programming.

For a pre-split word, ``count[i] = count[j] + 1`` where the one token that can end at byte
``i`` after the correct encoding of the first ``j`` bytes spans ``j..i``.  So the exact
number of tokens of every prefix of the word is stored; a text's table is the running sum
over its words.  Truncation ("how much of the text fits into ``n`` tokens") and budget
questions ("how many tokens have the first ``p`` characters") are answered from the table,
without encoding again.

A prefix that ends inside a word splits as the text itself does, but for three places where
the split looks ahead: the last blank of a run of white space, a contraction cut in two, and
the string of a special token cut in two.  Those prefixes are split anew from the start of the
run, so that the table is exact there too.

Defined results: null text counts as empty (0 tokens); special strings in texts count as one
token, as the library's default has it; repeated rows are each returned; whole texts of any length; extra
columns are ignored; a code point of several bytes is one step of the table.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ternlens.llm.bpe_automaton import MergeAutomaton, Splitter, automaton
from ternlens.llm.common import kept, own

LIMIT = 512


def word_counts(auto: MergeAutomaton, word: str) -> list[int]:
    """The number of tokens of each prefix of ``word``, by code points (1, 2, ... all)."""
    _, count = auto.states(word.encode())
    if word.isascii():
        return count[1:]
    ends = accumulate(len(c.encode()) for c in word)
    return [count[e] for e in ends]


class PrefixCounter:
    """Tables of prefix counts; ``values`` of a text hold one table for each of its chunks."""

    def __init__(self, auto: MergeAutomaton):
        self.auto = auto
        self.sp = Splitter(auto.special, self._of_word, self._joined)
        self.blank = regex.compile(r"\s+").fullmatch

    def _of_word(self, word: str, special: bool) -> tuple[int, ...]:
        return (0,) * (len(word) - 1) + (1,) if special else tuple(word_counts(self.auto, word))

    @staticmethod
    def _joined(parts: list) -> tuple[int, ...]:
        out: list[int] = []
        for p in parts:
            base = out[-1] if out else 0
            out += [base + x for x in p]
        return tuple(out)

    def count(self, text: str) -> int:
        return sum([t[-1] for t in self.sp.values(text)]) if text else 0

    def cut(self, text: str, budget: int) -> int:
        """Code points of ``text`` whose tokens all lie within its first ``budget`` tokens."""
        return self.measured(text, budget)[1]

    def measured(self, text: str, budget: int) -> tuple[int, int]:
        """``count`` and ``cut`` from one pass over the text."""
        tables = self.sp.values(text) if text else []
        n = sum([t[-1] for t in tables])
        if n <= budget:
            return n, len(text)
        total = at = 0
        for t in tables:
            if total + t[-1] > budget:
                return n, at + bisect_right(t, budget - total)
            total += t[-1]
            at += len(t)
        return n, at

    def table(self, text: str) -> list[int]:
        """Tokens of the encoding of every code point prefix of ``text`` (1, 2, ... all)."""
        out: list[int] = []
        total, tail = 0, ""
        pieces = self.sp.marks.split(text) if self.sp.marks else [text]
        for k, piece in enumerate(pieces):
            if k % 2:  # cut in two, the mark is ordinary text that goes on from the last word
                held = total - self._anew(tail)
                out += [held + self._anew(tail + piece[:i]) for i in range(1, len(piece))] + [total + 1]
                total, tail = total + 1, ""
                continue
            before, tail = "", ""
            for w in self.sp.split(piece):
                counts = word_counts(self.auto, w)
                whole = counts[-1]
                if w[0] == "'" and len(w) in (2, 3) and w[1].isalpha():
                    counts[:-1] = [self._anew(w[:i]) for i in range(1, len(w))]
                if before and self.blank(before) and self.blank(w[0]):
                    # the run of white space as it stands if the text ends here
                    counts[0] = self._anew(before + w[0]) - self._anew(before)
                out += [total + c for c in counts]
                total += whole
                before = tail = w
        return out

    def _anew(self, text: str) -> int:
        return sum(word_counts(self.auto, w)[-1] for w in self.sp.split(text))


@kept(maxsize=2)
def counter_for(path: str) -> PrefixCounter:
    """Kept by the Python worker from task to task."""
    return PrefixCounter(automaton(path))


def prefix_tables(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts array<int>: the exact token count of every code point prefix of the text."""
    def run(batches):
        counter = counter_for(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([counter.table(t) if t else [] for t in b.column(1).to_pylist()],
                                       pa.list_(pa.int32()))], names=[id_col, "counts"])
    kind = docs.schema[id_col].dataType.simpleString()
    return own(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, counts array<int>")


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and ``cut_chars``: where a text over the limit is to be cut."""
    def run(batches):
        counter = counter_for(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n, cut = zip(*[counter.measured(t, limit) for t in texts]) if texts else ((), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_()),
                 pa.array(cut, pa.int64())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit", "cut_chars"])
    kind = docs.schema[id_col].dataType.simpleString()
    return own(docs, id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")
