"""Fill-in-the-middle transformation by repeated-capture matching.

One ``fullmatch`` of ``(unit)*`` over a whole text keeps the end of every repetition of its group, so ``match.ends(1)`` gives both
the number of units and the two places of the cuts, with no loop over units.  The quantifiers are possessive: a unit is
never given back, so the match is linear in the text.

A text is cut at two unit borders drawn from a hash of its identifier into prefix, middle and suffix, which are put into
an order that lets a model learn to fill the middle: ``psm`` is prefix, suffix, middle and ``spm`` suffix, prefix, middle, each part
behind its mark.  A text stays ``plain`` if it is empty, holds a mark, or its draw says so.

Defined results: null text counts as empty (no units, plain); a null identifier draws as an empty one; repeated rows
are each returned, equal ones alike; texts of any length are read whole; an empty table gives an empty table; extra columns are
ignored.  Marks may not overlap one another or themselves, so that the output can be taken apart again.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternlens.llm.common import own

LINES = r"[^\n]*+\n|[^\n]++"
MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 7, 100, 50


def draws(seed: int, identifier) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for an identifier."""
    name = "" if identifier is None else str(identifier)
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return tuple(int(digest[k:k + 8], 16) for k in (0, 8, 16, 24))


class FillMiddle:
    """Transforms single texts; ``rate`` of 100 are transformed, ``spm`` of 100 of these with the suffix first."""

    def __init__(self, seed: int = SEED, rate: int = RATE, spm: int = SPM, unit: str = LINES, marks: tuple[str, str, str] = MARKS):
        self.seed, self.rate, self.spm, self.marks = seed, rate, spm, marks
        self.fullmatch = regex.compile(f"({unit})*+").fullmatch

    def __call__(self, identifier, text: str | None) -> tuple[int, str, int | None, int | None, str]:
        """Units, form, characters of the prefix and of the middle (None if plain), output."""
        text = text or ""
        match = self.fullmatch(text)
        if match is None:
            raise ValueError("units must cover every text")
        ends = match.ends(1)
        n = len(ends)
        h1, h2, h3, h4 = draws(self.seed, identifier)
        if not text or h3 % 100 >= self.rate or any(m in text for m in self.marks):
            return n, "plain", None, None, text
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        a = ends[first - 1] if first else 0
        b = ends[second - 1] if second else 0
        p, s, m = self.marks
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < self.spm:
            return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
        return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, unit: str = LINES,
                marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output for every row of ``docs``."""
    def run(batches):
        transform = FillMiddle(seed, rate, spm, unit, marks)
        for b in batches:
            rows = [transform(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            n, form, prefix, middle, output = ([r[k] for r in rows] for k in range(5))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])
    kind = docs.schema[id_col].dataType.simpleString()
    return own(docs, id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from its transformed form: the parts between the marks, in their old order."""
    def part(after: str, before: str | None = None) -> Column:
        tail = F.substring_index(output, after, -1)
        return F.substring_index(tail, before, 1) if before else tail
    p, s, m = marks
    return (F.when(form == "psm", F.concat(part(p, s), part(m), part(s, m)))
            .when(form == "spm", F.concat(part(p, m), part(m), part(s, p)))
            .otherwise(output))


def fill_digests(found: DataFrame, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id") -> DataFrame:
    """The columns of ``fill_middle`` with SHA-256 of the output and of the text restored from it."""
    return found.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                        F.sha2(restored(F.col("output"), F.col("form"), marks), 256).alias("restored_sha256"))
