"""Language identification by interpolated Kneser-Ney character models.

A text is read as its letters in lower case, every run of other characters as one blank,
with a start mark before it.  For each language the ``ORDER``-gram counts of all its training
texts are summed by Spark, and from them come the model's probabilities:

    p(w | c) = max(n(c w) - D, 0) / n(c) + D * types(c) / n(c) * p(w | shorter c)

with raw counts at the highest order, continuation counts (numbers of distinct symbols before)
below it, and a uniform share at the end; each order's discount is ``n1 / (n1 + 2 n2)``.
All orders are stored in arrays sorted by a hash of the packed n-gram (an odd multiplier,
so no two n-grams share one), found through a directory of the hash's first bits.
A text's language is that of lowest cross-entropy per symbol.

No n-gram is left out: counts, continuation counts and discounts are made by Spark over all of them.  Orders 3 and 4 are cut into
shards by their inner two symbols, which an n-gram, its context and its shorter forms share (orders 1 and 2, pairs of symbols
at most, are in every shard).  So a shard alone gives the probability of each n-gram that falls into it, and has about
``SHARD_GRAMS`` n-grams: that bounds what the driver and a broadcast hold.  The texts are scored shard by shard, and the sums of log
probabilities added up; there are as many passes as the model needs, one for small ones.

Rejection is calibrated on the training texts: a text is rejected when its best cross-entropy lies more
than ``CHANCE`` of the way from the mean of the training texts predicted so to that of symbols
drawn at random, with an allowance that shrinks with the text's length.  So texts with foreign
insertions stay, and text of no learned language goes.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; equal
cross-entropies go to the first language by name; with no training rows every text is
``und``; null languages take no part in training; repeated rows are each returned; empty tables give
an empty table; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternlens.llm.common import crc_mod, discard, let_go, own, releasing, rows_among, sliced, staged, text_hash

FOLDS, HELD_OUT = 4, 2
ORDER = 4
#: N-grams of order 3 and 4 in a shard of the model, about.
SHARD_GRAMS = 2_000_000
CHANCE = 0.6
#: Allowance for a text of one symbol, in nats; it falls with the root of the length.
ALLOWANCE = 6.0
#: Symbols after which the confidence doesn't grow further.
CONFIDENT = 50
BLANK, START = 32, 1
SLICE = 1 << 20
#: Characters of texts that a task holds before it counts their n-grams.
HELD_CHARS = 8 * SLICE
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Symbol of each code point: a letter's own (beyond 16 bits: folded into the private area), else a blank."""
    out = np.full(0x110000, BLANK, np.uint16)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    out[letters] = np.where(letters < 0x10000, letters, 0xE000 + letters % 6400)
    return out


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each with ORDER - 1 start marks before it; and each symbol's text."""
    parts = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), "<u4") for t in texts]
    table = _symbols()
    pad = np.full(ORDER - 1, START, np.uint16)
    flat = np.concatenate([x for p in parts for x in (pad, table[p])]) if parts else pad[:0]
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) + ORDER - 1 for p in parts])
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != BLANK) | (flat[:-1] != BLANK)
    # a text that ends in a blank says no more than one that doesn't
    return flat[keep], owner[keep]


def packed(flat: np.ndarray, order: int) -> np.ndarray:
    """The ``order`` symbols that end at each place, 16 bits each (places before: start marks)."""
    key = flat.astype(np.uint64)
    out = key.copy()
    for j in range(1, order):
        out[j:] |= key[:-j] << np.uint64(16 * j)
        out[:j] |= np.uint64(START) << np.uint64(16 * j)
    return out


def groups_of(texts: list[str]) -> Iterator[list[str]]:
    """Texts in groups of bounded length, but for one long text: bounds the arrays made of them."""
    group, chars = [], 0
    for t in texts:
        if group and chars + len(t) > 2 * SLICE:
            yield group
            group, chars = [], 0
        group.append(t)
        chars += len(t)
    if group:
        yield group


def gram_counts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang, gram (packed), n over all rows."""
    def counted(held):
        for lang, texts in held.items():
            for group in groups_of(texts):
                flat, _ = symbols(group)
                keys, n = np.unique(packed(flat, ORDER)[flat != START], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())],
                    names=["lang", "gram", "n"])

    def run(batches):
        let_go()
        held: dict[str, list[str]] = {}
        chars = 0
        for b in sliced(batches):
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    held.setdefault(lang, []).append(t)
                    chars += len(t)
            if chars > HELD_CHARS:
                yield from counted(held)
                held, chars = {}, 0
        yield from counted(held)
    parts = own(docs, lang_col, text_col).mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def shard_of(gram, shards: int):
    """Shard of an n-gram of order 3 or 4 (a column, or numbers): by its inner two symbols."""
    if isinstance(gram, Column):
        inner = F.shiftright(gram, 16).bitwiseAND(0xFFFFFFFF)
        return (inner % 1_000_003 % shards).cast("int")
    return (gram >> np.uint64(16) & np.uint64(0xFFFFFFFF)) % np.uint64(1_000_003) % np.uint64(shards)


def levels(counts: DataFrame) -> DataFrame:
    """lang, order, gram, n of all orders: raw counts at the highest, numbers of different symbols before it below."""
    out = [counts.select("lang", F.lit(ORDER).alias("order"), "gram", "n")]
    for order in range(ORDER - 1, 0, -1):
        short = F.col("gram").bitwiseAND((1 << 16 * order) - 1)
        out.append(out[-1].groupBy("lang", short.alias("gram")).agg(F.count("*").alias("n"))
                   .select("lang", F.lit(order).alias("order"), "gram", "n"))
    return functools.reduce(DataFrame.union, out)


def discount(ones: int, twos: int) -> float:
    return float(ones / (ones + 2 * twos)) if ones and twos else 0.5


class HashArray:
    """Rows of values by packed n-gram, sorted by hash, with a directory of the first bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: float):
        hashed = keys.astype(np.uint64) * _MIX
        order = np.argsort(hashed)
        self.hashed = hashed[order]
        self.values = np.vstack([values[order], np.full((1, values.shape[1]), missing)]).astype(np.float32)
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.hashed >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)
        self.steps = int(np.bincount((self.hashed >> self.shift).astype(np.int64)).max()) if len(keys) else 0
        self.hashed = np.append(self.hashed, np.uint64(2**64 - 1))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key; the last row (``missing``) for those that aren't there."""
        h = keys * _MIX
        at = self.start[(h >> self.shift).astype(np.int64)]
        last = len(self.hashed) - 1
        for _ in range(self.steps):
            at += (self.hashed[at] < h) & (at < last)
        return np.where(self.hashed[at] == h, at, last)


class CharacterModels:
    """One interpolated Kneser-Ney model for each language (or a shard of it), in shared hash arrays.

    ``grams``: lang, order, gram, n; ``discounts`` by language and order, over all shards.
    """

    def __init__(self, grams: pd.DataFrame, discounts: dict[tuple[str, int], float], shard: int = 0, shards: int = 1):
        self.shard, self.shards = shard, shards
        self.langs = sorted({lang for lang, _ in discounts})
        size = len(self.langs)
        probs: list[list] = [[] for _ in range(ORDER + 1)]  # by order: (language, grams, p)
        rests: list[list] = [[] for _ in range(ORDER)]  # by context length: (language, contexts, share of the shorter one)
        for k, lang in enumerate(self.langs):
            own_rows = grams[grams["lang"] == lang]
            levels = {}
            for order in range(1, ORDER + 1):
                rows = own_rows[own_rows["order"] == order].sort_values("gram")
                levels[order] = (rows["gram"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(float))
            below = None
            for order in range(1, ORDER + 1):
                g, c = levels[order]
                d = discounts[lang, order]
                context = g >> np.uint64(16)
                ctx, where, types = np.unique(context, return_inverse=True, return_counts=True)
                total = np.bincount(where, weights=c)
                rest = d * types / total
                if order == 1:
                    p_low = np.full(len(g), 1.0 / (len(g) + 1))
                else:
                    low_g, low_p = below
                    p_low = low_p[np.searchsorted(low_g, g & np.uint64((1 << 16 * (order - 1)) - 1))]
                p = np.maximum(c - d, 0) / total[where] + rest[where] * p_low
                o = np.argsort(g)
                below = (g[o], p[o])
                probs[order].append((k, *below))
                rests[order - 1].append((k, ctx, rest))
                if order == 1:
                    probs[0].append((k, np.zeros(1, np.uint64), np.array([1.0 / (len(g) + 1)])))
        uniform = np.zeros(size)
        for k, _, p in probs[0]:
            uniform[k] = p[0]
        self.uniform = np.log(uniform)
        # every order's table holds, for every n-gram of any language, the log probability in all languages
        self.rest, self.prob = [], []
        for parts in rests:
            self.rest.append(self._table(parts, size, lambda keys: np.zeros((len(keys), size)), 0.0))
        for order in range(1, ORDER + 1):
            self.prob.append(self._table(probs[order], size, lambda keys, order=order: self._back_off(keys, order), np.nan))

    @staticmethod
    def _table(parts: list, size: int, default, missing: float) -> HashArray:
        keys = np.unique(np.concatenate([p[1] for p in parts]))
        values = default(keys)
        for k, own_keys, p in parts:
            values[np.searchsorted(keys, own_keys), k] = np.log(p)
        return HashArray(keys, values, missing)

    def _back_off(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Log probabilities of n-grams by the next lower order and the context's rest."""
        rest = self.rest[order - 1]
        out = rest.values[rest.find(keys >> np.uint64(16))].astype(float)
        if order == 1:
            return out + self.uniform
        return out + self.log_prob(keys & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)

    def log_prob(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Rows of log probabilities by language."""
        table = self.prob[order - 1]
        at = table.find(keys)
        out = table.values[at]
        missed = np.nonzero(at == len(table.hashed) - 1)[0]
        if len(missed):
            out[missed] = self._back_off(keys[missed], order)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol by text and language, and each text's number of symbols."""
        total, n = self.sums(texts)
        return -total / np.maximum(n, 1)[:, None], n

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability by text and language, and the number of symbols, of the n-grams in this shard."""
        n = np.zeros(len(texts))
        total = np.zeros((len(texts), len(self.langs)))
        flat, owner = symbols(texts)
        for lo in range(0, len(flat), SLICE):
            before = max(0, lo - ORDER + 1)
            part = flat[before:lo + SLICE]
            keys = packed(part, ORDER)[lo - before:]
            own_part, mine = part[lo - before:] != START, owner[lo:lo + SLICE]
            keys, mine = keys[own_part], mine[own_part]
            if self.shards > 1:
                here = shard_of(keys, self.shards) == self.shard
                keys, mine = keys[here], mine[here]
            if len(keys):
                logs = self.log_prob(keys)
                n += np.bincount(mine, minlength=len(texts))
                for k in range(len(self.langs)):
                    total[:, k] += np.bincount(mine, weights=logs[:, k], minlength=len(texts))
        return total, n


class Trained:
    """The staged n-gram table, its discounts and the number of shards; ``models`` loads them one by one."""

    def __init__(self, grams: DataFrame):
        self.grams = grams
        some = grams.groupBy("lang", "order").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"),
                                                  F.count("*").alias("types")).collect()  # a row for each language and order
        self.discounts = {(r.lang, r.order): discount(r.ones, r.twos) for r in some}
        self.langs = sorted({r.lang for r in some})
        #: log of the uniform share at the end of the back-off, by language
        self.uniform = {r.lang: -math.log(r.types + 1) for r in some if r.order == 1}
        self.shards = max(1, -(-sum(r.types for r in some if r.order > 2) // SHARD_GRAMS))

    def models(self) -> Iterator[CharacterModels]:
        for shard in range(self.shards if self.langs else 0):
            here = (F.col("order") < 3) | (shard_of(F.col("gram"), self.shards) == shard)
            yield CharacterModels(self.grams.filter(here).toPandas(), self.discounts, shard, self.shards)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Trained:
    """Models of all rows with a text and a language."""
    counts = staged(gram_counts(docs.filter(docs[lang_col].isNotNull() & docs[text_col].isNotNull()), lang_col, text_col), "counts")
    out = Trained(staged(levels(counts), "grams"))
    discard(counts)
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def identify(docs: DataFrame, trained: Trained, id_col: str = "doc_id", text_col: str = "text", sha: bool = False) -> DataFrame:
    """id, lang_pred, score, cross_entropy, symbols (and, if asked for, sha: the text's hash) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    langs = trained.langs
    rows = own(docs, id_col, text_col)
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_hash(F.col(text_col) if sha else F.lit(None)).alias("sha"))

    def scored(shared):
        def run(batches):
            let_go()
            models = shared.value
            for b in sliced(batches):
                texts = [t or "" for t in b.column(1).to_pylist()]
                done = [models.sums(group) for group in groups_of(texts)]
                total = np.concatenate([t for t, _ in done]) if done else np.zeros((0, len(langs)))
                n = np.concatenate([k for _, k in done]) if done else np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [*(c for k, c in enumerate(b.columns) if k != 1), pa.array(n.astype(np.int64)), pa.array(map(has_letter, texts), pa.bool_()),
                     pa.array(list(total), pa.list_(pa.float64()))],
                    names=[*(c for c in b.schema.names if c != "text"), "n", "letter", "logs"])
        return run

    def decided(batches):
        """Rows (id, sha, n, letter, logs) to the result."""
        for b in batches:
            n, letter = b.column(2).to_numpy(), b.column(3).to_pylist()
            logs = b.column(4).flatten().to_numpy().reshape(len(n), -1) if len(n) else np.zeros((0, len(langs)))
            h = -logs / np.maximum(n, 1)[:, None]
            sure = 1 / np.exp(-(h - h.min(axis=1, keepdims=True)) * np.minimum(n, CONFIDENT)[:, None]).sum(axis=1)
            known = [bool(x) and k > 0 for x, k in zip(letter, n)]
            best = h.argmin(axis=1) if len(n) else []
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([langs[k] if y else "und" for k, y in zip(best, known)], pa.string()),
                 pa.array([float(s) if y else 0.0 for s, y in zip(sure, known)], pa.float64()),
                 pa.array([float(r[k]) if y else None for r, k, y in zip(h, best, known)], pa.float64()),
                 b.column(2), b.column(1)], names=["id", "lang_pred", "score", "cross_entropy", "symbols", "sha"])
    sc, columns = docs.sparkSession.sparkContext, "n long, letter boolean, logs array<double>"
    result = f"id {kind}, lang_pred string, score double, cross_entropy double, symbols long, sha binary"
    if not langs:
        out = rows.select("id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"),
                          F.lit(0).cast("long").alias("symbols"), "sha")
    elif trained.shards == 1:
        sums = scored(sc.broadcast(next(trained.models())))  # both steps in one Python worker
        out = rows.mapInArrow(lambda batches: decided(sums(batches)), result)
    else:
        rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
        passes = []
        for models in trained.models():
            shared = sc.broadcast(models)
            passes.append(staged(rows.select("row", "text").mapInArrow(scored(shared), f"row long, {columns}"), "pass"))
            shared.destroy()
        added = (functools.reduce(DataFrame.union, passes).groupBy("row").agg(
            F.sum("n").alias("n"), F.max("letter").alias("letter"), F.array(*[F.sum(F.col("logs")[k]) for k in range(len(langs))]).alias("logs")))
        logs = rows.select("row", "id", "sha").join(added, "row").select("id", "sha", "n", "letter", "logs")
        out = logs.mapInArrow(decided, result)
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", "cross_entropy", "symbols", *["sha"] * sha)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              sha: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, accepted (and sha) for every row, trained on the rows not held out."""
    rows = own(docs, id_col, text_col, lang_col)
    held_out = crc_mod(id_col, FOLDS) == HELD_OUT
    # a null identifier has no fold: it takes no part in training
    trained = train(rows.filter(~held_out), lang_col, text_col)
    found = staged(identify(rows, trained, id_col, text_col, sha), "languages").withColumn("held_out", held_out)
    usual = F.broadcast(found.filter(~F.col("held_out") & (F.col("lang_pred") != "und")).groupBy("lang_pred").agg(
        F.avg("cross_entropy").alias("mean")))  # a row for each language
    chance = F.create_map(*[F.lit(x) for lang in [*trained.langs, ""] for x in (lang, -trained.uniform.get(lang, 0.0))])
    limit = (F.col("mean") * (1 - CHANCE) + CHANCE * chance[F.col("lang_pred")]
             + ALLOWANCE / F.sqrt(F.greatest("symbols", F.lit(1))))
    return found.join(usual, "lang_pred", "left").select(
        id_col, "held_out", "lang_pred", "score", "cross_entropy",
        ((F.col("lang_pred") != "und") & F.coalesce(F.col("cross_entropy") <= limit, F.lit(True))).alias("accepted"), *["sha"] * sha)


@releasing
def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language is rejected, decided by the row's own text: the pipeline's form of the operator."""
    kept = languages(docs, id_col, text_col, lang_col, sha=True).filter("accepted").select(F.col(id_col).alias("id"), "sha").distinct()
    return rows_among(docs, kept, id_col, text_col)
