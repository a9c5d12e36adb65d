"""Near-duplicate documents by DartMinHash signatures and banded joining.

A text is the multiset of its shingles of ``WORDS`` words (letters and digits, lower case); the similarity of
two texts is the weighted Jaccard similarity of these multisets.  A shingle that occurs ``w`` times is an
element of weight ``w``: a region of ``w`` unit cells.

Signature.  Hashed darts are thrown into each cell: their times form a Poisson process of rate
``COORDINATES``, cut into time blocks [0, e), [e, 2e), [2e, 4e), ..., so that equal cells have equal darts
in every text, and each dart falls on one coordinate.  Of each coordinate the earliest dart stays.  A text of weight
``W`` needs the blocks up to about ln(COORDINATES) / W only, so the number of darts hardly depends on
the text's length; if a coordinate is still empty, that text throws the next block.  Two texts agree in a
coordinate with the probability of their similarity.

Joining.  ``BANDS`` bands of ``ROWS`` coordinates are joined on their hash: a pair at similarity 0.8 shares no
band with probability 5e-6, and ten bands on average.  Texts with equal multisets are first put together, and one
represents them.  What is wanted is the components:

* each text is compared with a hub, the smallest identifier of its buckets (found per salted part of a bucket, so
  that no bucket is gathered whole), and the links make first components;
* then every pair of texts that share a band and are in different components is compared.  Buckets of up to ``SMALL``
  texts give their pairs; larger ones are cut into blocks, each block meets each other one in a task of its own, and
  pairs are compared by matrix products, each in the first of its common bands.

So a link is missed only by texts that share no band.  The work grows with the pairs between different components
that share a band; pairs within a component cost nothing.  Every link is verified exactly, on the cells of both texts.

Defined results: a text with fewer than ``WORDS`` words has one shingle, all its words; null texts and texts without a word
are alone, each its own class; repeated rows are each returned, in one class; a class is named by its smallest
identifier; empty tables give an empty table; extra columns are ignored; an
identifier is taken to name one text (of several, one stands for it in the comparison).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ternlens.llm.bpe_automaton import _Table
from ternlens.llm.common import one_each, own, releasing, row_keys, rows_among, staged, with_row
from ternlens.llm.components import merged

WORDS = 5
SIMILARITY = 0.8
ROWS, BANDS = 6, 40
COORDINATES = ROWS * BANDS
#: Ends of the time blocks: doubling from 2^-14 to 1, then one by one.
EDGES = np.array([2.0 ** k for k in range(-14, 1)] + [float(k) for k in range(2, 17)])
BLOCKS = len(EDGES)
SALTS = 16
#: Texts of a bucket that is compared pair by pair; texts and cells of a block of a larger bucket (about); columns of a product.
SMALL, BLOCK, BLOCK_CELLS, COLUMNS = 16, 128, 4_000_000, 8192
_WORD = re.compile(r"\w+")
_MASK = np.uint64(0xFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(WORDS)]


def cells(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted hashes of the unit cells of a text's weighted shingles."""
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(len(w) - WORDS + 1, 1)
    s = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(w))):
        s += w[k:k + n] * _POWERS[k]
    s = np.sort(_mix(s))
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return s
    at = np.arange(n)
    nth = at - np.maximum.accumulate(np.where(new, at, 0))  # of equal shingles, the 0th, 1st, ...
    return np.sort(np.where(nth > 0, _mix(s + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), s))


def _block(j: int) -> tuple[float, float]:
    """Start and length of a time block."""
    start = float(EDGES[j - 1]) if j else 0.0
    return start, float(EDGES[j]) - start


def _poisson_cdf(rate: float) -> np.ndarray:
    p = [np.exp(-rate)]
    while len(p) < rate or p[-1] > 1e-17:
        p.append(p[-1] * rate / len(p))
    return np.cumsum(p)


_CDF = [_poisson_cdf(COORDINATES * _block(j)[1]) for j in range(BLOCKS)]
_END = float(EDGES[-1])


def _throw(cell: np.ndarray, owner: np.ndarray, j: int, signature: np.ndarray) -> None:
    """Block ``j``'s darts of the cells; the earliest of each text and coordinate stays in ``signature``."""
    start, length = _block(j)
    h = _mix(cell + np.uint64((j + 1) * 0xA0761D6478BD642F & (2**64 - 1)))
    n = np.searchsorted(_CDF[j], (h >> np.uint64(11)).astype(float) * 2.0 ** -53, side="right")
    hit = np.nonzero(n)[0]
    n = n[hit]
    first = np.cumsum(n) - n
    which = np.repeat(hit, n)
    nth = np.arange(len(which)) - np.repeat(first, n)
    g = _mix(h[which] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB))
    coordinate = ((g >> np.uint64(32)) * np.uint64(COORDINATES)) >> np.uint64(32)
    g2 = _mix(g)
    time = start + length * ((g2 >> np.uint64(32)).astype(float) * 2.0 ** -32)
    packed = ((time * (2.0 ** 32 / _END)).astype(np.uint64) << np.uint64(32)) | (g2 & _MASK)
    np.minimum.at(signature, owner[which].astype(np.int64) * COORDINATES + coordinate.astype(np.int64), packed)


def signatures(parts: list[np.ndarray]) -> np.ndarray:
    """One row of COORDINATES values (32 bits) for each set of cells; sets without cells have a row of zeros."""
    empty = np.uint64(2**64 - 1)
    out = np.full((len(parts), COORDINATES), empty, np.uint64)
    flat = out.reshape(-1)
    size = np.array([len(p) for p in parts])
    need = np.searchsorted(EDGES, (np.log(COORDINATES) + 4) / np.maximum(size, 1)) + 1
    need = np.minimum(need, BLOCKS)
    done = np.where(size > 0, 0, BLOCKS)
    while (done < need).any():
        live = np.nonzero(done < need)[0]
        cell = np.concatenate([parts[k] for k in live])
        owner = np.repeat(live, size[live])
        for j in range(int(done[live].min()), int(need[live].max())):
            here = (done[owner] <= j) & (j < need[owner])
            if here.any():
                _throw(cell[here], owner[here], j, flat)
        done[live] = need[live]
        short = live[(out[live] == empty).any(axis=1)]
        need[short] = np.minimum(need[short] + 1, BLOCKS)
    out &= _MASK
    out[size == 0] = 0
    return out


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, same (two hashes of the multiset), n, cells array<int> (32 bits, sorted), bands array<long>."""
    def run(batches):
        hashes = _Table(xxhash.xxh64_intdigest)
        for b in batches:
            texts, ids = b.column(1).to_pylist(), b.column(0)
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars < 4_000_000):
                    chars += len(texts[hi] or "")
                    hi += 1
                parts = [cells(t, hashes) for t in texts[lo:hi]]
                sig = signatures(parts).reshape(len(parts), BANDS, ROWS)
                band = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3), (len(parts), 1))
                for k in range(ROWS):
                    band = _mix(band + sig[:, :, k])
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, hi - lo),
                    pa.array([int(p.sum().view(np.int64)) if len(p) else 0 for p in parts], pa.int64()),
                    pa.array([int(np.bitwise_xor.reduce(_mix(p)).view(np.int64)) if len(p) else 0 for p in parts], pa.int64()),
                    pa.array([len(p) for p in parts], pa.int32()),
                    pa.array([np.sort((p >> np.uint64(32)).astype(np.uint32)).view(np.int32) for p in parts], pa.list_(pa.int32())),
                    pa.array(list(band.view(np.int64)), pa.list_(pa.int64()))],
                    names=["id", "same1", "same2", "n", "cells", "bands"])
                lo = hi
    kind = docs.schema[id_col].dataType.simpleString()
    return own(docs, id_col, text_col).mapInArrow(
        run, f"id {kind}, same1 long, same2 long, n int, cells array<int>, bands array<long>")


def _verified(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose weighted Jaccard similarity is high enough.

    The cells of equal shingles carry equal hashes, so the multisets' intersection is the one of the cells.
    """
    one = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("cells").alias("ca"))
    two = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("cells").alias("cb"))
    both = F.size(F.array_intersect("ca", "cb"))
    return (pairs.join(one, "a").join(two, "b")
            .filter(both >= F.lit(similarity) * (F.col("na") + F.col("nb") - both) - 1e-9).select("a", "b"))


def _pair(x: str, y: str) -> list:
    return [F.least(F.col(x), F.col(y)).alias("a"), F.greatest(F.col(x), F.col(y)).alias("b")]


def _close(x: str, y: str, similarity: float):
    return F.least(F.col(x), F.col(y)) >= similarity * F.greatest(F.col(x), F.col(y))


def links(bands: DataFrame, cells_: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame | None, DataFrame | None]:
    """Verified links (a, b) that join the components of similar texts, and (node, label) of linked nodes.

    ``bands``: rep, n, bands of texts with different multisets; ``cells_``: rep, cells of these and maybe others.
    """
    # Salted parts of each bucket: size and smallest member; then the parts of a bucket, SALTS rows at most.
    salt = F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")
    rows = bands.select("rep", "n", F.explode("bands").alias("key"))
    parts = (rows.groupBy("key", salt.alias("salt"))
             .agg(F.count("*").alias("c"), F.min(F.struct("rep", "n")).alias("hub")))
    bucket = Window.partitionBy("key")
    parts = (parts.select("key", "c", "hub", F.sum("c").over(bucket).alias("size"), F.min("hub").over(bucket).alias("first"))
             .filter("size > 1"))
    parts = staged(parts, "parts", slim=True)
    part_of = Window.partitionBy("key", salt).orderBy("rep").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # members that aren't their part's hub
    others = staged(rows.withColumn("hub", F.first(F.struct("rep", "n")).over(part_of)).filter("rep <> hub.rep")
                    .select("rep", "n", "hub"), "others", slim=True)
    # each goes to a hub (of all its bands the smallest), the parts' hubs to their bucket's
    to_hub = others.filter(_close("n", "hub.n", similarity)).groupBy("rep").agg(F.min("hub.rep").alias("hub"))
    to_first = (parts.filter("hub.rep <> first.rep").filter(_close("hub.n", "first.n", similarity))
                .groupBy(F.col("hub.rep").alias("rep")).agg(F.min("first.rep").alias("hub")))
    pairs = staged(to_hub.union(to_first).select(*_pair("rep", "hub")).distinct(), "pairs", slim=True)

    # texts that share a bucket with another one
    member = others.select("rep").union(parts.select("hub.rep")).distinct()
    live = staged(bands.join(member, "rep"), "live")
    reps = staged(cells_.join(live.select("rep", "n"), "rep").dropDuplicates(["rep"]), "cells")

    found = staged(_verified(pairs, reps, similarity), "verified", slim=True)
    labels = merged(None, found) if found.limit(1).count() else None
    few, many = _between(live, reps, labels, pairs, similarity)
    more = staged(few.union(many), "verified", slim=True)
    if more.limit(1).count():
        found, labels = found.union(more), merged(labels, more)
    return (None, None) if labels is None else (found, labels)


def _between(live: DataFrame, reps: DataFrame, labels: DataFrame | None, tried: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) among all pairs that share a band and are in different components: of small and of large buckets."""
    if labels is not None:
        live = live.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    live = live.withColumn("label", F.coalesce("label", "rep") if labels is not None else F.col("rep"))
    rows = live.select("rep", "n", "label", "bands", F.posexplode("bands").alias("b", "key"))
    weight = F.count("*") / BLOCK + F.sum("n") / BLOCK_CELLS
    each = rows.groupBy("key", "label").agg(F.count("*").alias("c"), weight.alias("w"))
    keys = each.groupBy("key").agg(
        F.count("*").alias("labels"), F.sum("c").alias("size"),
        F.ceil(F.sum(F.when(F.col("w") <= 1, F.col("w")).otherwise(0.0))).cast("int").alias("pool"),
        F.collect_list(F.when(F.col("w") > 1, F.struct("label", F.ceil("w").cast("int").alias("k")))).alias("large"))
    keys = staged(keys.filter("labels > 1"), "keys", slim=True)

    pair = F.expr("filter(flatten(transform(m, x -> transform(m, y -> struct(x, y)))), p -> p.x.rep < p.y.rep AND p.x.label <> p.y.label)")
    small = (rows.join(keys.filter(F.col("size") <= SMALL).select("key"), "key")
             .groupBy("key").agg(F.collect_list(F.struct("rep", "n", "label")).alias("m"))
             .select(F.explode(pair).alias("p")).filter(_close("p.x.n", "p.y.n", similarity))
             .select(F.col("p.x.rep").alias("a"), F.col("p.y.rep").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
    few = _verified(staged(small, "pairs", slim=True), reps, similarity)

    # A large component's members fill blocks (g, k) of their own; those of the others share the blocks (0, k).
    blocks = F.expr("""flatten(concat(
        array(if(pool > 0, transform(sequence(0, greatest(pool, 1) - 1), k -> struct(0 AS g, k AS k)), array())),
        transform(large, (l, i) -> transform(sequence(0, l.k - 1), k -> struct(i + 1 AS g, k AS k)))))""")
    large = (keys.filter(F.col("size") > SMALL).select("key", "pool", "large", blocks.alias("blocks"))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    place = F.expr("""if(array_position(transform(large, l -> l.label), label) = 0,
        struct(0 AS g, CAST(pmod(xxhash64(label), greatest(pool, 1)) AS INT) AS k),
        struct(CAST(array_position(transform(large, l -> l.label), label) AS INT) AS g,
               CAST(pmod(xxhash64(rep, 1), large[CAST(array_position(transform(large, l -> l.label), label) AS INT) - 1].k) AS INT) AS k))""")
    placed = (rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(large, ["key", "salt"])
              .withColumn("me", place).select("rep", "n", "label", "bands", "b", "key", "me", "blocks"))
    # a block of one component needs no comparison within that component
    met = (placed.join(reps.select("rep", "cells"), "rep")
           .withColumn("other", F.explode(F.expr("filter(blocks, o -> o.g = 0 OR o.g <> me.g)")))
           .select("key", "b", F.least("me", "other").alias("x"), F.greatest("me", "other").alias("y"),
                   (F.col("me") <= F.col("other")).alias("left"), "rep", "n", "label", "bands", "cells"))
    kind = live.schema["rep"].dataType.simpleString()
    many = met.groupBy("key", "x", "y").applyInArrow(lambda t: _block_links(t, similarity), f"a {kind}, b {kind}")
    return few, many


def _shared(parts: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``parts[i]`` and ``parts[j]``."""
    one, at_i = np.unique(i, return_inverse=True)
    two, at_j = np.unique(j, return_inverse=True)
    if len(i) * 8 < len(one) * len(two):
        return np.array([len(np.intersect1d(parts[x], parts[y], assume_unique=True)) for x, y in zip(i, j)])
    used = [parts[k] for k in (*one, *two)]
    _, cell, times = np.unique(np.concatenate(used), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(used)), [len(p) for p in used])
    common = times[cell] > 1
    cell, owner = np.unique(cell[common], return_inverse=True)[1], owner[common]
    order = np.argsort(cell, kind="stable")
    cell, owner = cell[order], owner[order]
    out = np.zeros((len(one), len(two)), np.float32)
    for lo in range(0, int(cell[-1]) + 1 if len(cell) else 0, COLUMNS):
        a, b = np.searchsorted(cell, [lo, lo + COLUMNS])
        has = np.zeros((len(used), COLUMNS), np.float32)
        has[owner[a:b], cell[a:b] - lo] = 1
        out += has[:len(one)] @ has[len(one):].T
    return out[at_i, at_j].astype(np.int64)


def _block_links(t: pa.Table, similarity: float) -> pa.Table:
    """Of two blocks of a bucket, the verified links between components: as many as join these components.

    A pair is compared in the first of its common bands only.
    """
    label = np.unique(np.array(t.column("label").to_pylist()), return_inverse=True)[1]
    n, b = t.column("n").to_numpy(), t.column("b")[0].as_py()
    bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    same = t.column("x")[0] == t.column("y")[0]
    one = np.nonzero(t.column("left").to_numpy())[0]
    two = one if same else np.nonzero(~t.column("left").to_numpy())[0]
    untried = (label[one][:, None] != label[two]) & (
        np.minimum(n[one][:, None], n[two]) >= similarity * np.maximum(n[one][:, None], n[two]))
    if same:
        untried &= one[:, None] < two
    for k in range(b):
        untried &= bands[one, k][:, None] != bands[two, k]
    i, j = np.nonzero(untried)
    i, j = one[i], two[j]
    a, c = [], []
    if len(i):
        ids = t.column("rep").to_pylist()
        parts = [np.unique(x.values.to_numpy()) for x in t.column("cells")]
        both = _shared(parts, i, j)
        ok = both >= similarity * (n[i] + n[j] - both) - 1e-9
        parent = list(range(len(label)))

        def top(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x
        for x, y in zip(i[ok], j[ok]):
            p, q = top(label[x]), top(label[y])
            if p != q:
                parent[p] = q
                a.append(min(ids[x], ids[y]))
                c.append(max(ids[x], ids[y]))
    kind = t.schema.field("rep").type
    return pa.table({"a": pa.array(a, kind), "b": pa.array(c, kind)})


@releasing
def near_copies(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, rep_id, kept for every row: the classes of linked near copies.

    ``rep_id`` names the documents with the same multiset of shingles, ``class_id`` the component.
    """
    rows = staged(signed(docs, id_col, text_col), "signed")
    # Rows of one multiset: salted, so that a third of all rows may have it.  Texts without a word stay alone.
    ids = rows.select("id", "n", "same1", "same2", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    wordy = ids.filter("n > 0")
    some = wordy.groupBy("same1", "same2", "salt").agg(F.min("id").alias("least"))
    text = Window.partitionBy("same1", "same2")  # SALTS rows of one multiset at most
    least = some.select("same1", "same2", "salt", F.min("least").over(text).alias("rep_id"))
    member = staged(wordy.join(least, ["same1", "same2", "salt"]).select("id", "rep_id")
                    .union(ids.filter("n = 0").select("id", F.col("id").alias("rep_id"))), "members")
    names = member.filter("id = rep_id").select("id").distinct()
    bands = staged(rows.filter("n > 0").select("id", "n", "bands").join(names, "id").dropDuplicates(["id"])
                   .withColumnRenamed("id", "rep"), "representatives")
    _, labels = links(bands, rows.select(F.col("id").alias("rep"), "cells"), similarity)
    if labels is None:
        return member.select(F.col("id").alias(id_col), F.col("rep_id").alias("class_id"), "rep_id",
                             F.coalesce(F.col("id") == F.col("rep_id"), F.lit(False)).alias("kept"))
    out = (member.join(labels.withColumnRenamed("node", "rep_id"), "rep_id", "left")
           .select(F.col("id").alias(id_col), F.coalesce("label", "rep_id").alias("class_id"), "rep_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("class_id"), F.lit(False)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, by identifier: repeated rows all stay, rows without an identifier go."""
    kept = near_copies(docs, SIMILARITY, id_col, text_col).filter("kept").select(F.col(id_col).alias("__kept"))
    return docs.join(kept, docs[id_col] == F.col("__kept"), "left_semi")


@releasing
def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of each class, also of repeated rows and of rows without an identifier: the pipeline's form."""
    keys = row_keys(docs, id_col, text_col)
    kept = near_copies(with_row(docs, keys, id_col, text_col), SIMILARITY, "row", "text").filter("kept").select("row")
    return one_each(rows_among(docs, keys.join(kept, "row", "left_semi"), id_col, text_col), id_col, text_col)
