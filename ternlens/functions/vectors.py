"""Vector functions: hashed bag-of-words embedding, dot, cosine distance, normalise.

The embedder is the one Arrow Python stage (an iterator Arrow UDF with a per-task
token→bucket cache, which takes a few rows of a batch at a time); everything else is SQL
higher-order functions over ``array<double>``, which stay inside generated code.

Embedding rule: tokens = lower-cased text split on ``[^a-z0-9]+`` (empties
dropped); bucket = first 8 hex digits of md5(token) as an integer, mod ``dim``;
vector = bucket counts divided by their L2 norm (all-zero when no token).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_DIM = 64
_TOKEN_FIND = re.compile(r"[a-z0-9]+").findall
#: Rows of an Arrow batch that are Python objects at a time, and tokens that a task's cache holds.
SLICE_ROWS = 128
CACHED_TOKENS = 200_000
#: Arrow types of a vector and of a list of vectors.
VECTOR, VECTORS = pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64()))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _bucket(tok: str, dim: int) -> int:
    return int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % dim


def embed_text(text: str | None, dim: int, cache: dict) -> np.ndarray:
    """Unit-norm bucket-count vector of one text (all tokens, whole text)."""
    if not text:
        return np.zeros(dim, dtype=np.float64)
    ids = []
    get = cache.get
    for tok in _TOKEN_FIND(text.lower()):
        b = get(tok)
        if b is None:
            b = _bucket(tok, dim)
            if len(cache) < CACHED_TOKENS:
                cache[tok] = b
        ids.append(b)
    if not ids:
        return np.zeros(dim, dtype=np.float64)
    v = np.bincount(np.asarray(ids, dtype=np.int64), minlength=dim).astype(np.float64)
    n = float(np.sqrt(np.dot(v, v)))
    return v / n if n > 0 else v


def slices(*columns: pa.Array) -> Iterator[list[list]]:
    """The columns of a batch as Python lists, ``SLICE_ROWS`` rows at a time: a whole batch never becomes Python objects."""
    for at in range(0, len(columns[0]), SLICE_ROWS):
        yield [c.slice(at, SLICE_ROWS).to_pylist() for c in columns]


def embed(col, dim: int = DEFAULT_DIM) -> Column:
    """V1/V2: unit-norm hashed embedding of a text column (null text → null)."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def _embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict = {}
        for b in batches:
            for (texts,) in slices(b):
                yield pa.array([None if t is None else embed_text(t, dim, cache) for t in texts], VECTOR)

    return _embed(_c(col))


def embed_many(col, dim: int = DEFAULT_DIM) -> Column:
    """V1 over ``array<string>`` (sentences): one vector per element, no explode/regroup."""

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def _embed_many(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict = {}
        for b in batches:
            for (lists,) in slices(b):
                yield pa.array([None if x is None else [embed_text(t, dim, cache) for t in x] for x in lists], VECTORS)

    return _embed_many(_c(col))


def dot(a, b) -> Column:
    """V3: Σ aᵢ·bᵢ (null if either side is null)."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x * x))


def normalize(a) -> Column:
    """V5: divide by the L2 norm when it is > 0."""
    from ternlens.functions.text import let

    def scale(v: Column) -> Column:
        n = norm(v)
        return let(n, lambda k: F.when(k > 0, F.transform(v, lambda x: x / k)).otherwise(v))

    return let(_c(a), scale)


def cosine_distance(a, b) -> Column:
    """V4: 1 − a·b/(‖a‖‖b‖), 1.0 when either norm is 0 (range 0–2)."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / (na * nb))


def round_elements(a, decimals: int = 9) -> Column:
    return F.transform(_c(a), lambda x: F.round(x, decimals))
