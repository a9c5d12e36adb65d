"""Quality by a regularised quadratic discriminant over document statistics.

Each whole text gives ``STATS`` transformed statistics (sizes as logarithms, shares as
smoothed logits).  For each class the count, sum and sum of outer products are gathered in
one pass (sums only, of a fixed size), which give its mean and its covariance; the covariance
is shrunk towards the pooled one and that towards its diagonal, and factorised once
(Cholesky).  The score is the logistic of the difference of the classes' Gaussian log densities
(Mahalanobis distance and log determinant from the cached factors) plus that of the priors.

Training reads a bounded number of labelled rows (``training.MAX_LABELLED``); statistics are computed for
every row once and staged, so no text is moved.

Defined results: null and empty texts have the statistics of an empty text and get a
score; with labels of one class or none the score is the share of label 1 (0.5 without labels); repeated
rows are each returned; empty tables give an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternlens.llm.common import crc_mod, own, staged
from ternlens.llm.training import labelled, training_labels

FOLDS, HELD_OUT = 3, 1
#: Share of the pooled covariance in each class' own, and of the diagonal in the pooled one.
TO_POOLED, TO_DIAGONAL, FLOOR = 0.1, 0.1, 1e-3
STATS = ("characters", "words", "word length", "upper case", "digits", "punctuation", "white space", "beyond ASCII",
         "distinct words", "distinct lines", "commonest word", "words with inner or double marks", "bare marks",
         "words in capitals")

_BYTE = np.zeros(256, np.int64)  # class of a byte: 0 other, 1 upper, 2 digit, 3 mark, 4 white, 5 lead, 6 trail
_BYTE[65:91] = 1
_BYTE[48:58] = 2
_BYTE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_BYTE[[9, 10, 11, 12, 13, 32]] = 4
_BYTE[192:256] = 5
_BYTE[128:192] = 6


def _logit(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text."""
    text = text or ""
    kinds = np.bincount(_BYTE[np.frombuffer(text.encode(), np.uint8)], minlength=7)
    chars = int(kinds.sum() - kinds[6])
    words = text.split()
    n = len(words)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x]
    marked = bare = capitals = 0
    for w, c in seen.items():
        if not w.isalpha():
            core = w.strip(".,;:!?\"'()«»¿¡")
            if not core:
                bare += c
            elif not core.isalnum() or len(w) - len(core) > 1:
                marked += c
        if len(w) > 2 and w.isupper():
            capitals += c
    return [float(np.log1p(chars)), float(np.log1p(n)), float(np.log1p(chars / n if n else 0)),
            _logit(kinds[1], chars), _logit(kinds[2], chars), _logit(kinds[3], chars), _logit(kinds[4], chars),
            _logit(kinds[5], chars), _logit(len(seen), n), _logit(len(set(lines)), len(lines)),
            _logit(max(seen.values(), default=0), n), _logit(marked, n), _logit(bare, n), _logit(capitals, n)]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, x array<double> of every row."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([statistics(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))],
                names=[id_col, "x"])
    kind = docs.schema[id_col].dataType.simpleString()
    return own(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, x array<double>")


class Discriminant:
    """Class log densities with cached Cholesky factors."""

    def __init__(self, moments: dict[int, tuple[int, np.ndarray, np.ndarray]], to_pooled: float = TO_POOLED,
                 to_diagonal: float = TO_DIAGONAL, floor: float = FLOOR):
        total = sum(m[0] for m in moments.values())
        own_cov = {}
        self.mean = {}
        for y, (n, s, ss) in moments.items():
            self.mean[y] = s / n
            own_cov[y] = ss / n - np.outer(self.mean[y], self.mean[y])
        pooled = sum(moments[y][0] / total * c for y, c in own_cov.items())
        pooled = (1 - to_diagonal) * pooled + to_diagonal * np.diag(np.diag(pooled)) + floor * np.eye(len(pooled))
        self.log_prior = {y: float(np.log(m[0] / total)) for y, m in moments.items()}
        self.whiten, self.log_det = {}, {}
        for y, c in own_cov.items():
            factor = np.linalg.cholesky((1 - to_pooled) * c + to_pooled * pooled + floor * np.eye(len(pooled)))
            self.whiten[y] = np.linalg.inv(factor)
            self.log_det[y] = 2 * float(np.log(np.diag(factor)).sum())

    def log_density(self, x: np.ndarray, y: int) -> np.ndarray:
        z = (x - self.mean[y]) @ self.whiten[y].T
        return -0.5 * ((z * z).sum(axis=1) + self.log_det[y]) + self.log_prior[y]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_density(x, 1) - self.log_density(x, 0), -60, 60)))


def class_moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products by class, of rows (x, y); a fixed-size result for each task."""
    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            y = np.array(b.column(1).to_pylist(), int)
            x = np.array(b.column(0).to_pylist(), float).reshape(len(y), -1)
            for k in np.unique(y):
                part = x[y == k]
                old = held.get(int(k), [0, 0.0, 0.0])
                held[int(k)] = [old[0] + len(part), old[1] + part.sum(axis=0), old[2] + part.T @ part]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([v[0] for v in held.values()], pa.int64()),
             pa.array([v[1].tolist() for v in held.values()], pa.list_(pa.float64())),
             pa.array([v[2].ravel().tolist() for v in held.values()], pa.list_(pa.float64()))],
            names=["y", "n", "s", "ss"])
    out: dict[int, tuple] = {}
    parts = rows.select("x", "__y").mapInArrow(run, "y int, n long, s array<double>, ss array<double>")
    for r in parts.select("y", "n", F.posexplode(F.concat("s", "ss")).alias("k", "v")).groupBy("y", "k").agg(
            F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("y", "k").collect():
        out.setdefault(r["y"], (r["n"], []))[1].append(r["v"])
    d = len(STATS)
    return {y: (n, np.array(v[:d]), np.array(v[d:]).reshape(d, d)) for y, (n, v) in out.items()}


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    x = staged(document_statistics(docs, id_col, text_col), "quality")
    moments = class_moments(labelled(x, training_labels(labels, label_col, FOLDS, HELD_OUT, id_col), id_col))
    model = Discriminant(moments) if len(moments) == 2 else None
    share = moments[1][0] / sum(m[0] for m in moments.values()) if 1 in moments else 0.5 if not moments else 0.0

    def run(batches):
        for b in batches:
            rows = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
            score = model.score(rows) if model and len(rows) else np.full(b.num_rows, share)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(score), pa.array((score >= 0.5).astype("i4"))],
                names=[id_col, "held_out", "score", "predicted"])
    kind = docs.schema[id_col].dataType.simpleString()
    return x.select(id_col, "x", (crc_mod(id_col, FOLDS) == HELD_OUT).alias("held_out")).mapInArrow(
        run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
