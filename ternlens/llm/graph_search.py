"""Approximate nearest neighbours by a robust-pruned directed graph on each shard.

Rows are dealt to shards of about ``SHARD_ROWS`` by a hash of their identifier.  A shard's graph is built
by inserting its vectors in batches, in random order: a greedy beam search in the graph so far proposes
neighbours, relaxed distance pruning (a candidate goes if it is ``ALPHA`` times closer to a kept neighbour
than to the point) keeps at most ``DEGREE`` diverse edges, and the edges' reverses are added and pruned
alike.  Every query block then beam-searches every shard, the candidates are scored exactly, and the
nearest of all shards stay.

Largest inner product becomes smallest distance by one more component, sqrt(M^2 - |x|^2) with M the shard's
largest norm (0 for queries), so vectors of any length are searched alike.  Equal vectors of a shard are one
vertex with their identifiers, of which the ``k + 1`` smallest can matter: ties go to the smaller one.

A shard's index is one row (about 3 MB for 64 components), queries go in blocks: no task holds more than one
shard and one block, whatever the table's size, and a third of all rows with one vector make small graphs.

Defined results: vectors that are null, all zero, or hold a null or non-finite component take no part; vectors of
different lengths are never compared; repeated rows (same identifier and vector) count once; a query's own identifier is no
candidate; fewer candidates than ``k`` are all returned; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ternlens.llm.common import own, staged

SHARD_ROWS = 8192
BLOCK_QUERIES = 1024
DEGREE, ALPHA = 32, 1.2
BUILD_BEAM, SEARCH_BEAM = 64, 128
EXPAND = 4
BATCH = 256
ENTRIES = 8


class Graph:
    """Vertices ``x`` (augmented), edges ``out`` (-1: none), and where a search starts."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.x = np.ascontiguousarray(x, np.float32)
        self.sq = np.einsum("nd,nd->n", self.x, self.x)
        n = len(x)
        self.out = np.full((n, 2 * DEGREE), -1, np.int32)
        self.degree = np.zeros(n, np.int32)
        rng = np.random.default_rng(seed)
        middle = int(np.argmin(self.sq - 2 * self.x @ self.x.mean(axis=0)))
        rest = rng.permutation(n)
        rest = rest[rest != middle]
        self.entries = np.append(rest[:ENTRIES - 1], middle).astype(np.int32)
        order = np.append(self.entries, rest[ENTRIES - 1:])
        self._insert(self.entries, self.entries[None, :].repeat(len(self.entries), 0))
        at = len(self.entries)
        while at < n:
            batch = order[at:at + min(BATCH, at)]
            near, _ = self.search(self.x[batch], BUILD_BEAM)
            self._insert(batch, near)
            at += len(batch)
        over = np.nonzero(self.degree > DEGREE)[0]
        for lo in range(0, len(over), BATCH):
            self._prune(over[lo:lo + BATCH], self.out[over[lo:lo + BATCH]])
        self.out = np.ascontiguousarray(self.out[:, :DEGREE])

    def _distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances less the query's own square, of each row's vertices (-1: infinite)."""
        d = self.sq[ids] - 2 * np.einsum("bcd,bd->bc", self.x[ids], q)
        return np.where(ids < 0, np.inf, d)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all rows of ``q`` at once: the nearest vertices found, nearest first."""
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(self.x) + 1), bool)  # the last column stands for -1
        seen[:, -1] = True
        ids = np.full((len(q), beam), -1, np.int32)
        start = self.entries[:beam]
        ids[:, :len(start)] = start
        seen[rows, ids] = True
        dist = self._distances(q, ids)
        todo = ids >= 0
        live = np.arange(len(q))
        while len(live):
            best = np.argsort(np.where(todo[live], dist[live], np.inf), axis=1, kind="stable")[:, :EXPAND]
            r = live[:, None]
            now = np.where(todo[r, best], ids[r, best], -1)
            todo[r, best] = False
            new = np.where(now[:, :, None] < 0, -1, self.out[now]).reshape(len(live), -1)
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[r, new]] = -1
            seen[r, new] = True
            every = np.concatenate([ids[live], new], axis=1)
            far = np.concatenate([dist[live], self._distances(q[live], new)], axis=1)
            open_ = np.concatenate([todo[live], new >= 0], axis=1)
            keep = np.argsort(far, axis=1, kind="stable")[:, :beam]
            k = np.arange(len(live))[:, None]
            ids[live], dist[live], todo[live] = every[k, keep], far[k, keep], open_[k, keep]
            live = live[todo[live].any(axis=1)]
        return ids, dist

    def _insert(self, points: np.ndarray, near: np.ndarray) -> None:
        self._prune(points, near)
        ends = self.out[points]
        source = np.repeat(points, ends.shape[1])[ends.ravel() >= 0].astype(np.int32)
        target = ends.ravel()[ends.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        nth = np.arange(len(target)) - np.repeat(first, count)
        room = 2 * DEGREE - self.degree[target]
        fits = nth < room
        self.out[target[fits], (self.degree[target] + nth)[fits]] = source[fits]
        full = nodes[count > 2 * DEGREE - self.degree[nodes]]
        self.degree[nodes] = np.minimum(self.degree[nodes] + count, 2 * DEGREE)
        left_s, left_t = source[~fits], target[~fits]
        for lo in range(0, len(full), BATCH):
            some = full[lo:lo + BATCH]
            more = [left_s[left_t == v] for v in some]
            width = max(map(len, more))
            extra = np.full((len(some), width), -1, np.int32)
            for k, m in enumerate(more):
                extra[k, :len(m)] = m
            self._prune(some, np.concatenate([self.out[some], extra], axis=1))

    def _prune(self, points: np.ndarray, near: np.ndarray) -> None:
        """Give ``points`` at most DEGREE diverse edges out of ``near`` (-1: none)."""
        near = np.where(near == points[:, None], -1, near)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        d = self._distances(self.x[points], near) + self.sq[points][:, None]
        order = np.argsort(d, axis=1, kind="stable")
        rows = np.arange(len(points))[:, None]
        near, d = near[rows, order], np.maximum(d[rows, order], 0)
        v = self.x[near]
        between = self.sq[near][:, :, None] + self.sq[near][:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive = near >= 0
        out = np.full((len(points), 2 * DEGREE), -1, np.int32)
        degree = np.zeros(len(points), np.int32)
        one = np.arange(len(points))
        for _ in range(DEGREE):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = alive.argmax(axis=1)
            out[one[some], degree[some]] = near[one[some], pick[some]]
            degree[some] += 1
            closer = ALPHA * ALPHA * between[one, pick] <= d
            alive &= ~closer
            alive[one, pick] = False
        self.out[points] = out
        self.degree[points] = degree


def augmented(x: np.ndarray) -> np.ndarray:
    norm = np.einsum("nd,nd->n", x, x)
    return np.concatenate([x, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], axis=1)


def build_index(ids: np.ndarray, x: np.ndarray, keep: int) -> bytes:
    """A shard's index: distinct vectors, the identifiers of each (``keep`` smallest), and the graph."""
    order = np.argsort(ids, kind="stable")
    distinct, where = np.unique(x[order], axis=0, return_inverse=True)
    by_vertex = np.argsort(where.ravel(), kind="stable")
    vertex, held = where.ravel()[by_vertex], ids[order][by_vertex]
    first = np.searchsorted(vertex, np.arange(len(distinct)))
    stays = np.arange(len(vertex)) - first[vertex] < keep
    graph = Graph(augmented(distinct.astype(np.float64)))
    small = distinct.astype(np.float32)  # as given, if given in single precision
    distinct = small if (small == distinct).all() else distinct
    out = io.BytesIO()
    np.savez(out, x=distinct, aug=graph.x, out=graph.out, entries=graph.entries, vertex=vertex[stays], ids=held[stays])
    return out.getvalue()


def search_index(index: bytes, query_ids: np.ndarray, q: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> pd.DataFrame:
    """The ``k`` nearest of one shard for each query: query_id, vec_id, score."""
    held = np.load(io.BytesIO(index))
    graph = Graph.__new__(Graph)
    graph.x, graph.out, graph.entries = held["aug"], held["out"], held["entries"]
    graph.sq = np.einsum("nd,nd->n", graph.x, graph.x)
    x, vertex, ids = held["x"].astype(np.float64), held["vertex"], held["ids"]
    first = np.searchsorted(vertex, np.arange(len(x) + 1))
    parts = []
    for lo in range(0, len(q), BATCH):
        some = q[lo:lo + BATCH].astype(np.float64)
        found, _ = graph.search(np.concatenate([some, np.zeros((len(some), 1))], axis=1).astype(np.float32), beam)
        score = np.where(found < 0, -np.inf, np.einsum("bcd,bd->bc", x[found], some))
        best = np.argsort(-score, axis=1, kind="stable")[:, :min(k + 1, beam)]
        # equal scores at the end may hide a smaller identifier: all of them go on
        last = np.take_along_axis(score, best[:, -1:], axis=1)
        row, col = np.nonzero((score >= last) & (found >= 0))
        v = found[row, col]
        count = first[v + 1] - first[v]
        at = np.repeat(first[v], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        parts.append(pd.DataFrame({"query_id": np.repeat(query_ids[lo + row], count), "vec_id": ids[at],
                                   "score": np.repeat(score[row, col], count)}))
    out = pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return out.groupby("query_id").head(k)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v array<float>, dim of the rows that take part."""
    inf = float("inf")
    v = F.col("v")
    return (own(vectors, id_col, vector_col).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .filter(F.col("id").isNotNull() & v.isNotNull()
                    & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(v, lambda x: x != 0))
            .withColumn("dim", F.size("v")))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of each row whose identifier is divisible by ``every``."""
    rows = staged(usable(vectors, id_col, vector_col), "vectors")
    n = rows.count()
    shards = max(1, math.ceil(n / shard_rows))
    queries = rows.filter(F.pmod("id", F.lit(every)) == 0)
    blocks = max(1, math.ceil(queries.count() / BLOCK_QUERIES))

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(raw=[np.asarray(v, np.float64).tobytes() for v in pdf["v"]]).drop_duplicates(["id", "raw"])
        x = np.frombuffer(b"".join(pdf["raw"]), np.float64).reshape(len(pdf), -1)
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "index": [build_index(pdf["id"].to_numpy(), x, k + 1)]})

    index = staged(rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
                   .repartition(shards, "dim", "shard")
                   .groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, index binary"), "index")

    # Blocks of queries, as bytes; each goes to each shard.
    block = (queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
             .groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v")).alias("queries")))  # about BLOCK_QUERIES rows
    pairs = (block.select("dim", "block", "queries", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
             .repartition(shards * blocks, "dim", "shard", "block")
             .join(index.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "index")
                   .repartition(shards * blocks, "dim", "shard", "block"), ["dim", "shard", "block"]))

    def find(batches):
        for b in batches:
            for k_row in range(b.num_rows):
                own_queries = b.column(0)[k_row].as_py()
                seen = {(r["id"], tuple(r["v"])) for r in own_queries}
                ids = np.array([r[0] for r in seen], np.int64)
                got = search_index(b.column(1)[k_row].as_py(), ids, np.array([r[1] for r in seen], np.float64), k, beam)
                yield pa.RecordBatch.from_arrays([pa.array(got["query_id"].to_numpy(np.int64)), pa.array(got["vec_id"].to_numpy(np.int64)),
                                                  pa.array(got["score"].to_numpy(np.float64))], names=["query_id", "vec_id", "score"])

    found = pairs.select("queries", "index").mapInArrow(find, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")  # k rows of each shard
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
