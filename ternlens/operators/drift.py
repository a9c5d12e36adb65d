"""Semantic drift: per-app centroids, snapshot drift and online (running-centroid) drift.

Online drift (W1) scores each vector, in arrival order per app, by its cosine
distance to the normalised mean of all vectors of that app so far, itself
included; null while fewer than ``min_baseline`` are stored.  The baseline is the whole
history; ``cap`` stops it after the first ``cap`` vectors (parity with a bounded store).

Plan at scale, the same for one hot app as for many small ones:
* only (app, order, id, vector) move: a range partitioning by (app, order) deals a hot app
  over as many partitions as its rows need, and is staged once, with the rows of a partition cut
  into blocks of 2^``BLOCK_BITS``, so that what a task holds doesn't grow with the partitions;
* each (app, block) gives a count and a vector sum, combined before the shuffle, and the
  exclusive prefix sums run over this block table;
* blocks are scored on their own with a cumulative sum from their prefix, and the scores
  are joined back by a number given to each input row, so repeated rows stay as many as they were.

A stream carries the history from batch to batch as one (app, count, sum) row per app
(``drift_state``): ``start`` goes into the blocks' prefixes, and no app is gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ternlens import constants as K
from ternlens.functions import vectors as V
from ternlens.session import stage


#: A block has up to 2^12 rows: what the Python side of a task holds of vectors.
BLOCK_BITS = 12


def _stored(vecs: DataFrame, vector: str) -> DataFrame:
    return vecs.where(F.col(vector).isNotNull() & (F.size(vector) > 0))


def _sum(vector: str) -> Column:
    """Vector sum, combined before the shuffle."""
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(vector).cast("array<double>"))))


def centroids(vecs: DataFrame, key: str = "app_name", vector: str = "vector",
              order: tuple[str, ...] = ("id",), cap: int | None = None) -> DataFrame:
    """Per key, dimension-wise mean of all vectors (of the first ``cap``, if given),
    L2-normalised: one partial sum per key and partition crosses the shuffle."""
    src = _stored(vecs, vector)
    if cap is not None:
        w = Window.partitionBy(key).orderBy(*order)
        src = src.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap)
    sums = src.groupBy(key).agg(F.count(F.lit(1)).alias("vectors"), _sum(vector).alias("_s"))
    mean = F.transform("_s", lambda x: x / F.col("vectors"))
    return (sums.select(key, "vectors", mean.alias("_mean"))
            .select(key, "vectors", V.normalize("_mean").alias("centroid")))


def vector_counts(vecs: DataFrame, key: str = "app_name", vector: str = "vector") -> DataFrame:
    """Stored vectors per key."""
    return (vecs.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
            .groupBy(key).agg(F.count(F.lit(1)).alias("embedding_count")))


def drift_from_distance(dist: Column) -> Column:
    """distance/2 clamped to [0, 1], 4 decimals."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dist / F.lit(2.0))), K.SCORE_DECIMALS)


def snapshot_drift(vecs: DataFrame, key: str = "app_name", vector: str = "vector",
                   order: tuple[str, ...] = ("id",), cap: int | None = None) -> DataFrame:
    """Distance of every vector to its key's centroid (the batch re-score).

    The centroid table is one row per key; AQE turns the join into a broadcast when
    it is small and keeps a shuffle join when there are very many keys.
    """
    c = centroids(vecs, key, vector, order, cap).select(key, "centroid")
    return (vecs.join(c, key, "left")
            .withColumn("drift_score", F.when(F.col(vector).isNull() | F.col("centroid").isNull(),
                                              F.lit(None).cast("double"))
                        .otherwise(drift_from_distance(V.cosine_distance(vector, "centroid"))))
            .drop("centroid"))


def drift_state(vecs: DataFrame, start: DataFrame | None = None, key: str = "app_name", vector: str = "vector") -> DataFrame:
    """(key, count, total): what the running centroid needs to know of all vectors so far, ``start`` and the given ones."""
    new = (_stored(vecs, vector).groupBy(key).agg(F.count(F.lit(1)).alias("count"), _sum(vector).alias("total")))
    if start is None:
        return new
    return (start.select(key, "count", "total").unionByName(new).groupBy(key)
            .agg(F.sum("count").alias("count"), _sum("total").alias("total")))


def _block_distances(order: list[str], cap: int | None):
    """Cosine distances of one (key, block) to the running centroid, from the block's prefix."""
    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k", kind="mergesort")
        m = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf["_v"]])
        before = int(pdf["_before"].iloc[0])
        first = pdf["_prefix"].iloc[0]
        rank = before + 1 + np.arange(len(m))
        counted = m if cap is None else np.where((rank <= cap)[:, None], m, 0.0)
        cen = np.cumsum(counted, axis=0)
        if first is not None:
            cen = cen + np.asarray(first, dtype=np.float64)
        cen = cen / (rank if cap is None else np.minimum(rank, cap))[:, None]
        cn = np.sqrt(np.einsum("ij,ij->i", cen, cen))
        cen = cen / np.where(cn > 0, cn, 1.0)[:, None]
        vn, cn = np.sqrt(np.einsum("ij,ij->i", m, m)), np.sqrt(np.einsum("ij,ij->i", cen, cen))
        zero = (vn == 0) | (cn == 0)
        dist = np.where(zero, 1.0, 1.0 - np.einsum("ij,ij->i", m, cen) / np.where(zero, 1.0, vn * cn))
        return pd.DataFrame({"_row": pdf["_row"], "_dist": dist, "_rank": rank})
    return score


def online_drift(vecs: DataFrame, key: str = "app_name", vector: str = "vector",
                 order: tuple[str, ...] = ("timestamp", "id"), cap: int | None = None,
                 min_baseline: int = K.MIN_DRIFT_BASELINE, keep_vector: str | None = None,
                 start: DataFrame | None = None) -> DataFrame:
    """Running-centroid drift in arrival order per key (see module docstring).

    Rows without a vector (blank responses) are not stored and get a null score.
    Returns the input columns (minus the vector) plus ``drift_score``; with
    ``keep_vector`` the vector is also returned under that name.  Every input row is returned once,
    repeated ones too.  ``start`` (``drift_state`` of earlier vectors) is the history before these.
    The staging of the input and of (key, row, vector) are eager jobs.
    """
    vecs = stage(vecs.withColumn("_row", F.monotonically_increasing_id()), "drift-input")
    cols = [F.col(key).alias("_key"), "_row", F.col(vector).cast("array<double>").alias("_v"),
            *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]]
    by = ["_key", *[f"_o{i}" for i in range(len(order))], "_row"]
    # the number of a row is its place in its partition behind the partition's number, so blocks are in order, too
    dealt = (_stored(vecs, vector).select(*cols).repartitionByRange(*by).sortWithinPartitions(*by)
             .withColumn("_k", F.monotonically_increasing_id())
             .select("_key", F.shiftright("_k", BLOCK_BITS).alias("_block"), "_row", "_v", "_k"))
    rows = stage(dealt, "drift-rows")

    # The block table: counts first, then sums of the rows that still belong to the baseline.
    upto = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_key", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_first"))
    counts = counts.select("_key", "_block", "_first", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    if start is not None:
        counts = (counts.join(start.select(F.col(key).alias("_key"), F.col("count").alias("_c"), F.col("total").alias("_total")), "_key", "left")
                  .select("_key", "_block", "_first", (F.col("_before") + F.coalesce("_c", F.lit(0))).alias("_before"), "_total"))
    else:
        counts = counts.withColumn("_total", F.lit(None).cast("array<double>"))
    counted = rows.join(counts.drop("_total"), ["_key", "_block"])
    baseline = counted if cap is None else counted.where(F.col("_before") + F.col("_k") - F.col("_first") < cap)
    sums = (baseline.groupBy("_key", "_block").agg(_sum("_v").alias("_s"))
            .select("_key", "_block", F.posexplode("_s").alias("_pos", "_x")))
    later = Window.partitionBy("_key", "_pos").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    every = counts.drop("_total").join(sums.select("_key", "_pos").distinct(), "_key").join(sums, ["_key", "_block", "_pos"], "left")
    prefix = (every.withColumn("_p", F.sum("_x").over(later)).where(F.col("_p").isNotNull())
              .groupBy("_key", "_block").agg(F.sort_array(F.collect_list(F.struct("_pos", "_p"))).alias("_ps"))
              .select("_key", "_block", F.col("_ps._p").alias("_prefix")))
    both = (F.when(F.col("_prefix").isNull(), F.col("_total")).when(F.col("_total").isNull(), F.col("_prefix"))
            .otherwise(F.zip_with("_prefix", "_total", lambda x, y: x + y)))
    blocks = stage(counts.join(prefix, ["_key", "_block"], "left").select("_key", "_block", "_before", both.alias("_prefix")), "drift-blocks")
    dist = (rows.join(blocks, ["_key", "_block"]).groupBy("_key", "_block")
            .applyInPandas(_block_distances(list(order), cap), "_row long, _dist double, _rank long"))
    scores = dist.select("_row", F.when(F.col("_rank") >= min_baseline, drift_from_distance(F.col("_dist"))).alias("drift_score"))
    kept = vecs.drop("drift_score")
    kept = kept.withColumnRenamed(vector, keep_vector) if keep_vector else kept.drop(vector)
    return kept.join(scores, "_row", "left").drop("_row")
