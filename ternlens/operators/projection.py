"""V6: two-dimensional projection of vectors on their principal axes.

Mean and covariance are sums over all vectors, combined in each task (the Gram matrix of its centred rows), so one row of
dim² numbers per task crosses the shuffle; the axes are the eigenvectors of a dim × dim matrix, and the projection is a pair of
inner products inside generated code.  An axis points to where its largest component (the first of equal ones) is positive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternlens import constants as K
from ternlens.functions import vectors as V


def _finite(vecs: DataFrame, vector: str, dim: int) -> DataFrame:
    """The rows whose vector has ``dim`` finite components."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vecs.where((F.size(vector) == dim) & ok)


def vector_moments(vecs: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """One row (count, mean, covariance): mean of the vectors of ``dim`` finite components, and their population covariance
    row by row; no row without such vectors."""
    src = _finite(vecs.select(F.col(vector).cast("array<double>").alias("_v")), "_v", dim)
    mean = src.agg(F.count(F.lit(1)).alias("count"), vector_to_array(Summarizer.mean(array_to_vector("_v"))).alias("mean"))
    centred = src.join(F.broadcast(mean)).select(F.zip_with("_v", "mean", lambda x, m: x - m).alias("_v"))

    def gram(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["_g"])

    sums = (centred.mapInArrow(gram, "_g array<double>")
            .agg(vector_to_array(Summarizer.sum(array_to_vector("_g"))).alias("_g")))
    return (mean.where(F.col("count") > 0).join(F.broadcast(sums))
            .select("count", "mean", F.transform("_g", lambda x: x / F.col("count")).alias("covariance")))


def principal_axes(moments: DataFrame, axes: int = 2) -> tuple[np.ndarray, np.ndarray] | None:
    """(mean, axes × dim eigenvectors by falling eigenvalue) of the one row of moments, an eager job; None without vectors."""
    row = moments.first()
    if row is None:
        return None
    mean = np.asarray(row["mean"])
    _, vectors = np.linalg.eigh(np.asarray(row["covariance"]).reshape(len(mean), len(mean)))
    top = vectors[:, ::-1][:, :axes].T
    largest = np.argmax(np.round(np.abs(top), 12), axis=1)
    return mean, top * np.where(top[np.arange(len(top)), largest] < 0, -1.0, 1.0)[:, None]


def principal_points(vecs: DataFrame, dim: int, vector: str = "vector", min_points: int = 3) -> DataFrame:
    """The rows with a vector of ``dim`` finite components, with its place ``x``, ``y`` on the first two principal axes;
    no rows if there are fewer than ``min_points``, or fewer than two dimensions."""
    moments = vector_moments(vecs, dim, vector)
    found = principal_axes(moments.where(F.col("count") >= min_points)) if 2 <= dim <= K.MAX_VECTOR_DIMS else None
    null = F.lit(None).cast("double")
    if found is None:
        return vecs.where(F.lit(False)).withColumns({"x": null, "y": null})
    mean, axes = found
    centred = F.zip_with(F.col(vector).cast("array<double>"), F.lit(mean.tolist()), lambda a, m: a - m)
    return (_finite(vecs, vector, dim).withColumn("_c", centred)
            .withColumns({"x": V.dot("_c", F.lit(axes[0].tolist())), "y": V.dot("_c", F.lit(axes[1].tolist()))}).drop("_c"))
