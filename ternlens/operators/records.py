"""Record lookups: filtered queries, counts, point lookups, latest-N, top-k, previews.

Filters are plain Catalyst predicates, so on a Parquet record table partitioned
by ``app_name, event_date`` they prune partitions and push into the scan. Every
ordering carries ``id`` as the final tie-break so limits are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ternlens import constants as K
from ternlens.functions import text as TX

_EQ_FILTERS = ("app_name", "model_name", "language_detected")


def filter_predicate(filters: dict | None) -> Column | None:
    """AND of the supported filters; unknown keys are ignored."""
    conds: list[Column] = []
    for key, value in (filters or {}).items():
        if key in _EQ_FILTERS:
            conds.append(F.col(key) == F.lit(value))
        elif key == "min_health_score":
            conds.append(F.col("health_score") >= F.lit(value))
        elif key == "max_health_score":
            conds.append(F.col("health_score") <= F.lit(value))
        elif key == "start_time":
            conds.append(F.col("timestamp") >= F.lit(value).cast("timestamp"))
        elif key == "end_time":
            conds.append(F.col("timestamp") <= F.lit(value).cast("timestamp"))
    if not conds:
        return None
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def apply_filters(records: DataFrame, filters: dict | None) -> DataFrame:
    pred = filter_predicate(filters)
    return records if pred is None else records.where(pred)


def query_records(records: DataFrame, filters: dict | None = None, limit: int = 100, offset: int = 0,
                  order_by: str = "timestamp", order_desc: bool = True) -> DataFrame:
    """filter → sort (allow-listed column, else timestamp) → offset → limit.

    Nulls sort lowest (first ascending, last descending), as in the original store.
    """
    col = order_by if order_by in K.SORTABLE_COLUMNS else "timestamp"
    if order_desc:
        order = [F.col(col).desc_nulls_last(), F.col("id").desc()]
    else:
        order = [F.col(col).asc_nulls_first(), F.col("id").asc()]
    df = apply_filters(records, filters).orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df.limit(limit)


def count_records(records: DataFrame, filters: dict | None = None, app_only: bool = False) -> DataFrame:
    """number of matching records. ``app_only`` honours only ``app_name`` (parity mode)."""
    if app_only:
        filters = {k: v for k, v in (filters or {}).items() if k == "app_name"}
    return apply_filters(records, filters).agg(F.count(F.lit(1)).alias("count"))


def get_by_id(records: DataFrame, record_id: str) -> DataFrame:
    """point lookup (empty when missing)."""
    return records.where(F.col("id") == F.lit(record_id))


def latest_n(records: DataFrame, n: int = 10, app_name: str | None = None) -> DataFrame:
    """the n newest records (top-N: each partition keeps n, one task merges)."""
    df = records if app_name is None else records.where(F.col("app_name") == F.lit(app_name))
    return df.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(n)


def latest_n_per_app(records: DataFrame, n: int = 10, key: str = "app_name") -> DataFrame:
    """the n newest records of every app in one pass.

    ``row_number() <= n`` lets Spark insert a map-side ``WindowGroupLimit``, so at most
    n rows per app and partition are shuffled even when one app holds most rows.
    """
    w = Window.partitionBy(key).orderBy(F.col("timestamp").desc(), F.col("id").desc())
    return records.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def preview(records: DataFrame) -> DataFrame:
    """Dashboard preview columns (query[:50], response[:60], first two claims, time)."""
    return records.select(
        "id",
        F.date_format("timestamp", "HH:mm:ss").alias("time"),
        F.substring("query", 1, 50).alias("query_preview"),
        F.substring("response", 1, 60).alias("response_preview"),
        TX.fixed("hallucination_score", 3).alias("score_text"),
        F.coalesce(F.array_join(F.slice(F.col("flagged_claims"), 1, 2), ", "), F.lit("")).alias("claims_preview"),
        "hallucination_score",
    )


def top_hallucinations(records: DataFrame, k: int = K.TOP_HALLUCINATIONS,
                       window: int = K.DASHBOARD_WINDOW) -> DataFrame:
    """the k highest hallucination scores among the latest ``window`` records.

    A stable sort of newest-first input keeps the newest of equal scores first,
    so ties break by timestamp descending, then id.
    """
    latest = latest_n(records, window)
    top = latest.orderBy(F.col("hallucination_score").desc(), F.col("timestamp").desc(),
                         F.col("id").desc()).limit(k)
    return preview(top)


def drift_applicable(records: DataFrame) -> DataFrame:
    """F8: records that carry a drift score."""
    return records.where(F.col("drift_score").isNotNull())


def rag_applicable(records: DataFrame) -> DataFrame:
    """F8: records that carry a groundedness score (RAG calls)."""
    return records.where(F.col("groundedness_score").isNotNull())


def embedding_points(records: DataFrame, vector: str = "embedding_vector", min_points: int = 3) -> DataFrame:
    """F8 + V6: first two vector components of records with a >2-dim vector, shown only
    when at least ``min_points`` such rows exist (guard joined as a one-row aggregate)."""
    pts = records.where(F.size(F.col(vector)) > 2)
    guard = pts.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points).select(F.lit(1).alias("_one"))
    out = pts.select("id", F.element_at(vector, 1).alias("x"), F.element_at(vector, 2).alias("y"),
                     "hallucination_score", F.substring("query", 1, 30).alias("label"),
                     F.lit(1).alias("_one"))
    return out.join(F.broadcast(guard), "_one").drop("_one")
