"""Aggregations over scored records: time series, KPIs, distributions, rates.

Every operator is a ``DataFrame -> DataFrame`` over the record table. Grouped
aggregates run as partial (map-side) + final hash aggregates, so only one small
row per group and partition crosses the shuffle. Dashboard views that look at
"the latest N" records use a bounded top-N (``TakeOrderedAndProject``) first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternlens import constants as K
from ternlens.functions import scores as S
from ternlens.operators.records import latest_n


def _metric(metric: str) -> str:
    if metric not in K.TIME_SERIES_METRICS:
        raise ValueError(f"Invalid metric: {metric}. Must be one of {K.TIME_SERIES_METRICS}")
    return metric


def _bucket(ts: Column, granularity: str) -> tuple[Column, str]:
    unit = granularity if granularity in K.TIME_BUCKET_FORMATS else "hour"
    return F.date_trunc(unit, ts), K.TIME_BUCKET_FORMATS[unit]


def time_series(records: DataFrame, metric: str, start=None, end=None, app_name: str | None = None,
                granularity: str = "hour", by: list[str] | None = None) -> DataFrame:
    """G1: avg/min/max/count of one metric per time bucket (minute, hour, day; else hour).

    Rows with a null metric are dropped; start/end are inclusive. Grouping is on the
    truncated timestamp (8 bytes per key in the shuffle) and only formatted after.
    ``by`` adds extra group keys (for example ``["app_name"]``).
    """
    m = _metric(metric)
    df = records.where(F.col(m).isNotNull())
    if start is not None:
        df = df.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    if app_name is not None:
        df = df.where(F.col("app_name") == F.lit(app_name))
    bucket, fmt = _bucket(F.col("timestamp"), granularity)
    keys = list(by or [])
    v = F.col(m).cast("double")
    agg = (df.groupBy(*keys, bucket.alias("_bucket"))
           .agg(F.avg(v).alias("avg_value"), F.min(v).alias("min_value"),
                F.max(v).alias("max_value"), F.count(F.lit(1)).alias("count")))
    return (agg.select(*keys, F.date_format("_bucket", fmt).alias("time_bucket"),
                       "avg_value", "min_value", "max_value", "count")
            .orderBy(*keys, "time_bucket"))


def multi_time_series(records: DataFrame, metrics: list[str], granularity: str = "hour",
                      by: list[str] | None = None) -> DataFrame:
    """G1, several metrics in one pass: one ``groupBy`` with an avg per metric."""
    ms = [_metric(m) for m in metrics]
    bucket, fmt = _bucket(F.col("timestamp"), granularity)
    keys = list(by or [])
    aggs = []
    for m in ms:
        aggs += [F.avg(F.col(m).cast("double")).alias(f"avg_{m}"), F.count(F.col(m)).alias(f"n_{m}")]
    agg = records.groupBy(*keys, bucket.alias("_bucket")).agg(*aggs, F.count(F.lit(1)).alias("count"))
    return agg.select(*keys, F.date_format("_bucket", fmt).alias("time_bucket"),
                      *[c for m in ms for c in (f"avg_{m}", f"n_{m}")], "count").orderBy(*keys, "time_bucket")


def overview_kpis(records: DataFrame, window: int = K.DASHBOARD_WINDOW) -> DataFrame:
    """Over the latest ``window`` records — truncated mean health (+ band), mean
    hallucination, mean drift over non-null (null when none; + status), row count."""
    latest = latest_n(records, window)
    agg = latest.agg(
        F.floor(F.avg("health_score")).cast("int").alias("avg_health"),
        F.avg("hallucination_score").alias("avg_hallucination"),
        F.avg("drift_score").alias("avg_drift"),
        F.count(F.lit(1)).alias("evaluations"),
    )
    return agg.select("*", S.health_band("avg_health").alias("health_band"),
                      S.drift_kpi_status("avg_drift").alias("drift_status"))


def aggregate_health(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of health scores > 0, half-even rounded; 50 when there are none."""
    keys = list(by or [])
    h = F.col("health_score")
    return records.groupBy(*keys).agg(
        F.coalesce(F.bround(F.avg(F.when(h > 0, h)), 0).cast("int"), F.lit(K.NEUTRAL_HEALTH))
        .alias("aggregate_health"),
        F.count(F.lit(1)).alias("records"))


def hallucination_by_model(records: DataFrame, window: int | None = K.DASHBOARD_WINDOW) -> DataFrame:
    """Mean hallucination per model, flagged when above 0.3."""
    src = latest_n(records, window) if window else records
    agg = src.groupBy("model_name").agg(F.avg("hallucination_score").alias("avg_hallucination"),
                                         F.count(F.lit(1)).alias("records"))
    return agg.withColumn("above_threshold", S.model_bar_band("avg_hallucination"))


def score_histogram(records: DataFrame, column: str = "hallucination_score", bins: int = 25,
                    by: list[str] | None = None) -> DataFrame:
    """Counts per equal-width bin over [0, 1]; empty bins appear with count 0.

    The bin domain is fixed (0 … bins-1): per group key it is generated with
    ``sequence`` next to the (small) distinct keys; counts are a partial/final aggregate.
    """
    keys = list(by or [])
    x = F.col(column)
    b = F.least(F.floor(x * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
    b = F.greatest(b, F.lit(0))
    counts = (records.where(x.isNotNull()).groupBy(*keys, b.alias("bin"))
              .agg(F.count(F.lit(1)).alias("count")))
    if keys:
        domain = (counts.select(*keys).distinct()
                  .select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")))
    else:
        domain = records.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = domain.join(counts, keys + ["bin"], "left")
    return out.select(*keys, "bin",
                      (F.col("bin") / F.lit(float(bins))).alias("bin_start"),
                      ((F.col("bin") + 1) / F.lit(float(bins))).alias("bin_end"),
                      F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def language_distribution(records: DataFrame, column: str = "language_detected") -> DataFrame:
    """Record count per detected language."""
    return records.groupBy(F.col(column).alias("language")).agg(F.count(F.lit(1)).alias("count"))


def denial_rate(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Denials / total."""
    keys = list(by or [])
    return (records.groupBy(*keys)
            .agg(F.count_if(F.col("is_denial")).alias("denials"), F.count(F.lit(1)).alias("total"))
            .withColumn("denial_rate", F.col("denials") / F.col("total")))


def rag_means(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Over records with groundedness, mean of the four RAG metrics with null as 0."""
    keys = list(by or [])
    df = records.where(F.col("groundedness_score").isNotNull())
    cols = ["faithfulness_score", "context_relevance", "answer_relevancy", "groundedness_score"]
    return df.groupBy(*keys).agg(
        *[F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(f"avg_{c}") for c in cols],
        F.count(F.lit(1)).alias("rag_records"))


def live_stats(records: DataFrame, window: int = K.LIVE_STATS_WINDOW) -> DataFrame:
    """Total count plus KPIs over the latest min(total, window) records.

    Both sides are single-row aggregates joined on a constant key (1×1).
    """
    total = records.agg(F.count(F.lit(1)).alias("total"))
    latest = latest_n(records, window).agg(
        F.floor(F.avg("health_score")).cast("int").alias("avg_health"),
        F.avg("hallucination_score").alias("avg_hallucination"),
        F.avg("toxicity_score").alias("avg_toxicity"),
        F.count_if(F.col("is_denial")).alias("denials"),
        F.count(F.lit(1)).alias("window_records"))
    status = (F.when(F.col("avg_health") >= 90, "Healthy").when(F.col("avg_health") >= 75, "Monitoring")
              .when(F.col("avg_health") >= 60, "Degrading").otherwise("Critical"))
    one = F.lit(1).alias("_one")
    return (total.select("*", one).join(latest.select("*", one), "_one")
            .drop("_one").withColumn("status", status))


def timeline(records: DataFrame, columns: list[str], window: int = K.DASHBOARD_WINDOW,
             require: str | None = None) -> DataFrame:
    """Latest ``window`` records in ascending time with a ``MM-dd HH:mm`` label.

    ``require`` keeps only rows where that column is not null (drift / RAG views).
    """
    latest = latest_n(records, window)
    if require:
        latest = latest.where(F.col(require).isNotNull())
    return (latest.select("id", "timestamp", F.date_format("timestamp", "MM-dd HH:mm").alias("label"), *columns)
            .orderBy("timestamp", "id"))


def trend_axis(records: DataFrame, window: int = K.DASHBOARD_WINDOW) -> DataFrame:
    """Health axis floor max(0, min−10) and drift axis top max(1.2·max drift, 0.3)."""
    latest = latest_n(records, window)
    return latest.agg(
        F.greatest(F.lit(0), F.min("health_score") - F.lit(10)).alias("health_axis_min"),
        F.greatest(F.max("drift_score") * F.lit(1.2), F.lit(0.3)).alias("drift_axis_max"),
        F.avg("drift_score").alias("avg_drift"),
    ).withColumn("drift_status", S.drift_tab_status("avg_drift"))
