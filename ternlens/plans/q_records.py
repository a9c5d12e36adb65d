"""Queries over scored records (V_REC): health, time series, lookups, KPIs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ternlens import constants as K
from ternlens.functions import scores as S
from ternlens.operators import analytics as A
from ternlens.operators import records as R
from ternlens.plans.catalog import r9, register
from ternlens.plans.sqlviews import V_REC, band_sql, quality_sql, with_views
from ternlens.sources import bridge

W_REC = with_views(V_REC)


def _latest(n: int, where: str = "") -> str:
    return f'(SELECT * FROM v_rec {where} ORDER BY "timestamp" DESC, id DESC LIMIT {n})'


def _fmt(g: str) -> str:
    return {"minute": "%Y-%m-%d %H:%M", "hour": "%Y-%m-%d %H:00", "day": "%Y-%m-%d"}[g]


# ---------------------------------------------------------------- M7 / M8 / M9
@register("record_health", ops="M7 M8 M9", sql=W_REC + f"""
SELECT id, app_name, health_score, round({quality_sql()}, 9) AS quality_subscore,
       {band_sql()} AS health_band
FROM v_rec""")
def record_health(spark, sf):
    rec = bridge.records(spark, sf)
    return rec.select("id", "app_name", "health_score", r9(S.quality_subscore()).alias("quality_subscore"),
                      S.health_band().alias("health_band"))


# ---------------------------------------------------------------- G1
def _ts_sql(metric: str, g: str, where: str = "", by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return W_REC + f"""
SELECT {keys}strftime(date_trunc('{g}', "timestamp"), '{_fmt(g)}') AS time_bucket,
       round(avg(CAST({metric} AS DOUBLE)), 9) AS avg_value, CAST(min({metric}) AS DOUBLE) AS min_value,
       CAST(max({metric}) AS DOUBLE) AS max_value, count(*) AS count
FROM v_rec WHERE {metric} IS NOT NULL {where}
GROUP BY {keys}date_trunc('{g}', "timestamp")"""


def _ts_round(df):
    return df.withColumn("avg_value", r9("avg_value"))


@register("health_time_series_by_app", ops="G1 M8", sql=_ts_sql("health_score", "hour", by="app_name"))
def health_time_series_by_app(spark, sf):
    return _ts_round(A.time_series(bridge.records(spark, sf), "health_score", by=["app_name"]))


@register("time_series_hallucination_hourly", ops="G1", sql=_ts_sql("hallucination_score", "hour"))
def time_series_hallucination_hourly(spark, sf):
    return _ts_round(A.time_series(bridge.records(spark, sf), "hallucination_score"))


@register("time_series_latency_daily_app", ops="G1 (app filter, day)",
          sql=_ts_sql("latency_ms", "day", where="AND app_name = 'app_1'"))
def time_series_latency_daily_app(spark, sf):
    return _ts_round(A.time_series(bridge.records(spark, sf), "latency_ms", app_name="app_1", granularity="day"))


@register("time_series_drift_minute_range", ops="G1 (time range, minute)",
          sql=_ts_sql("drift_score", "minute",
                      where="AND \"timestamp\" >= TIMESTAMP '2024-01-03 00:00:00' "
                            "AND \"timestamp\" <= TIMESTAMP '2024-01-05 12:00:00'"))
def time_series_drift_minute_range(spark, sf):
    return _ts_round(A.time_series(bridge.records(spark, sf), "drift_score", start="2024-01-03 00:00:00",
                                   end="2024-01-05 12:00:00", granularity="minute"))


_MULTI = ["health_score", "hallucination_score", "drift_score", "groundedness_score", "toxicity_score"]


@register("multi_metric_time_series_daily", ops="G1 (many metrics, one pass)", sql=W_REC + f"""
SELECT app_name, strftime(date_trunc('day', "timestamp"), '%Y-%m-%d') AS time_bucket,
       {", ".join(f"round(avg(CAST({m} AS DOUBLE)), 9) AS avg_{m}, count({m}) AS n_{m}" for m in _MULTI)},
       count(*) AS count
FROM v_rec GROUP BY app_name, date_trunc('day', "timestamp")""")
def multi_metric_time_series_daily(spark, sf):
    df = A.multi_time_series(bridge.records(spark, sf), _MULTI, granularity="day", by=["app_name"])
    for m in _MULTI:
        df = df.withColumn(f"avg_{m}", r9(f"avg_{m}"))
    return df


# ---------------------------------------------------------------- F1 – F5
_F1_FILTERS = {"app_name": "app_2", "min_health_score": 55, "max_health_score": 90,
               "start_time": "2024-01-02 00:00:00", "end_time": "2024-01-25 00:00:00", "bogus": 1}
_F1_WHERE = ("WHERE app_name = 'app_2' AND health_score >= 55 AND health_score <= 90 "
             "AND \"timestamp\" >= TIMESTAMP '2024-01-02 00:00:00' AND \"timestamp\" <= TIMESTAMP '2024-01-25 00:00:00'")


@register("query_records_filtered", ops="F1", sql=W_REC + f"""
SELECT id, app_name, "timestamp", health_score, hallucination_score FROM v_rec {_F1_WHERE}
ORDER BY health_score DESC NULLS LAST, id DESC LIMIT 100 OFFSET 10""")
def query_records_filtered(spark, sf):
    df = R.query_records(bridge.records(spark, sf), _F1_FILTERS, limit=100, offset=10, order_by="health_score")
    return df.select("id", "app_name", "timestamp", "health_score", "hallucination_score")


@register("query_records_drift_ascending", ops="F1 (nulls first ascending, offset)", sql=W_REC + """
SELECT id, model_name, drift_score FROM v_rec WHERE model_name = 'model_1'
ORDER BY drift_score ASC NULLS FIRST, id ASC LIMIT 250 OFFSET 100""")
def query_records_drift_ascending(spark, sf):
    df = R.query_records(bridge.records(spark, sf), {"model_name": "model_1"}, limit=250, offset=100,
                         order_by="drift_score", order_desc=False)
    return df.select("id", "model_name", "drift_score")


@register("count_records_filtered", ops="F2", sql=W_REC + f"SELECT count(*) AS count FROM v_rec {_F1_WHERE}")
def count_records_filtered(spark, sf):
    return R.count_records(bridge.records(spark, sf), _F1_FILTERS)


@register("count_records_app_only", ops="F2 (parity: only app_name honoured)",
          sql=W_REC + "SELECT count(*) AS count FROM v_rec WHERE app_name = 'app_2'")
def count_records_app_only(spark, sf):
    return R.count_records(bridge.records(spark, sf), _F1_FILTERS, app_only=True)


@register("record_by_id", ops="F3", sql=W_REC + """
SELECT id, app_name, model_name, health_score, drift_score FROM v_rec WHERE id = '4242'""")
def record_by_id(spark, sf):
    return R.get_by_id(bridge.records(spark, sf), "4242").select("id", "app_name", "model_name",
                                                                 "health_score", "drift_score")


@register("latest_records", ops="F4", sql=W_REC + f"""
SELECT id, "timestamp", app_name, health_score FROM {_latest(10)} t""")
def latest_records(spark, sf):
    return R.latest_n(bridge.records(spark, sf), 10).select("id", "timestamp", "app_name", "health_score")


@register("latest_records_app", ops="F4 (one app)", sql=W_REC + f"""
SELECT id, "timestamp", app_name, health_score FROM {_latest(25, "WHERE app_name = 'app_3'")} t""")
def latest_records_app(spark, sf):
    return R.latest_n(bridge.records(spark, sf), 25, app_name="app_3").select("id", "timestamp", "app_name",
                                                                               "health_score")


@register("latest_per_app", ops="F5", sql=W_REC + """
SELECT id, app_name, "timestamp", health_score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY app_name ORDER BY "timestamp" DESC, id DESC) AS rank FROM v_rec)
WHERE rank <= 10""")
def latest_per_app(spark, sf):
    return R.latest_n_per_app(bridge.records(spark, sf), 10).select("id", "app_name", "timestamp",
                                                                    "health_score", "rank")


# ---------------------------------------------------------------- F7 / P7 / F8
_PREVIEW_SQL = """id, strftime("timestamp", '%H:%M:%S') AS time, substr(query, 1, 50) AS query_preview,
       substr(response, 1, 60) AS response_preview, printf('%.3f', hallucination_score) AS score_text,
       '' AS claims_preview, hallucination_score"""


@register("top_hallucinations", ops="F7 P7", sql=W_REC + f"""
SELECT {_PREVIEW_SQL} FROM {_latest(K.DASHBOARD_WINDOW)} l
ORDER BY hallucination_score DESC, "timestamp" DESC, id DESC LIMIT {K.TOP_HALLUCINATIONS}""")
def top_hallucinations(spark, sf):
    return R.top_hallucinations(bridge.records(spark, sf))


@register("record_preview", ops="P7", sql=W_REC + f"SELECT {_PREVIEW_SQL} FROM v_rec")
def record_preview(spark, sf):
    return R.preview(bridge.records(spark, sf))


@register("rag_applicable_records", ops="F8", sql=W_REC + """
SELECT id, groundedness_score, faithfulness_score FROM v_rec WHERE groundedness_score IS NOT NULL""")
def rag_applicable_records(spark, sf):
    return R.rag_applicable(bridge.records(spark, sf)).select("id", "groundedness_score", "faithfulness_score")


@register("drift_applicable_records", ops="F8", sql=W_REC + """
SELECT id, app_name, drift_score FROM v_rec WHERE drift_score IS NOT NULL""")
def drift_applicable_records(spark, sf):
    return R.drift_applicable(bridge.records(spark, sf)).select("id", "app_name", "drift_score")


# ---------------------------------------------------------------- G2 – G9, W4, W5
@register("overview_kpis", ops="G2 M9 M10", sql=W_REC + f"""
SELECT avg_health, avg_hallucination, avg_drift, evaluations, {band_sql('avg_health')} AS health_band,
       CASE WHEN avg_drift IS NULL THEN 'BUILDING BASELINE' WHEN avg_drift < 0.15 THEN 'STABLE'
            ELSE 'DRIFTING' END AS drift_status
FROM (SELECT CAST(floor(avg(health_score)) AS INTEGER) AS avg_health,
             round(avg(hallucination_score), 9) AS avg_hallucination,
             round(avg(drift_score), 9) AS avg_drift, count(*) AS evaluations
      FROM {_latest(K.DASHBOARD_WINDOW)} l) k""")
def overview_kpis(spark, sf):
    df = A.overview_kpis(bridge.records(spark, sf))
    return df.withColumn("avg_hallucination", r9("avg_hallucination")).withColumn("avg_drift", r9("avg_drift"))


@register("aggregate_health_by_app_model", ops="G3", sql=W_REC + """
SELECT app_name, model_name,
       coalesce(CAST(round_even(avg(CASE WHEN health_score > 0 THEN health_score END), 0) AS INTEGER), 50)
         AS aggregate_health, count(*) AS records
FROM v_rec GROUP BY app_name, model_name""")
def aggregate_health_by_app_model(spark, sf):
    return A.aggregate_health(bridge.records(spark, sf), by=["app_name", "model_name"])


@register("hallucination_by_model", ops="G4", sql=W_REC + f"""
SELECT model_name, round(avg(hallucination_score), 9) AS avg_hallucination, count(*) AS records,
       avg(hallucination_score) > 0.3 AS above_threshold
FROM {_latest(K.DASHBOARD_WINDOW)} l GROUP BY model_name""")
def hallucination_by_model(spark, sf):
    return A.hallucination_by_model(bridge.records(spark, sf)).withColumn("avg_hallucination",
                                                                          r9("avg_hallucination"))


@register("hallucination_histogram", ops="G5", sql=W_REC + """
SELECT d.bin, d.bin / 25.0::DOUBLE AS bin_start, (d.bin + 1) / 25.0::DOUBLE AS bin_end,
       CAST(coalesce(c.count, 0) AS BIGINT) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(25)) d
LEFT JOIN (SELECT CAST(greatest(least(floor(hallucination_score * 25.0::DOUBLE), 24), 0) AS INTEGER) AS bin,
                  count(*) AS count
           FROM v_rec WHERE hallucination_score IS NOT NULL GROUP BY 1) c ON d.bin = c.bin""")
def hallucination_histogram(spark, sf):
    return A.score_histogram(bridge.records(spark, sf), "hallucination_score", bins=25)


@register("toxicity_histogram_by_app", ops="G5 (per app, 30 bins)", sql=W_REC + """
SELECT k.app_name, k.bin, k.bin / 30.0::DOUBLE AS bin_start, (k.bin + 1) / 30.0::DOUBLE AS bin_end,
       CAST(coalesce(c.count, 0) AS BIGINT) AS count
FROM (SELECT a.app_name, CAST(r.range AS INTEGER) AS bin
      FROM (SELECT DISTINCT app_name FROM v_rec WHERE toxicity_score IS NOT NULL) a, range(30) r) k
LEFT JOIN (SELECT app_name, CAST(greatest(least(floor(toxicity_score * 30.0::DOUBLE), 29), 0) AS INTEGER) AS bin,
                  count(*) AS count
           FROM v_rec WHERE toxicity_score IS NOT NULL GROUP BY 1, 2) c
  ON k.app_name = c.app_name AND k.bin = c.bin""")
def toxicity_histogram_by_app(spark, sf):
    return A.score_histogram(bridge.records(spark, sf), "toxicity_score", bins=30, by=["app_name"])


@register("language_distribution", ops="G6", sql=W_REC + """
SELECT language_detected AS language, count(*) AS count FROM v_rec GROUP BY 1""")
def language_distribution(spark, sf):
    return A.language_distribution(bridge.records(spark, sf))


@register("denial_rate_by_app", ops="G7", sql=W_REC + """
SELECT app_name, CAST(count_if(is_denial) AS BIGINT) AS denials, count(*) AS total,
       round(count_if(is_denial) / count(*), 9) AS denial_rate
FROM v_rec GROUP BY app_name""")
def denial_rate_by_app(spark, sf):
    return A.denial_rate(bridge.records(spark, sf), by=["app_name"]).withColumn("denial_rate", r9("denial_rate"))


_RAG = ["faithfulness_score", "context_relevance", "answer_relevancy", "groundedness_score"]


@register("rag_radar_means", ops="G8", sql=W_REC + f"""
SELECT {", ".join(f"round(avg(coalesce({c}, 0.0::DOUBLE)), 9) AS avg_{c}" for c in _RAG)},
       count(*) AS rag_records
FROM {_latest(K.DASHBOARD_WINDOW)} l WHERE groundedness_score IS NOT NULL""")
def rag_radar_means(spark, sf):
    df = A.rag_means(R.latest_n(bridge.records(spark, sf), K.DASHBOARD_WINDOW))
    for c in _RAG:
        df = df.withColumn(f"avg_{c}", r9(f"avg_{c}"))
    return df


@register("live_stats", ops="G9", sql=W_REC + f"""
SELECT t.total, l.avg_health, l.avg_hallucination, l.avg_toxicity, l.denials, l.window_records,
       CASE WHEN l.avg_health >= 90 THEN 'Healthy' WHEN l.avg_health >= 75 THEN 'Monitoring'
            WHEN l.avg_health >= 60 THEN 'Degrading' ELSE 'Critical' END AS status
FROM (SELECT count(*) AS total FROM v_rec) t,
     (SELECT CAST(floor(avg(health_score)) AS INTEGER) AS avg_health,
             round(avg(hallucination_score), 9) AS avg_hallucination,
             round(avg(toxicity_score), 9) AS avg_toxicity,
             CAST(count_if(is_denial) AS BIGINT) AS denials, count(*) AS window_records
      FROM {_latest(K.LIVE_STATS_WINDOW)} x) l""")
def live_stats(spark, sf):
    df = A.live_stats(bridge.records(spark, sf))
    return df.withColumn("avg_hallucination", r9("avg_hallucination")).withColumn("avg_toxicity",
                                                                                  r9("avg_toxicity"))


@register("health_timeline", ops="W4", sql=W_REC + f"""
SELECT id, "timestamp", strftime("timestamp", '%m-%d %H:%M') AS label, health_score, sentiment_score,
       toxicity_score FROM {_latest(K.DASHBOARD_WINDOW)} l""")
def health_timeline(spark, sf):
    return A.timeline(bridge.records(spark, sf), ["health_score", "sentiment_score", "toxicity_score"])


@register("drift_timeline", ops="W4 (drift rows only)", sql=W_REC + f"""
SELECT id, "timestamp", strftime("timestamp", '%m-%d %H:%M') AS label, drift_score
FROM {_latest(K.DASHBOARD_WINDOW)} l WHERE drift_score IS NOT NULL""")
def drift_timeline(spark, sf):
    return A.timeline(bridge.records(spark, sf), ["drift_score"], require="drift_score")


@register("trend_axis", ops="W5 M10", sql=W_REC + f"""
SELECT health_axis_min, drift_axis_max, avg_drift,
       CASE WHEN avg_drift IS NULL THEN NULL WHEN avg_drift < 0.1 THEN 'Stable'
            WHEN avg_drift < 0.2 THEN 'Minor drift' ELSE 'Significant drift!' END AS drift_status
FROM (SELECT greatest(0, min(health_score) - 10) AS health_axis_min,
             round(greatest(max(drift_score) * 1.2::DOUBLE, 0.3::DOUBLE), 9) AS drift_axis_max,
             round(avg(drift_score), 9) AS avg_drift
      FROM {_latest(K.DASHBOARD_WINDOW)} l) a""")
def trend_axis(spark, sf):
    df = A.trend_axis(bridge.records(spark, sf))
    return df.withColumn("drift_axis_max", r9("drift_axis_max")).withColumn("avg_drift", r9("avg_drift"))


@register("csv_export_rows", ops="S9 (export projection)", sql=W_REC + f"""
SELECT {", ".join('"timestamp"' if c == "timestamp" else c for c in K.CSV_EXPORT_COLUMNS)}
FROM {_latest(K.CSV_EXPORT_ROWS)} l""")
def csv_export_rows(spark, sf):
    from ternlens.sources.records_io import export_projection
    return export_projection(bridge.records(spark, sf))


@register("rag_timeline", ops="W4 (RAG trio over RAG rows, null shown as 0)", sql=W_REC + f"""
SELECT id, "timestamp", strftime("timestamp", '%m-%d %H:%M') AS label,
       coalesce(faithfulness_score, 0.0) AS faithfulness, coalesce(context_relevance, 0.0) AS context_relevance,
       coalesce(groundedness_score, 0.0) AS groundedness
FROM {_latest(K.DASHBOARD_WINDOW)} l WHERE groundedness_score IS NOT NULL""")
def rag_timeline(spark, sf):
    t = A.timeline(bridge.records(spark, sf), ["faithfulness_score", "context_relevance", "groundedness_score"],
                   require="groundedness_score")
    return t.select("id", "timestamp", "label",
                    F.coalesce("faithfulness_score", F.lit(0.0)).alias("faithfulness"),
                    F.coalesce("context_relevance", F.lit(0.0)).alias("context_relevance"),
                    F.coalesce("groundedness_score", F.lit(0.0)).alias("groundedness"))


@register("hallucination_timeline", ops="W4 (hallucination rate over time)", sql=W_REC + f"""
SELECT id, "timestamp", strftime("timestamp", '%m-%d %H:%M') AS label, hallucination_score,
       hallucination_score > 0.3 AS above_threshold
FROM {_latest(K.DASHBOARD_WINDOW)} l""")
def hallucination_timeline(spark, sf):
    t = A.timeline(bridge.records(spark, sf), ["hallucination_score"])
    return t.withColumn("above_threshold", F.col("hallucination_score") > F.lit(K.MODEL_HALLUCINATION_FLAG))
