"""Fixed schemas of the data model: events, scored records, alerts, golden sets."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("app_name", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("query", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("latency_ms", T.IntegerType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

SCORE_FIELDS = [
    T.StructField("hallucination_score", T.DoubleType()),
    T.StructField("hallucination_method", T.StringType()),
    T.StructField("flagged_claims", T.ArrayType(T.StringType())),
    T.StructField("embedding_vector", T.ArrayType(T.DoubleType())),
    T.StructField("drift_score", T.DoubleType()),
    T.StructField("faithfulness_score", T.DoubleType()),
    T.StructField("context_relevance", T.DoubleType()),
    T.StructField("answer_relevancy", T.DoubleType()),
    T.StructField("groundedness_score", T.DoubleType()),
    T.StructField("sentiment_score", T.DoubleType()),
    T.StructField("toxicity_score", T.DoubleType()),
    T.StructField("response_length", T.IntegerType()),
    T.StructField("language_detected", T.StringType()),
    T.StructField("is_denial", T.BooleanType()),
    T.StructField("health_score", T.IntegerType()),
]

RECORD_SCHEMA = T.StructType(list(EVENT_SCHEMA.fields) + SCORE_FIELDS)
STORED_RECORD_SCHEMA = T.StructType(list(RECORD_SCHEMA.fields) + [
    T.StructField("created_at", T.TimestampType()),
])

ALERT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("severity", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("message", T.StringType()),
    T.StructField("record_id", T.StringType()),
])

GOLDEN_EXAMPLE = T.StructType([
    T.StructField("position", T.LongType()),   # null in a document with all examples: their order
    T.StructField("query", T.StringType()),
    T.StructField("expected_response", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("max_hallucination", T.DoubleType()),
    T.StructField("min_faithfulness", T.DoubleType()),
    T.StructField("expected_language", T.StringType()),
    T.StructField("max_toxicity", T.DoubleType()),
])

GOLDEN_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("examples", T.ArrayType(GOLDEN_EXAMPLE)),
])

FAILURE_SCHEMA = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("expected_response", T.StringType()),
    T.StructField("actual_response", T.StringType()),
    T.StructField("violations", T.ArrayType(T.StringType())),
])

REGRESSION_RESULT_SCHEMA = T.StructType([
    T.StructField("dataset_name", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("total", T.LongType()),
    T.StructField("passed", T.LongType()),
    T.StructField("failed", T.LongType()),
    T.StructField("pass_rate", T.DoubleType()),
    T.StructField("failures", T.ArrayType(FAILURE_SCHEMA)),
])

TIME_SERIES_SCHEMA = T.StructType([
    T.StructField("time_bucket", T.StringType()),
    T.StructField("avg_value", T.DoubleType()),
    T.StructField("min_value", T.DoubleType()),
    T.StructField("max_value", T.DoubleType()),
    T.StructField("count", T.LongType()),
])
