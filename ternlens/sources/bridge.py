"""Bridge views: the given tables re-shaped into this library's data model.

* ``records``      (V_REC)  scored-call records derived from ``events``
* ``chat_events``  (V_EVT)  unscored call events derived from ``conversations``
* ``vectors``      (V_VEC)  keyed embedding vectors from ``embeddings``
* ``golden``       (V_GOLD) golden examples and candidate answers from ``benchmark``
* ``knowledge_base`` (V_KB) keyword → passage table derived from ``benchmark``

Each is a lazy DataFrame; everything downstream stays one Catalyst plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ternlens.functions import scores as S
from ternlens.operators.retrieval import key_occurrences
from ternlens.operators.sequence import next_in_order, numbered
from ternlens.sources.tables import table

# Phrases prepended to assistant turns (chosen by conv_id % 6) so refusal,
# sentiment and claim detectors see real hits in the invented prose.
CHAT_PREFIXES = [
    "",
    "I cannot provide medical advice. ",
    "As an AI language model, I think this is a great and helpful question. ",
    "I'm unable to access that system, sorry. ",
    "Python was created by Guido van Rossum in 1991 and it is useful. ",
    "This answer is terrible, broken and wrong. ",
]


def _frac(e: Column, mult: int, mod: int, div: float) -> Column:
    return ((e * F.lit(mult)) % F.lit(mod)) / F.lit(float(div))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_REC: one scored record per event row (health computed by the M8 operator)."""
    ev = table(spark, sf_dir, "events")
    e = F.col("event_id")
    rag_null = (e % 10) < 3
    f = _frac(e, 61, 1000, 1000)
    c = _frac(e, 67, 1000, 1000)
    a = _frac(e, 71, 1000, 1000)
    lang = (F.when(e % 4 == 0, "en").when(e % 4 == 1, "fr").when(e % 4 == 2, "de").otherwise("es"))
    ts = F.col("ts").cast("timestamp")
    df = ev.select(
        e.cast("string").alias("id"),
        F.concat(F.lit("app_"), (F.col("user_id") % 5).cast("string")).alias("app_name"),
        ts.alias("timestamp"),
        F.col("event_type").alias("query"),
        F.lit(None).cast("string").alias("context"),
        F.concat_ws(" ", F.col("event_type"), F.col("props")).alias("response"),
        F.concat(F.lit("model_"), (e % 3).cast("string")).alias("model_name"),
        F.floor(F.col("value")).cast("int").alias("latency_ms"),
        F.array().cast("array<string>").alias("tags"),
        _frac(e, 37, 1000, 1000).alias("hallucination_score"),
        F.lit("embedding").alias("hallucination_method"),
        F.array().cast("array<string>").alias("flagged_claims"),
        F.array().cast("array<double>").alias("embedding_vector"),
        F.when(e % 7 == 0, F.lit(None).cast("double")).otherwise(_frac(e, 53, 1000, 1000)).alias("drift_score"),
        F.when(rag_null, F.lit(None).cast("double")).otherwise(f).alias("faithfulness_score"),
        F.when(rag_null, F.lit(None).cast("double")).otherwise(c).alias("context_relevance"),
        F.when(rag_null, F.lit(None).cast("double")).otherwise(a).alias("answer_relevancy"),
        F.when(rag_null, F.lit(None).cast("double"))
         .otherwise(F.lit(0.4) * f + F.lit(0.3) * c + F.lit(0.3) * a).alias("groundedness_score"),
        _frac(e, 73, 1000, 1000).alias("sentiment_score"),
        _frac(e, 79, 200, 2000).alias("toxicity_score"),
        (e % 180 + 20).cast("int").alias("response_length"),
        lang.alias("language_detected"),
        ((F.col("event_type") == "error") & (e % 4 == 0)).alias("is_denial"),
        ts.alias("created_at"),
    )
    return df.withColumn("health_score", S.health_score())


def chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_EVT: a user turn directly followed by an assistant turn is one call."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pairs = (next_in_order(conv, "conv_id", "turn", ["role", "text"])
             .where((F.col("role") == "user") & (F.col("next_role") == "assistant")))
    prefix = F.element_at(F.array(*[F.lit(p) for p in CHAT_PREFIXES]), (F.col("conv_id") % 6 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text").alias("doc_text"))
    joined = pairs.join(docs, (pairs.conv_id == docs.doc_id) & (pairs.conv_id % 2 == 0), "left")
    minutes = F.col("conv_id") * 100 + F.col("turn")
    return joined.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.concat(F.lit("chat_"), (F.col("conv_id") % 4).cast("string")).alias("app_name"),
        F.timestamp_seconds(F.lit(1704067200) + minutes * 60).alias("timestamp"),
        F.col("text").alias("query"),
        F.col("doc_text").alias("context"),
        F.concat(prefix, F.col("next_text")).alias("response"),
        F.concat(F.lit("model_"), (F.col("conv_id") % 3).cast("string")).alias("model_name"),
        F.lit(0).alias("latency_ms"),
        F.array().cast("array<string>").alias("tags"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_VEC: (id, app_name, vector) with arrival order = id."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("app_"), F.col("label").cast("string")).alias("app_name"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_GOLD: golden examples with thresholds, plus the candidate answer.

    ``response`` is null where the system under test failed (item_id % 11 = 0)
    and blank where it answered nothing (item_id % 8 = 0).
    """
    b = table(spark, sf_dir, "benchmark")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("doc_text"))
    k = F.col("item_id")
    j = b.join(docs, b.item_id == docs.doc_id, "left")
    response = (F.when(k % 11 == 0, F.lit(None).cast("string"))
                .when(k % 8 == 0, F.lit(""))
                .otherwise(F.coalesce(F.col("doc_text"), F.lit(""))))
    return j.select(
        k.alias("item_id"),
        F.col("text").alias("query"),
        F.lit("").alias("expected_response"),
        F.when(k % 2 == 0, F.col("text")).alias("context"),
        (F.lit(0.2) + (k % 5).cast("double") * F.lit(0.1)).alias("max_hallucination"),
        F.lit(0.1).alias("max_toxicity"),
        F.when(k % 2 == 0, F.lit(0.5)).alias("min_faithfulness"),
        F.when(k % 3 == 0, F.lit("en")).alias("expected_language"),
        response.alias("response"),
        (k % 11 == 0).alias("call_failed"),
    )


def knowledge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_KB: every long token of ``benchmark`` as a retrieval key, the most frequent first.

    The document of a key is the text of the smallest item containing it.  Keys are ranked by a
    range partitioning, whatever their number.
    """
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    counted = (b.select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("key"))
               .where(F.length("key") >= 5).groupBy("key").agg(F.count(F.lit(1)).alias("_n")))
    ranked = numbered(counted, [F.desc("_n"), F.asc("key")], "key_pos").drop("_n")
    found = key_occurrences(b.withColumn("text", F.lower("text")), "item_id", "text", ranked)
    first = found.groupBy("key", "key_pos").agg(F.min("item_id").alias("item_id"))
    return first.join(b, "item_id").select("key", "key_pos", F.col("text").alias("document"))
