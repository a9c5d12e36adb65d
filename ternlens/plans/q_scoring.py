"""Queries for the scoring chain over chat events (V_EVT): M1–M8, P1–P5, S2, J1, J3.

The oracle recomputes every embedding from hashed token counts in SQL, so the
whole evaluate chain (quality, hallucination, RAG with sentence faithfulness,
online drift, health) is checked end to end against an independent engine.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ternlens import constants as K
from ternlens.functions import scores as S
from ternlens.functions import text as TX
from ternlens.operators import analytics as A
from ternlens.operators import retrieval as RT
from ternlens.operators import scoring as SC
from ternlens.plans.catalog import r9, register
from ternlens.plans.q_models import text_model_columns, text_models_sql, with_text_models
from ternlens.plans.q_text import (blank_sql, claims_sql, denial_sql, sentences_sql, sentiment_sql,
                                   strip_sql, word_count_sql)
from ternlens.plans.q_vectors import DIM, bucket_counts_sql, dense_sql
from ternlens.plans.sqlviews import V_EVT, V_KB, health_sql, with_views
from ternlens.sources import bridge
from ternlens.sources.conversations import conversation_events

ZERO = f"list_transform(range(0, {DIM}), lambda i: 0.0::DOUBLE)"


def _clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def _dot(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


def scored_sql(src: str = "v_evt", limits: K.TextLimits = K.WHOLE_TEXTS, models: bool = False) -> str:
    """CTEs ending in ``scored``: the evaluate chain in SQL over an event relation, with the learned
    toxicity and language of the responses if ``models``, else their defaults."""
    blank, short = blank_sql("e4.response"), f"length({strip_sql('e4.response')}) < {K.MIN_LANGUAGE_TEXT_CHARS}"
    tox, lang, learned, joined = "0.0::DOUBLE", "'en'", "", ""
    if models:
        tox = f"CASE WHEN {blank} THEN 0.0::DOUBLE ELSE coalesce(tox.toxicity, 0.0::DOUBLE) END"
        lang = f"CASE WHEN {blank} OR {short} THEN 'en' ELSE coalesce(langs.lang, 'en') END"
        learned = text_models_sql("ev", "id", "response") + ",\n"
        joined = " LEFT JOIN tox ON tox.mid = e4.id LEFT JOIN langs ON langs.mid = e4.id"
    def cut(x: str) -> str:
        return x if limits.rag_chars is None else f"substring({x}, 1, {limits.rag_chars})"
    first = "" if limits.rag_sentences is None else f"[1:{limits.rag_sentences}]"
    return f"""ev AS (
  SELECT *, {cut("query")} AS q10, {cut("coalesce(context, '')")} AS c10, {cut("response")} AS r10,
         (NOT {blank_sql('context')} AND NOT {blank_sql(cut('query'))}
          AND NOT {blank_sql(cut('response'))}) AS rag_ok
  FROM {src}),
sent AS (
  SELECT id, unnest(s) AS stext, unnest(range(1, len(s) + 1)) AS sidx
  FROM (SELECT id, ({sentences_sql('r10', K.RAG_MIN_SENTENCE_CHARS)}){first} AS s FROM ev WHERE rag_ok)),
txt AS (
  SELECT id || '|r' AS eid, response AS t FROM ev
  UNION ALL SELECT id || '|c', context FROM ev WHERE context IS NOT NULL AND context <> ''
  UNION ALL SELECT id || '|q', query FROM ev WHERE query IS NOT NULL AND query <> ''
  UNION ALL SELECT id || '|rq', q10 FROM ev WHERE rag_ok
  UNION ALL SELECT id || '|rc', c10 FROM ev WHERE rag_ok
  UNION ALL SELECT id || '|rr', r10 FROM ev WHERE rag_ok
  UNION ALL SELECT id || '|s' || CAST(sidx AS VARCHAR), stext FROM sent),
vec AS {dense_sql(bucket_counts_sql('txt', 'eid', 't'))},
e2 AS (
  SELECT ev.*, coalesce(vr.vec, {ZERO}) AS v_r,
         CASE WHEN ev.context IS NOT NULL AND ev.context <> '' THEN coalesce(vc.vec, {ZERO}) END AS v_c,
         CASE WHEN ev.query IS NOT NULL AND ev.query <> '' THEN coalesce(vq.vec, {ZERO}) END AS v_q,
         CASE WHEN rag_ok THEN coalesce(rq.vec, {ZERO}) END AS rag_q,
         CASE WHEN rag_ok THEN coalesce(rc.vec, {ZERO}) END AS rag_c,
         CASE WHEN rag_ok THEN coalesce(rr.vec, {ZERO}) END AS rag_r
  FROM ev LEFT JOIN vec vr ON vr.eid = ev.id || '|r' LEFT JOIN vec vc ON vc.eid = ev.id || '|c'
          LEFT JOIN vec vq ON vq.eid = ev.id || '|q' LEFT JOIN vec rq ON rq.eid = ev.id || '|rq'
          LEFT JOIN vec rc ON rc.eid = ev.id || '|rc' LEFT JOIN vec rr ON rr.eid = ev.id || '|rr'),
ss AS (
  SELECT s.id, list({_clamp(_dot(f'coalesce(sv.vec, {ZERO})', 'e2.rag_c'))} ORDER BY s.sidx) AS sims
  FROM sent s JOIN e2 ON e2.id = s.id LEFT JOIN vec sv ON sv.eid = s.id || '|s' || CAST(s.sidx AS VARCHAR)
  GROUP BY s.id),
e3 AS (
  SELECT e2.*, ss.sims,
         CASE WHEN e2.v_c IS NOT NULL THEN {_clamp(f"(1.0::DOUBLE - {_dot('v_r', 'v_c')}) / 2.0::DOUBLE")}
              WHEN e2.v_q IS NOT NULL THEN {_clamp(f"(1.0::DOUBLE - {_dot('v_r', 'v_q')}) / 2.0::DOUBLE")} END AS emb,
         {_clamp(_dot('rag_q', 'rag_c'))} AS cr, {_clamp(_dot('rag_r', 'rag_c'))} AS fdoc,
         {_clamp(_dot('rag_q', 'rag_r'))} AS ar
  FROM e2 LEFT JOIN ss ON ss.id = e2.id),
e4 AS (
  SELECT *, CASE WHEN sims IS NOT NULL AND len(sims) > 0
                 THEN 0.6::DOUBLE * fdoc + 0.4::DOUBLE * (list_sum(sims) / CAST(len(sims) AS DOUBLE)) ELSE fdoc END AS f
  FROM e3),
dv AS (
  SELECT id, app_name, "timestamp", v_r,
         row_number() OVER (PARTITION BY app_name ORDER BY "timestamp", id) AS rk
  FROM e2 WHERE NOT {blank_sql('response')}),
du AS (SELECT id, app_name, rk, unnest(v_r) AS x, unnest(range(1, len(v_r) + 1)) AS pos FROM dv),
drs AS (SELECT id, rk, x, sum(x)
               OVER (PARTITION BY app_name, pos ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
        FROM du),
dd AS (SELECT id, CASE WHEN max(rk) < {K.MIN_DRIFT_BASELINE} THEN NULL ELSE round_even({_clamp(
        "(CASE WHEN sum(x * x) = 0 OR sum(s * s) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - sum(x * s) / (sqrt(sum(x * x)) * sqrt(sum(s * s))) END) / 2.0::DOUBLE")}, 4) END AS drift_score
       FROM drs GROUP BY id),
{learned}pre AS (
  SELECT e4.id, e4.app_name, e4.model_name, e4."timestamp", e4.response, e4.context,
         CASE WHEN {blank_sql('e4.response')} THEN 0.0::DOUBLE ELSE coalesce(round_even(e4.emb, 4), 0.0::DOUBLE) END AS hallucination_score,
         CASE WHEN {blank_sql('e4.response')} OR e4.emb IS NULL THEN 'none' ELSE 'embedding' END AS hallucination_method,
         CASE WHEN {blank_sql('e4.response')} THEN CAST([] AS VARCHAR[]) ELSE {claims_sql('e4.response', 'e4.context')} END AS flagged_claims,
         dd.drift_score,
         CASE WHEN e4.rag_ok THEN round_even(e4.f, 4) END AS faithfulness_score,
         CASE WHEN e4.rag_ok THEN round_even(e4.cr, 4) END AS context_relevance,
         CASE WHEN e4.rag_ok THEN round_even(e4.ar, 4) END AS answer_relevancy,
         CASE WHEN e4.rag_ok THEN round_even(e4.f * 0.4::DOUBLE + e4.cr * 0.3::DOUBLE + e4.ar * 0.3::DOUBLE, 4) END AS groundedness_score,
         {sentiment_sql('e4.response')} AS sentiment_score,
         {tox} AS toxicity_score,
         {word_count_sql('e4.response')} AS response_length,
         {lang} AS language_detected,
         {denial_sql('e4.response')} AS is_denial
  FROM e4 LEFT JOIN dd ON dd.id = e4.id{joined}),
scored AS (SELECT *, {health_sql()} AS health_score FROM pre)"""


def scored_chat(spark, sf):
    """The evaluate chain over the chat events, with learned toxicity and language."""
    return SC.evaluate(with_text_models(spark, sf, bridge.chat_events(spark, sf)), **text_model_columns())


_SCORED_COLS = ["id", "app_name", "hallucination_score", "hallucination_method", "drift_score",
                "faithfulness_score", "context_relevance", "answer_relevancy", "groundedness_score",
                "sentiment_score", "toxicity_score", "response_length", "language_detected", "is_denial",
                "health_score"]


@register("chat_records_scored", ops="P1 P3 P4 P5 M1 M2 M3 M4 M5 M6 M8 T8 W1 (evaluate)",
          sql=with_views(V_EVT, scored_sql(models=True)) + f"""
SELECT {", ".join(_SCORED_COLS)}, CAST(len(flagged_claims) AS INTEGER) AS n_claims FROM scored""")
def chat_records_scored(spark, sf):
    rec = scored_chat(spark, sf)
    return rec.select(*_SCORED_COLS, F.size("flagged_claims").alias("n_claims"))


@register("repeated_chat_records", ops="P5 W1 (events delivered twice are two records each)", sql=with_views(
    V_EVT.replace("v_evt AS (", "v_once AS (", 1), """v_evt AS (SELECT * FROM v_once)""",
    scored_sql("(SELECT * REPLACE (id || '|' || CAST(copy AS VARCHAR) AS id) FROM v_evt, (VALUES (1), (2)) c(copy))")) + """
SELECT split_part(id, '|', 1) AS id, app_name, hallucination_score, drift_score, health_score FROM scored""")
def repeated_chat_records(spark, sf):
    ev = bridge.chat_events(spark, sf)
    return SC.evaluate(ev.union(ev)).select("id", "app_name", "hallucination_score", "drift_score", "health_score")


@register("app_health_overview", ops="flagship: S2/V_EVT → P5 → M8 → G3 per app",
          sql=with_views(V_EVT, scored_sql(models=True)) + """
SELECT app_name, count(*) AS records,
       coalesce(CAST(round_even(avg(CASE WHEN health_score > 0 THEN health_score END), 0) AS INTEGER), 50) AS aggregate_health,
       round(avg(hallucination_score), 9) AS avg_hallucination, round(avg(drift_score), 9) AS avg_drift,
       round(avg(groundedness_score), 9) AS avg_groundedness, round(avg(toxicity_score), 9) AS avg_toxicity,
       CAST(count(DISTINCT language_detected) AS BIGINT) AS languages, CAST(count_if(is_denial) AS BIGINT) AS denials,
       CAST(count_if(len(flagged_claims) > 0) AS BIGINT) AS flagged_records
FROM scored GROUP BY app_name""")
def app_health_overview(spark, sf):
    rec = scored_chat(spark, sf)
    agg = rec.groupBy("app_name").agg(
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.bround(F.avg(F.when(F.col("health_score") > 0, F.col("health_score"))), 0).cast("int"),
                   F.lit(K.NEUTRAL_HEALTH)).alias("aggregate_health"),
        r9(F.avg("hallucination_score")).alias("avg_hallucination"),
        r9(F.avg("drift_score")).alias("avg_drift"),
        r9(F.avg("groundedness_score")).alias("avg_groundedness"),
        r9(F.avg("toxicity_score")).alias("avg_toxicity"),
        F.size(F.collect_set("language_detected")).cast("long").alias("languages"),
        F.count_if(F.col("is_denial")).alias("denials"),
        F.count_if(F.size("flagged_claims") > 0).alias("flagged_records"))
    return agg


@register("rag_quality_scores", ops="M3 M4 M5 (RAG calls only)", sql=with_views(V_EVT, scored_sql()) + """
SELECT id, faithfulness_score, context_relevance, answer_relevancy, groundedness_score
FROM scored WHERE groundedness_score IS NOT NULL""")
def rag_quality_scores(spark, sf):
    ev = SC.event_to_record(SC.normalize_events(bridge.chat_events(spark, sf)))
    rec = SC.rag_scores(SC.with_embeddings(ev))
    return rec.where(F.col("groundedness_score").isNotNull()).select(
        "id", "faithfulness_score", "context_relevance", "answer_relevancy", "groundedness_score")


@register("rag_quality_scores_parity", ops="M3 M4 M5 (first 10 000 characters and 10 sentences)",
          sql=with_views(V_EVT, scored_sql(limits=K.PARITY_LIMITS)) + """
SELECT id, faithfulness_score, context_relevance, answer_relevancy, groundedness_score
FROM scored WHERE groundedness_score IS NOT NULL""")
def rag_quality_scores_parity(spark, sf):
    ev = SC.event_to_record(SC.normalize_events(bridge.chat_events(spark, sf)))
    rec = SC.rag_scores(SC.with_embeddings(ev, limits=K.PARITY_LIMITS))
    return rec.where(F.col("groundedness_score").isNotNull()).select(
        "id", "faithfulness_score", "context_relevance", "answer_relevancy", "groundedness_score")


@register("hallucination_scores", ops="M1 M2 T8", sql=with_views(V_EVT, scored_sql()) + """
SELECT id, hallucination_score, hallucination_method, flagged_claims FROM scored""")
def hallucination_scores(spark, sf):
    ev = SC.event_to_record(SC.normalize_events(bridge.chat_events(spark, sf)))
    rec = SC.hallucination_scores(SC.with_embeddings(ev))
    return rec.select("id", "hallucination_score", "hallucination_method", "flagged_claims")


@register("response_quality", ops="M6 T1 T2 T4 T5 T6", sql=with_views(V_EVT, scored_sql(models=True)) + """
SELECT id, sentiment_score, toxicity_score, response_length, language_detected, is_denial FROM scored""")
def response_quality(spark, sf):
    ev = SC.event_to_record(SC.normalize_events(bridge.chat_events(spark, sf)))
    rec = SC.quality_scores(with_text_models(spark, sf, ev), **text_model_columns())
    return rec.select("id", "sentiment_score", "toxicity_score", "response_length", "language_detected",
                      "is_denial")


@register("chat_quality_subscores", ops="M7 M9", sql=with_views(V_EVT, scored_sql(models=True)) + f"""
SELECT id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1.0::DOUBLE - toxicity_score) * 0.5::DOUBLE
           + sentiment_score * 0.4::DOUBLE + (1.0::DOUBLE - CASE WHEN is_denial THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)
           * 0.1::DOUBLE)), 9) AS quality_subscore,
       CASE WHEN health_score >= 90 THEN 'HEALTHY' WHEN health_score >= 75 THEN 'MONITORING'
            WHEN health_score >= 60 THEN 'DEGRADING' ELSE 'CRITICAL' END AS health_band
FROM scored""")
def chat_quality_subscores(spark, sf):
    rec = scored_chat(spark, sf)
    return rec.select("id", r9(S.quality_subscore()).alias("quality_subscore"), S.health_band().alias("health_band"))


@register("chat_drift_timeline", ops="W1 W4 (drift of chat responses)", sql=with_views(V_EVT, scored_sql()) + """
SELECT id, app_name, strftime("timestamp", '%m-%d %H:%M') AS label, drift_score FROM scored
WHERE drift_score IS NOT NULL""")
def chat_drift_timeline(spark, sf):
    rec = SC.evaluate(bridge.chat_events(spark, sf))
    return (rec.where(F.col("drift_score").isNotNull())
            .select("id", "app_name", F.date_format("timestamp", "MM-dd HH:mm").alias("label"), "drift_score"))


# ---------------------------------------------------------------- S2 conversations → events
@register("conversation_events", ops="S2 (conversations → call events, system turn as context)", sql="""
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, 'support_bot' AS app_name,
       'unknown' AS model_name, text AS query, ctx AS context, coalesce(next_text, '') AS response
FROM (SELECT conv_id, turn, role, text,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
             lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text,
             ctx
      FROM conversations LEFT JOIN (SELECT conv_id AS cid, arg_min(text, turn) AS ctx FROM conversations
                                    WHERE role = 'system' GROUP BY conv_id) s ON s.cid = conversations.conv_id)
WHERE role = 'user' AND next_role = 'assistant'""")
def conversation_events_q(spark, sf):
    ev = conversation_events(spark, sf, app="support_bot")
    return ev.select("id", "app_name", "model_name", "query", "context", "response")


@register("record_validation", ops="P2 (violations on perturbed records)", sql=with_views(V_EVT, scored_sql()) + """
SELECT id, list_filter([CASE WHEN latency_ms < 0 THEN 'latency_ms negative' END,
                        CASE WHEN hallucination_score > 1 THEN 'hallucination_score out of [0, 1]' END,
                        CASE WHEN health_score > 100 THEN 'health_score out of [0, 100]' END], lambda x: x IS NOT NULL)
         AS violations
FROM (SELECT id, CASE WHEN hash_pos % 5 = 0 THEN -1 ELSE 0 END AS latency_ms,
             CASE WHEN hash_pos % 7 = 0 THEN hallucination_score + 1.5 ELSE hallucination_score END AS hallucination_score,
             CASE WHEN hash_pos % 11 = 0 THEN 101 ELSE health_score END AS health_score
      FROM (SELECT *, CAST(split_part(id, '-', 1) AS BIGINT) + CAST(split_part(id, '-', 2) AS BIGINT) AS hash_pos
            FROM scored))""")
def record_validation(spark, sf):
    rec = SC.evaluate(bridge.chat_events(spark, sf))
    pos = (F.split("id", "-").getItem(0).cast("long") + F.split("id", "-").getItem(1).cast("long"))
    bad = rec.withColumns({
        "latency_ms": F.when(pos % 5 == 0, F.lit(-1)).otherwise(F.lit(0)),
        "hallucination_score": F.when(pos % 7 == 0, F.col("hallucination_score") + 1.5)
                                .otherwise(F.col("hallucination_score")),
        "health_score": F.when(pos % 11 == 0, F.lit(101)).otherwise(F.col("health_score")),
    })
    return SC.validate_records(bad).select("id", "violations")


# ---------------------------------------------------------------- J1 keyword retrieval
@register("keyword_retrieval", ops="J1 (V_EVT.query × V_KB)", sql=with_views(V_EVT, V_KB) + """
SELECT e.id, coalesce(m.document, 'No relevant context found.') AS retrieved, CAST(m.key_pos AS INTEGER) AS key_pos
FROM v_evt e LEFT JOIN (
  SELECT e.id, arg_min(k.document, k.key_pos) AS document, min(k.key_pos) AS key_pos
  FROM v_evt e JOIN v_kb k ON instr(lower(e.query), k.key) > 0 GROUP BY e.id) m ON e.id = m.id""")
def keyword_retrieval(spark, sf):
    ev = bridge.chat_events(spark, sf).select("id", "query")
    kb = bridge.knowledge_base(spark, sf)
    return RT.keyword_retrieve(ev, kb, default="No relevant context found.").select("id", "retrieved", "key_pos")


# ---------------------------------------------------------------- P1 / P4 as their own queries
@register("normalized_document_events", ops="P1 (defaults, 200 000-char text limit, 50 tags × 100 chars)",
          sql="""
SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(source, 'default') AS app_name, substring(text, 1, 200000) AS response,
       coalesce(lang, 'unknown') AS model_name, [substring(lang, 1, 100), substring(source, 1, 100), substring(lang, 1, 100)] AS tags,
       CAST(length(substring(text, 1, 200000)) AS INTEGER) AS response_chars
FROM documents""")
def normalized_document_events(spark, sf):
    from ternlens.sources.tables import table
    d = table(spark, sf, "documents")
    ev = d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("app_name"),
                  F.lit(None).cast("timestamp").alias("timestamp"), F.lit(None).cast("string").alias("query"),
                  F.lit(None).cast("string").alias("context"), F.col("text").alias("response"),
                  F.col("lang").alias("model_name"), F.lit(None).cast("int").alias("latency_ms"),
                  F.array("lang", "source", "lang").alias("tags"))
    n = SC.normalize_events(ev, max_chars=K.MAX_TEXT_CHARS, max_tags=K.MAX_TAGS, max_tag_chars=K.MAX_TAG_CHARS)
    return n.select("id", "app_name", "response", "model_name", "tags",
                    F.length("response").alias("response_chars"))


@register("clamped_record_scores", ops="P4 (every score column clamped to [0, 1])", sql=with_views(V_EVT, scored_sql()) + """
SELECT id, greatest(0.0, least(1.0, hallucination_score * 3.0 - 1.0)) AS hallucination_score,
       CASE WHEN drift_score IS NULL THEN NULL ELSE greatest(0.0, least(1.0, drift_score * 4.0)) END AS drift_score,
       greatest(0.0, least(1.0, sentiment_score - 0.75)) AS sentiment_score
FROM scored""")
def clamped_record_scores(spark, sf):
    rec = SC.evaluate(bridge.chat_events(spark, sf))
    pushed = rec.select("id", (F.col("hallucination_score") * 3.0 - 1.0).alias("hallucination_score"),
                        (F.col("drift_score") * 4.0).alias("drift_score"),
                        (F.col("sentiment_score") - 0.75).alias("sentiment_score"))
    return SC.clamp_scores(pushed)
