"""The bridge views and score formulas written once more as DuckDB SQL.

These feed the oracle strings of ``ternlens.plans.catalog``: the oracle must
reach its numbers independently of the Spark code, so nothing here is shared
with the Spark side except the fixed values.
"""

from __future__ import annotations

from ternlens import constants as K
from ternlens.sources.bridge import CHAT_PREFIXES


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def health_sql(h="hallucination_score", d="drift_score", g="groundedness_score", f="faithfulness_score",
               t="toxicity_score", s="sentiment_score", den="is_denial") -> str:
    W = K.HEALTH_WEIGHTS
    rag = f"coalesce({g}, {f})"
    q = (f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1.0::DOUBLE - {t}) * 0.5::DOUBLE + {s} * 0.4::DOUBLE"
         f" + (1.0::DOUBLE - CASE WHEN {den} THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) * 0.1::DOUBLE))")
    comps = [(f"(1.0::DOUBLE - {h})", W["hallucination"]), (f"(1.0::DOUBLE - {d})", W["drift"]),
             (rag, W["rag"]), (q, W["quality"])]
    tw = " + ".join(f"(CASE WHEN {x} IS NOT NULL THEN {w}::DOUBLE ELSE 0.0::DOUBLE END)" for x, w in comps)
    acc = " + ".join(f"coalesce({x} * ({w}::DOUBLE / ({tw})), 0.0::DOUBLE)" for x, w in comps)
    return (f"CAST(greatest(0.0::DOUBLE, least(100.0::DOUBLE, round_even(({acc}) * 100.0::DOUBLE, 0))) AS INTEGER)")


def quality_sql(t="toxicity_score", s="sentiment_score", den="is_denial") -> str:
    return (f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1.0::DOUBLE - {t}) * 0.5::DOUBLE + {s} * 0.4::DOUBLE"
            f" + (1.0::DOUBLE - CASE WHEN {den} THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) * 0.1::DOUBLE))")


def band_sql(h="health_score") -> str:
    return (f"CASE WHEN {h} >= 90 THEN 'HEALTHY' WHEN {h} >= 75 THEN 'MONITORING' "
            f"WHEN {h} >= 60 THEN 'DEGRADING' ELSE 'CRITICAL' END")


_REC_BASE = """
SELECT CAST(event_id AS VARCHAR) AS id,
       'app_' || CAST(user_id % 5 AS VARCHAR) AS app_name,
       CAST(ts AS TIMESTAMP) AS "timestamp",
       event_type AS query,
       CAST(NULL AS VARCHAR) AS context,
       concat_ws(' ', event_type, props) AS response,
       'model_' || CAST(event_id % 3 AS VARCHAR) AS model_name,
       CAST(floor(value) AS INTEGER) AS latency_ms,
       ((event_id * 37) % 1000) / 1000.0::DOUBLE AS hallucination_score,
       'embedding' AS hallucination_method,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE ((event_id * 53) % 1000) / 1000.0::DOUBLE END AS drift_score,
       CASE WHEN event_id % 10 < 3 THEN NULL ELSE ((event_id * 61) % 1000) / 1000.0::DOUBLE END AS faithfulness_score,
       CASE WHEN event_id % 10 < 3 THEN NULL ELSE ((event_id * 67) % 1000) / 1000.0::DOUBLE END AS context_relevance,
       CASE WHEN event_id % 10 < 3 THEN NULL ELSE ((event_id * 71) % 1000) / 1000.0::DOUBLE END AS answer_relevancy,
       CASE WHEN event_id % 10 < 3 THEN NULL ELSE
            0.4::DOUBLE * (((event_id * 61) % 1000) / 1000.0::DOUBLE)
          + 0.3::DOUBLE * (((event_id * 67) % 1000) / 1000.0::DOUBLE)
          + 0.3::DOUBLE * (((event_id * 71) % 1000) / 1000.0::DOUBLE) END AS groundedness_score,
       ((event_id * 73) % 1000) / 1000.0::DOUBLE AS sentiment_score,
       ((event_id * 79) % 200) / 2000.0::DOUBLE AS toxicity_score,
       CAST(event_id % 180 + 20 AS INTEGER) AS response_length,
       CASE event_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS language_detected,
       (event_type = 'error' AND event_id % 4 = 0) AS is_denial,
       CAST(ts AS TIMESTAMP) AS created_at
FROM events
"""

V_REC = f"v_rec AS (SELECT *, {health_sql()} AS health_score FROM ({_REC_BASE}) b)"

_prefix_case = "CASE conv_id % 6 " + " ".join(
    f"WHEN {i} THEN {sql_str(p)}" for i, p in enumerate(CHAT_PREFIXES)) + " END"

V_EVT = f"""v_evt AS (
  SELECT CAST(p.conv_id AS VARCHAR) || '-' || CAST(p.turn AS VARCHAR) AS id,
         'chat_' || CAST(p.conv_id % 4 AS VARCHAR) AS app_name,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(p.conv_id * 100 + p.turn AS BIGINT)) AS "timestamp",
         p.text AS query,
         d.text AS context,
         ({_prefix_case.replace('conv_id', 'p.conv_id')}) || p.next_text AS response,
         'model_' || CAST(p.conv_id % 3 AS VARCHAR) AS model_name,
         0 AS latency_ms
  FROM (SELECT conv_id, turn, role, text,
               lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
               lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
        FROM conversations) p
  LEFT JOIN documents d ON p.conv_id = d.doc_id AND p.conv_id % 2 = 0
  WHERE p.role = 'user' AND p.next_role = 'assistant')"""

V_VEC = """v_vec AS (
  SELECT vec_id AS id, 'app_' || CAST(label AS VARCHAR) AS app_name,
         CAST(embedding AS DOUBLE[]) AS vector
  FROM embeddings)"""

V_GOLD = """v_gold AS (
  SELECT b.item_id, b.text AS query, '' AS expected_response,
         CASE WHEN b.item_id % 2 = 0 THEN b.text END AS context,
         0.2::DOUBLE + CAST(b.item_id % 5 AS DOUBLE) * 0.1::DOUBLE AS max_hallucination,
         0.1::DOUBLE AS max_toxicity,
         CASE WHEN b.item_id % 2 = 0 THEN 0.5::DOUBLE END AS min_faithfulness,
         CASE WHEN b.item_id % 3 = 0 THEN 'en' END AS expected_language,
         CASE WHEN b.item_id % 11 = 0 THEN NULL WHEN b.item_id % 8 = 0 THEN ''
              ELSE coalesce(d.text, '') END AS response,
         (b.item_id % 11 = 0) AS call_failed
  FROM benchmark b LEFT JOIN documents d ON b.item_id = d.doc_id)"""

V_KB = """kb_tok AS (
  SELECT t AS tok FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS t FROM benchmark)
  WHERE length(t) >= 5),
kb_top AS (
  SELECT tok AS key, row_number() OVER (ORDER BY n DESC, tok ASC) AS key_pos
  FROM (SELECT tok, count(*) AS n FROM kb_tok GROUP BY tok)),
v_kb AS (
  SELECT k.key, k.key_pos, arg_min(b.text, b.item_id) AS document
  FROM kb_top k JOIN benchmark b ON instr(lower(b.text), k.key) > 0
  GROUP BY k.key, k.key_pos)"""


def with_views(*views: str) -> str:
    rec = any("UNION ALL" in v and "fires" in v for v in views)
    return ("WITH RECURSIVE " if rec else "WITH ") + ",\n".join(views) + "\n"
