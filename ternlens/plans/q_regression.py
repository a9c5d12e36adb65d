"""Queries for the regression suite over golden examples (V_GOLD): R1–R5, G10, J4, J5, S3, S4."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ternlens import constants as K
from ternlens.operators import regression as RG
from ternlens.plans.catalog import register
from ternlens.plans.q_models import text_model_columns, with_text_models
from ternlens.plans.q_scoring import scored_sql
from ternlens.plans.sqlviews import V_GOLD, with_views
from ternlens.session import checkpoint_dir, stage, unstage
from ternlens.sources import bridge
from ternlens.sources.golden import load_golden, load_regression_report, save_golden, save_regression_report
from ternlens.sources.tables import table

_FLAGS = K.ModuleFlags(drift=False)

_GOLD_EVENTS = """gev AS (
  SELECT CAST(item_id AS VARCHAR) AS id, 'regression' AS app_name, TIMESTAMP '2024-01-01 00:00:00' AS "timestamp",
         query, context, coalesce(response, '') AS response, 'unknown' AS model_name, 0 AS latency_ms
  FROM v_gold WHERE NOT call_failed)"""

_RESULTS = """res AS (
  SELECT g.item_id, g.query, g.expected_response, g.response, g.call_failed,
         CASE WHEN g.call_failed THEN ['LLM call failed: no response'] ELSE list_filter([
           CASE WHEN s.hallucination_score > g.max_hallucination THEN 'hallucination_score '
                || printf('%.2f', s.hallucination_score) || ' > max ' || CAST(g.max_hallucination AS VARCHAR) END,
           CASE WHEN s.toxicity_score > g.max_toxicity THEN 'toxicity_score '
                || printf('%.2f', s.toxicity_score) || ' > max ' || CAST(g.max_toxicity AS VARCHAR) END,
           CASE WHEN g.min_faithfulness IS NOT NULL AND s.faithfulness_score < g.min_faithfulness THEN
                'faithfulness_score ' || printf('%.2f', s.faithfulness_score) || ' < min ' || CAST(g.min_faithfulness AS VARCHAR) END,
           CASE WHEN g.expected_language IS NOT NULL AND g.expected_language <> '' AND s.language_detected <> ''
                     AND s.language_detected <> g.expected_language
                THEN 'language ' || s.language_detected || ' != expected ' || g.expected_language END,
           CASE WHEN regexp_replace(coalesce(g.response, ''), '[\\t\\n\\v\\f\\r \\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', '', 'g') = ''
                THEN 'empty response' END], lambda x: x IS NOT NULL) END AS violations
  FROM v_gold g LEFT JOIN scored s ON s.id = CAST(g.item_id AS VARCHAR))"""

_SQL = with_views(V_GOLD, _GOLD_EVENTS, scored_sql("gev", models=True), _RESULTS)


def _results(spark, sf):
    g = bridge.golden(spark, sf).withColumn("error", F.when(F.col("call_failed"), F.lit("no response")))
    return RG.run_suite(g, flags=_FLAGS, prepare=lambda ev: with_text_models(spark, sf, ev), **text_model_columns())


@register("regression_results", ops="R1 R2 J4 J5 T12", sql=_SQL + """
SELECT item_id, violations, len(violations) = 0 AS passed FROM res""")
def regression_results(spark, sf):
    return _results(spark, sf).select("item_id", "violations", "passed")


@register("regression_failures", ops="R4", sql=_SQL + f"""
SELECT item_id, query, CASE WHEN call_failed THEN '' ELSE expected_response END AS expected_response,
       CASE WHEN call_failed THEN '' ELSE substring(coalesce(response, ''), 1, {K.REGRESSION_RESPONSE_CHARS}) END
         AS actual_response, violations
FROM res WHERE len(violations) > 0""")
def regression_failures(spark, sf):
    return RG.suite_failures(_results(spark, sf))


@register("regression_summary", ops="R3 R5 G10", sql=_SQL + f"""
SELECT 'benchmark-golden' AS dataset_name, count(*) AS total, CAST(count_if(len(violations) = 0) AS BIGINT) AS passed,
       CAST(count(*) - count_if(len(violations) = 0) AS BIGINT) AS failed,
       CASE WHEN count(*) > 0 THEN round_even(count_if(len(violations) = 0) / count(*), 4) ELSE 0.0 END AS pass_rate,
       CASE WHEN count(*) > 0 THEN round_even(count_if(len(violations) = 0) / count(*), 4) ELSE 0.0 END
         >= {K.REGRESSION_GATE} AS gate_passed
FROM res""")
def regression_summary(spark, sf):
    return RG.suite_summary(_results(spark, sf), dataset_name="benchmark-golden")


_FAILURES = f"""
SELECT item_id, query, CASE WHEN call_failed THEN '' ELSE expected_response END AS expected_response,
       CASE WHEN call_failed THEN '' ELSE substring(coalesce(response, ''), 1, {K.REGRESSION_RESPONSE_CHARS}) END
         AS actual_response, violations
FROM res WHERE len(violations) > 0"""


@register("regression_report_file", ops="S10 (report written as JSON; its failures, read back beside the summary)",
          sql=_SQL + f"""
SELECT f.*, s.total, s.passed, s.pass_rate FROM ({_FAILURES}) f,
     (SELECT count(*) AS total, CAST(count_if(len(violations) = 0) AS BIGINT) AS passed,
             round_even(count_if(len(violations) = 0) / count(*), 4) AS pass_rate FROM res) s""")
def regression_report_file(spark, sf):
    results = stage(_results(spark, sf), "regression-results")
    path = f"{checkpoint_dir(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    save_regression_report(RG.suite_summary(results, "benchmark-golden"), RG.suite_failures(results), path)
    unstage(results)
    summary, failures = load_regression_report(spark, path)
    return failures.join(F.broadcast(summary.select("total", "passed", "pass_rate")))  # one row


@register("regression_attached_responses", ops="J4 R1 (golden examples joined with a table of responses and errors)",
          sql=with_views(V_GOLD.replace("(b.item_id % 11 = 0) AS call_failed",
                                        "(b.item_id % 11 = 0 OR d.doc_id IS NULL) AS call_failed"),
                         _GOLD_EVENTS, scored_sql("gev", models=True), _RESULTS) + """
SELECT item_id, call_failed, violations, len(violations) = 0 AS passed FROM res""")
def regression_attached_responses(spark, sf):
    i = F.col("doc_id")
    responses = table(spark, sf, "documents").select(
        i.alias("item_id"), F.when(i % 8 == 0, F.lit("")).otherwise(F.coalesce("text", F.lit(""))).alias("response"),
        F.when(i % 11 == 0, F.lit("no response")).alias("error"))
    g = RG.attach_responses(bridge.golden(spark, sf), responses)
    res = RG.run_suite(g, flags=_FLAGS, prepare=lambda ev: with_text_models(spark, sf, ev), **text_model_columns())
    return res.select("item_id", "call_failed", "violations", "passed")


@register("regression_empty_check_only", ops="R2 (no scoring modules: empty-response check only)",
          sql=with_views(V_GOLD) + """
SELECT item_id, CASE WHEN call_failed THEN ['LLM call failed: no response']
                     WHEN regexp_replace(coalesce(response, ''), '\\s+', '', 'g') = '' THEN ['empty response']
                     ELSE CAST([] AS VARCHAR[]) END AS violations FROM v_gold""")
def regression_empty_check_only(spark, sf):
    g = bridge.golden(spark, sf).withColumn("error", F.when(F.col("call_failed"), F.lit("no response")))
    return RG.run_suite(g, flags=None).select("item_id", "violations")


@register("golden_json_roundtrip", ops="S3 S4 (golden document write → read)", sql=with_views(V_GOLD) + """
SELECT query, expected_response, context, max_hallucination, min_faithfulness, expected_language, max_toxicity
FROM v_gold""")
def golden_json_roundtrip(spark, sf):
    g = (bridge.golden(spark, sf).withColumn("position", F.col("item_id"))
         .withColumn("tags", F.array().cast("array<string>")))
    path = f"{checkpoint_dir(spark).rstrip('/')}/golden-{uuid.uuid4().hex}"
    save_golden(g, path, name="benchmark-golden")
    back = load_golden(spark, path)
    return back.select("query", "expected_response", "context", "max_hallucination", "min_faithfulness",
                       "expected_language", "max_toxicity")
