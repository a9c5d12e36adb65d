"""Golden-set regression suite: responses, scoring, violations, summary, gate.

R1  ``attach_responses``: golden examples ⋈ responses of the system under test on
    the example key (left join; no row = the call failed), or a user callable run
    in ``mapInPandas`` (U2) that returns (response, error) per example.
R2  ``check_violations``: scores from ``evaluate`` (chosen modules) compared with the
    example thresholds, strict, in a fixed order, as a ``violations`` array.
R3  ``suite_summary``: total / passed / failed / pass_rate (4 decimals, 0.0 when empty).
R4  ``suite_failures``: the failing examples as their own table (never one array).
R5  gate: ``pass_rate >= threshold`` as a boolean column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternlens import constants as K
from ternlens.functions import text as TX
from ternlens.operators import scoring as SC


def attach_responses(golden: DataFrame, responses: DataFrame, key: str = "item_id") -> DataFrame:
    """``responses`` has ``key``, ``response`` and optionally ``error``.

    A missing response row, or a non-null ``error``, marks the call as failed.
    """
    r = responses.select(key, "response", *(["error"] if "error" in responses.columns else []))
    j = golden.drop("response", "call_failed", "error").join(r, key, "left")
    err = F.col("error") if "error" in r.columns else F.lit(None).cast("string")
    failed = F.col("response").isNull() | err.isNotNull()
    return j.withColumn("call_failed", failed).withColumn(
        "error", F.when(failed, F.coalesce(err, F.lit("no response"))))


def call_system(golden: DataFrame, llm_func: Callable[[str], str], query: str = "query") -> DataFrame:
    """Run the system under test once per example inside the executors.

    ``llm_func`` is shipped to the tasks; each partition's examples are called in
    Arrow batches and any exception becomes that example's ``error``.
    """
    schema = golden.schema.add("response", "string").add("error", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            resp, errs = [], []
            for q in pdf[query]:
                try:
                    out = llm_func(q)
                    resp.append(None if out is None else str(out))
                    errs.append(None)
                except Exception as exc:  # noqa: BLE001 - the failure is the result
                    resp.append(None)
                    errs.append(str(exc))
            yield pdf.assign(response=resp, error=errs)

    out = golden.drop(*[c for c in ("response", "error") if c in golden.columns]).mapInPandas(run, schema)
    return out.withColumn("call_failed", F.col("error").isNotNull())


def _py_float_text(v: Column) -> Column:
    """``str(float)`` of a threshold: shortest round-trip digits (Java and Python agree
    on these for values in [1e-3, 1e7), where both use fixed notation)."""
    return v.cast("string")


def check_violations(scored: DataFrame) -> DataFrame:
    """R2: adds ``violations`` (strict checks in order; a missing score skips its check)."""
    h, t, f = F.col("hallucination_score"), F.col("toxicity_score"), F.col("faithfulness_score")
    lang, exp = F.col("language_detected"), F.col("expected_language")
    mh, mt, mf = F.col("max_hallucination"), F.col("max_toxicity"), F.col("min_faithfulness")
    checks = [
        F.when(h.isNotNull() & (h > mh), F.concat(F.lit("hallucination_score "), TX.fixed(h, 2),
                                                  F.lit(" > max "), _py_float_text(mh))),
        F.when(t.isNotNull() & (t > mt), F.concat(F.lit("toxicity_score "), TX.fixed(t, 2),
                                                  F.lit(" > max "), _py_float_text(mt))),
        F.when(mf.isNotNull() & f.isNotNull() & (f < mf), F.concat(F.lit("faithfulness_score "), TX.fixed(f, 2),
                                                                   F.lit(" < min "), _py_float_text(mf))),
        F.when(exp.isNotNull() & (exp != "") & lang.isNotNull() & (lang != "") & (lang != exp),
               F.concat(F.lit("language "), lang, F.lit(" != expected "), exp)),
        F.when(TX.is_blank(F.col("response")), F.lit("empty response")),
    ]
    return scored.withColumn("violations", F.filter(F.array(*checks), lambda x: x.isNotNull()))


def run_suite(golden: DataFrame, key: str = "item_id", flags: K.ModuleFlags | None = None,
              prepare: Callable[[DataFrame], DataFrame] | None = None, **scoring) -> DataFrame:
    """R1–R2 over examples that already carry ``response``/``call_failed``: score the
    answered ones with ``evaluate`` (no modules → only the empty-response check) and
    attach ``violations``; failed calls get ``LLM call failed: <error>`` only.  ``prepare`` adds columns
    (learned toxicity and language, say) to the events, and ``scoring`` goes to ``evaluate``."""
    answered = golden.where(~F.col("call_failed"))
    failed = golden.where(F.col("call_failed"))
    ev = answered.select(F.col(key).cast("string").alias("id"), F.lit("regression").alias("app_name"),
                         F.lit(None).cast("timestamp").alias("timestamp"), "query", "context",
                         F.coalesce("response", F.lit("")).alias("response"), F.lit(None).cast("string").alias("model_name"),
                         F.lit(0).alias("latency_ms"), F.array().cast("array<string>").alias("tags"))
    if flags is None:
        scores = ev.select("id", F.lit(None).cast("double").alias("hallucination_score"),
                           F.lit(None).cast("double").alias("toxicity_score"),
                           F.lit(None).cast("double").alias("faithfulness_score"),
                           F.lit(None).cast("string").alias("language_detected"))
    else:
        rec = SC.evaluate(prepare(ev) if prepare else ev, flags=flags, **scoring)
        scores = rec.select("id", "hallucination_score", "toxicity_score", "faithfulness_score", "language_detected")
    scored = (answered.withColumn("id", F.col(key).cast("string")).join(scores, "id", "left").drop("id"))
    ok = check_violations(scored)
    bad = failed.withColumn("violations", F.array(F.concat(F.lit("LLM call failed: "),
                                                           F.coalesce("error", F.lit("")))))
    for c in ("hallucination_score", "toxicity_score", "faithfulness_score"):
        bad = bad.withColumn(c, F.lit(None).cast("double"))
    bad = bad.withColumn("language_detected", F.lit(None).cast("string"))
    return ok.unionByName(bad).withColumn("passed", F.size("violations") == 0)


def suite_failures(results: DataFrame, key: str = "item_id") -> DataFrame:
    """Query, expected_response, actual_response[:500], violations of failing examples.
    A failed call reports only the query and its ``LLM call failed`` violation."""
    failed = results.where(~F.col("passed"))
    return failed.select(
        key, "query",
        F.when(F.col("call_failed"), F.lit("")).otherwise(F.col("expected_response")).alias("expected_response"),
        F.when(F.col("call_failed"), F.lit(""))
         .otherwise(F.substring(F.coalesce("response", F.lit("")), 1, K.REGRESSION_RESPONSE_CHARS))
         .alias("actual_response"),
        "violations")


def suite_summary(results: DataFrame, dataset_name: str = "default",
                  threshold: float = K.REGRESSION_GATE) -> DataFrame:
    """One row of counts, pass rate and the gate decision."""
    agg = results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("passed")).alias("passed"))
    rate = F.when(F.col("total") > 0, F.bround(F.col("passed") / F.col("total"), 4)).otherwise(F.lit(0.0))
    return agg.select(F.lit(dataset_name).alias("dataset_name"), "total", "passed",
                      (F.col("total") - F.col("passed")).alias("failed"), rate.alias("pass_rate"),
                      (rate >= F.lit(threshold)).alias("gate_passed"))
