"""Golden-set regression suite: pass rates, failed calls, empty sets, JSON round trip."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from ternlens import constants as K
from ternlens.operators import regression as RG
from ternlens.sources.golden import load_golden, save_golden

GOLD = "item_id long, query string, expected_response string, context string, max_hallucination double, " \
       "min_faithfulness double, expected_language string, max_toxicity double"


def _golden(spark, n):
    return spark.createDataFrame([(i, f"question {i}?", f"answer {i}", None, 0.3, None, None, 0.1) for i in range(n)], GOLD)


def test_two_answered_two_blank(spark):
    g = _golden(spark, 4)
    resp = spark.createDataFrame([(0, "Answer zero"), (1, "Answer one"), (2, ""), (3, "   ")], "item_id long, response string")
    res = RG.run_suite(RG.attach_responses(g, resp), flags=None)
    s = RG.suite_summary(res).first()
    assert (s.total, s.passed, s.failed, s.pass_rate) == (4, 2, 2, 0.5)
    fails = RG.suite_failures(res).collect()
    assert all(f.violations == ["empty response"] for f in fails)


def test_failed_call_and_empty_set(spark):
    g = _golden(spark, 1)

    def boom(q):
        raise RuntimeError("timeout")

    res = RG.run_suite(RG.call_system(g, boom), flags=None)
    f = RG.suite_failures(res).first()
    assert f.violations == ["LLM call failed: timeout"] and f.expected_response == "" and f.actual_response == ""
    empty = RG.run_suite(RG.call_system(_golden(spark, 0), boom), flags=None)
    s = RG.suite_summary(empty).first()
    assert (s.total, s.pass_rate, s.gate_passed) == (0, 0.0, False)


def test_threshold_violation_messages(spark):
    df = spark.createDataFrame([(0.456, 0.2, 0.3, "fr", 0.3, 0.1, 0.5, "en", "text")],
                               "hallucination_score double, toxicity_score double, faithfulness_score double, "
                               "language_detected string, max_hallucination double, max_toxicity double, "
                               "min_faithfulness double, expected_language string, response string")
    v = RG.check_violations(df).first().violations
    assert v == ["hallucination_score 0.46 > max 0.3", "toxicity_score 0.20 > max 0.1",
                 "faithfulness_score 0.30 < min 0.5", "language fr != expected en"]


def test_golden_json_load_defaults_and_roundtrip(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "g.json")
    doc = {"name": "demo", "version": "2", "examples": [
        {"query": "What is a tern?", "expected_response": "A seabird.", "expected_language": "en"},
        {"query": "Explain tides", "context": "Tides follow the moon.", "min_faithfulness": 0.5, "max_hallucination": 0.4},
        {"query": "Name a gull"}]}
    with open(p, "w") as fh:
        json.dump(doc, fh, indent=2)
    ex = load_golden(spark, p).orderBy("position").collect()
    assert [e.query for e in ex] == ["What is a tern?", "Explain tides", "Name a gull"]
    assert ex[0].max_hallucination == K.GOLDEN_MAX_HALLUCINATION and ex[1].max_hallucination == 0.4
    assert ex[2].expected_response == "" and ex[2].max_toxicity == K.GOLDEN_MAX_TOXICITY
    out = os.path.join(d, "out")
    save_golden(load_golden(spark, p), out, name="demo")
    back = load_golden(spark, out).orderBy("position").collect()
    assert [(e.query, e.min_faithfulness) for e in back] == [(e.query, e.min_faithfulness) for e in ex]
