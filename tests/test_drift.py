"""Vectors, centroids, online drift (head and fixed-centroid tail) against NumPy brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ternlens.functions import vectors as V
from ternlens.operators import drift as D
from ternlens.sources import bridge


def test_centroid_and_distance(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0, 0.0]), (2, "a", [0.0, 1.0, 0.0])], "id long, app_name string, vector array<double>")
    c = D.centroids(df).first()["centroid"]
    assert abs(np.linalg.norm(c) - 1.0) < 1e-12
    pair = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, c array<double>, z array<double>")
    r = pair.select(V.cosine_distance("a", "b"), V.cosine_distance("a", "c"), V.cosine_distance("a", "z")).first()
    assert abs(r[0]) < 1e-12 and abs(r[1] - 1.0) < 1e-12 and r[2] == 1.0


def test_too_few_vectors_gives_null(spark):
    rows = [(i, "a", [float(i), 1.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, app_name string, vector array<double>")
    assert all(r.drift_score is None for r in D.online_drift(df, order=("id",)).collect())


def _brute(vecs, cap, min_n=10):
    out, total = [], np.zeros_like(vecs[0])
    for i, v in enumerate(vecs, start=1):
        if i <= cap:
            total = total + v
        c = total / min(i, cap)
        c = c / np.linalg.norm(c) if np.linalg.norm(c) > 0 else c
        nv, nc = np.linalg.norm(v), np.linalg.norm(c)
        dist = 1.0 if nv == 0 or nc == 0 else 1.0 - float(np.dot(v, c)) / (nv * nc)
        out.append(None if i < min_n else round(min(max(dist / 2, 0.0), 1.0), 4))
    return out


@pytest.mark.parametrize("cap", [10_000, 20])
def test_online_drift_matches_brute_force(spark, sf, cap):
    vecs = bridge.vectors(spark, sf)
    got = {r.id: r.drift_score for r in D.online_drift(vecs, order=("id",), cap=cap).collect()}
    by_app = {}
    for r in vecs.orderBy("id").collect():
        by_app.setdefault(r.app_name, []).append((r.id, np.asarray(r.vector)))
    for app, items in by_app.items():
        want = _brute([v for _, v in items], cap)
        for (i, _), w in zip(items, want):
            if w is None:
                assert got[i] is None
            else:
                assert abs(got[i] - w) <= 1e-4 + 1e-12, (app, i)


def test_embedding_is_unit_norm_and_deterministic(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(50)
    a = {r.doc_id: r.e for r in docs.select("doc_id", V.embed("text").alias("e")).collect()}
    b = {r.doc_id: r.e for r in docs.select("doc_id", V.embed("text").alias("e")).collect()}
    for k, v in a.items():
        assert v == b[k]
        n = np.linalg.norm(v)
        assert n == 0 or abs(n - 1) < 1e-9


def test_failing_embedder_leaves_defaults(spark):
    import datetime as dt
    import numpy as np
    from ternlens.operators import scoring as SC

    def factory():
        def fn(text):
            if "boom" in text:
                raise RuntimeError("model error")
            v = np.zeros(8)
            v[len(text) % 8] = 1.0
            return v
        return fn

    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([("a", "app", t, "q one", "ctx", "fine answer here"),
                                ("b", "app", t, "q two", "ctx", "boom goes the model")],
                               "id string, app_name string, timestamp timestamp, query string, context string, response string")
    out = {r.id: r for r in SC.evaluate(ev, embedder=factory).collect()}
    assert out["b"].score_errors == 1 and out["a"].score_errors == 0
    assert out["b"].hallucination_score == 0.0 and out["b"].hallucination_method == "none"
    assert out["b"].groundedness_score is None and out["b"].drift_score is None
    assert out["a"].hallucination_method == "embedding"


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_online_drift_partition_invariant(spark, sf, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        vecs = bridge.vectors(spark, sf)
        got = sorted((r.id, r.drift_score) for r in D.online_drift(vecs, order=("id",), cap=20).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    ref = sorted((r.id, r.drift_score) for r in D.online_drift(vecs, order=("id",), cap=20).collect())
    assert got == ref


def test_repeated_rows_stay_as_many_as_they_are(spark):
    import datetime as dt
    from ternlens.operators import scoring as SC

    rows = [(k % 40, "a", [float(k % 7), 1.0, float(k % 3)]) for k in range(120)]  # every id three times
    df = spark.createDataFrame(rows, "id long, app_name string, vector array<double>").repartition(4)
    out = D.online_drift(df, order=("id",)).collect()
    assert len(out) == 120 and sum(r.drift_score is None for r in out) == 9
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(None, "app", t, "q", None, "an answer")] * 30, "id string, app_name string, timestamp timestamp, query string, context string, response string")
    assert SC.evaluate(ev).count() == 30


def test_history_goes_on_from_the_stored_state(spark, sf):
    vecs = bridge.vectors(spark, sf)
    whole = {r.id: r.drift_score for r in D.online_drift(vecs, order=("id",)).collect()}
    early, late = vecs.where("id < 150"), vecs.where("id >= 150")
    state = D.drift_state(early)
    parts = {r.id: r.drift_score for df, start in ((early, None), (late, state)) for r in D.online_drift(df, order=("id",), start=start).collect()}
    assert parts == whole
    again = {r.app_name: (r["count"], np.round(r.total, 9).tolist()) for r in D.drift_state(late, state).collect()}
    assert again == {r.app_name: (r["count"], np.round(r.total, 9).tolist()) for r in D.drift_state(vecs).collect()}


def test_uncapped_baseline_of_an_app_above_ten_thousand(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(12_000, 3)) + np.linspace(0, 2, 12_000)[:, None]
    df = spark.createDataFrame([(k, "hot", v.tolist()) for k, v in enumerate(m)], "id long, app_name string, vector array<double>").repartition(6)
    got = {r.id: r.drift_score for r in D.online_drift(df, order=("id",)).collect()}
    want = _brute(list(m), 10**9)
    assert all(abs(got[k] - want[k]) <= 1e-4 + 1e-12 for k in range(10, 12_000))


def test_failing_plugin_leaves_defaults_on_its_rows(spark):
    import pandas as pd
    from pyspark.sql import types as T
    from ternlens.operators.plugins import PandasScorer

    def score(pdf):
        if pdf["response"].str.contains("boom").any():
            raise ValueError("no")
        return pd.DataFrame({"chars": pdf["response"].str.len()})
    df = spark.createDataFrame([(k, "boom" if k % 4 == 0 else "x" * k) for k in range(20)], "id long, response string")
    plug = PandasScorer("chars", score, ["response"], T.StructType([T.StructField("chars", T.LongType())]), {"chars": -1})
    assert {(r.id, r.chars, r.plugin_errors) for r in plug.apply(df).collect()} == {(k, -1, 1) if k % 4 == 0 else (k, k, 0) for k in range(20)}
    broken = PandasScorer("chars", lambda pdf: pdf.head(0), ["response"], T.StructType([T.StructField("chars", T.LongType())]))
    assert {(r.chars, r.plugin_errors) for r in broken.apply(df).collect()} == {(None, 1)}
