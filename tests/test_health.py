"""Health score, quality sub-score, bands, aggregate health."""

import math
import random

from pyspark.sql import functions as F

from ternlens.functions import scores as S
from ternlens.operators import analytics as A

COLS = "h double, d double, g double, f double, s double, t double, den boolean"


def _health(spark, rows):
    df = spark.createDataFrame(rows, COLS)
    return [r[0] for r in df.select(S.health_score("h", "d", "g", "f", "t", "s", "den")).collect()]


def _py_health(h, d, g, f, s, t, den):
    """Independent restatement of the weighting rule for the property test."""
    q = min(1.0, max(0.0, (1 - t) * 0.5 + s * 0.4 + (1 - (0.1 if den else 0.0)) * 0.1))
    parts = [(1 - h, 0.35), (None if d is None else 1 - d, 0.25),
             (g if g is not None else f, 0.20), (q, 0.15)]
    present = [(x, w) for x, w in parts if x is not None]
    tw = sum(w for _, w in present)
    val = sum(x * (w / tw) for x, w in present)
    return max(0, min(100, int(round(val * 100))))


def test_best_and_worst(spark):
    best, worst = _health(spark, [(0.0, 0.0, 1.0, None, 0.8, 0.0, False),
                                  (1.0, 1.0, 0.0, None, 0.0, 1.0, True)])
    assert best >= 85
    assert worst <= 20


def test_missing_components_redistribute(spark):
    random.seed(7)
    rows = []
    for _ in range(300):
        rows.append((random.random(), random.choice([None, random.random()]), random.choice([None, random.random()]),
                     random.choice([None, random.random()]), random.random(), random.random() * 0.2,
                     random.random() < 0.2))
    got = _health(spark, rows)
    want = [_py_health(*r) for r in rows]
    assert got == want


def test_quality_subscore_and_bands(spark):
    df = spark.createDataFrame([(0.0, 1.0, False, 95), (1.0, 0.0, True, 80), (0.2, 0.5, False, 61), (0.0, 0.5, False, 10)],
                               "t double, s double, den boolean, h int")
    out = df.select(S.quality_subscore("t", "s", "den").alias("q"), S.health_band("h").alias("b")).collect()
    assert math.isclose(out[0].q, 1.0)
    assert math.isclose(out[1].q, 0.09, abs_tol=1e-12)
    assert [r.b for r in out] == ["HEALTHY", "MONITORING", "DEGRADING", "CRITICAL"]


def test_aggregate_health(spark):
    df = spark.createDataFrame([(80,), (60,), (90,)], "health_score int")
    assert A.aggregate_health(df).first()["aggregate_health"] == 77
    empty = spark.createDataFrame([], "health_score int")
    assert A.aggregate_health(empty).first()["aggregate_health"] == 50
    zeros = spark.createDataFrame([(0,), (0,)], "health_score int")
    assert A.aggregate_health(zeros).first()["aggregate_health"] == 50
