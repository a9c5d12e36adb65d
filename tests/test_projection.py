"""Principal axes against numpy."""

import numpy as np

from ternlens.operators import projection as P


def test_points_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 5)) * [5, 1, 3, .5, .1] + 1000
    odd = [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, float("nan"), 1.0, 1.0, 1.0]), (904, [1.0, None, 1.0, 1.0, 1.0]),
           (905, [1.0, float("inf"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "id long, vector array<double>").repartition(7)
    m = P.vector_moments(df, 5).first()
    assert m["count"] == 500 and np.allclose(m["mean"], x.mean(0))
    assert np.allclose(np.reshape(m["covariance"], (5, 5)), np.cov(x.T, bias=True))
    w, v = np.linalg.eigh(np.cov(x.T, bias=True))
    axes = v[:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), [0, 1]])
    got = {r.id: (r.x, r.y) for r in P.principal_points(df, 5).collect()}
    assert sorted(got) == list(range(500))
    assert np.allclose([got[i] for i in range(500)], (x - x.mean(0)) @ axes)


def test_too_few_points_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "id long, vector array<double>")
    assert P.principal_points(df, 2).count() == 0
    assert P.principal_points(df, 2, min_points=2).count() == 2
    assert P.principal_points(df.limit(0), 0).columns == ["id", "vector", "x", "y"]
    assert P.vector_moments(df.limit(0), 2).count() == 0
