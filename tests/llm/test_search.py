import numpy as np

from ternlens.llm import graph_search, queries

SMALL = "/root/testdata/sf0.001"


def brute(ids, x, k=20, every=20):
    out = {}
    for q in sorted(set(ids[ids % every == 0])):
        score = x @ x[np.nonzero(ids == q)[0][0]]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), score[j]) for j in order]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    assert set(got) == set(want)
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def test_op1_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = by_query(queries.op1_pruned_graph_search(spark, SMALL).collect())
    want = brute(ids, x)
    assert recall(got, want) >= 0.95
    row = {int(i): v for i, v in zip(ids, x)}
    for q, found in got.items():
        assert len(found) == 20
        assert all(abs(s - row[q] @ row[i]) < 1e-12 for i, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_several_shards_and_lengths(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 12)) * rng.uniform(0.2, 3, size=(900, 1))
    x[300:600] = x[300]  # a third of all rows are one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = by_query(graph_search.nearest(df, shard_rows=250).collect())
    assert recall(got, brute(np.arange(900), x)) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]),
            (6, [2.0, 1.0]), (7, [2.0, 1.0]), (8, [1.0]), (20, [0.0, 1.0]), (40, [3.0]), (None, [1.0, 1.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v", "3 AS shard")
    got = by_query(graph_search.nearest(df, k=3).collect())
    assert got == {0: [(6, 2.0), (7, 2.0), (20, 0.0)], 20: [(6, 1.0), (7, 1.0), (0, 0.0)], 40: [(8, 3.0)]}
    assert graph_search.nearest(df.limit(0)).count() == 0
