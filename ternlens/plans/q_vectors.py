"""Queries for vector functions and drift."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ternlens.functions import vectors as V
from ternlens.operators import drift as D
from ternlens.operators import projection as P
from ternlens.operators import records as R
from ternlens.plans.catalog import r9, register
from ternlens.plans.sqlviews import V_VEC, with_views
from ternlens.sources import bridge
from ternlens.sources.tables import table

DIM = V.DEFAULT_DIM


def bucket_counts_sql(src: str, id_col: str, text_col: str, dim: int = DIM) -> str:
    """(id, bucket, c) hashed token counts — the embedding rule written in SQL."""
    return f"""(SELECT {id_col} AS eid, ('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim} AS bucket, count(*) AS c
   FROM (SELECT {id_col}, unnest(regexp_split_to_array(lower({text_col}), '[^a-z0-9]+')) AS tok FROM {src})
   WHERE tok <> '' GROUP BY 1, 2)"""


def dense_sql(counts: str, dim: int = DIM) -> str:
    """Dense unit vectors per id from a bucket-count relation."""
    return f"""(SELECT eid, list_transform(range(0, {dim}), lambda i: coalesce(list_sum(list_transform(
            list_filter(p, lambda q: q.bucket = i), lambda q: q.c)), 0) / nrm) AS vec
   FROM (SELECT eid, list(struct_pack(bucket := bucket, c := c)) AS p, sqrt(sum(c * c)) AS nrm
         FROM {counts} x GROUP BY eid))"""


W_VEC = with_views(V_VEC)


@register("document_embeddings", ops="V1 V2 V5", sql=f"""
SELECT d.doc_id, coalesce(list_transform(v.vec, lambda x: round(x, 9)),
                          list_transform(range(0, {DIM}), lambda i: 0.0::DOUBLE)) AS embedding
FROM documents d LEFT JOIN {dense_sql(bucket_counts_sql('documents', 'doc_id', 'text'))} v ON d.doc_id = v.eid""")
def document_embeddings(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", V.round_elements(V.embed("text")).alias("embedding"))


def _first_per_app(vecs):
    w = Window.partitionBy("app_name").orderBy("id")
    return (vecs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select("app_name", F.col("vector").alias("first_vector")))


@register("vector_similarity_to_first", ops="V3 V4 V5", sql=W_VEC + """,
f AS (SELECT app_name, vector AS first_vector FROM
      (SELECT *, row_number() OVER (PARTITION BY app_name ORDER BY id) AS r FROM v_vec) WHERE r = 1)
SELECT v.id, v.app_name, round(list_inner_product(v.vector, f.first_vector), 9) AS dot,
       round(CASE WHEN sqrt(list_inner_product(v.vector, v.vector)) = 0
                    OR sqrt(list_inner_product(f.first_vector, f.first_vector)) = 0 THEN 1.0
                  ELSE 1.0 - list_inner_product(v.vector, f.first_vector)
                       / (sqrt(list_inner_product(v.vector, v.vector)) * sqrt(list_inner_product(f.first_vector, f.first_vector)))
             END, 9) AS cosine_distance,
       round(v.vector[1] / sqrt(list_inner_product(v.vector, v.vector)), 9) AS unit_x
FROM v_vec v JOIN f USING (app_name)""")
def vector_similarity_to_first(spark, sf):
    vecs = bridge.vectors(spark, sf)
    j = vecs.join(_first_per_app(vecs), "app_name")
    return j.select("id", "app_name", r9(V.dot("vector", "first_vector")).alias("dot"),
                    r9(V.cosine_distance("vector", "first_vector")).alias("cosine_distance"),
                    r9(F.element_at(V.normalize("vector"), 1)).alias("unit_x"))


@register("embedding_projection", ops="V6 F8", sql=W_VEC + """
SELECT id, round(vector[1], 9) AS x, round(vector[2], 9) AS y, app_name AS label
FROM v_vec WHERE len(vector) > 2 AND (SELECT count(*) FROM v_vec WHERE len(vector) > 2) >= 3""")
def embedding_projection(spark, sf):
    vecs = bridge.vectors(spark, sf).withColumnRenamed("vector", "embedding_vector")
    pts = R.embedding_points(vecs.withColumn("hallucination_score", F.lit(0.0))
                             .withColumn("query", F.col("app_name")))
    return pts.select("id", r9("x").alias("x"), r9("y").alias("y"), "label")


_DIM_COUNTS = "(SELECT len(vector) AS d FROM v_vec GROUP BY 1 ORDER BY count(*) DESC, d LIMIT 1)"


def _commonest_dim(vecs) -> int:
    """The dimension that most vectors have (the smaller of equal ones); 0 without vectors."""
    row = (vecs.where(F.col("vector").isNotNull()).groupBy(F.size("vector").alias("d")).count()
           .orderBy(F.desc("count"), "d").first())
    return row["d"] if row else 0


@register("vector_moments", ops="V6 (mean and covariance of all vectors)", sql=W_VEC + f""",
u AS (SELECT id, unnest(vector) AS x, unnest(range(0, len(vector))) AS i FROM v_vec WHERE len(vector) = {_DIM_COUNTS})
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(avg(a.x), 9) AS mean_i, round(covar_pop(a.x, b.x), 9) AS covariance
FROM u a JOIN u b USING (id) GROUP BY a.i, b.i""")
def vector_moments(spark, sf):
    vecs = bridge.vectors(spark, sf)
    dim = _commonest_dim(vecs)
    at = F.posexplode("covariance").alias("at", "covariance")
    return (P.vector_moments(vecs, dim).select("mean", at)
            .select(F.floor(F.col("at") / dim).cast("int").alias("i"), (F.col("at") % dim).cast("int").alias("j"), "mean", "covariance")
            .select("i", "j", r9(F.get("mean", F.col("i"))).alias("mean_i"), r9("covariance").alias("covariance")))


@register("embedding_principal_points", ops="V6 F8 (every vector on the first two principal axes)")
def embedding_principal_points(spark, sf):
    vecs = bridge.vectors(spark, sf)
    return P.principal_points(vecs, _commonest_dim(vecs)).select("id", "app_name", r9("x").alias("x"), r9("y").alias("y"))


@register("embedding_count_per_app", ops="G11", sql=W_VEC + """
SELECT app_name, count(*) AS embedding_count FROM v_vec WHERE len(vector) > 0 GROUP BY app_name""")
def embedding_count_per_app(spark, sf):
    return D.vector_counts(bridge.vectors(spark, sf))


_CENTROID_SQL = """cen AS (
  SELECT app_name, list(m ORDER BY pos) AS mean, count(*) AS dims, max(n) AS vectors
  FROM (SELECT app_name, pos, sum(x) / count(*) AS m, count(*) AS n
        FROM (SELECT app_name, unnest(vector) AS x, unnest(range(1, len(vector) + 1)) AS pos FROM v_vec)
        GROUP BY app_name, pos) GROUP BY app_name),
cen_n AS (SELECT app_name, vectors, CASE WHEN sqrt(list_inner_product(mean, mean)) > 0
             THEN list_transform(mean, lambda x: x / sqrt(list_inner_product(mean, mean))) ELSE mean END AS centroid
          FROM cen)"""


@register("app_centroids", ops="G12 V5", sql=with_views(V_VEC, _CENTROID_SQL) + """
SELECT app_name, vectors, list_transform(centroid, lambda x: round(x, 9)) AS centroid FROM cen_n""")
def app_centroids(spark, sf):
    c = D.centroids(bridge.vectors(spark, sf))
    return c.select("app_name", "vectors", V.round_elements("centroid").alias("centroid"))


@register("snapshot_drift", ops="W2 V4", sql=with_views(V_VEC, _CENTROID_SQL) + """
SELECT v.id, v.app_name,
       round_even(greatest(0.0, least(1.0, (CASE WHEN list_inner_product(v.vector, v.vector) = 0
            OR list_inner_product(c.centroid, c.centroid) = 0 THEN 1.0
            ELSE 1.0 - list_inner_product(v.vector, c.centroid)
                 / (sqrt(list_inner_product(v.vector, v.vector)) * sqrt(list_inner_product(c.centroid, c.centroid))) END)
            / 2.0)), 4) AS drift_score
FROM v_vec v JOIN cen_n c USING (app_name)""")
def snapshot_drift(spark, sf):
    return D.snapshot_drift(bridge.vectors(spark, sf)).select("id", "app_name", "drift_score")


def _online_sql(cap: int | None) -> str:
    return W_VEC + f""",
e AS (SELECT id, app_name, vector, row_number() OVER (PARTITION BY app_name ORDER BY id) AS r FROM v_vec),
u AS (SELECT id, app_name, r, unnest(vector) AS x, unnest(range(1, len(vector) + 1)) AS pos FROM e),
rs AS (SELECT id, app_name, r, pos, x,
              sum({'x' if cap is None else f'CASE WHEN r <= {cap} THEN x ELSE 0.0 END'}) OVER (PARTITION BY app_name, pos ORDER BY r
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM u),
a AS (SELECT id, app_name, r, sum(x * s) AS xs, sum(x * x) AS xx, sum(s * s) AS ss FROM rs GROUP BY id, app_name, r)
SELECT id, app_name,
       CASE WHEN r < 10 THEN NULL ELSE round_even(greatest(0.0, least(1.0,
            (CASE WHEN xx = 0 OR ss = 0 THEN 1.0 ELSE 1.0 - xs / (sqrt(xx) * sqrt(ss)) END) / 2.0)), 4) END AS drift_score
FROM a"""


@register("online_drift", ops="W1 ST2-batch", sql=_online_sql(None))
def online_drift(spark, sf):
    vecs = bridge.vectors(spark, sf)
    return D.online_drift(vecs, order=("id",)).select("id", "app_name", "drift_score")


@register("online_drift_capped_baseline", ops="W1 (baseline cap 30: fixed-centroid tail path)", sql=_online_sql(30))
def online_drift_capped_baseline(spark, sf):
    vecs = bridge.vectors(spark, sf)
    return D.online_drift(vecs, order=("id",), cap=30).select("id", "app_name", "drift_score")
