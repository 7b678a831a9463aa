"""Queries for the vector operators.

The ``embeddings`` table stands in for per-checkpoint token embeddings and
attention rows: ``label`` is the layer, ``vec_id % 10`` the checkpoint (a key
derived for every row; no row is left out), ``vec_id div 10`` the index of the
vector inside its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from curio.functions import vectors as vf
from curio.operators import vectors as vo
from curio.plans.registry import query
from curio.sources import table

N_CKPT = 10
QUANT_GROUP = 16


def emb(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", "embedding",
                    (F.col("vec_id") % N_CKPT).alias("ckpt"),
                    F.floor(F.col("vec_id") / N_CKPT).cast("bigint").alias("k"))


_E = "CAST(embedding AS DOUBLE[])"
_NORM = f"sqrt(list_sum(list_transform({_E}, lambda x: x * x)))"


def _centroid_sql(keys: str) -> str:
    return f"""
ex AS (SELECT {keys}, u.i, CAST(embedding[u.i] AS DOUBLE) AS x
       FROM (SELECT *, vec_id % {N_CKPT} AS ckpt FROM embeddings) e,
            LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) u),
cen AS (SELECT {keys}, list(x ORDER BY i) AS c FROM (SELECT {keys}, i, avg(x) AS x FROM ex GROUP BY ALL) GROUP BY ALL),
unit AS (SELECT *, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS u
         FROM cen WHERE sqrt(list_sum(list_transform(c, lambda y: y * y))) > 0)"""


@query("l2_normalize", f"""
WITH n AS (SELECT vec_id, {_E} AS e, {_NORM} AS nrm FROM embeddings)
SELECT vec_id, round(nrm, 6) AS norm, round(list_sum(list_transform(e, lambda x: x / nrm)), 6) AS sum_unit,
       round(e[1] / nrm, 6) AS first_unit
FROM n WHERE nrm > 0""")
def q_l2_normalize(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", vf.as_double("embedding").alias("e"))
    e = e.withColumn("norm", vf.l2_norm("e")).filter(F.col("norm") > 0)
    u = e.withColumn("u", vf.l2_normalize("e", F.col("norm")))
    return u.select("vec_id", "norm",
                    F.aggregate("u", F.lit(0.0), lambda a, x: a + x).alias("sum_unit"),
                    F.element_at("u", 1).alias("first_unit"))


@query("cosine_similarity", f"""
SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
       / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])))
          * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS cos
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def q_cosine_similarity(spark, sf):
    """Cosine between each vector and the next one (an equi join on id + 1)."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next_e"))
    return e.join(nxt, "vec_id").select(
        "vec_id", vf.cosine_similarity("embedding", "next_e").alias("cos"))


@query("pairwise_similarity", f"""WITH {_centroid_sql('label')}
SELECT CAST(a.label AS BIGINT) AS i, CAST(b.label AS BIGINT) AS j, round(list_dot_product(a.u, b.u), 6) AS cos
FROM unit a JOIN unit b ON true""")
def q_pairwise_similarity(spark, sf):
    c = vo.centroids(emb(spark, sf), ["label"], "embedding")
    return vo.pairwise_similarity(c, "label", "centroid")


@query("similarity_matrix", f"""WITH {_centroid_sql('ckpt, label')}
SELECT a.ckpt, CAST(a.label AS BIGINT) AS i, CAST(b.label AS BIGINT) AS j, round(list_dot_product(a.u, b.u), 6) AS cos
FROM unit a JOIN unit b ON a.ckpt = b.ckpt""")
def q_similarity_matrix(spark, sf):
    c = vo.centroids(emb(spark, sf), ["ckpt", "label"], "embedding")
    return vo.pairwise_similarity(c, "label", "centroid", group_cols=["ckpt"])


@query("cross_checkpoint_similarity", f"""WITH {_centroid_sql('ckpt, label')},
e AS (SELECT label, count(DISTINCT ckpt) AS n_checkpoints FROM cen GROUP BY label),
p AS (SELECT a.label, sum(list_dot_product(a.u, b.u)) AS s
      FROM unit a JOIN unit b ON a.label = b.label AND a.ckpt < b.ckpt GROUP BY a.label)
SELECT CAST(e.label AS BIGINT) AS label, e.n_checkpoints, round(coalesce(p.s, 0.0) / (e.n_checkpoints * (e.n_checkpoints - 1) / 2.0), 6)
       AS mean_cosine
FROM e LEFT JOIN p ON e.label = p.label""")
def q_cross_checkpoint_similarity(spark, sf):
    c = vo.centroids(emb(spark, sf), ["ckpt", "label"], "embedding")
    return vo.cross_checkpoint_similarity(c, "label", "ckpt", "centroid")


_QUANT_SQL = f"""
g AS (SELECT vec_id, label, {_E} AS e, u.k,
             list_slice({_E}, u.k * {QUANT_GROUP} + 1, (u.k + 1) * {QUANT_GROUP}) AS grp
      FROM embeddings, LATERAL (SELECT unnest(range(0, len(embedding) // {QUANT_GROUP})) AS k) u),
s AS (SELECT *, list_max(list_transform(grp, lambda x: abs(x))) / 127.0 AS scale FROM g),
q AS (SELECT *, list_transform(grp, lambda x: CASE WHEN scale = 0 THEN 0
                                                   ELSE CAST(round_even(x / scale, 0) AS INTEGER) END) AS qv
      FROM s),
err AS (SELECT *, list_max(list_transform(grp, lambda x, i: abs(x - qv[i] * scale))) AS max_err FROM q)"""


@query("quantize_groups", f"""WITH {_QUANT_SQL}
SELECT vec_id, count(*) AS n_groups, CAST(sum(list_sum(qv)) AS BIGINT) AS sum_q,
       CAST(max(list_max(list_transform(qv, lambda x: abs(x)))) AS BIGINT) AS max_abs_q,
       round(sum(scale), 6) AS sum_scale, round(max(max_err), 6) AS max_err
FROM err GROUP BY vec_id""")
def q_quantize_groups(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    dim = len(e.select("embedding").first()[0])
    qv = e.select("vec_id", "embedding", vf.quantize_groups("embedding", dim, QUANT_GROUP).alias("qv"))
    return qv.select(
        "vec_id", F.size("qv.scale").alias("n_groups"),
        F.aggregate("qv.q", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_q"),
        F.array_max(F.transform("qv.q", F.abs)).alias("max_abs_q"),
        F.aggregate("qv.scale", F.lit(0.0), lambda a, x: a + x).alias("sum_scale"),
        vf.max_abs_error("embedding", F.col("qv")).alias("max_err"))


@query("quantization_error", f"""WITH {_QUANT_SQL},
v AS (SELECT vec_id, label, max(max_err) AS e FROM err GROUP BY vec_id, label)
SELECT CAST(label AS BIGINT) AS label, count(*) AS n_vectors, round(max(e), 6) AS max_err FROM v GROUP BY label""")
def q_quantization_error(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    dim = len(e.select("embedding").first()[0])
    per = e.select("label", vf.max_abs_error(
        "embedding", vf.quantize_groups("embedding", dim, QUANT_GROUP)).alias("err"))
    return per.groupBy("label").agg(F.count(F.lit(1)).alias("n_vectors"),
                                    F.max("err").alias("max_err"))


def attention_rows(spark, sf):
    """Attention-shaped rows: layer = label, head = vec_id % 4, query position
    = vec_id div 4, one stored sample (0); weights = the vector."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("label").alias("layer"), (F.col("vec_id") % 4).alias("head"),
                    F.floor(F.col("vec_id") / 4).cast("bigint").alias("q_pos"),
                    F.lit(0).alias("sample"), F.col("embedding").alias("weights"))


@query("attention_slice", """
SELECT CAST(label AS BIGINT) AS layer, vec_id % 4 AS head, CAST(floor(vec_id / 4) AS BIGINT) AS q_pos,
       CAST(u.i - 1 AS BIGINT) AS k_pos, round(CAST(embedding[u.i] AS DOUBLE), 6) AS w
FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) u""")
def q_attention_slice(spark, sf):
    return vo.attention_slice(attention_rows(spark, sf), 0)


@query("has_artifact", """
SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0""")
def q_has_artifact(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return vo.has_artifact(e, "embedding").select("vec_id", "label")


@query("pca_2d")
def q_pca_2d(spark, sf):
    return vo.pca_2d(emb(spark, sf), "ckpt", "embedding", "vec_id")


@query("pca_wide")
def q_pca_wide(spark, sf):
    """Each checkpoint's vectors, concatenated in index order, form one long
    vector; the dual PCA places the checkpoints in 2-D."""
    e = emb(spark, sf)
    el = e.select("ckpt", "k", F.posexplode(vf.as_double("embedding")).alias("d", "value"))
    el = el.select(F.col("ckpt").alias("item"), (F.col("k") * 64 + F.col("d")).alias("pos"), "value")
    return vo.pca_wide(el, "item", "pos", "value")


@query("pca_2d_spread", f"""
WITH e AS (SELECT vec_id, vec_id % 10 AS ckpt, u.d, ({_E})[u.d + 1] AS x FROM embeddings,
           LATERAL (SELECT unnest(range(0, len(embedding))) AS d) u),
m AS (SELECT *, x - avg(x) OVER (PARTITION BY ckpt, d) AS dev FROM e)
SELECT CAST(ckpt AS BIGINT) AS ckpt, vec_id, round(sum(dev * dev), 6) AS spread FROM m GROUP BY 1, 2""")
def q_pca_2d_spread(spark, sf):
    """Coordinates on all axes: their squares add up to the squared distance
    from the checkpoint's mean, whatever the axes are."""
    e = emb(spark, sf)
    dim = e.agg(F.max(F.size("embedding"))).first()[0]
    p = vo.pca_2d(e, "ckpt", "embedding", "vec_id", k=dim)
    return p.select(F.col("ckpt").cast("bigint").alias("ckpt"), "vec_id",
                    sum((F.col(f"pc{i + 1}") ** 2 for i in range(dim)), F.lit(0.0)).alias("spread"))


@query("pca_wide_spread", f"""
WITH e AS (SELECT vec_id % 10 AS item, CAST(vec_id // 10 AS BIGINT) * 64 + u.d AS pos, ({_E})[u.d + 1] AS value FROM embeddings,
           LATERAL (SELECT unnest(range(0, len(embedding))) AS d) u),
n AS (SELECT count(DISTINCT item) AS n FROM e),
m AS (SELECT pos, sum(value) / any_value(n.n) AS mean FROM e, n GROUP BY pos),
i AS (SELECT DISTINCT item FROM e)
SELECT CAST(i.item AS BIGINT) AS item, round(sum((coalesce(e.value, 0) - m.mean) ** 2), 6) AS spread
FROM i CROSS JOIN m LEFT JOIN e ON e.item = i.item AND e.pos = m.pos GROUP BY 1""")
def q_pca_wide_spread(spark, sf):
    """The checkpoints' long vectors on all nine axes that ten items have: the
    squares add up to the squared distance from the mean."""
    e = emb(spark, sf)
    el = e.select("ckpt", "k", F.posexplode(vf.as_double("embedding")).alias("d", "value"))
    el = el.select(F.col("ckpt").alias("item"), (F.col("k") * 64 + F.col("d")).alias("pos"), "value")
    p = vo.pca_wide(el, "item", "pos", "value", k=9)
    return p.select(F.col("item").cast("bigint").alias("item"), sum((F.col(f"pc{i + 1}") ** 2 for i in range(9)), F.lit(0.0)).alias("spread"))


@query("cross_checkpoint_pca_space")
def q_cross_checkpoint_pca_space(spark, sf):
    """C6 in the space of the plots: every checkpoint's layer centroids placed
    in 2-D by a PCA of that checkpoint, then the mean cosine over checkpoint pairs."""
    c = vo.centroids(emb(spark, sf), ["ckpt", "label"], "embedding")
    el = c.select("label", "ckpt", F.posexplode("centroid").alias("pos", "value"))
    return vo.cross_checkpoint_similarity(vo.pca_space(el, "label", "ckpt", "pos", "value"), "label", "ckpt", "coords")


@query("dequantize_groups", f"""WITH {_QUANT_SQL},
d AS (SELECT vec_id, k, list_transform(qv, lambda x: x * scale) AS dq FROM err)
SELECT vec_id, round(sum(list_sum(dq)), 6) AS sum_dequantized,
       round(max(list_max(list_transform(dq, lambda x: abs(x)))), 6) AS max_abs_dequantized
FROM d GROUP BY vec_id""")
def q_dequantize_groups(spark, sf):
    """H20 inverse: ``q * scale`` per group, summarised per vector."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    dim = len(e.select("embedding").first()[0])
    dq = e.select("vec_id", vf.dequantize_groups(
        vf.quantize_groups("embedding", dim, QUANT_GROUP)).alias("dq"))
    return dq.select("vec_id", F.aggregate("dq", F.lit(0.0), lambda a, x: a + x).alias("sum_dequantized"),
                     F.array_max(F.transform("dq", F.abs)).alias("max_abs_dequantized"))
