"""Queries for ordering, lineage and curves (B1-B4, B9, C1-C4, C9, D1, D7, D9,
E1-E4, E10, F1-F10, G1-G3, I7, I10, I11, K1) and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from curio.operators import curves as cv, lineage as ln, order as od
from curio.operators.flows import evaluate_checkpoints
from curio.operators.positions import asc, desc, assign_positions
from curio.plans import sql as S
from curio.plans.flagship import (BATCH_SIZE as B, EVAL_INTERVAL as STEP, FLAGSHIP_METRICS,
                                  GRAD_ACCUM as G, curriculum_means, flagship, ordered_train,
                                  scored_documents)
from curio.plans.registry import query
from curio.session import materialize
from curio.sources import table

M = FLAGSHIP_METRICS
FK, DIV, PROF = "flesch_kincaid_grade", "vocabulary_diversity", "profanity_check"
ALL_M = (FK, DIV, PROF)


def scored(spark, sf):
    return scored_documents(spark, sf, metrics=ALL_M, extra=("lang", "source", "n_chars"),
                            terms=S.QUERY_TERMS)


def _pos_sql(order_sql: str, where: str = "") -> str:
    return f"""WITH {S.scored_cte()}
SELECT id, row_number() OVER (ORDER BY {order_sql}id) - 1 AS pos FROM sc {where}"""


# ---- orders ----------------------------------------------------------------

@query("sort_ascending", _pos_sql(S.asc_key(FK) + ", "))
def q_sort_ascending(spark, sf):
    return od.sort_ascending(scored(spark, sf), FK)


@query("sort_descending", _pos_sql(S.desc_key(DIV) + ", "))
def q_sort_descending(spark, sf):
    return od.sort_descending(scored(spark, sf), DIV)


@query("filter_by_threshold", _pos_sql("", f"WHERE {PROF} > 0.0 AND NOT isnan({PROF})"))
def q_filter_by_threshold(spark, sf):
    return od.filter_by_threshold(scored(spark, sf), PROF, 0.0)


@query("combined_transform", _pos_sql(S.asc_key(DIV) + ", ", f"WHERE {DIV} > 0.6 AND NOT isnan({DIV})"))
def q_combined_transform(spark, sf):
    return od.combined_transform(scored(spark, sf), DIV, 0.6)


@query("order_identity", _pos_sql(""))
def q_order_identity(spark, sf):
    return od.order_identity(scored(spark, sf))


@query("order_custom", _pos_sql("lang, " + S.desc_key("n_chars") + ", "))
def q_order_custom(spark, sf):
    return od.order_custom(scored(spark, sf), [asc("lang"), desc("n_chars")])


@query("dispatch_order", _pos_sql(S.asc_key(FK) + ", ", f"WHERE {FK} > 0.0 AND NOT isnan({FK})"))
def q_dispatch_order(spark, sf):
    return od.dispatch_order(scored(spark, sf), "combined_transform", FK, 0.0)


@query("register_order", _pos_sql(S.desc_key("n_chars") + ", "))
def q_register_order(spark, sf):
    od.register_order("longest_first",
                      lambda df, column, threshold, id_col: od.order_custom(
                          df, [desc(column)], id_col))
    return od.dispatch_order(scored(spark, sf), "longest_first", "n_chars")


@query("head", "SELECT doc_id AS id, lang FROM documents ORDER BY doc_id LIMIT 500")
def q_head(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    return od.head(d, 500, "id")


@query("train_valid_split", """
SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS split_pos,
       CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < CAST(floor(0.9 * count(*) OVER ()) AS BIGINT)
            THEN 'train' ELSE 'valid' END AS split
FROM documents""")
def q_train_valid_split(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    tr = od.train_valid_split(d, "train", "id").withColumn("split", F.lit("train"))
    va = od.train_valid_split(d, "valid", "id").withColumn("split", F.lit("valid"))
    return od.split_positions(tr.unionByName(va), "id")


@query("lookup_by_id", """
SELECT d.doc_id, d.lang, d.n_chars FROM documents d
WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def q_lookup_by_id(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    ids = table(spark, sf, "labels").filter(F.col("toxic") == 1).select("doc_id")
    return od.lookup_by_id(d, ids, "doc_id")


@query("assign_dense_ids", """
SELECT doc_id, source, row_number() OVER (ORDER BY source, n_chars, doc_id) - 1 AS id FROM documents""")
def q_assign_dense_ids(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return od.assign_dense_ids(d, [asc("source"), asc("n_chars")], "doc_id", "id") \
        .select("doc_id", "source", "id")


@query("assign_positions", f"""WITH {S.scored_cte()},
p AS (SELECT id, row_number() OVER (ORDER BY {S.asc_key(FK)}, id) - 1 AS pos FROM sc)
SELECT id, pos, CAST(floor(pos / {B}) AS BIGINT) AS batch_no FROM p""")
def q_assign_positions(spark, sf):
    p = assign_positions(scored(spark, sf).select("id", FK), [asc(FK)], "id", "pos")
    return od.batch_numbers(p, B).select("id", "pos", "batch_no")


# ---- lineage ---------------------------------------------------------------

def _identity_positions(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return assign_positions(d, [], "id", "pos")


def _ckpts(spark, n):
    return ln.checkpoint_schedule(spark, n, B, G, STEP)


_MEMBER_SQL = f"""
p AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS pos,
             count(*) OVER () AS n FROM documents),
ck AS (SELECT unnest(range({STEP}, (SELECT CAST(ceil(max(n) / {G * B}.0) AS BIGINT) FROM p), {STEP})) AS ckpt),
mem AS (SELECT ck.ckpt, p.id FROM ck JOIN p ON p.pos < {B} * (1 + ck.ckpt * {G}))"""


@query("checkpoint_membership", f"WITH {_MEMBER_SQL} SELECT ckpt, id FROM mem")
def q_checkpoint_membership(spark, sf):
    p = _identity_positions(spark, sf)
    return ln.checkpoint_membership(p, _ckpts(spark, p.count()), B, G, STEP)


@query("filter_consumed", f"""WITH {_MEMBER_SQL}
SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT id FROM mem WHERE ckpt = (SELECT max(ckpt) FROM ck))""")
def q_filter_consumed(spark, sf):
    p = _identity_positions(spark, sf)
    last = ln.consumed_by(p, _ckpts(spark, p.count()).agg(F.max("ckpt")).first()[0], B, G, STEP)
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return ln.filter_consumed(d, last.select(F.col("id").alias("doc_id")), "doc_id")


_MEANS_SQL = f"""WITH {S.scored_cte()}, {_MEMBER_SQL}
SELECT ck.ckpt, count(sc.id) AS n_rows, round(avg(sc.{FK}), 6) AS {FK}, round(avg(sc.{DIV}), 6) AS {DIV}
FROM ck LEFT JOIN mem ON mem.ckpt = ck.ckpt LEFT JOIN sc ON sc.id = mem.id GROUP BY ck.ckpt"""


@query("checkpoint_means", _MEANS_SQL)
def q_checkpoint_means(spark, sf):
    p = assign_positions(scored(spark, sf).select("id", *M), [], "id", "pos")
    return ln.interval_means(p, ln.consumed_intervals(_ckpts(spark, p.count()), B, G), list(M))


@query("cumulative_checkpoint_means", _MEANS_SQL)
def q_cumulative_checkpoint_means(spark, sf):
    s = scored(spark, sf)
    p = assign_positions(s.select("id", *M), [], "id", "pos")
    return ln.cumulative_checkpoint_means(p, _ckpts(spark, p.count()), list(M), B, G, STEP)


@query("attach_metadata", """
SELECT d.doc_id, d.lang, CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_attach_metadata(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    lb = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return ln.attach_metadata(d, lb, "doc_id")


@query("collect_batches", f"""
WITH p AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT CAST(floor(pos / {B}) AS BIGINT) AS batch_no, count(*) AS n_rows,
       string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS ids
FROM p GROUP BY 1""")
def q_collect_batches(spark, sf):
    p = od.batch_numbers(_identity_positions(spark, sf), B)
    b = ln.collect_batches(p, "batch_no", "pos", ["id"])
    return b.select("batch_no", F.size("rows").alias("n_rows"),
                    F.array_join(F.transform("rows", lambda r: r["id"].cast("string")), ",")
                    .alias("ids"))


# tokens for batches: the word lengths of a document, as ids
def _word_length_tokens(col="text"):
    from curio.functions.text import words
    return F.transform(words(col), lambda w: F.length(w))


@query("make_batches", f"""WITH {S.scored_cte()},
t AS (SELECT d.doc_id AS id, list_transform({S.words('d.text')}, lambda w: length(w)) AS tokens,
             sc.{FK} AS fk, row_number() OVER (ORDER BY d.doc_id) - 1 AS pos
      FROM documents d JOIN sc ON sc.id = d.doc_id)
SELECT CAST(floor(pos / {B}) AS BIGINT) AS batch_no, count(*) AS n_rows,
       string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS ids,
       CAST(sum(greatest(len(tokens) - 1, 0)) AS BIGINT) AS n_x_tokens,
       CAST(sum(coalesce(list_sum(tokens[2:]), 0)) AS BIGINT) AS sum_y,
       round(avg(fk), 6) AS mean_fk
FROM t GROUP BY 1""")
def q_make_batches(spark, sf):
    s = scored(spark, sf).select("id", FK)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"),
                                             _word_length_tokens().alias("tokens"))
    # written, as ordering reads its input twice
    p = assign_positions(materialize(d.join(s, "id"), "batch-rows"), [], "id", "pos")
    b = ln.make_batches(p, B, "tokens", [FK])
    r = F.col("rows")
    return b.select(
        "batch_no", F.size(r).alias("n_rows"),
        F.array_join(F.transform(r, lambda x: x["id"].cast("string")), ",").alias("ids"),
        F.aggregate(r, F.lit(0).cast("bigint"), lambda a, x: a + F.size(x["x"])).alias("n_x_tokens"),
        F.aggregate(r, F.lit(0).cast("bigint"),
                    lambda a, x: a + F.aggregate(x["y"], F.lit(0).cast("bigint"),
                                                 lambda u, v: u + v)).alias("sum_y"),
        (F.aggregate(r, F.lit(0.0), lambda a, x: a + x["metrics"][FK]) / F.size(r)).alias("mean_fk"))


# ---- flagship and curves ---------------------------------------------------

_FLAGSHIP_SQL = f"""WITH {S.scored_cte()}, {S.curriculum_cte('a', S.asc_key(FK))},
lg AS ({S.unpivot_metrics('a_mean', 'ckpt, n_rows', M)})
SELECT ckpt, metric, n_rows, round(value, 6) AS value, round({S.norm_sql('value', 'PARTITION BY metric')}, 6) AS norm
FROM lg"""


@query("flagship", _FLAGSHIP_SQL)
def q_flagship(spark, sf):
    return flagship(spark, sf)


@query("normalize_minmax", _FLAGSHIP_SQL)
def q_normalize_minmax(spark, sf):
    return flagship(spark, sf)


def _input_output_tables(spark, sf):
    """Input side: cumulative means of the consumed documents in ascending
    grade order. Output side: the assistant replies of ``conversations``
    scored per checkpoint (the k-th reply stands for checkpoint k*STEP)."""
    ordered, n = ordered_train(scored_documents(spark, sf), asc(FK))
    conv = table(spark, sf, "conversations").filter(F.col("role") == "assistant").select(
        ((F.floor(F.col("turn") / 2) + 1) * STEP).cast("bigint").alias("ckpt"), "text")
    return evaluate_checkpoints(conv, ordered, _ckpts(spark, n), M, B, G, STEP)


_OUT_SQL = f"""
cv AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
{S.text_stats_cte(table='cv', key='conv_id', extra=', turn', name='cst')},
o_mean AS (SELECT CAST((floor(turn / 2) + 1) * {STEP} AS BIGINT) AS ckpt,
                  avg({S.FK}) AS {FK}, avg({S.DIV}) AS {DIV} FROM cst GROUP BY 1)"""

_CURVES_SQL = f"""WITH {S.scored_cte()}, {S.curriculum_cte('a', S.asc_key(FK))}, {_OUT_SQL},
lg AS (SELECT 'default' AS run, 'input' AS side, * FROM ({S.unpivot_metrics('a_mean', 'ckpt', M)})
       UNION ALL
       SELECT 'default' AS run, 'output' AS side, * FROM ({S.unpivot_metrics('o_mean', 'ckpt', M)})),
curves AS (SELECT run, side, ckpt, metric, value,
                  {S.norm_sql('value', 'PARTITION BY run, side, metric')} AS norm FROM lg)"""


@query("saturation_curves", f"""{_CURVES_SQL}
SELECT run, side, ckpt, metric, round(value, 6) AS value, round(norm, 6) AS norm FROM curves""")
def q_saturation_curves(spark, sf):
    return cv.saturation_curves(_input_output_tables(spark, sf), list(M))


@query("evaluate_checkpoints", f"""{_CURVES_SQL}
SELECT side, ckpt, metric, round(value, 6) AS value FROM curves""")
def q_evaluate_checkpoints(spark, sf):
    t = _input_output_tables(spark, sf)
    return cv.concat_rows([cv.to_long(v.select("ckpt", *M), ["ckpt"], list(M))
                           .withColumn("side", F.lit(k)) for k, v in t.items()])


@query("pair_curves", f"""{_CURVES_SQL}
SELECT coalesce(i.run, o.run) AS run, coalesce(i.ckpt, o.ckpt) AS ckpt, coalesce(i.metric, o.metric) AS metric,
       round(i.value, 6) AS input_value, round(i.norm, 6) AS input_norm,
       round(o.value, 6) AS output_value, round(o.norm, 6) AS output_norm
FROM (SELECT * FROM curves WHERE side = 'input') i
FULL OUTER JOIN (SELECT * FROM curves WHERE side = 'output') o
  ON i.run = o.run AND i.ckpt = o.ckpt AND i.metric = o.metric""")
def q_pair_curves(spark, sf):
    return cv.pair_curves(cv.saturation_curves(_input_output_tables(spark, sf), list(M)))


@query("saturation_point", f"""{_CURVES_SQL},
fin AS (SELECT run, side, metric, arg_max(value, ckpt) AS final_value FROM curves GROUP BY 1, 2, 3),
dv AS (SELECT c.*, f.final_value, abs(c.value - f.final_value) AS dev FROM curves c JOIN fin f USING (run, side, metric)),
mx AS (SELECT *, max(dev) OVER (PARTITION BY run, side, metric ORDER BY ckpt
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mda FROM dv)
SELECT run, side, metric, min(ckpt) AS saturation_ckpt, round(min(final_value), 6) AS final_value
FROM mx WHERE mda <= 0.05 GROUP BY 1, 2, 3""")
def q_saturation_point(spark, sf):
    c = cv.saturation_curves(_input_output_tables(spark, sf), list(M))
    return cv.saturation_point(c, 0.05)


@query("select_run_view", f"""{_CURVES_SQL}
SELECT run, side, ckpt, metric, round(value, 6) AS value FROM curves
WHERE run = 'default' AND ckpt IN (5, 15, 25) AND metric = '{FK}'""")
def q_select_run_view(spark, sf):
    c = cv.saturation_curves(_input_output_tables(spark, sf), list(M))
    return cv.select_run_view(c, "default", [5, 15, 25], FK).select(
        "run", "side", "ckpt", "metric", "value")


@query("sort_by_checkpoint", f"""{_CURVES_SQL}
SELECT ckpt, metric, round(value, 6) AS value FROM curves WHERE side = 'output' ORDER BY ckpt""")
def q_sort_by_checkpoint(spark, sf):
    c = cv.saturation_curves(_input_output_tables(spark, sf), list(M))
    return od.sort_by_checkpoint(c.filter(F.col("side") == "output"), "ckpt").select(
        "ckpt", "metric", "value")


_RUNS_SQL = f"""WITH {S.scored_cte()}, {S.curriculum_cte('a', S.asc_key(FK))}, {S.curriculum_cte('b', S.desc_key(FK))},
lg AS (SELECT 'asc' AS run, * FROM ({S.unpivot_metrics('a_mean', 'ckpt', M)})
       UNION ALL SELECT 'desc' AS run, * FROM ({S.unpivot_metrics('b_mean', 'ckpt', M)}))"""


def _two_runs(spark, sf):
    s = scored_documents(spark, sf)
    parts = []
    for run, key in (("asc", asc(FK)), ("desc", desc(FK))):
        m = curriculum_means(spark, s, key).drop("n_rows")
        parts.append(cv.to_long(m, ["ckpt"], list(M)).withColumn("run", F.lit(run)))
    return cv.concat_rows(parts)


@query("compare_runs", f"""{_RUNS_SQL},
e AS (SELECT metric, arg_max(CASE WHEN run = 'asc' THEN value END, CASE WHEN run = 'asc' THEN ckpt END) AS end_a,
             arg_max(CASE WHEN run = 'desc' THEN value END, CASE WHEN run = 'desc' THEN ckpt END) AS end_b
      FROM lg GROUP BY metric)
SELECT coalesce(a.ckpt, b.ckpt) AS ckpt, coalesce(a.metric, b.metric) AS metric,
       round(a.value, 6) AS value_a, round(b.value, 6) AS value_b, round(b.value - a.value, 6) AS delta,
       round(e.end_a, 6) AS end_a, round(e.end_b, 6) AS end_b, round(e.end_b - e.end_a, 6) AS end_delta
FROM (SELECT * FROM lg WHERE run = 'asc') a FULL OUTER JOIN (SELECT * FROM lg WHERE run = 'desc') b
  ON a.ckpt = b.ckpt AND a.metric = b.metric
LEFT JOIN e ON e.metric = coalesce(a.metric, b.metric)""")
def q_compare_runs(spark, sf):
    return cv.compare_runs(_two_runs(spark, sf), "asc", "desc")


@query("concat_rows", f"""{_RUNS_SQL}
SELECT run, ckpt, metric, round(value, 6) AS value FROM lg""")
def q_concat_rows(spark, sf):
    return _two_runs(spark, sf).select("run", "ckpt", "metric", "value")


@query("extent", f"""WITH {S.scored_cte()}
SELECT lang, round(min(CASE WHEN isnan({FK}) THEN NULL ELSE {FK} END), 6) AS min_value,
       round(max(CASE WHEN isnan({FK}) THEN NULL ELSE {FK} END), 6) AS max_value FROM sc GROUP BY lang""")
def q_extent(spark, sf):
    return cv.extent(scored(spark, sf), FK, ["lang"])


@query("metric_columns", f"""WITH {S.scored_cte()}
SELECT id, round({FK}, 6) AS {FK}, round({DIV}, 6) AS {DIV}, round({PROF}, 6) AS {PROF} FROM sc""")
def q_metric_columns(spark, sf):
    s = scored(spark, sf)
    keep = cv.metric_columns(s, exclude=("id", "lang", "source", "n_chars"))
    return s.select("id", *keep)


@query("hstack_key", f"""WITH {_OUT_SQL}
SELECT 'conversations' AS source, ckpt, round({FK}, 6) AS {FK}, round({DIV}, 6) AS {DIV} FROM o_mean""")
def q_hstack_key(spark, sf):
    out = _input_output_tables(spark, sf)["output"]
    return cv.hstack_key(out, "source", "conversations")


@query("flatten_ids", f"""
WITH p AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT CAST(floor(pos / {B * G}) AS BIGINT) AS step_no, id FROM p""")
def q_flatten_ids(spark, sf):
    p = od.batch_numbers(_identity_positions(spark, sf), B)
    per_batch = p.groupBy("batch_no").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    per_step = per_batch.groupBy((F.floor(F.col("batch_no") / G)).cast("bigint").alias("step_no")) \
        .agg(F.collect_list("ids").alias("batches"))
    return cv.flatten_ids(per_step, "batches", "id")
