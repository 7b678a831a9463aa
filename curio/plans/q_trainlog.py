"""Queries for training-log analytics (A6, A7, D5, D6, E5-E7) and chat.

``events`` stands in for training logs: ``user_id`` is the run, the event
order (ts, event_id) the iteration, ``event_type`` the split and ``value``
the loss.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from curio.operators import chat as ch, trainlog as tl
from curio.operators.positions import asc, assign_positions
from curio.plans import sql as S
from curio.plans.flagship import BATCH_SIZE as B, GRAD_ACCUM as G
from curio.plans.q_text import checkpoint_names
from curio.plans.registry import query
from curio.sources import table

EVAL_ITERS = 5
SEQ_LEN = 128


def runs(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("run"), "event_id", "ts", F.col("event_type").alias("split"),
        F.col("value").alias("loss"))
    return tl.iteration_index(e, "run", [asc("ts")], "event_id", "iter")


_EV = """ev AS (SELECT user_id AS run, event_id, ts, event_type AS split, value AS loss,
              row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS iter FROM events)"""


def log_lines(spark, sf):
    """Log text derived from the events: 'purchase' events write an
    evaluation line, the others an iteration line."""
    r = runs(spark, sf)
    line = F.when(F.col("split") == "purchase",
                  tl.format_eval_line(F.col("iter"), F.col("loss"), F.col("loss") / 2)) \
        .otherwise(tl.format_iteration_line(F.col("iter"), F.col("loss"), F.col("loss") / 10000,
                                            F.col("loss") * 10, F.col("loss") / 100))
    return r.select("run", line.alias("line"))


@query("parse_training_log", f"""WITH {_EV}
SELECT run, iter, 'iter' AS kind, NULL::VARCHAR AS split, round(loss, 6) AS loss, round(loss / 10000, 6) AS lr,
       round(loss * 10, 6) AS dt_ms, round(loss / 100, 6) AS mfu FROM ev WHERE split <> 'purchase'
UNION ALL
SELECT run, iter, 'eval', 'train', round(loss, 6), NULL, NULL, NULL FROM ev WHERE split = 'purchase'
UNION ALL
SELECT run, iter, 'eval', 'val', round(loss / 2, 6), NULL, NULL, NULL FROM ev WHERE split = 'purchase'""")
def q_parse_training_log(spark, sf):
    lines = log_lines(spark, sf)
    it = tl.parse_iteration_lines(lines).withColumn("kind", F.lit("iter")) \
        .withColumn("split", F.lit(None).cast("string"))
    ev = tl.parse_eval_lines(lines).withColumn("kind", F.lit("eval"))
    return it.unionByName(ev, allowMissingColumns=True).select(
        "run", "iter", "kind", "split", "loss", "lr", "dt_ms", "mfu")


@query("mean_loss_by_split", f"""WITH {_EV},
k AS (SELECT *, row_number() OVER (PARTITION BY run, split ORDER BY ts, event_id) - 1 AS k FROM ev)
SELECT run, split, round(avg(loss), 6) AS mean_loss, count(*) AS n FROM k WHERE k < {EVAL_ITERS} GROUP BY 1, 2""")
def q_mean_loss_by_split(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("run"), "event_id", "ts", F.col("event_type").alias("split"),
        F.col("value").alias("loss"))
    return tl.mean_loss_by_split(e, "run", "split", "loss", [asc("ts")], "event_id", EVAL_ITERS)


@query("best_so_far", f"""WITH {_EV}
SELECT run, iter, round(min(loss) OVER (PARTITION BY run ORDER BY iter ROWS UNBOUNDED PRECEDING), 6) AS best_loss
FROM ev""")
def q_best_so_far(spark, sf):
    return tl.best_so_far(runs(spark, sf), "run", "iter", "loss").select("run", "iter", "best_loss")


@query("ema", f"""WITH RECURSIVE {_EV},
r AS (SELECT run, iter, loss AS e FROM ev WHERE iter = {tl.EMA_START}
      UNION ALL
      SELECT ev.run, ev.iter, {tl.EMA_DECAY} * r.e + {tl.EMA_WEIGHT} * ev.loss
      FROM r JOIN ev ON ev.run = r.run AND ev.iter = r.iter + 1)
SELECT ev.run, ev.iter, round(r.e, 6) AS ema FROM ev LEFT JOIN r ON ev.run = r.run AND ev.iter = r.iter""")
def q_ema(spark, sf):
    return tl.ema(runs(spark, sf), "run", "iter", "loss").select("run", "iter", "ema")


@query("ema_with_gaps", f"""WITH RECURSIVE {_EV},
g AS (SELECT run, iter, CASE WHEN split <> 'error' THEN loss END AS loss FROM ev),
r AS (SELECT run, iter, loss AS e FROM g WHERE iter = {tl.EMA_START}
      UNION ALL
      SELECT g.run, g.iter, CASE WHEN g.loss IS NULL THEN r.e WHEN r.e IS NULL THEN g.loss
             ELSE {tl.EMA_DECAY} * r.e + {tl.EMA_WEIGHT} * g.loss END
      FROM r JOIN g ON g.run = r.run AND g.iter = r.iter + 1)
SELECT g.run, g.iter, round(r.e, 6) AS ema FROM g LEFT JOIN r ON g.run = r.run AND g.iter = r.iter""")
def q_ema_with_gaps(spark, sf):
    """The running value where failed steps ('error' events) log no loss."""
    logged = runs(spark, sf).withColumn("loss", F.when(F.col("split") != "error", F.col("loss")))
    return tl.ema(logged, "run", "iter", "loss").select("run", "iter", "ema")


@query("step_durations", f"""WITH {_EV}
SELECT run, iter, round(epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY run ORDER BY iter)) / 1e6, 6) AS dt_s
FROM ev""")
def q_step_durations(spark, sf):
    return tl.step_durations(runs(spark, sf), "run", "iter", "ts").select("run", "iter", "dt_s")


@query("token_budget", f"""
WITH t AS (SELECT doc_id, len({S.words('text')}) AS n_tok,
                  row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents),
it AS (SELECT CAST(floor(floor(pos / {B}) / {G}) AS BIGINT) AS iter, CAST(sum(n_tok) AS BIGINT) AS tokens_in_iter
       FROM t GROUP BY 1)
SELECT iter, tokens_in_iter, CAST(sum(tokens_in_iter) OVER (ORDER BY iter) AS BIGINT) AS tokens_seen,
       CAST((iter + 1) * {G * B * SEQ_LEN} AS BIGINT) AS nominal_tokens_seen FROM it""")
def q_token_budget(spark, sf):
    from curio.functions.text import words
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"),
                                             F.size(words("text")).alias("n_tok"))
    p = assign_positions(d, [], "id", "pos")
    per_batch = p.groupBy(F.floor(F.col("pos") / B).cast("bigint").alias("batch_no")) \
        .agg(F.sum("n_tok").alias("n_tok"))
    return tl.token_budget(per_batch, "batch_no", "n_tok", G, B, SEQ_LEN)


@query("checkpoint_catalog", """
WITH n AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'model.pt'
  WHEN 'view' THEN 'ckpt_x' || CAST(event_id AS VARCHAR) || '.pt'
  ELSE 'out/ckpt_' || CAST(event_id AS VARCHAR) || '.pt' END AS path FROM events)
SELECT TRY_CAST(regexp_extract(path, 'ckpt_(.*?)\\.pt', 1) AS BIGINT) AS ckpt, path FROM n
WHERE TRY_CAST(regexp_extract(path, 'ckpt_(.*?)\\.pt', 1) AS BIGINT) IS NOT NULL""")
def q_checkpoint_catalog(spark, sf):
    return tl.checkpoint_catalog(checkpoint_names(spark, sf).select(F.col("name").alias("path")))


@query("render_chat_prompt", """
WITH f AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'system') AS sys,
                  min(turn) FILTER (WHERE role = 'user') AS first_user FROM conversations GROUP BY conv_id)
SELECT c.conv_id, c.turn,
       CASE WHEN c.turn = f.first_user AND f.sys IS NOT NULL AND f.sys <> ''
            THEN '[INST] <<SYS>>' || chr(10) || f.sys || chr(10) || '<</SYS>>' || chr(10) || chr(10) || c.text || ' [/INST]'
            ELSE '[INST] ' || c.text || ' [/INST]' END AS prompt
FROM conversations c LEFT JOIN f ON c.conv_id = f.conv_id WHERE c.role = 'user'""")
def q_render_chat_prompt(spark, sf):
    return ch.render_chat_prompt(table(spark, sf, "conversations"))
