"""Training-log analytics.

A run's log is one long ordered sequence. Every sequential operator here
works on a per-run index (``group_positions``: no task sees a whole run), on
blocks of that index (a window inside a block, plus a carry from earlier blocks),
or by a segmented scan of the runs.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curio.functions.text import checkpoint_number
from curio.functions.timeutil import epoch_micros
from curio.operators.positions import SortKey, group_positions
from curio.operators.scan import RunningMean, segmented_scan

# --- fixed values -----------------------------------------------------------
# Log line formats written by the training loop:
#   "{iter} | loss {loss:.4f} | lr {lr:e} | {dt_ms:.2f}ms | mfu {mfu:.2f}%"
#   "step {iter}: train loss {train:.4f}, val loss {val:.4f}"
ITER_LINE = r"^(\d+) \| loss ([-\d.eE+]+) \| lr ([-\d.eE+]+) \| ([-\d.eE+]+)ms \| mfu ([-\d.eE+]+)%$"
EVAL_LINE = r"^step (\d+): train loss ([-\d.eE+]+), val loss ([-\d.eE+]+)$"
ITER_FORMAT = "%d | loss %.4f | lr %e | %.2fms | mfu %.2f%%"
EVAL_FORMAT = "step %d: train loss %.4f, val loss %.4f"
# running value: EMA_DECAY * previous + EMA_WEIGHT * new (written as two
# constants: 1 - 0.9 is not 0.1 in floating point)
EMA_DECAY = 0.9
EMA_WEIGHT = 0.1
EMA_START = 5          # the running value starts at the 6th iteration of a process
# ---------------------------------------------------------------------------


def checkpoint_catalog(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Checkpoint files -> ``(ckpt, path)``; names without a number are
    dropped. ``paths`` is e.g. ``spark.read.format("binaryFile")
    .option("pathGlobFilter", "*.pt").load(dir).select("path")`` (selecting
    only the path, the file contents are not read)."""
    name = F.element_at(F.split(F.col(path_col), "/"), -1)
    return paths.select(checkpoint_number(name).cast("bigint").alias("ckpt"),
                        F.col(path_col).alias("path")).filter(F.col("ckpt").isNotNull())


def list_checkpoints(spark, directory: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pt").load(directory)
    return checkpoint_catalog(files.select("path"))


def parse_iteration_lines(lines: DataFrame, line_col: str = "line",
                          run_col: str = "run") -> DataFrame:
    """A7, per-iteration lines -> ``(run, iter, loss, lr, dt_ms, mfu)``."""
    ln = F.col(line_col)
    ok = lines.filter(ln.rlike(ITER_LINE))

    def g(i, t):
        return F.regexp_extract(ln, ITER_LINE, i).try_cast(t)

    return ok.select(run_col, g(1, "bigint").alias("iter"), g(2, "double").alias("loss"),
                     g(3, "double").alias("lr"), g(4, "double").alias("dt_ms"),
                     (g(5, "double") / 100.0).alias("mfu"))


def parse_eval_lines(lines: DataFrame, line_col: str = "line", run_col: str = "run") -> DataFrame:
    """A7, evaluation lines -> ``(run, iter, split, loss)`` (two rows a line)."""
    ln = F.col(line_col)
    ok = lines.filter(ln.rlike(EVAL_LINE))
    it = F.regexp_extract(ln, EVAL_LINE, 1).try_cast("bigint")
    both = F.array(
        F.struct(F.lit("train").alias("split"),
                 F.regexp_extract(ln, EVAL_LINE, 2).try_cast("double").alias("loss")),
        F.struct(F.lit("val").alias("split"),
                 F.regexp_extract(ln, EVAL_LINE, 3).try_cast("double").alias("loss")))
    return ok.select(run_col, it.alias("iter"), F.inline(both))


def iteration_index(df: DataFrame, run_col: str, order: Sequence[SortKey], id_col: str,
                    idx_col: str = "iter") -> DataFrame:
    """0-based index of each row inside its run."""
    return group_positions(df, [run_col], order, id_col, idx_col)


def mean_loss_by_split(df: DataFrame, run_col: str, split_col: str, loss_col: str,
                       order: Sequence[SortKey], id_col: str, eval_iters: int) -> DataFrame:
    """Mean of the first ``eval_iters`` losses of each (run, split)."""
    idx = group_positions(df, [run_col, split_col], order, id_col, "__k")
    return idx.filter(F.col("__k") < eval_iters).groupBy(run_col, split_col).agg(
        F.avg(loss_col).alias("mean_loss"), F.count(F.lit(1)).alias("n"))


def best_so_far(df: DataFrame, run_col: str, iter_col: str, loss_col: str,
                block: int = 100_000, out: str = "best_loss") -> DataFrame:
    """E5: running minimum of the loss per run. Inside a block a window
    running min; the minimum of all earlier blocks comes from the block table."""
    b = df.withColumn("__b", F.floor(F.col(iter_col) / block).cast("bigint"))
    wb = Window.partitionBy(run_col, "__b").orderBy(iter_col).rowsBetween(
        Window.unboundedPreceding, 0)
    inner = b.withColumn("__m", F.min(loss_col).over(wb))
    blocks = b.groupBy(run_col, "__b").agg(F.min(loss_col).alias("__bm"))
    wp = Window.partitionBy(run_col).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    prev = blocks.select(run_col, "__b", F.min("__bm").over(wp).alias("__pm"))
    return inner.join(prev, [run_col, "__b"]).withColumn(
        out, F.least(F.col("__m"), F.coalesce(F.col("__pm"), F.col("__m")))) \
        .drop("__b", "__m", "__pm")


def step_durations(df: DataFrame, run_col: str, iter_col: str, ts_col: str,
                   out: str = "dt_s") -> DataFrame:
    """Seconds since the previous iteration of the run (null for the
    first): an equi join on ``(run, iter - 1)`` -- unique keys, no skew."""
    prev = df.select(F.col(run_col), (F.col(iter_col) + 1).alias(iter_col),
                     F.col(ts_col).alias("__prev_ts"))
    j = df.join(prev, [run_col, iter_col], "left")
    dtype = df.schema[ts_col].dataType
    secs = (epoch_micros(F.col(ts_col), dtype) - epoch_micros(F.col("__prev_ts"), dtype)) / 1e6
    return j.withColumn(out, secs).drop("__prev_ts")


def ema(df: DataFrame, run_col: str, iter_col: str, value_col: str, decay: float = EMA_DECAY,
        start: int = EMA_START, block: int | None = None, out: str = "ema",
        weight: float = EMA_WEIGHT) -> DataFrame:
    """``e = decay * e + weight * x`` from iteration ``start`` on,
    seeded by the first value; null before it. A null value leaves the running value
    as it is.

    Every step is a map ``e -> a * e + b`` and such maps compose associatively, a
    null is the identity: the running values are a segmented scan over the runs,
    which looks back over a whole run, whatever its length. (``block`` has no
    effect: the result doesn't depend on how the rows are cut.)"""
    live = df.withColumn("__x", F.when(F.col(iter_col) >= start, F.col(value_col).cast("double")))
    return segmented_scan(live, [run_col], [F.col(iter_col).asc_nulls_last()],
                          {out: RunningMean("__x", decay, weight)}).drop("__x")


def token_budget(batches: DataFrame, batch_col: str, n_tokens_col: str, grad_accum: int,
                 batch_size: int, seq_len: int) -> DataFrame:
    """Tokens per iteration (nominal ``G * B * L`` and counted) and tokens
    seen up to each iteration (a running sum over iterations)."""
    from curio.operators.lineage import running_totals
    it = batches.groupBy(F.floor(F.col(batch_col) / grad_accum).cast("bigint").alias("iter")) \
        .agg(F.sum(n_tokens_col).cast("bigint").alias("tokens_in_iter"))
    r = running_totals(it, "iter", ["tokens_in_iter"], [])
    return r.select("iter", "tokens_in_iter",
                    F.col("cum_tokens_in_iter").cast("bigint").alias("tokens_seen"),
                    ((F.col("iter") + 1) * grad_accum * batch_size * seq_len)
                    .cast("bigint").alias("nominal_tokens_seen"))


def format_iteration_line(it, loss, lr, dt_ms, mfu):
    return F.format_string(ITER_FORMAT, it, loss, lr, dt_ms, mfu * 100)


def format_eval_line(it, train, val):
    return F.format_string(EVAL_FORMAT, it, train, val)

