"""Curve analytics.

Curves are long tables ``(run, side, ckpt, metric, value)``: one row per
checkpoint and metric, so their size grows with the number of checkpoints,
not with the corpus. Windows partition by ``(run, side, metric)``.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metric_columns(df: DataFrame, exclude: Iterable[str] = ("id", "tokens", "checkpoint_name",
                                                             "ckpt", "text", "global_idx", "run",
                                                             "n_rows")) -> list[str]:
    """B1: the metric columns are all columns except the excluded ones."""
    ex = set(exclude)
    return [c for c in df.columns if c not in ex]


def _finite(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def extent(df: DataFrame, column: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Min and max of a metric over its non-null, non-NaN values."""
    g = df.groupBy(*group_cols) if group_cols else df.groupBy()
    return g.agg(F.min(_finite(F.col(column))).alias("min_value"),
                 F.max(_finite(F.col(column))).alias("max_value"))


def normalize_minmax(df: DataFrame, value_col: str = "value",
                     partition_cols: Sequence[str] = ("run", "side", "metric"),
                     out_col: str = "norm") -> DataFrame:
    """``(x - min) / (max - min)`` within each curve; 0.0 when the curve is
    constant. The extent is taken over non-null, non-NaN values."""
    w = Window.partitionBy(*partition_cols)
    v = F.col(value_col)
    lo = F.min(_finite(v)).over(w)
    hi = F.max(_finite(v)).over(w)
    return df.withColumn(out_col, F.when(hi == lo, F.when(v.isNotNull(), F.lit(0.0)))
                         .otherwise((v - lo) / (hi - lo)))


def to_long(wide: DataFrame, id_cols: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide (one column per metric) -> long ``(id_cols, metric, value)``."""
    return wide.select(*id_cols, *[F.col(m).cast("double").alias(m) for m in metrics]) \
        .unpivot(list(id_cols), list(metrics), "metric", "value")


def saturation_curves(tables: dict[str, DataFrame], metrics: Sequence[str],
                      ckpt_col: str = "ckpt", run_col: str = "run") -> DataFrame:
    """Per-checkpoint metric tables (one per side, e.g. ``input`` and
    ``output``) -> ``(run, side, ckpt, metric, value, norm)``."""
    parts = []
    for side, t in tables.items():
        cols = [run_col] if run_col in t.columns else []
        base = t.select(*([F.col(run_col)] if cols else [F.lit("default").alias(run_col)]),
                        F.col(ckpt_col).cast("bigint").alias("ckpt"), *metrics)
        parts.append(to_long(base, [run_col, "ckpt"], metrics)
                     .withColumn("side", F.lit(side)))
    long = concat_rows(parts)
    return normalize_minmax(long, "value", (run_col, "side", "metric"))


def pair_curves(curves: DataFrame, left: str = "input", right: str = "output") -> DataFrame:
    """C4: input and output curves side by side on ``(run, ckpt, metric)``
    (full outer join: a checkpoint present on one side only keeps its row)."""
    a = curves.filter(F.col("side") == left).select(
        "run", "ckpt", "metric", F.col("value").alias(f"{left}_value"),
        F.col("norm").alias(f"{left}_norm"))
    b = curves.filter(F.col("side") == right).select(
        "run", "ckpt", "metric", F.col("value").alias(f"{right}_value"),
        F.col("norm").alias(f"{right}_norm"))
    return a.join(b, ["run", "ckpt", "metric"], "full_outer")


def compare_runs(curves: DataFrame, run_a: str, run_b: str, side: str | None = None) -> DataFrame:
    """Two runs over the same data: per-checkpoint delta ``b - a`` and the
    delta of the end points (each run's value at its last checkpoint)."""
    c = curves if side is None else curves.filter(F.col("side") == side)
    keys = ["ckpt", "metric"] + (["side"] if "side" in c.columns else [])
    a = c.filter(F.col("run") == run_a).select(*keys, F.col("value").alias("value_a"))
    b = c.filter(F.col("run") == run_b).select(*keys, F.col("value").alias("value_b"))
    per = a.join(b, keys, "full_outer").withColumn("delta", F.col("value_b") - F.col("value_a"))
    gk = [k for k in keys if k != "ckpt"]
    ends = c.filter(F.col("run").isin(run_a, run_b)).groupBy(*gk).agg(
        F.max_by(F.when(F.col("run") == run_a, F.col("value")),
                 F.when(F.col("run") == run_a, F.col("ckpt"))).alias("end_a"),
        F.max_by(F.when(F.col("run") == run_b, F.col("value")),
                 F.when(F.col("run") == run_b, F.col("ckpt"))).alias("end_b"))
    ends = ends.withColumn("end_delta", F.col("end_b") - F.col("end_a"))
    return per.join(ends, gk, "left")


def saturation_point(curves: DataFrame, eps: float, value_col: str = "value",
                     partition_cols: Sequence[str] = ("run", "side", "metric")) -> DataFrame:
    """First checkpoint from which the curve stays within ``eps`` of its
    final value (a reverse running max of the deviation)."""
    pc = list(partition_cols)
    final = curves.groupBy(*pc).agg(F.max_by(value_col, "ckpt").alias("final_value"))
    dev = curves.join(final, pc).withColumn(
        "dev", F.abs(F.col(value_col) - F.col("final_value")))
    w = Window.partitionBy(*pc).orderBy("ckpt").rowsBetween(0, Window.unboundedFollowing)
    dev = dev.withColumn("max_dev_after", F.max("dev").over(w))
    return dev.filter(F.col("max_dev_after") <= F.lit(eps)).groupBy(*pc).agg(
        F.min("ckpt").alias("saturation_ckpt"), F.first("final_value").alias("final_value"))


def select_run_view(curves: DataFrame, run: str, ckpts: Iterable[int] | None = None,
                    metric: str | None = None) -> DataFrame:
    """One run, an optional set of checkpoints and metric (partition
    pruning applies when the table is partitioned by ``run``)."""
    f = F.col("run") == F.lit(run)
    if ckpts is not None:
        f = f & F.col("ckpt").isin(list(ckpts))
    if metric is not None:
        f = f & (F.col("metric") == F.lit(metric))
    return curves.filter(f)


def concat_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """G1: stack frames by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def hstack_key(df: DataFrame, name: str, value) -> DataFrame:
    """Add a constant key column (e.g. the checkpoint) to a result."""
    return df.withColumn(name, F.lit(value))


def flatten_ids(df: DataFrame, col: str, out: str = "id") -> DataFrame:
    """A list-of-lists column (ids per batch) -> one row per id."""
    return df.select(*[c for c in df.columns if c != col],
                     F.explode(F.flatten(F.col(col))).alias(out))
