"""Batch and checkpoint lineage.

Training semantics (batch size B, G micro-steps per iteration, checkpoint
every ``step`` iterations): one batch is fetched before the loop and G more in
each iteration, and checkpoint N is written at the start of iteration N. So
checkpoint N has fetched ``1 + N*G`` batches: the rows with
``pos < B * (1 + N*G)`` (the last of those batches is prefetched, not yet
trained on; ``include_prefetched=False`` drops it). Checkpoints exist for
N = step, 2*step, ... while batch ``N*G`` exists (``N*G*B < n``), up to
``max_iter``.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curio.functions.tokens import shift_pairs
from curio.operators._util import broadcast_if_small
from curio.operators.scan import RunningSum, segmented_scan

# Checkpoints of a row that stay together, and pairs of a row and a checkpoint a task makes.
STRETCH = 256
PAIRS_PER_TASK = 4_000_000


def checkpoint_schedule(spark: SparkSession, n_rows: int, batch_size: int, grad_accum: int,
                        step: int, max_iter: int | None = None) -> DataFrame:
    """``(ckpt)`` for every checkpoint the run writes; built with
    ``spark.range`` so a long run does not pass a list through the driver."""
    last = (n_rows - 1) // (grad_accum * batch_size) if n_rows > 0 else 0
    if max_iter is not None:
        last = min(last, max_iter)
    last = (last // step) * step
    if last < step:
        return spark.range(0).select(F.col("id").alias("ckpt"))
    return spark.range(step, last + 1, step).select(F.col("id").alias("ckpt"))


def first_checkpoint(pos: Column, batch_size: int, grad_accum: int, step: int,
                     include_prefetched: bool = True) -> Column:
    """Smallest checkpoint N (positive multiple of ``step``) that has consumed
    the row at ``pos``."""
    b = F.floor(pos / F.lit(batch_size))
    if not include_prefetched:
        b = b + 1
    need = F.ceil(b / F.lit(grad_accum))
    return F.greatest(F.lit(step), F.ceil(need / F.lit(step)) * step).cast("bigint")


def checkpoint_membership(positions: DataFrame, ckpts: DataFrame, batch_size: int,
                          grad_accum: int, step: int, include_prefetched: bool = True,
                          id_col: str = "id", pos_col: str = "pos") -> DataFrame:
    """``(ckpt, id)`` for every row each checkpoint has consumed.

    Each row's first checkpoint is a column expression, so the range join
    becomes an explode of ``sequence(first, last, step)`` -- linear in the
    output, no nested-loop join. (Output size is rows x checkpoints by
    nature; E4 avoids materialising it.) Early rows have the most checkpoints and a
    positions table has few splits, so a row is first cut into stretches of
    ``STRETCH`` checkpoints and these are dealt out, to a task for every
    ``PAIRS_PER_TASK`` pairs: tasks grow in number, not in length."""
    last = ckpts.agg(F.max("ckpt").alias("m")).collect()[0]["m"]
    if last is None:
        return positions.sparkSession.createDataFrame([], "ckpt bigint, id bigint")
    first = first_checkpoint(F.col(pos_col), batch_size, grad_accum, step, include_prefetched)
    end, span = F.lit(last).cast("bigint"), F.lit(STRETCH * step).cast("bigint")
    rows = positions.select(F.col(id_col).cast("bigint").alias("id"), first.alias("f")).filter(F.col("f") <= end)
    pairs = rows.agg(F.sum(F.floor((end - F.col("f")) / step) + 1)).first()[0] or 0
    tasks = max(-(-pairs // PAIRS_PER_TASK), 1)
    starts = rows.select(F.explode(F.sequence("f", end, span)).alias("f"), "id").repartition(tasks)
    upto = F.least(F.col("f") + span - F.lit(step), end)
    m = starts.select(F.explode(F.sequence("f", upto, F.lit(step).cast("bigint"))).alias("ckpt"), "id")
    return m.join(broadcast_if_small(ckpts.select(F.col("ckpt").cast("bigint"))), "ckpt",
                  "left_semi")


def consumed_by(positions: DataFrame, ckpt, batch_size: int, grad_accum: int, step: int,
                include_prefetched: bool = True, pos_col: str = "pos") -> DataFrame:
    """Rows that checkpoint ``ckpt`` (a number or column) has consumed: those
    whose first checkpoint is not after it. A filter on the position, so no row is
    repeated per checkpoint; no checkpoint (null), no rows."""
    ckpt = F.lit(ckpt) if ckpt is None or isinstance(ckpt, int) else ckpt
    first = first_checkpoint(F.col(pos_col), batch_size, grad_accum, step, include_prefetched)
    return positions.filter(first <= ckpt.cast("bigint"))


def attach_metadata(tokens: DataFrame, metadata: DataFrame, id_col: str = "id") -> DataFrame:
    """Left equi-join on the id (duplicate ids on the right fan out)."""
    return tokens.join(metadata, id_col, "left")


def filter_consumed(df: DataFrame, consumed: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id was consumed, once each however often listed."""
    ids = consumed.select(F.col(id_col)).distinct()
    return df.join(ids, id_col, "left_semi")


def checkpoint_means(scored: DataFrame, membership: DataFrame, ckpts: DataFrame,
                     metrics: Sequence[str], id_col: str = "id") -> DataFrame:
    """D1 for any listing ``(ckpt, id)``; ``interval_means`` needs none. Mean of
    every metric per checkpoint over the consumed rows. A row
    counts once per checkpoint; a checkpoint without rows gives nulls."""
    m = membership.select("ckpt", F.col("id").alias(id_col)).distinct()
    j = m.join(scored.select(id_col, *metrics), id_col)
    agg = j.groupBy("ckpt").agg(F.count(F.lit(1)).alias("n_rows"),
                                *[F.avg(c).alias(c) for c in metrics])
    return ckpts.select(F.col("ckpt").cast("bigint")).join(agg, "ckpt", "left") \
        .withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("bigint"))


def consumed_intervals(ckpts: DataFrame, batch_size: int, grad_accum: int,
                       include_prefetched: bool = True) -> DataFrame:
    """``(ckpt, lo, hi)``: the positions ``lo <= pos < hi`` each checkpoint has consumed."""
    batches = F.col("ckpt") * grad_accum + (1 if include_prefetched else 0)
    return ckpts.select(F.col("ckpt").cast("bigint"), F.lit(0).cast("bigint").alias("lo"),
                        (batches * batch_size).cast("bigint").alias("hi"))


def interval_means(scored_positions: DataFrame, intervals: DataFrame, metrics: Sequence[str],
                   pos_col: str = "pos") -> DataFrame:
    """``(ckpt, n_rows, *metrics)``, the mean of every metric over the rows in the
    position intervals ``(ckpt, lo, hi)`` of each checkpoint; a checkpoint may have
    several, disjoint ones. No row is repeated per checkpoint: the cuts go among
    the rows, one scan gives the sums of all that stands before each cut, and an
    interval is the difference of two of them.

    Nulls don't count; a NaN or infinite value makes the means that hold it NaN.
    A checkpoint without rows has nulls and ``n_rows`` 0, one that has a null in
    its interval is as if that interval weren't there."""
    known = intervals.select(F.col("ckpt").cast("bigint").alias("ckpt"), F.col("lo").cast("bigint").alias("lo"),
                             F.col("hi").cast("bigint").alias("hi"))
    sums = ["n"] + [f"{v}{k}" for k in range(len(metrics)) for v in ("s", "c", "odd")]
    whole = lambda c: F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))
    values = []
    for k, m in enumerate(metrics):
        v = F.col(f"`{m}`").cast("double")
        odd = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
        values += [F.when(v.isNull() | odd, 0.0).otherwise(v).alias(f"s{k}"), whole(v.isNotNull()).alias(f"c{k}"),
                   whole(odd).alias(f"odd{k}")]
    rows = scored_positions.where(F.col(pos_col).isNotNull()).select(
        F.col(pos_col).cast("bigint").alias("at"), F.lit(1).alias("row"), F.lit(1).cast("bigint").alias("n"), *values)
    cuts = known.select(F.explode(F.array("lo", "hi")).alias("at")).where("at is not null").distinct()
    none = [F.lit(0.0 if c.startswith("s") else 0).cast("double" if c.startswith("s") else "bigint").alias(c) for c in sums]
    both = rows.unionByName(cuts.select("at", F.lit(0).alias("row"), *none))
    # a cut stands before the rows of its own position
    before = segmented_scan(both, [], [F.col("at").asc(), F.col("row").asc()],
                            {f"b_{c}": RunningSum(c) for c in sums}).where("row = 0").select(
        "at", F.struct(*[F.col(f"b_{c}").alias(c) for c in sums]).alias("sums"))
    ends = known.join(before.select(F.col("at").alias("lo"), F.col("sums").alias("a")), "lo", "left").join(
        before.select(F.col("at").alias("hi"), F.col("sums").alias("z")), "hi", "left")
    part = lambda c: F.sum(F.when(F.col("hi") > F.col("lo"), F.col(f"z.{c}") - F.col(f"a.{c}")))
    per = ends.groupBy("ckpt").agg(*[part(c).alias(c) for c in sums])
    out = [F.when(F.col(f"odd{k}") > 0, F.lit(float("nan"))).when(
        F.col(f"c{k}") > 0, F.col(f"s{k}") / F.col(f"c{k}")).alias(m) for k, m in enumerate(metrics)]
    return per.select("ckpt", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_rows"), *out)


def running_totals(df: DataFrame, order_col: str, value_cols: Sequence[str],
                   partition_cols: Sequence[str] = (), block: int = 100_000) -> DataFrame:
    """Running sums of ``value_cols`` along ``order_col`` within ``partition_cols``, as
    columns ``cum_*``, in two levels so no single task sees all rows: a running sum
    inside each block of ``block`` ranks, and the sum of all blocks before it, by one
    segmented scan over the block totals, whatever their number. ``order_col`` must be a
    non-negative integer rank (e.g. a checkpoint index); ranks may be missing, and rows
    without a rank or with a null partition key are left out. Null values add nothing."""
    pc = list(partition_cols)
    withb = df.withColumn("__blk", F.floor(F.col(order_col) / F.lit(block)).cast("bigint"))
    totals = withb.where("__blk is not null").groupBy(*pc, "__blk").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"__t_{c}") for c in value_cols])
    # in what stands before a block its own total is taken off again, so whole numbers stay exact
    before = segmented_scan(totals, pc, [F.col("__blk").asc()], {f"__o_{c}": RunningSum(f"__t_{c}") for c in value_cols})
    offsets = before.select(*pc, "__blk", *[(F.col(f"__o_{c}") - F.col(f"__t_{c}")).alias(f"__o_{c}") for c in value_cols])
    wr = Window.partitionBy(*pc, "__blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    inner = withb.select("*", *[F.coalesce(F.sum(c).over(wr), F.lit(0)).alias(f"__r_{c}") for c in value_cols])
    out = inner.join(offsets, [*pc, "__blk"])
    for c in value_cols:
        out = out.withColumn(f"cum_{c}", F.col(f"__r_{c}") + F.col(f"__o_{c}"))
    return out.select(*df.columns, *[f"cum_{c}" for c in value_cols])


def cumulative_checkpoint_means(scored_positions: DataFrame, ckpts: DataFrame,
                                metrics: Sequence[str], batch_size: int, grad_accum: int,
                                step: int, include_prefetched: bool = True,
                                pos_col: str = "pos",
                                partition_cols: Sequence[str] = ()) -> DataFrame:
    """The result of C3 + D1 in one pass over the rows. Each row is
    counted once, at its first checkpoint (per-checkpoint sum and count of each
    metric, a map-side-combined aggregate), then running sums over the
    checkpoint list give the cumulative means. Null metrics get their own
    count. Rows consumed after the last checkpoint fall out of the join."""
    pc = list(partition_cols)
    first = first_checkpoint(F.col(pos_col), batch_size, grad_accum, step, include_prefetched)
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in metrics:
        aggs += [F.sum(c).alias(f"s_{c}"), F.count(c).alias(f"c_{c}")]
    per = scored_positions.withColumn("ckpt", first).groupBy(*pc, "ckpt").agg(*aggs)
    k = ckpts.select(*pc, F.col("ckpt").cast("bigint"))
    full = k.join(per, [*pc, "ckpt"], "left").fillna(0, subset=["n"] + [f"c_{c}" for c in metrics])
    full = full.withColumn("__k", (F.col("ckpt") / F.lit(step)).cast("bigint"))
    vals = ["n"] + [x for c in metrics for x in (f"s_{c}", f"c_{c}")]
    full = full.fillna(0.0, subset=[f"s_{c}" for c in metrics])
    run = running_totals(full, "__k", vals, pc)
    out = [*pc, "ckpt", F.col("cum_n").cast("bigint").alias("n_rows")]
    for c in metrics:
        out.append(F.when(F.col(f"cum_c_{c}") > 0, F.col(f"cum_s_{c}") / F.col(f"cum_c_{c}"))
                   .alias(c))
    return run.select(*out)


def collect_batches(rows: DataFrame, batch_col: str = "batch_no", pos_col: str = "pos",
                    fields: Iterable[str] = ()) -> DataFrame:
    """The rows of each batch stacked in position order. A group holds at
    most one batch (B rows), so ``collect_list`` is bounded."""
    st = F.struct(F.col(pos_col).alias("pos"), *[F.col(f) for f in fields])
    return rows.groupBy(batch_col).agg(F.sort_array(F.collect_list(st)).alias("rows"))


def make_batches(ordered: DataFrame, batch_size: int, tokens_col: str = "tokens",
                 metrics: Sequence[str] = (), id_col: str = "id",
                 pos_col: str = "pos") -> DataFrame:
    """Ordered rows -> ``(batch_no, rows)``, each row with its id, the
    input/target token pairs and a struct of its metrics."""
    x, y = shift_pairs(F.col(tokens_col))
    r = ordered.select(
        F.floor(F.col(pos_col) / F.lit(batch_size)).cast("bigint").alias("batch_no"),
        F.col(pos_col).alias("pos"), F.col(id_col).alias("id"), x.alias("x"), y.alias("y"),
        F.struct(*[F.col(m) for m in metrics]).alias("metrics"))
    return collect_batches(r, "batch_no", "pos", ["id", "x", "y", "metrics"])
