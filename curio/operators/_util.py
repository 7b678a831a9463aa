"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest side we broadcast after checking its row count.
MAX_BROADCAST_ROWS = 1_000_000
# Tasks per task slot that a small input is spread over.
SPREAD = 2


def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (stops reading early)."""
    return df.limit(max_rows + 1).count() <= max_rows


def collect_bounded(df: DataFrame, max_rows: int):
    """All rows of ``df`` when there are at most ``max_rows`` of them, else
    ``None`` -- the bound check and the collect in one job."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only behind a checked row bound; otherwise leave the
    join strategy to the optimizer (sort-merge / shuffle hash, AQE).

    The check runs a (limited) job, so use it for scans and small literal
    tables. For a side derived from an expensive plan, join plainly: adaptive
    execution measures the shuffled side at run time and switches to a
    broadcast join when it is small, without computing the side twice."""
    return F.broadcast(df) if row_count_at_most(df, max_rows) else df


def spread_small_input(df: DataFrame) -> DataFrame:
    """Round-robin a scan that has fewer partitions, or comes from fewer files,
    than the cluster has task slots, so CPU-heavy per-row work uses every core. A
    file may be a single row group, which no split divides: its splits are then
    empty but one. The rows go to ``SPREAD`` tasks a slot, or to as many as there are
    splits, so tasks stay short. Inputs of many files are left as they are."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= slots and not 0 < len(df.inputFiles()) < slots:
        return df
    return df.repartition(max(splits, SPREAD * slots))
