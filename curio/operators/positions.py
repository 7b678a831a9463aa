"""Global positions (0..n-1) in a chosen order, without a single-partition
exchange, and positions inside groups.

``row_number()`` over an un-partitioned window moves every row to one task.
Instead the rows go through one range shuffle on ``(keys, id)`` and are sorted
inside their partitions, so the partitions are consecutive stretches of the order.
The rows are written once with their index in their partition; the counts of the
partitions, one number each, are added up to offsets. Because the id is part of the
range key, a key value held by a third of all rows is still split over many
partitions. Sorting never looks at a column's type: strings, dates and numbers
may be ascending or descending; NaN and null sort last in both directions.

The input is read twice (once for the sample of the range shuffle): pass a scan
or a written table, not an expensive plan.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curio.operators.scan import segmented_scan
from curio.session import materialize

PARTITION_BITS = 33       # monotonically_increasing_id: the index is below, the partition above


@dataclass(frozen=True)
class SortKey:
    """One sort key; NaN/null sort last in both directions."""
    col: Column | str
    descending: bool = False

    @property
    def column(self) -> Column:
        return F.col(self.col) if isinstance(self.col, str) else self.col


def asc(c) -> SortKey:
    return SortKey(c, False)


def desc(c) -> SortKey:
    return SortKey(c, True)


def _value(df: DataFrame, key: SortKey) -> Column:
    """The key with NaN as null."""
    c = key.column
    real = isinstance(df.select(c.alias("x")).schema["x"].dataType, (T.DoubleType, T.FloatType))
    return F.nanvl(c, F.lit(None)) if real else c


def order_columns(df: DataFrame, keys: Sequence[SortKey], id_col: str) -> list[Column]:
    """Sort expressions of the order ``keys`` (then ``id_col``)."""
    values = [(_value(df, k), k.descending) for k in keys]
    return [v.desc_nulls_last() if down else v.asc_nulls_last() for v, down in values] + [F.col(id_col).asc_nulls_last()]


def _ranged(df: DataFrame, order: list[Column], buckets: int | None) -> DataFrame:
    return df.repartitionByRange(buckets, *order) if buckets else df.repartitionByRange(*order)


def bucket_sizes(df: DataFrame, keys: Sequence[SortKey], id_col: str, buckets: int) -> list[int]:
    """Rows per range partition that ``assign_positions`` would use (for
    checking the balance under skew)."""
    rows = _ranged(df, order_columns(df, keys, id_col), buckets)
    return [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("b")).count().collect()]


def assign_positions(df: DataFrame, keys: Sequence[SortKey] = (), id_col: str = "id",
                     pos_col: str = "pos", buckets: int | None = None,
                     n: int | None = None) -> DataFrame:
    """Add ``pos_col`` = 0-based position of each row in the order
    ``keys`` (then ``id_col``). ``id_col`` must be unique. ``buckets``: the number
    of range partitions, if it isn't to be the session's. (``n``, the number of
    rows, is no longer needed and has no effect.)"""
    spark = df.sparkSession
    order = order_columns(df, list(keys), id_col)
    kept = [c for c in df.columns if c != pos_col]
    rows = _ranged(df, order, buckets).sortWithinPartitions(*order).select(*kept, F.monotonically_increasing_id().alias("__m"))
    done = materialize(rows, "positions")
    part, index = F.shiftright("__m", PARTITION_BITS), F.col("__m").bitwiseAND((1 << PARTITION_BITS) - 1)
    counts = sorted(done.groupBy(part.alias("p")).count().collect())
    offsets, run = [], 0
    for p, count in counts:
        offsets.append((p, run))
        run += count
    if len(offsets) <= 1:
        return done.select(*kept, index.alias(pos_col))
    # one row a partition, whatever the data
    before = F.broadcast(spark.createDataFrame(offsets, "__p long, __before long"))
    return done.join(before, part == F.col("__p")).select(*kept, (F.col("__before") + index).alias(pos_col))


def group_positions(df: DataFrame, group_cols: Sequence[str], keys: Sequence[SortKey] = (),
                    id_col: str = "id", idx_col: str = "idx") -> DataFrame:
    """0-based index of each row inside its group, in ``keys`` order (then
    ``id_col``): a segmented scan, so a group holding a third of all rows is split
    over many tasks and the number of groups doesn't matter."""
    return segmented_scan(df, group_cols, order_columns(df, list(keys), id_col), idx_col=idx_col)


def _before(values: list[tuple[Column, bool]], cut: Sequence) -> Column:
    """Whether a row stands before the row with the key values ``cut``."""
    out = F.lit(False)
    for (c, down), v in reversed(list(zip(values, cut))):
        if v is None:
            less, same = c.isNotNull(), c.isNull()
        else:
            less, same = (c > F.lit(v)) if down else (c < F.lit(v)), c == F.lit(v)
        out = F.coalesce(less, F.lit(False)) | (F.coalesce(same, F.lit(False)) & out)
    return out


def rank_cut(df: DataFrame, keys: Sequence[SortKey], id_col: str, k: int,
             buckets: int | None = None, n: int | None = None) -> Column | None:
    """A predicate selecting the rows at positions ``< k`` in the order
    ``keys`` (then ``id_col``), or ``None`` when ``k >= n`` (every row).

    Only the key columns are ordered, to read the keys at rank ``k``; the result
    is a plain filter (for an id-only order: ``id < cut``), which pushes down to
    the scan."""
    if k <= 0:
        return F.lit(False)
    n = df.count() if n is None else n
    if k >= n:
        return None
    values = [(_value(df, key), key.descending) for key in keys] + [(F.col(id_col), False)]
    names = [f"k{i}" for i in range(len(values))]
    thin = df.select(*[v.alias(name) for (v, _), name in zip(values, names)])
    order = [SortKey(name, down) for name, (_, down) in zip(names[:-1], values[:-1])]
    row = assign_positions(thin, order, names[-1], "pos", buckets).where(F.col("pos") == k).first()
    if len(values) == 1:
        return F.col(id_col) < F.lit(row["k0"])
    return _before(values, [row[name] for name in names])
