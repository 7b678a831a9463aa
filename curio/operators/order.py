"""Curriculum order operators.

Every order operator returns ``(id, pos)``: the order is data, not a list in
the driver. Positions come from ``assign_positions`` (no single-partition
exchange). NaN and null sort last in both directions, ties break on the id.
"""

from __future__ import annotations

from typing import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curio.operators._util import broadcast_if_small
from curio.operators.positions import SortKey, asc, assign_positions, desc, rank_cut


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ordered(df: DataFrame, keys: Sequence[SortKey], id_col: str, buckets=None) -> DataFrame:
    thin = df.select(F.col(id_col).alias("id"), *[k.column.alias(f"k{i}") for i, k in enumerate(keys)])
    return assign_positions(thin, [SortKey(f"k{i}", k.descending) for i, k in enumerate(keys)], "id", "pos", buckets) \
        .select("id", "pos")


def above_threshold(column, threshold: float) -> Column:
    """Strict ``column > threshold``; NaN and null excluded (Spark orders NaN
    above every number, so the NaN test is explicit)."""
    c = _c(column)
    return (c > F.lit(threshold)) & ~F.isnan(c.cast("double"))


def sort_ascending(df: DataFrame, column, id_col: str = "id", buckets=None) -> DataFrame:
    """ids by ``column`` ascending."""
    return _ordered(df, [asc(column)], id_col, buckets)


def sort_descending(df: DataFrame, column, id_col: str = "id", buckets=None) -> DataFrame:
    """ids by ``column`` descending."""
    return _ordered(df, [desc(column)], id_col, buckets)


def filter_by_threshold(df: DataFrame, column, threshold: float, id_col: str = "id",
                        buckets=None) -> DataFrame:
    """B2: rows with ``column > threshold`` in table (id) order."""
    return _ordered(df.filter(above_threshold(column, threshold)), [], id_col, buckets)


def combined_transform(df: DataFrame, column, threshold: float, id_col: str = "id",
                       buckets=None) -> DataFrame:
    """strict threshold filter, then ascending order."""
    return _ordered(df.filter(above_threshold(column, threshold)), [asc(column)], id_col, buckets)


def order_identity(df: DataFrame, id_col: str = "id", buckets=None) -> DataFrame:
    """no transform, table order."""
    return _ordered(df, [], id_col, buckets)


def order_custom(df: DataFrame, keys: Sequence[SortKey], id_col: str = "id",
                 buckets=None) -> DataFrame:
    """caller-supplied keys."""
    return _ordered(df, list(keys), id_col, buckets)


# K1: name -> fn(df, column, threshold, id_col) -> (id, pos)
_ORDERS: dict[str, Callable[..., DataFrame]] = {}


def register_order(name: str, fn: Callable[..., DataFrame]) -> None:
    """Register a user-defined order ``fn(df, column, threshold, id_col)``
    returning ``(id, pos)``; ``order_custom`` builds one from sort keys."""
    _ORDERS[name] = fn


def _by_column(method: str, fn, needs_threshold: bool):
    def run(df, column, threshold, id_col):
        if column is None:
            raise ValueError(f"{method} needs a column")
        if needs_threshold and threshold is None:
            raise ValueError(f"{method} needs a threshold")
        return fn(df, column, threshold, id_col) if needs_threshold else fn(df, column, id_col)
    return run


register_order("sort_ascending", _by_column("sort_ascending", sort_ascending, False))
register_order("sort_descending", _by_column("sort_descending", sort_descending, False))
register_order("filter_by_threshold",
               _by_column("filter_by_threshold", filter_by_threshold, True))
register_order("combined_transform", _by_column("combined_transform", combined_transform, True))
register_order("identity", lambda df, column, threshold, id_col: order_identity(df, id_col))


def dispatch_order(df: DataFrame, method: str | None, column: str | None = None,
                   threshold: float | None = None, id_col: str = "id") -> DataFrame:
    """method name + column + threshold -> ``(id, pos)``. Only ``None``
    counts as missing (a threshold of 0.0 is a real threshold); a missing
    argument raises ``ValueError``."""
    name = "identity" if method is None else method
    if name not in _ORDERS:
        raise ValueError(f"unknown order {method!r}; known: {sorted(_ORDERS)}")
    return _ORDERS[name](df, column, threshold, id_col)


def train_valid_split(df: DataFrame, split: str = "train", id_col: str = "id",
                      train_fraction: float = 0.9, buckets=None, n: int | None = None
                      ) -> DataFrame:
    """The first ``int(0.9 * n)`` rows in table (id) order are ``train``;
    any other split name means validation. The split is a filter ``id < cut``
    -- the cut id is found from bucket counts and one bucket, the rows are
    never globally ordered."""
    n = df.count() if n is None else n
    pred = rank_cut(df, [], id_col, int(train_fraction * n), buckets, n)
    if pred is None:
        return df if split == "train" else df.limit(0)
    return df.filter(pred) if split == "train" else df.filter(~pred)


def split_positions(df: DataFrame, id_col: str = "id", buckets=None) -> DataFrame:
    """Table positions (``split_pos``) of every row, for reporting the split."""
    return assign_positions(df, [], id_col, "split_pos", buckets)


def lookup_by_id(df: DataFrame, ids, id_col: str = "id") -> DataFrame:
    """Rows for one id, a list of ids, or the ids of another frame (semi join)."""
    if isinstance(ids, DataFrame):
        keys = ids.select(F.col(ids.columns[0]).alias(id_col)).distinct()
        return df.join(broadcast_if_small(keys), id_col, "left_semi")
    if isinstance(ids, Iterable) and not isinstance(ids, (str, bytes)):
        return df.filter(F.col(id_col).isin(list(ids)))
    return df.filter(F.col(id_col) == F.lit(ids))


def assign_dense_ids(df: DataFrame, keys: Sequence[SortKey], tie_col: str,
                     id_col: str = "id", buckets=None) -> DataFrame:
    """``id`` = 0..n-1 in ``keys`` order (e.g. shard name, position in
    shard). ``tie_col`` is a unique column used to break ties."""
    return assign_positions(df, list(keys), tie_col, id_col, buckets)


def batch_numbers(df: DataFrame, batch_size: int, pos_col: str = "pos") -> DataFrame:
    """``batch_no = pos div batch_size``; the last batch may be partial."""
    return df.withColumn("batch_no", F.floor(F.col(pos_col) / F.lit(batch_size)).cast("bigint"))


def head(df: DataFrame, n: int = 500, id_col: str = "id") -> DataFrame:
    """first ``n`` ids (a top-n: Spark plans a per-partition top-n and a
    merge of n rows per partition)."""
    return df.orderBy(id_col).limit(n)


def sort_by_checkpoint(df: DataFrame, ckpt_col: str = "checkpoint_name") -> DataFrame:
    """curve rows by checkpoint number (curves are small: one row per
    checkpoint and metric)."""
    return df.orderBy(ckpt_col)
