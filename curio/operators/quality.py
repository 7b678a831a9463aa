"""Data-quality checks as tables.

Each check is an aggregate or an anti/semi join -- one pass, partial
aggregation, no rows collected to the driver. ``quality_report`` stacks them
into ``(check, n_bad)``.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _missing(df: DataFrame, c: str) -> Column:
    col = F.col(c)
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def short_sequences(df: DataFrame, tokens: str = "tokens", min_len: int = 5) -> DataFrame:
    """Rows with fewer than ``min_len`` tokens."""
    return df.filter(F.size(tokens) < min_len)


def missing_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a null (or NaN) in any of ``cols``."""
    cond = reduce(lambda a, b: a | b, [_missing(df, c) for c in cols])
    return df.filter(cond)


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column, n_null)`` -- nulls and NaNs per column, one pass."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.sum(_missing(df, c).cast("bigint")).alias(c) for c in cols])
    return row.unpivot([], cols, "column", "n_null").fillna(0, subset=["n_null"])


def n_unique(df: DataFrame, col: str, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Exact distinct count (or HyperLogLog++ with ``approx``)."""
    f = F.approx_count_distinct(col, rsd) if approx else F.countDistinct(col)
    return df.agg(f.alias("n_unique"))


def duplicate_keys(df: DataFrame, key: Column | str, id_col: str | None = None) -> DataFrame:
    """D3: keys occurring more than once, with their count (and smallest id).
    A partial aggregate: a key held by a third of all rows is combined map-side."""
    k = F.col(key) if isinstance(key, str) else key
    aggs = [F.count(F.lit(1)).alias("n")]
    if id_col:
        aggs.append(F.min(id_col).alias("min_id"))
    return df.groupBy(k.alias("key")).agg(*aggs).filter(F.col("n") > 1)


def text_key(text: str = "text") -> Column:
    """Compact grouping key for exact-duplicate text (SHA-256 hex): the
    shuffle moves 64 characters per row instead of the text."""
    return F.sha2(F.col(text), 256)


def reconcile_ids(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """Do two tables hold the same ids? One full outer join of the
    per-id row counts, one aggregate: ``(n_a, n_b, only_in_a, only_in_b)``."""
    ca = a.groupBy(id_col).agg(F.count(F.lit(1)).alias("__ca"))
    cb = b.groupBy(id_col).agg(F.count(F.lit(1)).alias("__cb"))
    j = ca.join(cb, id_col, "full_outer")
    return j.agg(F.coalesce(F.sum("__ca"), F.lit(0)).cast("bigint").alias("n_a"),
                 F.coalesce(F.sum("__cb"), F.lit(0)).cast("bigint").alias("n_b"),
                 F.count(F.when(F.col("__cb").isNull(), 1)).alias("only_in_a"),
                 F.count(F.when(F.col("__ca").isNull(), 1)).alias("only_in_b"))


def quality_report(checks: dict[str, DataFrame]) -> DataFrame:
    """``(check, n_bad)`` from frames of offending rows."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_bad")).withColumn("check", F.lit(name))
             for name, df in checks.items()]
    return reduce(lambda x, y: x.unionByName(y), parts).select("check", "n_bad")
