"""Registry of named queries over the driver tables, each with an optional
DuckDB oracle SQL string over the same tables."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def round_digits(c, digits: int = 6):
    """Round a double to ``digits`` places as ``sign * floor(|x * 10^d| + 0.5)
    / 10^d``: half away from zero on the binary value, the rule the SQL oracle
    engine applies, so ties at the next digit round the same way on both
    sides. Negative zero becomes zero; huge values pass through."""
    scale = float(10 ** digits)
    v = c.cast("double") * F.lit(scale)
    r = F.signum(v) * F.floor(F.abs(v) + F.lit(0.5)) / F.lit(scale) + F.lit(0.0)
    return F.when(F.abs(v) < F.lit(1e15), r).otherwise(c.cast("double"))


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Last projection of a registered query: integers as bigint, floating
    values rounded to ``digits`` places (float sums depend on order)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = round_digits(c, digits)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(
                f.dataType.elementType, (T.DoubleType, T.FloatType)):
            c = F.transform(c, lambda x: round_digits(x, digits))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(
                f.dataType.elementType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("array<bigint>")
        cols.append(c.alias(f.name))
    return df.select(*cols)
