"""Group-wise ranking operators.

Groups can be very uneven (one group may hold a third of all rows), so
group-level statistics are ``groupBy`` aggregates (combined map-side) joined
back (adaptive execution broadcasts them when they are small), and ordered running
sums are segmented scans -- never a window that puts a whole group in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curio.operators.positions import desc, order_columns
from curio.operators.scan import RunningSum, segmented_scan

SALT_BUCKETS = 64


def group_softmax(df: DataFrame, group: str, score: str, temperature: float = 1.0,
                  out: str = "p") -> DataFrame:
    """``exp(x/t - max) / sum`` within each group."""
    x = F.col(score) / F.lit(float(temperature))
    mx = df.groupBy(group).agg(F.max(x).alias("__m"))
    e = df.join(mx, group).withColumn("__e", F.exp(x - F.col("__m")))
    z = e.groupBy(group).agg(F.sum("__e").alias("__z"))
    return e.join(z, group).withColumn(out, F.col("__e") / F.col("__z")) \
        .drop("__m", "__e", "__z")


def argmax_per_group(df: DataFrame, group: str, score: str, item: str) -> DataFrame:
    """highest score per group, ties to the lowest item (a partial
    aggregate of ``max(struct(score, -item))``)."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(item)).alias("neg")))
    return df.groupBy(group).agg(best.alias("__b")).select(
        group, (-F.col("__b.neg")).alias(item), F.col("__b.s").alias(score))


def top_k_per_group(df: DataFrame, group: str, score: str, k: int, item: str,
                    salt_buckets: int = SALT_BUCKETS) -> DataFrame:
    """F8: rows whose score is >= the k-th largest of their group (ties at k
    kept; k above the group size keeps all). Two stages: rank inside
    ``(group, salt)`` splits a hot group over ``salt_buckets`` tasks and keeps
    at most k (+ties) per bucket -- every row of the group's top k survives,
    since its rank in the bucket cannot exceed its rank in the group -- then
    rank over the few survivors."""
    salt = F.pmod(F.xxhash64(F.col(item)), F.lit(salt_buckets))
    w1 = Window.partitionBy(group, "__salt").orderBy(F.col(score).desc())
    cand = df.withColumn("__salt", salt).withColumn("__r1", F.rank().over(w1)) \
        .filter(F.col("__r1") <= k)
    w2 = Window.partitionBy(group).orderBy(F.col(score).desc())
    return cand.withColumn("rank", F.rank().over(w2)).filter(F.col("rank") <= k) \
        .drop("__salt", "__r1")


def ordered_cumsum(df: DataFrame, group: str, keys, item: str, value: str,
                   idx_col: str = "idx", out: str = "cum") -> DataFrame:
    """Index in ``keys`` order and inclusive running sum of ``value`` inside
    each group, by one segmented scan."""
    return segmented_scan(df, [group], order_columns(df, keys, item), {out: RunningSum(value)}, idx_col)


def nucleus_filter(df: DataFrame, group: str, item: str, p: str, topp: float,
                   crop: bool = True) -> DataFrame:
    """E9 (top-p): per group, the items by descending share (ties: item id)
    up to and including the one where the cumulative share first exceeds
    ``topp``. ``topp`` <= 0 or >= 1 keeps everything. With ``crop``, shares
    below ``(1 - topp) / (n - 1)`` are dropped before ordering (they can never
    be kept; one-item groups are not cropped). Adds ``idx`` (0-based rank in the
    order) and ``cum``."""
    if not (0.0 < topp < 1.0):
        return ordered_cumsum(df, group, [desc(p)], item, p)
    src = df
    if crop:
        n = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
        src = df.join(n, group).filter(
            (F.col("__n") <= 1) | (F.col(p) >= (1.0 - topp) / (F.col("__n") - 1))).drop("__n")
    c = ordered_cumsum(src, group, [desc(p)], item, p)
    return c.filter(F.col("cum") - F.col(p) <= F.lit(topp))


def _first_where(c: DataFrame, group: str, item: str, cond: Column) -> DataFrame:
    """First row in ``idx`` order meeting ``cond``, else the last row."""
    agg = c.groupBy(group).agg(
        F.min(F.when(cond, F.struct("idx", item))).alias("__hit"),
        F.max(F.struct("idx", item)).alias("__last"))
    return agg.select(group, F.coalesce(F.col(f"__hit.{item}"), F.col(f"__last.{item}"))
                      .alias(item))


def weighted_sample(df: DataFrame, group: str, item: str, p: str, coin: str) -> DataFrame:
    """I8: inverse-CDF draw per group: the first item (in item order) whose
    cumulative share exceeds the group's coin in [0, 1); the last item when
    rounding leaves none. ``coin`` is a column (e.g. a seeded hash of the
    group key)."""
    c = ordered_cumsum(df, group, [], item, p)
    return _first_where(c, group, item, F.col(coin) < F.col("cum"))


def nucleus_sample(df: DataFrame, group: str, item: str, p: str, topp: float,
                   coin: str) -> DataFrame:
    """Top-p filter, then a draw with ``r = coin * kept mass`` over the
    kept items in descending-share order."""
    kept = nucleus_filter(df, group, item, p, topp)
    mass = kept.groupBy(group).agg(F.max("cum").alias("__mass"))
    k = kept.join(mass, group)
    return _first_where(k, group, item, F.col(coin) * F.col("__mass") < F.col("cum"))
