"""Operator 5, sharding by global byte-size prefix sums.

Rows are ordered by id over range partitions; each partition's total of bytes and
rows gives the offset of the next (a prefix sum over as many numbers as there are
partitions), a running sum inside each partition gives each row its global byte
position, and shard ``s`` of ``n`` takes the rows whose middle byte lies in the s-th
of n equal parts. Shards are contiguous in id order and differ from the target by
half a row at each cut. Only ids, sizes and checksums are shuffled, not texts.

Order is (doc_id, checksum, size), null ids first; rows alike in all three are
interchangeable, and a further arbitrary number spreads them over partitions when
one id holds very many rows. Null text: size 8, checksum 0. An empty table gives an
empty table. Extra columns stay out of ``assign`` and pass through ``write_shards``.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curio.session import discard, materialize

ROW_BYTES = 8


def assign(docs: DataFrame, shards: int) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for every row of ``docs``
    (``doc_id``, ``text``)."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    narrow = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
                         F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.monotonically_increasing_id().alias("__any"))
    order = ["doc_id", "text_crc32", "size", "__any"]
    dealt = materialize(narrow.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "shard-rows")
    totals = sorted(tuple(r) for r in dealt.groupBy("__part").agg(F.sum("size"), F.count("*")).collect())
    if not totals:
        return dealt.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    starts = [(p, b - own, r - n) for (p, own, n), b, r in zip(
        totals, accumulate(t[1] for t in totals), accumulate(t[2] for t in totals))]
    total = sum(t[1] for t in totals)
    # one row for each partition: bounded by their number
    offsets = F.broadcast(spark.createDataFrame(starts, "__part int, __bytes long, __rows long"))
    within = Window.partitionBy("__part").orderBy(*order)
    before = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size") + F.col("__bytes")
    middle = (2 * F.col("__before") + F.col("size")).cast("decimal(38,0)")
    placed = materialize(dealt.join(offsets, "__part").withColumn("__before", before).withColumn(
        "__row", F.row_number().over(within) - 1 + F.col("__rows")).select(
        "doc_id", "size", "text_crc32", "__row",
        F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * total)).cast("int")).alias("shard")), "shard-places")
    discard(dealt)
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("__row").alias("__first")))  # one row a shard
    return placed.join(firsts, "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("__row") - F.col("__first")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int) -> None:
    """Write ``docs`` as Parquet, a folder for each shard; several tasks write a
    shard, so none holds it whole."""
    places = assign(docs, shards).select(F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__crc"), "shard").groupBy(
        "__id", "__crc").agg(F.min("shard").alias("shard"))
    crc = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = [c for c in docs.columns if c.lower() != "shard"]
    docs.join(places, docs["doc_id"].eqNullSafe(F.col("__id")) & (crc == F.col("__crc"))).select(
        *[docs[c] for c in own], places["shard"]).write.partitionBy("shard").parquet(path)
