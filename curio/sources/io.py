"""Sources and sinks.

All scans declare their schema (no inference) and leave pruning and pushdown
to the Parquet reader. Files written by these helpers go to the path the
caller gives -- on a cluster a shared file system path, e.g. under
``spark.checkpoint.dir`` (see ``curio.session.scratch_path``).
"""

from __future__ import annotations

import sys
import uuid
from typing import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curio.functions.text import strip
from curio.sources.json_ranges import RANGE_BYTES, file_system, read_elements

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORY = T.StructType([T.StructField("story", T.StringType())])
SPLITS_PER_TASK = 64
NO_NAME = "__HIVE_DEFAULT_PARTITION__"
UNSAFE = "\"#%'*/:=?\\\x7f{[]^"


def read_json_shards(spark: SparkSession, directory: str, max_shards: int | None = None,
                     glob: str = "*.json", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A1: ``(shard, pos, story)`` from files that each hold one JSON array of
    objects; ``pos`` = position in the array. Files are read by ranges of
    ``range_bytes``, so many tasks share a large shard (see ``json_ranges``); with
    ``max_shards`` only the first in file-name order. A broken shard fails the
    read instead of vanishing; an object without a story gives null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob) \
        .option("recursiveFileLookup", "true").load(directory).select("path", "length")
    # a task lists the files of many splits: Spark would start one for every 32 small files
    files = files.coalesce(max(2 * spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions() // SPLITS_PER_TASK))
    if max_shards is not None:
        files = files.orderBy("path").limit(max_shards)
    obj = F.from_json("element", STORY, {"mode": "FAILFAST"})
    return read_elements(spark, files, range_bytes).select(
        F.col("path").alias("shard"), F.col("pos").cast("int").alias("pos"), obj["story"].alias("story"))


def _escaped(name: str) -> str:
    """``name`` as Spark's writer names the folder of a partition."""
    return "".join(f"%{ord(c):02X}" if c in UNSAFE or ord(c) < 32 else c for c in name)


def write_json_shards(df: DataFrame, path: str, shard_col: str, order_col: str,
                      fields: Sequence[str]) -> None:
    """Write each shard as one file ``shard=NAME.txt`` holding a JSON array (shards
    are bounded groups: the caller's shard key keeps them small); what was in
    ``path`` goes. Tasks write the files themselves, all into one folder: a folder a
    shard, as partitions would have, costs far more than its text to make, to commit
    and to list. A shard without a name gets the one of Spark's null partition."""
    spark = df.sparkSession
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(folder, True)
    store.mkdirs(folder)
    target = store.makeQualified(folder).toString().rstrip("/")
    shard = F.col(shard_col).cast("string")
    named = F.when(F.coalesce(shard, F.lit("")) == "", F.lit(NO_NAME)).otherwise(shard)
    arr = F.transform(F.sort_array(F.collect_list(F.struct(order_col, *fields))),
                      lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    shards = df.groupBy(named.alias("name")).agg(F.to_json(arr).alias("value"))

    def write(batches):
        files, inner = file_system(target)
        for batch in batches:
            for name, value in zip(*batch.columns):
                new, full = f"{inner}/.{uuid.uuid4().hex}", f"{inner}/shard={_escaped(name.as_py())}.txt"
                with files.open_output_stream(new, compression=None) as out:
                    out.write(value.as_py().encode("utf-8") + b"\n")
                # whole or not at all; another attempt of the task has written the same
                try:
                    files.move(new, full)
                except OSError:
                    if not files.get_file_info(full).is_file:
                        raise
                    files.delete_file(new)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    shards.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def read_scored_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A2: Parquet scan with a declared schema."""
    return spark.read.schema(schema).parquet(path)


def read_legacy_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A3: CSV with a header line and a declared schema."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def write_legacy_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("run",),
                mode: str = "overwrite") -> None:
    """A4: Parquet sink (snappy), Hive-style partitions (A8: one directory per
    run, so a filter on ``run`` prunes partitions)."""
    w = df.write.mode(mode)
    cols = [c for c in partition_by if c in df.columns]
    if cols:
        w = w.partitionBy(*cols)
    w.parquet(path)


def read_run(spark: SparkSession, path: str, run: str, run_col: str = "run") -> DataFrame:
    """One run of a run-partitioned table (partition pruning)."""
    return spark.read.parquet(path).filter(F.col(run_col) == F.lit(run))


def export_text_corpus(df: DataFrame, path: str, text: str = "text",
                       max_shards: int | None = None, shard: str = "shard") -> None:
    """A5: stripped texts, one per line (embedded newlines make more lines,
    as the vocabulary trainer expects). With ``max_shards`` the texts of that many
    shards, the first in the order of their names."""
    if max_shards is not None:
        first = df.select(shard).where(F.col(shard).isNotNull()).distinct().orderBy(shard).limit(max_shards)
        df = df.join(first, shard, "left_semi")
    df.select(strip(text).alias("value")).write.mode("overwrite").text(path)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path)


def debug_sample(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """A small deterministic sample for debugging: the first ``n`` rows
    by ``order_col``."""
    return df.orderBy(order_col).limit(n)
