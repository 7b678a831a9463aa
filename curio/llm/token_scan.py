"""Operator 7, token counts of documents in flat token files by a separator scan.

A flat token file is a run of fixed-width little-endian ids in which each document
ends with a separator id; there is no index. ``write_token_files`` makes such files
with Spark's own writer (ids as raw bytes, the separator as the line end), so output
commits and retries are Spark's.

``scan`` cuts each file into blocks by its length alone. A task finds the separators
of a block with one vectorised comparison and emits the distances between them: each
whole document, the first piece (which may belong to a document of the blocks
before) and the tail after the last separator. A prefix scan over the blocks of a file
(one small row a block) gives the ordinal of each block's first document and the
tokens that the blocks before carry into it; an open end of the file is its last
document, if it has tokens.

Defined results: a null or empty text is a document of 0 tokens. Repeated rows count
each. An empty file or table gives no rows. A document may span any number of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curio.llm import bpe
from curio.llm.common import ship, sliced

ship(__name__)

BLOCK_TOKENS = 1 << 20


def write_token_files(docs: DataFrame, path: str, vocab_path: str, separator: int, width: int = 2) -> None:
    """Write the ids of every text of ``docs`` to flat files under ``path``, in
    row order, a file for each partition. ``width``: bytes of an id. Special strings
    in texts are ordinary text here, so only the writer makes separators."""
    ids = bpe.encode(docs.select("text"), vocab_path, special=False)

    def raw(batches):
        for batch in sliced(batches):
            lists = batch.column(0)
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype(f"<u{width}"), lists.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array([flat[ends[i]:ends[i + 1]].tobytes() for i in range(len(lists))], pa.binary())], names=["raw"])

    end = separator.to_bytes(width, "little").decode("latin-1")
    # a text row's bytes are written as they are; the line end is the separator
    ids.select("ids").mapInArrow(raw, "raw binary").select(F.col("raw").cast("string").alias("value")).write.option(
        "lineSep", end).option("encoding", "ISO-8859-1").text(path)


def _open(path: str):
    from pyarrow import fs
    where = path if "://" in path else "file://" + path.removeprefix("file:")
    store, inner = fs.FileSystem.from_uri(where)
    return store.open_input_file(inner)


def scan(spark: SparkSession, path: str, separator: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(file, document, n_tokens)`` for every document of the flat files under
    ``path``; ``document`` counts from 0 in each file. Files are read in ranges, so
    neither their size nor a document's bounds a task."""
    size = block_tokens * width
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    blocks = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("block"))

    def pieces(batches):
        for batch in sliced(batches, rows=1):
            file, length, block = (batch.column(c)[0].as_py() for c in range(3))
            with _open(file) as f:
                data = f.read_at(min(size, length - block * size), block * size)
            ids = np.frombuffer(data, f"<u{width}")
            ends = np.flatnonzero(ids == separator)
            lengths = np.diff(np.append(ends, len(ids)), prepend=-1) - 1  # the last one is the tail
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array([file] * n, pa.string()), pa.array(np.full(n, block), pa.int64()), pa.array(np.arange(n), pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(np.full(n, n - 1), pa.int64())],
                names=["file", "block", "piece", "tokens", "ends"])

    # blocks are dealt evenly, whatever files they are of
    slots = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = blocks.repartition(slots, "file", "block").mapInArrow(
        pieces, "file string, block long, piece long, tokens long, ends long")
    found = _written(found)
    # the prefix scan, over one row a block
    tails = found.where("piece = ends").select("file", "block", "ends", F.col("tokens").alias("tail"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last_cut = F.max(F.when(F.col("ends") > 0, F.col("block"))).over(before)
    sums = tails.withColumns({"base": F.coalesce(F.sum("ends").over(before), F.lit(0)),
                              "all": F.coalesce(F.sum("tail").over(before), F.lit(0)), "cut": last_cut})
    # tails of the blocks since the last one with a separator, that one's included
    at_cut = sums.select("file", F.col("block").alias("cut"), F.col("all").alias("all_cut"))
    carried = sums.join(at_cut, ["file", "cut"], "left").select(
        "file", "block", "base", (F.col("all") - F.coalesce("all_cut", F.lit(0))).alias("carry"))
    final = tails.groupBy("file").agg(F.max("block").alias("last_block"))
    whole = found.join(carried, ["file", "block"]).join(final, "file")
    count = F.col("tokens") + F.when(F.col("piece") == 0, F.col("carry")).otherwise(0)
    closed = (F.col("piece") < F.col("ends")) | ((F.col("block") == F.col("last_block")) & (count > 0))
    return whole.where(closed).select("file", (F.col("base") + F.col("piece")).alias("document"), count.alias("n_tokens"))


def _written(df: DataFrame) -> DataFrame:
    from curio.session import materialize
    return materialize(df, "token-pieces")
