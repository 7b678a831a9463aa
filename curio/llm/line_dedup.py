"""Operator 12, line dedup by a range shuffle of line hashes.

A line is what stands between ``\\n``; its key is the line without white space
(``[\\x20\\x09-\\x0D]``) at both ends, A-Z lower-cased. Every key of at least
``min_chars`` code points leaves its document as a 128-bit hash with the document
and the line's place. These rows are range-partitioned and sorted by (hash,
document, place), so a key that a third of all lines share lies over as many
neighbouring partitions as it needs. Each partition streams its rows: the first
document of a hash keeps its lines, all later ones lose theirs. Only the first
document seen of a partition's first hash is open, as the hash may have begun in
an earlier partition; it is settled by the least document among the marks that the
partitions leave, one mark for the hash a partition begins with and one for the
hash it ends with. The result is a compressed bitmap of kept lines per document,
no text.

Defined results: a null or empty text is one empty line. A null id sorts first.
Rows that share an id (null too) are one document, so that they lose no line to
each other; each row has its own bitmap, rows that also share the text the same
one. Extra columns are ignored by ``keep_bitmaps`` and pass through
``apply_bitmaps``. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curio.llm.common import SPACES, ship, sliced, text_or_empty, texts_of
from curio.session import materialize

ship(__name__)

MIN_CHARS = 10
DROPPED, OPEN, MARK = 0, 1, 2


def line_keys(text: str, min_chars: int):
    """``(place, 128-bit hash)`` of the lines whose key is long enough."""
    digest = xxhash.xxh3_128_digest
    for place, line in enumerate(text.split("\n")):
        key = line.strip(SPACES)
        if len(key) >= min_chars:
            yield place, digest(key.encode("utf-8", "replace").lower())


def _line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(hi, lo, doc_id, text_key, place)`` of every line long enough."""
    schema = T.StructType([T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), docs.schema["doc_id"],
                           T.StructField("text_key", T.LongType()), T.StructField("place", T.IntegerType())])

    def run(batches):
        for batch in sliced(batches):
            rows, places, hashes = [], [], []
            for row, text in enumerate(texts_of(batch.column(2))):
                for place, h in line_keys(text, min_chars):
                    rows.append(row)
                    places.append(place)
                    hashes.append(h)
            words = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[:, 0]), pa.array(words[:, 1]), batch.column(0).take(at), batch.column(1).take(at),
                 pa.array(places, pa.int32())], schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, schema)


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each row but the first differs from the one before; null equals null."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    same = pc.or_(pc.and_(pc.is_null(a), pc.is_null(b)), pc.fill_null(pc.equal(a, b), False))
    return ~same.to_numpy(zero_copy_only=False)


class Stream:
    """First occurrences in the sorted rows of one partition. ``last`` is the
    last row seen; ``later``: it belongs to a later document of its hash;
    ``first_hash``: no other hash has been seen; ``mark``: the first row of its hash."""

    def __init__(self):
        self.last: pa.RecordBatch | None = None
        self.mark: pa.RecordBatch | None = None
        self.later, self.first_hash = False, True

    def __call__(self, batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
        """Rows that go or are open, and their states."""
        n = batch.num_rows
        joined = batch if self.last is None else pa.concat_batches([self.last, batch])
        skip = joined.num_rows - n
        new_hash = _differs(joined.column(0)) | _differs(joined.column(1))
        new_doc = _differs(joined.column(2)) & ~new_hash
        if not skip:
            new_hash, new_doc = np.r_[True, new_hash], np.r_[False, new_doc]
        index = np.arange(n)
        begin = np.maximum.accumulate(np.where(new_hash, index, -1))   # -1: the hash began before this batch
        seen = np.cumsum(new_doc)
        later = seen - np.where(begin >= 0, seen[begin], -1 if self.later else 0) > 0
        hashes = np.cumsum(new_hash) + (0 if skip else -1)             # 0: the first hash of the batch's stream
        first_hash = (hashes == 0) & self.first_hash
        states = np.where(later, DROPPED, OPEN)
        at = np.flatnonzero(later | first_hash)
        if begin[-1] >= 0:
            self.mark = batch.slice(int(begin[-1]), 1)
        self.first_hash = bool(first_hash[-1])
        self.later, self.last = bool(later[-1]), batch.slice(n - 1, 1)
        return batch.take(pa.array(at)), states[at]


def _streamed(lines: DataFrame) -> DataFrame:
    schema = T.StructType([*lines.schema.fields, T.StructField("state", T.IntegerType())])

    def run(batches):
        stream = Stream()
        for batch in batches:
            if batch.num_rows:
                rows, states = stream(batch)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(states, pa.int32())], schema.names)
        if stream.mark is not None:
            yield pa.RecordBatch.from_arrays([*stream.mark.columns, pa.array([MARK], pa.int32())], schema.names)

    keys = ["hi", "lo", "doc_id", "place"]
    return lines.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, text_key, place)`` of every line that an earlier document holds."""
    out = materialize(_streamed(_line_rows(docs, min_chars)), "line-states")
    doc = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"))
    # at most two hashes a partition: marks are few, whatever the data
    least = out.where(F.col("state") > DROPPED).groupBy("hi", "lo").agg(F.min(doc).alias("least"))
    settled = out.where(F.col("state") == OPEN).join(least, ["hi", "lo"]).where(doc > F.col("least"))
    places = ["doc_id", "text_key", "place"]
    return out.where(F.col("state") == DROPPED).select(*places).unionByName(settled.select(*places))


def _pack(n_lines: int, places: list[int]) -> bytes:
    keep = np.ones(n_lines, bool)
    keep[places] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    """The kept lines of a document, as booleans."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, text_key, n_lines, n_dropped, bitmap)`` for each document: one
    row for each different (doc_id, text). ``text_key`` is Spark's ``xxhash64`` of
    the text. A bitmap grows with its own document's lines only."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_key"),
                        (F.length(text_or_empty(F.col("text"))) - F.length(F.translate(text_or_empty(F.col("text")), "\n", "")) + 1)
                        .alias("n_lines")).distinct()
    gone = dropped_lines(docs, min_chars).groupBy(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t")).agg(
        F.collect_set("place").alias("places"))
    rows = lines.join(gone, (F.col("text_key") == F.col("__t")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left").drop("__d", "__t")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_key", T.LongType()), T.StructField("n_lines", T.LongType()),
                           T.StructField("n_dropped", T.LongType()), T.StructField("bitmap", T.BinaryType())])

    def run(batches):
        for batch in sliced(batches):
            counts, places = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2).cast(pa.int64()),
                 pa.array([len(p or ()) for p in places], pa.int64()),
                 pa.array([_pack(n, p or []) for n, p in zip(counts, places)], pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, out_col: str = "text") -> DataFrame:
    """``docs`` with the kept lines of ``text`` as ``out_col`` (null stays null
    where nothing goes) and, as new columns, ``n_lines`` and ``n_dropped``. A row
    without a bitmap keeps its text."""
    side = bitmaps.select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t"), F.col("n_lines").alias("__n"),
                          F.col("n_dropped").alias("__gone"), F.when(F.col("n_dropped") > 0, F.col("bitmap")).alias("__bits"))
    joined = docs.join(side, (F.xxhash64("text") == F.col("__t")) & docs["doc_id"].eqNullSafe(F.col("__d")), "left")
    new = {out_col: T.StringType(), "n_lines": T.LongType(), "n_dropped": T.LongType()}
    rest = [c for c in docs.columns if c.lower() not in new]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(n, t) for n, t in new.items()])

    def run(batches):
        for batch in sliced(batches):
            texts, bits = batch.column("__text").to_pylist(), batch.column("__bits").to_pylist()
            n = batch.column("__n").to_pylist()
            kept = [t if b is None else "\n".join([line for line, k in zip((t or "").split("\n"), unpack(b, m)) if k])
                    for t, b, m in zip(texts, bits, n)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [
                pa.array(kept, pa.string()), batch.column("__n"), batch.column("__gone")], schema.names)

    return joined.select(*rest, F.col("text").cast("string").alias("__text"), "__n", "__gone", "__bits").mapInArrow(run, schema)
