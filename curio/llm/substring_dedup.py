"""Operator 2, substring dedup by MinHash banding of paragraphs and windows.

Two kinds of units go through bands: whole paragraphs, and windows of 50 words of
what is left without the repeated paragraphs, inside lines or across them. A
paragraph is a line (``\\n``) with at least ``min_words`` words. Paragraphs with
equal lower-cased word sequences (128-bit digest) form a class. The MinHash of a
class's 5-word shingles is cut into bands that ``tune_bands`` sizes for a recall of
0.9995 at the similarity; classes that collide in a band are compared on their full
shingle sets (exact Jaccard, by ``banding.linked``, so no group's pairs are emitted);
a pair is left out beforehand only if its minima agree so seldom that one at the
similarity does so with a probability of 1e-4.
Components of the confirmed pairs are the clusters. In each cluster the first
paragraph by (doc_id, place) stays and all others are removed. A window is named by
the least hash of its 25-word runs, a band of one MinHash that equal windows
always share (``passages``); windows that collide are compared whole, and all but
the first of equal ones are removed.

Defined results: null and empty texts and shorter paragraphs are in no cluster and
stay as they are. Rows with equal id and equal text are one document. A null id sorts
first. Rows that share an id but not the text are told apart. Extra columns pass
through ``remove_repeats``; an empty table gives empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curio.llm.banding import linked, packed_marks, semi_join, tune_bands
from curio.llm.common import SPACES, hashed_words, joined_texts, mix64, shingle_hashes, ship, sliced, texts_of
from curio.llm.components import connected_components
from curio.llm.passages import remove_passages, repeated_passages
from curio.session import discard, materialize

ship(__name__)

WORDS, PERCENT, MIN_WORDS = 5, 75, 20
ROWS, BANDS = tune_bands(PERCENT / 100, 0.9995)
_ODD = np.random.default_rng(31).integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(32).integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2)
_PART = np.random.default_rng(33).integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Paragraphs:
    """The paragraphs of a batch of texts and, in flat arrays, their shingle
    sets: ``rows`` (number of the text), ``places``, ``sizes`` (words), ``ids``
    (digests), ``shingles`` (one set after the other), ``counts``."""

    def __init__(self, texts: list[str], min_words: int):
        raw, begin = joined_texts(texts)
        hashes, spots = hashed_words(raw)
        breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)       # the end of each line
        lines = np.r_[0, breaks[:-1] + 1] if len(breaks) else breaks
        first = np.searchsorted(spots, lines)
        words = np.diff(np.append(first, len(spots)))
        chosen = np.flatnonzero(words >= max(1, min_words))
        top = np.searchsorted(lines, begin)                               # the first line of each text
        row = np.searchsorted(top, chosen, side="right") - 1
        self.rows, self.places, self.sizes = row, chosen - top[row] if len(top) else chosen, words[chosen]
        self.ids, self.shingles, self.counts = [], np.empty(0, np.uint64), self.sizes
        if not len(chosen):
            return
        starts = np.cumsum(self.sizes) - self.sizes
        number = np.arange(self.sizes.sum()) - np.repeat(starts, self.sizes)
        hashes = hashes[number + np.repeat(first[chosen], self.sizes)]
        place = mix64(number.astype(np.uint64) + np.uint64(1))
        # two independent sums over words and their places name the word sequence
        lanes = [mix64(np.add.reduceat(mix64(hashes ^ np.uint64(k)) * (place | np.uint64(1)), starts) + self.sizes.astype(np.uint64))
                 for k in (0x51ED270B, 0xA54FF53A5F1D36F1)]
        packed = np.column_stack(lanes).astype(">u8").tobytes()
        self.ids = [packed[k:k + 16] for k in range(0, len(packed), 16)]
        if self.sizes.min() < WORDS:
            parts = [shingle_hashes(h, WORDS) for h in np.split(hashes, starts[1:])]
            flat, each = np.concatenate(parts), np.array([len(x) for x in parts])
        else:
            # windows over the whole batch; those that cross an edge are skipped
            each = self.sizes - (WORDS - 1)
            flat = shingle_hashes(hashes, WORDS)[np.arange(each.sum()) + (WORDS - 1) * np.repeat(np.arange(len(each)), each)]
        # a sort of the owners with the hashes' upper bits shows which sets have repeats
        owner = np.repeat(np.arange(len(each)), each)
        bits = max(1, int(len(each)).bit_length())
        mixed = np.sort((owner.astype(np.uint64) << np.uint64(64 - bits)) | (flat >> np.uint64(bits)))
        again = np.unique((mixed[1:][mixed[1:] == mixed[:-1]] >> np.uint64(64 - bits)).astype(np.int64))
        self.shingles, self.counts = flat, each
        if len(again):
            ends = np.cumsum(each)
            parts = np.split(flat, np.ravel(np.column_stack((ends[again] - each[again], ends[again]))))
            for k in range(1, len(parts), 2):
                parts[k] = np.unique(parts[k])
            self.counts = each.copy()
            self.counts[again] = [len(parts[k]) for k in range(1, len(parts), 2)]
            self.shingles = np.concatenate(parts)

    def minima(self) -> np.ndarray:
        """The MinHash of each set, one row each."""
        least = np.empty((ROWS * BANDS, len(self.rows)), np.uint64)
        if len(self.rows):
            begins = np.cumsum(self.counts) - self.counts
            for k in range(ROWS * BANDS):
                least[k] = np.minimum.reduceat(self.shingles * _ODD[k] + _ADD[k], begins)
        return np.ascontiguousarray(least.T)


def buckets(least: np.ndarray) -> np.ndarray:
    """One 64-bit bucket for each band of each MinHash."""
    parts = (least.reshape(-1, BANDS, ROWS) * _PART).sum(axis=2, dtype=np.uint64)
    return mix64(parts + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _matrix(rows: np.ndarray) -> pa.Array:
    """An Arrow list column of the rows of a matrix."""
    offsets = np.arange(rows.shape[0] + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1), pa.int64()))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def paragraph_rows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each paragraph that counts: where it is, its class, the
    buckets of its shingle set and the marks of its MinHash."""
    def run(batches):
        for batch in sliced(batches, rows=256):
            found = Paragraphs(texts_of(batch.column(2)), min_words)
            least, at = found.minima(), pa.array(found.rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(found.places, pa.int32()),
                 pa.array(found.sizes, pa.int32()), pa.array(found.ids, pa.binary()), pa.array(found.counts, pa.int64()),
                 _matrix(buckets(least)), _matrix(packed_marks(mix64(least)))],
                names=["doc_id", "text_key", "paragraph", "n_words", "class_id", "n", "buckets", "marks"])

    return _keyed(docs).mapInArrow(
        run, "doc_id long, text_key long, paragraph int, n_words int, class_id binary, n long, buckets array<long>, marks array<long>")


def _class_sets(docs: DataFrame, min_words: int) -> DataFrame:
    """``(rep, shingles)`` of every paragraph of ``docs``."""
    def run(batches):
        for batch in sliced(batches, rows=256):
            found = Paragraphs(texts_of(batch.column(0)), min_words)
            offsets = np.r_[0, np.cumsum(found.counts)].astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.shingles.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(found.ids, pa.binary()), sets], names=["rep", "shingles"])

    return docs.select("text").mapInArrow(run, "rep binary, shingles array<long>")


def repeated_paragraphs(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each paragraph of ``docs`` (``doc_id``, ``text``) that repeats:
    ``(doc_id, text_key, paragraph, n_words, first_doc_id, first_paragraph,
    removed)``; the first of its cluster has ``removed`` false."""
    keyed = _keyed(docs)
    rows = materialize(paragraph_rows(docs, min_words), "paragraphs")
    classes = materialize(rows.groupBy("class_id").agg(
        F.first("n").alias("n"), F.first("buckets").alias("buckets"), F.first("marks").alias("marks"),
        F.min(F.struct("doc_id", "text_key")).alias("where")), "paragraph-classes")

    def sets_of(reps):
        # texts of the documents where a class is first
        named = materialize(reps, "named")
        wanted = materialize(classes.join(named, F.col("class_id") == F.col("rep"), "left_semi").select(
            F.col("where.doc_id").alias("i"), F.col("where.text_key").alias("k")).distinct(), "wanted")
        texts = semi_join(keyed, wanted, lambda few: keyed["doc_id"].eqNullSafe(few["i"]) & (keyed["text_key"] == few["k"]))
        sets = materialize(_class_sets(texts, min_words).join(named, "rep", "left_semi")
                           .dropDuplicates(["rep"]), "paragraph-sets")
        discard(named)
        discard(wanted)
        return sets

    links = linked(classes.select(F.col("class_id").alias("rep"), "n", "buckets", "marks"), percent, ROWS * BANDS, sets_of, missed=1e-4)
    parts = connected_components(links, "a", "b")
    discard(classes)
    cluster = F.coalesce("component", "class_id").alias("cluster")
    place = F.struct("doc_id", "text_key", "paragraph")
    placed = rows.select("doc_id", "text_key", "paragraph", "n_words", "class_id").join(
        parts, F.col("class_id") == F.col("node"), "left").select("doc_id", "text_key", "paragraph", "n_words", cluster)
    # written, so that the join below may be split where a cluster has very many paragraphs
    firsts = materialize(placed.groupBy("cluster").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last"),
                         "cluster-firsts")
    return placed.join(firsts, "cluster").select(
        "doc_id", "text_key", "paragraph", "n_words", F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.paragraph").alias("first_paragraph"), (place != F.col("first")).alias("removed"))


def remove_paragraphs(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, found: DataFrame | None = None,
                      key_col: str | None = None) -> DataFrame:
    """``docs`` without the repeated paragraphs (``found``, if they are known
    already; ``key_col`` then names the column with their ``text_key``); a document
    that loses its last word goes. All columns stay; ``n_chars``, if there is one,
    follows the text."""
    found = repeated_paragraphs(docs, percent, min_words) if found is None else found
    gone = found.where("removed").groupBy("doc_id", "text_key").agg(
        F.collect_set("paragraph").alias("__gone")).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "__gone")
    kept_lines = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(F.col("__gone"), i))
    key = F.col(key_col) if key_col else F.xxhash64("text")
    out = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (key == F.col("__key")), "left")
    new = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept_lines, "\n"))
    out = out.withColumn("text", new).where(F.col("__gone").isNull() | (F.length(F.translate("text", SPACES, "")) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def repeats(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Both kinds of repeats in one table ``(unit, doc_id, text_key, paragraph,
    start_word, end_word, n_words, first_doc_id, first_paragraph, first_word,
    removed)``: the rows of ``repeated_paragraphs`` (unit ``paragraph``) and, in what
    is left without the removed ones, the passages that stand before (unit
    ``passage``; words are counted in that rest)."""
    found = materialize(repeated_paragraphs(docs, percent, min_words), "repeated-paragraphs")
    rest = materialize(remove_paragraphs(_keyed(docs), found=found, key_col="text_key"), "paragraphs-left")
    none = F.lit(None).cast("int")
    spans = repeated_passages(rest, "text_key")
    discard(rest)
    return found.select(
        F.lit("paragraph").alias("unit"), "doc_id", "text_key", "paragraph", none.alias("start_word"), none.alias("end_word"),
        "n_words", "first_doc_id", "first_paragraph", none.alias("first_word"), "removed").unionByName(spans.select(
            F.lit("passage").alias("unit"), "doc_id", "text_key", none.alias("paragraph"), "start_word", "end_word",
            (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id", none.alias("first_paragraph"),
            "first_word", F.lit(True).alias("removed")))


def remove_repeats(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without repeated paragraphs, and then without the passages that
    stand before in what is left; a document that loses its last word goes. All
    columns stay; ``n_chars``, if there is one, follows the text."""
    rest = materialize(remove_paragraphs(docs, percent, min_words), "paragraphs-left")
    return remove_passages(rest)
