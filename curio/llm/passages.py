"""Operator 2, second part: passages that repeat inside lines or across them.

A window is a run of ``WINDOW`` words (lower-cased A-Z) of the whole text; lines
play no part. Windows with equal words form a class. All windows of a class but the
first by (doc_id, text, place) are removed, so a run of 50 words or more
that stands anywhere before goes as a whole, wherever it begins. A window that
overlaps the first of its class in one document stays (``a a a ...``).

Every window is named by the least hash of its 25-word runs (winnowing), which
equal windows share, and which consecutive windows mostly share too. Only windows
whose name stands at another place as well become rows; then classes are
aggregated, so no group's pairs are made and no window is passed over.

Defined results: null and empty texts and texts of fewer words hold no window. Rows
with equal id and equal text are one document, a null id sorts first, rows that
share an id but not the text are told apart. Extra columns pass through
``remove_passages``; an empty table gives empty results. Copies whose edits leave no
run of ``WINDOW`` equal words are not passages here.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curio.llm.banding import semi_join
from curio.llm.common import hashed_words, joined_texts, mix64, ship, sliced, texts_of
from curio.session import discard, materialize

ship(__name__)

WINDOW = 50
HALF = WINDOW // 2
_LEFT = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix64(left * _LEFT + right)


def _over(h: np.ndarray, width: int, join) -> np.ndarray:
    """``join`` over each run of ``width`` entries, by doubling."""
    done, out, size, power = 0, None, 1, h
    while True:
        if width & size:
            out = power if out is None else join(out[:len(power) - done], power[done:][:len(out)])
            done += size
        if done == width:
            return out
        power, size = join(power[:len(power) - size], power[size:]), size * 2


class Runs:
    """The runs of consecutive windows of one name in a batch of texts, in flat
    arrays: ``owner`` (number of the text), ``names``, ``starts`` (first window's
    word), ``sizes`` (windows), and the ``hashes`` of all windows one after the other."""

    def __init__(self, texts: list[str]):
        raw, begin = joined_texts(texts)
        flat, spots = hashed_words(raw)
        words = np.diff(np.append(np.searchsorted(spots, begin), len(spots)))
        windows = np.maximum(words - WINDOW + 1, 0)
        total = int(windows.sum())
        self.owner = self.starts = self.sizes = np.empty(0, np.int64)
        self.names = self.hashes = np.empty(0, np.uint64)
        if not total:
            return
        # windows over the whole batch; those that cross from one text to the next are skipped
        halves = _over(flat, HALF, _joined)
        owner = np.repeat(np.arange(len(words)), windows)
        start = np.arange(total) - (np.cumsum(windows) - windows)[owner]
        at = start + (np.cumsum(words) - words)[owner]
        names, self.hashes = _over(halves, HALF + 1, np.minimum)[at], _joined(halves[:-HALF], halves[HALF:])[at]
        begins = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])])
        self.owner, self.names, self.starts = owner[begins], names[begins], start[begins]
        self.sizes = np.diff(np.append(begins, total))


def _keyed(docs: DataFrame, key_col: str | None) -> DataFrame:
    text = F.col("text").cast("string")
    key = F.col(key_col) if key_col else F.xxhash64(text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("text_key"), text.alias("text"))


def _names(keyed: DataFrame) -> DataFrame:
    """``(name, times)`` of every run of windows; one that holds two windows
    apart counts twice."""
    def run(batches):
        for batch in sliced(batches):
            found = Runs(texts_of(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(found.names.view(np.int64)), pa.array(1 + (found.sizes > HALF + 1).astype(np.int64))],
                                             names=["name", "times"])

    return keyed.select("text").mapInArrow(run, "name long, times long")


def _window_rows(keyed: DataFrame) -> DataFrame:
    """``(doc_id, text_key, name, start, hashes)`` of every run of windows."""
    def run(batches):
        for batch in sliced(batches):
            found = Runs(texts_of(batch.column(2)))
            at, ends = pa.array(found.owner), np.r_[0, np.cumsum(found.sizes)].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(found.names.view(np.int64)),
                 pa.array(found.starts, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(found.hashes.view(np.int64)))],
                names=["doc_id", "text_key", "name", "start", "hashes"])

    return keyed.mapInArrow(run, "doc_id long, text_key long, name long, start int, hashes array<long>")


def _merged(windows: DataFrame) -> DataFrame:
    """Maximal spans of the removed windows of each document."""
    lists = windows.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "first_doc_id", "first_word"))).alias("w"))
    # a span begins where the window before, if any, has ended
    opens = F.filter(F.col("w"), lambda x, i: (i == 0) | (x["start"] > F.element_at("w", F.greatest(i, F.lit(1)))["start"] + WINDOW))
    closes = F.filter(F.col("w"), lambda x, i: (i == F.size("w") - 1) | (
        F.element_at("w", F.least(i + 2, F.size("w")))["start"] > x["start"] + WINDOW))
    return lists.select("doc_id", "text_key", F.inline(F.arrays_zip(opens.alias("o"), closes.alias("c")))).select(
        "doc_id", "text_key", F.col("o.start").alias("start_word"), (F.col("c.start") + WINDOW).alias("end_word"),
        F.col("o.first_doc_id").alias("first_doc_id"), F.col("o.first_word").alias("first_word"))


def repeated_passages(docs: DataFrame, key_col: str | None = None) -> DataFrame:
    """``(doc_id, text_key, start_word, end_word, first_doc_id, first_word)`` of
    every span of ``docs`` (``doc_id``, ``text``) that only repeats; the words are
    counted from 0, the end is not part of it, and the first place is the one of
    the span's first window. ``key_col``: a long column that tells rows of one id
    apart, if that isn't to be the hash of the text."""
    keyed = _keyed(docs, key_col)
    often = materialize(_names(keyed).groupBy("name").agg(F.sum("times").alias("times")).where("times > 1").select("name"), "window-names")
    runs = materialize(semi_join(_window_rows(keyed), often, "name"), "windows")
    rows = runs.select("doc_id", "text_key", "name", "start", F.posexplode("hashes").alias("i", "hash")).select(
        "doc_id", "text_key", "name", "hash", (F.col("start") + F.col("i")).alias("start"))
    place = F.struct("doc_id", "text_key", "start")
    # written, so that the join below may be split where a window has very many places
    firsts = materialize(rows.groupBy("name", "hash").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                         .where("first <> last").drop("last"), "window-firsts")
    near = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")) & (
        F.col("start") < F.col("first.start") + WINDOW)
    gone = rows.join(firsts, ["name", "hash"]).where(~near).select(
        "doc_id", "text_key", "start", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_word"))
    spans = materialize(_merged(gone), "passages")
    for done in (often, runs, firsts):
        discard(done)
    return spans


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans, which are in order; of the white
    space around a span the part with a line break stays."""
    raw = text.encode("utf-8", "replace")
    words = [m.span() for m in WORD.finditer(raw)]
    out, at = [], 0
    for start, end in spans:
        before, after = words[start - 1][1] if start else 0, words[end][0] if end < len(words) else len(raw)
        out.append(raw[at:before])
        lead, trail = raw[before:words[start][0]], raw[words[end - 1][1]:after]
        out.append(trail if b"\n" in trail and b"\n" not in lead else lead)
        at = after
    return b"".join([*out, raw[at:]]).decode("utf-8")


def remove_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without the passages that stand before; a document that loses
    its last word goes. All columns stay; ``n_chars``, if there is one, follows
    the text."""
    gone = repeated_passages(docs).groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("__gone")).select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "__gone")
    joined = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__key")),
                       "left").select(*docs.columns, "__gone")
    hit, at, names = joined.where("__gone is not null"), docs.columns.index("text"), docs.columns
    schema = T.StructType([T.StructField(f.name, T.StringType()) if k == at else f for k, f in enumerate(docs.schema.fields)])

    def run(batches):
        for batch in sliced(batches):
            spans = batch.column(len(names)).to_pylist()
            texts = [without(t, [(x["start_word"], x["end_word"]) for x in found]) for t, found in zip(texts_of(batch.column(at)), spans)]
            columns = batch.columns[:len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    cut = hit.mapInArrow(run, schema).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast("long"))
    return joined.where("__gone is null").select(*docs.columns).unionByName(cut.select(*docs.columns))
