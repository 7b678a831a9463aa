"""Elements of files that each hold one JSON array, read by byte ranges.

A file is cut into ranges by its length alone; a task reads one range at a time, so
a file of any size is read by many tasks. Where a range begins, three things are
unknown: whether that place is inside a string, how deep it is nested, and how many
elements came before. Each is an associative prefix over the ranges of a file:

1. one pass counts the quotes that aren't escaped and, for both answers to the first
   question, the change of depth and the commas at each relative depth;
2. exclusive scans over the ranges (one small row a range) give the parity of the
   quotes, with it the depth, with it the number of commas between elements;
3. the second pass emits each element that begins in the range, with its place in
   the array. An element that goes on behind the range is read to its end.

Escapes need no scan: whether the byte before a range is an escaping backslash is
seen from the bytes before it.

A file of one range begins outside a string at depth 0 behind no element, so it needs
no scan and is read once.

An array may be empty; a file of no bytes, which Spark's scan leaves out, has no elements. What is no single array (an open string or bracket at the
end, something before or behind the array, two commas in a row, an element that is
not one object) fails the read; an object that is no JSON fails where it is parsed.
"""

from __future__ import annotations

import sys
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.operators.scan import RunningSum, RunningXor, segmented_scan
from curio.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 8 << 20
# What a task reads: so many ranges (small files) or bytes, about.
TASK_RANGES, TASK_BYTES = 512, 16 << 20
QUOTE, BACKSLASH, COMMA = 34, 92, 44
OPEN, CLOSE = b"[{", b"]}"
WHITE = b" \t\n\r"


def file_system(path: str):
    """The pyarrow file system of a path as Spark names it, and the path in it."""
    from pyarrow import fs
    if "://" not in path or path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@="))


def _open(path: str):
    store, inner = file_system(path)
    return store.open_input_file(inner)


def _escaped(file, at: int) -> bool:
    """Whether the byte at ``at`` stands behind an odd number of backslashes."""
    run, step = 0, 64
    while at - run > 0:
        lo = max(0, at - run - step)
        piece = file.read_at(at - run - lo, lo)
        tail = len(piece) - len(piece.rstrip(b"\\"))
        run += tail
        if tail < len(piece):
            break
        step *= 2
    return run % 2 == 1


def _marks(data: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of brackets and commas, the change of depth at each (0 for a comma)
    and the parity of the quotes before each; the last entry of the
    parities is that of the whole piece."""
    b = np.frombuffer(data, np.uint8)
    slashes = np.flatnonzero(b == BACKSLASH)
    quotes = np.flatnonzero(b == QUOTE)
    if len(slashes):
        first = np.concatenate([[True], np.diff(slashes) != 1])
        begin = slashes[first]
        length = np.diff(np.append(np.flatnonzero(first), len(slashes)))
        odd = length % 2 == 1
        if escaped and begin[0] == 0:
            odd[0] = not odd[0]
        quotes = quotes[~np.isin(quotes, (begin + length)[odd])]
    if escaped and len(b) and b[0] == QUOTE:
        quotes = quotes[quotes != 0]
    step = np.zeros(256, np.int8)
    step[list(OPEN)], step[list(CLOSE)] = 1, -1
    wanted = step != 0
    wanted[COMMA] = True
    at = np.flatnonzero(wanted[b])
    parity = np.searchsorted(quotes, at) & 1
    return at, step[b[at]].astype(np.int64), np.append(parity, len(quotes) & 1)


def _summary(data: bytes, escaped: bool):
    """``(quotes, [depth], [commas])``: parity of the quotes; the change of depth and a
    map from relative depth to commas, for a beginning outside and inside a string."""
    at, step, parity = _marks(data, escaped)
    depths, commas = [], []
    for inside in (0, 1):
        s = step[parity[:-1] == inside]
        depth = np.cumsum(s)
        levels, n = np.unique(depth[s == 0], return_counts=True)
        depths.append(int(depth[-1]) if len(depth) else 0)
        commas.append(list(zip(levels.tolist(), n.tolist())))
    return int(parity[-1]), depths, commas


class _Elements:
    """The elements that begin in a range, found from what is known at its begin."""

    def __init__(self, file, path: str, lo: int, hi: int, inside: int, depth: int, before: int):
        self.file, self.path, self.lo, self.hi, self.size = file, path, lo, hi, file.size()
        self.inside, self.depth, self.before = inside, depth, before
        self.begun = None                 # place of the delimiter that the current element begins behind

    def _fail(self, why: str):
        raise ValueError(f"{self.path}: {why}")

    def _delimiters(self):
        """``(place, change, depth behind it)`` of the array's brackets, of the commas between
        elements and of the brackets that open elements: those of the range, then
        on to the end of the element that is open there."""
        at, inside, depth = self.lo, self.inside, self.depth
        step = self.hi - self.lo
        while at < self.size and (at < self.hi or self.begun is not None):
            self.base, self.data = at, self.file.read_at(min(step, self.size - at), at)
            places, change, parity = _marks(self.data, _escaped(self.file, at))
            real = parity[:-1] == inside
            places, change = places[real], change[real]
            after = depth + np.cumsum(change)
            if len(after) and after.min() < 0:
                self._fail("closing bracket without an opening one")
            edge = np.flatnonzero(((change == 0) & (after <= 1)) | ((change == 1) & (after <= 2)) | ((change == -1) & (after == 0)))
            for k in edge.tolist():
                yield at + int(places[k]), int(change[k]), int(after[k])
            depth = int(after[-1]) if len(after) else depth
            inside ^= int(parity[-1])
            at += len(self.data)
            step = 1 << 20
        if at >= self.size and (inside or depth):
            self._fail("the array is not closed")

    def _between(self, lo: int, hi: int) -> bytes:
        if lo >= self.base:
            return self.data[lo - self.base:hi - self.base]
        return self.file.read_at(hi - lo, lo)

    def __iter__(self):
        place, opened, first = self.before + 1, 0, False
        bare = self.depth == 0 and not self.inside      # nothing but white space may stand here
        last, seen = self.lo, False
        for at, change, after in self._delimiters():
            if after == 2:
                opened += 1
                continue
            if self.begun is not None:
                text = self._between(self.begun + 1, at).strip(WHITE)
                if text:
                    if opened != 1 or text[:1] != b"{" or text[-1:] != b"}":
                        self._fail(f"element {place} is not one object")
                    yield place, text.decode("utf-8")
                elif not (first and change == -1):
                    self._fail(f"element {place} is missing")
                place += 1
                self.begun = None
            if at >= self.hi:
                return
            if change == 0 and after == 0 or bare and self._between(last, at).strip(WHITE):
                self._fail("something beside the array")
            if change and self.file.read_at(1, at) != (b"[" if change == 1 else b"]"):
                self._fail("not an array")
            if change == 1:
                if self._anything(0, at):
                    self._fail("a second array")
                place = 0
            bare, last, seen, first, opened = change == -1, at + 1, True, change == 1, 0
            if change >= 0:
                self.begun = at
        if bare and self._anything(last, self.hi):
            self._fail("something beside the array")
        if bare and not seen and self.hi >= self.size and not self._anything(0, self.size):
            self._fail("no array")

    def _anything(self, lo: int, hi: int) -> bool:
        """Whether bytes other than white space stand there."""
        while lo < hi:
            data = self.file.read_at(min(1 << 20, hi - lo), lo)
            if data.strip(WHITE):
                return True
            lo += len(data)
        return False


def read_elements(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, pos, element)``: the JSON text of each element of the array in each
    file of ``files`` (``path``, ``length``), with its place in the array."""
    last = F.greatest(F.ceil(F.col("length") / F.lit(range_bytes)) - 1, F.lit(0)).cast("bigint")
    # a range is a small row and much work: the number of tasks follows the bytes and the
    # files, as adaptive execution would put all the rows into one
    ranges = materialize(files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("k")), "json-files")
    one = F.col("length") <= range_bytes
    n, size, split = ranges.agg(F.count(F.lit(1)), F.sum(F.least(F.lit(range_bytes), F.col("length") - F.col("k") * range_bytes)),
                                F.count(F.when(~one, 1))).first()
    slots = spark.sparkContext.defaultParallelism
    tasks = max(min(n, 2 * slots), -(-n // TASK_RANGES), -(-(size or 0) // TASK_BYTES), 1)
    none = F.lit(0).cast("bigint")
    known = ranges.where(one).select("path", "length", "k", none.alias("inside"), none.alias("depth"), none.alias("before"))
    if split:
        known = known.unionByName(_beginnings(ranges.where(~one), range_bytes, tasks))

    def elements(batches):
        for batch in batches:
            for path, size, k, inside, depth, before in zip(*(c.to_pylist() for c in batch.columns)):
                with _open(path) as file:
                    pos, texts, held = [], [], 0
                    for place, text in _Elements(file, path, k * range_bytes, min(size, (k + 1) * range_bytes), inside, depth, before):
                        pos.append(place)
                        texts.append(text)
                        held += len(text)
                        if held > 4 << 20:
                            yield _rows(path, pos, texts)
                            pos, texts, held = [], [], 0
                    yield _rows(path, pos, texts)

    return known.repartition(tasks, "path", "k").mapInArrow(elements, "path string, pos long, element string")


def _beginnings(ranges: DataFrame, range_bytes: int, tasks: int) -> DataFrame:
    """``ranges`` (``path``, ``length``, ``k``) with what is known where each begins:
    whether it is ``inside`` a string, its ``depth``, and the elements ``before``."""
    def summaries(batches):
        for batch in batches:
            rows = []
            for path, size, k in zip(*(c.to_pylist() for c in batch.columns)):
                with _open(path) as file:
                    lo = k * range_bytes
                    quotes, depths, commas = _summary(file.read_at(min(range_bytes, size - lo), lo), _escaped(file, lo))
                rows.append((path, size, k, quotes, depths, commas))
            names = ["path", "length", "k", "quotes", "depths", "commas"]
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.map_(pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    # written once: a scan reads its input twice
    known = materialize(ranges.repartition(tasks, "path", "k").mapInArrow(
        summaries, "path string, length long, k long, quotes long, depths array<long>, commas array<map<long,long>>"), "json-ranges")
    order = [F.col("k").asc()]
    # whether the range begins inside a string, then how deep, then behind how many commas
    inside = F.col("parity").bitwiseXOR(F.col("quotes"))
    known = segmented_scan(known, ["path"], order, {"parity": RunningXor("quotes")}).withColumn("inside", inside)
    known = known.select("path", "length", "k", "inside", F.get("depths", F.col("inside").cast("int")).alias("change"),
                         F.get("commas", F.col("inside").cast("int")).alias("commas"))
    known = segmented_scan(known, ["path"], order, {"depth": RunningSum("change")}).withColumn("depth", F.col("depth") - F.col("change"))
    here = F.coalesce(F.try_element_at("commas", F.lit(1) - F.col("depth")), F.lit(0)).cast("bigint")
    known = known.select("path", "length", "k", "inside", "depth", here.alias("here"))
    known = segmented_scan(known, ["path"], order, {"before": RunningSum("here")})
    return known.select("path", "length", "k", "inside", "depth", (F.col("before") - F.col("here")).alias("before"))


def _rows(path: str, pos: list[int], texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(pos), pa.string()), pa.array(pos, pa.int64()), pa.array(texts, pa.string())],
                                      names=["path", "pos", "element"])
