"""What several operators share: word and shingle definitions, batch helpers.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``; ``bytes.split()`` and
``bytes.lower()`` on UTF-8 have exactly this word rule and the A-Z rule.

Functions that run inside tasks are pickled by value (``ship``), so executors
need no copy of this package on their path.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = (1 << 64) - 1
SPACES = " \t\n\x0b\x0c\r"


def ship(module_name: str) -> None:
    """Pickle the functions of a module by value in tasks."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)


class WordHash(dict):
    """Memo of 64-bit word hashes, emptied when it holds ``limit`` words, so a
    worker's memory stays bounded whatever the vocabulary."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str, memo: WordHash) -> np.ndarray:
    """Hashes of the lower-cased (A-Z) words of a text."""
    words = text.encode("utf-8", "replace").lower().split()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240502)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_SPACE] = 0
_SPOT = _rng.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BREAK = re.compile(rb"[\x20\x09-\x0D]")
CHUNK = 1 << 20


def hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``raw`` and where they begin: for each word
    the sum of a random number per byte value times one per place in the word,
    mixed. Works through pieces of about ``CHUNK`` bytes that end at white space."""
    data, at = np.frombuffer(raw, np.uint8), 0
    hashes, starts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    while at < len(data):
        end = at + CHUNK
        if end < len(data):
            stop = _BREAK.search(raw, end)
            end = stop.start() if stop else len(data)
        piece = data[at:end]
        space = _SPACE[piece]
        begin = np.flatnonzero(~space & np.r_[True, space[:-1]])
        if len(begin):
            spot = np.arange(begin[0], len(piece)) - np.repeat(begin, np.diff(np.append(begin, len(piece))))
            weight = _SPOT[np.minimum(spot, 4095)]
            if spot.max() >= 4096:
                far = np.flatnonzero(spot >= 4096)
                weight[far] = mix64(spot[far].astype(np.uint64)) | np.uint64(1)
            hashes.append(mix64(np.add.reduceat(_BYTE[piece[begin[0]:]] * weight, begin - begin[0])))
            starts.append(begin + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def joined_texts(texts: list[str]) -> tuple[bytes, np.ndarray]:
    """The lower-cased (A-Z) texts, one after the other with a line break after
    each, and where each begins."""
    raw = [t.encode("utf-8", "replace").lower() for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    return b"\n".join([*raw, b""]), np.cumsum(sizes) - sizes


# odd multipliers from one generator, in order of the word's place in a shingle
_PLACE = np.random.default_rng(20240501).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each window of ``width`` words, in text order; a
    shorter text is one shingle, a text without words has none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < width:
        return mix64(np.array([np.sum(words * _PLACE[:n], dtype=np.uint64) + np.uint64(n)], np.uint64))
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total += words[k:n - width + 1 + k] * _PLACE[k]
    return mix64(total + np.uint64(width))


def sliced(batches, rows: int = 512, max_bytes: int = 16 << 20):
    """Cut Arrow batches so that no piece holds many rows or, unless a single
    row does, many bytes; output stays small for long texts."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, min(rows, int(n * max_bytes / max(1, batch.nbytes)) or 1))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, null as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def list_array(lists: list[np.ndarray], value_type: pa.DataType) -> pa.Array:
    """An Arrow list column of numpy arrays."""
    sizes = np.fromiter((len(x) for x in lists), np.int64, len(lists))
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    flat = np.concatenate(lists) if lists else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, value_type))


def with_fields(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    """Schema of ``df`` with ``fields`` at the end; a column of ``df`` with
    the name of a new field gives way to it."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in new] + fields)


def text_or_empty(column) -> F.Column:
    return F.coalesce(column.cast("string"), F.lit(""))
