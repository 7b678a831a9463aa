"""Operator 8, benchmark decontamination by CGK embedding and bit-sampling LSH.

A document holds an item if some run of its words is within ``k`` word edits of
the item's words (lower-cased A-Z), ``k`` being 15 % of the item's length. An item
is cut into k + 1 blocks or more of 4 words; k edits leave one of them whole, so
window starts that no item block points to (within k) can hold no item and are
passed over; this loses nothing. Windows at the other starts are embedded by the
Chakraborty-Goldenberg-Koucky random walk: at step j it writes the word it stands
on and moves on if the j-th random bit of that word is one. Few edits between
window and item so become few differing places, and a sample of places agrees
with good probability. ``REPEATS`` independent walks and samples are taken, per
class of item lengths (the window is as long as the class's shortest item); a
window that agrees with an item in one of them is verified by exact edit distance
(bit-parallel, free ends). ``tests/llm`` measures the recall against brute force.

Items go to the tasks in blocks of at most ``BLOCK_BYTES`` of text, each broadcast
and held against all documents: the benchmark is the stated query set, its size
per pass is bounded, and nothing is shuffled.

Items with fewer than ``MIN_ITEM_WORDS`` words allow no edit, so they are found by
a hash of their whole word sequence instead, and compared word by word.

Defined results: null or empty texts hold nothing; items without words, null items
included, match nothing. Rows that share an id (null too) but not the text are
judged apart. Repeated items are
reported each; repeated rows each. An empty table on either side gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curio.llm.common import WordHash, mix64, ship, sliced, texts_of
from curio.session import materialize

ship(__name__)

EDIT_PERCENT, MIN_ITEM_WORDS, BLOCK = 15, 8, 4
REPEATS, SAMPLE = 24, 2
BLOCK_BYTES = 16 << 20
_BITS = np.random.default_rng(8).integers(1, 1 << 63, (REPEATS, 4096), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(9).integers(1, 1 << 63, SAMPLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def edits_allowed(n_words: int) -> int:
    return n_words * EDIT_PERCENT // 100


def length_class(n_words: int) -> int:
    """The largest of 8, 12, 18, 27, ... up to the length."""
    size = MIN_ITEM_WORDS
    while size * 3 // 2 <= n_words:
        size = size * 3 // 2
    return size


def embed(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """LSH keys ``(REPEATS, len(starts))`` of the windows of ``width`` words:
    each repeat's walk, of which ``SAMPLE`` places are kept."""
    steps = min(2 * width, _BITS.shape[1])
    picks = np.sort(np.random.default_rng(width).integers(0, steps, (REPEATS, SAMPLE)), axis=1)
    ends = np.minimum(starts + width, len(hashes))
    padded = np.append(hashes, np.uint64(0))
    at = np.repeat(starts[None, :], REPEATS, axis=0)
    keys = np.zeros(at.shape, np.uint64)
    for j in range(int(picks.max()) + 1):
        symbol = np.where(at < ends, padded[np.minimum(at, len(hashes))], np.uint64(0))
        for s in range(SAMPLE):
            hit = picks[:, s] == j
            if hit.any():
                keys[hit] += symbol[hit] * _PLACE[s]
        at = at + ((symbol * _BITS[:, j:j + 1]) >> np.uint64(63)).astype(np.int64)
    return mix64(keys + np.arange(REPEATS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(width))


def _grams(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(max(0, len(hashes) - BLOCK + 1), np.uint64)
    for k in range(BLOCK):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k:len(total) + k]
    return mix64(total)


def best_match(item: list[bytes], text: list[bytes], anchored: bool = False) -> tuple[int, int]:
    """``(edits, end)`` of the run of ``text`` nearest to ``item``, by bit-parallel
    edit distance; ``anchored`` runs begin with the text."""
    m = len(item)
    masks: dict[bytes, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = (m, 0)
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        x = eq | down
        d = (((x & up) + up) ^ up) | x
        hp, hn = down | (full & ~(d | up)), up & d
        score += bool(hp & top) - bool(hn & top)
        hp = (hp << 1 | anchored) & full
        hn = (hn << 1) & full
        up, down = hn | (full & ~(d | hp)), hp & d
        if score < best[0]:
            best = (score, j + 1)
    return best


def _sequences(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` words."""
    total = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[k:len(total) + k]
    return mix64(total + np.uint64(width))


class Index:
    """Blocks, LSH keys and words of a bounded set of items; short items by
    the hash of their words, per length."""

    def __init__(self, items: list[tuple[int, str | None]]):
        memo = WordHash()
        self.items, anchors, keys = [], [], {}
        self.short: dict[int, dict[int, list]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
            if len(words) < MIN_ITEM_WORDS:
                whole = int(_sequences(hashes, len(words))[0])
                self.short.setdefault(len(words), {}).setdefault(whole, []).append((item_id, words))
                continue
            k, width, number = edits_allowed(len(words)), length_class(len(words)), len(self.items)
            grams = _grams(hashes)
            anchors += [(int(grams[s]), s, k, width) for s in range(0, len(words) - BLOCK + 1, BLOCK)]
            for key in embed(hashes, np.array([0]), width)[:, 0].tolist():
                keys.setdefault(key, set()).add(number)
            self.items.append((item_id, words, k))
        points: dict[int, set] = {}
        for gram, s, k, width in anchors:
            points.setdefault(gram, set()).add((s, k, width))
        self.grams = np.array(sorted(points), np.uint64)
        self.points = [sorted(points[g]) for g in self.grams.tolist()]
        self.keys = np.array(sorted(keys), np.uint64)
        self.of_key = [sorted(keys[k]) for k in self.keys.tolist()]
        self.short_keys = {width: np.array(sorted(found), np.uint64) for width, found in self.short.items()}

    @staticmethod
    def of(block: dict) -> Index:
        """The index that a worker builds once from its copy of the items."""
        if "index" not in block:
            block["index"] = Index(block["items"])
        return block["index"]

    def _short_matches(self, words: list[bytes], hashes: np.ndarray):
        for width, keys in self.short_keys.items():
            have = _sequences(hashes, width)
            spot = np.minimum(np.searchsorted(keys, have), len(keys) - 1)
            done: dict[tuple, int] = {}
            for at in np.flatnonzero(keys[spot] == have).tolist():
                for number, (item_id, item) in enumerate(self.short[width][int(have[at])]):
                    if words[at:at + width] == item and at >= done.get((int(have[at]), number), 0):
                        done[int(have[at]), number] = at + width
                        yield item_id, at, at + width, 0

    def matches(self, text: str, memo: WordHash):
        """``(item_id, start_word, end_word, edits)`` of the items in a text."""
        words = words_of(text)
        hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        yield from self._short_matches(words, hashes)
        if not len(self.grams) or len(words) < BLOCK:
            return
        grams = _grams(hashes)
        where = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        hits = np.flatnonzero(self.grams[where] == grams)
        starts: dict[int, set] = {}
        for p in hits.tolist():
            for s, k, width in self.points[where[p]]:
                starts.setdefault(width, set()).update(range(max(0, p - s - k), max(0, p - s + k) + 1))
        found: dict[int, set] = {}
        for width, some in starts.items():
            offsets = np.array(sorted(o for o in some if o < len(words)), np.int64)
            for at in range(0, len(offsets), 4096):
                part = offsets[at:at + 4096]
                keys = embed(hashes, part, width)
                spot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                for r, c in zip(*np.nonzero(self.keys[spot] == keys)):
                    for number in self.of_key[spot[r, c]]:
                        found.setdefault(number, set()).add(int(part[c]))
        for number in sorted(found):
            item_id, item, k = self.items[number]
            done = -1
            for o in sorted(found[number]):
                if o < done:
                    continue
                low = max(0, o - k)
                region = words[low:o + len(item) + 2 * k]
                edits, end = (0, o - low + len(item)) if words[o:o + len(item)] == item else best_match(item, region)
                if edits <= k:
                    _, back = best_match(item[::-1], region[:end][::-1], anchored=True)
                    yield item_id, low + end - back, low + end, edits
                    done = low + end


def _item_blocks(benchmark: DataFrame, block_bytes: int):
    """The items, in lists of bounded size, one list on the driver at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "") + 64
        if size >= block_bytes:
            yield block
            block, size = [], 0
    yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, item_id, start_word, end_word, edits)`` for every item that a
    text of ``docs`` (``doc_id``, ``text``) holds."""
    return _matches(docs, benchmark, block_bytes).drop("text_key")


def _matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``contaminated`` with the hash of the text that holds the item."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    parts = []
    for block in _item_blocks(benchmark, block_bytes):
        index = spark.sparkContext.broadcast({"items": block})

        def run(batches, index=index):
            memo = WordHash()
            for batch in sliced(batches):
                rows = [(i, *m) for i, t in enumerate(texts_of(batch.column(1))) for m in Index.of(index.value).matches(t, memo)]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(2).take(at)] + [pa.array([r[c] for r in rows], pa.int64()) for c in range(1, 5)],
                    names=["doc_id", "text_key", "item_id", "start_word", "end_word", "edits"])

        parts.append(texts.mapInArrow(run, "doc_id long, text_key long, item_id long, start_word long, end_word long, edits long"))
    while len(parts) > 1:  # a benchmark of many blocks: one written pass each, so no plan holds them all
        parts = [materialize(p, "matches") for p in parts]
        parts = [parts[0]] if len(parts) == 1 else [a.unionByName(b) for a, b in zip(parts[::2], parts[1::2])] + (
            [parts[-1]] if len(parts) % 2 else [])
    return parts[0]


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds an item; a row is judged by
    its own text, so other rows of its id (null too) stay."""
    found = materialize(_matches(docs, benchmark).select(
        F.col("doc_id").alias("__held"), F.col("text_key").alias("__text")).distinct(), "contaminated")
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["__held"])
                     & (F.xxhash64(docs["text"].cast("string")) == found["__text"]), "left_anti")
