"""Vocabulary and tokenizer operators.

* ``word_frequencies``: the corpus reduced to distinct pre-tokens with counts
  (one big aggregate, combined map-side).
* ``train_bpe_vocab``: byte-pair merges learned on that table, many to a round.
  A round counts all adjacent pairs (an aggregation) and makes the most frequent
  ones active; let T be the count of the best pair that is not. Words fall apart
  where two symbols are no active pair: no pair across such a gap, nor any pair that
  a merge makes there, can be more frequent than T. So every merge that comes up
  before the best count has sunk to T is decided by the active segments alone.
  Equal segments are added up by a second aggregation; their number is bounded
  (a round with too many tries fewer active pairs), and the driver replays the merges
  on them, with an index from pairs to segments whose counts are kept up by
  deltas. The words then take the round's merges in one pass over the word table.
  Where more pairs tie at the top than a round may hold, their longest run without
  a pair that begins where another ends is merged instead, as such pairs can't
  touch each other's counts. Both give the merges of plain one-at-a-time BPE.
* ``encode_texts``: one Arrow pass with the vocabulary broadcast; joins are made
  best score first, in long segments from a heap over a linked list.
* ``decode_tokens``: the byte labels of the ids, read as UTF-8 with replacement.

Conventions: a word is encoded with the whitespace marker U+2581 in front
(the dummy prefix); ids 0-2 are ``<unk> <s> </s>``, 3-258 the byte-fallback
pieces ``<0x00>``..``<0xFF>``; characters missing from the vocabulary fall
back to their UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import math
import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curio.functions.text import words
from curio.session import discard, ensure_checkpoint_dir, materialize

# --- fixed values -----------------------------------------------------------
SPACE_MARK = "▁"
SPECIALS = ("<unk>", "<s>", "</s>")
BYTE_OFFSET = 3
VOCAB_SCHEMA = "token_id int, piece string, score float, n_bytes int"
# ---------------------------------------------------------------------------


# tasks carry this module's functions by value: executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def word_frequencies(df: DataFrame, text: str = "text", partitions: int | None = None) -> DataFrame:
    """``(word, n)`` over whitespace words (a frequent word is combined
    map-side before the shuffle). ``partitions``: spread the texts over that many
    tasks first, for an input that the scan can't split."""
    if partitions is not None:
        df = df.select(text).repartition(partitions)
    return df.select(F.explode(words(text)).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"))


def vocab_stats(tokens: DataFrame, vocab: DataFrame, ids_col: str = "tokens") -> DataFrame:
    """``(token_id, piece, n_bytes, n_occurrences, vocab_size, max_piece_bytes)`` of every
    piece of ``vocab`` (``token_id``, ``piece``); a piece that no row of ``tokens``
    holds occurs 0 times, ids that are no piece are left out. Bytes are those of the
    shown piece in UTF-8 (the space mark counts as one space)."""
    n_bytes = F.octet_length(F.replace("piece", F.lit(SPACE_MARK), F.lit(" "))).cast("bigint")
    pieces = vocab.select("token_id", "piece", n_bytes.alias("n_bytes"))
    # one row: the size of the vocabulary and its longest piece
    size, longest = pieces.agg(F.count(F.lit(1)), F.max("n_bytes")).first()
    used = tokens.select(F.explode(ids_col).alias("token_id")).groupBy("token_id").agg(F.count(F.lit(1)).alias("n"))
    return pieces.join(used, "token_id", "left").select(
        "token_id", "piece", "n_bytes", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_occurrences"),
        F.lit(size).cast("bigint").alias("vocab_size"), F.lit(longest).cast("bigint").alias("max_piece_bytes"))


_PAIR = 32                    # bits of a pair's right symbol


def _flat(batch):
    """Symbols of a batch of words one after the other, the words' ends, and
    the adjacent pairs: place of the left symbol, code, weight."""
    lists, n = batch.column(0), batch.column(1).to_numpy()
    flat = lists.flatten().to_numpy().astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    inner = np.ones(len(flat), bool)
    inner[(np.cumsum(sizes) - 1)[sizes > 0]] = False
    at = np.flatnonzero(inner)
    return flat, sizes, at, flat[at] << _PAIR | flat[at + 1], np.repeat(n, sizes)[at]


def _pair_counts(words_now: DataFrame, apart) -> DataFrame:
    """``(a, b, n)`` of the adjacent symbols; ``apart``: symbols never merged."""
    def run(batches):
        fixed = np.array(apart.value, bool)
        for batch in batches:
            _, _, _, code, n = _flat(batch)
            free = ~(fixed[code >> _PAIR] | fixed[code & ((1 << _PAIR) - 1)])
            pairs, at = np.unique(code[free], return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, at, n[free])
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(total)], names=["code", "n"])

    return words_now.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).select(
        F.shiftright("code", _PAIR).cast("int").alias("a"), F.col("code").bitwiseAND((1 << _PAIR) - 1).cast("int").alias("b"), "n")


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Lists of the given sizes over the values ``flat``."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def _member(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which of ``code`` are among the sorted ``codes``."""
    if not len(codes):
        return np.zeros(len(code), bool)
    return codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code


def _runs(flat: np.ndarray, joined: np.ndarray):
    """Runs of symbols that the places ``joined`` tie to their right neighbours:
    all their places, each run's symbols in bytes, and which of ``joined`` begin a run."""
    inside = np.zeros(len(flat), bool)
    inside[joined] = True
    inside[joined + 1] = True
    raw = flat[inside].astype(np.int32).tobytes()
    first = np.flatnonzero(np.diff(joined, prepend=-2) != 1)
    # a run of k ties has k + 1 symbols
    ends = (np.cumsum(np.diff(np.append(first, len(joined))) + 1) * 4).tolist()
    return inside, [raw[a:b] for a, b in zip([0, *ends], ends)], first


def _segments(words_now: DataFrame, active) -> DataFrame:
    """``(segment, n)``: runs of symbols that active pairs join, in bytes."""
    def run(batches):
        codes = np.array(active.value, np.int64)
        for batch in batches:
            flat, _, at, code, n = _flat(batch)
            hit = _member(codes, code)
            _, keys, first = _runs(flat, at[hit])
            found: dict[bytes, int] = {}
            for key, w in zip(keys, n[hit][first].tolist()):
                found[key] = found.get(key, 0) + w
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                                             names=["segment", "n"])

    return words_now.mapInArrow(run, "segment binary, n long").groupBy("segment").agg(F.sum("n").alias("n"))


def _merged(word: list[int], merges: dict) -> list[int]:
    """The word after merges ``(a, b) -> (rank, symbol)`` in the order of their ranks."""
    while len(word) > 1:
        best = min((merges[p] for p in zip(word, word[1:]) if p in merges), default=None)
        if best is None:
            break
        rank, symbol, a, b = best
        out, k = [], 0
        while k < len(word):
            if k + 1 < len(word) and word[k] == a and word[k + 1] == b:
                out.append(symbol)
                k += 2
            else:
                out.append(word[k])
                k += 1
        word = out
    return word


def _gaps(merges: list[tuple]) -> np.ndarray:
    """Codes of the adjacent symbols between which merges ``(a, b, symbol)`` can join
    anything: the last symbols that ``a`` can be made of before the first ones
    that ``b`` can be made of. Words never change across other gaps."""
    made: dict[int, list] = {}
    for a, b, symbol in merges:
        made.setdefault(symbol, []).append((a, b))

    def outer(symbol: int, side: int) -> set:
        found, todo = {symbol}, [symbol]
        while todo:
            for pair in made.get(todo.pop(), ()):
                if pair[side] not in found:
                    found.add(pair[side])
                    todo.append(pair[side])
        return found

    return np.array(sorted({x << _PAIR | y for a, b, _ in merges for x in outer(a, 1) for y in outer(b, 0)}), np.int64)


class _Memo(dict):
    """What ``make`` gives for a key, kept for a bounded number of keys."""

    def __init__(self, make, most: int = 200_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        got = self[key] = self.make(key)
        return got


def _apply(words_now: DataFrame, merges) -> DataFrame:
    """The word table after a round's merges ``(a, b, symbol)``, in order. Only runs
    of symbols that they can change are merged, equal ones once."""
    def run(batches):
        table = {(a, b): (rank, symbol, a, b) for rank, (a, b, symbol) in enumerate(merges.value)}
        gaps = _gaps(merges.value)

        def padded(key: bytes) -> bytes:
            old = np.frombuffer(key, np.int32).tolist()
            word = _merged(old, table)
            return np.array(word + [-1] * (len(old) - len(word)), np.int32).tobytes()

        memo = _Memo(padded)
        for batch in batches:
            flat, sizes, at, code, _ = _flat(batch)
            inside, keys, _ = _runs(flat, at[_member(gaps, code)])
            flat[inside] = np.frombuffer(b"".join(map(memo.__getitem__, keys)), np.int32)
            left = flat >= 0
            kept = np.r_[0, np.cumsum(left)]
            ends = np.r_[0, np.cumsum(sizes)]
            yield pa.RecordBatch.from_arrays([_lists(flat[left], np.diff(kept[ends])), batch.column(1)], names=["syms", "n"])

    return words_now.mapInArrow(run, "syms array<int>, n long")


class _Replay:
    """One-at-a-time BPE on weighted segments."""

    def __init__(self, segments: list[tuple[list[int], int]]):
        self.segments = [s for s, _ in segments]
        self.weight = [n for _, n in segments]
        self.count: dict[tuple, int] = {}
        self.where: dict[tuple, set] = {}
        for k in range(len(segments)):
            self._add(k, 1)
        self.heap = [(-n, max(p), p) for p, n in self.count.items()]
        heapq.heapify(self.heap)

    def _add(self, k: int, sign: int, changed: set | None = None) -> None:
        word, n = self.segments[k], sign * self.weight[k]
        for p in zip(word, word[1:]):
            self.count[p] = self.count.get(p, 0) + n
            if sign > 0:
                self.where.setdefault(p, set()).add(k)
            if changed is not None:
                changed.add(p)

    def best(self, above: int):
        """The most frequent pair, if its count is over ``above``; ties go to
        the pair whose newer symbol is the oldest, then to the smaller symbols."""
        while self.heap:
            n, newer, p = self.heap[0]
            if -n == self.count.get(p, 0):
                return p if -n > above else None
            heapq.heappop(self.heap)
        return None

    def merge(self, p: tuple, symbol: int) -> None:
        changed: set = set()
        for k in self.where.pop(p):
            self._add(k, -1, changed)
            self.segments[k] = _merged(self.segments[k], {p: (0, symbol, *p)})
            self._add(k, 1, changed)
        for c in changed:
            if self.count.get(c, 0) > 0:
                heapq.heappush(self.heap, (-self.count[c], max(c), c))
            else:
                self.count.pop(c, None)


def _independent(pairs: list[tuple]) -> list[tuple]:
    """The longest run of ranked pairs of which none begins where another, or
    itself, ends. None of them changes the count of another, and what they make is
    newer than all of them, so it loses every tie."""
    begins, ends, out = set(), set(), []
    for a, b in pairs:
        if a in ends or b in begins or (a == b and out):
            break
        begins.add(a)
        ends.add(b)
        out.append((a, b))
        if a == b:
            break
    return out


def train_bpe_vocab(spark: SparkSession, texts: DataFrame, n_merges: int,
                    text: str = "text", split_digits: bool = True,
                    pairs_per_round: int = 1024, segments_per_round: int = 50_000) -> DataFrame:
    """I4: vocabulary table ``(token_id, piece, score, n_bytes)`` of plain BPE:
    ``n_merges`` times (or until nothing is left to merge) the most frequent pair;
    ties go to the pair whose newer symbol is older (symbols count from the most
    frequent character), then to the smaller symbols. A pair whose piece is there
    already makes that piece. With ``split_digits`` digits (0-9) are never merged.
    ``pairs_per_round`` and ``segments_per_round`` bound what a round brings to the
    driver; they change the number of rounds, not the vocabulary."""
    ensure_checkpoint_dir(spark)
    wf = materialize(word_frequencies(texts, text).where("word is not null"), "bpe-words")
    mark = F.concat(F.lit(SPACE_MARK), "word")
    # characters: as many rows as the alphabet has
    base = sorted(wf.select(F.explode(F.regexp_extract_all(mark, F.lit("(?s)."), 0)).alias("c"), "n").groupBy("c").agg(
        F.sum("n").alias("n")).collect(), key=lambda r: (-r["n"], r["c"]))
    pieces = [r["c"] for r in base]
    symbol_of = {c: k for k, c in enumerate(pieces)}
    plain = spark.sparkContext.broadcast(dict(symbol_of))

    def split(batches):
        places = np.array(sorted(map(ord, plain.value)), np.uint32)
        symbols = np.array([plain.value[chr(c)] for c in places.tolist()], np.int32)
        for batch in batches:
            text = "".join(batch.column(0).to_pylist()).encode("utf-32-le")
            flat = symbols[np.searchsorted(places, np.frombuffer(text, np.uint32))]
            sizes = pc.utf8_length(batch.column(0)).to_numpy()
            yield pa.RecordBatch.from_arrays([_lists(flat, sizes), batch.column(1)], names=["syms", "n"])

    now = materialize(wf.select(mark.alias("word"), "n").mapInArrow(split, "syms array<int>, n long"), "bpe-state")
    discard(wf)
    merges: list[tuple[int, int, int]] = []
    most = pairs_per_round
    while len(merges) < n_merges:
        apart = [split_digits and any("0" <= c <= "9" for c in p) for p in pieces]
        ranked = _pair_counts(now, spark.sparkContext.broadcast(apart)).orderBy(
            F.desc("n"), F.greatest("a", "b"), "a", "b").limit(pairs_per_round + 1).collect()
        ranked = [((r["a"], r["b"]), r["n"]) for r in ranked]
        if not ranked:
            break
        done = len(merges)

        def merge(a, b):
            """Record a merge; whether its piece is new."""
            piece = pieces[a] + pieces[b]
            new = piece not in symbol_of
            if new:
                symbol_of[piece] = len(pieces)
                pieces.append(piece)
            merges.append((a, b, symbol_of[piece]))
            return new

        while len(merges) == done:
            below = ranked[most][1] if len(ranked) > most else 0    # with 0 pairs: all of the top are left
            active = [p for p, n in ranked[:most] if n > below]
            if not active or most == 0:
                tied = [p for p, n in ranked if n == ranked[0][1]]
                for a, b in _independent(tied)[:n_merges - done]:
                    if not merge(a, b):
                        break
                break
            codes = sorted(a << _PAIR | b for a, b in active)
            rows = _segments(now, spark.sparkContext.broadcast(codes)).limit(segments_per_round + 1).collect()
            if len(rows) > segments_per_round:
                most //= 4
                continue
            replay = _Replay([(np.frombuffer(r["segment"], np.int32).tolist(), r["n"]) for r in rows])
            while len(merges) < n_merges and (best := replay.best(below)) is not None:
                new = merge(*best)
                replay.merge(best, merges[-1][2])
                # the same piece by another way: its pairs may lie outside the segments
                if not new:
                    break
            if len(rows) < segments_per_round // 4:
                most = min(pairs_per_round, most * 2)
        most = max(most, 1)
        after = materialize(_apply(now, spark.sparkContext.broadcast(merges[done:])), "bpe-state")
        discard(now)
        now = after
    discard(now)
    rows = [(i, s, 0.0, len(s.encode())) for i, s in enumerate(SPECIALS)]
    rows += [(BYTE_OFFSET + v, f"<0x{v:02X}>", 0.0, 1) for v in range(256)]
    ordered = list(dict.fromkeys(pieces[symbol] for _, _, symbol in merges))
    ordered += [r["c"] for r in base]
    rows += [(BYTE_OFFSET + 256 + k, p, float(-(k + 1)), len(p.encode())) for k, p in enumerate(ordered)]
    return spark.createDataFrame(rows, VOCAB_SCHEMA)


class _Pieces:
    """Lookup of a vocabulary: id and score of each piece. Byte pieces have no
    text of their own, so nothing is ever merged across one."""

    @staticmethod
    def of(plain: dict) -> _Pieces:
        """The lookup that a worker builds once from the broadcast rows."""
        if "built" not in plain:
            plain["built"] = _Pieces(plain["rows"])
        return plain["built"]

    def __init__(self, rows):
        first = BYTE_OFFSET + 256
        self.entry = {p: (i, s) for i, p, s in rows if i >= first}
        self.ranked = not any(math.isnan(s) for _, s in self.entry.values())
        self._joins = None
        size = max([first - 1, *(i for i, _, _ in rows)]) + 1
        self.label = [b""] * size
        for i, piece, _ in rows:
            if i >= first:
                self.label[i] = piece.replace(SPACE_MARK, " ").encode()
        for v in range(256):
            self.label[BYTE_OFFSET + v] = bytes([v])

    def joins(self) -> _Joins:
        if self._joins is None:
            self._joins = _Joins(self)
        return self._joins


def _merged_ids(segment: str, pieces: _Pieces) -> list[int]:
    """BPE of one segment. Symbols are a linked list; a heap holds the joins
    that the vocabulary knows, best score first, then leftmost. A join whose ends
    have changed since it was pushed is stale and dropped when it comes up."""
    entry = pieces.entry
    texts: list[str | None] = []
    ids: list[int] = []
    for ch in segment:
        # a space is the space mark; a mark that stands in the text itself is bytes
        shown = SPACE_MARK if ch == " " else ch
        hit = None if ch == SPACE_MARK else entry.get(shown)
        if hit is None:
            raw = ch.encode("utf-8", "replace")
            texts += [None] * len(raw)
            ids += [b + BYTE_OFFSET for b in raw]
        else:
            texts.append(shown)
            ids.append(hit[0])
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple] = []

    def offer(left: int) -> None:
        right = after[left] if left >= 0 else n
        if right < n and texts[left] is not None and texts[right] is not None:
            joined = texts[left] + texts[right]
            hit = entry.get(joined)
            if hit is not None:
                heapq.heappush(heap, (-hit[1], left, right, joined, hit[0]))

    for k in range(n - 1):
        offer(k)
    while heap:
        _, left, right, joined, new_id = heapq.heappop(heap)
        if ids[left] < 0 or after[left] != right or texts[left] + texts[right] != joined:
            continue
        texts[left], ids[left], ids[right] = joined, new_id, -1
        after[left] = after[right]
        if after[left] < n:
            before[after[left]] = left
        offer(before[left])
        offer(left)
    return [i for i in ids if i >= 0]


_SHORT = 48                   # symbols up to which equally long segments are merged side by side
_NEVER = np.iinfo(np.int32).max
_CHUNK = 2_000_000            # characters of the texts that are split at once


class _Joins:
    """The pairs of pieces whose joined text is a piece, sorted by code, with the
    rank of its score and its id; and the pieces that are one character."""

    def __init__(self, pieces: _Pieces):
        entry = pieces.entry
        scores = np.array([score for _, score in entry.values()], float)
        rank = dict(zip(entry, np.unique(-scores, return_inverse=True)[1].tolist()))
        pairs = sorted((entry[p[:k]][0] << _PAIR | entry[p[k:]][0], rank[p], entry[p][0])
                       for p in entry for k in range(1, len(p)) if p[:k] in entry and p[k:] in entry)
        code, ranks, ids = zip(*pairs) if pairs else ((), (), ())
        self.code, self.rank, self.id = np.array(code, np.int64), np.array(ranks, np.int32), np.array(ids, np.int32)
        # a space is the space mark; a mark that stands in the text itself is bytes
        chars = sorted((ord(" ") if p == SPACE_MARK else ord(p), i) for p, (i, _) in entry.items() if len(p) == 1 and p != " ")
        self.char = np.array([c for c, _ in chars], np.int64)
        self.char_id = np.array([i for _, i in chars], np.int32)

    def symbols(self, segments: list[str]):
        """Ids of the characters, or of the bytes of those that are no piece, one
        segment after the other; how many each segment has."""
        points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).astype(np.int64)
        known = _member(self.char, points)
        widths = np.where(known, 1, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))
        ids = np.zeros(len(points), np.int32)
        ids[known] = self.char_id[np.searchsorted(self.char, points[known])]
        flat = np.repeat(ids, widths)
        raw = "".join(map(chr, points[~known].tolist())).encode()
        flat[np.repeat(~known, widths)] = np.frombuffer(raw, np.uint8).astype(np.int32) + BYTE_OFFSET
        starts = np.cumsum([0, *map(len, segments)])[:-1]
        return flat, np.add.reduceat(widths, starts)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left.astype(np.int64) << _PAIR | right
        hit = _member(self.code, code.ravel()).reshape(code.shape)
        out = np.full(code.shape, _NEVER, np.int32)
        out[hit] = self.rank[np.searchsorted(self.code, code[hit])]
        return out

    def merged(self, rows: np.ndarray):
        """``(numbers of rows, their ids)`` of segments with equally many symbols: in
        every step each row makes its best join, the leftmost of the best."""
        at = np.arange(len(rows))
        ranks = self.ranks(rows[:, :-1], rows[:, 1:])
        while rows.shape[1] > 1 and len(rows):
            k = ranks.argmin(axis=1)
            go = ranks[np.arange(len(rows)), k] != _NEVER
            yield at[~go], rows[~go]
            at, rows, ranks, k = at[go], rows[go], ranks[go], k[go]
            each = np.arange(len(rows))
            joined = self.id[np.searchsorted(self.code, rows[each, k].astype(np.int64) << _PAIR | rows[each, k + 1])]
            place = np.arange(rows.shape[1] - 1)[None, :]
            rows = np.take_along_axis(rows, place + (place > k[:, None]), 1)
            rows[each, k] = joined
            place = place[:, :-1]
            ranks = np.take_along_axis(ranks, place + (place >= k[:, None]), 1)
            for near in (k - 1, k):
                some = np.flatnonzero((near >= 0) & (near < ranks.shape[1]))
                ranks[some, near[some]] = self.ranks(rows[some, near[some]], rows[some, near[some] + 1])
        yield at, rows


def _encoded(segments: list[str], pieces: _Pieces) -> dict[str, bytes]:
    """The ids of each segment, as the bytes of 32-bit numbers; what ``_merged_ids``
    gives, for short segments many at a time."""
    if not segments:
        return {}
    if not pieces.ranked:
        return {x: np.array(_merged_ids(x, pieces), np.int32).tobytes() for x in segments}
    flat, sizes = pieces.joins().symbols(segments)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    out: dict[str, bytes] = {}
    for same in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        size = int(sizes[same[0]])
        if size > _SHORT:
            out.update((segments[k], np.array(_merged_ids(segments[k], pieces), np.int32).tobytes()) for k in same.tolist())
            continue
        for at, rows in pieces.joins().merged(flat[starts[same][:, None] + np.arange(size)]):
            raw, step = rows.astype(np.int32).tobytes(), 4 * rows.shape[1]
            out.update((segments[k], raw[step * i:step * (i + 1)]) for i, k in enumerate(same[at].tolist()))
    return out


# A space, then what is not white space; other white space stands alone. Pieces
# never cross these segments.
_SEGMENT = re.compile(r" ?\S+|\s")


def _piece_table(vocab: DataFrame) -> dict:
    """The vocabulary on the driver as plain rows: a model table, whose size is
    that of the model, not of the corpus."""
    return {"rows": [(int(r[0]), r[1], float(r[2])) for r in vocab.select("token_id", "piece", "score").collect()]}


def encode_texts(spark: SparkSession, docs: DataFrame, vocab: DataFrame, key: str = "doc_id",
                 text: str = "text", add_bos: bool = True) -> DataFrame:
    """``(key, ids)`` of every row, in one Arrow pass without a shuffle: the
    vocabulary is broadcast and each task keeps a bounded memo of segments. All
    white space is kept and characters outside the vocabulary become their bytes,
    so ``decode_tokens`` gives the text back exactly. Null texts are empty; rows
    with equal keys stay apart."""
    plain = spark.sparkContext.broadcast(_piece_table(vocab))
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>"

    def run(batches):
        pieces = _Pieces.of(plain.value)
        memo: dict[str, bytes] = {}
        begin = np.array([1] if add_bos else [], np.int32).tobytes()

        def encoded(texts):
            """The rows of some texts; a chunk of them has its new segments merged at once."""
            if len(memo) > 200_000:
                memo.clear()
            split = [_SEGMENT.findall(" " + value) if value else () for value in texts]
            memo.update(_encoded(list({x for found in split for x in found if x not in memo}), pieces))
            return [begin + b"".join(map(memo.__getitem__, found)) for found in split]

        for batch in batches:
            rows, chunk, size = [], [], 0
            for value in batch.column(1).to_pylist():
                chunk.append(value)
                size += len(value or "")
                if size > _CHUNK:
                    rows += encoded(chunk)
                    chunk, size = [], 0
            rows += encoded(chunk)
            ids = _lists(np.frombuffer(b"".join(rows), np.int32), np.fromiter(map(len, rows), np.int64, len(rows)) // 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, schema)


def decode_tokens(tokens: DataFrame, vocab: DataFrame, ids_col: str = "ids",
                  strip_pad: bool = True, out: str = "text") -> DataFrame:
    """Ids -> text. Byte pieces become raw bytes, the space mark a space,
    one leading space (the dummy prefix) is removed, specials are dropped;
    with ``strip_pad`` the pad/unknown id 0 is dropped instead of decoded. Bytes
    that are no UTF-8 (a cut sequence) become U+FFFD. Unknown ids are dropped."""
    plain = tokens.sparkSession.sparkContext.broadcast(_piece_table(vocab))
    kept = [c for c in tokens.columns if c.lower() != out.lower()]
    schema = T.StructType([tokens.schema[c] for c in kept] + [T.StructField(out, T.StringType())])
    at = tokens.columns.index(ids_col)

    def run(batches):
        label = list(_Pieces.of(plain.value).label)
        if not strip_pad:
            label[0] = " \u2047 ".encode()
        size = len(label)
        labels = pa.array([*label, b""], pa.large_binary())     # the last one is that of an unknown id
        for batch in batches:
            lists = batch.column(at)
            ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
            ends = np.zeros(len(lists) + 1, np.int64)
            np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), out=ends[1:])
            shown = labels.take(pa.array(np.where((ids >= 0) & (ids < size), ids, size).astype(np.int64)))
            joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), shown), pa.scalar(b"", pa.large_binary()))
            texts = [None if none else b.decode("utf-8", "replace").removeprefix(" ")
                     for none, b in zip(lists.is_null().to_pylist(), joined.to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(texts, pa.string())], names=schema.names)

    return tokens.mapInArrow(run, schema)
