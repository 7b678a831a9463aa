"""Operator 1, BPE encoding and decoding by a merge automaton.

Every merge ``(a, b) -> ab`` is a two-state gadget: it holds back an ``a`` it
reads; a ``b`` after it leaves as ``ab``, anything else lets the held ``a`` go
first. The merges in rank order are a cascade of gadgets, each reading what the
one before emits; applying the merges to a word one rank after another is what
BPE does when no merge makes a symbol that an earlier one reads, which
``Vocabulary`` checks. The cascade is one deterministic transducer over bytes:
its state is the list of held symbols, its arcs carry token ids. ``Automaton``
builds that product a gadget at a time along the arcs that texts really take and
keeps them in a table, so each further word is a walk through the table. Held
symbols lie at falling ranks, so an arc goes straight to the
gadgets that hold, take or join a symbol, found by binary search; held symbols
that nothing after them can join any more leave at once, which keeps states few.

Decoding emits the byte label of each id and reads the bytes as UTF-8, bad
sequences as U+FFFD.

Nulls and empty texts have no ids and decode to the empty text; unknown and null
ids in a list are left out. Rows are independent: repeated rows and extra
columns stay, and an existing column with the output's name is replaced. An
empty table gives an empty table. No row is cut, whatever its length.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from curio.llm.common import list_array, ship, sliced, texts_of, with_fields

ship(__name__)

# The byte-level pre-split of the published vocabulary.
PRESPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space by Unicode; the regex module's own class also has U+001C to U+001F.
UNICODE_SPACE = r"\t-\r \x85\xa0  -     　"
# The same rule for texts that hold ASCII only.
PRESPLIT_ASCII = (r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+"
                  r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files:
    printable Latin-1 characters stand for themselves, the other bytes for
    code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read(path: str) -> dict:
    """Ids, byte labels and merges of a byte-level BPE file (JSON), as plain
    data that can be broadcast to workers without this package."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    ids = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    labels = {i: bytes(alphabet[c] for c in t) for t, i in ids.items() if t not in special}
    return {"special": special, "labels": labels | {i: t.encode() for t, i in special.items()},
            "byte_ids": [ids[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])],
            "merges": [(ids[a], ids[b], ids[a + b]) for a, b in pairs]}


class Vocabulary:
    """A vocabulary file or what ``read`` made of it."""

    def __init__(self, source: str | dict):
        plain = read(source) if isinstance(source, str) else source
        self.special, self.labels = plain["special"], plain["labels"]
        self.byte_ids, self.merges = plain["byte_ids"], plain["merges"]
        self.encoders: dict[bool, Encoder] = {}
        made: dict[int, int] = {}
        for rank, (a, b, ab) in enumerate(self.merges):
            if max(made.get(a, -1), made.get(b, -1)) >= rank or ab in made:
                raise ValueError("a merge reads a symbol that a later merge makes")
            made[ab] = rank
        reads, single = {x for a, b, _ in self.merges for x in (a, b)}, set(self.byte_ids)
        if any(x not in made and x not in single for x in reads):
            raise ValueError("a merge reads a symbol that nothing makes")

    @staticmethod
    def of(plain: dict) -> Vocabulary:
        """The vocabulary that a worker builds once and keeps with its copy of
        the broadcast data, so that its tables serve all tasks of that worker."""
        if "built" not in plain:
            plain["built"] = Vocabulary(plain)
        return plain["built"]


class Automaton:
    """The composed gadgets as a transition table, filled on demand. Tables
    are emptied at their limits (states, arcs, words; at most some 300 MB a worker
    together); results don't depend on what they hold."""

    def __init__(self, vocab: Vocabulary, max_states: int = 200_000, max_words: int = 500_000, max_arcs: int = 400_000):
        self.vocab, self.max_states, self.max_words, self.max_arcs = vocab, max_states, max_words, max_arcs
        self.ranks: dict[int, list[int]] = {}
        for rank, (a, _, _) in enumerate(vocab.merges):
            self.ranks.setdefault(a, []).append(rank)
        self.pairs = {(a, b): rank for rank, (a, b, _) in enumerate(vocab.merges)}
        self.end = len(vocab.merges)
        # the last gadget that could join a symbol with one that begins with the other
        left = {ab: a for a, _, ab in vocab.merges}
        self.right = {ab: b for _, b, ab in vocab.merges}
        self.last_join: dict[tuple[int, int], int] = {}
        for rank, (a, b, _) in enumerate(vocab.merges):
            while b is not None:
                self.last_join[a, b] = rank
                b = left.get(b)
        self.words: dict[str, tuple[int, ...]] = {}
        self._empty()

    def _empty(self) -> None:
        self.state_of: dict[tuple, int] = {(): 0}
        self.held: list[tuple] = [()]
        self.arcs: dict[int, tuple[int, tuple]] = {}
        self.final: list[tuple | None] = [()]

    def _taker(self, symbol: int, rank: int) -> int:
        """The first gadget from ``rank`` on that would hold the symbol."""
        takes = self.ranks.get(symbol, ())
        at = bisect_left(takes, rank)
        return takes[at] if at < len(takes) else self.end

    def _flow(self, held: list, symbol: int, rank: int, out: list) -> None:
        """Let a symbol into the gadgets from ``rank`` on. ``held``: (rank,
        symbol) that gadgets hold back, the earliest text first. A symbol on its
        way drives the one before it through all gadgets that it passes, so both
        go straight to the next gadget that changes something: the one that joins
        them, or the one that holds the second."""
        while True:
            stop = self._taker(symbol, rank)
            if not held:
                if stop == self.end:
                    out.append(symbol)
                else:
                    held.append((stop, symbol))
                return
            at, before = held[-1]
            if at > stop:
                held.append((stop, symbol))
                return
            join = self.pairs.get((before, symbol), -1)
            if at == join:
                held.pop()
                symbol, rank = self.vocab.merges[join][2], join + 1
            else:
                held.pop()
                self._flow(held, before, join if at < join <= stop else stop + (before == symbol), out)

    def _state(self, held: list) -> int:
        key = tuple(held)
        state = self.state_of.get(key)
        if state is None:
            state = self.state_of[key] = len(self.held)
            self.held.append(key)
            self.final.append(None)
        return state

    def _arc(self, state: int, byte: int) -> tuple[int, tuple]:
        held, out = list(self.held[state]), []
        self._flow(held, self.vocab.byte_ids[byte], 0, out)
        for k in range(len(held) - 1, 0, -1):
            done = self._settled(held, k)
            if done is not None:
                out += done
                held = held[k:]
                break
        arc = self.arcs[state << 8 | byte] = (self._state(held), tuple(out))
        return arc

    def _flush(self, held: list) -> list:
        """What leaves when nothing follows."""
        held, out = list(held), []
        while held:
            self._flow(held, held.pop()[1], self.end, out)
        return out

    def _settled(self, held: list, k: int) -> list | None:
        """What the first ``k`` held symbols become, if no later gadget can
        join across their end whatever follows; else None. Left of the end
        stands the k-th symbol or one that grows from it to the left."""
        rank, symbol = held[k - 1]
        follower = held[k][1]
        if self.last_join.get((symbol, follower), -1) >= rank:
            return None
        out = self._flush(held[:k])
        last = out[-1]
        while last != symbol:
            if self.last_join.get((last, follower), -1) >= rank:
                return None
            last = self.right[last]
        return out

    def _end(self, state: int) -> tuple:
        self.final[state] = tuple(self._flush(self.held[state]))
        return self.final[state]

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-split word: a walk through the table."""
        state, out, arcs = 0, [], self.arcs
        for byte in word.encode("utf-8", "replace"):
            arc = arcs.get(state << 8 | byte) or self._arc(state, byte)
            state = arc[0]
            if arc[1]:
                out += arc[1]
        last = self.final[state]
        out += self._end(state) if last is None else last
        if len(self.held) > self.max_states or len(self.arcs) > self.max_arcs:
            self._empty()
        return tuple(out)


class Encoder:
    def __init__(self, vocab: Vocabulary, special: bool = True):
        self.automaton = Automaton(vocab)
        self.split = regex.compile(PRESPLIT.replace(r"[^\s", f"[^{UNICODE_SPACE}").replace(
            r"(?!\S)", f"(?![^{UNICODE_SPACE}])").replace(r"\s", f"[{UNICODE_SPACE}]")).findall
        self.split_ascii = re.compile(PRESPLIT_ASCII).findall
        self.special = vocab.special if special else {}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(
            self.special, key=len, reverse=True)) + ")").split if self.special else None

    def plain(self, text: str) -> np.ndarray:
        words, known = (self.split_ascii if text.isascii() else self.split)(text), self.automaton.words
        ids = list(map(known.get, words))
        if not all(ids):
            word, most = self.automaton.word, self.automaton.max_words
            for k, w in enumerate(words):
                if ids[k] is None:
                    ids[k] = known.get(w) or word(w)
                    if len(w) <= 64:
                        if len(known) >= most:
                            known.clear()
                        known[w] = ids[k]
        return np.fromiter(chain.from_iterable(ids), np.int32)

    def __call__(self, text: str) -> np.ndarray:
        if not self.cut or not any(t in text for t in self.special):
            return self.plain(text)
        return np.concatenate([np.array([self.special[p]], np.int32) if p in self.special else self.plain(p)
                               for p in self.cut(text)])

    @staticmethod
    def of(vocab: Vocabulary, special: bool) -> Encoder:
        """The vocabulary's encoder, made once."""
        if special not in vocab.encoders:
            vocab.encoders[special] = Encoder(vocab, special)
        return vocab.encoders[special]


class Decoder:
    def __init__(self, vocab: Vocabulary):
        size = max(vocab.labels) + 1
        labels = [vocab.labels.get(i, b"") for i in range(size)]
        self.size = size
        self.bytes = np.frombuffer(b"".join(labels) or b"\0", np.uint8)
        self.length = np.fromiter(map(len, labels), np.int64, size)
        self.start = np.cumsum(self.length) - self.length

    def labels(self, ids: np.ndarray) -> bytes:
        """Labels of the arcs, one after the other."""
        ids = ids[(ids >= 0) & (ids < self.size)]
        n = self.length[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.start[ids] - (ends - n), n)
        at += np.arange(len(at))
        return self.bytes[at].tobytes()

    def __call__(self, ids: np.ndarray) -> str:
        return self.labels(ids).decode("utf-8", "replace")


def _encoded(encoder: Encoder, texts: pa.Array) -> pa.Array:
    return list_array([encoder(t) for t in texts_of(texts)], pa.int32())


def _decoded(decoder: Decoder, lists: pa.Array) -> pa.Array:
    flat = lists.values.fill_null(-1).to_numpy(zero_copy_only=False)
    ends, valid = lists.offsets.to_numpy(), lists.is_valid().to_pylist()
    return pa.array([decoder(flat[ends[i]:ends[i + 1]]) if valid[i] else "" for i in range(len(lists))], pa.string())


def _mapped(df: DataFrame, vocab_path: str, source: str, new: list[T.StructField], make) -> DataFrame:
    """``df`` with columns that ``make(vocabulary)`` gives a function for. The
    vocabulary file (a few MB, its size known) is read on the driver and broadcast
    as plain data."""
    plain = df.sparkSession.sparkContext.broadcast(read(vocab_path))
    schema = with_fields(df, new)
    keep, at = schema.names[:-len(new)], df.columns.index(source)

    def run(batches):
        columns = make(Vocabulary.of(plain.value))
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + columns(batch.column(at)), names=schema.names)

    return df.mapInArrow(run, schema)


def _ids_field(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.IntegerType(), False), False)


def encode(df: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "ids",
           special: bool = True) -> DataFrame:
    """``df`` with the token ids of every whole text as ``ids_col`` (array of
    int). ``special``: the vocabulary's special strings in a text are their own
    ids; otherwise they are ordinary text."""
    def make(vocab):
        encoder = Encoder.of(vocab, special)
        return lambda texts: [_encoded(encoder, texts)]

    return _mapped(df, vocab_path, text_col, [_ids_field(ids_col)], make)


def decode(df: DataFrame, vocab_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids_col`` as ``text_col``."""
    def make(vocab):
        decoder = Decoder(vocab)
        return lambda lists: [_decoded(decoder, lists)]

    return _mapped(df, vocab_path, ids_col, [T.StructField(text_col, T.StringType(), False)], make)


def encode_decode(df: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "ids",
                  decoded_col: str = "decoded", special: bool = True) -> DataFrame:
    """``encode`` and then ``decode`` of its ids, in one pass and by one worker,
    so that the vocabulary and the tables are held once."""
    def make(vocab):
        encoder, decoder = Encoder.of(vocab, special), Decoder(vocab)

        def both(texts):
            ids = _encoded(encoder, texts)
            return [ids, _decoded(decoder, ids)]
        return both

    return _mapped(df, vocab_path, text_col, [_ids_field(ids_col), T.StructField(decoded_col, T.StringType(), False)], make)
