"""Syllables by pattern hyphenation (competing patterns).

A pattern is a run of letters with digits between them, ``.`` at either end standing
for the end of a word: ``1na`` asks for a break before ``na``, ``n2at`` forbids one after
``n`` there, as its level is higher. Of all patterns that fit at a place the highest level
wins; a word may break where that level is odd, but not within ``left`` letters of its start
or ``right`` letters of its end. It has one syllable more than breaks.

The patterns are the caller's (those of a dictionary file, some thousands); they become one
trie. Words are counted in Arrow batches without a shuffle, each distinct word of a batch once.
"""

from __future__ import annotations

import re
import sys
from typing import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEVELS = ""  # the key of a trie node that holds the levels of a pattern ending there


def pattern_trie(patterns: Iterable[str]) -> dict:
    """Nested dicts by letter. A pattern listed twice with other levels has the
    higher one at each place; empty patterns are left out."""
    root: dict = {}
    for pattern in patterns:
        letters = re.sub(r"\d", "", pattern.lower())
        if not letters:
            continue
        levels = [int(d or 0) for d in re.split(r"\D", re.sub(r"(?<=\d)\d+", "", pattern))]
        node = root
        for letter in letters:
            node = node.setdefault(letter, {})
        node[LEVELS] = list(map(max, levels, node.get(LEVELS, levels)))
    return root


def breaks(word: str, trie: dict, left: int = 2, right: int = 2) -> list[int]:
    """Places (letters before the break) at which ``word`` may break."""
    dotted = f".{word}."
    best = [0] * (len(dotted) + 1)
    for start in range(len(dotted)):
        node = trie
        for letter in dotted[start:]:
            node = node.get(letter)
            if node is None:
                break
            for at, level in enumerate(node.get(LEVELS, ())):
                if level > best[start + at]:
                    best[start + at] = level
    return [at for at in range(max(left, 1), len(word) - max(right, 1) + 1) if best[at + 1] % 2]


def syllable_counter(patterns: Iterable[str], left: int = 2, right: int = 2):
    """A function from an array column of lower-case words to their syllables
    (``array<int>``, same length): 0 for the empty word, else at least 1. A null
    array gives null."""
    listed = sorted(set(patterns))

    @F.pandas_udf("array<int>")
    def counted(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = pattern_trie(listed)
        for batch in arrays:
            known = {"": 0}
            out = []
            for words in batch:
                if words is None:
                    out.append(None)
                    continue
                counts = np.empty(len(words), np.int32)
                for i, word in enumerate(words):
                    n = known.get(word)
                    if n is None:
                        n = known[word] = 1 + len(breaks(word, trie, left, right))
                    counts[i] = n
                out.append(counts)
            yield pd.Series(out, dtype=object)

    def counter(words: Column) -> Column:
        return counted(words)

    return counter
