"""Readability grades as native column expressions.

Syllables come from a vowel-group rule, or in ``score_texts`` from a caller's
hyphenation patterns (``functions.hyphenation``). The rule: on the lower-cased word with non-letters
removed, ``syl = max(1, #vowel groups - silent final e)``; a word without
letters has 0 syllables. Sentences are the chunks between runs of ``.!?``
that hold more than two words, at least one per text.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from curio.functions.text import (WORD_SEP, WS_LIST, bound, joined_words, split_joined, words,
                                  _col)

# --- fixed values -----------------------------------------------------------
# Flesch-Kincaid grade: 0.39 * words/sentences + 11.8 * syllables/words - 15.59
FK_WORDS_PER_SENTENCE = 0.39
FK_SYLLABLES_PER_WORD = 11.8
FK_OFFSET = 15.59
# Gunning fog: 0.4 * (words/sentences + 100 * difficult/words)
FOG_FACTOR = 0.4
FOG_DIFFICULT_SYLLABLES = 3
VOWEL_GROUP = "[aeiouy]+"
SILENT_E = "[^aeiouyl]e$"
# The parts of a word of letters, one of: a whole word without a counted vowel group
# (consonants, perhaps with a silent e), a silent e, a vowel group, consonants. What
# counts as a syllable has one letter in a capture group.
SYLLABLE_PARTS = ("(?<![^ ])([^aeiouy ])[^aeiouy ]*+(?:(?<!l)e)?+(?![^ ])|(?<=[^aeiouyl ])e(?![^ ])"
                  "|([aeiouy])[aeiouy]*+|[^aeiouy ]++")
NON_LETTER = "[^a-z]"
# Stands for a sentence terminator in the text-level sentence count; it is
# itself a whitespace character, which the same ``translate`` maps to a space,
# so after the mapping it can only come from a terminator.
SENTENCE_MARK = "\x1c"
# ---------------------------------------------------------------------------


def letters_joined(joined: Column) -> Column:
    """``joined_words`` text lower-cased with everything but a-z removed:
    word i of the result is ``letters(word i)``."""
    return F.regexp_replace(F.lower(joined), f"[^a-z{WORD_SEP}]+", "")


def syllable_marks_joined(lj: Column) -> Column:
    """From ``letters_joined``: word i becomes one letter per syllable, so its
    length is its syllable count, in one pass of ``SYLLABLE_PARTS``. A silent final
    e (after a consonant other than l) is no vowel group; a word with letters but no
    counted vowel group becomes a single letter (at least one syllable); a word
    without letters stays empty (0 syllables)."""
    return F.regexp_replace(lj, SYLLABLE_PARTS, "$1$2")


def syllable_total_joined(marks: Column) -> Column:
    """Total syllables of a text from ``syllable_marks_joined``."""
    return F.length(F.replace(marks, F.lit(WORD_SEP), F.lit(""))).cast("bigint")


def syllable_array(marks: Column) -> Column:
    """Syllables per word from ``syllable_marks_joined``."""
    return F.transform(split_joined(marks), F.length)


def syllable_sum(counts: Column) -> Column:
    """Total of an array of syllable counts."""
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, n: a + n)


def _hard_words_of(joined: Column, easy_words: Iterable[str]) -> Column:
    return bound(letters_joined(joined), lambda lj: hard_word_count(
        split_joined(lj), bound(syllable_marks_joined(lj), syllable_array), easy_words))


def letters(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), NON_LETTER, "")


def syllables_of_letters(lw: Column) -> Column:
    """Syllables of an already lower-cased, letters-only word."""
    groups = F.regexp_count(lw, F.lit(VOWEL_GROUP))
    silent = F.when(lw.rlike(SILENT_E), 1).otherwise(0)
    return F.when(lw == "", F.lit(0)).otherwise(F.greatest(F.lit(1), groups - silent))


def syllables(word) -> Column:
    return syllables_of_letters(letters(_col(word)))


def syllable_total(text) -> Column:
    return syllable_total_joined(syllable_marks_joined(letters_joined(joined_words(text))))


def sentence_count(text) -> Column:
    """Chunks between runs of ``.!?`` holding more than two words, at least 1.
    Text-level: whitespace becomes a space and each terminator a mark (one
    ``translate``, no regex), every word run one ``w``, spaces are dropped --
    a chunk's length is its word count (consecutive marks give empty chunks,
    which never count)."""
    t = F.translate(F.coalesce(_col(text), F.lit("")), WS_LIST + ".!?",
                    " " * len(WS_LIST) + SENTENCE_MARK * 3)
    t = F.regexp_replace(t, f"[^ {SENTENCE_MARK}]+", "w")
    t = F.replace(t, F.lit(" "), F.lit(""))
    n = F.size(F.filter(F.split(t, SENTENCE_MARK), lambda c: F.length(c) > 2))
    return F.greatest(F.lit(1), n).cast("bigint")


def difficult_words(text, easy_words: Iterable[str] = ()) -> Column:
    """Distinct lower-cased words with at least 3 syllables, not in ``easy_words``."""
    return _hard_words_of(joined_words(text), easy_words)


def hard_word_count(lw: Column, syl: Column, easy_words: Iterable[str] = ()) -> Column:
    """Distinct letters-words with at least 3 syllables, not easy. ``lw`` and
    ``syl`` are per-word arrays of equal length."""
    easy = sorted({e.lower() for e in easy_words})
    easy_arr = F.array(*[F.lit(e) for e in easy]).cast("array<string>")
    hard = F.zip_with(lw, syl, lambda a, n: F.when(
        (n >= FOG_DIFFICULT_SYLLABLES) & ~F.array_contains(easy_arr, a), a))
    return F.size(F.array_distinct(F.filter(hard, lambda x: x.isNotNull()))).cast("bigint")


def flesch_kincaid_grade(text, round_outputs: bool = False) -> Column:
    def grade(joined: Column) -> Column:
        total = syllable_total_joined(syllable_marks_joined(letters_joined(joined)))
        return bound(F.size(split_joined(joined)), lambda n: F.when(
            n > 0, F.lit(FK_WORDS_PER_SENTENCE) * n / sentence_count(text)
            + F.lit(FK_SYLLABLES_PER_WORD) * total / n - F.lit(FK_OFFSET)).otherwise(F.lit(0.0)))

    out = bound(joined_words(text), grade)
    return F.round(out, 1) if round_outputs else out


def gunning_fog(text, easy_words: Iterable[str] = (), round_outputs: bool = False) -> Column:
    def grade(joined: Column) -> Column:
        return bound(F.size(split_joined(joined)), lambda n: F.when(
            n > 0, F.lit(FOG_FACTOR) * (n / sentence_count(text) + F.lit(100.0) * _hard_words_of(joined, easy_words) / n))
            .otherwise(F.lit(0.0)))

    out = bound(joined_words(text), grade)
    return F.round(out, 2) if round_outputs else out
