"""Per-row text functions as native Spark column expressions.

Everything here is a ``Column`` builder: no Python runs per row, the work stays
inside the JVM and is distributed with the scan.
"""

from __future__ import annotations

import re
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Python's ``str.split()`` whitespace set (the characters of ``str.isspace``):
# tab, newline, vertical tab, form feed, carriage return, space, the four
# information separators 1C-1F, NEL 85, no-break space A0, ogham space 1680,
# the spaces 2000-200A, line and paragraph separators 2028-2029, narrow no-break
# space 202F, medium math space 205F and ideographic space 3000. Written so the
# same pattern runs in Java regex and in RE2.
WS_CHARS = (r"\t\n\x0B\f\r \x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS_RUN = f"[{WS_CHARS}]+"
# The same whitespace set as literal characters (for ``translate``).
WS_LIST = ("\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680"
           + "".join(chr(c) for c in range(0x2000, 0x200B))
           + "\u2028\u2029\u202f\u205f\u3000")
NON_WS_RUN = f"[^{WS_CHARS}]+"
# A "word character" as in a Unicode ``\w``: letters, numbers, underscore.
WORD_CHAR_RUN = r"[\p{L}\p{N}_]+"
# Default flagged terms.
DEFAULT_FLAGGED_TERMS = ("prison", "hate")
# Sentence terminators for readability.
SENTENCE_END = r"[.!?]+"
# ASCII control characters that are not whitespace.
UNPRINTABLE = r"[\x00-\x08\x0E-\x1F\x7F]"
# Joins the words of a text for text-level rewriting: words never contain
# whitespace, so one ASCII space separates them unambiguously (and keeps
# ASCII texts on Spark's fast ASCII paths).
WORD_SEP = " "
# Checkpoint file name pattern: the number between ``ckpt_`` and ``.pt``.
CHECKPOINT_NAME = r"ckpt_(.*?)\.pt"
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, build) -> Column:
    """``build(value)`` with ``value`` computed once per row, however often ``build``
    uses it. Catalyst shares no subexpressions inside or across higher-order
    functions, so a nested builder would otherwise repeat its input at each use."""
    return F.element_at(F.transform(F.array(value), build), 1)


def words(text) -> Column:
    """Whitespace tokens, no empty strings; null or empty text gives ``[]``
    (Python ``str.split()``). Whitespace is mapped to a space with
    ``translate`` and runs collapsed, then split on the space."""
    return bound(joined_words(text), split_joined)


def words_regex(text) -> Column:
    """The same tokens by a regex split (kept as a cross-check)."""
    t = _col(text)
    return F.coalesce(F.filter(F.split(t, WS_RUN), lambda w: w != F.lit("")),
                      F.array().cast("array<string>"))


def joined_words(text) -> Column:
    """The text with its ends stripped and every whitespace run replaced by
    ``WORD_SEP``: a per-word rewrite can then run as one regex over the text
    instead of one regex call per word."""
    spaced = F.translate(F.coalesce(_col(text), F.lit("")), WS_LIST, " " * len(WS_LIST))
    return F.regexp_replace(F.trim(spaced), " {2,}", WORD_SEP)


def split_joined(joined: Column) -> Column:
    """Inverse of ``joined_words``: one element per word, in order."""
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(
        F.split(joined, WORD_SEP))


def word_count(text) -> Column:
    return F.size(words(text)).cast("bigint")


def strip(text) -> Column:
    """Trim the full Unicode whitespace set from both ends (Spark ``trim``
    removes spaces only)."""
    return F.regexp_replace(_col(text), f"^{WS_RUN}|{WS_RUN}$", "")


def vocabulary_diversity(text) -> Column:
    """distinct words / words, 0.0 when there are no words (case-sensitive)."""
    return bound(words(text), lambda w: F.when(
        F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(F.lit(0.0)))


def _phrase_pattern(terms: list[str]) -> str:
    """A case-insensitive alternation of ``terms`` between word boundaries. A
    boundary stands between a word character and what is none, so what must be
    next to a term depends on its own first and last character."""
    def bounded(term: str) -> str:
        first, last = (re.match(r"\w", c) is not None for c in (term[0], term[-1]))
        before = r"(?<![\p{L}\p{N}_])" if first else r"(?<=[\p{L}\p{N}_])"
        after = r"(?![\p{L}\p{N}_])" if last else r"(?=[\p{L}\p{N}_])"
        return before + re.sub(r"([^\w\s])", r"\\\1", term) + after
    return "(?iu)(?:" + "|".join(bounded(t) for t in terms) + ")"


def flagged_term_count(text, terms: Iterable[str] = DEFAULT_FLAGGED_TERMS) -> Column:
    """Number of whole-word, case-insensitive occurrences of ``terms``, which
    may be phrases or hold hyphens and other marks. Occurrences don't overlap: at
    each place the first term of the list that fits counts, as in an alternation.
    Empty terms are left out.

    A whole-word match of a term made of word characters is exactly a maximal
    run of word characters equal to the term, so where all terms are such, the runs
    are extracted once and tested for membership, whatever the number of terms;
    otherwise the text is matched with the alternation.
    """
    listed = [t for t in dict.fromkeys(t.lower() for t in terms) if t]
    source = F.coalesce(_col(text), F.lit(""))
    if any(not re.fullmatch(r"\w+", t) for t in listed):
        return F.regexp_count(source, F.lit(_phrase_pattern(listed))).cast("bigint")
    term_arr = F.array(*[F.lit(t) for t in sorted(listed)]).cast("array<string>")
    runs = F.regexp_extract_all(source, F.lit(WORD_CHAR_RUN), 0)
    return F.size(F.filter(runs, lambda r: F.array_contains(term_arr, F.lower(r)))).cast("bigint")


def profanity_check(text, terms: Iterable[str] = DEFAULT_FLAGGED_TERMS) -> Column:
    """flagged-term matches / words, 0.0 when there are no words."""
    return bound(F.size(words(text)), lambda n: F.when(
        n > 0, flagged_term_count(text, terms) / n).otherwise(F.lit(0.0)))


def create_global_id(shard, idx) -> Column:
    """``"{shard}_{idx}"`` string id."""
    return F.concat_ws("_", _col(shard).cast("string"), _col(idx).cast("string"))


def checkpoint_number(name) -> Column:
    """Integer between ``ckpt_`` and ``.pt``; null when absent or not a number."""
    raw = F.regexp_extract(_col(name), CHECKPOINT_NAME, 1)
    return F.when(_col(name).rlike(CHECKPOINT_NAME), raw.try_cast("int"))


def strip_unprintable(text) -> Column:
    """Remove ASCII control characters that are not whitespace."""
    return F.regexp_replace(_col(text), UNPRINTABLE, "")
