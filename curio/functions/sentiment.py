"""Lexicon sentiment (polarity, subjectivity) as per-row expressions.

A lexicon given as a dict becomes a literal map and is looked up inside the row: no
explode, no join, no shuffle. A lexicon given as a table ``(word, polarity,
subjectivity)`` of any size is joined (``curio.operators.lexicon``).

Rules: words are whitespace tokens, lower-cased with non-word characters
removed; a word preceded by not / no / never has its polarity multiplied by
-0.5; scores are the mean over matched words, 0.0 when nothing matches.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curio.functions.text import WORD_SEP, bound, joined_words, split_joined

# --- fixed values -----------------------------------------------------------
NEGATIONS = ("not", "no", "never")
NEGATION_FACTOR = -0.5
NON_WORD_CHAR = r"[^\p{L}\p{N}_]"
# Small demonstration lexicon (word: polarity, subjectivity). Real runs pass
# their own table.
DEFAULT_LEXICON = {
    "good": (0.7, 0.6),
    "great": (0.8, 0.75),
    "bad": (-0.7, 0.67),
    "little": (-0.1875, 0.5),
    "new": (0.136, 0.454),
    "the": (0.05, 0.1),
    "and": (0.1, 0.2),
    "with": (0.2, 0.3),
    "this": (-0.1, 0.4),
    "that": (0.15, 0.35),
    "le": (0.1, 0.2),
    "la": (-0.2, 0.3),
    "des": (0.3, 0.5),
    "die": (-0.3, 0.6),
    "und": (0.25, 0.1),
    "der": (0.05, 0.2),
}
# ---------------------------------------------------------------------------


def clean_word(w: Column) -> Column:
    return F.regexp_replace(F.lower(w), NON_WORD_CHAR, "")


def lexicon_map(lexicon: Mapping[str, tuple[float, float]] | None = None) -> Column:
    """Literal ``map<string, struct<pol, subj>>`` from a dict. A lookup scans the keys,
    so many thousand entries are better joined."""
    if lexicon is None:
        lexicon = DEFAULT_LEXICON
    if isinstance(lexicon, DataFrame):
        raise TypeError("a lexicon table is joined: operators.lexicon.lexicon_sentiment, score_texts")
    keys = sorted(lexicon)
    vals = [F.struct(F.lit(float(lexicon[k][0])).alias("pol"),
                     F.lit(float(lexicon[k][1])).alias("subj")) for k in keys]
    return F.map_from_arrays(F.array(*[F.lit(k) for k in keys]).cast("array<string>"),
                             F.array(*vals))


def clean_joined(joined: Column) -> Column:
    """``joined_words`` text lower-cased with non-word characters removed:
    word i of the result is ``clean_word(word i)``."""
    return F.regexp_replace(F.lower(joined), f"[^\\p{{L}}\\p{{N}}_{WORD_SEP}]+", "")


def matched_scores(w: Column, lex: Column, cw: Column | None = None) -> Column:
    """Array of ``struct(pol, subj)`` for the words found in ``lex``, with the
    negation rule applied to ``pol``. Each word is paired with its predecessor
    by ``zip_with`` (one pass), and looked up once. ``cw`` may pass the
    cleaned words (``split_joined(clean_joined(...))``)."""
    return bound(F.transform(w, clean_word) if cw is None else cw, lambda c: _matched(c, lex))


def _matched(cw: Column, lex: Column) -> Column:
    prev = F.concat(F.array(F.lit(None).cast("string")),
                    F.slice(cw, 1, F.greatest(F.size(cw) - 1, F.lit(0))))
    neg = F.array(*[F.lit(x) for x in NEGATIONS])
    looked = F.zip_with(cw, prev, lambda c, p: F.struct(
        F.try_element_at(lex, c).alias("e"), p.alias("prev")))
    hits = F.filter(looked, lambda s: s["e"].isNotNull())
    negated = lambda s: F.coalesce(F.array_contains(neg, s["prev"]), F.lit(False))
    return F.transform(hits, lambda s: F.struct(
        (s["e"]["pol"] * F.when(negated(s), F.lit(NEGATION_FACTOR)).otherwise(F.lit(1.0)))
        .alias("pol"), s["e"]["subj"].alias("subj")))


def mean_of(scores: Column, field: str) -> Column:
    return bound(scores, lambda found: F.when(
        F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda acc, s: acc + s[field]) / F.size(found))
        .otherwise(F.lit(0.0)))


def _scores_of(text, lexicon, w: Column | None) -> Column:
    cw = bound(clean_joined(joined_words(text)), split_joined) if w is None else F.transform(w, clean_word)
    return matched_scores(w, lexicon_map(lexicon), cw)


def sentiment_score(text, lexicon=None, w: Column | None = None) -> Column:
    return mean_of(_scores_of(text, lexicon, w), "pol")


def subjectivity_score(text, lexicon=None, w: Column | None = None) -> Column:
    return mean_of(_scores_of(text, lexicon, w), "subj")
