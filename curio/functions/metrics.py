"""``score_texts``: the seven corpus metrics for every row, plus a registry
for extra metrics.

The metrics are staged: the word array and the per-row counts are computed
once in their own projection, the metrics are built from them in the next.
Catalyst does not merge projections that would compute a non-trivial
expression twice, so every intermediate is evaluated once per row.
"""

from __future__ import annotations

from typing import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curio.functions import bleu, readability as rd, sentiment as se
from curio.functions.text import (DEFAULT_FLAGGED_TERMS, flagged_term_count, joined_words,
                                  split_joined)

# --- fixed values -----------------------------------------------------------
METRIC_COLUMNS = (
    "bleu_score",
    "flesch_kincaid_grade",
    "gunning_fog",
    "vocabulary_diversity",
    "subjectivity_score",
    "sentiment_score",
    "profanity_check",
)
# ---------------------------------------------------------------------------

SENTIMENT_COLUMNS = ("subjectivity_score", "sentiment_score")
# words array Column -> array<int> Column of their syllables
SyllableCounter = Callable[[Column], Column]

# name -> builder(text Column, words Column) -> Column
_EXTRA_METRICS: dict[str, Callable[[Column, Column], Column]] = {}


def register_metric(name: str, builder: Callable[[Column, Column], Column]) -> None:
    """Add a metric computed next to the seven. ``builder(text, words)`` must
    return a Column (prefer native functions; a pandas_udf is the last resort)."""
    if name in METRIC_COLUMNS:
        raise ValueError(f"{name} is a built-in metric")
    _EXTRA_METRICS[name] = builder


def unregister_metric(name: str) -> None:
    _EXTRA_METRICS.pop(name, None)


def registered_metrics() -> tuple[str, ...]:
    return METRIC_COLUMNS + tuple(_EXTRA_METRICS)


def score_texts(df: DataFrame, text: str = "text", *,
                reference: str = bleu.DEFAULT_REFERENCE,
                terms: Iterable[str] = DEFAULT_FLAGGED_TERMS,
                lexicon=None, easy_words: Iterable[str] = (),
                round_outputs: bool = False,
                metrics: Iterable[str] | None = None, balance: bool = True,
                key: str | None = None, syllables: SyllableCounter | None = None) -> DataFrame:
    """Add the metric columns to ``df``. A metric that cannot be computed for a
    row (null text, no words) is 0.0, as in the reference scorer. ``balance``
    spreads a small input over all task slots (no-op on large inputs).

    ``lexicon`` is a dict, looked up inside the row, or a table ``(word, polarity,
    subjectivity)`` of any size, joined on the words; ``key`` then names a unique
    column of ``df`` by which the means come back. ``syllables`` counts the syllables of
    an array of words (``functions.hyphenation.syllable_counter``) in place of the vowel groups."""
    if isinstance(lexicon, DataFrame):
        return _scored_by_table(df, text, lexicon, key, metrics, reference=reference, terms=terms,
                                easy_words=easy_words, round_outputs=round_outputs, balance=balance,
                                syllables=syllables)
    if balance and not df.isStreaming:
        from curio.operators._util import spread_small_input
        df = spread_small_input(df)
    wanted = tuple(metrics) if metrics is not None else registered_metrics()
    t = F.col(text)
    lex = se.lexicon_map(lexicon) if {"sentiment_score", "subjectivity_score"} & set(wanted) \
        else None
    # stage 1: the text with words joined by a separator (one regex pass)
    s1 = df.withColumn("__j", joined_words(t))
    j = F.col("__j")
    # stage 2: the word arrays (each a text-level rewrite, then a split)
    st2 = {"__w": split_joined(j)}
    if {"flesch_kincaid_grade", "gunning_fog"} & set(wanted):
        st2["__lj"] = rd.letters_joined(j)
    if lex is not None:
        st2["__cw"] = split_joined(se.clean_joined(j))
    s2 = s1.withColumns(st2)
    w = F.col("__w")
    stage = {"__n": F.size(w)}
    if "bleu_score" in wanted:
        stage["__h"] = bleu.reference_hits(w, reference)
    if {"flesch_kincaid_grade", "gunning_fog"} & set(wanted):
        stage["__s"] = rd.sentence_count(t)
        if syllables is None:
            stage["__mk"] = rd.syllable_marks_joined(F.col("__lj"))
        else:
            stage["__sy"] = syllables(split_joined(F.col("__lj")))
    if "vocabulary_diversity" in wanted:
        stage["__d"] = F.size(F.array_distinct(w))
    if "profanity_check" in wanted:
        stage["__f"] = flagged_term_count(t, terms)
    if lex is not None:
        stage["__sc"] = se.matched_scores(w, lex, F.col("__cw"))
    for name in wanted:
        if name in _EXTRA_METRICS:
            stage[f"__x_{name}"] = _EXTRA_METRICS[name](t, w)
    s3 = s2.withColumns(stage)
    st4 = {}
    if "bleu_score" in wanted:
        st4["__m"] = bleu.match_counts(w, reference, F.col("__h"))
    if {"flesch_kincaid_grade", "gunning_fog"} & set(wanted):
        st4["__syl"] = rd.syllable_total_joined(F.col("__mk")) if syllables is None \
            else rd.syllable_sum(F.col("__sy"))
    if "gunning_fog" in wanted:
        easy = sorted({e.lower() for e in easy_words})
        st4["__hard"] = rd.hard_word_count(split_joined(F.col("__lj")),
                                           rd.syllable_array(F.col("__mk")) if syllables is None
                                           else F.col("__sy"), easy)
    s2 = s3.withColumns(st4) if st4 else s3

    n = F.col("__n")
    out: dict[str, Column] = {}
    if "bleu_score" in wanted:
        out["bleu_score"] = bleu.bleu_from_counts(F.col("__m"), n, reference)
    if "flesch_kincaid_grade" in wanted:
        fk = (F.lit(rd.FK_WORDS_PER_SENTENCE) * n / F.col("__s")
              + F.lit(rd.FK_SYLLABLES_PER_WORD) * F.col("__syl") / n - F.lit(rd.FK_OFFSET))
        fk = F.when(n > 0, fk).otherwise(F.lit(0.0))
        out["flesch_kincaid_grade"] = F.round(fk, 1) if round_outputs else fk
    if "gunning_fog" in wanted:
        fog = F.lit(rd.FOG_FACTOR) * (n / F.col("__s") + F.lit(100.0) * F.col("__hard") / n)
        fog = F.when(n > 0, fog).otherwise(F.lit(0.0))
        out["gunning_fog"] = F.round(fog, 2) if round_outputs else fog
    if "vocabulary_diversity" in wanted:
        out["vocabulary_diversity"] = F.when(n > 0, F.col("__d") / n).otherwise(F.lit(0.0))
    if "subjectivity_score" in wanted:
        out["subjectivity_score"] = se.mean_of(F.col("__sc"), "subj")
    if "sentiment_score" in wanted:
        out["sentiment_score"] = se.mean_of(F.col("__sc"), "pol")
    if "profanity_check" in wanted:
        out["profanity_check"] = F.when(n > 0, F.col("__f") / n).otherwise(F.lit(0.0))
    for name in wanted:
        if name in _EXTRA_METRICS:
            out[name] = F.col(f"__x_{name}")
    out = {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in out.items()}
    tmp = [c for c in s2.columns if c.startswith("__")]
    return s2.withColumns(out).drop(*tmp)


def _scored_by_table(df: DataFrame, text: str, lexicon: DataFrame, key: str | None,
                     metrics: Iterable[str] | None, **options) -> DataFrame:
    """``score_texts`` with the sentiment columns from a joined lexicon."""
    from curio.operators.lexicon import lexicon_sentiment
    wanted = tuple(metrics) if metrics is not None else registered_metrics()
    joined = [c for c in wanted if c in SENTIMENT_COLUMNS]
    scored = score_texts(df, text, metrics=[c for c in wanted if c not in joined], **options)
    if not joined:
        return scored
    if key is None:
        raise ValueError("a lexicon table needs key, a unique column of the texts")
    means = lexicon_sentiment(df, lexicon, key, text).select(F.col(key).alias("__key"), *joined)
    kept = [c for c in df.columns if c not in wanted]
    return scored.drop(*joined).join(means, F.col(key).eqNullSafe(F.col("__key")), "left").select(*kept, *wanted)
