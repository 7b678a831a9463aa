"""C8 ``lexicon_join`` and the join form of the lexicon sentiment scores.

Words are cleaned on the text, exploded once with their position, and joined to the
lexicon: a lexicon of at most ``BROADCAST_WORDS`` rows by a broadcast, without a shuffle
of the words. A larger one is shuffled. A few words hold much of any corpus, so that
join is split at them: a word with more than 1 / ``SHARES`` of all occurrences is
frequent, of which there are fewer than ``SHARES`` whatever the corpus. These are
broadcast with their scores; occurrences of all other words are joined by a shuffle in
which no key holds more than that share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.functions.sentiment import (DEFAULT_LEXICON, NEGATION_FACTOR, NEGATIONS,
                                       clean_joined)
from curio.functions.text import bound, joined_words, split_joined
from curio.operators._util import row_count_at_most, spread_small_input
from curio.session import materialize

LEXICON_SCHEMA = "word string, polarity double, subjectivity double"
SHARES = 10_000
BROADCAST_WORDS = 200_000


def lexicon_table(spark: SparkSession, lexicon: dict | None = None) -> DataFrame:
    lexicon = DEFAULT_LEXICON if lexicon is None else lexicon
    rows = [(k, float(v[0]), float(v[1])) for k, v in sorted(lexicon.items())]
    return spark.createDataFrame(rows, LEXICON_SCHEMA)


def join_words(occurrences: DataFrame, entries: DataFrame, shares: int = SHARES) -> DataFrame:
    """``occurrences`` joined with ``entries`` on ``word`` (inner), apart for
    frequent and other words. The counts combine before their shuffle and are written
    once, as all of their uses would count the words again."""
    counts = materialize(occurrences.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    total = counts.agg(F.sum("n")).scalar()
    frequent = counts.where(F.col("n") * shares > total).select("word")
    return occurrences.join(F.broadcast(frequent.join(entries, "word")), "word").unionByName(
        occurrences.join(F.broadcast(frequent), "word", "left_anti").join(entries, "word"))


def lexicon_join(df: DataFrame, lexicon: DataFrame, key: str = "doc_id",
                 text: str = "text", shares: int = SHARES, small: int = BROADCAST_WORDS) -> DataFrame:
    """One row per matched word: ``(key, word_pos, word, polarity, subjectivity)``;
    polarity carries the negation rule (previous word not/no/never). Null and empty
    texts match nothing; a word that the lexicon lists twice matches twice, the null
    word never. ``small``: the rows of a lexicon that is broadcast; the lexicon is
    read several times, so pass a table, not an expensive plan."""
    cleaned = bound(clean_joined(joined_words(text)), split_joined)
    marked = bound(cleaned, lambda w: F.transform(w, lambda c, i: F.struct(
        c.alias("word"), F.coalesce(F.get(w, i - 1).isin(*NEGATIONS), F.lit(False)).alias("negated"))))
    ex = spread_small_input(df.select(key, text)).select(key, F.posexplode(marked).alias("word_pos", "m")).select(
        key, F.col("word_pos").cast("bigint").alias("word_pos"), "m.word", "m.negated")
    entries = lexicon.select("word", "polarity", "subjectivity")
    j = ex.join(F.broadcast(entries), "word") if row_count_at_most(entries, small) else join_words(ex, entries, shares)
    return j.select(key, "word_pos", "word",
                    (F.col("polarity") * F.when(F.col("negated"), F.lit(NEGATION_FACTOR)).otherwise(1.0))
                    .alias("polarity"), "subjectivity")


def lexicon_sentiment(df: DataFrame, lexicon: DataFrame, key: str = "doc_id",
                      text: str = "text", shares: int = SHARES, small: int = BROADCAST_WORDS) -> DataFrame:
    """``(key, sentiment_score, subjectivity_score)`` for every row of ``df``
    through the join route. The matched words of one row sit in one partition after
    the explode, so the aggregation combines map-side before its shuffle. Rows that
    share a key share the means over all their words; the null key matches nothing."""
    m = lexicon_join(df, lexicon, key, text, shares, small).groupBy(key).agg(
        F.avg("polarity").alias("sentiment_score"),
        F.avg("subjectivity").alias("subjectivity_score"))
    return df.select(key).join(m, key, "left").select(
        key, F.coalesce("sentiment_score", F.lit(0.0)).alias("sentiment_score"),
        F.coalesce("subjectivity_score", F.lit(0.0)).alias("subjectivity_score"))
