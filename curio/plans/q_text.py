"""Queries for the per-row text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from curio.functions import bleu, readability as rd, sentiment as se, text as tx
from curio.functions.hyphenation import syllable_counter
from curio.functions.metrics import METRIC_COLUMNS, score_texts
from curio.operators import lexicon as lexop
from curio.operators._util import spread_small_input
from curio.plans import sql as S
from curio.plans.registry import query
from curio.session import materialize
from curio.sources import table

# Flagged terms used by the queries: the default terms never occur in the
# driver's documents, so the queries pass common words to get non-zero values.
QUERY_TERMS = ("the", "and", "und")


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("words", f"""
WITH b AS (SELECT doc_id, {S.words('text')} AS w FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct,
       w[1] AS first_word, w[-1] AS last_word FROM b""")
def q_words(spark, sf):
    d = docs(spark, sf).select("doc_id", tx.words("text").alias("w"))
    return d.select("doc_id", F.size("w").alias("n_words"),
                    F.size(F.array_distinct("w")).alias("n_distinct"),
                    # a text may have no words
                    F.try_element_at("w", F.lit(1)).alias("first_word"),
                    F.try_element_at("w", F.lit(-1)).alias("last_word"))


@query("vocabulary_diversity", f"""
WITH {S.text_stats_cte()} SELECT doc_id, round({S.DIV}, 6) AS vocabulary_diversity FROM st""")
def q_diversity(spark, sf):
    return docs(spark, sf).select("doc_id", tx.vocabulary_diversity("text").alias("vocabulary_diversity"))


@query("profanity_check", f"""
WITH {S.text_stats_cte(terms=QUERY_TERMS)}
SELECT doc_id, CAST(f AS BIGINT) AS n_flagged, round({S.PROF}, 6) AS profanity_check FROM st""")
def q_profanity(spark, sf):
    return docs(spark, sf).select(
        "doc_id", tx.flagged_term_count("text", QUERY_TERMS).alias("n_flagged"),
        tx.profanity_check("text", QUERY_TERMS).alias("profanity_check"))


PHRASE_TERMS = ("of the", "the", "in-the", "and", "and the")


@query("profanity_phrases", f"""
SELECT doc_id, len(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[À-ÖØ-öø-ɏͰ-῿぀-퟿]', 'x', 'g')),
           '\\b(?:{"|".join(PHRASE_TERMS)})\\b'))::BIGINT AS n_flagged FROM documents""")
def q_profanity_phrases(spark, sf):
    """Phrases and hyphenated terms among the flagged ones."""
    return docs(spark, sf).select("doc_id", tx.flagged_term_count("text", PHRASE_TERMS).alias("n_flagged"))


@query("bleu_score", f"""
WITH {S.bleu_ctes()} SELECT doc_id, round(bleu_score, 6) AS bleu_score FROM bleu""")
def q_bleu(spark, sf):
    return bleu.with_bleu(docs(spark, sf).select("doc_id", "text")).select("doc_id", "bleu_score")


@query("flesch_kincaid_grade", f"""
WITH {S.text_stats_cte()}
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(s AS BIGINT) AS n_sentences,
       CAST(syl AS BIGINT) AS n_syllables, round({S.FK}, 6) AS flesch_kincaid_grade FROM st""")
def q_fk(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", tx.word_count("text").alias("n_words"),
                    rd.sentence_count("text").alias("n_sentences"),
                    rd.syllable_total("text").alias("n_syllables"),
                    rd.flesch_kincaid_grade("text").alias("flesch_kincaid_grade"))


@query("gunning_fog", f"""
WITH {S.text_stats_cte()}
SELECT doc_id, CAST(hard AS BIGINT) AS n_difficult, round({S.FOG}, 6) AS gunning_fog FROM st""")
def q_fog(spark, sf):
    d = spread_small_input(docs(spark, sf).select("doc_id", "text"))
    return d.select("doc_id", rd.difficult_words("text").alias("n_difficult"),
                    rd.gunning_fog("text").alias("gunning_fog"))


_SCORE_SQL = f"""
WITH {S.text_stats_cte(terms=QUERY_TERMS)}, {S.bleu_ctes()}, {S.sentiment_ctes(se.DEFAULT_LEXICON)}
SELECT st.doc_id, round(bleu.bleu_score, 6) AS bleu_score, round({S.FK}, 6) AS flesch_kincaid_grade,
       round({S.FOG}, 6) AS gunning_fog, round({S.DIV}, 6) AS vocabulary_diversity,
       round(senti.subjectivity_score, 6) AS subjectivity_score,
       round(senti.sentiment_score, 6) + 0.0 AS sentiment_score, round({S.PROF}, 6) AS profanity_check
FROM st JOIN bleu ON st.doc_id = bleu.doc_id JOIN senti ON st.doc_id = senti.doc_id"""


@query("score_texts", _SCORE_SQL)
def q_score_texts(spark, sf):
    d = docs(spark, sf).select("doc_id", "text")
    return score_texts(d, "text", terms=QUERY_TERMS).select("doc_id", *METRIC_COLUMNS)


@query("sentiment_score", f"""
WITH {S.sentiment_ctes(se.DEFAULT_LEXICON)} SELECT doc_id, round(sentiment_score, 6) + 0.0 AS sentiment_score FROM senti""")
def q_sentiment(spark, sf):
    d = spread_small_input(docs(spark, sf).select("doc_id", "text"))
    return d.select("doc_id", se.sentiment_score("text").alias("sentiment_score"))


@query("subjectivity_score", f"""
WITH {S.sentiment_ctes(se.DEFAULT_LEXICON)}
SELECT doc_id, round(subjectivity_score, 6) AS subjectivity_score FROM senti""")
def q_subjectivity(spark, sf):
    d = spread_small_input(docs(spark, sf).select("doc_id", "text"))
    return d.select("doc_id", se.subjectivity_score("text").alias("subjectivity_score"))


@query("lexicon_join", f"""
WITH {S.sentiment_ctes(se.DEFAULT_LEXICON)}
SELECT sx.k AS doc_id, CAST(sx.i - 1 AS BIGINT) AS word_pos, lx.word AS word,
       round(lx.polarity * CASE WHEN sx.prev IN ('not', 'no', 'never') THEN -0.5 ELSE 1.0 END, 6) AS polarity,
       round(lx.subjectivity, 6) AS subjectivity
FROM sx JOIN {S.lexicon_values(se.DEFAULT_LEXICON)} ON sx.cw = lx.word""")
def q_lexicon_join(spark, sf):
    lex = lexop.lexicon_table(spark)
    return lexop.lexicon_join(docs(spark, sf).select("doc_id", "text"), lex, key="doc_id")


@query("strip", f"""
SELECT doc_id, CAST(length(regexp_replace(text, {S.q('^' + tx.WS_RUN + '|' + tx.WS_RUN + '$')}, '', 'g')) AS BIGINT)
       AS n_chars_stripped,
       CAST(length(text) AS BIGINT) AS n_chars_raw FROM documents""")
def q_strip(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", F.length(tx.strip("text")).alias("n_chars_stripped"),
                    F.length("text").alias("n_chars_raw"))


@query("strip_unprintable", f"""
SELECT doc_id, CAST(length(regexp_replace(text, {S.q(tx.UNPRINTABLE)}, '', 'g')) AS BIGINT) AS n_chars_printable,
       md5(regexp_replace(text, {S.q(tx.UNPRINTABLE)}, '', 'g')) AS text_md5
FROM documents""")
def q_strip_unprintable(spark, sf):
    d = docs(spark, sf).select("doc_id", tx.strip_unprintable("text").alias("t"))
    return d.select("doc_id", F.length("t").alias("n_chars_printable"), F.md5("t").alias("text_md5"))


@query("create_global_id", """
SELECT doc_id, source || '_' || CAST(doc_id AS VARCHAR) AS global_id FROM documents""")
def q_global_id(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", tx.create_global_id("source", "doc_id").alias("global_id"))


# Checkpoint file names formatted from the events table: most events name a
# checkpoint, 'error' events a file without a number, 'view' events a
# malformed number.
_CKPT_NAME_SQL = """CASE event_type WHEN 'error' THEN 'model.pt'
  WHEN 'view' THEN 'ckpt_x' || CAST(event_id AS VARCHAR) || '.pt'
  ELSE 'out/ckpt_' || CAST(event_id AS VARCHAR) || '.pt' END"""


def checkpoint_names(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    name = (F.when(F.col("event_type") == "error", F.lit("model.pt"))
            .when(F.col("event_type") == "view",
                  F.concat(F.lit("ckpt_x"), F.col("event_id").cast("string"), F.lit(".pt")))
            .otherwise(F.concat(F.lit("out/ckpt_"), F.col("event_id").cast("string"), F.lit(".pt"))))
    return e.select("event_id", name.alias("name"))


@query("checkpoint_number", f"""
WITH n AS (SELECT event_id, {_CKPT_NAME_SQL} AS name FROM events)
SELECT event_id, name, TRY_CAST(regexp_extract(name, 'ckpt_(.*?)\\.pt', 1) AS INTEGER)::BIGINT AS ckpt
FROM n""")
def q_checkpoint_number(spark, sf):
    n = checkpoint_names(spark, sf)
    return n.select("event_id", "name", tx.checkpoint_number("name").alias("ckpt"))


@query("register_metric", f"""
WITH b AS (SELECT doc_id, {S.words('text')} AS w FROM documents)
SELECT doc_id, round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w)
                     ELSE 0.0 END, 6) AS mean_word_length,
       round(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0.0 END, 6) AS vocabulary_diversity
FROM b""")
def q_register_metric(spark, sf):
    """K2: a user metric (mean word length) computed next to a built-in one."""
    from curio.functions.metrics import register_metric, unregister_metric
    register_metric("mean_word_length", lambda text, w: F.when(
        F.size(w) > 0, F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
        / F.size(w)).otherwise(F.lit(0.0)))
    try:
        d = docs(spark, sf).select("doc_id", "text")
        return score_texts(d, "text", metrics=["mean_word_length", "vocabulary_diversity"]) \
            .select("doc_id", "mean_word_length", "vocabulary_diversity")
    finally:
        unregister_metric("mean_word_length")


@query("lexicon_sentiment", f"""
WITH {S.sentiment_ctes(se.DEFAULT_LEXICON)}
SELECT doc_id, round(sentiment_score, 6) + 0.0 AS sentiment_score, round(subjectivity_score, 6) AS subjectivity_score
FROM senti""")
def q_lexicon_sentiment(spark, sf):
    """H7/H8 through the join route used for lexicons too large for an
    in-row map lookup (explode + size-checked broadcast join + aggregate)."""
    return lexop.lexicon_sentiment(docs(spark, sf).select("doc_id", "text"),
                                   lexop.lexicon_table(spark), key="doc_id")


_VOCABULARY_SQL = f"""
WITH vw AS (SELECT {S.words('text')} AS w FROM documents),
vc AS (SELECT DISTINCT regexp_replace(lower(u.x), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS word
       FROM vw, LATERAL (SELECT unnest(vw.w) AS x) u),
lx AS (SELECT word, (length(word) % 7 - 3) / 4.0 AS polarity, (length(word) % 5) / 8.0 AS subjectivity
       FROM vc WHERE length(word) % 3 > 0),
{S.sentiment_ctes({"": (0, 0)}).split("sm AS (")[0]}
sm AS (
  SELECT sx.k, avg(lx.polarity * CASE WHEN sx.prev IN ('not', 'no', 'never') THEN -0.5 ELSE 1.0 END) AS pol,
         avg(lx.subjectivity) AS subj
  FROM sx JOIN lx ON sx.cw = lx.word GROUP BY sx.k)
SELECT sw.k AS doc_id, round(coalesce(sm.pol, 0.0), 6) + 0.0 AS sentiment_score,
       round(coalesce(sm.subj, 0.0), 6) AS subjectivity_score
FROM sw LEFT JOIN sm ON sw.k = sm.k"""


def vocabulary_lexicon(spark, sf):
    """A stand-in lexicon as large as the corpus' vocabulary, written once: the
    join reads it several times."""
    d = spread_small_input(docs(spark, sf).select("text"))
    cleaned = tx.bound(se.clean_joined(tx.joined_words("text")), tx.split_joined)
    v = d.select(F.explode(cleaned).alias("word")).distinct()
    n = F.length("word")
    return materialize(v.where(n % 3 > 0).select("word", ((n % 7 - 3) / F.lit(4.0)).alias("polarity"),
                                                 ((n % 5) / F.lit(8.0)).alias("subjectivity")), "lexicon")


@query("lexicon_sentiment_vocabulary", _VOCABULARY_SQL)
def q_lexicon_sentiment_vocabulary(spark, sf):
    """H7/H8 by ``score_texts`` with a lexicon table of tens of thousands of words."""
    d = docs(spark, sf).select("doc_id", "text")
    return score_texts(d, "text", lexicon=vocabulary_lexicon(spark, sf), key="doc_id",
                       metrics=["sentiment_score", "subjectivity_score"]) \
        .select("doc_id", "sentiment_score", "subjectivity_score")


# Hyphenation patterns of the query, from a rule: a break before a consonant with a
# vowel; none inside a stop and a liquid or a digraph, but before them; none before the
# consonant of a silent end.
_CONSONANTS = "bcdfghjklmnpqrstvwxz"
HYPHEN_PATTERNS = tuple(
    [f"1{c}{v}" for c in _CONSONANTS for v in "aeiouy"]
    + [f"1{s}2{l}" for s in "bcdfgkpt" for l in "lr"]
    + [f"1{d[0]}2{d[1]}" for d in ("ch", "gh", "ph", "sh", "th")]
    + [f"2{c}e." for c in _CONSONANTS if c != "l"] + ["a1e2a", "i1a", "4ed."])


def _hyphen_sql(patterns, left=2, right=2):
    """Every substring of a dotted word joined with the patterns; highest level per place."""
    import re
    rows = ", ".join("({}, {})".format(S.q(re.sub(r"\d", "", p)),
                                       [int(x or 0) for x in re.split(r"\D", p)]) for p in patterns)
    longest = max(len(re.sub(r"\d", "", p)) for p in patterns)
    return f"""
hb AS (SELECT doc_id, text, {S.words('text')} AS w FROM documents),
ho AS (SELECT doc_id, {S.letters('u.x')} AS lw FROM hb, LATERAL (SELECT unnest(hb.w) AS x) u),
hd AS (SELECT DISTINCT lw, '.' || lw || '.' AS dotted FROM ho WHERE lw <> ''),
hs AS (SELECT lw, a.a AS a, substr(dotted, a.a, l.l) AS part FROM hd,
       LATERAL (SELECT unnest(range(1, length(dotted) + 1)) AS a) a,
       (SELECT unnest(range(1, {longest + 1})) AS l) l WHERE a.a + l.l - 1 <= length(dotted)),
hp(part, levels) AS (VALUES {rows}),
hl AS (SELECT lw, a, unnest(levels) AS lev, unnest(range(len(levels))) AS j FROM hs JOIN hp USING (part)),
hx AS (SELECT lw, a + j - 2 AS place, max(lev) AS lev FROM hl GROUP BY ALL),
hy AS (SELECT hd.lw, 1 + count(hx.place) AS syl FROM hd LEFT JOIN hx ON hx.lw = hd.lw AND lev % 2 = 1
       AND place BETWEEN {left} AND length(hd.lw) - {right} GROUP BY hd.lw),
hn AS (SELECT doc_id, sum(syl) AS syl, count(DISTINCT CASE WHEN syl >= 3 THEN lw END) AS hard
       FROM ho JOIN hy USING (lw) GROUP BY doc_id),
ht AS (SELECT hb.doc_id, len(hb.w) AS n, {S.sentences('hb.text')} AS s, coalesce(hn.syl, 0) AS syl,
       coalesce(hn.hard, 0) AS hard FROM hb LEFT JOIN hn ON hb.doc_id = hn.doc_id)"""


@query("readability_hyphenated", f"""
WITH {_hyphen_sql(HYPHEN_PATTERNS)}
SELECT doc_id,
       round(CASE WHEN n > 0 THEN 0.39::DOUBLE * n / s + 11.8::DOUBLE * syl / n - 15.59::DOUBLE ELSE 0.0 END, 6)
         AS flesch_kincaid_grade,
       round(CASE WHEN n > 0 THEN 0.4::DOUBLE * (n / s + 100.0::DOUBLE * hard / n) ELSE 0.0 END, 6) AS gunning_fog
FROM ht""")
def q_readability_hyphenated(spark, sf):
    """H5/H6 with syllables by hyphenation patterns."""
    d = docs(spark, sf).select("doc_id", "text")
    names = ["flesch_kincaid_grade", "gunning_fog"]
    return score_texts(d, "text", metrics=names, syllables=syllable_counter(HYPHEN_PATTERNS)) \
        .select("doc_id", *names)
