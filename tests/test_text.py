import math

import pytest
from pyspark.sql import functions as F

from curio.functions import bleu, readability as rd, sentiment as se, text as tx, tokens as tk
from curio.functions.metrics import METRIC_COLUMNS, register_metric, score_texts, unregister_metric

REF = bleu.DEFAULT_REFERENCE


def one(spark, col, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("text,expected", [
    (None, []), ("", []), ("   \t\n", []), ("one", ["one"]), ("two words", ["two", "words"]),
    ("a b", ["a", "b"]), ("  lead trail  ", ["lead", "trail"]), ("été là", ["été", "là"]),
    ("x\x1cy　z", ["x", "y", "z"]),
])
def test_words_match_python_split(spark, text, expected):
    assert one(spark, tx.words("t"), text) == expected
    if text is not None:
        assert expected == text.split()
    assert one(spark, tx.words_regex("t"), text) == expected


@pytest.mark.parametrize("hyp,expected", [
    ("", 0.0), (REF, 1.0), ("there was a little girl named Bob", 0.456917),
    ("a a a", 0.009389), ("xyz", 0.0),
    ("Once upon a time, there was a dog and a cat and a little girl named Sue.", 0.484597),
])
def test_bleu_fixtures(spark, hyp, expected):
    got = one(spark, bleu.bleu_score("t"), hyp)
    assert got == pytest.approx(expected, abs=1e-6)
    assert bleu.bleu_reference_value(hyp) == pytest.approx(expected, abs=1e-6)
    staged = bleu.with_bleu(spark.createDataFrame([(hyp,)], "text string")).first()["bleu_score"]
    assert staged == pytest.approx(expected, abs=1e-6)


def test_flesch_kincaid_and_fog_by_hand(spark):
    text = "The cat sat on the mat. It was happy."
    # 9 words, 2 sentences (chunks of 6 and 3 words), syllables 1*8 + 2 (happy)
    fk = 0.39 * 9 / 2 + 11.8 * 10 / 9 - 15.59
    assert one(spark, rd.flesch_kincaid_grade("t"), text) == pytest.approx(fk)
    assert one(spark, rd.sentence_count("t"), text) == 2
    assert one(spark, rd.syllable_total("t"), text) == 10
    hard = "An extraordinary beautiful, beautiful day."
    # difficult: distinct words with >= 3 syllables: extraordinary, beautiful
    assert one(spark, rd.difficult_words("t"), hard) == 2
    fog = 0.4 * (5 / 1 + 100 * 2 / 5)
    assert one(spark, rd.gunning_fog("t"), hard) == pytest.approx(fog)
    assert one(spark, rd.gunning_fog("t", easy_words=["beautiful"]), hard) == \
        pytest.approx(0.4 * (5 + 100 * 1 / 5))


@pytest.mark.parametrize("word,syl", [("the", 1), ("cafe", 1), ("table", 2), ("happy", 2),
                                      ("rhythm", 1), ("123", 0), ("e", 1), ("see", 1)])
def test_syllables_rule(spark, word, syl):
    assert one(spark, rd.syllables("t"), word) == syl
    assert one(spark, rd.syllable_total("t"), word) == syl


def test_metrics_of_empty_and_null_texts_are_zero(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "   ")], "id int, text string")
    out = score_texts(df, "text").collect()
    for r in out:
        for m in METRIC_COLUMNS:
            assert r[m] == 0.0


def test_profanity_whole_words_case_insensitive(spark):
    text = "Hate the hater. HATE, prison-hate and éhate hate_x"
    # whole words: Hate, HATE, prison, hate (after '-'); not hater, éhate, hate_x
    assert one(spark, tx.flagged_term_count("t"), text) == 4
    assert one(spark, tx.profanity_check("t"), text) == pytest.approx(4 / 8)


def test_vocabulary_diversity(spark):
    assert one(spark, tx.vocabulary_diversity("t"), "a b a B") == pytest.approx(3 / 4)
    assert one(spark, tx.vocabulary_diversity("t"), "") == 0.0


def test_sentiment_negation_and_no_match(spark):
    lex = {"good": (0.7, 0.6), "bad": (-0.7, 0.67)}
    text = "Not good, but bad!"
    pol = one(spark, se.sentiment_score("t", lex), text)
    assert pol == pytest.approx((0.7 * -0.5 + -0.7) / 2)
    assert one(spark, se.subjectivity_score("t", lex), text) == pytest.approx((0.6 + 0.67) / 2)
    assert one(spark, se.sentiment_score("t", lex), "nothing here") == 0.0


def test_checkpoint_number(spark):
    assert one(spark, tx.checkpoint_number("t"), "out/ckpt_100.pt") == 100
    assert one(spark, tx.checkpoint_number("t"), "model.pt") is None
    assert one(spark, tx.checkpoint_number("t"), "ckpt_x.pt") is None


@pytest.mark.parametrize("s,expected", [("[1 2  3]", [1, 2, 3]), ("[1, 2]", []), ("[]", []),
                                        (None, []), ("[7]", [7])])
def test_parse_token_string(spark, s, expected):
    assert one(spark, tk.parse_token_string("t"), s) == expected


def test_token_helpers(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([],), ([9],)], "t array<int>")
    got = df.select(tk.pad_truncate("t", 2).alias("p"), tk.add_bos_eos("t").alias("b"),
                    *[c.alias(n) for c, n in zip(tk.shift_pairs(F.col("t")), ("x", "y"))]).collect()
    assert [r["p"] for r in got] == [[5, 6], [0, 0], [9, 0]]
    assert [r["b"] for r in got] == [[1, 5, 6, 7, 2], [1, 2], [1, 9, 2]]
    assert [(r["x"], r["y"]) for r in got] == [([5, 6], [6, 7]), ([], []), ([], [])]


def test_strip_and_unprintable(spark):
    assert one(spark, tx.strip("t"), "  a b \n") == "a b"
    assert one(spark, tx.strip_unprintable("t"), "a\x00b\tc\x7f") == "ab\tc"


def test_register_metric(spark):
    register_metric("n_words", lambda text, w: F.size(w))
    try:
        df = spark.createDataFrame([("a b c",)], "text string")
        assert score_texts(df).first()["n_words"] == 3.0
    finally:
        unregister_metric("n_words")
    with pytest.raises(ValueError):
        register_metric("bleu_score", lambda t, w: t)


def test_bleu_reference_python_matches_math():
    assert math.isclose(bleu.bleu_reference_value(REF), 1.0)


def test_flagged_phrases_and_hyphens_as_an_alternation(spark):
    import re
    texts = ["Damn it, damn  it; DAMN IT", "her mother-in-law and the mother in law", "mother-in-lawyer", "c++ or c++x, a-damn it",
             "damn itß damn it_ damn it!", "damn damn it damn", "", None, "édamn it", "in law in-law"]
    for terms in (["damn it", "mother-in-law"], ["damn", "damn it"], ["damn it", "damn"], ["c++", "in-law", "law"], ["it"]):
        pattern = re.compile(r"\b(?:" + "|".join(map(re.escape, terms)) + r")\b", re.IGNORECASE)
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
        got = {r["k"]: r["n"] for r in df.select("k", tx.flagged_term_count("t", terms).alias("n")).collect()}
        assert got == {k: len(pattern.findall(t or "")) for k, t in enumerate(texts)}, terms
