"""The lexicon join at every size and syllables by hyphenation patterns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from curio.functions.hyphenation import breaks, pattern_trie, syllable_counter
from curio.functions.metrics import score_texts
from curio.operators.lexicon import lexicon_join, lexicon_sentiment
from curio.plans.q_text import HYPHEN_PATTERNS

SCHEMA = "word string, polarity double, subjectivity double"


def texts(n=300, seed=3):
    """A third of all words is one word; some texts are null or empty."""
    rng = random.Random(seed)
    out = [(0, None), (1, ""), (2, "hot"), (3, "hot"), (None, "hot not w1")]
    for i in range(4, n):
        out.append((i, " ".join(rng.choice(["hot", f"W{rng.randrange(900)}.", "not"]) for _ in range(rng.randrange(40)))))
    return out


def plain(rows, lexicon):
    out = {}
    for key, text in rows:
        words = [re.sub(r"[^\w]", "", w.lower()) for w in (text or "").split()]
        hits = [(lexicon[w][0] * (-0.5 if i and words[i - 1] in ("not", "no", "never") else 1), lexicon[w][1])
                for i, w in enumerate(words) if w in lexicon]
        out[key] = (sum(h[0] for h in hits) / len(hits), sum(h[1] for h in hits) / len(hits)) if hits else (0.0, 0.0)
    return out


@pytest.mark.parametrize("size", [1, 300, 300_000])
@pytest.mark.parametrize("shares", [2, 10_000])
def test_every_lexicon_size_and_split_gives_the_same_means(spark, size, shares):
    rows = texts()
    lexicon = {"hot": (0.5, 0.25), **{f"w{i}": ((i % 9 - 4) / 4, (i % 5) / 4) for i in range(size)}}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.range(size).select(
        F.concat(F.lit("w"), F.col("id")).alias("word"), ((F.col("id") % 9 - 4) / 4).alias("polarity"),
        ((F.col("id") % 5) / 4).alias("subjectivity")).union(spark.createDataFrame([("hot", 0.5, 0.25)], SCHEMA))
    got = {r[0]: (r[1], r[2]) for r in lexicon_sentiment(df, table, shares=shares).collect()}
    want = plain(rows, lexicon)
    assert set(got) == set(want)
    for key, means in want.items():
        assert got[key] == pytest.approx(means if key is not None else (0.0, 0.0)), key


def test_score_texts_with_a_table_equals_the_dict(spark):
    rows = [r for r in texts(60) if r[0] is not None]
    lexicon = {"hot": (0.5, 0.25), "w7": (-1.0, 0.5)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([(w, *v) for w, v in lexicon.items()], SCHEMA)
    by_table = score_texts(df, lexicon=table, key="doc_id")
    by_dict = score_texts(df, lexicon=lexicon)
    assert by_table.columns == by_dict.columns
    pairs = zip(*[sorted(map(tuple, d.collect())) for d in (by_table, by_dict)])
    assert all(a[:2] == b[:2] and a[2:] == pytest.approx(b[2:]) for a, b in pairs)
    with pytest.raises(ValueError):
        score_texts(df, lexicon=table)
    empty = lexicon_join(df.limit(0), table)
    assert empty.count() == 0 and lexicon_join(df, table.limit(0)).count() == 0


def plain_breaks(word, patterns, left, right):
    dotted, best = f".{word}.", {}
    for p in patterns:
        letters = re.sub(r"\d", "", p)
        levels = [int(d or 0) for d in re.split(r"\D", p)]
        for at in range(len(dotted) - len(letters) + 1):
            if dotted[at:at + len(letters)] == letters:
                for j, level in enumerate(levels):
                    best[at + j] = max(best.get(at + j, 0), level)
    return [i for i in range(left, len(word) - right + 1) if best.get(i + 1, 0) % 2]


def test_breaks():
    trie = pattern_trie(HYPHEN_PATTERNS)
    assert [breaks(w, trie) for w in ("table", "make", "banana", "a", "", "father")] == [[2], [], [2, 4], [], [], [2]]
    rng = random.Random(5)
    patterns = {"".join(rng.choice(["", "", "1", "2", "3"]) + rng.choice("abc.") for _ in range(rng.randrange(1, 4)))
                + rng.choice(["", "1", "2"]) for _ in range(60)}
    trie = pattern_trie(patterns)
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 14)))
        for left, right in ((1, 1), (2, 2), (2, 3)):
            assert breaks(word, trie, left, right) == plain_breaks(word, patterns, left, right), word


def test_syllable_counter(spark):
    words = [["table", "make", "", "banana", "banana"], [], None]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w array<string>")
    got = {r.i: r.n for r in df.select("i", syllable_counter(HYPHEN_PATTERNS)(F.col("w")).alias("n")).collect()}
    assert got == {0: [2, 1, 0, 3, 3], 1: [], 2: None}
