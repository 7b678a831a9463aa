"""Sentence BLEU-4 (uniform weights, smoothing "method 1") as a column expression.

Rules: hypothesis and reference are whitespace-split; p_n = clipped n-gram
matches / max(1, hypothesis n-grams); no unigram match gives 0; a zero
numerator becomes ``epsilon / denominator``; brevity penalty is 1 when the
hypothesis is longer than the reference, else ``exp(1 - ref/hyp)``;
score = BP * exp(sum(ln p_n) / 4).

With a literal reference (the usual case: one fixed reference sentence) the
reference n-grams are known when the plan is built, so the score is a pure
per-row expression: no explode, no shuffle. For a reference held in a column,
see ``curio.operators.bleu.bleu_against_column``.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from curio.functions.text import words

# --- fixed values -----------------------------------------------------------
# Reference sentence used by the corpus scorer.
DEFAULT_REFERENCE = "Once upon a time, there was a little girl named Lily..."
MAX_ORDER = 4
SMOOTHING_EPSILON = 0.1
# Joins the words of an n-gram; a control character that whitespace-split
# words cannot contain.
GRAM_SEP = "\u0001"
# ---------------------------------------------------------------------------


def reference_ngrams(reference: str, n: int) -> Counter:
    toks = reference.split()
    return Counter(GRAM_SEP.join(toks[i:i + n]) for i in range(len(toks) - n + 1))


def reference_hits(w: Column, reference: str = DEFAULT_REFERENCE) -> Column:
    """1-based positions of the words that occur in the reference: only
    n-grams starting there can match, so n-grams are built for those alone."""
    vocab = F.array(*[F.lit(x) for x in sorted(set(reference.split()))])
    return F.when(F.size(w) > 0, F.filter(F.sequence(F.lit(1), F.size(w)),
                                          lambda i: F.array_contains(vocab, F.element_at(w, i)))
                  ).otherwise(F.array().cast("array<int>"))


def clipped_matches(w: Column, reference: str, n: int, hits: Column | None = None) -> Column:
    """Clipped n-gram matches in one pass: the n-grams starting at reference
    words, kept when they occur in the reference, sorted, each run counted
    up to the reference count (a literal map)."""
    ref = reference_ngrams(reference, n)
    if not ref:
        return F.lit(0).cast("bigint")
    hits = reference_hits(w, reference) if hits is None else hits
    grams = sorted(ref)
    ref_counts = F.map_from_arrays(F.array(*[F.lit(g) for g in grams]),
                                   F.array(*[F.lit(ref[g]) for g in grams]))
    starts = F.filter(hits, lambda i: i + (n - 1) <= F.size(w))
    cand = F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), GRAM_SEP))
    found = F.array_sort(F.filter(cand, lambda g: F.map_contains_key(ref_counts, g)))
    zero = F.struct(F.lit("").alias("prev"), F.lit(0).alias("run"),
                    F.lit(0).cast("bigint").alias("total"))

    def step(acc, g):
        run = F.when(g == acc["prev"], acc["run"] + 1).otherwise(F.lit(1))
        keep = F.when(run <= F.element_at(ref_counts, g), 1).otherwise(0)
        return F.struct(g.alias("prev"), run.alias("run"),
                        (acc["total"] + keep).cast("bigint").alias("total"))

    return F.aggregate(found, zero, step)["total"]


def match_counts(w: Column, reference: str = DEFAULT_REFERENCE,
                 hits: Column | None = None) -> Column:
    """``array(m_1, ..., m_4)`` of clipped matches."""
    return F.array(*[clipped_matches(w, reference, n, hits) for n in range(1, MAX_ORDER + 1)])


def bleu_from_counts(m: Column, hyp_len: Column, reference: str = DEFAULT_REFERENCE) -> Column:
    """BLEU from the match-count array and the hypothesis length."""
    ref_len = len(reference.split())
    log_sum = F.lit(0.0)
    for n in range(1, MAX_ORDER + 1):
        m_n = F.element_at(m, n)
        d = F.greatest(F.lit(1), hyp_len - n + 1)
        p = F.when(m_n == 0, F.lit(SMOOTHING_EPSILON) / d).otherwise(m_n / d)
        log_sum = log_sum + F.log(p)
    bp = F.when(hyp_len > ref_len, F.lit(1.0)).otherwise(
        F.exp(F.lit(1.0) - F.lit(float(ref_len)) / hyp_len))
    return F.when((hyp_len == 0) | (F.element_at(m, 1) == 0),
                  F.lit(0.0)).otherwise(bp * F.exp(log_sum / MAX_ORDER))


def bleu_score(text, reference: str = DEFAULT_REFERENCE, w: Column | None = None) -> Column:
    """Single-column form. ``with_bleu`` stages the intermediate columns so
    that each is computed once per row; prefer it on large tables."""
    w = words(text) if w is None else w
    return bleu_from_counts(match_counts(w, reference), F.size(w), reference)


def with_bleu(df, text: str = "text", out: str = "bleu_score",
              reference: str = DEFAULT_REFERENCE):
    """Add ``out`` = sentence BLEU of ``text`` against ``reference``."""
    from curio.operators._util import spread_small_input
    staged = (spread_small_input(df).withColumn("__w", words(text))
                .withColumn("__h", reference_hits(F.col("__w"), reference))
                .withColumn("__m", match_counts(F.col("__w"), reference, F.col("__h")))
                .withColumn("__n", F.size("__w")))
    return staged.withColumn(out, bleu_from_counts(F.col("__m"), F.col("__n"), reference)) \
                 .drop("__w", "__h", "__m", "__n")


def bleu_reference_value(hyp: str, reference: str = DEFAULT_REFERENCE) -> float:
    """Plain-Python version of the same rules, used by the tests."""
    h = hyp.split() if hyp else []
    if not h:
        return 0.0
    logs = []
    first = None
    for n in range(1, MAX_ORDER + 1):
        ref = reference_ngrams(reference, n)
        hc = Counter(GRAM_SEP.join(h[i:i + n]) for i in range(len(h) - n + 1))
        m = sum(min(c, ref.get(g, 0)) for g, c in hc.items())
        if n == 1:
            first = m
        d = max(1, len(h) - n + 1)
        logs.append(math.log(SMOOTHING_EPSILON / d if m == 0 else m / d))
    if first == 0:
        return 0.0
    r = len(reference.split())
    bp = 1.0 if len(h) > r else math.exp(1 - r / len(h))
    return bp * math.exp(sum(logs) / MAX_ORDER)
