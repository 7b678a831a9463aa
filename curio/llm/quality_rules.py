"""Operator 9, quality rules as a learned decision list. DataFrame functions only.

``statistics`` computes a document's counts; ``features`` makes ratios of them.
``learn`` grows an ordered list of rules from labelled statistics by sequential
covering: a rule is grown one threshold at a time by information gain on two
thirds of the rows not yet covered, then its last conditions are pruned while that
helps on the other third, and it is accepted only if it is precise on both; rows
that it covers go and the next rule is grown. Thresholds are quantiles of the
training rows. ``Rule`` lists become one ordered Spark expression (``verdict``).

The list is fitted on a sample of at most ``SAMPLE_ROWS`` labelled rows (the
smallest by hash of the id; a documented bound); only their numbers, never texts,
come to the driver. Everything else runs on all rows.

A word is ``[^\\x20\\x09-\\x0D]+``. Defined results: null and empty texts have zero
counts and fail the base rules. Repeated rows are judged alike; a null id is judged
by its text. Without labels, or when no rule is precise enough, the list is empty
and the base rules decide alone. Extra columns pass through ``keep``; an empty
table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curio.llm.common import SPACES

SYMBOLS = "#*$%&|<>"
WINDOW = 8  # made by doubling: 1, 2, 4, 8
SAMPLE_ROWS = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_upper", "n_end_marks", "n_lines", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share",
            "stop_share", "lines_per_word", "end_mark_share"]


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words (long), and a few more counts of the whole text.

    Each step is its own projection, so the word list and the window hashes are
    made once. Windows are compared by 64-bit hash within one text; the sorted
    (hash, place) list is only made for texts that do repeat a window."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blank = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), SPACES[1:], text)
    out = docs.withColumn("__words", F.array_remove(F.split(blank, " ", -1), ""))
    out = out.withColumns({
        "__hashes": F.transform("__words", lambda w: F.xxhash64(w)),
        "__lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t\x0B\f\r]")),
        # one pass leaves the few characters that are counted
        "__marks": F.regexp_replace(text, f"[^A-Z.!?{SYMBOLS}]+", ""),
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
    })
    count = lambda marks: F.length(F.regexp_replace("__marks", f"[^{marks}]+", "")).cast("long")
    out = out.withColumns({"__windows": F.when(F.size("__hashes") >= WINDOW, _pairs(F.col("__hashes"), 1)),
                           "n_symbols": count(SYMBOLS), "n_upper": count("A-Z"), "n_end_marks": count(".!?")})
    for width in (2, 4):
        out = out.withColumn("__windows", _pairs(F.col("__windows"), width))
    repeats = F.size("__windows") > F.size(F.array_distinct("__windows"))
    out = out.withColumns({
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__sorted": F.when(F.coalesce(repeats, F.lit(False)), F.sort_array(F.transform(
            F.col("__windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    })
    out = out.withColumn("n_repeat_words", F.coalesce(_covered(F.col("__sorted")), F.lit(0)).cast("long"))
    # A filter on the counts would be pushed below these projections, with their
    # whole expressions evaluated again inside it; a generated row stops that.
    row = F.explode(F.array(F.struct(*STATISTICS))).alias("__row")
    return out.select(*[f"`{c}`" for c in docs.columns], row).select(*[f"`{c}`" for c in docs.columns], "__row.*")


def _pairs(hashes: Column, width: int) -> Column:
    """Hashes of windows of twice the width from those of windows of ``width``."""
    n = F.size(hashes) - width
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 1 + width, n), lambda a, b: F.xxhash64(a, b))


def _covered(ordered: Column) -> Column:
    """Words under windows whose hash stands twice or more in the sorted list."""
    same = lambda a, b: F.get(ordered, a)["h"] == F.get(ordered, b)["h"]
    found = F.filter(ordered, lambda x, k: F.coalesce(same(k, k - F.lit(1)), F.lit(False)) | F.coalesce(same(k, k + F.lit(1)), F.lit(False)))
    places = F.sort_array(F.transform(found, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(places, start, lambda acc, at: F.struct(
        (acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n"), at.alias("last")), lambda acc: acc["n"])


def features(stats: DataFrame) -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"), "mean_word": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars, "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words, "upper_share": F.col("n_upper") / chars,
        "stop_share": F.col("n_end_marks") / words,
        "lines_per_word": F.col("n_lines") / words, "end_mark_share": F.col("n_end_marks") / chars,
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Reject when all conditions ``(feature, at_least, threshold)`` hold."""
    conditions: tuple[tuple[str, bool, float], ...]

    def column(self, values: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a & b, [values[f] >= F.lit(t) if up else values[f] < F.lit(t) for f, up, t in self.conditions])

    def covers(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for f, up, t in self.conditions:
            column = x[:, names.index(f)]
            hit &= column >= t if up else column < t
        return hit


def _gain(before: np.ndarray, after: np.ndarray, bad: np.ndarray) -> float:
    p0, n0, p1, n1 = (bad & before).sum(), (~bad & before).sum(), (bad & after).sum(), (~bad & after).sum()
    return float(p1 * (log2(p1 / (p1 + n1)) - log2(p0 / (p0 + n0)))) if p1 else 0.0


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], cuts: list[np.ndarray], depth: int) -> Rule:
    conditions, covered = [], np.ones(len(x), bool)
    while len(conditions) < depth and (~bad & covered).any():
        best = (1e-9, None, None)
        for k, name in enumerate(names):
            for t in cuts[k]:
                for up in (True, False):
                    hit = covered & ((x[:, k] >= t) if up else (x[:, k] < t))
                    if (gain := _gain(covered, hit, bad)) > best[0]:
                        best = (gain, (name, up, float(t)), hit)
        if best[1] is None:
            break
        conditions.append(best[1])
        covered = best[2]
    return Rule(tuple(conditions))


def _value(rule: Rule, x: np.ndarray, bad: np.ndarray, names: list[str]) -> float:
    hit = rule.covers(x, names)
    p, n = (bad & hit).sum(), (~bad & hit).sum()
    return float((p - n) / (p + n)) if p + n else -1.0


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.97, max_rules: int = 12,
                depth: int = 4, cuts: int = 48, min_cover: int = 5) -> list[Rule]:
    """Sequential covering over numeric rows; deterministic in their order."""
    rules, left = [], np.ones(len(x), bool)
    third = np.arange(len(x)) % 3 == 2
    while len(rules) < max_rules and (bad & left & ~third).sum() >= min_cover:
        grow, prune = left & ~third, left & third
        edges = [np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, cuts)) for v in (x[grow, k], x[grow & bad, k])]))
                 for k in range(len(names))]
        rule = _grow(x[grow], bad[grow], names, edges, depth)
        while len(rule.conditions) > 1:
            shorter = Rule(rule.conditions[:-1])
            if _value(shorter, x[prune], bad[prune], names) < _value(rule, x[prune], bad[prune], names):
                break
            rule = shorter
        if not rule.conditions:
            break
        hit = rule.covers(x, names) & left
        good = [(bad & hit & part).sum() >= precision * max(1, (hit & part).sum()) for part in (grow, prune)]
        if not all(good) or (hit & bad).sum() < min_cover:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules that reject label 0 of ``labels`` (doc_id, quality). The sample is
    the ``sample_rows`` labelled ids with the smallest hash, so its ids (its bound
    is known) may be broadcast; rows that the base rules reject say nothing."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("__quality")).withColumn("__h", F.xxhash64("doc_id")).orderBy("__h", "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    stats = statistics(rows)
    values = features(stats)
    data = stats.where(~base_failed()).select("__h", "doc_id", "__quality", *[values[f].alias(f"f_{f}") for f in FEATURES]).orderBy(
        "__h", "doc_id").limit(sample_rows).collect()
    if not data:
        return []
    x = np.array([r[3:] for r in data], float)
    return learn_rules(x, np.array([r[2] == 0 for r in data]), FEATURES)


def verdict(rules: list[Rule], values: dict[str, Column]) -> Column:
    """Kept or not: the first rule that fires rejects, the base rules before all."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(values), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with its statistics, ``base_failed`` and ``kept``."""
    stats = statistics(docs)
    return stats.withColumns({"base_failed": base_failed(), "kept": verdict(rules, features(stats))})


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns."""
    own = [F.col(f"`{c}`").alias(f"__own_{i}") for i, c in enumerate(docs.columns)]
    text = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    judged = judge(docs.select(*own, F.col(f"`{docs.columns[text]}`").alias("text")), rules).where("kept")
    return judged.select(*[F.col(f"__own_{i}").alias(c) for i, c in enumerate(docs.columns)])
