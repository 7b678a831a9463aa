"""DuckDB SQL fragments for the oracle strings.

They restate the same rules as the Spark column builders in plain SQL over
the driver tables, so that a query and its oracle are computed independently.
"""

from __future__ import annotations

from curio.functions.bleu import DEFAULT_REFERENCE
from curio.functions.text import NON_WS_RUN, WS_RUN, WORD_CHAR_RUN


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def words(x: str) -> str:
    return (f"list_filter(regexp_split_to_array(coalesce({x}, ''), {q(WS_RUN)}), "
            f"lambda w: w <> '')")


def letters(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z]', '', 'g')"


def syl(lw: str) -> str:
    return (f"(CASE WHEN {lw} = '' THEN 0 ELSE greatest(1, len(regexp_extract_all({lw}, "
            f"'[aeiouy]+')) - CASE WHEN regexp_matches({lw}, '[^aeiouyl]e$') THEN 1 ELSE 0 END) END)")


def sentences(text: str) -> str:
    return (f"greatest(1, len(list_filter(regexp_split_to_array(coalesce({text}, ''), '[.!?]+'), "
            f"lambda c: len(regexp_extract_all(c, {q(NON_WS_RUN)})) > 2)))")


def flagged(text: str, terms) -> str:
    lst = ", ".join(q(t.lower()) for t in sorted(set(terms)))
    return (f"len(list_filter(regexp_extract_all(coalesce({text}, ''), {q(WORD_CHAR_RUN)}), "
            f"lambda r: list_contains([{lst}], lower(r))))")


def text_stats_cte(table: str = "documents", key: str = "doc_id", text: str = "text",
                   terms=("the", "and", "und"), extra: str = "", name: str = "st") -> str:
    """CTE ``name`` with per-row counts used by the readability/diversity metrics."""
    return f"""
{name}_base AS (SELECT {key}, {text} AS text, {words(text)} AS w{extra} FROM {table}),
{name} AS (
  SELECT *, len(w) AS n, {sentences('text')} AS s,
         coalesce(list_sum(list_transform(w, lambda x: {syl(letters('x'))})), 0) AS syl,
         len(list_distinct(list_filter(list_transform(w, lambda x: {letters('x')}),
             lambda lw: {syl('lw')} >= 3))) AS hard,
         len(list_distinct(w)) AS d,
         {flagged('text', terms)} AS f
  FROM {name}_base)"""


FK = ("CASE WHEN n > 0 THEN 0.39 * n / s + 11.8 * syl / n - 15.59 ELSE 0.0 END")
FOG = ("CASE WHEN n > 0 THEN 0.4 * (n / s + 100.0 * hard / n) ELSE 0.0 END")
DIV = "CASE WHEN n > 0 THEN d / n ELSE 0.0 END"
PROF = "CASE WHEN n > 0 THEN f / n ELSE 0.0 END"


def bleu_ctes(table: str = "documents", key: str = "doc_id", text: str = "text",
              reference: str = DEFAULT_REFERENCE) -> str:
    """CTEs ending in ``bleu(key, bleu_score)``."""
    r = len(reference.split())
    return f"""
bd AS (SELECT {key} AS k, {words(text)} AS w FROM {table}),
ng AS (SELECT * FROM (VALUES (1), (2), (3), (4)) t(n)),
rw AS (SELECT {words(q(reference))} AS w),
refg AS (
  SELECT ng.n, array_to_string(rw.w[u.i:u.i + ng.n - 1], chr(1)) AS g, count(*) AS c
  FROM rw, ng, LATERAL (SELECT unnest(range(1, len(rw.w) - ng.n + 2)) AS i) u
  GROUP BY 1, 2),
hypg AS (
  SELECT bd.k, ng.n, array_to_string(bd.w[u.i:u.i + ng.n - 1], chr(1)) AS g, count(*) AS c
  FROM bd, ng, LATERAL (SELECT unnest(range(1, len(bd.w) - ng.n + 2)) AS i) u
  GROUP BY 1, 2, 3),
mm AS (
  SELECT h.k, h.n, sum(least(h.c, r.c)) AS m
  FROM hypg h JOIN refg r ON h.n = r.n AND h.g = r.g GROUP BY 1, 2),
bm AS (
  SELECT bd.k, CAST(len(bd.w) AS DOUBLE) AS hl,
    CAST(coalesce(max(CASE WHEN mm.n = 1 THEN mm.m END), 0) AS DOUBLE) AS m1,
    CAST(coalesce(max(CASE WHEN mm.n = 2 THEN mm.m END), 0) AS DOUBLE) AS m2,
    CAST(coalesce(max(CASE WHEN mm.n = 3 THEN mm.m END), 0) AS DOUBLE) AS m3,
    CAST(coalesce(max(CASE WHEN mm.n = 4 THEN mm.m END), 0) AS DOUBLE) AS m4
  FROM bd LEFT JOIN mm ON bd.k = mm.k GROUP BY bd.k, len(bd.w)),
bleu AS (
  SELECT k AS {key}, CASE WHEN hl = 0 OR m1 = 0 THEN 0.0 ELSE
    (CASE WHEN hl > {r} THEN 1.0 ELSE exp(1.0 - {r}.0 / hl) END) * exp((
      ln(CASE WHEN m1 = 0 THEN 0.1 ELSE m1 END / greatest(1, hl))
    + ln(CASE WHEN m2 = 0 THEN 0.1 ELSE m2 END / greatest(1, hl - 1))
    + ln(CASE WHEN m3 = 0 THEN 0.1 ELSE m3 END / greatest(1, hl - 2))
    + ln(CASE WHEN m4 = 0 THEN 0.1 ELSE m4 END / greatest(1, hl - 3))) / 4.0) END AS bleu_score
  FROM bm)"""


def lexicon_values(lexicon: dict) -> str:
    rows = ", ".join(f"({q(k)}, CAST({float(v[0])!r} AS DOUBLE), CAST({float(v[1])!r} AS DOUBLE))"
                     for k, v in sorted(lexicon.items()))
    return f"(VALUES {rows}) lx(word, polarity, subjectivity)"


def sentiment_ctes(lexicon: dict, table: str = "documents", key: str = "doc_id",
                   text: str = "text") -> str:
    """CTEs ending in ``senti(key, sentiment_score, subjectivity_score)``."""
    return f"""
sw AS (SELECT {key} AS k, {words(text)} AS w FROM {table}),
sx AS (
  SELECT sw.k, u.i, regexp_replace(lower(sw.w[u.i]), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS cw,
         CASE WHEN u.i > 1 THEN regexp_replace(lower(sw.w[u.i - 1]), '[^\\p{{L}}\\p{{N}}_]', '', 'g')
         END AS prev
  FROM sw, LATERAL (SELECT unnest(range(1, len(sw.w) + 1)) AS i) u),
sm AS (
  SELECT sx.k, avg(lx.polarity * CASE WHEN sx.prev IN ('not', 'no', 'never') THEN -0.5 ELSE 1.0 END) AS pol,
         avg(lx.subjectivity) AS subj
  FROM sx JOIN {lexicon_values(lexicon)} ON sx.cw = lx.word GROUP BY sx.k),
senti AS (
  SELECT sw.k AS {key}, coalesce(sm.pol, 0.0) AS sentiment_score,
         coalesce(sm.subj, 0.0) AS subjectivity_score
  FROM sw LEFT JOIN sm ON sw.k = sm.k)"""


QUERY_TERMS = ("the", "and", "und")


def scored_cte() -> str:
    """CTEs ending in ``sc(id, lang, source, n_chars, flesch_kincaid_grade,
    vocabulary_diversity, profanity_check)`` over ``documents``."""
    return text_stats_cte(terms=QUERY_TERMS, extra=", lang, source, n_chars") + f""",
sc AS (SELECT doc_id AS id, lang, source, n_chars, {FK} AS flesch_kincaid_grade,
              {DIV} AS vocabulary_diversity, {PROF} AS profanity_check FROM st)"""


def missing(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN 1 ELSE 0 END)"


def asc_key(x: str) -> str:
    return f"{missing(x)}, {x}"


def desc_key(x: str) -> str:
    return f"{missing(x)}, {x} DESC"


def curriculum_cte(name: str, order_sql: str, source: str = "sc", B: int = 8, G: int = 4,
                   step: int = 5, metrics=("flesch_kincaid_grade", "vocabulary_diversity"),
                   extra_mean: str = "") -> str:
    """CTEs ``{name}_od`` (train rows with ``pos``), ``{name}_ck`` (checkpoints),
    ``{name}_fc`` (first checkpoint per row) and ``{name}_mean`` (ckpt, n_rows,
    metric means over the rows each checkpoint consumed)."""
    means = ", ".join(f"avg(fc.{m}) AS {m}" for m in metrics)
    return f"""
{name}_sp AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS split_pos,
                     count(*) OVER () AS n_all FROM {source}),
{name}_tr AS (SELECT * FROM {name}_sp WHERE split_pos < CAST(floor(0.9 * n_all) AS BIGINT)),
{name}_od AS (SELECT *, row_number() OVER (ORDER BY {order_sql}, id) - 1 AS pos,
                     count(*) OVER () AS n_train FROM {name}_tr),
{name}_ck AS (SELECT unnest(range({step}, (SELECT CAST(ceil(max(n_train) / {G * B}.0) AS BIGINT)
                                          FROM {name}_od), {step})) AS ckpt),
{name}_fc AS (SELECT *, greatest({step}, CAST(ceil(ceil(floor(pos / {B}) / {G}.0) / {step}.0)
                                           * {step} AS BIGINT)) AS first_ckpt FROM {name}_od),
{name}_mean AS (SELECT ck.ckpt, count(fc.id) AS n_rows, {means}{extra_mean}
                FROM {name}_ck ck LEFT JOIN {name}_fc fc ON fc.first_ckpt <= ck.ckpt
                GROUP BY ck.ckpt)"""


def unpivot_metrics(src: str, keys: str, metrics) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {src}" for m in metrics)


def norm_sql(value: str, part: str) -> str:
    lo, hi = f"min({value}) OVER ({part})", f"max({value}) OVER ({part})"
    return (f"CASE WHEN {hi} = {lo} THEN (CASE WHEN {value} IS NOT NULL THEN 0.0 END) "
            f"ELSE ({value} - {lo}) / ({hi} - {lo}) END")
