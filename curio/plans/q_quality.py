"""Queries for data quality (B7, B8, C7, D2-D4, I12) and token operators
(H11-H14, D10, D11). Token ids are the word lengths of a document."""

from __future__ import annotations

from pyspark.sql import functions as F

from curio.functions import tokens as tk
from curio.functions.text import words
from curio.operators import quality as ql
from curio.operators._util import spread_small_input
from curio.operators.order import assign_dense_ids
from curio.operators.tokenizer import (SPACE_MARK, decode_tokens, encode_texts, train_bpe_vocab,
                                      vocab_stats, word_frequencies)
from curio.plans import sql as S
from curio.plans.registry import query
from curio.sources import table


def token_docs(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", "lang", F.transform(words("text"), lambda w: F.length(w))
                    .alias("tokens"))


_TOK = f"tok AS (SELECT doc_id, lang, list_transform({S.words('text')}, lambda w: length(w)) AS tokens FROM documents)"


@query("short_sequences", f"WITH {_TOK} SELECT doc_id, len(tokens) AS n_tokens FROM tok WHERE len(tokens) < 5")
def q_short_sequences(spark, sf):
    t = token_docs(spark, sf)
    return ql.short_sequences(t, "tokens", 5).select("doc_id", F.size("tokens").alias("n_tokens"))


@query("missing_values", """
SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE d.text IS NULL OR l.quality IS NULL OR l.toxic IS NULL""")
def q_missing_values(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    lb = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return ql.missing_values(d.join(lb, "doc_id", "left"), ["text", "quality", "toxic"]) \
        .select("doc_id")


@query("null_counts", """
WITH j AS (SELECT d.doc_id, d.text, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'doc_id' AS "column", count(*) FILTER (WHERE doc_id IS NULL) AS n_null FROM j
UNION ALL SELECT 'text', count(*) FILTER (WHERE text IS NULL) FROM j
UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL) FROM j
UNION ALL SELECT 'quality', count(*) FILTER (WHERE quality IS NULL) FROM j
UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic IS NULL) FROM j""")
def q_null_counts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    lb = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return ql.null_counts(d.join(lb, "doc_id", "left"), ["doc_id", "text", "lang", "quality", "toxic"])


@query("n_unique", """
SELECT count(DISTINCT lang) AS n_lang, count(DISTINCT source) AS n_source, count(DISTINCT text) AS n_text FROM documents""")
def q_n_unique(spark, sf):
    d = table(spark, sf, "documents")
    # distinct texts are counted on their SHA-256 key: the shuffle moves 64
    # characters per row, not the text
    return d.agg(F.countDistinct("lang").alias("n_lang"), F.countDistinct("source").alias("n_source"),
                 F.countDistinct(ql.text_key("text")).alias("n_text"))


@query("duplicate_ids", """
SELECT sha256(text) AS key, count(*) AS n, min(doc_id) AS min_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def q_duplicate_ids(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return ql.duplicate_keys(d, ql.text_key("text"), "doc_id")


@query("reconcile_ids", """
WITH ca AS (SELECT doc_id, count(*) AS c FROM documents GROUP BY 1),
cb AS (SELECT doc_id, count(*) AS c FROM labels GROUP BY 1),
j AS (SELECT ca.c AS ca, cb.c AS cb FROM ca FULL OUTER JOIN cb ON ca.doc_id = cb.doc_id)
SELECT CAST(coalesce(sum(ca), 0) AS BIGINT) AS n_a, CAST(coalesce(sum(cb), 0) AS BIGINT) AS n_b,
       count(*) FILTER (WHERE cb IS NULL) AS only_in_a, count(*) FILTER (WHERE ca IS NULL) AS only_in_b FROM j""")
def q_reconcile_ids(spark, sf):
    return ql.reconcile_ids(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("quality_report", f"""WITH {_TOK},
j AS (SELECT d.doc_id, d.text, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'short_sequences' AS "check", count(*) AS n_bad FROM tok WHERE len(tokens) < 5
UNION ALL SELECT 'missing_values', count(*) FROM j WHERE text IS NULL OR quality IS NULL OR toxic IS NULL
UNION ALL SELECT 'duplicate_text', count(*) FROM (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'labels_without_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def q_quality_report(spark, sf):
    t = token_docs(spark, sf)
    d = table(spark, sf, "documents")
    lb = table(spark, sf, "labels")
    j = d.select("doc_id", "text").join(lb.select("doc_id", "quality", "toxic"), "doc_id", "left")
    return ql.quality_report({
        "short_sequences": ql.short_sequences(t, "tokens", 5),
        "missing_values": ql.missing_values(j, ["text", "quality", "toxic"]),
        "duplicate_text": ql.duplicate_keys(d, ql.text_key("text")),
        "labels_without_document": lb.join(d.select("doc_id"), "doc_id", "left_anti"),
    })


@query("add_bos_eos", f"""WITH {_TOK}
SELECT doc_id, len(tokens) + 2 AS n, CAST(1 AS BIGINT) AS first_id, CAST(2 AS BIGINT) AS last_id FROM tok""")
def q_add_bos_eos(spark, sf):
    t = token_docs(spark, sf).select("doc_id", tk.add_bos_eos("tokens", 1, 2).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.element_at("t", 1).alias("first_id"),
                    F.element_at("t", -1).alias("last_id"))


@query("pad_truncate", f"""WITH {_TOK}
SELECT doc_id, array_to_string(list_concat(tokens[1:16], list_transform(range(greatest(0, 16 - len(tokens))), lambda x: 0)), ' ')
       AS tokens FROM tok""")
def q_pad_truncate(spark, sf):
    t = token_docs(spark, sf)
    return t.select("doc_id", F.array_join(tk.pad_truncate("tokens", 16, 0), " ").alias("tokens"))


@query("shift_pairs", f"""WITH {_TOK}
SELECT doc_id, greatest(len(tokens) - 1, 0) AS n_x, CAST(coalesce(list_sum(tokens[1:len(tokens) - 1]), 0) AS BIGINT) AS sum_x,
       CAST(coalesce(list_sum(tokens[2:]), 0) AS BIGINT) AS sum_y FROM tok""")
def q_shift_pairs(spark, sf):
    x, y = tk.shift_pairs(F.col("tokens"))
    t = token_docs(spark, sf).select("doc_id", x.alias("x"), y.alias("y"))
    s = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, v: a + v)
    return t.select("doc_id", F.size("x").alias("n_x"), s(F.col("x")).alias("sum_x"),
                    s(F.col("y")).alias("sum_y"))


@query("parse_token_string", f"""WITH {_TOK},
s AS (SELECT doc_id, '[' || CASE WHEN lang = 'fr' THEN array_to_string(tokens, ', ')
                                   ELSE array_to_string(tokens, '  ') END || ']' AS tstr FROM tok)
SELECT doc_id, CASE WHEN lang_bad THEN 0 ELSE n END AS n_parsed, CASE WHEN lang_bad THEN 0 ELSE sm END AS sum_parsed
FROM (SELECT s.doc_id, (d.lang = 'fr' AND len(t.tokens) > 1) AS lang_bad, len(t.tokens) AS n,
             CAST(coalesce(list_sum(t.tokens), 0) AS BIGINT) AS sm
      FROM s JOIN documents d ON d.doc_id = s.doc_id JOIN tok t ON t.doc_id = s.doc_id)""")
def q_parse_token_string(spark, sf):
    """Token strings written from the token arrays (the French rows with a
    comma separator, which the parser rejects) and parsed back."""
    t = token_docs(spark, sf)
    joined = F.when(F.col("lang") == "fr", F.array_join("tokens", ", ")) \
        .otherwise(F.array_join("tokens", "  "))
    s = t.select("doc_id", F.concat(F.lit("["), joined, F.lit("]")).alias("tstr"))
    p = s.select("doc_id", tk.parse_token_string("tstr").alias("p"))
    return p.select("doc_id", F.size("p").alias("n_parsed"),
                    F.aggregate("p", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("sum_parsed"))


@query("vocab_stats", f"""WITH {_TOK}
SELECT u.t AS token_id, count(*) AS n_occurrences FROM tok, LATERAL (SELECT unnest(tokens) AS t) u GROUP BY 1""")
def q_vocab_stats(spark, sf):
    t = token_docs(spark, sf)
    return t.select(F.explode("tokens").alias("token_id")).groupBy("token_id").agg(
        F.count(F.lit(1)).alias("n_occurrences"))


@query("vocab_stats_pieces", f"""
WITH w AS (SELECT DISTINCT u.w AS piece FROM documents, LATERAL (SELECT unnest({S.words('text')}) AS w) u),
u AS (SELECT u.w AS piece, count(*) AS n FROM benchmark, LATERAL (SELECT unnest({S.words('text')}) AS w) u GROUP BY 1),
p AS (SELECT piece, strlen(replace(piece, '{SPACE_MARK}', ' ')) AS n_bytes FROM w)
SELECT p.piece, p.n_bytes, coalesce(u.n, 0) AS n_occurrences, (SELECT count(*) FROM p) AS vocab_size,
       (SELECT max(n_bytes) FROM p) AS max_piece_bytes FROM p LEFT JOIN u ON u.piece = p.piece""")
def q_vocab_stats_pieces(spark, sf):
    """The words of ``documents`` as a vocabulary, and how often each occurs in ``benchmark``."""
    w = word_frequencies(table(spark, sf, "documents")).select(F.col("word").alias("piece"))
    vocab = assign_dense_ids(w, [], "piece", "token_id")
    used = table(spark, sf, "benchmark").select(F.explode(words("text")).alias("piece"))
    tokens = used.join(vocab, "piece").select(F.array("token_id").alias("tokens"))
    return vocab_stats(tokens, vocab).drop("token_id")


@query("word_frequencies", f"""
SELECT u.w AS word, count(*) AS n FROM documents, LATERAL (SELECT unnest({S.words('text')}) AS w) u GROUP BY 1""")
def q_word_frequencies(spark, sf):
    return word_frequencies(table(spark, sf, "documents"), "text", spark.sparkContext.defaultParallelism)


BPE_MERGES = 8000


def _vocab(spark, sf):
    return train_bpe_vocab(spark, table(spark, sf, "documents"), BPE_MERGES)


@query("train_bpe_vocab")
def q_train_bpe_vocab(spark, sf):
    return _vocab(spark, sf)


@query("encode_texts", """
SELECT doc_id, 1::BIGINT AS n_bos, (CASE WHEN text = '' THEN 0 ELSE strlen(text) + 1 END)::BIGINT AS n_bytes FROM documents""")
def q_encode_texts(spark, sf):
    """Whole texts in pieces of the trained vocabulary: the bytes of a text's
    pieces add up to the text and the space in front."""
    vocab = _vocab(spark, sf)
    enc = encode_texts(spark, spread_small_input(table(spark, sf, "documents").select("doc_id", "text")), vocab)
    n_bytes = F.when(F.col("token_id") < 3, 0).when(F.col("token_id") < 259, 1).otherwise(
        F.octet_length(F.replace("piece", F.lit(SPACE_MARK), F.lit(" "))))
    # a model table: its size is that of the vocabulary
    sizes = F.broadcast(vocab.select("token_id", n_bytes.alias("n_bytes")))
    return enc.select("doc_id", F.explode("ids").alias("token_id")).join(sizes, "token_id").groupBy("doc_id").agg(
        F.count(F.when(F.col("token_id") == 1, 1)).alias("n_bos"), F.sum("n_bytes").cast("bigint").alias("n_bytes"))


@query("decode_tokens", "SELECT doc_id, true AS round_trip_ok FROM documents")
def q_decode_tokens(spark, sf):
    """Exact round trip of every text with a vocabulary trained on other text."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    v = train_bpe_vocab(spark, table(spark, sf, "benchmark"), BPE_MERGES)
    dec = decode_tokens(encode_texts(spark, spread_small_input(d), v), v, "ids", out="decoded")
    return dec.join(d, "doc_id").select(
        "doc_id", (F.col("text") == F.col("decoded")).alias("round_trip_ok"))
