"""Queries for the sources and sinks (A1-A5, A8, A9): each writes data derived
from the driver tables to a fresh folder under the checkpoint folder and
reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from curio.operators.flows import SEQ_LENGTH, compute_metadata, pretokenize
from curio.operators.tokenizer import decode_tokens, train_bpe_vocab
from curio.plans import sql as S
from curio.functions.text import WS_RUN
from curio.plans.flagship import scored_documents
from curio.plans.registry import query
from curio.session import scratch_path
from curio.sources import io, table

SHARD_ROWS = 100
VOCAB_SHARDS = 10
SCORED_SCHEMA = ("id bigint, lang string, flesch_kincaid_grade double, "
                 "vocabulary_diversity double")


def _shards(spark, sf):
    """``documents`` as stories in shards."""
    return table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("story"),
        F.concat_ws("_", "source", F.floor(F.col("doc_id") / SHARD_ROWS).cast("string")).alias("shard"))


@query("read_json_shards", f"""
SELECT source || '_' || CAST(doc_id // {SHARD_ROWS} AS VARCHAR) AS shard,
       CAST(row_number() OVER (PARTITION BY source, doc_id // {SHARD_ROWS} ORDER BY doc_id) - 1 AS BIGINT) AS pos,
       md5(text) AS story_md5
FROM documents""")
def q_read_json_shards(spark, sf):
    path = scratch_path(spark, "json-shards")
    io.write_json_shards(_shards(spark, sf), path, "shard", "doc_id", ["story"])
    r = io.read_json_shards(spark, path, glob="*.txt")
    return r.select(F.regexp_extract("shard", r"shard=([^/]+)\.txt$", 1).alias("shard"), "pos",
                    F.md5("story").alias("story_md5"))


@query("read_scored_table", f"""WITH {S.scored_cte()}
SELECT id, round(flesch_kincaid_grade, 6) AS flesch_kincaid_grade FROM sc WHERE lang = 'en'""")
def q_read_scored_table(spark, sf):
    s = scored_documents(spark, sf, extra=("lang",))
    path = scratch_path(spark, "scored")
    io.write_table(s, path, ())
    t = io.read_scored_table(spark, path, SCORED_SCHEMA)
    return t.filter(F.col("lang") == "en").select("id", "flesch_kincaid_grade")


@query("read_legacy_csv", f"""WITH {S.scored_cte()}
SELECT id AS global_idx, round(vocabulary_diversity, 6) AS vocabulary_diversity FROM sc""")
def q_read_legacy_csv(spark, sf):
    s = scored_documents(spark, sf).select(F.col("id").alias("global_idx"), "vocabulary_diversity")
    path = scratch_path(spark, "legacy-csv")
    io.write_legacy_csv(s, path)
    return io.read_legacy_csv(spark, path, "global_idx bigint, vocabulary_diversity double")


@query("write_table", """
SELECT lang AS run, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY lang""")
def q_write_table(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("run"), "doc_id", "n_chars")
    path = scratch_path(spark, "runs")
    io.write_table(d, path, ("run",))
    return spark.read.parquet(path).groupBy("run").agg(F.count(F.lit(1)).alias("n"),
                                                       F.sum("n_chars").alias("n_chars"))


@query("run_layout", "SELECT doc_id, n_chars FROM documents WHERE lang = 'de'")
def q_run_layout(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("run"), "doc_id", "n_chars")
    path = scratch_path(spark, "run-layout")
    io.write_table(d, path, ("run",))
    return io.read_run(spark, path, "de").select("doc_id", "n_chars")


@query("export_text_corpus", f"""
WITH s AS (SELECT regexp_replace(text, {S.q('^' + WS_RUN + '|' + WS_RUN + '$')}, '', 'g') AS t FROM documents),
l AS (SELECT unnest(string_split(t, chr(10))) AS line FROM s)
SELECT count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM l""")
def q_export_text_corpus(spark, sf):
    path = scratch_path(spark, "corpus-text")
    io.export_text_corpus(table(spark, sf, "documents"), path)
    lines = io.read_text_lines(spark, path)
    return lines.agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("value")).alias("n_chars"))


@query("export_text_corpus_shards", f"""
WITH d AS (SELECT text, source || '_' || CAST(doc_id // {SHARD_ROWS} AS VARCHAR) AS shard FROM documents),
f AS (SELECT DISTINCT shard FROM d ORDER BY shard LIMIT {VOCAB_SHARDS}),
s AS (SELECT regexp_replace(text, {S.q('^' + WS_RUN + '|' + WS_RUN + '$')}, '', 'g') AS t FROM d WHERE shard IN (SELECT shard FROM f)),
l AS (SELECT unnest(string_split(t, chr(10))) AS line FROM s)
SELECT count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM l""")
def q_export_text_corpus_shards(spark, sf):
    """The texts of the first ten shards, as the vocabulary trainer takes them."""
    path = scratch_path(spark, "corpus-shards")
    io.export_text_corpus(_shards(spark, sf), path, "story", VOCAB_SHARDS)
    return io.read_text_lines(spark, path).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("value")).alias("n_chars"))


@query("debug_sample", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def q_debug_sample(spark, sf):
    return io.debug_sample(table(spark, sf, "documents").select("doc_id", "lang"), 100, "doc_id")


VOCAB_MERGES = 8000
_ORDERED_SQL = f"""o AS (SELECT doc_id, row_number() OVER (ORDER BY source || '_' || CAST(doc_id // {SHARD_ROWS} AS VARCHAR) || '/', doc_id) - 1 AS id,
    regexp_replace(text, {S.q('^' + WS_RUN + '|' + WS_RUN + '$')}, '', 'g') AS text FROM documents)"""


def _pretokenized(spark, sf, length):
    path = scratch_path(spark, "story-shards")
    io.write_json_shards(_shards(spark, sf), path, "shard", "doc_id", ["story"])
    vocab = train_bpe_vocab(spark, table(spark, sf, "benchmark"), VOCAB_MERGES)
    return vocab, pretokenize(spark, path, vocab, scratch_path(spark, "token-table"), length, glob="*.txt")


@query("pretokenize", f"""WITH {_ORDERED_SQL}
SELECT id, {SEQ_LENGTH} AS n_ids, 1 AS first_id, left(text, 30) AS head FROM o""")
def q_pretokenize(spark, sf):
    """Shards to the table of 128 ids a story. An id stands for one byte at
    least, so 128 of them hold the first 30 characters."""
    vocab, t = _pretokenized(spark, sf, SEQ_LENGTH)
    return decode_tokens(t, vocab, "tokens").select(
        "id", F.size("tokens").alias("n_ids"), F.element_at("tokens", 1).alias("first_id"), F.left("text", F.lit(30)).alias("head"))


@query("compute_metadata", f"""WITH {_ORDERED_SQL}, {S.text_stats_cte(table='o', key='id')}
SELECT id, round({S.FK}, 6) AS flesch_kincaid_grade, round({S.DIV}, 6) AS vocabulary_diversity FROM st""")
def q_compute_metadata(spark, sf):
    """Whole stories to tokens, back to text, scored."""
    vocab, t = _pretokenized(spark, sf, None)
    metrics = ("flesch_kincaid_grade", "vocabulary_diversity")
    return compute_metadata(t, vocab, scratch_path(spark, "metadata"), metrics=metrics).select("id", *metrics)
