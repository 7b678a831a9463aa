"""The registered queries of the training-data operators. Each applies its
operator, with production parameters, to its whole table."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.llm import (bpe, decontaminate, html_text, line_dedup, near_dedup, passages, prefix_trie, quality_rules,
                       sharding, substring_dedup, token_align, token_scan, toxicity, url_filter)
from curio.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def vocab_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text with the published 50k vocabulary."""
    both = bpe.encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), vocab_path())
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents; the smallest id of each is kept."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that repeat within or across documents, passages that do in
    what is left of them, and what is removed."""
    return substring_dedup.repeats(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text_key")


@query
def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand before, inside lines or across them."""
    return passages.repeated_passages(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text_key")


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every text and the verdict of the learned decision list."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_rules.judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, with their places."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"),
                                      table(spark, sf_dir, "benchmark", "item_id", "text"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline`` over ``documents``."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text; learned from training rows only."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model, ["doc_id"]).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


# The rules of the query.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url", "html"), URL_RULES).drop("url")


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 contiguous shards of near-equal bytes."""
    return sharding.assign(table(spark, sf_dir, "documents", "doc_id", "text"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# A checksum by bytes from a table of 256, an order by id, cuts by the middle byte.
ORACLE["op5_sharding"] = r"""
WITH steps AS (SELECT list(list_reduce(list_concat([i::BIGINT], range(8)), lambda x, s: xor(x >> 1, 3988292384::BIGINT * (x & 1)))
                 ORDER BY i) AS crcs FROM range(256) r(i)),
sized AS (SELECT doc_id, (strlen(coalesce(text, '')) + 8)::BIGINT AS size, list_transform(
            regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ((strpos('0123456789ABCDEF', h[1]) - 1) * 16
            + strpos('0123456789ABCDEF', h[2]) - 1)::BIGINT) AS bytes FROM documents),
summed AS (SELECT doc_id, size, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, x:
             xor(c >> 8, crcs[(xor(c, x) & 255) + 1])))::BIGINT AS text_crc32 FROM sized, steps),
placed AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before,
             sum(size) OVER () AS total FROM summed),
cut AS (SELECT *, least(23, (2 * before + size) * 24 // (2 * total))::INT AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard FROM cut"""

# Links with a scheme only: relative targets, of which the given pages have none, are
# held against a plain version in the tests.
ORACLE["op6_url_filter"] = r"""
WITH RECURSIVE rules(says, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
links AS (SELECT url, replace(unnest(list_concat(
    regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract_all(html, '(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*\brel\s*=\s*["'']?canonical\b', 1),
    regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*?\burl\s*=\s*["'']?([^"''\s>]+)', 1))),
    '&amp;', '&') AS target FROM pages WHERE url IS NOT NULL),
whole AS (SELECT url, target FROM links WHERE regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://')),
urls AS (SELECT url FROM pages UNION SELECT target FROM whole),
cut AS (SELECT url, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM urls),
keyed AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\.', '')
            || regexp_replace(path, '/+$', '') || regexp_replace(regexp_replace(regexp_extract(url, '://[^?#]*(\?[^#]*)', 1),
            '[?&](utm_[a-z]+|ref|gclid|fbclid)=[^&#]*', '', 'g'), '^&', '?') END AS key FROM cut),
ruled AS (SELECT url, host, path, key, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
            arg_max(says, length(rhost || rpath)) AS own FROM keyed LEFT JOIN rules
            ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL),
edges AS (SELECT a.key AS a, b.key AS b FROM whole JOIN keyed a ON a.url = whole.url JOIN keyed b ON b.url = whole.target
          WHERE a.key <> b.key),
reach AS (SELECT DISTINCT key AS k, key AS node FROM keyed WHERE key IS NOT NULL
          UNION SELECT reach.k, e.b FROM reach JOIN (SELECT a, b FROM edges UNION SELECT b, a FROM edges) e ON e.a = reach.node),
blocked AS (SELECT k FROM reach JOIN ruled ON ruled.key = reach.node GROUP BY k
            HAVING coalesce(bool_or(own = 'block'), false) AND NOT coalesce(bool_or(own = 'allow'), false))
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN k IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM pages JOIN ruled ON ruled.url IS NOT DISTINCT FROM pages.url LEFT JOIN blocked ON blocked.k = ruled.key"""


SEPARATOR = 50256


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, read back from flat token files that are
    written in scan order; the scan's own row numbers name the documents."""
    path = scratch_path(spark, "token-files")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    token_scan.write_token_files(docs, path, vocab_path(), SEPARATOR)
    counts = token_scan.scan(spark, path, SEPARATOR)
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    # a row's number holds its partition above bit 33 and its place in it below
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"))
    return counts.select((F.shiftleft(part, 33) + F.col("document")).alias("row"), "n_tokens").join(rows, "row").select(
        "doc_id", F.shiftright("row", 33).alias("file_no"), F.col("row").bitwiseAND((1 << 33) - 1).alias("document"), "n_tokens")


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page, with its layout."""
    pages = table(spark, sf_dir, "pages", "page_id", "html")
    return html_text.extract(pages).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds, and the digest of what stays."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE["op12_line_dedup"] = r"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS line FROM documents),
lines AS (SELECT doc_id, unnest(line) AS line, generate_subscripts(line, 1) AS place FROM texts),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
least AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (SELECT k.*, coalesce(k.doc_id > l.first_doc, false) AS gone FROM keyed k LEFT JOIN least l USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of the rebuilt conversations."""
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return prefix_trie.build(*prefix_trie.grafted(turns))


ORACLE["op11_prefix_trie"] = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
             PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT],
        list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda crc, b:
        list_reduce(list_concat([xor(crc, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) % 9 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND pos < h
      UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h),
s AS (SELECT c.conv_id, coalesce(list({'r': role, 't': text} ORDER BY part, pos) FILTER (WHERE pos IS NOT NULL), []) AS seq
      FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
m AS (SELECT conv_id, d, len(seq) = d AS ends, md5(seq[1:d]::VARCHAR) AS key, CASE WHEN d = 0 THEN NULL ELSE md5(seq[1:d - 1]::VARCHAR) END AS up,
             CASE WHEN d = 0 THEN 0 ELSE strlen(seq[d].t) END AS bytes
      FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM s)),
n AS (SELECT key, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
      FROM m GROUP BY key, d),
k AS (SELECT n.*, (SELECT count(*) FROM n AS o WHERE o.up = n.key AND o.d = n.d + 1) AS n_children FROM n),
pairs AS (SELECT DISTINCT a.key AS top, a.d AS top_d, b.key, b.d FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (SELECT top, top_d, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens
         FROM pairs JOIN k ON k.key = pairs.key AND k.d = pairs.d GROUP BY top, top_d)
SELECT k.conv_id, k.d::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN sums ON sums.top = k.key AND sums.top_d = k.d LEFT JOIN k AS p ON p.key = k.up AND p.d = k.d - 1"""


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the byte-level and the piece tokenizer on every text."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_align.align(docs, vocab_path(), vocab_path("piece_bpe_32k.model"))
