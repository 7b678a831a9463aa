"""Line dedup against plain Python."""

import hashlib
import random

import pytest

from curio.llm import line_dedup, queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10):
    """``[(doc, kept text, lines, dropped)]``; null ids sort first."""
    rank = lambda d: (d is not None, d or 0)
    first = {}
    split = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    for d, lines in split:
        for line in lines:
            if len(key(line)) >= least:
                first[key(line)] = min(first.get(key(line), (9, 0)), rank(d))
    out = []
    for d, lines in split:
        keep = [line for line in lines if first.get(key(line), rank(d)) == rank(d)]
        out.append((d, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=repr)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect()
    return sorted([(r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in got], key=repr)


@pytest.mark.parametrize("parts", [1, 64])
def test_against_brute_force_with_a_hot_line(spark, parts):
    rnd = random.Random(5)
    pool = ["the very common line", "  THE very common line\r", "short", "", "ÄÖÜ äöü öäü", "äÖÜ äöü öäü"] + [
        f"line number {k:04d} of them" for k in range(60)]
    rows = [(d, "\n".join(rnd.choice(pool[:2] if rnd.random() < .3 else pool) for _ in range(rnd.randrange(12))))
            for d in range(400)]
    rows += [(None, "the very common line\nonly here, nowhere else"), (None, None), (7, "line number 0001 of them\nnew text"),
             (7, "line number 0001 of them\nnew text"), (900, ""), (901, "x" * 200_000 + "\n" + "x" * 200_000)]
    rnd.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = run(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows)


def test_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a line of text", 5, 6), (2, "a line of text\nb", 7, 8)],
                                 "doc_id long, text string, n_lines int, places int")
    got = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).orderBy("doc_id").collect()
    assert [(r["text"], r["n_lines"], r["n_dropped"], r["places"]) for r in got] == [("a line of text", 1, 0, 6), ("b", 2, 1, 8)]
    assert line_dedup.keep_bitmaps(docs.limit(0)).collect() == []


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: (n, gone, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, gone in brute(rows)}
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"])
           for r in queries.op12_line_dedup(spark, sf).collect()}
    assert got == want
