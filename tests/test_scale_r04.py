"""Texts without words, shards without a folder each, and the same results."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from curio.llm import banding, substring_dedup
from curio.plans import QUERIES
from curio.sources import io, json_ranges


def test_words_of_texts_without_any(spark, tmp_path):
    spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, " \n\u3000"), (None, "one")], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES["words"](spark, str(tmp_path)).collect()), key=str)
    assert got == [(1, 3, 2, "a", "a"), (2, 0, 0, None, None), (3, 0, 0, None, None), (4, 0, 0, None, None), (None, 1, 1, "one", "one")]


def _told(rows):
    return sorted((r["shard"].rsplit("/", 1)[-1], r["pos"], r["story"]) for r in rows)


def test_shards_are_files_of_one_folder(spark, tmp_path):
    names = ["web_1", "web_10", "a/b: c=%é", "x.txt", "", None]
    rows = [(n, k, None if k == 2 else f"{n} \"{k}\"\n[é,{{") for n in names for k in range(3)]
    df = spark.createDataFrame(rows, "shard string, i int, story string")
    for _ in range(2):      # the second time over the first
        io.write_json_shards(df, str(tmp_path / "s"), "shard", "i", ["story"])
        spark.range(1).write.mode("append").parquet(str(tmp_path / "s"))
    shown = ["web_1", "web_10", "a%2Fb%3A c%3D%25é", "x.txt"]
    seen = sorted(f for f in os.listdir(tmp_path / "s") if f.endswith(".txt"))
    assert seen == sorted(f"shard={n}.txt" for n in [*shown, "__HIVE_DEFAULT_PARTITION__"])
    assert not [f for f in os.listdir(tmp_path / "s") if os.path.isdir(tmp_path / "s" / f) or len(f) == 33]
    got = _told(io.read_json_shards(spark, str(tmp_path / "s"), glob="*.txt").collect())
    want = [(f"shard={m}.txt", k, None if k == 2 else f"{n} \"{k}\"\n[é,{{") for n, m in zip(names, shown) for k in range(3)]
    assert [r for r in got if "HIVE" not in r[0]] == sorted(want)
    # those without a name are one shard
    unnamed = sorted((r[1], r[2]) for r in got if "HIVE" in r[0])
    assert [p for p, _ in unnamed] == list(range(6)) and [t is None for _, t in unnamed] == [False] * 4 + [True] * 2
    assert sorted(t for _, t in unnamed[:2]) == [' "0"\n[é,{', 'None "0"\n[é,{']
    io.write_json_shards(df.limit(0), str(tmp_path / "s"), "shard", "i", ["story"])
    assert io.read_json_shards(spark, str(tmp_path / "s"), glob="*.txt").collect() == []


def test_shards_of_one_range_are_read_once_and_listed_by_few_tasks(spark, tmp_path, monkeypatch):
    n = 60
    io.write_json_shards(spark.range(2 * n).select((F.col("id") % n).alias("shard"), "id", F.concat(F.lit("story "), "id").alias("story")),
                         str(tmp_path), "shard", "id", ["story"])
    tasks, read, scan = [], io.read_elements, json_ranges.segmented_scan
    scans = []
    monkeypatch.setattr(io, "read_elements", lambda s, files, size: (tasks.append(files.rdd.getNumPartitions()), read(s, files, size))[1])
    monkeypatch.setattr(json_ranges, "segmented_scan", lambda *a: (scans.append(a), scan(*a))[1])
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))       # a split for each file
    try:
        got = _told(io.read_json_shards(spark, str(tmp_path), glob="*.txt").collect())
        assert got == sorted((f"shard={k}.txt", p, f"story {k + p * n}") for k in range(n) for p in range(2))
        assert not scans and tasks[0] == 2 * spark.sparkContext.defaultParallelism < n
        # one longer shard brings the scans, for its own ranges only
        io.write_json_shards(spark.range(300).select(F.lit("long").alias("shard"), "id", F.lit("[,").alias("story")),
                             str(tmp_path / "more"), "shard", "id", ["story"])
        assert _told(io.read_json_shards(spark, str(tmp_path), glob="*.txt", range_bytes=200).collect()) == sorted(
            [*got, *[("shard=long.txt", k, "[,") for k in range(300)]])
        assert len(scans) == 3 and {r["path"].rsplit("/", 1)[-1] for r in scans[0][0].collect()} == {"shard=long.txt"}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_crowded_buckets_are_compared_by_blocks(spark, monkeypatch):
    """Paragraphs that share a third of their shingles meet in buckets and are no repeats; some others are."""
    rng = random.Random(3)
    fixed = [f"fix{k}" for k in range(25)]
    texts = [" ".join(fixed + [f"w{rng.randrange(10 ** 9)}" for _ in range(25)]) for _ in range(300)]
    texts += [" ".join(t.split()[:-2] + ["other", "end"]) for t in texts[:40]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    told = lambda: sorted(map(tuple, substring_dedup.repeated_paragraphs(docs).drop("text_key").collect()))
    calls, alike = [], banding._alike_in_heavy
    monkeypatch.setattr(banding, "_alike_in_heavy", lambda rows, *a: (calls.append(rows.agg(F.min("size")).first()[0]), alike(rows, *a))[1])
    monkeypatch.setattr(banding, "HEAVY", 10 ** 9)
    want = told()
    assert not calls and len(want) == 80 and sum(r[-1] for r in want) == 40
    monkeypatch.setattr(banding, "HEAVY", 20)
    monkeypatch.setattr(banding, "BLOCK", 7)
    assert told() == want and len(calls) == 1 and calls[0] > 20


def test_blocks_find_each_pair_that_may_be_alike(spark):
    rng = np.random.default_rng(5)
    marks = rng.integers(0, 3, (90, 20))
    n, held = rng.integers(20, 60, 90), rng.integers(0, 3, (90, 32))
    part, bucket = rng.integers(0, 30, 90), rng.integers(0, 2, 90)
    rows = spark.createDataFrame(
        [(int(bucket[k]), int((bucket == bucket[k]).sum()), 0, k, int(n[k]), int(part[k]), m.tolist(), held[k].tolist())
         for k, m in enumerate(banding.packed_marks(marks))],
        "bucket long, size long, main long, rep long, n long, part long, marks array<long>, held array<long>")
    want = {(a, b) for a in range(90) for b in range(a + 1, 90)
            if bucket[a] == bucket[b] and part[a] != part[b] and 100 * min(n[a], n[b]) >= 50 * max(n[a], n[b])
            and (marks[a] == marks[b]).sum() >= 8 and 150 * np.minimum(held[a], held[b]).sum() >= 50 * (n[a] + n[b])}
    old = banding.BLOCK
    try:
        for banding.BLOCK in (8, 2048):
            got = banding._alike_in_heavy(rows, 5, 50, 20, 8)
            assert {tuple(r) for r in got.collect()} == want and 20 < len(want) < 2000
            assert got.rdd.getNumPartitions() > 1
    finally:
        banding.BLOCK = old


def _corpus(spark, tmp_path, monkeypatch):
    """Documents whose shards' names continue one another, and the folders that queries write shards to."""
    texts = ["The little house stood there. It was beautiful!", None, "", "one two two", "  A dog, a cat.\n", "word " * 300]
    spark.createDataFrame([(k, texts[k % 6], ("web", "books")[k % 2]) for k in range(0, 1300, 13)],
                          "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "the little house and the dog")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    paths, write = [], io.write_json_shards
    monkeypatch.setattr(io, "write_json_shards", lambda df, path, *a: (paths.append(path), write(df, path, *a))[1])
    docs = sorted((f"{('web', 'books')[k % 2]}_{k // 100}/", k, texts[k % 6] or "") for k in range(0, 1300, 13))
    return docs, paths


def _folders(paths):
    return [f for path in paths for f in os.scandir(path.removeprefix("file:")) if f.is_dir()]


def test_pretokenize_makes_no_folder_a_shard(spark, tmp_path, monkeypatch):
    docs, paths = _corpus(spark, tmp_path, monkeypatch)
    got = sorted(map(tuple, QUERIES["pretokenize"](spark, str(tmp_path)).select("id", "head").collect()))
    assert got == [(k, text.strip()[:30]) for k, (_, _, text) in enumerate(docs)]
    assert len(paths) == 1 and not _folders(paths)


def test_compute_metadata_makes_no_folder_a_shard(spark, tmp_path, monkeypatch):
    docs, paths = _corpus(spark, tmp_path, monkeypatch)
    got = sorted(map(tuple, QUERIES["compute_metadata"](spark, str(tmp_path)).select("id", "vocabulary_diversity").collect()))
    words = [text.split() for _, _, text in docs]
    assert [k for k, _ in got] == list(range(len(docs)))
    assert [d for _, d in got] == [round(len(set(w)) / len(w), 6) if w else 0.0 for w in words]
    assert len(paths) == 1 and not _folders(paths)
