"""The composed jobs and the operators they brought: shards to tokens, tokens to
metrics, checkpoint evaluation, vocabulary statistics, interval means."""

import json
import math
import random

from curio.functions.metrics import score_texts
from curio.operators import flows, lineage as ln
from curio.operators.tokenizer import decode_tokens, train_bpe_vocab, vocab_stats
from curio.session import scratch_path
from curio.sources import io


def test_interval_means_against_brute_force(spark):
    rng = random.Random(3)
    values = [rng.choice([None, 1.5, -2.0, 0.25, 7.0]) for _ in range(400)]
    other = [float(i) if i != 350 else math.nan for i in range(400)]
    rows = spark.createDataFrame([(i, values[i], other[i]) for i in range(400)], "pos long, x double, y double").repartition(7)
    cuts = [(1, 0, 40), (2, 0, 40), (2, 100, 180), (3, 390, 1000), (4, 5, 5), (5, 2000, 3000), (6, 300, 360), (7, None, 4), (8, 0, 400)]
    got = {r["ckpt"]: r for r in ln.interval_means(rows, spark.createDataFrame(cuts, "ckpt long, lo long, hi long"), ["x", "y"]).collect()}
    assert sorted(got) == list(range(1, 9))
    for k in got:
        at = [i for c, lo, hi in cuts if c == k and lo is not None for i in range(lo, min(hi, 400))]
        xs = [values[i] for i in at if values[i] is not None]
        assert got[k]["n_rows"] == len(at)
        assert got[k]["x"] is None if not xs else math.isclose(got[k]["x"], sum(xs) / len(xs), rel_tol=1e-12, abs_tol=1e-12)
        if 350 in at:
            assert math.isnan(got[k]["y"])
        elif at:
            assert math.isclose(got[k]["y"], sum(other[i] for i in at) / len(at), rel_tol=1e-12)
    none = spark.createDataFrame([], "ckpt long, lo long, hi long")
    assert ln.interval_means(rows, none, ["x"]).count() == 0
    empty = ln.interval_means(rows.limit(0), spark.createDataFrame([(1, 0, 9)], "ckpt long, lo long, hi long"), ["x"]).first()
    assert (empty["n_rows"], empty["x"]) == (0, None)


def test_consumed_intervals_agree_with_the_listing(spark):
    pos = spark.range(200).selectExpr("id", "id as pos")
    ck = ln.checkpoint_schedule(spark, 200, 4, 3, 5)
    for prefetched in (True, False):
        listed = {r["ckpt"]: r["count"] for r in ln.checkpoint_membership(pos, ck, 4, 3, 5, prefetched).groupBy("ckpt").count().collect()}
        cut = {r["ckpt"]: min(r["hi"], 200) for r in ln.consumed_intervals(ck, 4, 3, prefetched).collect()}
        assert listed == cut


def test_pretokenize_then_metadata(spark, tmp_path):
    shards = {"b.json": ["  the cat sat. ", ""], "a.json": ["the hat\nthe hat " * 40, None, "ünï 漢"], "c.json": ["left out"]}
    for name, stories in shards.items():
        (tmp_path / name).write_text(json.dumps([{"story": s, "n": {"k": [1]}} for s in stories]))
    vocab = train_bpe_vocab(spark, spark.createDataFrame([("the cat the hat sat",)], "text string"), 12)
    t = flows.pretokenize(spark, str(tmp_path), vocab, scratch_path(spark, "t-tok"), 16, max_shards=2, first_id=100)
    rows = {r["id"]: r["tokens"] for r in t.collect()}
    assert sorted(rows) == [100, 101, 102, 103, 104]
    assert all(len(ids) == 16 and ids[0] == 1 for ids in rows.values()) and rows[101] == [1] + [0] * 15 == rows[104]
    texts = {r["id"]: r["text"] for r in decode_tokens(t, vocab, "tokens").collect()}
    assert "the hat\nthe hat ".startswith(texts[100][:16]) and texts[103] == "the cat sat."

    whole = flows.pretokenize(spark, str(tmp_path), vocab, scratch_path(spark, "t-tok"), None)
    assert {r["text"] for r in decode_tokens(whole, vocab, "tokens").collect()} == {(s or "").strip() for v in shards.values() for s in v}

    metrics = ["vocabulary_diversity", "profanity_check"]
    got = flows.compute_metadata(whole.selectExpr("id", "tokens", "0 as profanity_check"), vocab, scratch_path(spark, "t-meta"), metrics=metrics)
    assert got.columns == ["id", "tokens", *metrics]
    plain = {r["text"]: r["vocabulary_diversity"] for r in score_texts(decode_tokens(whole, vocab, "tokens"), "text", metrics=metrics).collect()}
    by_id = {r["id"]: r["text"] for r in decode_tokens(whole, vocab, "tokens").collect()}
    assert all(r["vocabulary_diversity"] == plain[by_id[r["id"]]] for r in got.collect())
    # printed tokens, a null and repeated ids
    odd = spark.createDataFrame([(1, "[1 %d]" % (3 + ord("a"))), (1, "[1 %d]" % (3 + ord("a"))), (2, None)], "id long, tokens string")
    out = flows.compute_metadata(odd, vocab, scratch_path(spark, "t-meta"), metrics=["vocabulary_diversity"]).collect()
    assert sorted((r["id"], r["vocabulary_diversity"]) for r in out) == [(1, 1.0), (1, 1.0), (2, 0.0)]
    assert flows.compute_metadata(odd.limit(0), vocab, scratch_path(spark, "t-meta")).count() == 0


def test_evaluate_checkpoints_writes_both_sides(spark):
    generated = spark.createDataFrame([(5, "a a b"), (5, "a b"), (10, "")], "ckpt int, text string")
    rows = spark.createDataFrame([(i, i, float(i)) for i in range(60)], "id long, pos long, vocabulary_diversity double")
    ck = ln.checkpoint_schedule(spark, 60, 2, 2, 5)
    path = scratch_path(spark, "t-eval")
    sides = flows.evaluate_checkpoints(generated, rows, ck, ["vocabulary_diversity"], 2, 2, 5, path=path)
    out = {r["ckpt"]: r["vocabulary_diversity"] for r in sides["output"].collect()}
    assert out == {5: (2 / 3 + 1) / 2, 10: 0.0}
    assert {r["ckpt"]: r["vocabulary_diversity"] for r in spark.read.parquet(f"{path}/input").collect()} == {5: 10.5, 10: 20.5}


def test_vocab_stats_and_first_shards(spark):
    vocab = spark.createDataFrame([(0, "<unk>"), (1, "▁the"), (2, "é")], "token_id int, piece string")
    tokens = spark.createDataFrame([([1, 2, 1],), ([9],), (None,), ([],)], "tokens array<int>")
    got = sorted((r["token_id"], r["n_bytes"], r["n_occurrences"], r["vocab_size"], r["max_piece_bytes"]) for r in vocab_stats(tokens, vocab).collect())
    assert got == [(0, 5, 0, 3, 5), (1, 4, 2, 3, 5), (2, 2, 1, 3, 5)]
    df = spark.createDataFrame([("s2", " b "), ("s1", "a"), ("s1", "c"), (None, "n"), ("s3", "d")], "shard string, text string")
    path = scratch_path(spark, "t-export")
    io.export_text_corpus(df, path, max_shards=2)
    assert sorted(r["value"] for r in io.read_text_lines(spark, path).collect()) == ["a", "b", "c"]
