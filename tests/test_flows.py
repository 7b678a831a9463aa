import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from curio.operators import chat as ch, trainlog as tl
from curio.operators.tokenizer import decode_tokens, encode_texts, train_bpe_vocab
from curio.session import scratch_path
from curio.streaming import streams as st

from conftest import SF001


def python_ema(xs, start=5, q=0.9):
    out, e, started = [], None, False
    for i, x in enumerate(xs):
        if i >= start:
            e = x if not started else q * e + 0.1 * x
            started = True
            out.append(e)
        else:
            out.append(None)
    return out


@pytest.mark.parametrize("block", [3, 7, 1024])
def test_ema_blocks_match_sequential(spark, block):
    random.seed(block)
    runs = {"r1": [random.uniform(0, 10) for _ in range(57)], "r2": [1.0, 2.0, 3.0]}
    rows = [(r, i, x) for r, xs in runs.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "run string, iter long, x double")
    got = {(r["run"], r["iter"]): r["ema"] for r in tl.ema(df, "run", "iter", "x", block=block).collect()}
    for r, xs in runs.items():
        for i, e in enumerate(python_ema(xs)):
            assert got[(r, i)] == (None if e is None else pytest.approx(e, rel=1e-12))


def test_best_so_far_small_blocks(spark):
    xs = [5.0, 3.0, 4.0, 1.0, 2.0, 0.5, 7.0]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(xs)], "run string, iter long, x double")
    got = sorted((r["iter"], r["best_loss"]) for r in tl.best_so_far(df, "run", "iter", "x", block=2).collect())
    assert [b for _, b in got] == [5.0, 3.0, 3.0, 1.0, 1.0, 0.5, 0.5]


def test_step_durations(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("r", 0, t0), ("r", 1, t0 + dt.timedelta(seconds=1.5))],
                               "run string, iter long, ts timestamp")
    got = sorted((r["iter"], r["dt_s"]) for r in tl.step_durations(df, "run", "iter", "ts").collect())
    assert got == [(0, None), (1, 1.5)]


def test_parse_log_lines(spark):
    lines = spark.createDataFrame([
        ("r", "12 | loss 2.3456 | lr 5.000000e-04 | 123.45ms | mfu 31.20%"),
        ("r", "step 10: train loss 2.5000, val loss 2.6000"),
        ("r", "garbage line")], "run string, line string")
    it = tl.parse_iteration_lines(lines).first()
    assert (it["iter"], it["loss"], it["lr"], it["dt_ms"]) == (12, 2.3456, 5e-4, 123.45)
    assert it["mfu"] == pytest.approx(0.312)
    ev = sorted((r["split"], r["loss"]) for r in tl.parse_eval_lines(lines).collect())
    assert ev == [("train", 2.5), ("val", 2.6)]


def test_checkpoint_catalog_from_files(spark, tmp_path):
    for name in ("ckpt_10.pt", "ckpt_5.pt", "model.pt", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = sorted(r["ckpt"] for r in tl.list_checkpoints(spark, str(tmp_path)).collect())
    assert got == [5, 10]


def test_chat_prompts(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi"), (1, 2, "assistant", "Hello"),
            (1, 3, "user", "Again"),
            (2, 0, "user", "No system"),
            (3, 0, "system", ""), (3, 1, "user", "Empty system")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["prompt"] for r in ch.render_chat_prompt(df).collect()}
    assert got[(1, 1)] == "[INST] <<SYS>>\nBe brief.\n<</SYS>>\n\nHi [/INST]"
    assert got[(1, 3)] == "[INST] Again [/INST]"
    assert got[(2, 0)] == "[INST] No system [/INST]"
    assert got[(3, 1)] == "[INST] Empty system [/INST]"


def test_stream_equals_batch(spark):
    from curio.functions.metrics import score_texts
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    src = scratch_path(spark, "t-src")
    docs.repartition(3).write.mode("overwrite").parquet(src)
    s = st.score_stream(st.read_stream(spark, src, docs.schema, 1), "text",
                        metrics=["flesch_kincaid_grade"])
    sink = scratch_path(spark, "t-sink")
    st.run_available_now(s.select("doc_id", "flesch_kincaid_grade"), sink, scratch_path(spark, "t-ck"))
    got = {r[0]: r[1] for r in spark.read.parquet(sink).collect()}
    exp = {r[0]: r[1] for r in score_texts(docs, "text", metrics=["flesch_kincaid_grade"])
           .select("doc_id", "flesch_kincaid_grade").collect()}
    assert got == pytest.approx(exp)


def test_windowed_metrics_append_drops_late_rows(spark):
    t0 = dt.datetime(2024, 1, 1)
    early = [(t0 + dt.timedelta(minutes=m), "a", 1.0) for m in (0, 10, 70, 200)]
    late = [(t0 + dt.timedelta(minutes=5), "a", 100.0)]   # arrives after the watermark passed
    src = scratch_path(spark, "w-src")
    schema = "ts timestamp, k string, v double"
    sink, ck = scratch_path(spark, "w-sink"), scratch_path(spark, "w-ck")
    # two incremental runs of the same job: the late row arrives in the second
    for batch in (early, late):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        w = st.windowed_metrics(st.read_stream(spark, src, schema), "ts", ["k"], "v", "1 hour",
                                watermark="30 minutes")
        st.run_available_now(w, sink, ck, "append")
    got = {r["window_start"].hour: (r["mean_value"], r["n"]) for r in spark.read.parquet(sink).collect()}
    assert got[0] == (1.0, 2)           # the late 100.0 was dropped
    assert 1 in got and got[1] == (1.0, 1)


def test_bpe_round_trip(spark):
    docs = spark.createDataFrame([(0, "the cat the hat"), (1, "that thin thing  ünïcode 42"),
                                  (2, ""), (3, "   ")], "doc_id long, text string")
    vocab = train_bpe_vocab(spark, docs, 8)
    pieces = [r["piece"] for r in vocab.orderBy("token_id").collect()]
    assert pieces[:3] == ["<unk>", "<s>", "</s>"] and pieces[3] == "<0x00>"
    enc = encode_texts(spark, docs, vocab)
    dec = {r["doc_id"]: r["text"] for r in decode_tokens(enc, vocab).collect()}
    assert dec == {0: "the cat the hat", 1: "that thin thing  ünïcode 42", 2: "", 3: "   "}
    # a merged piece is used: fewer ids than characters
    ids0 = [r["ids"] for r in enc.collect() if r["doc_id"] == 0][0]
    assert len(ids0) < len("the cat the hat") + 1


def test_bpe_unseen_characters_white_space_keys_and_cut_ids(spark):
    vocab = train_bpe_vocab(spark, spark.createDataFrame([(0, "ab ab zab abab")], "doc_id long, text string"), 6)
    texts = ["ab éab zab", "éab", "ab", " a\n\tb  漢\u2581 ", "ab", None]
    docs = spark.createDataFrame([(1 if t == "ab" else i + 10, t) for i, t in enumerate(texts)], "doc_id long, text string")
    enc = encode_texts(spark, docs, vocab)
    dec = decode_tokens(enc, vocab)
    assert sorted(r["text"] for r in dec.collect()) == sorted(t or "" for t in texts)
    assert [r["ids"] for r in enc.collect() if r["doc_id"] == 15] == [[1]]
    cut = enc.filter("doc_id = 11").selectExpr("doc_id", "slice(ids, 1, 3) AS ids")
    assert decode_tokens(cut, vocab).first()["text"] == "\ufffd"
    many = spark.createDataFrame([(i, f"p{i}", 0.0, 1) for i in range(259, 70259)], "token_id int, piece string, score float, n_bytes int")
    assert decode_tokens(spark.createDataFrame([(1, [70258, 99999999])], "k int, ids array<int>"), many).first()["text"] == "p70258"


def test_bpe_several_pairs_per_round_round_trips(spark):
    docs = spark.createDataFrame([(0, "low lower lowest newer wider"), (1, "new newest low")],
                                 "doc_id long, text string")
    vocab = train_bpe_vocab(spark, docs, 6, pairs_per_round=3)
    merged = [r["piece"] for r in vocab.filter("score < 0 AND token_id >= 259").orderBy(
        "token_id").collect()]
    assert len(merged) >= 6
    dec = {r["doc_id"]: r["text"] for r in decode_tokens(encode_texts(spark, docs, vocab), vocab).collect()}
    assert dec == {0: "low lower lowest newer wider", 1: "new newest low"}


def test_stream_ema_holds_rows_until_the_watermark(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    schema = "ts timestamp, run string, id long, v double"
    # (minute, id, value): 3 and 5 come a batch late, 6 ties with 7, 1 comes too late, 9 has no time
    batches = [[(at(2), "a", 2, 2.0), (at(8), "a", 8, None), (at(6), "a", 7, 7.0), (at(1), "b", 1, 1.0), (None, "a", 9, 9.0)],
               [(at(3), "a", 3, 3.0), (at(6), "a", 6, 6.0), (at(5), "a", 5, 5.0), (at(40), "a", 40, 4.0)],
               [(at(4), "a", 4, 100.0), (at(90), "b", 90, 1.0)]]
    src, sink, ck = (scratch_path(spark, f"ema-{x}") for x in ("src", "sink", "ck"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        e = st.stream_ema(st.read_stream(spark, src, spark.createDataFrame([], schema).schema), "run", "ts", "id", "v", start=1, delay="10 minutes")
        st.run_available_now(e, sink, ck)
    got = sorted((r["run"], r["iter"], r["id"], r["ema"]) for r in spark.read.parquet(sink).collect())
    exp, e = [], None
    for i, (k, v) in enumerate([(2, 2.0), (3, 3.0), (5, 5.0), (6, 6.0), (7, 7.0), (8, None), (40, 4.0)]):
        if i >= 1 and v is not None:
            e = v if e is None else 0.9 * e + 0.1 * v
        exp.append(("a", i, k, None if e is None else pytest.approx(e)))
    assert got == exp + [("b", 0, 1, None)]          # b's row of minute 90 is still held
