"""Work that is done once, spread over tasks, and the same results."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from curio.functions import readability as rd, sentiment as se
from curio.operators import flows, lineage as ln
from curio.operators._util import spread_small_input
from curio.operators.lexicon import lexicon_join, lexicon_sentiment
from curio.operators.tokenizer import train_bpe_vocab
from curio.session import scratch_path
from curio.sources import io

TEXTS = ["Not good, never GREAT. The little house!", "", None, "beautiful beautiful idea the le table.", "e x the-e 12 été"]


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def rows_by_task(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_per_row_scores_read_the_text_once(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    # one translate for the words, one more for the sentences
    for column, most in ((se.sentiment_score("t"), 1), (se.subjectivity_score("t"), 1), (rd.gunning_fog("t"), 2),
                         (rd.flesch_kincaid_grade("t"), 2), (rd.difficult_words("t"), 1)):
        shown = plan(df.select(column.alias("x"))).split("== Physical Plan ==")[1]
        assert 0 < shown.count("translate(") <= most
    got = [r[0] for r in df.orderBy("id").select(se.sentiment_score("t")).collect()]
    # not good; the (never has no entry itself, great is negated); the; little
    first = (0.7 * -0.5 + 0.8 * -0.5 + 0.05 - 0.1875) / 4
    assert got[0] == pytest.approx(first) and got[1:3] == [0.0, 0.0]


def test_syllables_of_a_text_are_those_of_its_words(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeiouylbcrt") for _ in range(rng.randrange(7))) for _ in range(3000)] + ["the", "le", "e", "be", "ble", "rhythm"]
    text = " ".join(w or "1" for w in words)
    row = spark.createDataFrame([(text,)], "t string").select(
        rd.syllable_total("t").alias("n"), rd.syllable_array(rd.syllable_marks_joined(rd.letters_joined(F.col("t")))).alias("each")).first()

    def plain(w):
        return max(1, len(re.findall("[aeiouy]+", w)) - bool(re.search("[^aeiouyl]e$", w))) if w else 0
    assert row["each"] == [plain(w) for w in words] and row["n"] == sum(map(plain, words))


def test_membership_pairs_are_dealt_out_evenly(spark, monkeypatch):
    monkeypatch.setattr(ln, "PAIRS_PER_TASK", 2000)
    monkeypatch.setattr(ln, "STRETCH", 8)
    n = 2000
    positions = spark.range(n).select("id", F.col("id").alias("pos")).coalesce(1)
    ckpts = ln.checkpoint_schedule(spark, n, 2, 2, 5)
    got = ln.checkpoint_membership(positions, ckpts, 2, 2, 5)
    sizes = rows_by_task(got)
    assert len(sizes) > 20 and sizes[-1] < 2 * sum(sizes) / len(sizes)
    last = [r[0] for r in ckpts.collect()]
    want = sorted((c, i) for c in last for i in range(min(n, 2 * (1 + c * 2))))
    assert sorted(map(tuple, got.select("ckpt", "id").collect())) == want


def test_one_row_group_is_spread_whatever_its_splits(spark, tmp_path):
    spark.range(5000).coalesce(1).write.parquet(str(tmp_path / "t"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        df = spark.read.parquet(str(tmp_path / "t"))
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and len(rows_by_task(df)) == 1
        sizes = rows_by_task(spread_small_input(df))
        assert len(sizes) >= spark.sparkContext.defaultParallelism and sum(sizes) == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_small_lexicon_moves_no_words(spark):
    df = spark.createDataFrame([(1, "Hot not hot, no"), (2, ""), (3, None), (None, "hot")], "doc_id long, text string")
    lexicon = spark.createDataFrame([("hot", 0.5, 0.25), ("hot", 1.0, 0.5), ("no", 0.2, 0.1), (None, 1.0, 1.0)],
                                    "word string, polarity double, subjectivity double")
    assert not re.search(r"hashpartitioning\(word", plan(lexicon_join(df, lexicon)))
    routes = [sorted(map(tuple, lexicon_join(df, lexicon, small=s).collect()), key=str) for s in (0, 100)]
    assert routes[0] == routes[1] and (1, 2, "hot", -0.25, 0.25) in routes[0] and len(routes[0]) == 7
    means = [sorted(map(tuple, lexicon_sentiment(df, lexicon, small=s).collect()), key=str) for s in (0, 100)]
    assert means[0] == means[1]


def shards(folder, n=40):
    for s in range(n):
        (folder / f"s{s:03d}.json").write_text(json.dumps([{"story": f"story {s} {k}"} for k in range(3)]))


def test_many_small_shards_are_read_by_many_tasks(spark, tmp_path):
    shards(tmp_path)
    got = io.read_json_shards(spark, str(tmp_path))
    assert got.count() == 120 and len(rows_by_task(got)) >= spark.sparkContext.defaultParallelism


def test_pretokenize_encodes_once(spark, tmp_path, monkeypatch):
    shards(tmp_path, 5)
    seen = []
    dense = flows.assign_dense_ids
    monkeypatch.setattr(flows, "assign_dense_ids", lambda rows, *a: (seen.append(plan(rows)), dense(rows, *a))[1])
    vocab = train_bpe_vocab(spark, spark.createDataFrame([("story 1 2 3",)], "text string"), 5)
    got = flows.pretokenize(spark, str(tmp_path), vocab, scratch_path(spark, "t-tokens"), 8)
    assert "MapInArrow" not in seen[0]
    assert sorted(r["id"] for r in got.collect()) == list(range(15))


def test_make_batches_joins_once(spark, tmp_path, monkeypatch):
    from curio.plans import q_curriculum as q
    spark.createDataFrame([(i, f"word {i} and more.", "en", "web", 12) for i in range(20)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    ordered = q.assign_positions
    monkeypatch.setattr(q, "assign_positions", lambda df, *a: (seen.append(plan(df)), ordered(df, *a))[1])
    got = {r["batch_no"]: (r["n_rows"], r["n_x_tokens"]) for r in q.q_make_batches(spark, str(tmp_path)).collect()}
    assert "Join" not in seen[0] and got == {0: (8, 24), 1: (8, 24), 2: (4, 12)}
