import json

from pyspark.sql import functions as F

from curio.operators._util import collect_bounded
from curio.session import materialize, scratch_path
from curio.sources import io


def test_read_json_shards_order_and_limit(spark, tmp_path):
    for name, stories in (("b.json", ["b0", "b1"]), ("a.json", ["a0", "a1", "a2"]),
                          ("c.json", ["c0"])):
        (tmp_path / name).write_text(json.dumps([{"story": s, "other": 1} for s in stories]))
    (tmp_path / "skip.txt").write_text("not json")
    rows = io.read_json_shards(spark, str(tmp_path)).collect()
    got = sorted((r["shard"].rsplit("/", 1)[-1], r["pos"], r["story"]) for r in rows)
    assert got == [("a.json", 0, "a0"), ("a.json", 1, "a1"), ("a.json", 2, "a2"),
                   ("b.json", 0, "b0"), ("b.json", 1, "b1"), ("c.json", 0, "c0")]
    two = io.read_json_shards(spark, str(tmp_path), max_shards=2).collect()
    assert sorted({r["shard"].rsplit("/", 1)[-1] for r in two}) == ["a.json", "b.json"]


def test_export_text_corpus_strips_and_splits_lines(spark):
    df = spark.createDataFrame([("  one story\nsecond line  ",), ("\tother ",)], "text string")
    path = scratch_path(spark, "t-export")
    io.export_text_corpus(df, path)
    lines = sorted(r["value"] for r in io.read_text_lines(spark, path).collect())
    assert lines == ["one story", "other", "second line"]


def test_run_layout_prunes_partitions(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "run string, x int")
    path = scratch_path(spark, "t-runs")
    io.write_table(df, path, ("run",))
    r = io.read_run(spark, path, "a")
    assert sorted(x["x"] for x in r.collect()) == [1, 3]
    assert "PartitionFilters: [isnotnull(run" in r._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_materialize_and_bounded_collect(spark):
    df = spark.range(10).select(F.col("id"), (F.col("id") * 2).alias("y"))
    m = materialize(df, "t-mat")
    assert sorted(r["y"] for r in m.collect()) == [2 * i for i in range(10)]
    assert collect_bounded(df, 10) is not None and collect_bounded(df, 9) is None


def test_quality_operators_on_fixture(spark):
    from curio.operators import quality as ql
    a = spark.createDataFrame([(1, 0.5, [1, 2, 3, 4, 5]), (2, float("nan"), [1]), (2, None, []),
                               (3, 0.1, None)], "id long, m double, tokens array<int>")
    b = spark.createDataFrame([(1,), (3,), (4,)], "id long")
    r = ql.reconcile_ids(a, b, "id").first()
    assert (r["n_a"], r["n_b"], r["only_in_a"], r["only_in_b"]) == (4, 3, 1, 1)
    nulls = {x["column"]: x["n_null"] for x in ql.null_counts(a, ["id", "m", "tokens"]).collect()}
    assert nulls == {"id": 0, "m": 2, "tokens": 1}
    assert sorted(x["key"] for x in ql.duplicate_keys(a, "id").collect()) == [2]
    rep = {x["check"]: x["n_bad"] for x in ql.quality_report({
        "short": ql.short_sequences(a.filter("tokens IS NOT NULL")),
        "missing": ql.missing_values(a, ["m", "tokens"])}).collect()}
    assert rep == {"short": 2, "missing": 3}
