import math
import random

import pytest
from pyspark.sql import functions as F

from curio.operators import curves as cv, lineage as ln, order as od
from curio.operators.positions import asc, assign_positions, desc, group_positions


@pytest.fixture(scope="module")
def metric_frame(spark):
    random.seed(7)
    rows = []
    for i in range(3000):
        r = random.random()
        v = float("nan") if r < 0.05 else None if r < 0.1 else (0.5 if r < 0.43 else random.random())
        rows.append((i, v))
    return rows, spark.createDataFrame(rows, "id long, k double")


def _expected(rows, descending):
    def key(r):
        k = r[1]
        miss = k is None or math.isnan(k)
        return (1 if miss else 0, 0 if miss else (-k if descending else k), r[0])
    return [r[0] for r in sorted(rows, key=key)]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("buckets", [None, 1, 5, 37])
def test_positions_dense_unique_and_ordered(metric_frame, descending, buckets):
    rows, df = metric_frame
    key = desc("k") if descending else asc("k")
    out = assign_positions(df, [key], "id", "pos", buckets).orderBy("pos").collect()
    assert [r["pos"] for r in out] == list(range(len(rows)))
    assert [r["id"] for r in out] == _expected(rows, descending)


def test_positions_plan_has_no_single_partition(metric_frame):
    _, df = metric_frame
    plan = assign_positions(df, [asc("k")], "id", "pos", 4)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "SinglePartition" not in plan


def test_group_positions(spark):
    df = spark.createDataFrame([(i, i % 3, float(-i)) for i in range(30)], "id long, g int, v double")
    out = group_positions(df, ["g"], [asc("v")], "id", "idx").collect()
    for g in range(3):
        ids = [r["id"] for r in sorted((r for r in out if r["g"] == g), key=lambda r: r["idx"])]
        assert ids == sorted((i for i in range(30) if i % 3 == g), reverse=True)
        assert sorted(r["idx"] for r in out if r["g"] == g) == list(range(10))


def test_threshold_edges(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.0), (2, float("nan")), (3, None), (4, 0.7)],
                               "id long, k double")
    assert [r["id"] for r in od.filter_by_threshold(df, "k", 0.5).collect()] == [4]
    assert sorted(r["id"] for r in od.filter_by_threshold(df, "k", 0.0).collect()) == [0, 4]
    ct = od.combined_transform(df, "k", 0.0).orderBy("pos").collect()
    assert [r["id"] for r in ct] == [0, 4]


def test_split_ten_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "id long")
    assert od.train_valid_split(df, "train").count() == 9
    assert [r["id"] for r in od.train_valid_split(df, "valid").collect()] == [9]


def test_custom_reverse_order_and_dispatch(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(9)], "id long, k double")
    rev = od.order_custom(df, [desc("id")]).orderBy("pos").collect()
    assert [r["id"] for r in rev] == [8, 7, 6, 5, 4, 3, 2, 1, 0]
    with pytest.raises(ValueError):
        od.dispatch_order(df, "combined_transform", "k", None)
    with pytest.raises(ValueError):
        od.dispatch_order(df, "sort_ascending", None)
    assert od.dispatch_order(df, "filter_by_threshold", "k", 0.0).count() == 8


def _scored(spark, n):
    random.seed(3)
    rows = [(i, random.random(), None if i % 17 == 0 else random.random()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double")


@pytest.mark.parametrize("B,G,step,include", [(8, 4, 5, True), (3, 2, 1, True), (5, 1, 3, False)])
def test_cumulative_means_equal_membership_means(spark, B, G, step, include):
    n = 700
    s = _scored(spark, n)
    pos = assign_positions(s, [asc("a")], "id", "pos")
    ck = ln.checkpoint_schedule(spark, n, B, G, step)
    mem = ln.checkpoint_membership(pos, ck, B, G, step, include)
    d1 = {r["ckpt"]: r for r in ln.checkpoint_means(s, mem, ck, ["a", "b"]).collect()}
    e4 = {r["ckpt"]: r for r in ln.cumulative_checkpoint_means(
        pos, ck, ["a", "b"], B, G, step, include).collect()}
    assert d1.keys() == e4.keys() and len(d1) > 0
    for k in d1:
        assert d1[k]["n_rows"] == e4[k]["n_rows"]
        for m in ("a", "b"):
            assert d1[k][m] == pytest.approx(e4[k][m])
    # Checkpoint N holds rows with pos < B * (1 + N*G) (or B*N*G without the prefetch)
    for k, r in d1.items():
        bound = B * (k * G + (1 if include else 0))
        assert r["n_rows"] == min(n, bound)


def test_schedule_edges(spark):
    assert [r.ckpt for r in ln.checkpoint_schedule(spark, 100, 8, 4, 5).collect()] == []
    assert [r.ckpt for r in ln.checkpoint_schedule(spark, 161, 8, 4, 5).collect()] == [5]
    assert [r.ckpt for r in ln.checkpoint_schedule(spark, 10_000, 8, 4, 5, max_iter=12).collect()] \
        == [5, 10]


def test_checkpoint_beyond_data_and_empty(spark):
    s = _scored(spark, 20)
    pos = assign_positions(s, [], "id", "pos")
    ck = spark.createDataFrame([(5,), (500,)], "ckpt long")
    m = {r["ckpt"]: r["n_rows"] for r in ln.checkpoint_means(
        s, ln.checkpoint_membership(pos, ck, 2, 1, 5), ck, ["a"]).collect()}
    assert m == {5: 12, 500: 20}
    none = spark.createDataFrame([(7,)], "ckpt long")
    r = ln.checkpoint_means(s, spark.createDataFrame([], "ckpt long, id long"), none, ["a"]).first()
    assert r["n_rows"] == 0 and r["a"] is None


def test_make_batches_last_partial(spark):
    df = spark.createDataFrame([(i, i, [i, i + 1, i + 2], 0.5) for i in range(10)],
                               "id long, pos long, tokens array<int>, m double")
    b = {r["batch_no"]: r["rows"] for r in ln.make_batches(df, 4, "tokens", ["m"]).collect()}
    assert sorted(b) == [0, 1, 2] and len(b[2]) == 2
    assert b[0][1]["x"] == [1, 2] and b[0][1]["y"] == [2, 3]


def test_normalize_and_saturation(spark):
    c = spark.createDataFrame([("r", "in", 5, "m", 1.0), ("r", "in", 10, "m", 3.0),
                               ("r", "in", 15, "m", 2.0), ("r", "in", 20, "m", 2.02),
                               ("r", "in", 5, "k", 4.0), ("r", "in", 10, "k", 4.0)],
                              "run string, side string, ckpt long, metric string, value double")
    n = {(r["metric"], r["ckpt"]): r["norm"] for r in cv.normalize_minmax(c).collect()}
    assert n[("m", 5)] == 0.0 and n[("m", 10)] == 1.0 and n[("k", 5)] == 0.0
    sp = {r["metric"]: r["saturation_ckpt"] for r in cv.saturation_point(c, 0.05).collect()}
    assert sp == {"m": 15, "k": 5}


@pytest.mark.parametrize("buckets", [None, 1, 6])
def test_rank_cut_matches_positions(metric_frame, buckets):
    from curio.operators.positions import rank_cut
    rows, df = metric_frame
    for k in (0, 1, 1234, len(rows) - 1, len(rows)):
        for keys in ([], [asc("k")], [desc("k")]):
            pred = rank_cut(df, keys, "id", k, buckets)
            got = sorted(r["id"] for r in (df.filter(pred) if pred is not None else df).collect())
            exp = sorted(_expected(rows, bool(keys) and keys[0].descending)[:k]) if keys \
                else sorted(r[0] for r in rows)[:k]
            assert got == exp, (k, keys)


@pytest.mark.parametrize("block", [1, 3, 100])
@pytest.mark.parametrize("parts", [[], ["g"]])
def test_running_totals_two_level(spark, block, parts):
    rows = [(g, i, float(i % 7) - 2.0) for g in ("a", "b") for i in range(25)]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    if not parts:
        df = df.filter(F.col("g") == "a")
    got = {(r["g"], r["k"]): r["cum_v"] for r in ln.running_totals(df, "k", ["v"], parts, block).collect()}
    for g in (["a", "b"] if parts else ["a"]):
        run = 0.0
        for i in range(25):
            run += float(i % 7) - 2.0
            assert got[(g, i)] == pytest.approx(run)


def test_hot_key_is_split_across_buckets(spark):
    """A third of all rows share one key value: the buckets stay balanced
    because the sort tuple carries the id."""
    from curio.operators.positions import bucket_sizes
    n = 30_000
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(7.0))
                               .otherwise(F.rand(1)).alias("k"))
    sizes = bucket_sizes(df, [asc("k")], "id", 16)
    assert sum(sizes) == n and len(sizes) >= 12
    assert max(sizes) < 3 * n / 16


def test_group_positions_null_and_nan_groups(spark):
    rows = [(i, None if i % 4 == 0 else ("b" if i % 4 == 1 else "a"), float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    out = group_positions(df, ["g"], [desc("v")], "id", "idx").collect()
    assert len(out) == 20
    for g in (None, "a", "b"):
        ids = [r["id"] for r in sorted((r for r in out if r["g"] == g), key=lambda r: r["idx"])]
        assert ids == sorted((i for i, gg, _ in rows if gg == g), reverse=True)
        assert sorted(r["idx"] for r in out if r["g"] == g) == list(range(len(ids)))


def test_consumed_by_is_the_listing_of_one_checkpoint(spark):
    p = spark.range(500).selectExpr("id", "id as pos")
    ck = ln.checkpoint_schedule(spark, 500, 7, 3, 5)
    for pre in (True, False):
        listed = ln.checkpoint_membership(p, ck, 7, 3, 5, pre).collect()
        for c in (5, 10, 20):
            want = {r["id"] for r in listed if r["ckpt"] == c}
            assert {r["id"] for r in ln.consumed_by(p, c, 7, 3, 5, pre).collect()} == want and want
    assert ln.consumed_by(p, None, 7, 3, 5).count() == 0
