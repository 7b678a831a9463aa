"""Segmented scans against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from curio.operators.scan import RunningMean, RunningSum, RunningXor, segmented_scan


def plain(rows, decay, weight):
    out, state = {}, {}
    for g, k, w, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1])):
        key = "nan" if g != g else g
        i, whole, real, mean, xor = state.get(key, (-1, 0, 0.0, None, 0))
        if x is not None:
            mean = x if mean is None else decay * mean + weight * x
        state[key] = now = (i + 1, whole + (w or 0), real + (x or 0.0), mean, xor ^ (w or 0))
        out[k] = now
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_scans_with_a_hot_group_nulls_and_many_groups(spark, parts):
    rnd = random.Random(parts)
    rows = []
    for k in range(6000):
        g = "hot" if k % 3 == 0 else (None if k % 50 == 1 else f"g{rnd.randrange(1500)}")
        rows.append((g, k, rnd.choice([None, 1, 5, -2]), rnd.choice([None, None, rnd.random(), 1e6 * rnd.random()])))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k long, w long, x double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = segmented_scan(df, ["g"], [F.col("k").asc()], {"s": RunningSum("w"), "r": RunningSum("x"),
                                                             "e": RunningMean("x", 0.9, 0.1), "o": RunningXor("w")}, "i").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain(rows, 0.9, 0.1)
    assert len(got) == len(rows)
    for r in got:
        i, s, x, e, o = want[r["k"]]
        assert (r["i"], r["s"], r["o"]) == (i, s, o)
        assert math.isclose(r["r"], x, rel_tol=1e-12, abs_tol=1e-9)
        assert (r["e"] is None) == (e is None) and (e is None or math.isclose(r["e"], e, rel_tol=1e-12))


def test_empty_and_two_keys(spark):
    df = spark.createDataFrame([], "g string, k long, w long")
    assert segmented_scan(df, ["g"], [F.col("k").asc()], {"s": RunningSum("w")}, "i").collect() == []
    nan = float("nan")
    df = spark.createDataFrame([(nan, 1, 1, 1), (nan, 1, 2, 2), (None, 1, 3, 4), (1.0, 1, 4, 8), (1.0, 2, 5, 16)],
                               "g double, h long, k long, w long")
    got = {r["k"]: (r["i"], r["s"]) for r in
           segmented_scan(df, ["g", "h"], [F.col("k").desc()], {"s": RunningSum("w")}, "i").collect()}
    assert got == {1: (1, 3), 2: (0, 2), 3: (0, 4), 4: (0, 8), 5: (0, 16)}


def test_ema_with_nulls_whatever_the_partitions(spark):
    from curio.operators.trainlog import ema
    rnd = random.Random(3)
    rows = [(r, i, None if rnd.random() < .2 else rnd.uniform(0, 1e6)) for r in range(3) for i in range(400 if r else 4000)]
    want, state = {}, {}
    for r, i, x in rows:
        if i >= 5 and x is not None:
            state[r] = x if r not in state else 0.9 * state[r] + 0.1 * x
        want[r, i] = state.get(r)
    for parts in (1, 23):
        df = spark.createDataFrame(rows, "run int, iter long, x double").repartition(parts)
        got = {(v["run"], v["iter"]): v["ema"] for v in ema(df, "run", "iter", "x", block=parts).collect()}
        assert set(got) == set(want)
        for k, e in want.items():
            assert (got[k] is None) == (e is None) and (e is None or math.isclose(got[k], e, rel_tol=1e-11))


def test_positions_of_strings_dates_and_string_ids_both_ways(spark):
    import datetime as dt

    from curio.operators.order import order_custom, sort_descending
    from curio.operators.positions import asc, desc, group_positions, rank_cut
    rows = [(f"id{k:03d}", None if k % 11 == 0 else f"w{k * 7 % 13}", None if k % 7 == 0 else dt.date(2020, 1, 1 + k % 20), k % 3)
            for k in range(200)]
    df = spark.createDataFrame(rows, "id string, w string, d date, g int").repartition(5)

    def plain(column, down, rest=rows):
        known = [r for r in rest if r[column] is not None]
        known = sorted(sorted(known, key=lambda r: r[0]), key=lambda r: r[column], reverse=down)
        return [r[0] for r in known + sorted(r for r in rest if r[column] is None)]

    for column, name in ((1, "w"), (2, "d")):
        got = [r["id"] for r in sort_descending(df, name, "id", 4).orderBy("pos").collect()]
        assert got == plain(column, True)
        for down, key in ((True, desc(name)), (False, asc(name))):
            assert [r["id"] for r in order_custom(df, [key], "id", 3).orderBy("pos").collect()] == plain(column, down)
            for k in (1, 57, 185, 199):
                assert {r["id"] for r in df.where(rank_cut(df, [key], "id", k)).collect()} == set(plain(column, down)[:k])
        by = group_positions(df, ["g"], [desc(name)], "id").orderBy("g", "idx").collect()
        for g in range(3):
            assert [r["id"] for r in by if r["g"] == g] == plain(column, True, [r for r in rows if r[3] == g])
