"""The streamed mean with many runs in a group of state."""

import datetime as dt
import random

import pytest

from curio.plans import q_streams
from curio.session import scratch_path
from curio.streaming import streams as st

BIG = 2 ** 60 + 1


def plain(rows, last=None, start=3):
    """``(run, id, iter, ema)`` of each row in order, up to the time ``last``."""
    out, tails = [], {}
    for ts, run, k, v in sorted(rows, key=lambda r: (r[0], r[2] is None, r[2] or 0)):
        it, e = tails.get(run, (0, None))
        if it >= start and v is not None and v == v:
            e = v if e is None else 0.9 * e + 0.1 * v
        tails[run] = (it + 1, e)
        if last is None or ts <= last:
            out.append((run, k, it, e))
    return out


def shown(rows):
    return sorted([("" if r is None else str(r), -1 if k is None else k, it, "" if e is None else f"{e:.9g}") for r, k, it, e in rows])


def made(seed, runs):
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    return [(t0 + dt.timedelta(minutes=k), rng.choice(runs), None if k == 7 else BIG + k, rng.choice([None, float("nan"), rng.random()]))
            for k in range(400)]


@pytest.mark.parametrize("kind, runs", [("long", [None, 0, -1, *range(BIG, BIG + 60)]),
                                        ("string", [None, "", "null", "=", *map(str, range(60))])])
def test_runs_share_groups_of_state(spark, kind, runs):
    schema = f"ts timestamp, run {kind}, id long, v double"
    rows = made(1, runs)
    src, sink, ck = (scratch_path(spark, f"groups-{x}") for x in ("src", "sink", "ck"))
    for lo in (0, 150, 300):
        # a row up to 20 minutes late, over the cuts too
        late = [r for i, r in enumerate(rows) if lo <= i + (i * 7) % 20 < (150 if lo == 0 else 300 if lo == 150 else 500)]
        spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(src)
        e = st.stream_ema(st.read_stream(spark, src, spark.createDataFrame([], schema).schema), "run", "ts", "id", "v", start=3,
                          delay="20 minutes", groups=5)
        st.run_available_now(e, sink, ck)
    got = spark.read.parquet(sink)
    assert got.columns == ["run", "iter", "ema", "id"] and dict(got.dtypes)["run"] == ("bigint" if kind == "long" else "string")
    assert shown((r["run"], r["id"], r["iter"], r["ema"]) for r in got.collect()) == shown(plain(rows, rows[-1][0] - dt.timedelta(minutes=20)))
    # a call and a state for a group, not for a run
    assert 0 < spark.read.format("statestore").load(ck).count() <= 5


def test_runs_in_order_share_groups_of_state(spark):
    schema = "ts timestamp, run long, id long, v double"
    rows = made(2, [None, *range(300)])
    src, sink, ck = (scratch_path(spark, f"groups-{x}") for x in ("src", "sink", "ck"))
    for part in (rows[:200], rows[200:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        st.run_available_now(st.stream_ema(st.read_stream(spark, src, spark.createDataFrame([], schema).schema), "run", "ts", "id", "v", start=1), sink, ck)
    got = spark.read.parquet(sink)
    assert got.columns == ["run", "iter", "ema"]
    assert shown((r["run"], None, r["iter"], r["ema"]) for r in got.collect()) == shown((r, None, it, e) for r, _, it, e in plain(rows, start=1))
    assert spark.read.format("statestore").load(ck).count() <= st.RUN_GROUPS < 300


def test_cuts_between_appends_do_not_hold_every_value():
    assert 0 < q_streams.CUT_ERROR < 0.01
