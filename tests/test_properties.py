"""Property-based checks of the global ordering against a Python sort."""

import math

from hypothesis import HealthCheck, given, settings, strategies as st

from curio.operators.positions import asc, assign_positions, desc, rank_cut

KEYS = st.one_of(st.none(), st.just(float("nan")), st.sampled_from([0.0, 1.0, -2.5]),
                 st.floats(-5, 5, allow_nan=False))


def _expected(rows, descending):
    def key(r):
        k = r[1]
        miss = k is None or math.isnan(k)
        return (1 if miss else 0, 0 if miss else (-k if descending else k), r[0])
    return [r[0] for r in sorted(rows, key=key)]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(keys=st.lists(KEYS, min_size=1, max_size=120), descending=st.booleans(),
       buckets=st.integers(1, 9), k=st.integers(0, 130))
def test_positions_and_rank_cut_match_python_sort(spark, keys, descending, buckets, k):
    rows = [(i, v) for i, v in enumerate(keys)]
    df = spark.createDataFrame(rows, "id long, k double")
    key = desc("k") if descending else asc("k")
    out = assign_positions(df, [key], "id", "pos", buckets).orderBy("pos").collect()
    exp = _expected(rows, descending)
    assert [r["id"] for r in out] == exp
    assert [r["pos"] for r in out] == list(range(len(rows)))
    pred = rank_cut(df, [key], "id", k, buckets)
    got = sorted(r["id"] for r in (df.filter(pred) if pred is not None else df).collect())
    assert got == sorted(exp[:k])


WORDS = st.sampled_from(["Once", "upon", "a", "time,", "there", "was", "little", "girl",
                         "named", "Lily...", "Bob", "cat", "a"])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.lists(WORDS, min_size=0, max_size=25), min_size=1, max_size=15))
def test_bleu_expression_matches_python_rules(spark, texts):
    from curio.functions.bleu import bleu_reference_value, with_bleu
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: r["bleu_score"] for r in with_bleu(df).collect()}
    for i, t in rows:
        assert math.isclose(got[i], bleu_reference_value(t), rel_tol=1e-12, abs_tol=1e-15)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(xs=st.lists(st.floats(-100, 100, allow_nan=False), min_size=1, max_size=80),
       block=st.integers(1, 20))
def test_blockwise_ema_matches_recursion(spark, xs, block):
    from curio.operators.trainlog import ema
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(xs)],
                               "run string, iter long, x double")
    got = {r["iter"]: r["ema"] for r in ema(df, "run", "iter", "x", block=block).collect()}
    e, started = None, False
    for i, x in enumerate(xs):
        if i < 5:
            assert got[i] is None
            continue
        e = x if not started else 0.9 * e + 0.1 * x
        started = True
        assert math.isclose(got[i], e, rel_tol=1e-9, abs_tol=1e-9)
