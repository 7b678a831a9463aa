import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curio.functions import vectors as vf
from curio.operators import ranking as rk, vectors as vo


@pytest.fixture(scope="module")
def shares(spark):
    rows = [("a", 1, 0.5), ("a", 2, 0.3), ("a", 3, 0.2),
            ("b", 1, 0.4), ("b", 2, 0.4), ("b", 3, 0.2),
            ("c", 7, 1.0)]
    return spark.createDataFrame(rows, "g string, item long, p double")


def kept(df):
    return sorted((r["g"], r["item"]) for r in df.collect())


def test_top_k_ties_and_large_k(shares):
    t = rk.top_k_per_group(shares, "g", "p", 1, "item", salt_buckets=3)
    assert kept(t) == [("a", 1), ("b", 1), ("b", 2), ("c", 7)]
    assert len(kept(rk.top_k_per_group(shares, "g", "p", 10, "item"))) == 7


def test_argmax_ties_to_lowest(shares):
    assert kept(rk.argmax_per_group(shares, "g", "p", "item")) == [("a", 1), ("b", 1), ("c", 7)]


def test_nucleus_boundaries(shares):
    # p=0.5 in group a: 0.5 is not > 0.5, so the crossing item 2 is included
    assert kept(rk.nucleus_filter(shares, "g", "item", "p", 0.5)) == \
        [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 7)]
    assert len(kept(rk.nucleus_filter(shares, "g", "item", "p", 0.0))) == 7   # disabled
    assert len(kept(rk.nucleus_filter(shares, "g", "item", "p", 1.0))) == 7   # disabled
    assert kept(rk.nucleus_filter(shares, "g", "item", "p", 0.3)) == \
        [("a", 1), ("b", 1), ("c", 7)]


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([("x", i, float(i)) for i in range(5)] + [("y", 0, 1000.0)],
                               "g string, item long, s double")
    out = rk.group_softmax(df, "g", "s", 2.0).collect()
    tot = {}
    for r in out:
        tot[r["g"]] = tot.get(r["g"], 0) + r["p"]
    assert tot["x"] == pytest.approx(1.0) and tot["y"] == pytest.approx(1.0)
    px = {r["item"]: r["p"] for r in out if r["g"] == "x"}
    z = sum(math.exp(i / 2) for i in range(5))
    assert px[4] == pytest.approx(math.exp(2) / z)


def test_weighted_and_nucleus_sample(spark, shares):
    coin = shares.withColumn("coin", F.when(F.col("g") == "a", 0.6).when(F.col("g") == "b", 0.99)
                             .otherwise(0.0))
    ws = dict((r["g"], r["item"]) for r in rk.weighted_sample(coin, "g", "item", "p", "coin").collect())
    assert ws == {"a": 2, "b": 3, "c": 7}
    ns = dict((r["g"], r["item"]) for r in rk.nucleus_sample(coin, "g", "item", "p", 0.5, "coin")
              .collect())
    # a keeps items 1,2 (mass 0.8): r = 0.48 < 0.5 -> item 1; b keeps 1,2: r = 0.792 -> item 2
    assert ns == {"a": 1, "b": 2, "c": 7}


def test_quantize_round_trip(spark):
    rng = np.random.default_rng(0)
    vecs = [rng.normal(size=16).tolist() for _ in range(20)] + [[0.0] * 16]
    vecs.append([127.0, 63.5, -63.5, 0.5] + [0.0] * 12)   # halves: 63.5 -> 64 (even), 0.5 -> 0
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "id int, v array<double>")
    q = df.select("id", "v", vf.quantize_groups("v", 16, 8).alias("q"))
    out = q.select("id", "v", "q", vf.dequantize_groups(F.col("q")).alias("d"),
                   vf.max_abs_error("v", F.col("q")).alias("e")).collect()
    for r in out:
        for k, s in enumerate(r["q"]["scale"]):
            grp = r["v"][k * 8:(k + 1) * 8]
            for x, d in zip(grp, r["d"][k * 8:(k + 1) * 8]):
                assert abs(x - d) <= s / 2 + 1e-12
    zero = out[20]
    assert zero["q"]["q"] == [0] * 16 and zero["q"]["scale"] == [0.0, 0.0]
    half = out[21]["q"]["q"]
    assert half[:4] == [127, 64, -64, 0]
    assert vf.group_size_for(48, 64) == 16 and vf.group_size_for(64, 64) == 64


def test_pca_2d_matches_numpy(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(2):
        x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
        rows += [(g, i + 100 * g, x[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, id long, v array<double>")
    out = vo.pca_2d(df, "g", "v", "id").collect()
    for g in range(2):
        x = np.array([r[2] for r in rows if r[0] == g])
        xc = x - x.mean(0)
        u, s, vt = np.linalg.svd(xc, full_matrices=False)
        proj = xc @ vt[:2].T
        for c in range(2):
            col = proj[:, c]
            if col[np.argmax(np.abs(col))] < 0:
                proj[:, c] = -col
        got = sorted((r["id"], r["pc1"], r["pc2"]) for r in out if r["g"] == g)
        assert np.allclose(np.array([[a, b] for _, a, b in got]), proj, atol=1e-6)


def test_pca_wide_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 50))
    el = spark.createDataFrame([(i, p, float(x[i, p])) for i in range(6) for p in range(50)],
                               "item int, pos long, value double")
    out = sorted((r["item"], r["pc1"], r["pc2"]) for r in vo.pca_wide(el, block=7).collect())
    xc = x - x.mean(0)
    u, s, vt = np.linalg.svd(xc, full_matrices=False)
    proj = u[:, :2] * s[:2]
    for c in range(2):
        if proj[np.argmax(np.abs(proj[:, c])), c] < 0:
            proj[:, c] *= -1
    assert np.allclose(np.array([[a, b] for _, a, b in out]), proj, atol=1e-6)


def test_cross_checkpoint_similarity_matches_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(layer, ck, rng.normal(size=4).tolist()) for layer in range(2) for ck in range(5)]
    rows.append((0, 5, [0.0, 0.0, 0.0, 0.0]))   # zero vector: counted in E, adds nothing
    df = spark.createDataFrame(rows, "layer int, ckpt int, v array<double>")
    got = {r["layer"]: r["mean_cosine"] for r in
           vo.cross_checkpoint_similarity(df, "layer", "ckpt", "v").collect()}
    for layer in range(2):
        vs = [np.array(v) for lyr, _, v in rows if lyr == layer]
        e = len(vs)
        tot = 0.0
        for i in range(e):
            for j in range(i + 1, e):
                ni, nj = np.linalg.norm(vs[i]), np.linalg.norm(vs[j])
                if ni > 0 and nj > 0:
                    tot += vs[i] @ vs[j] / (ni * nj)
        assert got[layer] == pytest.approx(tot / (e * (e - 1) / 2))


def test_pairwise_similarity_is_symmetric(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0])],
                               "k int, v array<double>")
    m = {(r["i"], r["j"]): r["cos"] for r in vo.pairwise_similarity(df, "k", "v").collect()}
    assert set(m) == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert m[(0, 1)] == pytest.approx(1 / math.sqrt(2)) and m[(1, 0)] == m[(0, 1)]
    with pytest.raises(ValueError):
        vo.pairwise_similarity(df, "k", "v", max_items=2)


def test_pca_wide_per_group_and_pca_space(spark):
    rng = np.random.default_rng(5)
    rows = []
    xs = {}
    for ck in range(3):
        x = rng.normal(size=(4, 20))
        xs[ck] = x
        rows += [(ck, layer, p, float(x[layer, p])) for layer in range(4) for p in range(20)]
    el = spark.createDataFrame(rows, "ckpt int, layer int, pos long, value double")
    got = vo.pca_wide(el, "layer", "pos", "value", block=6, group_cols=["ckpt"]).collect()
    for ck, x in xs.items():
        xc = x - x.mean(0)
        u, s, vt = np.linalg.svd(xc, full_matrices=False)
        proj = u[:, :2] * s[:2]
        for c in range(2):
            if proj[np.argmax(np.abs(proj[:, c])), c] < 0:
                proj[:, c] *= -1
        mine = sorted((r["layer"], r["pc1"], r["pc2"]) for r in got if r["ckpt"] == ck)
        assert np.allclose(np.array([[a, b] for _, a, b in mine]), proj, atol=1e-6)
    sp = vo.pca_space(el, "layer", "ckpt", "pos", "value")
    c6 = vo.cross_checkpoint_similarity(sp, "layer", "ckpt", "coords").collect()
    assert len(c6) == 4 and all(-1.0 <= r["mean_cosine"] <= 1.0 for r in c6)


def test_hot_group_ranking_matches_brute_force(spark):
    """One group holds a third of the rows: salted top-k, top-p and softmax
    still equal a brute-force computation."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else f"g{i % 17}"
        rows.append((g, i, float(rng.integers(0, 50))))   # many ties
    df = spark.createDataFrame(rows, "g string, item long, s double")
    top = sorted((r["g"], r["item"]) for r in rk.top_k_per_group(df, "g", "s", 5, "item", 8).collect())
    exp = []
    for g in {r[0] for r in rows}:
        vals = sorted((r[2] for r in rows if r[0] == g), reverse=True)
        kth = vals[min(5, len(vals)) - 1]
        exp += [(g, r[1]) for r in rows if r[0] == g and r[2] >= kth]
    assert top == sorted(exp)
    sm = rk.group_softmax(df, "g", "s", 10.0)
    nf = {(r["g"], r["item"]) for r in rk.nucleus_filter(sm, "g", "item", "p", 0.3).collect()}
    p = {(r["g"], r["item"]): r["p"] for r in sm.collect()}
    for g in {r[0] for r in rows}:
        items = sorted(((-p[(g, r[1])], r[1]) for r in rows if r[0] == g))
        cum, keep = 0.0, set()
        for negp, it in items:
            if cum > 0.3:
                break
            keep.add((g, it))
            cum += -negp
        assert {k for k in nf if k[0] == g} == keep


def test_pca_2d_with_a_large_mean_many_partitions_and_nulls(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 4)) * [5, 3, 1, .5] + 1e6
    rows = [(None if i % 3 else "hot", i, x[i].tolist()) for i in range(900)] + [("hot", 1000, None)]
    df = spark.createDataFrame(rows, "g string, id long, v array<double>").repartition(40)
    out = vo.pca_2d(df, "g", "v", "id").collect()
    assert len(out) == 901 and [r["pc1"] for r in out if r["id"] == 1000] == [None]
    for g in (None, "hot"):
        part = np.array([i for i in range(900) if rows[i][0] == g])
        xc = x[part] - x[part].mean(0)
        proj = xc @ np.linalg.svd(xc, full_matrices=False)[2][:2].T
        proj *= np.sign(proj[np.abs(proj).argmax(0), [0, 1]])
        got = np.array([[r["pc1"], r["pc2"]] for r in sorted((r for r in out if r["g"] == g and r["id"] < 900), key=lambda r: r["id"])])
        assert np.allclose(got, proj, atol=1e-6)


def test_pca_wide_with_more_items_than_directions(spark):
    rng = np.random.default_rng(7)
    n = 3000
    x = rng.normal(size=(n, 12)) * np.array([20, 12, 3, 2, 2, 1, 1, 1, 1, 1, 1, 1])
    el = spark.createDataFrame([(i, int(p), float(x[i, p])) for i in range(n) for p in range(12)], "item int, pos long, value double")
    out = sorted((r["item"], r["pc1"], r["pc2"]) for r in vo.pca_wide(el, spare=4).collect())
    xc = x - x.mean(0)
    u, s, _ = np.linalg.svd(xc, full_matrices=False)
    proj = u[:, :2] * s[:2]
    proj *= np.sign(proj[np.abs(proj).argmax(0), [0, 1]])
    assert np.allclose(np.array([r[1:] for r in out]), proj, atol=1e-4)
