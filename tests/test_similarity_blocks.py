import random

from curio.operators import vectors as vo


def test_similarity_has_no_count_limit(spark):
    rnd = random.Random(2)
    rows = [(g, k, [rnd.random(), rnd.random()]) for g in range(1400) for k in range(3)]  # 4,200 items
    df = spark.createDataFrame(rows, "g int, k int, v array<double>")
    got = {(r.g, r.i, r.j): r.cos for r in vo.pairwise_similarity(df, "k", "v", ["g"]).collect()}
    assert len(got) == 1400 * 9
    vecs = {(g, k): v for g, k, v in rows}
    for (g, i, j), c in got.items():
        x, y = vecs[g, i], vecs[g, j]
        want = (x[0] * y[0] + x[1] * y[1]) / ((x[0] ** 2 + x[1] ** 2) * (y[0] ** 2 + y[1] ** 2)) ** 0.5
        assert abs(c - want) < 1e-9
    ungrouped = vo.pairwise_similarity(df.where("g < 40").selectExpr("g * 3 + k as k", "v"), "k", "v")
    assert ungrouped.count() == ungrouped.select("i", "j").distinct().count() == 120 ** 2
