import random
from collections import defaultdict

import numpy as np

from curio.llm import near_dedup as N
from curio.llm.components import connected_components
from curio.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(docs):
    """doc_id -> component by all pairs that share a shingle."""
    sets, where = {i: shingles(t) for i, t in docs.items()}, defaultdict(list)
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(docs):
        common = defaultdict(int)
        for s in sets[i]:
            for j in where[s]:
                common[j] += 1
            where[s].append(i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in docs}


def check(spark, df, docs):
    want = brute(docs)
    for r in df.collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = QUERIES["op3_near_dedup"](spark, SF)
    assert out.count() == len(docs)
    check(spark, out, docs)


def test_hot_group_chains_and_edges(spark):
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    docs, k = {}, 1
    for _ in range(250):  # copies of one text with few changes: many texts, one group or nearly so
        t = list(base)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = f"x{rnd.randrange(999)}"
        docs[k] = " ".join(t)
        k += 1
    chain = [f"c{i}" for i in range(60)]
    for i in range(12):  # each near the next, the ends far apart
        docs[k] = " ".join(chain[:60 - 3 * i] + [f"d{j}" for j in range(3 * i)])
        k += 1
    for t in [None, "", " \t", "one", "ONE", "two words", "a b c d e", "A b c d E  ", "same", "same"]:
        docs[k] = t
        k += 1
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, rep string")
    check(spark, N.near_duplicates(df.repartition(5)), docs)


def test_nulls_repeats_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "other"), (None, None)],
                               "doc_id long, text string")
    got = sorted(map(str, N.near_duplicates(df).collect()))
    assert len(got) == 5 and sum("component_id=4" in x for x in got) == 3 and sum("kept=True" in x for x in got) == 2
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 900, dtype=np.uint64), rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    ra, rb = N.registers(a), N.registers(b)
    assert (N.merge_registers(ra, rb) == N.registers(np.concatenate([a, b]))).all()
    both = np.concatenate([a[:800], b[:50]])
    rc = N.registers(both)
    grid = np.linspace(0, 1, 201)
    fit = N.log_likelihoods(np.array([(ra > rc).sum()]), np.array([(ra < rc).sum()]), np.array([900.0]), np.array([850.0]), grid)
    assert abs(grid[fit[0].argmax()] - 800 / 950) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 260)] + [(5, 5), (None, 3), (7, 6)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 200 for i in range(200, 260)}}
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_packed_marks_count_disagreeing_entries(spark):
    from curio.llm.banding import disagreeing, least_agreeing, packed_marks
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 512, (2, 200, N.REGISTERS))
    b = np.where(rng.random(b.shape) < 0.6, a, b)
    a[0], b[0], a[1], b[1] = 511, 511, 511, 0
    df = spark.createDataFrame([(packed_marks(x).tolist(), packed_marks(y).tolist()) for x, y in zip(a, b)], "a array<long>, b array<long>")
    assert [r.d for r in df.select(disagreeing("a", "b", N.REGISTERS).alias("d")).collect()] == (a != b).sum(axis=1).tolist()
    agree = rng.random((200_000, N.REGISTERS)) < 0.75
    assert (agree.sum(axis=1) < least_agreeing(N.REGISTERS, 0.75)).mean() < 1e-4


def test_held_by_others_bounds_the_intersection(spark):
    from curio.llm.banding import PARTS, held_by_others
    rng = np.random.default_rng(9)
    sets = {i: np.unique(rng.integers(-30, 30, rng.integers(1, 25)) * 7919).tolist() for i in range(20)}
    sets[20] = [10 ** 9 + k for k in range(5)]  # held by no other
    got = {r.rep: r.held for r in held_by_others(spark.createDataFrame(list(sets.items()), "rep long, shingles array<long>")).collect()}
    for a, x in sets.items():
        others = set().union(*(y for b, y in sets.items() if b != a))
        assert got[a] == [sum(s % PARTS == k and s in others for s in x) for k in range(PARTS)]
        assert all(len(set(x) & set(y)) <= sum(map(min, got[a], got[b])) for b, y in sets.items() if b != a)


def test_null_ids_and_two_texts_under_one_id(spark):
    long = lambda x, n=40: " ".join(f"{x}{i}" for i in range(n))
    rows = [(None, long("u")), (None, long("v")), (None, long("v")), (None, long("v") + " w"), (None, None), (None, ""),
            (3, long("a")), (3, long("b")), (3, long("a")), (5, long("b") + " x"), (None, long("a") + " y"), (9, None), (9, None)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept string").repartition(3)
    got = sorted((str(r.doc_id), str(r.text)[:2]) for r in N.keep(df).collect())
    assert got == sorted([("None", "u0"), ("None", "v0"), ("None", "No"), ("None", ""), ("3", "a0"), ("3", "b0"), ("9", "No")])
    out = N.near_duplicates(df).collect()
    assert len(out) == len(rows)
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in out if r.n_shingles) == sorted(
        [("None", "None", False)] * 4 + [("3", "3", True)] * 3 + [("5", "3", False), ("None", "3", False)])
