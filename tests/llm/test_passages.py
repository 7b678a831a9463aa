import random

from curio.llm import passages as G
from curio.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows):
    """doc -> places of the words that lie in a window which stands before."""
    first, gone = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().lower().split()
        for a in range(len(w) - G.WINDOW + 1):
            j, b = first.setdefault(tuple(w[a:a + G.WINDOW]), (i, a))
            if (j, b) != (i, a) and not (j == i and a < b + G.WINDOW):
                gone.setdefault(i, set()).update(range(a, a + G.WINDOW))
    return gone


def places(out):
    got = {}
    for r in out.collect():
        span = set(range(r.start_word, r.end_word))
        assert not span & got.setdefault(r.doc_id, set())
        got[r.doc_id] |= span
    return got


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert places(QUERIES["op2_passages"](spark, SF)) == brute(rows)


def test_inside_lines_across_lines_and_edges(spark):
    rnd = random.Random(8)
    own = lambda n: [f"u{rnd.randrange(10 ** 9)}" for _ in range(n)]
    passage = [f"p{i}" for i in range(81)]
    lines = "\n".join(" ".join(passage[k:k + 9]) for k in range(0, 81, 9)).upper()
    rows = [(1, " ".join(own(40) + passage + own(37))), (2, " ".join(own(33) + passage + own(45))), (3, f"head\n{lines}\ntail"),
            (4, " ".join(own(20) + passage[:49] + own(20))), (5, " ".join(own(20) + passage[10:60] + own(20))), (6, " ".join(["a"] * 500)),
            (7, " ".join(["a"] * 70)), (8, " ".join(own(60))), (9, None), (10, ""), (11, " ".join("xyz"[k % 3] for k in range(400)))]
    rows += [(20 + i, " ".join(own(rnd.randrange(60)) + passage + own(rnd.randrange(1, 60)))) for i in range(60)]
    df = spark.createDataFrame([(i, t, len(t or ""), "k") for i, t in rows], "doc_id long, text string, n_chars long, name string").repartition(4)
    want = brute(rows)
    assert places(G.repeated_passages(df)) == want and {2, 3, 5, 6, 7, 11, 79} <= set(want) and not {1, 4, 8} & set(want)
    clean = {r.doc_id: r for r in G.remove_passages(df).collect()}
    assert set(clean) == {i for i, _ in rows} - {7}
    for i, t in rows:
        if i != 7 and t:
            assert clean[i].text.split() == [w for k, w in enumerate(t.split()) if k not in want.get(i, ())]
    assert clean[3].text == "head\ntail" and clean[3].n_chars == 9 and clean[9].text is None and clean[1].text == rows[0][1]


def test_repeated_rows_null_ids_empty(spark):
    p = " ".join(f"q{i}" for i in range(60))
    df = spark.createDataFrame([(7, p + " x"), (7, p + " x"), (7, p + " y"), (None, "z " + p)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in G.remove_passages(df).where("doc_id is not null").collect()) == [(7, "x"), (7, "x"), (7, "y")]
    assert G.remove_passages(df).where("doc_id is null").first().text == "z " + p
    assert G.repeated_passages(df.limit(0)).count() == 0 and G.remove_passages(df.limit(0)).count() == 0


def test_pipeline_leaves_no_repeated_window(spark):
    import corpus_pipeline as P
    out = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(P.STAGES)
    rows = [(r.doc_id, r.text) for r in stages["substring_dedup"](spark, out, SF).collect()]
    assert not {i for i, x in brute(rows).items()}
