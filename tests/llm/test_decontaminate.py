import random

from curio.llm import decontaminate as D
from curio.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def nearest(item, words):
    """Least edits of the item against any run of words, by the plain table."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(words):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rnd = random.Random(2)
    for _ in range(300):
        a = [b"%d" % rnd.randrange(4) for _ in range(rnd.randint(1, 80))]
        b = [b"%d" % rnd.randrange(4) for _ in range(rnd.randint(0, 90))]
        edits, end = D.best_match(a, b)
        assert edits == nearest(a, b)
        back = D.best_match(a[::-1], b[:end][::-1], anchored=True)
        assert back[0] == edits


def edited(words, k, rnd):
    words = list(words)
    for _ in range(k):
        at = rnd.randrange(len(words))
        words[at:at + rnd.randint(0, 1)] = [b"e%d" % rnd.randrange(10 ** 6)] * rnd.randint(0, 1)
    return words


def test_recall_against_brute_force():
    rnd = random.Random(4)
    items = [(i, " ".join(f"w{rnd.randrange(400)}" for _ in range(rnd.randint(8, 60)))) for i in range(60)]
    index, memo = D.Index(items), D.WordHash()
    want = found = 0
    for i, text in items:
        item = D.words_of(text)
        for k in range(D.edits_allowed(len(item)) + 2):
            for _ in range(4):
                pad = [[b"p%d" % rnd.randrange(10 ** 6) for _ in range(rnd.randint(0, 40))] for _ in range(2)]
                words = pad[0] + edited(item, k, rnd) + pad[1]
                inside = nearest(item, words) <= D.edits_allowed(len(item))
                got = any(m[0] == i for m in index.matches(b" ".join(words).decode(), memo))
                assert inside or not got
                want += inside
                found += got
    assert found >= 0.97 * want and want > 500


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [(r.item_id, D.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for r in docs:
        words = D.words_of(r.text)
        have = set(words)
        for i, item in items:
            if len(have & set(item)) * 2 >= len(set(item)):  # needed for 15 % edits
                text = b" ".join(words)
                if b" ".join(item) in text or (len(words) < 400 and nearest(item, words) <= D.edits_allowed(len(item))):
                    want.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in QUERIES["op8_decontamination"](spark, SF).collect()}
    long = {r.doc_id for r in docs if len(D.words_of(r.text)) >= 400}
    assert want <= got and all(d in long for d, _ in got - want) and want


def test_edges(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, None), (2, ""), (3, "x " + item.upper() + " y"), (3, "x " + item + " y"), (None, item), (4, "clean text only"),
            (5, " ".join(f"v{i}" for i in range(20000)) + " " + item), (6, (item + " ") * 3)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, edits string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, item)], "item_id long, text string")
    got = D.contaminated(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.start_word, r.edits) for r in got if r.item_id == 1) == [
        (0, 1, 0, 0), (3, 1, 1, 0), (3, 1, 1, 0), (5, 1, 20000, 0), (6, 1, 0, 0), (6, 1, 10, 0), (6, 1, 20, 0)]
    assert sorted(map(str, D.contaminated(docs, bench, block_bytes=1).collect())) == sorted(map(str, got))
    clean = D.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [1, 2, 4]
    assert D.contaminated(docs.limit(0), bench).count() == 0 and D.contaminated(docs, bench.limit(0)).count() == 0


def test_rows_that_share_an_id_are_judged_apart(spark):
    item = " ".join(f"i{k}" for k in range(12))
    clean = [(None, "clean one"), (None, None), (7, "clean two"), (7, ""), (8, "clean three")]
    dirty = [(None, "x " + item), (7, item + " y"), (7, item + " y"), (9, item)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in clean + dirty], "doc_id long, text string, text_key int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted((str(r.doc_id), str(r.text)) for r in D.remove_contaminated(docs, bench).collect()) == sorted(
        (str(i), str(t)) for i, t in clean)


def test_short_items_word_for_word(spark):
    bench = [(1, "What is it?"), (2, "seven words make up this short item"), (3, ""), (4, "what IS it?"), (5, "yes")]
    rows = [(1, "so what is it? what is it?"), (2, "what is"), (3, "it? what is"), (4, "a seven words make up this short item b"),
            (5, "seven words make up the short item"), (6, "yes"), (7, "yes yes, no"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = D.contaminated(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.start_word, r.end_word, r.edits) for r in got) == [
        (1, 1, 1, 4, 0), (1, 1, 4, 7, 0), (1, 4, 1, 4, 0), (1, 4, 4, 7, 0), (4, 2, 1, 8, 0), (6, 5, 0, 1, 0), (7, 5, 0, 1, 0)]
