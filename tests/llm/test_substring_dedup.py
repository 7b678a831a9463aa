import os
import random
import sys
from collections import defaultdict

sys.path.insert(0, os.path.dirname(__file__))

from test_passages import brute as passages_of
from test_passages import places

from curio.llm import substring_dedup as S
from curio.llm.banding import tune_bands
from curio.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, min_words=20, percent=75):
    """(doc, place) -> (first doc, first place) of every paragraph that repeats."""
    sets, where, root = {}, defaultdict(list), {}
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            w = line.encode().lower().split()
            if len(w) >= min_words:
                sets[i, p] = (tuple(w), frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)))
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in sorted(sets):
        common = defaultdict(int)
        for s in sets[k][1]:
            for j in where[s]:
                common[j] += 1
            where[s].append(k)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[k][1]) + len(sets[j][1]) - n):
                a, b = sorted((find(k), find(j)))
                root[b] = a
    size = defaultdict(int)
    for k in sets:
        size[find(k)] += 1
    return {k: find(k) for k in sets if size[find(k)] > 1}


def as_dict(df):
    return {(r.doc_id, r.paragraph): (r.first_doc_id, r.first_paragraph) for r in df.collect()}


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    both = QUERIES["op2_substring_dedup"](spark, SF)
    out = both.where("unit = 'paragraph'")
    want = brute(rows)
    assert as_dict(out) == want
    rest = [(i, "\n".join(x for p, x in enumerate((t or "").split("\n")) if want.get((i, p), (i, p)) == (i, p))) for i, t in rows]
    passages = both.where("unit = 'passage'")
    assert places(passages) == passages_of(rest)
    assert all(r.removed and r.n_words == r.end_word - r.start_word and (r.first_doc_id, r.first_word) < (r.doc_id, r.start_word)
               for r in passages.collect())
    assert all(r.removed == ((r.doc_id, r.paragraph) != (r.first_doc_id, r.first_paragraph)) for r in out.collect())


def test_hot_passage_near_copies_and_edges(spark):
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(1, 160):
        own = " ".join(f"u{rnd.randrange(10 ** 6)}" for _ in range(30))
        t = list(passage)
        if i % 3:
            t[rnd.randrange(60)] = f"z{rnd.randrange(10 ** 6)}"
        rows.append((i, f"{own}\n{' '.join(t)}\nshort line"))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, " ".join(passage)), (504, " ".join(["a"] * 20000)), (505, " ".join(["A"] * 20000))]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, cluster string").repartition(4)
    assert as_dict(S.repeated_paragraphs(df)) == brute(rows)
    clean = {r.doc_id: r for r in S.remove_repeats(df).collect()}
    assert set(clean) == {i for i, _ in rows} - {503, 505}
    assert "p59" in clean[1].text and all("short line" in clean[i].text and "p30" not in clean[i].text and "u" in clean[i].text
                                          for i in range(2, 160))
    assert clean[500].text is None and clean[501].text == "" and clean[2].cluster == "k"


def test_repeated_rows_null_ids_empty(spark):
    text = "\n".join(" ".join(f"q{k}{i}" for i in range(25)) for k in "ab")
    df = spark.createDataFrame([(7, text), (7, text), (None, text), (8, "other")], "doc_id long, text string")
    out = S.repeated_paragraphs(df).collect()
    assert sorted((r.doc_id is None, r.removed) for r in out) == [(False, True)] * 4 + [(True, False)] * 2
    assert sorted(str(r.doc_id) for r in S.remove_repeats(df).collect()) == ["8", "None"]
    assert S.repeated_paragraphs(df.limit(0)).count() == 0 and S.remove_repeats(df.limit(0)).count() == 0


def test_tuned_bands():
    rows, bands = tune_bands(0.75, 0.9995)
    assert 1 - (1 - 0.75 ** rows) ** bands >= 0.9995 > 1 - (1 - 0.75 ** rows) ** (bands - 1)


def test_word_hashes_and_paragraphs_of_a_batch(monkeypatch):
    from curio.llm import common
    rnd = random.Random(9)
    alpha = "aAbZ é漢 \t\n\x0b\x0c\r\x1c\xa0"
    texts = ["", "\n", " x", "a" * 9000 + " b", *("".join(rnd.choice(alpha) for _ in range(rnd.randrange(200))) for _ in range(300))]
    for chunk in (7, 1 << 20):
        monkeypatch.setattr(common, "CHUNK", chunk)
        raw, begin = common.joined_texts(texts)
        hashes, spots = common.hashed_words(raw)
        words = [w for t in texts for w in t.encode().lower().split()]
        assert len(words) == len(hashes) == len(spots)
        assert all(raw[s:s + len(w)] == w for s, w in zip(spots.tolist(), words))
        name = dict(zip(words, hashes.tolist()))
        assert [name[w] for w in words] == hashes.tolist() and len(set(name.values())) == len(name)
        for least in (1, 3):
            got = S.Paragraphs(texts, least)
            want = [(i, p, line.encode().lower().split()) for i, t in enumerate(texts) for p, line in enumerate(t.split("\n"))]
            want = [x for x in want if len(x[2]) >= least]
            assert [(i, p, n) for i, p, n in zip(got.rows.tolist(), got.places.tolist(), got.sizes.tolist())] == [
                (i, p, len(w)) for i, p, w in want]
            sets = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for _, _, w in want]
            assert got.counts.tolist() == [len(x) for x in sets] and len(got.shingles) == sum(map(len, sets))
            same = {}
            for key, (_, _, w) in zip(got.ids, want):
                assert same.setdefault(key, w) == w
            assert len(same) == len({tuple(w) for _, _, w in want})
