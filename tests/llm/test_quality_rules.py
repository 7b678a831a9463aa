import re
from collections import Counter

import numpy as np

from curio.llm import quality_rules as Q
from curio.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def check(df, docs):
    for r in df.collect():
        want = counts(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_query_counts_and_verdicts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = QUERIES["op9_quality_rules"](spark, SF)
    check(out, docs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [(r.kept, labels[r.doc_id]) for r in out.collect() if r.doc_id in labels and not r.base_failed]
    good = [k for k, q in rows if q == 1]
    assert sum(good) >= 0.98 * len(good)


def test_edges(spark):
    texts = [None, "", " \n\t ", "a", "x " * 30, "one\ntwo\none\n\none", "é🙂 " * 25, "a b c d e f g h a b c d e f g h i",
             " ".join(str(i) for i in range(30000)) + " 0 1 2 3 4 5 6 7", "w\x0bx\x0cy\rz\x85q"]
    docs = {i: t for i, t in enumerate(texts)}
    df = spark.createDataFrame([(i, t, 3) for i, t in docs.items()], "doc_id long, text string, kept int")
    check(Q.judge(df, []), docs)
    kept = Q.keep(df, [])
    assert kept.columns == ["doc_id", "text", "kept"] and {r.doc_id for r in kept.collect()} == {8}
    assert Q.judge(df.limit(0), []).count() == 0
    assert Q.learn(df, spark.createDataFrame([], "doc_id long, quality int")) == []


def test_sequential_covering():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    bad = ((x[:, 0] > 0.8) & (x[:, 1] < 0.5)) | (x[:, 2] > 0.9)
    rules = Q.learn_rules(x, bad, ["a", "b", "c"])
    hit = np.any([r.covers(x, ["a", "b", "c"]) for r in rules], axis=0)
    assert (hit & bad).sum() >= 0.85 * bad.sum() and (hit & ~bad).sum() <= 0.03 * (~bad).sum()


def test_learned_rules_find_bad_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rules = Q.learn(docs, labels)
    rows = Q.judge(docs, rules).join(labels, "doc_id").select("kept", "quality").collect()
    bad = [r for r in rows if r.quality == 0]
    assert sum(not r.kept for r in bad) >= 0.6 * len(bad)
