import hashlib
import random

import pytest
from pyspark.sql import functions as F

from curio.llm import bpe
from curio.llm.queries import QUERIES, vocab_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocab_path())


def test_automaton_equals_library(library):
    encode = bpe.Encoder(bpe.Vocabulary(vocab_path()))
    rnd = random.Random(7)
    alpha = list("aeot  \t\n\r\x0b\x1c\x85\xa0'sréß漢字🙂١²Ⅷ!?01-_") + ["<|endoftext|>", "'ll", " the", "thth"]
    for k in range(4000):
        text = "".join(rnd.choice(alpha if k % 2 else "etaoin") for _ in range(rnd.randint(0, 60)))
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_tables_at_their_limit_change_nothing(library):
    encode = bpe.Encoder(bpe.Vocabulary(vocab_path()))
    for limits in ((10, 3, 400_000), (10**6, 10**6, 5)):
        encode.automaton.max_states, encode.automaton.max_words, encode.automaton.max_arcs = limits
        for text in ["the others were thinking", "international banana", "x" * 5000, ""]:
            assert encode(text).tolist() == library.encode(text).ids


def test_edge_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b", "z"), (3, "a b", "z"), (None, "é" * 40000, "w"),
            (5, "end<|endoftext|> x", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    out = bpe.decode(bpe.encode(df, vocab_path()), vocab_path()).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in out) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert all(r.ids == library.encode(r.text or "").ids for r in out)
    same = bpe.encode_decode(df, vocab_path()).collect()
    assert sorted(map(repr, same)) == sorted(map(repr, out))
    plain = bpe.encode(df.where("doc_id = 5"), vocab_path(), special=False).first().ids
    assert 50256 not in plain
    assert bpe.encode(df.limit(0), vocab_path()).count() == 0


def test_decode_of_broken_sequences(spark, library):
    lists = [[], None, [50256, 0, 99999, -1], library.encode("é漢🙂").ids[1:], library.encode("a🙂").ids[:-1]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe.decode(df, vocab_path()).collect()}
    for i, x in enumerate(lists):
        known = [t for t in x or [] if 0 <= t <= 50256]
        assert got[i] == library.decode(known, skip_special_tokens=False)


def test_query_against_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op1_bpe"](spark, SF).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
