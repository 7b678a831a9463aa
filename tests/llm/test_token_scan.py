from pyspark.sql import functions as F

from curio.llm import token_scan as T
from curio.llm.queries import QUERIES, vocab_path
from curio.session import scratch_path

SF = "/root/testdata/sf0.001"


def counts(df):
    return sorted((r.file, r.document, r.n_tokens) for r in df.collect())


def test_blocks_of_any_size_agree(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (4, "x y " * 500), (5, "a<|endoftext|>b"), (5, "a<|endoftext|>b")],
                                 "doc_id long, text string").repartition(2)
    path = scratch_path(spark, "token-test")
    T.write_token_files(docs, path, vocab_path(), 50256)
    whole = counts(T.scan(spark, path, 50256))
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(vocab_path())
    library.encode_special_tokens = True
    want = sorted(len(library.encode(r.text or "").ids) for r in docs.collect())
    assert sorted(n for _, _, n in whole) == want
    for block in (1, 2, 3, 7, 64, 1000):
        assert counts(T.scan(spark, path, 50256, block_tokens=block)) == whole
    wide = scratch_path(spark, "token-test")
    T.write_token_files(docs, wide, vocab_path(), 50256, width=4)
    assert sorted(n for _, _, n in counts(T.scan(spark, wide, 50256, width=4, block_tokens=5))) == want


def test_open_end_and_empty(spark, tmp_path):
    import numpy as np
    np.array([9, 9, 0, 9, 9, 9], "<u2").tofile(tmp_path / "a.bin")
    np.array([0, 0], "<u2").tofile(tmp_path / "b.bin")
    (tmp_path / "c.bin").write_bytes(b"")
    for block in (1, 2, 100):
        got = T.scan(spark, str(tmp_path), 0, block_tokens=block).select(
            F.regexp_extract("file", r"(\w)\.bin", 1).alias("f"), "document", "n_tokens").collect()
        assert sorted(map(tuple, got)) == [("a", 0, 2), ("a", 1, 3), ("b", 0, 0), ("b", 1, 0)]


def test_query_equals_encoding(spark):
    got = {r.doc_id: r.n_tokens for r in QUERIES["op7_token_counts"](spark, SF).collect()}
    want = {r.doc_id: r.n_tokens for r in QUERIES["op1_bpe"](spark, SF).collect()}
    assert got == want
