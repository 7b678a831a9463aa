"""Training, encoding and decoding on arrays give what the plain steps give."""

import random

import numpy as np
import pytest

from curio.operators import tokenizer as tk


def vocabulary(rng, n, ties):
    pieces = sorted({*"ab▁éx", *("".join(rng.choice("ab▁éx") for _ in range(rng.randint(2, 5))) for _ in range(n))})
    rng.shuffle(pieces)
    return [(tk.BYTE_OFFSET + 256 + k, p, float(-(k // 4) if ties else -k)) for k, p in enumerate(pieces)]


@pytest.mark.parametrize("seed", range(6))
def test_segments_merged_side_by_side_equal_one_by_one(seed, monkeypatch):
    rng = random.Random(seed)
    pieces = tk._Pieces(vocabulary(rng, 10 * seed, seed % 2) if seed else [])
    segments = list({"".join(rng.choice("ab é▁漢😀x") for _ in range(rng.randint(1, 70))) for _ in range(150)} | {" ", "▁"})
    want = {x: np.array(tk._merged_ids(x, pieces), np.int32).tobytes() for x in segments}
    one_by_one = []
    plain = tk._merged_ids
    monkeypatch.setattr(tk, "_merged_ids", lambda x, p: one_by_one.append(x) or plain(x, p))
    assert tk._encoded(segments, pieces) == want
    assert all(len(x.encode()) > tk._SHORT for x in one_by_one)


def test_round_trip_of_odd_rows(spark):
    rng = random.Random(9)
    vocab = spark.createDataFrame([(i, p, s, 1) for i, p, s in vocabulary(rng, 40, False)], tk.VOCAB_SCHEMA)
    texts = [None, "", " ", "\n", "ab" * 5000, "▁a ▁", "漢 é\tx", "a\u0000b"] + ["".join(rng.choice("abéx \n") for _ in range(200)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = tk.encode_texts(spark, docs, vocab)
    got = {r["doc_id"]: r["text"] for r in tk.decode_tokens(enc, vocab).collect()}
    assert got == {k: t or "" for k, t in enumerate(texts)}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [0, 1, 2]), (4, [3 + 97, None, -5, 10 ** 12, 3 + 98, 3 + 0xC3])], "k int, ids array<long>")
    assert {r["k"]: r["text"] for r in tk.decode_tokens(odd, vocab).collect()} == {1: None, 2: "", 3: "", 4: "ab�"}
    assert {r["k"]: r["text"] for r in tk.decode_tokens(odd, vocab, strip_pad=False).collect()}[3] == "⁇ "


def test_a_round_merges_what_the_words_hold():
    rng = random.Random(4)
    for _ in range(50):
        merges, newest = [], 6
        for _ in range(rng.randint(1, 8)):
            merges.append((rng.randrange(newest), rng.randrange(newest), newest))
            newest += 1
        if rng.random() < 0.3:             # a piece that is there already
            merges.append((0, 1, 5))
        merges = list({m[:2]: m for m in merges}.values())
        table = {(a, b): (rank, symbol, a, b) for rank, (a, b, symbol) in enumerate(merges)}
        gaps = set(tk._gaps(merges).tolist())
        for _ in range(30):
            word = [rng.randrange(6) for _ in range(12)]
            cuts = [0] + [k + 1 for k in range(11) if (word[k] << tk._PAIR | word[k + 1]) not in gaps] + [12]
            apart = [s for a, b in zip(cuts, cuts[1:]) for s in tk._merged(word[a:b], table)]
            assert apart == tk._merged(word, table)
