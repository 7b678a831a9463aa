"""BPE training against a plain trainer."""

from collections import Counter

import pytest

from curio.operators.tokenizer import SPACE_MARK, decode_tokens, encode_texts, train_bpe_vocab

SF = "/root/testdata/sf0.001"


def plain_bpe(texts, n_merges, split_digits=True):
    """Pieces in the order of their merges, one merge at a time."""
    counts = Counter(w for t in texts for w in (t or "").split())
    chars = Counter()
    for w, n in counts.items():
        for c in SPACE_MARK + w:
            chars[c] += n
    symbol = {c: k for k, (c, n) in enumerate(sorted(chars.items(), key=lambda x: (-x[1], x[0])))}
    names = list(symbol)
    words = [([symbol[c] for c in SPACE_MARK + w], n) for w, n in counts.items()]
    out = []
    for _ in range(n_merges):
        pairs = Counter()
        for w, n in words:
            for p in zip(w, w[1:]):
                pairs[p] += n
        if split_digits:
            pairs = {p: n for p, n in pairs.items() if not any(c in "0123456789" for c in names[p[0]] + names[p[1]])}
        if not pairs:
            break
        a, b = min(pairs, key=lambda p: (-pairs[p], max(p), p))
        piece = names[a] + names[b]
        if piece not in symbol:
            symbol[piece] = len(names)
            names.append(piece)
        out.append(piece)
        for k, (w, n) in enumerate(words):
            if a in w:
                new, i = [], 0
                while i < len(w):
                    if w[i:i + 2] == [a, b]:
                        new.append(symbol[piece])
                        i += 2
                    else:
                        new.append(w[i])
                        i += 1
                words[k] = (new, n)
    return list(dict.fromkeys(out))


def learned(vocab, n):
    return [r["piece"] for r in vocab.where("token_id >= 259").orderBy("token_id").limit(n).collect()]


@pytest.mark.parametrize("bounds", [{}, {"pairs_per_round": 40, "segments_per_round": 30}, {"pairs_per_round": 7}])
def test_equal_to_a_plain_trainer(spark, bounds):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r["text"] for r in docs.collect()][:60] + ["aaaa aaa aaaaaaa banana bananas 2024 20 x1y", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    n = 60 if "segments_per_round" in bounds else 150
    want = plain_bpe(texts, n)
    assert learned(train_bpe_vocab(spark, df, n, **bounds), len(want)) == want


def test_until_nothing_is_left_and_ties(spark):
    texts = ["aaaa aaa aab abab baba abc abc 11 121 a1b", "xyxyxy yxyx zz zzz zzzz"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for split in (True, False):
        want = plain_bpe(texts, 500, split)
        for most in (1, 2, 5, 1000):
            got = learned(train_bpe_vocab(spark, df, 500, split_digits=split, pairs_per_round=most), len(want))
            assert got == want
    assert train_bpe_vocab(spark, df.limit(0), 10).count() == 259


def test_private_use_and_mark_characters_come_back(spark):
    rows = [(1, "a  b ▁ c▁"), (2, ""), (3, " ▁ "), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = train_bpe_vocab(spark, docs, 20)
    got = {r["doc_id"]: r["text"] for r in decode_tokens(encode_texts(spark, docs, vocab), vocab).collect()}
    assert got == {i: t or "" for i, t in rows}
