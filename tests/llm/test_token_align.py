"""Token alignment against the tokenizers' own libraries and plain Python."""

import hashlib
from collections import Counter

import pytest

from curio.llm import queries, token_align
from curio.llm.bpe import byte_alphabet


@pytest.fixture(scope="module")
def tools():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(queries.vocab_path())
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=queries.vocab_path("piece_bpe_32k.model"))


def b_bytes(piece):
    if len(piece) == 6 and piece.startswith("<0x"):
        return bytes.fromhex(piece[3:5])
    return piece.replace("▁", " ").encode()


def brute(rows, tools):
    a_tok, b_tok = tools
    alphabet = {c: bytes([b]) for c, b in byte_alphabet().items()}
    docs = []
    for d, text in rows:
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        a_text = [b"".join(alphabet[c] for c in a_tok.id_to_token(i)) for i in a]
        b_text = [b_bytes(b_tok.id_to_piece(i)) for i in b]
        if not text or b"".join(a_text) != (" " + text).encode() or b"".join(b_text) != (" " + text).encode():
            docs.append((d, [], [], []))
            continue
        groups, links, i, j, at_a, at_b, ga, gb = [], [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                ga.append(a[i])
                at_a += len(a_text[i])
                i += 1
            else:
                gb.append(b[j])
                at_b += len(b_text[j])
                j += 1
            if at_a == at_b and ga and gb:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                links.append((ga[-1], gb[-1]))
                ga, gb = [], []
        docs.append((d, a, b, list(zip(groups, links))))
    count = Counter(link for _, _, _, g in docs for _, link in g)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    return sorted([(d, len(a), len(b), len(g), len(g), sum(count[x] == top[x[1]] for _, x in g), sum(count[x] for _, x in g),
                    hashlib.sha256(";".join(s for s, _ in g).encode()).hexdigest() if g else "") for d, a, b, g in docs], key=repr)


ODD = ["", None, " ", "  two  spaces ", "<|endoftext|> is text", "a▁b", "éè café naïve", "\U0001F600 你好世界",
       "tabs\tand\nlines\r\n\n", "x" * 30_000, "\x00\x1c\x85\xa0", "don't you'll we've", "ﬁ ligature ①", "</s> <s> <unk> <0x41> A",
       "the cat the cat the cat"]


@pytest.mark.parametrize("heavy", [token_align.HEAVY, 5])
def test_odd_texts_against_the_libraries(spark, tools, heavy, monkeypatch):
    monkeypatch.setattr(token_align, "HEAVY", heavy)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (3, "again"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as odd")
    got = token_align.align(docs, queries.vocab_path(), queries.vocab_path("piece_bpe_32k.model")).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, tools)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_align.align(docs, queries.vocab_path(), queries.vocab_path("piece_bpe_32k.model")).collect() == []


@pytest.mark.parametrize("held", [token_align.HELD, 500])
def test_query_against_the_libraries(spark, tools, held, monkeypatch):
    monkeypatch.setattr(token_align, "HELD", held)
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_token_alignment(spark, sf).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, tools)
