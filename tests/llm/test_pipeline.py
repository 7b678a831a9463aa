import os
import sys

sys.path.insert(0, os.path.dirname(__file__))

from test_decontaminate import nearest  # noqa: E402
from test_near_dedup import brute as near_groups  # noqa: E402
from test_passages import brute as passages_of  # noqa: E402
from test_substring_dedup import brute as repeats

import corpus_pipeline as P
from curio.llm import decontaminate as D
from curio.llm.queries import vocab_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Every stage against a brute-force version on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r for r in out.collect()}
        out = P.materialize(stage(spark, out, SF), name)
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and out.count() == len(after)
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns
        if name == "near_dedup":
            groups = near_groups({i: r.text for i, r in before.items()})
            assert set(after) == {i for i, (_, c) in groups.items() if i == c}
        if name == "substring_dedup":
            found = repeats([(i, r.text) for i, r in before.items()])
            gone = {k for k, first in found.items() if k != first}
            rest = {i: "\n".join(x for p, x in enumerate(r.text.split("\n")) if (i, p) not in gone) for i, r in before.items()}
            cut = passages_of(list(rest.items()))
            for i, text in rest.items():
                words = [w for k, w in enumerate(text.encode().split()) if k not in cut.get(i, ())]
                assert (after[i].text if i in after else "").encode().split() == words
                if i not in cut:
                    assert (after[i].text if i in after else "").strip() == text.strip()
        if name == "decontamination":
            items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            for i, r in after.items():
                assert not any(x in " ".join(r.text.lower().split()) for x in items)
            for i in set(before) - set(after):  # clean rows stay
                words = D.words_of(before[i].text)
                assert len(words) >= 400 or any(nearest(D.words_of(x), words) <= D.edits_allowed(len(x.split())) for x in items)
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(vocab_path())
    assert all(r.round_trip and r.token_ids == library.encode(r.text).ids for r in after.values())


def test_odd_rows(spark):
    rows = [(None, None, None), (1, None, "en"), (2, "", None), (3, "same words " * 40, "en"), (3, "same words " * 40, "en"),
            (4, " ".join(f"w{i}" for i in range(50)), "en"), (5, " ".join(f"w{i}" for i in range(50)) + " x", "en")]
    docs = spark.createDataFrame([(*r, "s", 1, 1, "k") for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, kept int, rep string")
    docs = docs.selectExpr("*", "1 as token_ids", "2 as n_tokens", "3 as round_trip")
    out = docs
    for name, stage in P.STAGES:
        out = P.materialize(stage(spark, out, SF), name)
    assert [r.doc_id for r in out.collect()] == [4]
    empty = docs.limit(0)
    for name, stage in P.STAGES:
        empty = P.materialize(stage(spark, empty, SF), name)
    assert empty.count() == 0
    for name, stage in P.STAGES[1:]:  # without the first stage, rows without words reach the others
        docs = P.materialize(stage(spark, docs, SF), name)
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "2", "3", "4", "None"]
    assert D.MIN_ITEM_WORDS == 8
