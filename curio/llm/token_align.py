"""Operator 13, alignment of two tokenizers' tokens with an identity-map fast path.

Every text is encoded by a byte-level BPE (A, of space + text) and by a piece model
(B, which adds the space itself). Byte offsets at which tokens of both end cut the
text into groups, and the two tokens that end there are linked. ``Pair`` holds, for
each A id, the B id with the same bytes: a group of one A and one B token that this
array joins is regular and is counted in a vector as long as A's vocabulary, so
nothing of it is shuffled but one vector a task. All other links are irregular:
their (A, B) pairs are counted in each task first and then by a shuffle of pairs.

Corpus counts come back to documents without hot keys: the regular counts and the
highest count of each B id are vectors of vocabulary length; irregular pairs with at
least one in ``HEAVY`` of all irregular links are at most ``HEAVY``, a proven bound,
and are broadcast; the rest, each rarer than that, meet their documents in an
equi-join on the pair. Texts are encoded once; what a document holds of each pair is
written as narrow lists.

Defined results: null and empty texts and texts whose tokens' bytes differ from
space + text (a piece model may normalise) have no tokens, zeros everywhere and ''
as digest. Rows are independent: repeated rows and ids stay, each row counts in the
corpus. Extra columns are ignored. An empty table gives an empty table. No text is
cut, whatever its length.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curio.llm.bpe import PRESPLIT, read
from curio.llm.common import list_array, ship, sliced, texts_of
from curio.session import materialize

ship(__name__)

HEAVY = 100_000        # pairs that may be broadcast
HELD = 1_000_000       # pairs that a task holds before it hands them on


def piece_bytes(piece: str) -> bytes:
    """Bytes of a piece: ``<0xHH>`` is one byte, U+2581 a space."""
    byte = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


def load(a_path: str, b_path: str) -> dict:
    """The two vocabularies as plain data: token bytes by id, and B's model file.
    Vocabulary files are a few MB; they are read on the driver."""
    from sentencepiece import SentencePieceProcessor
    a = read(a_path)
    size = max(a["labels"]) + 1
    with open(b_path, "rb") as f:
        model = f.read()
    b = SentencePieceProcessor(model_proto=model)
    return {"a": [a["labels"].get(i, b"") for i in range(size)], "special": sorted(a["special"].values()), "model": model,
            "b": [b"" if b.IsControl(i) or b.IsUnknown(i) else piece_bytes(b.IdToPiece(i)) for i in range(b.GetPieceSize())]}


def identity_map(a: list[bytes], b: list[bytes], special=()) -> np.ndarray:
    """For each A id the smallest B id with the same bytes that is no byte
    fallback unless nothing else is, else -1."""
    by_bytes: dict[bytes, int] = {}
    for i, label in enumerate(b):
        if label and (len(label) > 1 or label not in by_bytes):
            by_bytes.setdefault(label, i)
    for i in range(len(b) - 1, -1, -1):      # a piece of one byte stands behind the fallbacks
        if len(b[i]) == 1 and by_bytes[b[i]] < i:
            by_bytes[b[i]] = i
    skip = set(special)
    return np.array([-1 if i in skip else by_bytes.get(label, -1) if label else -1 for i, label in enumerate(a)], np.int64)


class Pair:
    """Both tokenizers in a worker, built once for all its tasks."""

    def __init__(self, plain: dict):
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        special = set(plain["special"])
        ranks = {label: i for i, label in enumerate(plain["a"]) if label and i not in special}
        self.encode_a = tiktoken.Encoding("a", pat_str=PRESPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.encode_b = SentencePieceProcessor(model_proto=plain["model"]).encode
        self.a, self.b = plain["a"], plain["b"]
        self.a_len = np.fromiter(map(len, self.a), np.int64, len(self.a))
        self.b_len = np.fromiter(map(len, self.b), np.int64, len(self.b))
        self.same = identity_map(self.a, self.b, special)
        # decimal ids with what follows them: A inside, A at the end, B inside, B at the end of a group
        self.words = [f"{i}{sep}".encode() for size, seps in ((len(self.a), ",|"), (len(self.b), ",;")) for sep in seps
                      for i in range(size)]

    @staticmethod
    def of(plain: dict) -> Pair:
        if "built" not in plain:
            plain["built"] = Pair(plain)
        return plain["built"]

    def __call__(self, text: str):
        """``(a ids, b ids, last A and last B token of each group)`` or None."""
        if not text:
            return None
        whole = (" " + text).encode("utf-8", "replace")
        a, b = self.encode_a(" " + text), self.encode_b(text)
        if b"".join(map(self.a.__getitem__, a)) != whole or b"".join(map(self.b.__getitem__, b)) != whole:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        at = np.searchsorted(ends_b, ends_a)
        last_a = np.flatnonzero(ends_b[at] == ends_a)
        return a, b, last_a, at[last_a]

    def digest(self, a, b, last_a, last_b) -> str:
        """SHA-256 of the groups in order, ``a1,a2|b1;a3|b2,b3``."""
        n_a, n_b, n = len(a), len(b), len(last_a)
        end_a, end_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        end_a[last_a], end_b[last_b] = 1, 1
        group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
        words = np.empty(n_a + n_b, np.int64)
        words[np.arange(n_a) + np.r_[0, last_b + 1][group_a]] = a + end_a * len(self.a)
        words[np.arange(n_b) + (last_a + 1)[group_b]] = b + 2 * len(self.a) + end_b * len(self.b)
        return hashlib.sha256(b"".join(map(self.words.__getitem__, words.tolist()))[:-1]).hexdigest()


_LISTS = [T.StructField("same", T.ArrayType(T.IntegerType(), False)), T.StructField("same_n", T.ArrayType(T.IntegerType(), False)),
          T.StructField("odd", T.ArrayType(T.LongType(), False)), T.StructField("odd_n", T.ArrayType(T.IntegerType(), False))]
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def aligned(docs: DataFrame, plain) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups_sha256)`` and the links of
    each document: A ids of regular ones and codes ``A * |B| + B`` of the others,
    each once with its number. ``plain``: the broadcast of ``load``."""
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in _COUNTS],
                           T.StructField("groups_sha256", T.StringType()), *_LISTS])

    def run(batches):
        pair = Pair.of(plain.value)
        width, none = len(pair.b), np.empty(0, np.int64)
        for batch in sliced(batches):
            counts, shas, lists = [], [], [[], [], [], []]
            for text in texts_of(batch.column(1)):
                found = pair(text)
                if found is None:
                    counts.append((0, 0, 0, 0))
                    shas.append("")
                    parts = (none, none, none, none)
                else:
                    a, b, last_a, last_b = found
                    counts.append((len(a), len(b), len(last_a), len(last_a)))
                    shas.append(pair.digest(*found))
                    left, right = a[last_a], b[last_b]
                    regular = ((np.diff(last_a, prepend=-1) == 1) & (np.diff(last_b, prepend=-1) == 1)
                               & (pair.same[left] == right))
                    parts = (*np.unique(left[regular], return_counts=True),
                             *np.unique(left[~regular] * width + right[~regular], return_counts=True))
                for out, part in zip(lists, parts):
                    out.append(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in zip(*counts)], pa.array(shas, pa.string())]
                + [list_array(x, pa.int64() if k == 2 else pa.int32()) for k, x in enumerate(lists)], schema.names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _compact(codes: list, counts: list):
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(at, np.concatenate(counts), len(code)).astype(np.int64)


def pair_counts(links: DataFrame, a_size: int) -> DataFrame:
    """``(regular, code, n)``: links of each pair in the whole corpus; ``code``
    is the A id of a regular one."""
    schema = T.StructType([T.StructField("regular", T.BooleanType()), T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])

    def rows(regular, code, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(code), regular)), pa.array(code, pa.int64()), pa.array(n, pa.int64())], schema.names)

    def run(batches):
        vector = np.zeros(a_size, np.int64)
        codes, counts, held = [], [], 0
        for batch in batches:
            same, same_n, odd, odd_n = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns)
            vector += np.bincount(same, same_n, a_size).astype(np.int64)
            codes.append(odd)
            counts.append(odd_n)
            held += len(odd)
            if held > HELD:
                code, n = _compact(codes, counts)
                codes, counts, held = [code], [n], len(code)
                if held > HELD // 2:
                    yield rows(False, code, n)
                    codes, counts, held = [], [], 0
        used = np.flatnonzero(vector)
        yield rows(True, used, vector[used])
        if codes:
            yield rows(False, *_compact(codes, counts))

    return links.select(*[f.name for f in _LISTS]).mapInArrow(run, schema).groupBy("regular", "code").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256."""
    spark = docs.sparkSession
    plain = load(a_path, b_path)
    a_size, b_size = len(plain["a"]), len(plain["b"])
    same = identity_map(plain["a"], plain["b"], plain["special"])
    links = materialize(aligned(docs, spark.sparkContext.broadcast(plain)).withColumn("row", F.monotonically_increasing_id()), "token-links")
    counts = materialize(pair_counts(links, a_size), "pair-counts")
    odd = counts.where("not regular").select("code", "n", (F.col("code") % b_size).cast("int").alias("b"))
    # vectors of vocabulary length
    regular = np.zeros(a_size, np.int64)
    for r in counts.where("regular").select("code", "n").collect():
        regular[r["code"]] = r["n"]
    best = np.zeros(b_size, np.int64)
    total = 0
    for r in odd.groupBy("b").agg(F.max("n").alias("most"), F.sum("n").alias("n")).collect():
        best[r["b"]], total = r["most"], total + r["n"]
    known = same >= 0
    np.maximum.at(best, same[known], regular[known])
    regular_best = known & (regular == best[np.maximum(same, 0)])
    # at most HEAVY pairs can each be one in HEAVY of all links
    is_heavy = F.col("n") >= F.lit(max(1, -(-total // HEAVY)))
    heavy = sorted((r["code"], r["n"]) for r in odd.where(is_heavy).select("code", "n").collect())
    heavy_code, heavy_n = (np.array([h[k] for h in heavy], np.int64) for k in (0, 1))
    sums = spark.sparkContext.broadcast((regular, regular_best, heavy_code, heavy_n, heavy_n == best[heavy_code % b_size]))
    base_schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    cold_schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("code", T.LongType()), T.StructField("times", T.LongType())])

    def split_lists(batch):
        """Rows, codes and numbers of the irregular links, and which are heavy."""
        codes, heavy_codes = batch.column(3), sums.value[2]
        row = np.repeat(np.arange(batch.num_rows), np.diff(codes.offsets.to_numpy()))
        code, n = codes.flatten().to_numpy(), batch.column(4).flatten().to_numpy()
        if not len(heavy_codes):
            return row, code, n, np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        at = np.minimum(np.searchsorted(heavy_codes, code), len(heavy_codes) - 1)
        return row, code, n, at, heavy_codes[at] == code

    def per_row(row, values, n):
        out = np.zeros(n, np.int64)
        np.add.at(out, row, values)
        return out

    def known_sums(batches):
        counts_a, best_a, _, counts_h, best_h = sums.value
        for batch in batches:
            m = batch.num_rows
            ids, times = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy().astype(np.int64)
            of = np.repeat(np.arange(m), np.diff(batch.column(1).offsets.to_numpy()))
            count, good = per_row(of, counts_a[ids] * times, m), per_row(of, best_a[ids] * times, m)
            row, _, n, at, hit = split_lists(batch)
            if hit.any():
                n = n[hit].astype(np.int64)
                count += per_row(row[hit], counts_h[at[hit]] * n, m)
                good += per_row(row[hit], best_h[at[hit]] * n, m)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good), pa.array(count)], base_schema.names)

    def cold_rows(batches):
        for batch in batches:
            row, code, n, _, hit = split_lists(batch)
            rest = ~hit
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[rest])), pa.array(code[rest]),
                                              pa.array(n[rest].astype(np.int64))], cold_schema.names)

    lists = links.select("row", *[f.name for f in _LISTS])
    most = spark.createDataFrame([(i, int(n)) for i, n in enumerate(best) if n], "b int, most long")
    rare = odd.where(~is_heavy).join(F.broadcast(most), "b").select("code", "n", (F.col("n") == F.col("most")).cast("long").alias("is_best"))
    cold = lists.mapInArrow(cold_rows, cold_schema).join(rare, "code").select(
        "row", (F.col("times") * F.col("is_best")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    both = lists.mapInArrow(known_sums, base_schema).unionByName(cold).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return links.select("row", "doc_id", *_COUNTS, "groups_sha256").join(both, "row").select(
        "doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256")
