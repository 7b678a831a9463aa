"""Operator 3, MinHash near-dedup with SetSketch registers.

A document is the set of its 5-word shingles (64-bit hashes). Its sketch has 128
registers ``floor(1 - log_b h_i)``, cut to 16 bits, where ``h_i`` is the least of
the set's exponential variates under the i-th hash: exponentially spaced truncated
minima. Registers of a union are the larger of the parts' (``merge_registers``),
and two sets agree in a register with a probability near their Jaccard
similarity. Then:

1. Documents with equal sets (a 128-bit digest of the whole set) form a class
   with one representative; copies are never compared again.
2. Runs of 4 registers, 32 of them, are hashed to buckets. A pair at similarity
   0.75 shares no bucket with a probability of (1 - 0.75^4)^32 = 5e-6, less above.
3. In each bucket one pivot is compared with all others: the member that meets
   the most others over all its buckets. Members that the links so far put into
   one component need no further comparison, whatever their number. The others,
   which neither the pivot nor a chain of links joins to the bucket's largest
   component, are compared with every member of another component, inside the
   join: a pair leaves it only if so many registers agree (by 9 bits of each) that
   a pair at the similarity falls short with a probability of 5e-6 at most, and if
   the shingles of each that any other such document holds are enough. So each
   pair that shares a bucket is compared or already joined; nothing is capped, and
   neither copies nor members that are not linked make a row per pair.
4. A pair goes on if its sizes allow the similarity, and if the joint likelihood
   of its registers (Ertl's SetSketch model, sizes known) at any similarity that
   would pass is at least e^-16 of its maximum.
5. Pairs are confirmed on the full shingle sets, read again from the texts of just
   these documents. Components of the confirmed links are the groups.

Defined results: null or empty text and text without words: empty set, linked with
nothing, its own component, kept. Fewer words than a shingle: the whole sequence
is one shingle. Classes are named by their digest, so rows that share an id but not
the text are told apart; ``component_id`` is the least id of the group. Rows with a
null id belong to the class of their text but name no group: ``component_id`` is
null if no row of the group has an id, and they are not ``kept``; ``keep`` keeps one
row of such a group too. Extra columns don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curio.llm.banding import linked, packed_marks, semi_join
from curio.llm.common import WordHash, list_array, ship, shingle_hashes, sliced, texts_of, word_hashes
from curio.llm.components import connected_components
from curio.session import discard, materialize

ship(__name__)

WORDS, ROWS, BANDS = 5, 4, 32
REGISTERS = ROWS * BANDS
BASE, RATE = 1.001, 20.0  # spacing of the registers; rate of the variates
PERCENT = 75
_ODD = np.random.default_rng(75).integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(76).integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2)

SKETCH_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("n_shingles", T.LongType()),
    T.StructField("set_id", T.BinaryType()), T.StructField("registers", T.BinaryType()),
    T.StructField("marks", T.ArrayType(T.LongType()))])


def shingle_set(text: str, memo: WordHash, width: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(word_hashes(text, memo), width))


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers (16 bits) of a set; blocks keep memory bounded."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        block = shingles[at:at + 256, None] * _ODD + _ADD
        np.minimum(least, block.min(axis=0), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0 ** 64
    h = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, 65535).astype("<u2")


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def log_likelihoods(over: np.ndarray, under: np.ndarray, n_a: np.ndarray, n_b: np.ndarray,
                    grid: np.ndarray) -> np.ndarray:
    """Joint log-likelihood of pairs (rows) at each similarity of ``grid``:
    ``over`` and ``under`` count registers of a above and below those of b."""
    share = (n_a / (n_a + n_b))[:, None]
    highest = np.minimum(share / (1 - share), (1 - share) / share)
    j = np.minimum(grid[None, :], highest * (1 - 1e-9))
    def p(x):
        return -np.log(np.maximum(1 - x * (BASE - 1) / BASE, 1e-300)) / np.log(BASE)
    up = np.maximum(p(share - (1 - share) * j), 1e-12)
    down = np.maximum(p((1 - share) - share * j), 1e-12)
    same = np.maximum(1 - up - down, 1e-12)
    equal = (REGISTERS - over - under)[:, None]
    return over[:, None] * np.log(up) + under[:, None] * np.log(down) + equal * np.log(same)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def sketch(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """One row per document: key of the text, set size, set digest, registers and
    their packed marks (null for an empty set)."""
    def run(batches):
        memo = WordHash()
        for batch in sliced(batches):
            sets = [shingle_set(t, memo, width) for t in texts_of(batch.column(2))]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            known: dict = {}
            for d, s in zip(digests, sets):
                if d is not None and d not in known:
                    regs = registers(s)
                    known[d] = regs.tobytes(), packed_marks(regs)
            found = [known.get(d, (None, None)) for d in digests]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                 pa.array([r for r, _ in found], pa.binary()), pa.array([m for _, m in found], pa.list_(pa.int64()))],
                names=SKETCH_SCHEMA.names)

    return _keyed(docs).mapInArrow(run, SKETCH_SCHEMA)


def shingle_rows(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """``(rep, shingles)``, digest and full set of every text."""
    def run(batches):
        memo = WordHash()
        for batch in sliced(batches):
            sets = [shingle_set(t, memo, width).view(np.int64) for t in texts_of(batch.column(0))]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), list_array(sets, pa.int64())],
                                             names=["rep", "shingles"])

    return docs.select("text").mapInArrow(run, "rep binary, shingles array<long>")


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs whose registers don't rule the similarity out."""
    side = lambda x: sketches.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")
    grid = np.concatenate([np.linspace(0.0, percent / 100, 40), np.linspace(percent / 100, 1.0, 30)])

    def run(batches):
        for batch in sliced(batches, rows=8192):
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in (4, 5))
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (2, 3))
            fit = log_likelihoods((a > b).sum(axis=1), (a < b).sum(axis=1), n_a, n_b, grid)
            keep = fit[:, 40:].max(axis=1) >= fit.max(axis=1) - 16
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return joined.mapInArrow(run, "a binary, b binary")


def _sets_of(reps: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The full sets of ``reps``, made anew from the texts of just the documents
    where these classes are first, as a written table."""
    named = materialize(reps, "named")
    wanted = materialize(classes.join(named, "rep", "left_semi").select(
        F.col("where.doc_id").alias("i"), F.col("where.text_key").alias("k")).distinct(), "wanted")
    keyed = _keyed(docs)
    texts = semi_join(keyed, wanted, lambda few: keyed["doc_id"].eqNullSafe(few["i"]) & (keyed["text_key"] == few["k"]))
    sets = materialize(shingle_rows(texts, width).join(named, "rep", "left_semi").dropDuplicates(["rep"]), "shingle-sets")
    discard(named)
    discard(wanted)
    return sets


def near_duplicate_links(docs: DataFrame, sketches: DataFrame, percent: int = PERCENT, width: int = WORDS) -> DataFrame:
    """Confirmed links ``(a, b)`` between representatives that give the same
    components as all links between them."""
    buckets = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(
        i, F.substring(F.col("registers"), i * (2 * ROWS) + 1, F.lit(2 * ROWS)))).alias("buckets")
    return linked(sketches.select("rep", "n", buckets, "marks"), percent, REGISTERS,
                  lambda reps: _sets_of(reps, sketches, docs, width), lambda p: _likely(p, sketches, percent))


def groups(docs: DataFrame, percent: int = PERCENT, width: int = WORDS) -> DataFrame:
    """``(doc_id, text_key, n_shingles, group_id)`` for every row of ``docs``
    (columns ``doc_id``, ``text``); the group is null for a text without words."""
    rows = materialize(sketch(docs, width), "sketches")
    classes = materialize(rows.where("set_id is not null").groupBy(F.col("set_id").alias("rep")).agg(
        F.first("n_shingles").alias("n"), F.first("registers").alias("registers"), F.first("marks").alias("marks"),
        F.min(F.struct("doc_id", "text_key")).alias("where")), "classes")
    links = near_duplicate_links(docs, classes, percent, width)
    parts = connected_components(links, "a", "b")
    return rows.select("doc_id", "text_key", "n_shingles", "set_id").join(parts, F.col("set_id") == F.col("node"), "left").select(
        "doc_id", "text_key", "n_shingles", F.coalesce("component", "set_id").alias("group_id"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WORDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``
    (columns ``doc_id``, ``text``)."""
    rows = groups(docs, percent, width)
    least = rows.where("group_id is not null").groupBy("group_id").agg(F.min("doc_id").alias("least_id"))
    return rows.join(least, "group_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("group_id").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep(docs: DataFrame, percent: int = PERCENT, width: int = WORDS) -> DataFrame:
    """One row of each group of ``docs``, the first by (doc_id, text), a null id
    last. Rows without words stay; of those with one id and one text, one."""
    rows = groups(docs, percent, width)
    firsts = rows.where("group_id is not null").groupBy("group_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")).alias("first"))
    kept = materialize(firsts.select("first.doc_id", "first.text_key").unionByName(
        rows.where("group_id is null").select("doc_id", "text_key").distinct()).select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")), "kept")
    key = F.xxhash64(F.col("text").cast("string"))
    found = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["__id"]) & (key == kept["__key"]), "left_semi")
    bare = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return found.where(bare).unionByName(found.where(~bare).withColumn("__key", key).dropDuplicates(["doc_id", "__key"]).drop("__key"))
