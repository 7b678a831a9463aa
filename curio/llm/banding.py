"""From bucket memberships to confirmed links, without the pairs of a group.

Used by the near-duplicate operators. A bucket's members are first compared with
one pivot; members that links already put into one component are never compared
again, so a group of copies costs rows in proportion to its size. Members that
the bucket's largest component has not taken in are then compared with every
member of another component. Each pair that shares a bucket is so compared or
already joined. Nothing is capped.

This second comparison is a condition of the join: each member carries its
sketch as packed marks, and the numbers of its set's elements that any other of
these members holds, one for each of ``PARTS`` parts of the hash space. A pair leaves the
join only if enough marks agree, and if the smaller numbers, whose sum the
intersection can't exceed, allow the similarity; and only in the first bucket that
the two share. So the pairs that these rule out are never rows, which matters in a
group whose members are alike, but not enough to be linked. The members of a bucket
of more than ``HEAVY`` are cut into blocks and every two blocks compared by their
marks as matrices (``_alike_in_heavy``): a pair costs some ten nanoseconds instead of
microseconds, and one bucket's pairs are the work of many tasks.
"""

from __future__ import annotations

from math import comb
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curio.llm.common import ship
from curio.llm.components import connected_components
from curio.session import discard, materialize

ship(__name__)


def size_ok(n_a, n_b, percent: int):
    """Sizes that allow a Jaccard similarity of ``percent``."""
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def tune_bands(similarity: float, recall: float, unlike: float = 0.2, noise: float = 0.5,
               max_rows: int = 8) -> tuple[int, int]:
    """``(rows, bands)`` with the fewest bands that find a pair at ``similarity``
    with probability ``recall`` and one at ``unlike`` with ``noise`` at most."""
    best = None
    for rows in range(1, max_rows + 1):
        bands, missed = 1, 1 - similarity ** rows
        while 1 - missed ** bands < recall:
            bands += 1
        if 1 - (1 - unlike ** rows) ** bands <= noise and (best is None or bands < best[1]):
            best = (rows, bands)
    if best is None:
        raise ValueError("no banding meets both bounds")
    return best


LANES, LANE_BITS = 7, 9  # 63 bits: a sum of two lanes' low bits never reaches the sign
_TOP = sum(1 << (LANE_BITS * k + LANE_BITS - 1) for k in range(LANES))
_LOW = ((1 << (LANES * LANE_BITS)) - 1) ^ _TOP
MISSED = 5e-6


def packed_marks(sketch: np.ndarray) -> np.ndarray:
    """The low 9 bits of each entry of a sketch (or of each sketch of a matrix),
    7 to a 64-bit integer; the last one is filled with zeros."""
    groups = -(-sketch.shape[-1] // LANES)
    marks = np.zeros((*sketch.shape[:-1], groups * LANES), np.int64)
    marks[..., :sketch.shape[-1]] = sketch.astype(np.int64) & ((1 << LANE_BITS) - 1)
    return (marks.reshape(*sketch.shape[:-1], groups, LANES) << (np.arange(LANES, dtype=np.int64) * LANE_BITS)).sum(axis=-1)


def least_agreeing(entries: int, similarity: float, missed: float = MISSED) -> int:
    """The most agreeing entries that may be asked of a pair so that one at
    ``similarity`` fails with probability ``missed`` at most."""
    below = 0.0
    for k in range(entries + 1):
        below += comb(entries, k) * similarity ** k * (1 - similarity) ** (entries - k)
        if below > missed:
            return k
    return entries


def disagreeing(a: str, b: str, entries: int):
    """How many of the entries differ, from two columns of packed marks."""
    total = F.lit(0)
    for k in range(-(-entries // LANES)):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        # a lane's top bit is set if the lane isn't zero
        total = total + F.bit_count((x.bitwiseAND(_LOW) + F.lit(_LOW)).bitwiseOR(x).bitwiseAND(_TOP))
    return total


PARTS, COARSE = 32, 8


def held_by_others(sets: DataFrame) -> DataFrame:
    """``(rep, held, coarse)``: how many elements of each set ``(rep, shingles)`` are in
    another of the sets, one count for each part of the hash space (and for ``COARSE``
    unions of parts, a quicker and weaker bound). All counts have partial sums before the shuffle."""
    key = F.xxhash64("rep").alias("key")
    rows = sets.select(key, F.explode("shingles").alias("shingle"))
    alone = rows.groupBy("shingle").agg(F.min("key").alias("key"), F.max("key").alias("last")).where("key = last")
    signed = rows.withColumn("c", F.lit(1)).unionByName(alone.select("key", "shingle", F.lit(-1).alias("c")))
    part = F.pmod("shingle", F.lit(PARTS))
    held = signed.groupBy("key").agg(*[F.sum(F.when(part == k, F.col("c")).otherwise(0)).alias(f"p{k}") for k in range(PARTS)])
    coarse = [sum((F.col(f"p{k}") for k in range(i, PARTS, COARSE)), F.lit(0)) for i in range(COARSE)]
    return sets.select("rep", key).join(held.select(
        "key", F.array(*[f"p{k}" for k in range(PARTS)]).alias("held"), F.array(*coarse).alias("coarse")), "key").drop("key")


HEAVY, BLOCK = 256, 2048


def _agreeing(x: np.ndarray, y: np.ndarray, entries: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of two matrices of packed marks that agree in ``least`` entries at least."""
    def lanes(marks):
        places = np.arange(LANES, dtype=np.int64) * LANE_BITS
        return np.ascontiguousarray(((marks[:, :, None] >> places) & ((1 << LANE_BITS) - 1)).reshape(len(marks), -1)[:, :entries].T.astype(np.uint16))
    a, b = lanes(x), lanes(y)
    agree = np.zeros((a.shape[1], b.shape[1]), np.uint16)
    for k in range(entries):
        agree += a[k][:, None] == b[k][None, :]
    return np.nonzero(agree >= least)


def _alike_in_heavy(rows: DataFrame, tasks: int, percent: int, entries: int, least: int) -> DataFrame:
    """``(a, b)`` of the pairs of one bucket and two parts whose sizes, marks and elements held by
    others allow the similarity. ``rows``: ``(bucket, size, main, rep, n, part, marks, held)``; every two
    blocks of a bucket are one group, dealt to ``tasks`` tasks as their rows don't tell their work."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    cells = rows.select("bucket", "rep", "n", "part", (F.col("part") != F.col("main")).alias("stranger"), "marks",
                        F.col("held").cast("array<int>").alias("held"), own.alias("own"),
                        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")).withColumns(
        {"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other").repartition(tasks, "bucket", "i", "j")
    kind = rows.schema["rep"].dataType

    def run(key, table):
        own, n, stranger = (table[c].to_numpy() for c in ("own", "n", "stranger"))
        marks, held = np.stack(table["marks"].to_numpy()), np.stack(table["held"].to_numpy())
        part = table["part"].combine_chunks().dictionary_encode().indices.to_numpy()
        first, second = np.flatnonzero(own == key[1].as_py()), np.flatnonzero(own == key[2].as_py())
        x, y = _agreeing(marks[first], marks[second], entries, least)
        good = [np.empty((2, 0), np.int64)]
        for at in range(0, len(x), 1 << 16):
            p, q = first[x[at:at + (1 << 16)]], second[y[at:at + (1 << 16)]]
            some = (part[p] != part[q]) & (stranger[p] | stranger[q]) & (100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q]))
            p, q = p[some], q[some]
            common = np.minimum(held[p], held[q]).sum(axis=1, dtype=np.int64)
            some = (100 + percent) * common >= percent * (n[p] + n[q])
            good.append(np.stack((p[some], q[some])))
        a, b = np.concatenate(good, axis=1)
        return pa.table({"a": table["rep"].take(pa.array(a)), "b": table["rep"].take(pa.array(b))})

    found = cells.groupBy("bucket", "i", "j").applyInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def linked(members: DataFrame, percent: int, entries: int, sets_of: Callable[[DataFrame], DataFrame],
           likely: Callable[[DataFrame], DataFrame] | None = None, missed: float = MISSED) -> DataFrame:
    """Links ``(a, b)`` that give the components of all similar pairs which share
    a bucket. ``members``: ``(rep, n, buckets array<long>, marks array<long>)``, one
    row per distinct set, the buckets in the order of the bands, the marks packed from a sketch of ``entries``; ``likely``
    may drop pairs, ``sets_of`` writes the full sets ``(rep, shingles)`` of a table of
    reps. A pair at the similarity fails the test of the marks with probability
    ``missed`` at most."""
    likely = likely or (lambda pairs: pairs)
    rows = members.select(F.explode("buckets").alias("bucket"), "rep", "n")
    counts = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    items = materialize(rows.join(counts, "bucket"), "buckets")
    meets = items.groupBy("rep").agg(F.sum("size").alias("meets"))
    # the pivot is the member that meets the most others over all its buckets
    pivots = items.join(meets, "rep").groupBy("bucket").agg(
        F.min(F.struct(F.negative("meets").alias("meets"), "rep", "n")).alias("p")).select(
        "bucket", F.col("p.rep").alias("pivot"), F.col("p.n").alias("n_pivot"))
    tried = materialize(
        items.join(pivots, "bucket").where(F.col("rep") != F.col("pivot")).where(size_ok(F.col("n"), F.col("n_pivot"), percent))
        .select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct(), "pivot-pairs")
    hopeful = materialize(likely(tried), "pivot-likely")
    sets = sets_of(ends_of(hopeful, "rep"))
    links = confirm_by_sets(hopeful, sets, percent)
    for done in (hopeful, sets):
        discard(done)

    parts = connected_components(links, "a", "b")
    placed = materialize(items.join(parts, F.col("rep") == F.col("node"), "left").select(
        "bucket", "rep", "n", F.coalesce("component", "rep").alias("part")), "placed")
    discard(items)
    sizes = placed.groupBy("bucket", "part").agg(F.count("*").alias("c"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("c", "part")).alias("m"), F.count("*").alias("parts")).where(
        "parts > 1").select("bucket", F.col("m.part").alias("main"))
    written = materialize(placed.join(main, "bucket"), "split")
    sets = sets_of(written.select("rep").distinct())
    facts = materialize(members.select("rep", "marks", "buckets").join(held_by_others(sets), "rep"), "facts")
    sized = written.groupBy("bucket").agg(F.count("*").alias("size"))
    light, heavy = sized.where(F.col("size") <= HEAVY).select("bucket"), sized.where(F.col("size") > HEAVY)
    blocks = F.ceil(F.col("size") / BLOCK)
    cells = heavy.agg(F.sum(blocks * (blocks + 1) / 2)).first()[0] or 0
    split = (written.join(light, "bucket", "left_semi") if cells else written).join(facts, "rep")
    strangers = split.where("part <> main").select(
        "bucket", F.col("rep").alias("x"), F.col("n").alias("n_x"), F.col("part").alias("part_x"),
        F.col("marks").alias("marks_x"), F.col("held").alias("held_x"), F.col("coarse").alias("coarse_x"), F.col("buckets").alias("buckets_x"))
    least = least_agreeing(entries, percent / 100, missed)
    alike = disagreeing("marks", "marks_x", entries) <= entries - least

    def enough(column, parts):
        common = sum((F.least(F.col(column)[k], F.col(f"{column}_x")[k]) for k in range(1, parts)),
                     F.least(F.col(column)[0], F.col(f"{column}_x")[0]))
        return (100 + percent) * common >= percent * (F.col("n") + F.col("n_x"))

    # every shared bucket shows a pair of two parts once; the first of them speaks for all
    first = F.element_at(F.array_intersect("buckets", "buckets_x"), 1) == F.col("bucket")
    rest = strangers.join(split, "bucket").where(
        (F.col("part_x") != F.col("part")) & ((F.col("part") == F.col("main")) | (F.col("x") < F.col("rep")))
        & size_ok(F.col("n"), F.col("n_x"), percent) & enough("coarse", COARSE) & enough("held", PARTS) & alike & first).select(
        F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b"))
    if cells:
        crowd = written.join(heavy, "bucket").join(facts.select("rep", "marks", "held"), "rep")
        tasks = int(min(cells, max(2 * written.sparkSession.sparkContext.defaultParallelism, cells // 4)))
        rest = rest.unionByName(_alike_in_heavy(crowd, tasks, percent, entries, least))
    rest = rest.distinct()
    hopeful = materialize(likely(rest.join(tried, ["a", "b"], "left_anti")), "rest-likely")
    more = confirm_by_sets(hopeful, sets, percent)
    for done in (placed, written, tried, hopeful, sets, facts):
        discard(done)
    return links.unionByName(more)


def confirm_by_sets(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets ``(rep, shingles)`` reach the similarity, written."""
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"s_{x}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    union = F.size("s_a") + F.size("s_b") - both
    return materialize(pairs.join(side("a"), "a").join(side("b"), "b").where(100 * both >= percent * union)
                       .select("a", "b"), "links")


def ends_of(pairs: DataFrame, name: str) -> DataFrame:
    """The distinct ends of the pairs as column ``name``."""
    return pairs.select(F.col("a").alias(name)).unionByName(pairs.select(F.col("b").alias(name))).distinct()


BROADCAST_ROWS = 4_000_000  # narrow rows; some 100 MB as a hash table


def semi_join(big: DataFrame, few: DataFrame, on) -> DataFrame:
    """Rows of ``big`` (with texts) that ``few`` (narrow, written) names. When
    ``few`` is counted to be small it is broadcast, so texts that aren't wanted
    never enter a shuffle; otherwise the plain join holds."""
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    return big.join(few, on(few) if callable(on) else on, "left_semi")
