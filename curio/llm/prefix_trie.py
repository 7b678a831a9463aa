"""Operator 11, the prefix trie of conversations by fixed-length block hashing.

A conversation is a sequence of turns; its key at depth d is its first d turns.
Turns become 128-bit digests once and no text moves after that. ``BLOCK`` turns
in a row make a block, and a block's prefix digest (the exclusive-or of block digests, each
hashed with its number, so a running one over the blocks of a conversation) names
all turns before it. Conversations are grouped by successive prefix and block
digests first: equal blocks after equal prefixes become one row with the count and
the smallest id of their conversations, so a conversation that a third of all rows
repeat shrinks before any shuffle. Turn boundaries are refined from these rows.
Where a prefix is followed by one block only, every boundary inside it has the
block's count and is written at once; only blocks with siblings go on to be
grouped by their own turn prefixes.

Counts that belong to subtrees are summed upwards by doubling: after round k a
node holds the sums of its descendants less than 2^k below it and knows its
ancestor 2^k above, so rounds grow with the logarithm of the greatest depth.
Positions and prefix digests come from ``segmented_scan``: no window and no
array holds a whole conversation, a block row has at most ``BLOCK`` turns. The ids
that end at a node are hashed as a stream: range-partitioned and sorted by (node,
id), each partition hashes the nodes that lie in it alone and hands on the ids of
nodes that cross its edges in sorted pieces, which are then streamed per node.

Defined results: turns are ordered by ``turn`` (null first), ties by the digests of
their role and text; null roles and texts are empty. Rows without a conv_id belong
to no conversation. Repeated rows are repeated turns. Extra columns are ignored.
An empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curio.llm.common import ship
from curio.operators.scan import RunningXor, segmented_scan
from curio.session import discard, materialize

ship(__name__)

BLOCK = 4          # turns in a block
PIECE = 1024       # ids in one piece of a stream
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _digest(*parts) -> Column:
    """16 bytes that name the parts (numbers, or arrays of numbers as text)."""
    return F.unhex(F.md5(F.concat_ws(",", *[p.cast("string") for p in parts]).cast("binary")))


def turns_of(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, hi, lo, bytes)``: the turns of every conversation in
    order, each as the digest of its role and text and the text's length."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    thin = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("hi"),
        F.xxhash64(F.lit(11), text, role).alias("lo"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("hi").asc(), F.col("lo").asc()]
    return segmented_scan(thin, ["conv_id"], order, idx_col="pos").drop("turn")


def grafted(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations whose heads come from the first of their family: with
    ``h = crc32(conv_id) % most``, the first h turns of conversation
    ``conv_id - conv_id % family`` (``%`` as in SQL; all if fewer, none if absent), then the own
    turns after the first h. Returns ``(turns, conversations)``; a conversation may
    be left without turns."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    turn = F.struct("pos", "hi", "lo", "bytes")
    heads = turns.where(F.col("pos") < most - 1).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(turn)).alias("head"))             # at most `most` - 1 turns
    convs = turns.where("pos = 0").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    convs = convs.join(heads, "base", "left").select(
        "conv_id", "h", F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.array()), 1, F.greatest("h", F.lit(1)))).alias("head"))
    convs = materialize(convs.select("conv_id", "h", F.coalesce("head", F.array()).alias("head")), "trie-heads")
    own = turns.where(F.col("pos") >= h).join(convs.select("conv_id", "h", F.size("head").alias("n")), "conv_id").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "hi", "lo", "bytes")
    taken = convs.select("conv_id", F.inline("head"))
    return taken.unionByName(own), convs.select("conv_id")


def _blocks(turns: DataFrame) -> DataFrame:
    """``(conv_id, k, before_hi, before_lo, hi[], lo[], bytes[])``: the blocks of
    every conversation with the digest of all blocks before them."""
    rows = turns.groupBy("conv_id", F.floor(F.col("pos") / BLOCK).cast("long").alias("k")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "hi", "lo", "bytes"))).alias("t"))
    rows = rows.select("conv_id", "k", F.col("t.hi").alias("hi"), F.col("t.lo").alias("lo"), F.col("t.bytes").alias("bytes"))
    rows = rows.withColumns({"dhi": F.xxhash64("k", "hi"), "dlo": F.xxhash64("lo", "k")})
    done = segmented_scan(rows, ["conv_id"], [F.col("k").asc()], {"shi": RunningXor("dhi"), "slo": RunningXor("dlo")})
    return done.select("conv_id", "k", F.col("shi").bitwiseXOR(F.col("dhi")).alias("before_hi"),
                       F.col("slo").bitwiseXOR(F.col("dlo")).alias("before_lo"), "shi", "slo", "hi", "lo", "bytes")


def _at_end(k: Column, hi: Column, lo: Column) -> Column:
    """Name of the node after ``k`` whole blocks."""
    return _digest(F.lit("b"), k, hi, lo)


def _inside(j: Column) -> Column:
    """Name of the node after the first ``j`` turns of the row's block."""
    first = [F.array_join(F.slice(F.col(c), F.lit(1), j).cast("array<string>"), " ") for c in ("hi", "lo")]
    return F.when(j == BLOCK, _at_end(F.col("k") + 1, F.col("shi"), F.col("slo"))).otherwise(
        _digest(F.lit("t"), F.col("k"), F.col("before_hi"), F.col("before_lo"), *first))


def _root() -> Column:
    return _at_end(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"))


def _nodes(blocks: DataFrame) -> DataFrame:
    """``(node, parent, depth, n_convs, conv_id, bytes)`` of all depths from 1 on."""
    prefix = ["k", "before_hi", "before_lo"]
    kinds = materialize(blocks.groupBy(*prefix, "hi", "lo", "bytes", "shi", "slo").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")), "trie-blocks")
    # the first blocks are all siblings; later ones are counted under their prefix
    alone = kinds.where("k > 0").groupBy(*prefix).agg(F.count("*").alias("n")).where("n = 1").select(*prefix, F.lit(True).alias("alone"))
    later = kinds.where("k > 0").join(alone, prefix, "left")
    marked = later.unionByName(kinds.where("k = 0").withColumn("alone", F.lit(None).cast("boolean")))
    j = F.col("j")
    turned = marked.withColumn("j", F.explode(F.sequence(F.lit(1), F.size("hi")))).select(
        _inside(j).alias("node"),
        F.when(j > 1, _inside(j - 1)).otherwise(_at_end(F.col("k"), F.col("before_hi"), F.col("before_lo"))).alias("parent"),
        (F.col("k") * BLOCK + j).alias("depth"), "n_convs", "conv_id", F.element_at("bytes", j).alias("bytes"), "alone")
    single = turned.where("alone").drop("alone")
    apart = turned.where("alone is null").groupBy("node", "parent", "depth").agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("bytes").alias("bytes"))
    return single.unionByName(apart)


def _subtree_sums(nodes: DataFrame, values: list[str], depth: int) -> DataFrame:
    """``(node, values)`` with the values of all descendants added."""
    now = materialize(nodes.select("node", F.col("parent").alias("up"), *values), "trie-sums")
    reach = 1
    while reach <= depth:
        given = now.where("up is not null").groupBy(F.col("up").alias("node")).agg(*[F.sum(v).alias(v) for v in values])
        # the root has no ancestor, so nothing that points at it needs the look-up
        jump = now.where("up is not null").select(F.col("node").alias("up"), F.col("up").alias("next"))
        moved = now.where(F.col("up") != _root()).join(jump, "up", "left").select("node", F.col("next").alias("up"), *values)
        rest = now.where("up is null or up = " + "unhex('" + _root_hex() + "')").select(
            "node", F.lit(None).cast("binary").alias("up"), *values)
        parts = moved.unionByName(rest).unionByName(given.select("node", F.lit(None).cast("binary").alias("up"), *values))
        after = materialize(parts.groupBy("node").agg(F.max("up").alias("up"), *[F.sum(v).alias(v) for v in values]), "trie-sums")
        discard(now)
        now, reach = after, reach * 2
    return now.drop("up")


def _root_hex() -> str:
    return hashlib.md5(b"b,0,0,0").hexdigest()


class _Ids:
    """Streams sorted ``(node, id)`` rows: a node that is over is hashed; the
    first and the last node of the partition leave as pieces of sorted ids."""

    def __init__(self):
        self.node, self.first, self.ids, self.out = None, True, [], []

    def _piece(self):
        self.out.append((self.node, self.ids[0], ",".join(map(str, self.ids)), None))
        self.ids = []

    def close(self, last: bool):
        """The node at hand is over, or the partition is."""
        if self.node is None:
            return
        if self.first or last or self.split:
            if self.ids:
                self._piece()
        else:
            self.out.append((self.node, self.ids[0], None, hashlib.sha256(",".join(map(str, self.ids)).encode()).hexdigest()))
        self.first = False

    def add(self, nodes: list[bytes], ids: list[int]):
        for node, i in zip(nodes, ids):
            if node != self.node:
                self.close(False)
                self.node, self.ids, self.split = node, [], False
            self.ids.append(i)
            if len(self.ids) >= PIECE:
                self.split = True
                self._piece()

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _end_digests(ends: DataFrame) -> DataFrame:
    """``(node, ends_sha256)`` of all nodes at which conversations end."""
    schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("at", T.LongType()),
                           T.StructField("ids", T.StringType()), T.StructField("sha", T.StringType())])

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*out), (pa.binary(), pa.int64(), pa.string(), pa.string()))], schema.names)

    def cut(batches):
        stream = _Ids()
        for batch in batches:
            stream.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if out := stream.take():
                yield rows(out)
        stream.close(True)
        if out := stream.take():
            yield rows(out)

    cut_rows = materialize(ends.select("node", "conv_id").repartitionByRange("node", "conv_id")
                           .sortWithinPartitions("node", "conv_id").mapInArrow(cut, schema), "trie-ends")
    whole = cut_rows.where("sha is not null").select("node", F.col("sha").alias("ends_sha256"))
    out_schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("ends_sha256", T.StringType())])

    def stitch(batches):
        node, digest = None, None
        for batch in batches:
            done = []
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if n != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = n, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], out_schema.names)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], out_schema.names)

    # pieces only: two nodes a partition, and the nodes with more ids than a piece
    pieces = cut_rows.where("sha is null").repartition("node").sortWithinPartitions("node", "at")
    return whole.unionByName(pieces.mapInArrow(stitch, out_schema))


def build(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie over ``turns`` ``(conv_id, pos, hi, lo,
    bytes)`` of the conversations ``convs``: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    blocks = materialize(_blocks(turns), "trie-turns")
    whole = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    root = whole.where("n_convs > 0").select(
        _root().alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"),
        "n_convs", "conv_id", F.lit(0).cast("long").alias("bytes"))
    nodes = materialize(_nodes(blocks).unionByName(root), "trie-nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    known = materialize(nodes.join(children, "node", "left").na.fill(0, ["n_children"]), "trie-children")
    valued = known.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                          ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    depth, top = known.agg(F.max("depth"), F.min(F.when(F.col("depth") == 0, F.col("conv_id")))).first()
    sums = _subtree_sums(valued, ["n_leaves", "saved_tokens"], depth or 0)
    last = blocks.groupBy("conv_id").agg(F.max_by(F.struct("k", "before_hi", "before_lo", "shi", "slo", "hi", "lo"), "k").alias("b"))
    named = last.select("conv_id", "b.*").select("conv_id", _inside(F.size("hi")).alias("node"))
    ends = convs.join(named, "conv_id", "left").select("conv_id", F.coalesce("node", _root()).alias("node"))
    above = known.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    parents = known.where("depth > 1").join(above, "parent").unionByName(known.where("depth < 2").withColumn(
        "parent_conv_id", F.when(F.col("depth") == 1, F.lit(top).cast("long"))))
    return parents.join(sums, "node").join(_end_digests(ends), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
