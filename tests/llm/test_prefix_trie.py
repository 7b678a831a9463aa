"""The conversation trie against plain Python."""

import hashlib
import random
import zlib

import pytest

from curio.llm import prefix_trie, queries


def brute(rows):
    """Nodes as tuples in the order of the contract's columns."""
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            talks.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in talks.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    out = []
    for k, m in members.items():
        below, leaves, saved = [k], 0, 0
        while below:
            v = below.pop()
            below += kids.get(v, [])
            leaves += v not in kids
            saved += (len(members[v]) - 1) * (len(v[-1][1].encode()) if v else 0)
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seqs[c]) == len(k)))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as pos", "2 as h", "3 as node")
    got = prefix_trie.build(*prefix_trie.grafted(prefix_trie.turns_of(df))).collect()
    return sorted([tuple(r) for r in got], key=repr)


@pytest.mark.parametrize("parts", [2, 50])
def test_against_brute_force(spark, parts):
    rnd = random.Random(parts)
    rows = []
    for c in range(300):
        if c % 7 == 3:
            continue
        length = rnd.randrange(1, 14) if c % 40 else 60
        for t in range(length):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {rnd.randrange(1 + t // 3)}" + "é" * (t % 3)))
    rows += [(c, 0, "user", "hello") for c in range(400, 520)]                 # a hot first turn
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 2400) for t in range(3)]   # copies of one conversation
    rows += [(600, None, None, None), (600, 1, "user", "x"), (600, 1, "user", "x"), (605, None, "", ""), (None, 1, "a", "b")]
    rnd.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = run(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows)


def test_small_tables(spark):
    assert run(spark, [(5, 0, "a", "b")]) == brute([(5, 0, "a", "b")])
    assert run(spark, [(3, 0, "a", "b")]) == brute([(3, 0, "a", "b")])
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert prefix_trie.build(*prefix_trie.grafted(prefix_trie.turns_of(empty))).collect() == []


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted([tuple(r) for r in queries.op11_prefix_trie(spark, sf).collect()], key=repr) == brute(rows)
