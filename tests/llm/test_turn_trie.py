import hashlib
import random
import zlib

from pyspark.sql import functions as F

from spanloom.llm import turn_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def brute(rows):
    rows = [r for r in rows if r[0] is not None]
    convs = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        convs.setdefault(conv, []).append((role or "", text or ""))
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = {}
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in below)]
        ends = sorted(c for c in members if rebuilt[c] == prefix)
        out[min(members), len(prefix)] = (
            min(nodes[prefix[:-1]]) if prefix else None, len(members), sum(len(p) == len(prefix) + 1 for p in below), len(childless),
            sum((len(nodes[p]) - 1) * len(p[-1][1].split()) for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def run(spark, rows):
    table = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    turns = turn_trie.numbered_turns(table)
    ids = table.select("conv_id").where("conv_id is not null").distinct()
    found = turn_trie.prefix_trie(turn_trie.borrowed_starts(turns), ids)
    return {(r.conv_id, r.depth): tuple(r)[2:] for r in found.collect()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(120):
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv, None if turn == 0 and conv % 3 == 0 else turn, rng.choice(["user", None, "assistant"]), rng.choice(["a b", "c", None, ""])))
    rows.append((None, 1, "user", "left out"))
    assert run(spark, rows) == brute(rows)


def test_deep_chain_and_many_leaves(spark):
    rows = [(1, t, "user", f"w{t}") for t in range(150)] + [(c, t, "user", f"w{t}") for c in range(500, 520) for t in range(140)]
    rows += [(c, 0, "user", "same first turn") for c in range(1000, 1100)]
    assert run(spark, rows) == brute(rows)


def test_totals_of_a_long_conversation_cross_segments(spark):
    turns = spark.range(1, 10_001).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("pos"), F.lit("x").alias("digest"), F.lit(1).cast("long").alias("words"))
    sums = turn_trie.running_sums(turns)
    row = sums.agg(F.max("depth"), F.countDistinct("s0", "s1", "s2", "s3"), F.count("*")).first()
    assert tuple(row) == (10_000, 10_000, 10_000)


def test_empty_table(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, None, None, None)]) == {}
