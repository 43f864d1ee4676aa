"""Ranked tours, ancestors of pairs and permutations against plain walks of the tree."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import hierarchy as H
from spanloom.operators import signal as G
from spanloom.operators.tours import tour
from tests.test_trees import dense, tree

EDGES = "tree_id string, parent string, child string, length double, label string, is_tip boolean"


def random_tree(seed, n):
    """Parents drawn at random, so that chains, stars and single children all occur."""
    draw = random.Random(seed)
    parent = {"n0": None} | {f"n{i}": f"n{draw.randrange(max(0, i - 4), i)}" for i in range(1, n)}
    inner = set(parent.values())
    return [(f"t{seed}", p, c, None if p is None else draw.randint(1, 9) / 2, f"l{c}", c not in inner) for c, p in parent.items()]


def walk(rows):
    """Places, tips before, and tips below, by recursion."""
    kids = {}
    for _, p, c, *_ in rows:
        kids.setdefault(p, []).append(c)
    tips = {r[2] for r in rows if r[5]}
    out, place, seen = {}, 0, 0

    def visit(node):
        nonlocal place, seen
        first, before = place, seen
        place += 1
        seen += node in tips
        for k in sorted(kids.get(node, [])):
            visit(k)
        out[node] = (first, place, before, seen - before)
        place += 1

    visit("n0")
    return out


def test_places_and_sums(spark):
    forests = [random_tree(seed, n) for seed, n in enumerate((1, 2, 30, 90))]
    edges = spark.createDataFrame([r for f in forests for r in f], EDGES)
    mixed = F.when(F.col("is_tip"), F.xxhash64("label"))
    got = {}
    for r in tour(edges, {"tips": F.col("is_tip").cast("long")}, {"mixed": mixed}).collect():
        got.setdefault(r.tree_id, {})[r.node] = r
    hashes = {(r.tree_id, r.child): r.h for r in edges.select("tree_id", "child", mixed.alias("h")).collect()}
    for i, rows in enumerate(forests):
        expected = walk(rows)
        assert {n: (r["first"], r["last"], r.before_tips, r.tips) for n, r in got[f"t{i}"].items()} == expected
        for n, (first, last, *_) in expected.items():
            below = [hashes[f"t{i}", m] or 0 for m, v in expected.items() if first <= v[0] <= last]
            assert got[f"t{i}"][n].mixed == int(np.bitwise_xor.reduce(np.array(below, dtype=np.int64)))


def test_no_rows_and_cycles(spark, monkeypatch):
    assert tour(spark.createDataFrame([], EDGES), {"tips": F.lit(1)}).count() == 0
    monkeypatch.setattr("spanloom.operators.tours.MOST_ROUNDS", 6)
    ring = [("t", "a", "b", 1.0, "b", False), ("t", "b", "a", 1.0, "a", False)]
    with pytest.raises(ValueError, match="cycle"):
        tour(spark.createDataFrame(ring, EDGES))


def test_shared_lengths_of_all_pairs(spark):
    rows = random_tree(7, 60)
    up = {c: (p, length) for _, p, c, length, *_ in rows}

    def line(node):
        out = {}
        while node is not None:
            out[node] = up[node][1] or 0.0
            node = up[node][0]
        return out

    tips = {r[4]: line(r[2]) for r in rows if r[5]}
    got = {(r.tip_i, r.tip_j): r.shared for r in H.covariance(spark.createDataFrame(rows, EDGES)).collect()}
    assert got == pytest.approx({(a, b): sum(v for n, v in x.items() if n in y) for a, x in tips.items() for b, y in tips.items()})


def test_caterpillar(spark):
    """A tree as deep as it has tips: two rows a node and ~ log2 rounds."""
    n = int(os.environ.get("CATERPILLAR_TIPS", "100"))
    base = spark.range(n).withColumn("name", F.lpad(F.col("id").cast("string"), 9, "0"))
    above = F.when(F.col("id") > 0, F.concat(F.lit("i"), F.lpad((F.col("id") - 1).cast("string"), 9, "0")))
    inner = base.select(F.lit("t").alias("tree_id"), above.alias("parent"), F.concat(F.lit("i"), "name").alias("child"), F.lit(1.0).alias("length"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("is_tip"))
    tips = base.select(F.lit("t"), F.concat(F.lit("i"), "name"), F.concat(F.lit("a"), "name"), F.lit(1.0), F.concat(F.lit("a"), "name"), F.lit(True))
    edges = inner.union(tips)
    order = H.tip_order(edges)
    assert order.where(F.col("label") != F.concat(F.lit("a"), F.lpad((F.col("position") - 1).cast("string"), 9, "0"))).count() == 0
    assert order.count() == n
    pairs = spark.createDataFrame([("t", f"a{n - 1:09d}", f"a{n // 2:09d}")], "tree_id string, tip_i string, tip_j string")
    assert H.shared_length(edges, pairs).first().shared == n // 2


def test_permutation_p_by_plain_formulas(spark):
    """More orders than one row holds, and the last row not full."""
    text, nsim, seed = "((A:1.5,B:1,E:0.5):1,((C:2,D:1):0.7,F:2.2):0.4);", 70, 5
    x = dict(zip("ABCDEF", (1.0, 2.5, -1.0, 0.3, 4.0, 2.0)))
    traits = spark.createDataFrame([(t, v, 3.0) for t, v in x.items()], "s string, v double, flat double")
    got = {r.trait: r for r in G.signal_k(tree(spark, text), traits, "s", ["v", "flat"], nsim, seed).collect()}
    tips, c = dense(text)
    inv, one = np.linalg.inv(c), np.ones(len(tips))
    total = one @ inv @ one
    names = sorted(x)
    keys = spark.range(1, nsim).select(F.col("id").cast("int").alias("perm")).crossJoin(traits.select(F.col("s").alias("tip"))).select("perm", "tip", F.xxhash64(F.lit(seed), "perm", "tip").alias("h"))
    ranked = {0: names}
    for r in keys.orderBy("perm", "h", "tip").collect():
        ranked.setdefault(r.perm, []).append(r.tip)

    def k(order):
        value = {t: x[names[i]] for i, t in enumerate(order)}
        v = np.array([value[t.split("/")[-1]] for t in labels])
        a = one @ inv @ v / total
        return (v - a) @ (v - a) / ((v - a) @ inv @ (v - a)) / ((np.trace(c) - len(v) / total) / (len(v) - 1))

    by_node = {r.child: r.label for r in tree(spark, text).where("is_tip").collect()}
    labels = [by_node.get(t, t) for t in tips]
    ks = {p: k(order) for p, order in ranked.items()}
    assert got["v"].k == pytest.approx(ks[0])
    assert got["v"].p_value == pytest.approx(np.mean([v >= ks[0] * (1 - 1e-12) for v in ks.values()]))
    assert got["flat"].k is None and got["flat"].p_value is None


def test_drawn_orders_equal_sorted_ones(spark):
    """Trees above ``most_drawn`` are sorted by Spark; both ways draw the same orders, and a value is not spread over them."""
    text = "((A:1.5,B:1,E:0.5):1,((C:2,D:1):0.7,F:2.2):0.4);"
    traits = spark.createDataFrame([(t, v) for t, v in zip("ABCDEFF", (1.0, 2.5, -1.0, 0.3, 4.0, 2.0, 2.0))], "s string, v double")
    a, b = (G.signal_k(tree(spark, text), traits, "s", ["v"], 300, 5, most).first() for most in (G.MOST_DRAWN, 3))
    assert a.k == pytest.approx(b.k) and a.p_value == b.p_value
    values = spark.range(1, 61).select(F.lit("t").alias("tree_id"), F.lit("v").alias("trait"), F.concat(F.lit("s"), "id").alias("tip"), F.col("id").alias("idx"), F.sin("id").alias("x"))
    edges = values.select("tree_id", F.lit("r").alias("parent"), F.col("tip").alias("child"), F.lit(1.0).alias("length"), F.col("tip").alias("label"), F.lit(True).alias("is_tip"))
    moments = G.drawn_moments(edges, values, 300, 5, [f"x{i}" for i in range(32)]).toPandas()
    assert sorted(moments["block"]) == list(range(10))  # a row per node and 32 orders, not per value
    sums = moments[[f"__m_x{i}" for i in range(32)]].to_numpy().ravel()
    assert np.isnan(sums).sum() == 20 and np.allclose(sums[~np.isnan(sums)], np.sin(np.arange(1, 61)).sum())
