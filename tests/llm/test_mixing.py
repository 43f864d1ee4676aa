import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.llm import mixing as M


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else weight[s] * left / free for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def rows_of(seed):
    draw = random.Random(seed)
    out = [(i, " ".join("x" * draw.randint(1, 60)), draw.choice(["a", "B", "é", "c", None])) for i in range(300)]
    return out + [(900, None, "a"), (901, "", "tiny"), (902, "one two", "tiny"), (None, "no id", "c"), (902, "one two", "tiny"), (903, None, "void")]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken(spark, seed):
    rows = rows_of(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mixture(docs).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    target = plain_targets(sizes)
    assert len(got) == len(rows)
    taken, most = {}, {}
    for r in got:
        s = r["source"]
        assert r["__size"] == words(r["text"]) and r["__source_size"] == sizes[s] and abs(r["__target"] - target[s]) < 1e-6
        assert 0 <= r["__copies"] <= 3 and len(r["__places"]) == r["__copies"] and all(-1e-9 <= p <= 1 + 1e-9 for p in r["__places"])
        taken[s] = taken.get(s, 0) + r["__copies"] * r["__size"]
        most[s] = max(most.get(s, 0), r["__size"])
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6 for s in sizes)


@pytest.mark.parametrize("points", [((0.0, 2.0), (1.0, 1.0)), ((0.0, 1.0), (0.5, 2.0), (1.0, 1.0)), ((0.0, 1.0), (0.3, 1.0), (1.0, 4.0))])
def test_demand_inverse(spark, points):
    steps = 10_000

    def weight(t):
        for (t0, w0), (t1, w1) in zip(points, points[1:]):
            if t <= t1:
                return w0 + (w1 - w0) * (t - t0) / (t1 - t0)

    whole = sum(weight((i + 0.5) / steps) for i in range(steps))
    shares = [0.0, 0.1, 0.33, 0.5, 0.75, 0.99, 1.0]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").select(M.demand_inverse(F.col("s"), points)).collect()]
    for share, t in zip(shares, got):
        area = sum(weight((i + 0.5) / steps) for i in range(int(round(t * steps)))) / whole
        assert abs(area - share) < 1e-3


def test_mix_repeats_rows_in_order(spark):
    docs = spark.createDataFrame(rows_of(3), "doc_id long, text string, source string").withColumn("size", F.lit("s")).withColumn("place", F.lit(1))
    marked = {(r.doc_id, r.text): r["__copies"] for r in M.mixture(docs).collect()}
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    count = {}
    for r in mixed.collect():
        count[r.doc_id, r.text] = count.get((r.doc_id, r.text), 0) + 1
    assert count[902, "one two"] in (2 * marked[902, "one two"], 5)
    assert all(count.get(k, 0) == n for k, n in marked.items() if k[0] != 902)
    assert M.mix(docs.limit(0)).count() == 0
    again = [r.doc_id for r in M.mix(docs).collect()]
    assert again == [r.doc_id for r in mixed.collect()]


def test_mixture_is_sorted_by_place(spark):
    docs = spark.createDataFrame(rows_of(4), "doc_id long, text string, source string").repartition(5)
    firsts = [r["__places"][0] if r["__places"] else 9.0 for r in M.mixture(docs).collect()]
    assert firsts == sorted(firsts) and len(set(firsts)) > 100
    assert sorted(M.mixture(docs).groupBy("doc_id").count().collect(), key=str) == sorted(docs.groupBy("doc_id").count().collect(), key=str)
