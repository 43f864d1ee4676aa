"""Checkpoints keep rows and partitioning, but no estimate that grows from round to round."""

import sys

import pytest
from pyspark.sql import functions as F

from spanloom.llm.graph import components
from spanloom.operators import hierarchy as H
from spanloom.operators.tours import tour
from spanloom.session import cut_lineage, settled

UNKNOWN = 1 << 63  # bytes, about what Spark assumes of a table it knows nothing of


@pytest.fixture(autouse=True)
def long_numbers():
    before = sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(0)
    yield
    sys.set_int_max_str_digits(before)


def estimate(df):
    return df._jdf.queryExecution().analyzed().stats().sizeInBytes()


@pytest.mark.parametrize("cut", [cut_lineage, settled])
def test_estimate_stays_bounded_over_rounds_of_self_joins(spark, cut):
    df = spark.range(40).select("id", (F.col("id") + 1).alias("to"))
    for _ in range(6):
        ahead = df.select(F.col("id").alias("to"), F.col("to").alias("far"))
        df = cut(df.join(ahead, "to", "left").select("id", F.coalesce("far", "to").alias("to")))
    assert estimate(df) <= UNKNOWN
    assert sorted(map(tuple, df.collect())) == [(i, 40) for i in range(40)]
    assert [f.nullable for f in df.schema] == [False, False]


def test_small_estimate_and_partitioning_are_kept(spark):
    small = cut_lineage(spark.range(10))
    assert estimate(small) == 80
    wide = spark.range(10).repartition(3, "id")
    for _ in range(4):
        wide = wide.crossJoin(spark.range(1 << 20).toDF("x")).where("x = 1").drop("x")
    cut = cut_lineage(wide)
    plan, before = (d._jdf.queryExecution().executedPlan().outputPartitioning().numPartitions() for d in (cut, wide))
    assert plan == before and sorted(r.id for r in cut.collect()) == list(range(10))


def chain(spark, n):
    rows = [("t", f"n{i - 1:03d}" if i else None, f"n{i:03d}", 1.0 if i else None, f"n{i:03d}", None, i == n - 1) for i in range(n)]
    return spark.createDataFrame(rows, "tree_id string, parent string, child string, length double, label string, support double, is_tip boolean")


def test_tree_rounds_keep_no_long_estimates(spark, monkeypatch):
    """t11d, t11e: every checkpoint of tours, heights and cut trees, which take rounds ~ log2 of the nodes."""
    seen = []
    for module in ("tours", "hierarchy", "ranks"):
        name = f"spanloom.operators.{module}.cut_lineage"
        if hasattr(sys.modules[f"spanloom.operators.{module}"], "cut_lineage"):
            monkeypatch.setattr(name, lambda df: seen.append(out := cut_lineage(df)) or out)
    edges = chain(spark, 20)
    places = {r.node: (r.first, r.last) for r in tour(edges).collect()}
    assert places["n000"] == (0, 39) or places["n000"][1] - places["n000"][0] == 39
    assert {r.node: r.height for r in H.heights(edges).collect()} == {f"n{i:03d}": float(i) for i in range(20)}
    assert [r.child for r in H.keep_tips(edges, edges.where("is_tip").select("label")).collect()] == ["n019"]
    assert len(seen) > 10 and max(map(estimate, seen)) <= UNKNOWN


def test_components_of_a_shuffled_chain_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr("spanloom.llm.graph.settled", lambda df: rounds.append(out := settled(df)) or out)
    n = 300
    ids = [(i * 7919 + 13) % 1009 for i in range(n)]
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long").repartition(n, "a")
    assert sorted(map(tuple, components(edges).collect())) == sorted((i, min(ids)) for i in ids)
    assert len(rounds) <= 9


def test_component_rounds_keep_no_long_estimates(spark):
    """op9, pipeline: edges dealt so that no batch joins the chain by itself."""
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long").repartition(n, "a")
    found = components(edges)
    assert estimate(found) <= UNKNOWN
    assert sorted(map(tuple, found.collect())) == [(i, 0) for i in range(n + 1)]
