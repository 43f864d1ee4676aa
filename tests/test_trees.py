"""Tree operators against hand-checked values and dense formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import hierarchy as H
from spanloom.operators import signal as G
from spanloom.sources.trees import edges_of, tree_edges

SMALL = "((A:1,B:1):1,C:2);"
FOUR = "((A:1,B:1)80:2,(C:2,D:2)40:1);"


def tree(spark, *texts):
    return edges_of(spark.createDataFrame([(f"t{i}", s) for i, s in enumerate(texts)], "id string, text string"), "id", "text").cache()


def dense(text):
    edges = {e[1]: e for e in tree_edges(text)}
    def line(node):
        out = {}
        while node is not None:
            out[node] = edges[node][2] or 0.0
            node = edges[node][0]
        return out
    tips = sorted(n for n, e in edges.items() if e[5])
    lines = [line(t) for t in tips]
    return tips, np.array([[sum(v for k, v in a.items() if k in b) for b in lines] for a in lines])


def test_reading(spark):
    rows = {r.child: r for r in tree(spark, FOUR).collect()}
    assert len(rows) == 7 and rows["A"].length == 1 and rows["A"].is_tip
    assert rows[rows["A"].parent].support == 80 and rows[rows["A"].parent].length == 2
    assert [r.parent for r in rows.values()].count(None) == 1


def test_covariance_root_and_k(spark):
    edges = tree(spark, SMALL)
    cov = {(r.tip_i, r.tip_j): r.shared for r in H.covariance(edges).collect()}
    assert (cov["A", "A"], cov["A", "B"], cov["C", "C"], cov["A", "C"]) == (2, 1, 2, 0)
    traits = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 4.0)], "species string, v double")
    values = edges.where("is_tip").select("tree_id", "label").join(traits.withColumnRenamed("species", "label"), "label")
    sums = H.tree_sums(edges, values, ["v"]).first()
    assert (sums.n, sums.root_v, sums.q_v_v) == (3, pytest.approx(2.571429, abs=1e-6), pytest.approx(2.285714, abs=1e-6))
    tips, c = dense(SMALL)
    assert sums.logdet == pytest.approx(np.linalg.slogdet(c)[1])
    r = G.signal_k(edges, traits, "species", ["v"], nsim=60, seed=3).first()
    assert r.k == pytest.approx(1.234375) and 1 / 60 <= r.p_value <= 1


def test_gls(spark):
    edges = tree(spark, FOUR)
    traits = spark.createDataFrame([("A", 1.0, 2.0), ("B", 2.0, 3.0), ("C", 4.0, 7.0), ("D", 3.0, 4.0)], "s string, x double, y double")
    m = G.tree_gls(edges, traits, "s", "y", "x")
    r = m.first()
    got = (r.intercept, r.slope, r.r_squared, r.adj_r_squared, r.f_value, r.p_value)
    assert got == pytest.approx((0.050847, 1.576271, 0.857270, 0.785905, 12.0125, 0.074111), abs=1e-5)
    fitted = {x.label: x.fitted for x in G.gls_fitted(edges, traits, "s", "x", m).collect()}
    assert fitted["C"] == pytest.approx(0.050847 + 4 * 1.576271, abs=1e-5)


def test_polytomy_and_lambda_match_dense(spark):
    text = "((A:1.5,B:1,E:0.5):1,((C:2,D:1):0.7,F:2.2):0.4);"
    edges = tree(spark, text)
    x = dict(zip("ABCDEF", (1.0, 2.5, -1.0, 0.3, 4.0, 2.0)))
    traits = spark.createDataFrame(list(x.items()), "s string, v double")
    tips, c = dense(text)
    v = np.array([x[t] for t in tips])

    def loglik(lam):
        s = c * lam
        np.fill_diagonal(s, np.diag(c))
        inv, one = np.linalg.inv(s), np.ones(len(v))
        a = one @ inv @ v / (one @ inv @ one)
        n = len(v)
        s2 = (v - a) @ inv @ (v - a) / n
        return -0.5 * (n * np.log(2 * np.pi * s2) + np.linalg.slogdet(s)[1] + n)

    r = G.signal_lambda(edges, traits, "s", "v", points=11, rounds=2).first()
    assert r.log_lik == pytest.approx(loglik(r.lam), abs=1e-8)
    assert all(r.log_lik >= loglik(t) - 1e-3 for t in np.linspace(0, 0.99, 50))


def test_keep_tips_support_and_ancestor(spark):
    edges = tree(spark, "(((A:1,B:1)90:1,C:2)70:1,(D:1,E:2)30:3);")
    kept = {r.child: r for r in H.keep_tips(edges, spark.createDataFrame([("A",), ("C",), ("E",)], "label string")).collect()}
    assert kept["A"].length == 2 and kept["C"].length == 2 and kept["E"].length == 5
    assert kept["A"].parent == kept["C"].parent and kept[kept["A"].parent].length == 1
    inner = H.keep_tips(edges, spark.createDataFrame([("A",), ("C",)], "label string"))
    assert inner.where("parent is null").count() == 1 and inner.count() == 3
    mrca = H.common_ancestor(edges, spark.createDataFrame([("A",), ("C",)], "label string")).first().node
    assert edges.where(F.col("child") == mrca).first().support == 70
    rotated = tree(spark, "((E:1,D:1):3,(C:2,(B:1,A:1):1):1);")
    moved = H.transfer_support(edges, rotated)
    got = {r.child: r for r in moved.collect()}
    assert all(r.matched for r in got.values()) and got[got["A"].parent].support == 90 and got[got["D"].parent].support == 30
    assert [r.label for r in H.tip_order(edges).orderBy("position").collect()] == ["A", "B", "C", "D", "E"]
    data, small = H.match_traits(edges, spark.createDataFrame([("A", 1.0), ("C", 2.0), ("Z", 3.0)], "species string, v double"), "species")
    assert [(r.species, r.v) for r in data.orderBy("position").collect()] == [("A", 1.0), ("C", 2.0)]
    blank = H.with_node_attributes(edges, spark.createDataFrame([("A", "red")], "tip string, colour string"), "tip")
    assert blank.where("support = 30").count() == 0 and blank.where("colour = 'red'").count() == 1


def k_of(text, x):
    tips, c = dense(text)
    v, one = np.array([x[t] for t in tips]), np.ones(len(tips))
    inv, n = np.linalg.inv(c), len(tips)
    a = one @ inv @ v / (one @ inv @ one)
    return (v - a) @ (v - a) / ((v - a) @ inv @ (v - a)) / ((np.trace(c) - n / (one @ inv @ one)) / (n - 1))


def test_missing_values_cut_the_tree_per_trait(spark):
    edges = tree(spark, "((A:1,B:1.5):1,((C:1,D:2):0.5,E:2):0.7);")
    rows = [("A", 1.0, 2.0), ("B", 2.5, 1.0), ("C", 4.0, None), ("D", None, 5.0), ("E", 3.0, 4.0)]
    traits = spark.createDataFrame(rows, "s string, x double, y double")
    got = {r.trait: r.k for r in G.signal_k(edges, traits, "s", ["x", "y"], nsim=20).collect()}
    assert got["x"] == pytest.approx(k_of("((A:1,B:1.5):1,(C:1.5,E:2):0.7);", {t: x for t, x, _ in rows}))
    assert got["y"] == pytest.approx(k_of("((A:1,B:1.5):1,(D:2.5,E:2):0.7);", {t: y for t, _, y in rows}))
    m = G.tree_gls(edges, traits, "s", "y", "x").first()
    assert m.n == 3
    staged = traits.select("s", F.col("x"), F.when(F.col("s") != "D", "one").alias("stage")).dropna()
    assert G.signal_by_stage(edges, staged, "s", ["x"], "stage", nsim=20).first().k == pytest.approx(got["x"])


def test_trees_left_with_one_tip_drop_out(spark):
    edges = tree(spark, SMALL, "((D:1,E:1):1,F:2);")
    traits = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 4.0), ("D", 1.0)], "s string, x double")
    assert [r.tree_id for r in G.signal_k(edges, traits, "s", ["x"], nsim=10).collect()] == ["t0"]


def test_unreached_nodes_raise(spark):
    edges = tree(spark, SMALL)
    values = spark.createDataFrame([("t0", "A", 1.0), ("t0", "C", 2.0)], "tree_id string, label string, v double")
    with pytest.raises(ValueError, match="no value"):
        H.tree_sums(edges, values, ["v"])
