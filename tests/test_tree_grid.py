"""Mixed models with effects along a tree, against dense matrices on the same grid."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.operators import tree_grid as T
from spanloom.operators import variance_grid as G

SPECS = {"null": [], "stage": [("stage",)]}
EDGES = "tree_id int, parent string, child string, length double, label string, support double, is_tip boolean"
#: parent, child, length; the root is r. One inner node has one child, one three.
BRANCHES = [("r", "a", 1.0), ("r", "b", 0.5), ("a", "c", 0.7), ("a", "t1", 2.0), ("c", "t2", 1.3), ("c", "t3", 1.1), ("c", "t4", 1.3), ("b", "d", 0.5), ("d", "t5", 2.0), ("d", "t6", 1.5)]


def edge_rows(branches, tree=1):
    parents = {p for p, _, _ in branches}
    rows = [(tree, None, "r", None, None, None, False)]
    return rows + [(tree, p, c, l, None if c in parents else c, None, c not in parents) for p, c, l in branches]


def shared(branches, tips):
    up = {c: (p, l) for p, c, l in branches}

    def line(n):
        out = {}
        while n in up:
            out[n] = up[n][1]
            n = up[n][0]
        return out

    lines = [line(t) for t in tips]
    c = np.array([[sum(l for n, l in x.items() if n in y) for y in lines] for x in lines])
    return c / c.diagonal().max()


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(2)
    tips = [f"t{i}" for i in range(1, 7)]
    effect = rng.multivariate_normal(np.zeros(6), 2 * shared(BRANCHES, tips))
    rows = [(t, "ab"[i % 2], 4 + effect[k] + 1.5 * (i % 2) + rng.normal(0, 0.6)) for k, t in enumerate(tips) for i in range(2 + k % 3)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["tip", "stage", "y"]))
    edges = spark.createDataFrame(edge_rows([*BRANCHES, ("b", "unused", 1.0)]), EDGES)
    models = T.tree_moments(df, ["y"], ["stage"], SPECS, "tip", edges)
    return rows, tips, models, T.tree_posterior_grid(models).cache()


def psi(x):
    total = 0.0
    while x < 30:
        total -= 1 / x
        x += 1
    return total + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def dense(rows, tips, spec, logs):
    """Means, sds and DIC by matrices of all rows at the given logarithms of the ratio."""
    z = np.array([[r[0] == t for t in tips] for r in rows], dtype=float)
    c = shared(BRANCHES, tips)
    y = np.array([r[2] for r in rows])
    shift = y.mean()
    x = np.column_stack([np.ones(len(rows))] + ([[r[1] == "b" for r in rows]] if spec == "stage" else [])).astype(float)
    y, n, p = y - shift, len(y), x.shape[1]
    logw, parts = [], []
    for lr in logs:
        rho = math.exp(lr)
        v = np.eye(n) + rho * z @ c @ z.T
        vi = np.linalg.inv(v)
        xvx = x.T @ vi @ x
        beta = np.linalg.solve(xvx, x.T @ vi @ y)
        r = y - x @ beta
        shape, rate = (n - p) / 2 + 0.02, (r @ vi @ r + 0.02 * (1 + 1 / rho)) / 2
        logw.append(-0.01 * lr - (np.linalg.slogdet(v)[1] + np.linalg.slogdet(xvx)[1]) / 2 - shape * math.log(rate))
        u = rho * c @ z.T @ vi @ r
        e = r - z @ u
        # spread of effects and group effects around their means, over the residual variance
        joint = np.hstack([x, z])
        prior = np.zeros((p + 6, p + 6))
        prior[p:, p:] = np.linalg.inv(rho * c)
        hat = np.trace(joint @ np.linalg.inv(joint.T @ joint + prior) @ joint.T)
        parts.append((beta, np.linalg.inv(xvx).diagonal(), shape, rate, e @ e, hat, u))
    w = np.exp(np.array(logw) - max(logw))
    w /= w.sum()
    deviance = sum(k * (n * (math.log(2 * math.pi) + math.log(ra) - psi(sh)) + sh / ra * fit + hat) for k, (_, _, sh, ra, fit, hat, _) in zip(w, parts))
    beta = sum(k * q[0] for k, q in zip(w, parts))
    units = sum(k * q[3] / (q[2] - 1) for k, q in zip(w, parts))
    e = y - x @ beta - z @ sum(k * q[6] for k, q in zip(w, parts))
    second = sum(k * (q[1] * q[3] / (q[2] - 1) + q[0] ** 2) for k, q in zip(w, parts))
    group = sum(k * math.exp(lr) * q[3] / (q[2] - 1) for k, lr, q in zip(w, logs, parts))
    beta[0], sd = beta[0] + shift, np.sqrt(second - beta**2)
    dic = 2 * deviance - (n * math.log(2 * math.pi * units) + e @ e / units)
    return beta, sd, group, units, dic, sum(k * q[6] for k, q in zip(w, parts))


@pytest.mark.parametrize("spec", list(SPECS))
def test_grid_equals_dense_matrices(case, spec):
    rows, tips, models, grid = case
    logs = sorted(r[0] for r in grid.where(F.col("spec") == spec).select("log_ratio").collect())
    beta, sd, group, units, dic, effect = dense(rows, tips, spec, logs)
    found = {r.param: r for r in G.posterior_means(grid, models).where(F.col("spec") == spec).collect()}
    names = ["(Intercept)", "stageb"][: len(beta)]
    assert [found[n].mean for n in names] == pytest.approx(beta, rel=1e-7)
    assert [found[n].sd for n in names] == pytest.approx(sd, rel=1e-5)
    assert found["group_var"].mean == pytest.approx(group, rel=1e-7) and found["units_var"].mean == pytest.approx(units, rel=1e-7)
    scores = {r.spec: r.dic for r in T.tree_grid_dic(grid, models).collect()}
    assert scores[spec] == pytest.approx(dic, rel=1e-7)
    effects = {r.node: r.effect for r in T.mean_effects(grid, models).where(F.col("spec") == spec).collect()}
    assert [effects[t] for t in tips] == pytest.approx(effect, rel=1e-6)


def test_star_tree_is_the_grid_of_independent_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(f"t{g}", "ab"[i % 2], rng.normal(g % 4, 1)) for g in range(20) for i in range(1 + g % 3)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["tip", "stage", "y"]))
    edges = spark.createDataFrame(edge_rows([("r", f"t{g}", 3.0) for g in range(20)]), EDGES)
    models = T.tree_moments(df, ["y"], ["stage"], SPECS, "tip", edges)
    tree = T.tree_posterior_grid(models)
    plain = G.model_moments(df, ["y"], ["stage"], SPECS, "tip")
    flat = G.posterior_grid(plain)
    key = ["spec", "param"]
    a, b = (g.toPandas().sort_values(key).set_index(key)["mean"] for g in (G.posterior_means(tree, models), G.posterior_means(flat, plain)))
    assert a.to_numpy() == pytest.approx(b.to_numpy(), rel=1e-4)
    a, b = (g.toPandas().set_index("spec")["dic"].sort_index().to_numpy() for g in (T.tree_grid_dic(tree, models), G.grid_dic(flat, plain)))
    assert a == pytest.approx(b, rel=1e-5)


def test_thousands_of_tips(spark):
    tips = spark.range(3000).select(F.concat(F.lit("t"), "id").alias("child"), F.concat(F.lit("n"), F.col("id") % 60).alias("parent"))
    whole = tips.union(spark.range(60).select(F.concat(F.lit("n"), "id"), F.lit("r"))).union(spark.createDataFrame([("r", None)], "child string, parent string"))
    is_tip = F.col("child").startswith("t")
    edges = whole.select(F.lit(1).alias("tree_id"), "parent", "child", F.lit(1.0).alias("length"), F.when(is_tip, F.col("child")).alias("label"), F.lit(None).cast("double").alias("support"), is_tip.alias("is_tip"))
    df = tips.select(F.col("child").alias("tip"), F.lit("a").alias("stage"), (F.crc32("parent") % 7 + F.crc32("child") % 100 / 100.0).alias("y"))
    models = T.tree_moments(df, ["y"], ["stage"], {"null": []}, "tip", edges)
    found = {r.param: r.mean for r in G.posterior_means(T.tree_posterior_grid(models, points=25, rounds=3), models).collect()}
    assert 0.1 < found["group_var"] < 1 and 0 < found["units_var"] < found["group_var"]


def test_lone_tip_has_no_effect(spark):
    rows = [("t1", "a", 1.0), ("t1", "b", 2.0), ("x", "a", 5.0), ("x", "b", 5.5), ("t5", "a", 1.5), ("t5", "b", 2.5), ("t2", "a", 3.0)]
    df = spark.createDataFrame(rows, "tip string, stage string, y double")
    lone = [(2, None, "r", None, None, None, False), (2, "r", "x", 1.0, "x", None, True)]
    models = T.tree_moments(df, ["y"], ["stage"], {"null": []}, "tip", spark.createDataFrame(edge_rows(BRANCHES) + lone, EDGES))
    points = spark.createDataFrame([("y", "null", 1.0, 0.3)], "response string, spec string, step double, log_ratio double")
    got = T.tree_sums_at(models, points).first()
    tips = ["t1", "t2", "t5"]
    c = np.zeros((4, 4))
    kept = [(p, q, l) for p, q, l in BRANCHES if q in ("a", "c", "t1", "t2", "b", "d", "t5")]
    c[:3, :3] = shared(kept, tips)
    z = np.array([[r[0] == t for t in [*tips, "x"]] for r in rows], dtype=float)
    v = np.eye(len(rows)) + math.exp(0.3) * z @ c @ z.T
    x, y = np.ones(len(rows)), np.array([r[2] for r in rows])
    both = np.column_stack([x, y - y.mean()])
    want = both.T @ np.linalg.inv(v) @ both
    assert got["__a"] == pytest.approx([want[0, 0], want[0, 1], want[1, 1]], rel=1e-9)
    assert got["log_det_v"] == pytest.approx(np.linalg.slogdet(v)[1], rel=1e-9)


def test_unknown_tips_are_refused(spark):
    edges = spark.createDataFrame(edge_rows(BRANCHES), EDGES)
    df = spark.createDataFrame([("t1", "a", 1.0), ("nowhere", "b", 2.0)], "tip string, stage string, y double")
    with pytest.raises(Exception, match="not a tip"):
        T.tree_moments(df, ["y"], ["stage"], SPECS, "tip", edges)


def test_tips_at_all_points_are_not_kept(case):
    # one row per point and inner node; tips go into their parents' aggregate
    _, tips, models, grid = case
    points = grid.select("response", "log_ratio").distinct()
    inner, added, _ = T.upward(models, points)
    nodes = {r.node for r in inner.select("node").distinct().collect()}
    assert nodes and not nodes & set(tips)
    assert added.count() <= points.count() * 2 * models.nodes.where("is_inner").count()
