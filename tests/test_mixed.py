"""Mixed-model chains against a plain Gibbs sampler and fixed sequences."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.operators import mixed as M
from spanloom.operators import variance_grid as G

SPECS = {"null": [], "stage": [("stage",)]}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(14):
        u = rng.normal(0, 1.5)
        for i in range(3 + g % 3):
            stage = "ab"[i % 2]
            rows.append((f"g{g}", stage, 5 + u + (2.0 if stage == "b" else 0.0) + rng.normal(0, 0.7)))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["grp", "stage", "y"])), rows


def plain_gibbs(rows, iters=4000, burn=500):
    """Textbook sampler with every group effect kept."""
    rng = np.random.default_rng(8)
    g = np.array([int(r[0][1:]) for r in rows])
    x = np.column_stack([np.ones(len(rows)), [r[1] == "b" for r in rows]]).astype(float)
    y = np.array([r[2] for r in rows])
    se2, su2, u, out = 1.0, 1.0, np.zeros(g.max() + 1), []
    n = np.bincount(g)
    for it in range(iters):
        p = np.linalg.inv(x.T @ x / se2 + 1e-10 * np.eye(2))
        b = rng.multivariate_normal(p @ (x.T @ (y - u[g]) / se2), p)
        v = 1 / (n / se2 + 1 / su2)
        u = rng.normal(v * np.bincount(g, y - x @ b) / se2, np.sqrt(v))
        su2 = (0.02 + u @ u) / 2 / rng.gamma((0.02 + len(u)) / 2)
        r = y - x @ b - u[g]
        se2 = (0.02 + r @ r) / 2 / rng.gamma((0.02 + len(y)) / 2)
        if it >= burn:
            out.append([*b, su2, se2, len(y) * np.log(2 * np.pi * se2) + r @ r / se2])
    return np.mean(out, axis=0)


def test_class_chain_matches_plain_gibbs(spark, data):
    df, rows = data
    draws = M.mixed_grid(df, ["y"], ["stage"], SPECS, "grp", chains=2, iters=4000, burn=500, thin=2, seed=3).cache()
    got = draws.where("spec = 'stage' and iter > 0").groupBy("param").avg("value").toPandas().set_index("param")["avg(value)"]
    want = plain_gibbs(rows)
    names = ["(Intercept)", "stageb", "group_var", "units_var", "deviance"]
    assert got[names].to_numpy() == pytest.approx(want, rel=0.08, abs=0.05)
    scored = M.score_dic(draws).toPandas()
    assert list(scored.spec) == ["stage", "null"] and scored.delta_dic.iloc[0] == 0 and scored.delta_dic.iloc[1] > 5
    best = M.best_parameters(draws).toPandas()
    assert list(best.param) == ["stageb"] and best.lower[0] < 2 < best.upper[0] and best.p_mcmc[0] < 0.01
    assert 500 < best.effective_size[0] <= 3900


def test_grid_matches_plain_gibbs(spark, data):
    df, rows = data
    models = G.model_moments(df, ["y"], ["stage"], SPECS, "grp")
    grid = G.posterior_grid(models).cache()
    got = G.posterior_means(grid, models).where("spec = 'stage'").toPandas().set_index("param")
    want = plain_gibbs(rows, iters=12_000)
    names = ["(Intercept)", "stageb", "group_var", "units_var"]
    assert got["mean"][names].to_numpy() == pytest.approx(want[:4], rel=0.05, abs=0.05)
    finer = G.posterior_means(G.posterior_grid(models, points=301, rounds=3), models).where("spec = 'stage'").toPandas().set_index("param")
    assert got["mean"][names].to_numpy() == pytest.approx(finer["mean"][names].to_numpy(), rel=1e-6)
    scored = {r.spec: r for r in G.grid_dic(grid, models).collect()}
    assert scored["stage"].delta_dic == 0 and scored["null"].delta_dic > 5
    chains = M.mixed_grid(df, ["y"], ["stage"], SPECS, "grp", chains=4, iters=8000, burn=500, thin=2, seed=3)
    for r in M.score_dic(chains).collect():
        assert scored[r.spec].dic == pytest.approx(r.dic, abs=0.6)
    best = G.best_effects(grid, models).toPandas()
    draws = chains.where("spec = 'stage' and param = 'stageb' and iter > 0").toPandas()["value"]
    assert list(best.param) == ["stageb"] and best.p_mcmc[0] < 0.001
    assert [best.lower[0], best.upper[0]] == pytest.approx(np.quantile(draws, [0.025, 0.975]), abs=0.04)
    assert best.sd[0] == pytest.approx(draws.std(), rel=0.05)


def test_grid_edges(spark):
    """An aliased effect, a missing group, missing values and no rows at all."""
    rows = [("a", "p", 1.0), ("a", "p", 2.0), (None, "q", 4.0), (None, "q", 5.5), ("b", "q", None), ("b", None, 3.0), ("c", "p", 2.5)]
    df = spark.createDataFrame(rows, "grp string, stage string, y double").withColumn("copy", F.col("stage"))
    models = G.model_moments(df, ["y"], ["stage", "copy"], {"one": [("stage",)], "twice": [("stage",), ("copy",)]}, "grp")
    found = {(r.spec, r.param): r for r in G.posterior_means(G.posterior_grid(models), models).collect()}
    assert {p for s, p in found if s == "twice"} == {"(Intercept)", "stageq", "group_var", "units_var"}
    assert found["twice", "stageq"]["mean"] == pytest.approx(found["one", "stageq"]["mean"])
    none = G.model_moments(df.where("false"), ["y"], ["stage"], SPECS, "grp")
    assert G.posterior_means(G.posterior_grid(none), none).count() == 0


def test_tree_chain_with_identity_covariance(spark, data):
    df, rows = data
    ids = sorted({r[0] for r in rows})
    cov = spark.createDataFrame([(a, b, 1.0 if a == b else 0.0) for a in ids for b in ids], "tip_i string, tip_j string, shared double")
    draws = M.mixed_grid(df, ["y"], ["stage"], {"stage": [("stage",)]}, "grp", iters=3000, burn=300, thin=2, seed=5, cov=cov)
    got = draws.where("iter > 0").groupBy("param").avg("value").toPandas().set_index("param")["avg(value)"]
    assert got[["(Intercept)", "stageb", "group_var", "units_var", "deviance"]].to_numpy() == pytest.approx(plain_gibbs(rows), rel=0.1, abs=0.08)


def test_hpd_is_narrowest(spark):
    x = np.exp(np.random.default_rng(2).normal(size=400))
    df = spark.createDataFrame(pd.DataFrame({"p": "a", "value": x}))
    r = M.hpd_interval(df, ["p"]).first()
    s = np.sort(x)
    gap = round(len(s) * 0.95)
    i = (s[gap:] - s[:-gap]).argmin()
    assert (r.lower, r.upper) == pytest.approx((s[i], s[i + gap]))
    assert r.upper - r.lower <= np.quantile(x, 0.975) - np.quantile(x, 0.025)


def test_effective_size(spark):
    rng = np.random.default_rng(9)
    n, rho = 4000, 0.6
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = rho * x[i - 1] + rng.normal()
    df = spark.createDataFrame(pd.DataFrame({"p": "a", "chain": 1, "iter": np.arange(n), "value": x}))
    got = M.effective_size(df, ["p"]).first().effective_size
    assert got == pytest.approx(n * (1 - rho) / (1 + rho), rel=0.2)
