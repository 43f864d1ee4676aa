"""Curves, Welch tests, tail probabilities and clustering on hand-checked inputs."""

import time
from math import erfc, pi, sqrt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.functions.tails import f_upper, t_p_value, t_quantile, t_two_sided
from spanloom.operators.cluster import kmeans_1d
from spanloom.operators.curves import critical_x, fit_saturation, fitted_max, inverse_at, with_fitted
from spanloom.operators.welch import formatted_p, welch_by_group

X = [0.0, 25.0, 50.0, 100.0, 200.0, 400.0]
Y = [0.0, 6.1, 8.9, 9.7, 10.0, 9.9]


def test_tails_match_published_quantiles():
    # Published t table: 0.975 quantiles.
    assert t_quantile(np.array([0.975] * 3), np.array([1.0, 10.0, 30.0])) == pytest.approx([12.7062, 2.22814, 2.04227], abs=1e-4)
    assert t_two_sided(np.array([2.22814]), np.array([10.0])) == pytest.approx([0.05], abs=1e-5)
    # F(0.95; 3, 10) = 3.7083
    f = 3.7083
    assert f_upper(np.array([f]), np.array([3.0]), np.array([10.0])) == pytest.approx([0.05], abs=1e-4)


def test_welch(spark):
    df = spark.createDataFrame([("g", "a", float(v)) for v in (1, 2, 3, 4)] + [("g", "b", float(v)) for v in (2, 4, 6)] + [("h", "a", 1.0), ("h", "b", 2.0), ("h", "b", 3.0)], "g string, side string, v double")
    rows = welch_by_group(df, ["g"], "side", ("a", "b"), ["v"]).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.statistic, r.df, r.p_value) == pytest.approx((-1.133893, 3.234719, 0.333824), abs=1e-5)
    q = t_quantile(np.array([0.975]), np.array([r.df]))[0]
    se = r.difference / r.statistic
    assert (r.conf_low, r.conf_high) == pytest.approx((r.difference - q * se, r.difference + q * se))
    assert formatted_p(welch_by_group(df, ["g"], "side", ("a", "b"), ["v"]), "g", "g", "v", None).first().p_text == "0.334"
    with pytest.raises(Exception, match="not below"):
        formatted_p(welch_by_group(df, ["g"], "side", ("a", "b"), ["v"]), "g", "g", "v").collect()


def test_tails_for_many_and_for_no_degrees_of_freedom(spark):
    for df in (1e3, 1e6, 1e9, 1e12, 1e15):
        t = np.array([0.0, 0.5, 2.0, 6.0])
        normal = np.array([erfc(x / sqrt(2)) for x in t])
        density = np.exp(-t * t / 2) / sqrt(2 * pi)
        first = 2 * density * t * (t * t + 1) / (4 * df)
        assert np.abs(t_two_sided(t, np.full(4, df)) - normal - first).max() < max(1e-10, 3 / df**2)
    # both sides of the change of method
    assert abs(t_two_sided(np.array([2.0]), np.array([1e5]))[0] - t_two_sided(np.array([2.0]), np.array([1.000001e5]))[0]) < 1e-10
    rows = spark.createDataFrame([(2.0, 0.0), (2.0, -1.0), (None, 5.0), (2.0, 1.0)], "t double, df double")
    got = [r[0] for r in rows.select(t_p_value(F.col("t"), F.col("df"))).collect()]
    assert got[:3] == [None, None, None] and got[3] == pytest.approx(0.2951672, abs=1e-6)


def test_tails_of_many_values_at_once():
    # a value is what it is alone, and one that has converged does not wait for the others
    t = np.linspace(-8, 8, 200_001)
    df = np.where(np.arange(len(t)) % 2, 9e4, 15e3)
    begun = time.perf_counter()
    got = t_two_sided(t, df)
    assert time.perf_counter() - begun < 15
    some = np.arange(0, len(t), 20_001)
    alone = np.concatenate([t_two_sided(t[[i]], df[[i]]) for i in some])
    assert np.array_equal(got[some], alone)


def test_curves_of_one_and_two_points(spark):
    df = spark.createDataFrame([("one", 10.0, 5.0), ("two", 10.0, 5.0), ("two", 40.0, 9.0)], "id string, x double, y double")
    got = {r.id: r for r in fit_saturation(df, ["id"], "x", "y", iterations=200).collect()}
    assert set(got) == {"one", "two"} and got["one"].p_value is None


def test_curve_fit(spark):
    df = spark.createDataFrame(list(zip(["c"] * 6, X, Y)), "id string, x double, y double")
    p = fit_saturation(df, ["id"], "x", "y")
    r = p.first()
    assert r.converged and r.n == 6
    assert (r.k, r.se, r.t) == pytest.approx((0.0396129, 0.00139993, 28.2962), rel=1e-4)
    assert r.p_value == pytest.approx(1.03e-6, rel=1e-2)
    fitted = with_fitted(df, p, ["id"], "x")
    assert fitted_max(fitted, ["id"]).first().fitted_max == pytest.approx(9.9999987, abs=1e-6)
    assert inverse_at(fitted, ["id"], "x").first().x_at == pytest.approx(86.98462, abs=1e-4)
    assert p.select(critical_x(F.col("k"))).first()[0] == pytest.approx(75.62526, abs=1e-3)


def test_curve_fits_match_a_fine_grid(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(6):
        k = 0.01 * (c + 1)
        for x in np.linspace(0, 300, 40):
            rows.append((f"c{c}", float(x), float(20 * (1 - np.exp(-k * x)) + rng.normal(0, 0.4))))
    df = spark.createDataFrame(rows, "id string, x double, y double")
    a = {r.id: r for r in fit_saturation(df, ["id"], "x", "y").collect()}
    for c in a:
        grid = np.linspace(0.5 * a[c].k, 1.5 * a[c].k, 20001)
        pts = np.array([(x, y) for i, x, y in rows if i == c])
        top = pts[:, 1].max()
        rss = ((pts[:, 1][None] - top * (1 - np.exp(-grid[:, None] * pts[:, 0][None]))) ** 2).sum(axis=1)
        assert a[c].k == pytest.approx(grid[rss.argmin()], rel=1e-3)


def test_inverse_lookup(spark):
    df = spark.createDataFrame([("a", x, y) for x, y in ((0.0, 0.0), (50.0, 8.0), (100.0, 9.6), (200.0, 10.0))], "id string, x double, fitted double")
    assert inverse_at(df, ["id"], "x").first().x_at == pytest.approx(96.875)


def within_cost(values, ids):
    s = pd.Series(values, dtype=float)
    return float(((s - s.groupby(ids).transform("mean")) ** 2).sum())


def test_kmeans_small(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 10, 11, 12, 30)] + [(None,)], "v double")
    got = {r.v: r.cluster for r in kmeans_1d(df, [], "v", 3).collect()}
    assert got == {1.0: 1, 2.0: 1, 10.0: 2, 11.0: 2, 12.0: 2, 30.0: 3, None: None}
    few = kmeans_1d(df.where("v < 3"), [], "v", 5).collect()
    assert sorted(r.cluster for r in few) == [1, 2]


@pytest.mark.parametrize("shape", ["mixture", "uniform", "heavy"])
def test_kmeans_refinement_is_optimal(spark, shape):
    rng = np.random.default_rng(11)
    n = 900
    values = {
        "mixture": np.concatenate([rng.normal(m, 1.5, n // 3) for m in (0, 9, 30)]),
        "uniform": rng.uniform(0, 1, n),
        "heavy": np.exp(rng.normal(0, 2.5, n)),
    }[shape]
    values = np.round(np.concatenate([values, values[: n // 3]]), 4)
    frame = pd.DataFrame({"g": "a", "v": values})
    frame = pd.concat([frame, pd.DataFrame({"g": "b", "v": np.arange(8.0)})])
    df = spark.createDataFrame(frame)
    exact = kmeans_1d(df, ["g"], "v", 4).toPandas()
    refined = kmeans_1d(df, ["g"], "v", 4, max_cells=256).toPandas()
    for g in ("a", "b"):
        one, two = exact[exact.g == g], refined[refined.g == g]
        assert set(one.cluster) == {1, 2, 3, 4} == set(two.cluster)
        assert within_cost(one.v, one.cluster) == pytest.approx(within_cost(two.v, two.cluster), rel=1e-9)
        for _ in range(50):
            cuts = np.sort(rng.choice(np.unique(one.v)[1:], 3, replace=False))
            assert within_cost(one.v, np.searchsorted(cuts, one.v, side="right")) >= within_cost(one.v, one.cluster) - 1e-9
