"""Saturating response curves: per-group fit, fitted values, inverse lookup.

Model ``y = A * (1 - exp(-k * x))`` with A the observed maximum of y, so k is
the only free parameter. Gauss-Newton with step halving, one pass a step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spanloom.functions.tails import t_p_value
from spanloom.operators.joins import join_null_safe
from spanloom.operators.ranks import attach
from spanloom.session import cut_lineage

HALVINGS = 3
TOLERANCE = 1e-9


def curve(a: Column, k: Column, x: Column) -> Column:
    return a * (1 - F.exp(-k * x))


def _moments(k: str) -> dict[str, str]:
    """Residual sum, and products of slope and residual, of the curve with rate ``k``, as SQL."""
    g = f"(a * x * exp(-{k} * x))"
    r = f"(y - a * (1D - exp(-{k} * x)))"
    return {"rss": f"sum({r} * {r})", "gr": f"sum({g} * {r})", "gg": f"sum({g} * {g})"}


def _fit(points: DataFrame, by: list[str], k0: float, iterations: int) -> DataFrame:
    """Fit all groups together: one aggregate pass per iteration over those not yet converged.

    Each pass evaluates the full step and a few halvings of it at once, and
    keeps the first that does not raise the residual sum. When none does, the
    step shrinks and the next pass goes on from there.
    """
    points = cut_lineage(points)  # read again in every pass
    scales = [2.0**-h for h in range(HALVINGS + 1)]
    state = points.groupBy(*by).agg(F.max("y").alias("a"), F.count(F.lit(1)).alias("n")).withColumns(
        {"k": F.lit(k0), "delta": F.lit(0.0), "rss": F.lit(float("inf")), "gg": F.lit(0.0), "converged": F.lit(False)}
    )
    names = [*by, "a", "n", "k", "delta", "rss", "gg", "converged"]
    # Expressions are by name, so one set serves all passes.
    sums, tries = [], []
    for i, scale in enumerate(scales):
        sums += [F.expr(e).alias(f"{n}{i}") for n, e in _moments(f"(k + delta * {scale!r}D)").items()]
        step = f"coalesce(try_divide(gr{i}, gg{i}), 0D) AS delta"
        tries.append(F.expr(f"struct(k + delta * {scale!r}D AS k, rss{i} AS rss, {step}, gg{i} AS gg)"))
    kept = [F.max(c).alias(c) for c in ("a", "n", "k", "delta", "rss", "gg")]
    better = F.get(F.filter(F.array(*tries), lambda c: c.rss <= F.col("rss")), F.lit(0))
    best = F.coalesce(better, F.expr(f"struct(k, rss, delta * {scales[-1] / 2!r}D AS delta, gg)"))
    settled = F.expr(f"abs(__b.delta) <= {TOLERANCE!r}D * abs(__b.k)")
    moves = {**{c: F.col(f"__b.{c}") for c in ("k", "delta", "rss", "gg")}, "converged": settled}
    open_curves = F.count(F.when(~F.col("converged"), 1)).alias("n")
    done = None
    for _ in range(iterations + 1):
        agg = join_null_safe(points, state, by, "inner").groupBy(*by).agg(*kept, *sums)
        moved = agg.withColumn("__b", best).withColumns(moves).select(*names)
        left = Observation()
        moved = cut_lineage(moved.observe(left, open_curves))  # one row per curve
        finished = moved.where("converged")
        done = finished if done is None else done.unionByName(finished)
        if left.get["n"] == 0:
            return done
        state = moved.where("not converged")
    return done.unionByName(state)


def fit_saturation(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    y: str,
    k0: float = 0.04,
    iterations: int = 10_000,
) -> DataFrame:
    """Fit every curve: ``by, n, a, k, se, t, p_value, rss, converged``.

    No curve is gathered: each Gauss-Newton step is one map-side combined
    aggregate of moments, whatever the length of a curve. A step that does not
    lower the residual sum is halved; a curve has converged when its step is
    below ``TOLERANCE`` of k.
    """
    by = list(by)
    points = df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    out = _fit(points, by, k0, iterations).select(*by, "n", "a", "k", "rss", "gg", "converged")
    se = F.sqrt(F.try_divide(F.try_divide(F.col("rss"), F.col("n") - 1), F.col("gg")))
    out = out.withColumn("se", se).withColumn("t", F.try_divide("k", "se"))
    out = out.withColumn("p_value", t_p_value(F.col("t"), F.col("n") - 1))
    return out.select(*by, "n", "a", "k", "se", "t", "p_value", "rss", "converged")


def with_fitted(df: DataFrame, params: DataFrame, by: Sequence[str], x: str, out: str = "fitted") -> DataFrame:
    """Fitted value at every point of the curves in ``params``."""
    joined = join_null_safe(df, params.select(*by, F.col("a").alias("__a"), F.col("k").alias("__k")), list(by), "inner")
    return joined.withColumn(out, curve(F.col("__a"), F.col("__k"), F.col(x))).drop("__a", "__k")


def fitted_max(fitted: DataFrame, by: Sequence[str], value: str = "fitted", out: str = "fitted_max") -> DataFrame:
    return fitted.groupBy(*by).agg(F.max(value).alias(out))


def inverse_at(
    fitted: DataFrame, by: Sequence[str], x: str, value: str = "fitted", frac: float = 0.95, out: str = "x_at"
) -> DataFrame:
    """x at which the fitted curve reaches a fraction of its maximum.

    Linear between the neighbouring fitted points; x is averaged over points
    with equal fitted value; null when the target lies outside their range.
    """
    points = fitted.groupBy(*by, F.col(value).alias("__y")).agg(F.avg(x).alias("__x"))
    marked = attach(points, by, __top=F.max("__y")).withColumn("__t", F.col("__top") * frac)
    pair = F.struct("__y", "__x")
    ends = marked.groupBy(*by).agg(
        F.max("__t").alias("__t"),
        F.max(F.when(F.col("__y") <= F.col("__t"), pair)).alias("__lo"),
        F.min(F.when(F.col("__y") >= F.col("__t"), pair)).alias("__hi"),
    )
    share = F.try_divide(F.col("__t") - F.col("__lo.__y"), F.col("__hi.__y") - F.col("__lo.__y"))
    between = F.col("__lo.__x") + F.coalesce(share, F.lit(0.0)) * (F.col("__hi.__x") - F.col("__lo.__x"))
    found = F.when(F.col("__lo").isNotNull() & F.col("__hi").isNotNull(), between)
    return ends.select(*by, found.alias(out))


def critical_x(k: Column, rest: float = 0.05) -> Column:
    """x beyond which less than ``rest`` of the maximum is left, in closed form."""
    return F.try_divide(-F.log(F.lit(rest)), k)


def good_fits(df: DataFrame, params: DataFrame, by: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Points of curves whose fit is significant."""
    return join_null_safe(df, params.where(F.col("p_value") < alpha).select(*by), list(by), "left_semi")
