"""Gaussian mixed-model grids without sampling: random intercepts of independent groups.

Spark reduces the data to moments per distinct group size. With the effects and
the residual variance integrated in closed form, the posterior is a function of
one number, the ratio of the group to the residual variance; it is evaluated on
a grid of its logarithm that closes in on the mass round by round. Means,
intervals, tail probabilities and DIC are weighted sums over the grid, exact up
to its step and the same on every run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.tails import t_two_sided
from spanloom.operators.joins import join_null_safe
from spanloom.operators.mixed import PRIOR_NU, PRIOR_V, Term, design, factor_levels
from spanloom.operators.ranks import attach
from spanloom.operators.reshape import to_long
from spanloom.session import cut_lineage

#: Logarithms of the variance ratio that the first round covers.
FIRST = (-28.0, 28.0)
#: Points whose log weight is this far below the best carry no mass.
DEPTH = 30.0
#: A column whose pivot falls to this share of its square sum depends on those before it.
ALIASED = 1e-9
KEYS = ["response", "spec"]
SOLVED = "log_det double, rank int, rss double, slope_rss double, slope_det double, beta array<double>, unit_var array<double>"


@dataclass
class Models:
    """Moments per response and group size, names of all fixed effects, and the effects of each spec."""

    moments: DataFrame
    names: list[str]
    picks: dict[str, list[int]]


def _each(n: int, value) -> Column:
    return F.array(*[value(i) for i in range(n)])


def model_moments(df: DataFrame, responses: Sequence[str], factors: Sequence[str], specs: Mapping[str, Sequence[Term]], group: str) -> Models:
    """One row per response and group size: ``size, m, squares, n_rows, shift, total, within``.

    Rows missing the response or a factor are dropped per response; a missing
    group is a group of its own. ``squares`` sums the cross products of the
    group sums, ``within`` is what of ``total`` lies within groups.
    """
    levels = factor_levels(df, factors)
    full = design(levels, list(dict.fromkeys(t for terms in specs.values() for t in terms)))
    names = list(full)
    picks = {s: [names.index(n) for n in design(levels, terms)] for s, terms in specs.items()}
    z = [*[f"__x{i}" for i in range(len(names))], "__y"]
    pairs = [(a, b) for i, a in enumerate(z) for b in z[i:]]
    products = F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs])

    long = to_long(df, [group, *factors], responses, "response", "__y").dropna(subset=["__y", *factors])
    long = attach(long, ["response"], __shift=F.avg("__y")).withColumn("__y", F.col("__y") - F.col("__shift"))
    long = long.withColumns(dict(zip(z, full.values())))
    totals = long.groupBy("response").agg(F.count(F.lit(1)).alias("n_rows"), F.max("__shift").alias("shift"), products.alias("total"))
    groups = long.groupBy("response", group).agg(F.count(F.lit(1)).alias("size"), *[F.sum(c).alias(c) for c in z])
    classes = cut_lineage(groups.groupBy("response", "size").agg(F.count(F.lit(1)).alias("m"), products.alias("squares")))
    between = classes.groupBy("response").agg(_each(len(pairs), lambda i: F.sum(F.col("squares")[i] / F.col("size"))).alias("between"))
    whole = totals.join(between, "response").withColumn("within", F.zip_with("total", "between", lambda t, b: t - b)).drop("between")
    return Models(cut_lineage(classes.join(whole, "response")), names, picks)


def _square(flat: pd.Series, width: int, keep: list[int]) -> np.ndarray:
    out = np.zeros((len(flat), width, width))
    i, j = np.triu_indices(width)
    out[:, i, j] = np.stack(flat.to_numpy())
    out[:, j, i] = out[:, i, j]
    return out[np.ix_(range(len(flat)), keep, keep)]


def sweep(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sweep all but the last column of stacked matrices: inverse, log determinant, and which columns were free."""
    a = a.copy()
    p = a.shape[1] - 1
    scale = np.einsum("rii->ri", a).copy()
    log_det, free = np.zeros(len(a)), np.zeros((len(a), p), dtype=bool)
    for k in range(p):
        d = a[:, k, k].copy()
        ok = free[:, k] = d > ALIASED * np.maximum(scale[:, k], 1e-300)
        d = np.where(ok, d, 1.0)
        row = a[:, k, :] / d[:, None]
        new = a - a[:, :, k, None] * row[:, None, :]
        new[:, k, :] = row
        new[:, :, k] = -a[:, :, k] / d[:, None]
        new[:, k, k] = 1 / d
        # an aliased column leaves the model
        out = a.copy()
        out[:, k, :] = out[:, :, k] = 0.0
        a = np.where(ok[:, None, None], new, out)
        log_det += np.log(d)
    return a, log_det, free


def _solver(width: int, picks: dict[str, list[int]]):
    @F.pandas_udf(SOLVED)
    def solve(spec: pd.Series, flat: pd.Series, slope: pd.Series) -> pd.DataFrame:
        parts = []
        for name, at in spec.groupby(spec).groups.items():
            keep = [*picks[name], width - 1]
            a, da = _square(flat[at], width, keep), _square(slope[at], width, keep)
            inverse, log_det, free = sweep(a)
            p = len(keep) - 1
            beta = inverse[:, :p, p]
            theta = np.concatenate([-beta, np.ones((len(at), 1))], axis=1)
            parts.append(pd.DataFrame({
                "log_det": log_det, "rank": free.sum(axis=1), "rss": inverse[:, p, p],
                "slope_rss": np.einsum("ri,rij,rj->r", theta, da, theta),
                "slope_det": np.einsum("rij,rji->r", inverse[:, :p, :p], da[:, :p, :p]),
                "beta": list(beta), "unit_var": list(np.where(free, np.einsum("rii->ri", inverse)[:, :p], 0.0)),
            }, index=at))
        return pd.concat(parts).reindex(spec.index)

    return solve


def class_sums(models: Models, grid: DataFrame) -> DataFrame:
    """``log_det_v, slope_v, __a, __slope`` of independent groups at every row of ``grid``, from moments by group size."""
    moments = models.moments
    classes = moments.select("response", "size", "m", F.posexplode("squares").alias("pos", "square"))
    whole = moments.groupBy("response").agg(F.max("n_rows").alias("n_rows"), F.max("shift").alias("shift"), F.first("within").alias("within"))
    n, m, square, ratio = F.col("size"), F.col("m"), F.col("square"), F.exp("log_ratio")
    entries = grid.join(classes, "response").groupBy(*KEYS, "step", "log_ratio", "pos").agg(
        F.sum(square / (n * (1 + n * ratio))).alias("part"), F.sum(-ratio * square / ((1 + n * ratio) * (1 + n * ratio))).alias("slope"),
        F.sum(m * F.log1p(n * ratio)).alias("log_det_v"), F.sum(m * n * ratio / (1 + n * ratio)).alias("slope_v"),
    )
    # one element per entry of the matrix
    sums = entries.groupBy(*KEYS, "step", "log_ratio").agg(
        F.array_sort(F.collect_list(F.struct("pos", "part", "slope"))).alias("__m"), F.max("log_det_v").alias("log_det_v"), F.max("slope_v").alias("slope_v")
    ).join(whole, "response")
    return sums.withColumns({"__a": F.zip_with("within", "__m.part", lambda w, b: w + b), "__slope": F.col("__m.slope")})


def posterior_grid(models: Models, points: int = 97, rounds: int = 4, sums=class_sums, shared: bool = False) -> DataFrame:
    """One row per response, spec and grid point: ``log_ratio, weight`` and what the effects and variances are there.

    ``shape`` and ``rate`` belong to the inverse gamma of the residual
    variance, ``beta`` and ``unit_var`` to the t distributions of the effects;
    ``hat`` is the trace of the hat matrix and ``fit`` the square sum of the
    residuals around effects and group effects. ``sums`` gives the cross products
    under the groups' covariance; with ``shared`` all specs of a response keep one grid.
    """
    solve = _solver(len(models.names) + 1, models.picks)
    specs = F.explode(F.array(*[F.lit(s) for s in models.picks]))
    limits = models.moments.select("response").distinct().select("response", specs.alias("spec"), F.lit(FIRST[0]).alias("lo"), F.lit(FIRST[1]).alias("hi"))
    for left in reversed(range(rounds)):
        step = (F.col("hi") - F.col("lo")) / (points - 1)
        grid = limits.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(
            *KEYS, step.alias("step"), (F.col("lo") + F.col("__i") * step).alias("log_ratio")
        )
        solved = sums(models, grid).withColumn("__s", solve("spec", "__a", "__slope")).select(
            *KEYS, "step", "log_ratio", "n_rows", "shift", "log_det_v", "slope_v", "__s.*"
        )
        shape = (F.col("n_rows") - F.col("rank")) / 2 + PRIOR_NU
        rate = (F.col("rss") + PRIOR_NU * PRIOR_V * (1 + F.exp(-F.col("log_ratio")))) / 2
        priced = solved.withColumns({"shape": shape, "rate": rate}).withColumn(
            "__w", -PRIOR_NU / 2 * F.col("log_ratio") - (F.col("log_det_v") + F.col("log_det")) / 2 - F.col("shape") * F.log("rate")
        )
        priced = cut_lineage(priced)
        best = attach(priced, KEYS, __best=F.max("__w"))
        if left:
            mass = best.where(F.col("__w") >= F.col("__best") - DEPTH)
            limits = mass.groupBy(*KEYS).agg((F.min("log_ratio") - F.max("step")).alias("lo"), (F.max("log_ratio") + F.max("step")).alias("hi"))
            if shared:
                limits = attach(limits, ["response"], __lo=F.min("lo"), __hi=F.max("hi")).select(*KEYS, F.col("__lo").alias("lo"), F.col("__hi").alias("hi"))
            limits = cut_lineage(limits)
    best = attach(best.withColumn("__w", F.exp(F.col("__w") - F.col("__best"))), KEYS, __sum=F.sum("__w"))
    return best.select(
        *KEYS, "log_ratio", (F.col("__w") / F.col("__sum")).alias("weight"), "n_rows", "shift", "shape", "rate", "rank",
        (F.col("rss") + F.col("slope_rss")).alias("fit"), (F.col("rank") + F.col("slope_v") + F.col("slope_det")).alias("hat"), "beta", "unit_var",
    )


def _digamma(x: Column) -> Column:
    """For shapes above 0.02: eight steps up, then the asymptotic series."""
    up = x + 8
    y = 1 / (up * up)
    steps = sum((1 / (x + i) for i in range(1, 8)), 1 / x)
    return F.log(up) - 0.5 / up - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132)))) - steps


def _effects(grid: DataFrame, models: Models) -> DataFrame:
    """A row per grid point and effect of the spec; aliased effects are left out."""
    names = F.create_map(*[x for s, at in models.picks.items() for x in (F.lit(s), F.array(*[F.lit(models.names[i]) for i in at]))])
    each = grid.withColumn("__e", F.explode(F.arrays_zip(names[F.col("spec")].alias("param"), "beta", "unit_var"))).where("__e.unit_var > 0")
    shift = F.when(F.col("__e.param") == "(Intercept)", F.col("shift")).otherwise(0.0)
    return each.select(*KEYS, "weight", "shape", "rate", F.col("__e.param").alias("param"), (F.col("__e.beta") + shift).alias("centre"), F.col("__e.unit_var").alias("unit_var"))


def posterior_means(grid: DataFrame, models: Models) -> DataFrame:
    """``response, spec, param, mean, sd``: all effects, ``group_var`` and ``units_var``."""
    spread = F.col("rate") / (F.col("shape") - 1)
    effects = _effects(grid, models).select(*KEYS, "param", "weight", F.col("centre").alias("one"), (F.col("unit_var") * spread + F.col("centre") ** 2).alias("two"))
    square = F.col("rate") * F.col("rate") / ((F.col("shape") - 1) * (F.col("shape") - 2))
    times = F.when(F.col("param") == "group_var", F.exp("log_ratio")).otherwise(1.0)
    variances = grid.withColumn("param", F.explode(F.array(F.lit("group_var"), F.lit("units_var")))).select(
        *KEYS, "param", "weight", (times * spread).alias("one"), (times * times * square).alias("two")
    )
    sums = effects.unionByName(variances).groupBy(*KEYS, "param").agg(
        F.sum(F.col("weight") * F.col("one")).alias("mean"), F.sum(F.col("weight") * F.col("two")).alias("__two")
    )
    return sums.select(*KEYS, "param", "mean", F.sqrt(F.greatest(F.col("__two") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("sd"))


def posterior_intervals(grid: DataFrame, models: Models, prob: float = 0.95) -> DataFrame:
    """``response, spec, param, lower, upper, p_mcmc`` of the effects: narrowest interval and two-sided share beyond zero.

    One group holds the grid points of one effect, ``points`` rows at most.
    """

    def below(x: np.ndarray, f: pd.DataFrame) -> np.ndarray:
        scale = np.sqrt(f["unit_var"] * f["rate"] / f["shape"]).to_numpy()
        t = (x[:, None] - f["centre"].to_numpy()) / scale
        tail = t_two_sided(t, 2 * f["shape"].to_numpy()[None, :] + 0 * t) / 2
        return np.where(t > 0, 1 - tail, tail) @ f["weight"].to_numpy()

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f[f["weight"] > 1e-12]
        scale = np.sqrt(f["unit_var"] * f["rate"] / f["shape"])
        x = np.linspace((f["centre"] - 8 * scale).min(), (f["centre"] + 8 * scale).max(), 2001)
        share = below(x, f)
        start = np.linspace(0, 1 - prob, 4001)[1:-1]
        low, high = np.interp(start, share, x), np.interp(start + prob, share, x)
        best = int(np.argmin(high - low))
        zero = float(below(np.zeros(1), f)[0])
        return pd.DataFrame([[*key, low[best], high[best], 2 * min(zero, 1 - zero)]], columns=[*KEYS, "param", "lower", "upper", "p_mcmc"])

    shape = "response string, spec string, param string, lower double, upper double, p_mcmc double"
    return _effects(grid, models).groupBy(*KEYS, "param").applyInPandas(run, shape)


def deviance_means(grid: DataFrame, models: Models) -> DataFrame:
    """``response, spec, d_mean, units, beta_mean, rows``: the mean deviance given the group effects, and the means it is held against."""
    w, most = F.col("weight"), max(len(p) for p in models.picks.values())
    deviance = F.col("n_rows") * (F.log(2 * F.pi()) + F.log("rate") - _digamma(F.col("shape"))) + F.col("shape") / F.col("rate") * F.col("fit") + F.col("hat")
    at = _each(most, lambda j: F.sum(w * F.coalesce(F.get("beta", F.lit(j)), F.lit(0.0))))
    return cut_lineage(grid.groupBy(*KEYS).agg(
        F.sum(w * deviance).alias("d_mean"), F.sum(w * F.col("rate") / (F.col("shape") - 1)).alias("units"), at.alias("beta_mean"), F.max("n_rows").alias("rows")
    ))


def scored(fits: DataFrame) -> DataFrame:
    """DIC from ``fit``, the square sum of the residuals at the means, and its distance to the best of the response."""
    at_mean = F.col("rows") * (F.log(2 * F.pi()) + F.log("units")) + F.col("fit") / F.col("units")
    found = attach(fits.select(*KEYS, (2 * F.col("d_mean") - at_mean).alias("dic")), ["response"], __best=F.min("dic"))
    return found.select(*KEYS, "dic", (F.col("dic") - F.col("__best")).alias("delta_dic"))


def grid_dic(grid: DataFrame, models: Models) -> DataFrame:
    """``response, spec, dic, delta_dic``: twice the mean deviance less that at the means, conditional on the group effects."""
    width, picks = len(models.names) + 1, models.picks
    most = max(len(p) for p in picks.values())
    w = F.col("weight")
    means = deviance_means(grid, models)
    # mean group effects: the mean shrinkage, and its product with the effects, by group size
    ratio = F.exp("log_ratio")
    shrunk = w * ratio / (1 + F.col("size") * ratio)
    met = grid.select(*KEYS, "log_ratio", "weight", "beta").join(models.moments.select("response", "size"), "response")
    shrink = met.groupBy(*KEYS, "size").agg(
        F.sum(shrunk).alias("c"), _each(most, lambda j: F.sum(shrunk * F.coalesce(F.get("beta", F.lit(j)), F.lit(0.0)))).alias("cb")
    )

    @F.pandas_udf("around double, cross double, own double")
    def parts(spec: pd.Series, total: pd.Series, squares: pd.Series, beta: pd.Series, c: pd.Series, cb: pd.Series) -> pd.DataFrame:
        out = []
        for name, rows in spec.groupby(spec).groups.items():
            keep = [*picks[name], width - 1]
            p = len(keep) - 1
            one = np.ones((len(rows), 1))
            theta = np.concatenate([-np.stack(beta[rows].to_numpy())[:, :p], one], axis=1)
            psi = np.concatenate([-np.stack(cb[rows].to_numpy())[:, :p], c[rows].to_numpy()[:, None]], axis=1)
            t, s = _square(total[rows], width, keep), _square(squares[rows], width, keep)
            out.append(pd.DataFrame({
                "around": np.einsum("ri,rij,rj->r", theta, t, theta), "cross": np.einsum("ri,rij,rj->r", psi, s, theta),
                "own": np.einsum("ri,rij,rj->r", psi, s, psi),
            }, index=rows))
        return pd.concat(out).reindex(spec.index)

    lines = shrink.join(means, KEYS).join(models.moments.select("response", "size", "total", "squares"), ["response", "size"])
    lines = lines.withColumn("__p", parts("spec", "total", "squares", "beta_mean", "c", "cb"))
    sums = lines.groupBy(*KEYS).agg(
        (F.max("__p.around") - 2 * F.sum("__p.cross") + F.sum(F.col("size") * F.col("__p.own"))).alias("fit"),
        F.max("d_mean").alias("d_mean"), F.max("units").alias("units"), F.max("rows").alias("rows"),
    )
    return scored(sums)


def best_effects(grid: DataFrame, models: Models, prob: float = 0.95) -> DataFrame:
    """Effects of the best model of each response by DIC, intercepts left out: mean, sd, interval, p."""
    best = grid_dic(grid, models).where("delta_dic = 0").select(*KEYS)
    used = cut_lineage(join_null_safe(grid, best, KEYS, "left_semi"))
    both = posterior_means(used, models).join(posterior_intervals(used, models, prob), [*KEYS, "param"])
    return both.where(F.col("param") != "(Intercept)")
