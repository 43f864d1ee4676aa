"""Gaussian mixed-model grids: one random intercept, several fixed-effect specs.

Spark reduces the data to moments; chains then run one per (response, spec,
chain), all in parallel, and emit draws as rows. With independent groups the
group effects enter only through sums over groups of equal size, and those
sums are drawn exactly from their own distributions, so a chain's state grows
with the number of distinct group sizes and not with rows or groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from spanloom.operators.joins import join_null_safe
from spanloom.operators.ranks import attach, row_numbers
from spanloom.operators.reshape import to_long
from spanloom.session import cut_lineage

DRAWS = "response string, spec string, chain int, iter long, param string, value double"
MAX_LEVELS = 200
MAX_TREE_GROUPS = 2000
# Inverse-gamma prior of both variances (V = 1, nu = 0.02).
PRIOR_V, PRIOR_NU = 1.0, 0.02

Term = tuple[str, ...]


def factor_levels(df: DataFrame, factors: Sequence[str]) -> dict[str, list]:
    """Sorted levels of each factor; the first is the reference."""
    out = {}
    for factor in factors:
        rows = df.select(factor).where(F.col(factor).isNotNull()).distinct().orderBy(factor).take(MAX_LEVELS + 1)
        if len(rows) > MAX_LEVELS:
            raise ValueError(f"{factor} has more than {MAX_LEVELS} levels; not a factor")
        out[factor] = [r[0] for r in rows]
    return out


def design(levels: Mapping[str, Sequence], terms: Sequence[Term]) -> dict[str, Column]:
    """Dummy-coded columns of the terms; a term of several factors is their interaction."""
    columns: dict[str, Column] = {"(Intercept)": F.lit(1.0)}
    for term in terms:
        combos: list[tuple[str, Column]] = [("", F.lit(1.0))]
        for factor in term:
            combos = [
                (f"{name}:{factor}{lv}" if name else f"{factor}{lv}", value * F.when(F.col(factor) == lv, 1.0).otherwise(0.0))
                for name, value in combos
                for lv in levels[factor][1:]
            ]
        columns.update(combos)
    return columns


def _moments(cols: Sequence[str]) -> Column:
    """Upper triangle of the cross-product sums as one array."""
    return F.array(*[F.sum(F.col(a) * F.col(b)) for i, a in enumerate(cols) for b in cols[i:]])


def _square(flat, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = np.asarray(flat, float)
    return out + np.triu(out, 1).T


def mixed_grid(
    df: DataFrame,
    responses: Sequence[str],
    factors: Sequence[str],
    specs: Mapping[str, Sequence[Term]],
    group: str,
    chains: int = 1,
    iters: int = 500_000,
    burn: int = 1_000,
    thin: int = 500,
    seed: int = 1,
    cov: DataFrame | None = None,
) -> DataFrame:
    """Posterior draws ``response, spec, chain, iter, param, value``.

    Rows missing the response are dropped per response. Parameters are the
    fixed effects, ``group_var``, ``units_var``, ``deviance`` and, once per
    chain as iteration 0, ``deviance_at_mean``. ``cov(tip_i, tip_j, shared)``
    gives correlated groups, scaled to a largest diagonal of one; such a chain
    keeps one effect per group and refuses more than ``MAX_TREE_GROUPS``.
    """
    levels = factor_levels(df, factors)
    all_terms = list(dict.fromkeys(t for terms in specs.values() for t in terms))
    full = design(levels, all_terms)
    names = list(full)
    xs = [f"__x{i}" for i in range(len(names))]
    picks = {s: [names.index(n) for n in design(levels, terms)] for s, terms in specs.items()}
    schedule = (iters, burn, thin)

    long = to_long(df, [group, *factors], responses, "response", "__y").dropna(subset=["__y", *factors])
    long = attach(long, ["response"], __shift=F.avg("__y")).withColumn("__y", F.col("__y") - F.col("__shift"))
    long = long.withColumns(dict(zip(xs, full.values())))
    z = [*xs, "__y"]
    totals = long.groupBy("response").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("__shift").alias("shift"), _moments(z).alias("total")
    )
    groups = long.groupBy("response", group).agg(F.count(F.lit(1)).alias("size"), *[F.sum(c).alias(c) for c in z])
    if cov is None:
        stats = groups.groupBy("response", "size").agg(F.count(F.lit(1)).alias("m"), _moments(z).alias("moment"))
    else:
        stats = _tree_rows(groups, cov, group, z)
    stats = join_null_safe(stats, totals, ["response"])
    models = stats.withColumn("spec", F.explode(F.array(*[F.lit(s) for s in specs]))).withColumn(
        "chain", F.explode(F.sequence(F.lit(1), F.lit(chains)))
    )
    width = len(z)
    sampler = _class_chain if cov is None else _tree_chain

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        response, spec, chain = key
        idx = picks[spec]
        rng = np.random.default_rng([seed, int(chain), *f"{response}/{spec}".encode()])
        labels, draws, at_mean = sampler(rows, idx, width, rng, *schedule)
        draws[:, 0] += float(rows["shift"].iloc[0])
        kept = np.arange(burn + thin, iters + 1, thin)[: len(draws)]
        labels = [names[i] for i in idx] + labels
        out = pd.DataFrame(
            {"iter": np.repeat(kept, len(labels)), "param": np.tile(labels, len(kept)), "value": draws.ravel()}
        )
        out.loc[len(out)] = [0, "deviance_at_mean", at_mean]
        return out.assign(response=response, spec=spec, chain=chain)[["response", "spec", "chain", "iter", "param", "value"]]

    return models.groupBy("response", "spec", "chain").applyInPandas(run, DRAWS)


def _tree_rows(groups: DataFrame, cov: DataFrame, group: str, z: Sequence[str]) -> DataFrame:
    """Per-group sums with that group's row of the covariance, after a size check."""
    most = groups.groupBy("response").count().agg(F.max("count")).first()[0] or 0
    if most > MAX_TREE_GROUPS:
        raise ValueError(f"{most} correlated groups; at most {MAX_TREE_GROUPS} fit one chain")
    numbered = row_numbers(groups, ["response"], [group], "pos")
    here = numbered.select("response", F.col(group).alias("tip_i"), "pos")
    there = numbered.select("response", F.col(group).alias("tip_j"), F.col("pos").alias("pos_j"))
    entries = cov.join(here, "tip_i").join(there, ["response", "tip_j"])
    lines = entries.groupBy("response", F.col("tip_i").alias(group)).agg(
        F.array_sort(F.collect_list(F.struct("pos_j", "shared"))).alias("__line")
    )
    joined = numbered.join(lines, ["response", group])
    return joined.select("response", "pos", "size", F.array(*z).alias("moment"), F.transform("__line", lambda e: e.shared).alias("line"))


def _inverse_gamma(rng, shape: float, scale: float) -> float:
    return scale / rng.gamma(shape)


def _finish(labels, kept, at_mean):
    return labels, np.asarray(kept), float(at_mean)


def _class_chain(rows: pd.DataFrame, idx: list[int], width: int, rng, iters: int, burn: int, thin: int):
    """Independent groups: effects are integrated over classes of equal size."""
    total = _square(rows["total"].iloc[0], width)
    n_rows = float(rows["n_rows"].iloc[0])
    size, m = rows["size"].to_numpy(float), rows["m"].to_numpy(float)
    keep = [*idx, width - 1]
    total = total[np.ix_(keep, keep)]
    moment = np.stack([_square(v, width)[np.ix_(keep, keep)] for v in rows["moment"]])
    p, n_groups = len(idx), m.sum()
    ridge = 1e-10 * np.eye(p)
    se2 = su2 = max(total[-1, -1] / n_rows / 2, 1e-8)
    kept, sums = [], {"beta": np.zeros(p), "se2": 0.0, "c": np.zeros(len(m)), "cb": np.zeros((len(m), p))}
    theta = np.ones(p + 1)

    def around(t):
        return t @ total @ t

    for it in range(1, iters + 1):
        c = su2 / (se2 + size * su2)
        reduced = total - np.tensordot(c, moment, 1)
        root = np.linalg.cholesky(reduced[:p, :p] / se2 + ridge)
        mean = np.linalg.solve(root.T, np.linalg.solve(root, reduced[:p, p] / se2))
        beta = mean + np.linalg.solve(root.T, rng.standard_normal(p))
        theta[:p] = -beta
        r2 = np.maximum(np.einsum("i,cij,j->c", theta, moment, theta), 0.0)
        s = np.sqrt(se2 * c)
        z1 = rng.standard_normal(len(m))
        zz = z1 * z1 + np.where(m > 1, 2 * rng.standard_gamma(np.maximum(m - 1, 1e-12) / 2), 0.0)
        rz = np.sqrt(r2) * z1
        uu = c * c * r2 + 2 * c * s * rz + s * s * zz
        ur = c * r2 + s * rz
        rss = max(around(theta) - 2 * ur.sum() + (size * uu).sum(), 1e-12)
        su2 = _inverse_gamma(rng, (PRIOR_NU + n_groups) / 2, (PRIOR_NU * PRIOR_V + uu.sum()) / 2)
        se2 = _inverse_gamma(rng, (PRIOR_NU + n_rows) / 2, (PRIOR_NU * PRIOR_V + rss) / 2)
        if it > burn and (it - burn) % thin == 0:
            deviance = n_rows * np.log(2 * np.pi * se2) + rss / se2
            kept.append([*beta, su2, se2, deviance])
            sums["beta"] += beta
            sums["se2"] += se2
            sums["c"] += c
            sums["cb"] += c[:, None] * beta
    n = max(len(kept), 1)
    theta[:p] = -sums["beta"] / n
    psi = np.concatenate([-sums["cb"] / n, (sums["c"] / n)[:, None]], axis=1)
    ur = np.einsum("ci,cij,j->c", psi, moment, theta)
    uu = np.einsum("ci,cij,cj->c", psi, moment, psi)
    rss, se2 = around(theta) - 2 * ur.sum() + (size * uu).sum(), sums["se2"] / n
    return _finish(["group_var", "units_var", "deviance"], kept, n_rows * np.log(2 * np.pi * se2) + rss / se2)


def _tree_chain(rows: pd.DataFrame, idx: list[int], width: int, rng, iters: int, burn: int, thin: int):
    """Correlated groups: fixed effects and group effects drawn jointly."""
    rows = rows.sort_values("pos")
    total = _square(rows["total"].iloc[0], width)
    n_rows = float(rows["n_rows"].iloc[0])
    keep = [*idx, width - 1]
    total = total[np.ix_(keep, keep)]
    sums_g = np.stack([np.asarray(v, float)[keep] for v in rows["moment"]])
    size, p, g = rows["size"].to_numpy(float), len(idx), len(rows)
    a = np.stack([np.asarray(v, float) for v in rows["line"]])
    a_inv = np.linalg.inv(a / a.diagonal().max())
    base = np.zeros((p + g, p + g))
    base[:p, :p], base[:p, p:], base[p:, :p] = total[:p, :p], sums_g[:, :p].T, sums_g[:, :p]
    base[p:, p:] = np.diag(size)
    target = np.concatenate([total[:p, p], sums_g[:, p]])
    prior = np.zeros_like(base)
    prior[:p, :p] = 1e-10 * np.eye(p)
    se2 = su2 = max(total[-1, -1] / n_rows / 2, 1e-8)
    kept, mean_w, mean_se2 = [], np.zeros(p + g), 0.0

    def rss_of(w):
        return max(total[-1, -1] - 2 * w @ target + w @ base @ w, 1e-12)

    for it in range(1, iters + 1):
        prior[p:, p:] = a_inv / su2
        root = np.linalg.cholesky(base / se2 + prior)
        w = np.linalg.solve(root.T, np.linalg.solve(root, target / se2) + rng.standard_normal(p + g))
        u, rss = w[p:], rss_of(w)
        su2 = _inverse_gamma(rng, (PRIOR_NU + g) / 2, (PRIOR_NU * PRIOR_V + u @ a_inv @ u) / 2)
        se2 = _inverse_gamma(rng, (PRIOR_NU + n_rows) / 2, (PRIOR_NU * PRIOR_V + rss) / 2)
        if it > burn and (it - burn) % thin == 0:
            kept.append([*w[:p], su2, se2, n_rows * np.log(2 * np.pi * se2) + rss / se2])
            mean_w += w
            mean_se2 += se2
    n = max(len(kept), 1)
    rss, se2 = rss_of(mean_w / n), mean_se2 / n
    return _finish(["group_var", "units_var", "deviance"], kept, n_rows * np.log(2 * np.pi * se2) + rss / se2)


def score_dic(draws: DataFrame) -> DataFrame:
    """``response, spec, dic, delta_dic`` ordered within response, best first.

    DIC = 2 * mean deviance - deviance at the posterior means; the deviance is
    conditional on the group effects.
    """
    per_chain = draws.where(F.col("param").isin("deviance", "deviance_at_mean")).groupBy("response", "spec", "chain").agg(
        F.avg(F.when(F.col("param") == "deviance", F.col("value"))).alias("__d"),
        F.max(F.when(F.col("param") == "deviance_at_mean", F.col("value"))).alias("__m"),
    )
    scored = per_chain.groupBy("response", "spec").agg(F.avg(2 * F.col("__d") - F.col("__m")).alias("dic"))
    best = attach(scored, ["response"], __best=F.min("dic"))
    return best.withColumn("delta_dic", F.col("dic") - F.col("__best")).drop("__best").orderBy("response", "delta_dic")


def hpd_interval(draws: DataFrame, by: Sequence[str], prob: float = 0.95) -> DataFrame:
    """Narrowest interval holding ``prob`` of the draws: ``by, lower, upper``.

    Sorted draws are joined to those a fixed number of ranks further on; of
    equally narrow intervals the first counts.
    """
    ranked = row_numbers(draws.select(*by, "value"), by, ["value"], "__rn")
    ranked = attach(ranked, by, __n=F.count(F.lit(1)))
    gap = F.greatest(F.lit(1), F.least(F.col("__n") - 1, F.rint(F.col("__n") * prob).cast("long")))
    low = ranked.withColumn("__to", F.col("__rn") + gap)
    high = ranked.select(*by, F.col("__rn").alias("__to"), F.col("value").alias("upper"))
    pairs = join_null_safe(low, high, [*by, "__to"], "inner")
    best = pairs.groupBy(*by).agg(
        F.min(F.struct((F.col("upper") - F.col("value")).alias("w"), F.col("__rn").alias("r"), F.col("value").alias("lower"), "upper")).alias("__b")
    )
    return best.select(*by, F.col("__b.lower").alias("lower"), F.col("__b.upper").alias("upper"))


def effective_size(draws: DataFrame, by: Sequence[str], chain: str = "chain", order: str = "iter") -> DataFrame:
    """Effective sample size, chains added up.

    Spectral density at zero from an autoregression fitted by Yule-Walker,
    its order chosen by AIC up to ``10 log10(n)``.
    """
    keys = [*by, chain]
    seq = row_numbers(draws.select(*keys, order, "value"), keys, [order], "__t")
    seq = attach(seq, keys, __n=F.count(F.lit(1)), __m=F.avg("value"))
    last = F.least(F.col("__n") - 1, F.floor(10 * F.log10(F.col("__n").cast("double"))))
    early = seq.withColumn("__lag", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    early = early.withColumn("__s", F.col("__t") + F.col("__lag"))
    late = seq.select(*keys, F.col("__t").alias("__s"), (F.col("value") - F.col("__m")).alias("__later"))
    cov = join_null_safe(early, late, [*keys, "__s"], "inner").groupBy(*keys, "__lag", "__n").agg(
        (F.sum((F.col("value") - F.col("__m")) * F.col("__later")) / F.col("__n")).alias("__c")
    )
    series = cov.groupBy(*keys, "__n").agg(F.transform(F.array_sort(F.collect_list(F.struct("__lag", "__c"))), lambda e: e["__c"]).alias("acov"))
    sized = series.withColumn("ess", _ess()(F.col("acov"), F.col("__n").cast("double")))
    return sized.groupBy(*by).agg(F.sum("ess").alias("effective_size"))


def _ess():
    @F.pandas_udf(DoubleType())
    def ess(acov: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([ar_effective_size(np.asarray(a, float), int(k)) for a, k in zip(acov, n)])

    return ess.asNondeterministic()


def ar_effective_size(acov: np.ndarray, n: int) -> float:
    """Effective size from autocovariances (divisor n) by Levinson recursion."""
    if n < 2 or acov[0] <= 0:
        return 0.0
    phi, v = np.zeros(0), acov[0]
    best = (n * np.log(v), phi, v, 0)
    for order in range(1, len(acov)):
        k = (acov[order] - phi @ acov[order - 1 : 0 : -1]) / v
        phi = np.append(phi - k * phi[::-1], k)
        v *= 1 - k * k
        if v <= 0:
            break
        aic = n * np.log(v) + 2 * order
        if aic < best[0]:
            best = (aic, phi, v, order)
    _, phi, v, order = best
    spectrum = v * n / (n - order - 1) / (1 - phi.sum()) ** 2
    return float(n * (acov[0] * n / (n - 1)) / spectrum)


def posterior_table(draws: DataFrame, prob: float = 0.95, by: Sequence[str] = ("response", "spec", "param")) -> DataFrame:
    """Mean, HPD interval, effective size and two-sided MCMC p of every parameter."""
    by = list(by)
    draws = cut_lineage(draws)  # read several times below
    n = F.count(F.lit(1))
    above = F.count(F.when(F.col("value") > 0, F.lit(1))) / n
    base = draws.groupBy(*by).agg(
        F.avg("value").alias("mean"), (2 * F.greatest(0.5 / n, F.least(above, 1 - above))).alias("p_mcmc")
    )
    frames = [base, hpd_interval(draws, by, prob), effective_size(draws, by)]
    return reduce(lambda a, b: join_null_safe(a, b, by), frames)


def best_parameters(draws: DataFrame, prob: float = 0.95) -> DataFrame:
    """Fixed effects, intercepts left out, of the best model per response."""
    draws = cut_lineage(draws)
    best = score_dic(draws).where("delta_dic = 0").select("response", "spec")
    other = F.col("param").isin("group_var", "units_var", "deviance", "deviance_at_mean") | F.contains("param", F.lit("Intercept"))
    used = join_null_safe(draws.where(~other), best, ["response", "spec"], "left_semi")
    return posterior_table(used, prob)
