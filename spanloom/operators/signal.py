"""Statistics of traits on trees: K, lambda and generalised least squares."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.tails import chi2_1_p_value, f_p_value
from spanloom.operators.hierarchy import centred, heights, keep_tips, risen_sums, scale_by_lambda, tip_moments, tree_sums
from spanloom.operators.joins import join_null_safe
from spanloom.operators.ranks import row_numbers
from spanloom.operators.reshape import to_long
from spanloom.session import cut_lineage

ORDERS_A_ROW = 32
#: Rows of orders that one task draws together from the values of one tree.
ROWS_A_DRAW = 4
#: Values of a tree that one task orders; the orders of larger trees are sorted by Spark, a row per value and order.
MOST_DRAWN = 200_000


def cut_to(edges: DataFrame, traits: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """Trees cut to the tips that have all of ``cols``; trees with fewer than two of them drop out."""
    known = traits.dropna(subset=list(cols)).select(F.col(label).alias("label")).distinct()
    kept = cut_lineage(keep_tips(edges, known))
    lone = kept.where(F.col("is_tip") & F.col("parent").isNull()).select("tree_id")
    return cut_lineage(kept.join(lone, "tree_id", "left_anti"))


def signal_k(edges: DataFrame, traits: DataFrame, label: str, cols: Sequence[str], nsim: int = 10_000, seed: int = 1, most_drawn: int = MOST_DRAWN) -> DataFrame:
    """Blomberg's K per tree and trait with a permutation p-value.

    For each trait the trees are cut to the tips that have a value. The
    observed order counts as one of the ``nsim`` orders, and p is the share of
    orders whose K reaches the observed one; both are null for a trait without
    spread. Orders follow seeded hashes, so reruns agree. The values go once to
    each group of orders, where a tree of up to ``most_drawn`` values is ordered
    and summed to the nodes above its tips; the upward pass has a row per inner
    node and ``ORDERS_A_ROW`` orders, whatever the depth.
    """
    parts = [_signal_k(cut_to(edges, traits, label, [c]), traits, label, [c], nsim, seed, most_drawn) for c in cols]
    return reduce(DataFrame.unionByName, parts)


def signal_by_stage(edges: DataFrame, traits: DataFrame, label: str, cols: Sequence[str], stage: str, nsim: int = 10_000, seed: int = 1) -> DataFrame:
    """K for each value of ``stage``, each with trees of its own."""
    stages = [r[0] for r in traits.select(stage).distinct().orderBy(stage).collect()]  # a few named stages
    parts = [signal_k(edges, traits.where(F.col(stage) == s), label, cols, nsim, seed).withColumn(stage, F.lit(s)) for s in stages]
    return reduce(DataFrame.unionByName, parts)


def draw(slots: int, nsim: int, xs: Sequence[str]):
    """Moments of the tips below each node for a group of orders, from rows sorted by tree, trait, group, tip and idx."""

    def summed(rows: pa.Table, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        number, idx, x, w = (rows.column(c).to_numpy() for c in ("draw", "idx", "x", "__w"))
        tip, node = (rows.column(c).combine_chunks().dictionary_encode() for c in ("tip", "node"))
        at, known = node.indices.to_numpy(zero_copy_only=False), len(node.dictionary)
        value = np.flatnonzero(np.concatenate(([True], idx[1:] != idx[:-1])))
        tip = tip.indices.to_numpy()[value]
        starts = np.flatnonzero(np.concatenate(([True], tip[1:] != tip[:-1])))
        # a tip's branches come with each of its values: those of the first count
        run = np.searchsorted(value[starts], np.arange(len(idx)), side="right") - 1
        branch = np.flatnonzero((idx == idx[value[starts]][run]) & ~np.isnan(at))
        at, run, w = at[branch].astype(np.int64), run[branch], w[branch]
        drawn, keys = x[value][np.argsort(idx[value])], keys[value]
        sums = np.zeros((2, keys.shape[1], known))
        shuffled = np.empty(len(value))
        for j in range(keys.shape[1]):
            shuffled[np.argsort(keys[:, j], kind="stable")] = drawn
            mine = np.maximum.reduceat(shuffled, starts)[run]
            sums[0, j] = np.bincount(at, weights=w * mine, minlength=known)
            sums[1, j] = np.bincount(at, weights=w * mine * mine, minlength=known)
        same = [rows.column(c).combine_chunks().take(pa.array(np.zeros(known, np.int64))) for c in ("tree_id", "trait")]
        first = int(number[0]) * slots * ROWS_A_DRAW
        for part in range(0, keys.shape[1], slots):
            if first + part < nsim:
                live = [part + i if first + part + i < nsim else None for i in range(slots)]
                block = pa.array(np.full(known, (first + part) // ORDERS_A_ROW))
                moments = [pa.nulls(known, pa.float64()) if j is None else pa.array(sums[kind, j]) for kind in (0, 1) for j in live]
                yield pa.RecordBatch.from_arrays([*same, block, node.dictionary, *moments], names=["tree_id", "trait", "block", "node", *[f"__{k}_{x}" for k in "mq" for x in xs]])

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("keys").flatten().to_numpy().reshape(batch.num_rows, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def close():
            light = pa.Table.from_batches([b.drop_columns(["keys"]) for b in held])
            return summed(light, np.concatenate([matrix(b) for b in held]))

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy() for c in ("tree_id", "trait", "draw")]
            cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                key = tuple(batch.column(c)[int(a)].as_py() for c in ("tree_id", "trait", "draw"))
                if held and key != last:
                    yield from close()
                    held = []
                held.append(batch.slice(int(a), int(b - a)))
                last = key
        if held:
            yield from close()

    return run


def drawn_moments(edges: DataFrame, values: DataFrame, nsim: int, seed: int, xs: Sequence[str]) -> DataFrame:
    """``tree_id, trait, block, node`` with the moments of all orders: a value goes once to each group of orders."""
    together = len(xs) * ROWS_A_DRAW
    # a tip listed more than once below a node weighs as often
    branches = edges.where("is_tip").groupBy("tree_id", F.col("label").alias("tip"), F.col("parent").alias("node")).agg(F.sum(1 / F.col("length")).alias("__w"))
    rows = values.join(branches, ["tree_id", "tip"]).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit((nsim - 1) // together))))
    at = ["tree_id", "trait", "draw"]
    rows = rows.repartition(*at).sortWithinPartitions(*at, "tip", "idx", "node")
    perms = [F.col("draw") * together + i for i in range(min(nsim, together))]
    keys = F.array(*[F.when(p == 0, F.col("idx")).otherwise(F.xxhash64(F.lit(seed), p, "tip")) for p in perms])
    rows = rows.select(*at, "tip", "idx", "x", "node", "__w", keys.alias("keys"))
    kinds = dict(rows.dtypes)
    sums = ", ".join(f"__{k}_{x} double" for k in "mq" for x in xs)
    return rows.mapInArrow(draw(len(xs), nsim, xs), f"tree_id {kinds['tree_id']}, trait string, block long, node {kinds['node']}, {sums}")


def sorted_moments(edges: DataFrame, values: DataFrame, nsim: int, seed: int, xs: Sequence[str]) -> DataFrame:
    """As ``drawn_moments`` for trees of any size, with a row per value and order."""
    orders = values.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(nsim - 1))))
    key = F.when(F.col("perm") == 0, F.col("idx")).otherwise(F.xxhash64(F.lit(seed), "perm", "tip"))
    orders = row_numbers(orders.withColumn("__key", key), ["tree_id", "trait", "perm"], ["__key", "tip"], "pick")
    drawn = values.select("tree_id", "trait", F.col("idx").alias("pick"), F.col("x").alias("__x"))
    shuffled = orders.select("tree_id", "trait", "perm", "tip", "pick").join(drawn, ["tree_id", "trait", "pick"])
    width = F.lit(ORDERS_A_ROW)
    blocks = shuffled.groupBy("tree_id", "trait", F.floor(F.col("perm") / width).alias("block"), F.col("tip").alias("label")).agg(
        *[F.max(F.when(F.col("perm") % width == i, F.col("__x"))).alias(x) for i, x in enumerate(xs)]
    )
    return tip_moments(edges, blocks, xs, ["trait", "block"])


def _signal_k(edges: DataFrame, traits: DataFrame, label: str, cols: Sequence[str], nsim: int, seed: int, most_drawn: int) -> DataFrame:
    tips = edges.where("is_tip").select("tree_id", F.col("label").alias("tip"))
    values = to_long(tips.join(traits.withColumnRenamed(label, "tip"), "tip"), ["tree_id", "tip"], cols, "trait", "x")
    values = centred(values.dropna(subset=["x"]), ["x"], ["trait"]).drop("__mean_x")
    values = cut_lineage(row_numbers(values, ["tree_id", "trait"], ["tip"], "idx"))

    # A row per node and block of orders, an order a column.
    xs = [f"x{i}" for i in range(min(nsim, ORDERS_A_ROW))]
    large = cut_lineage(values.groupBy("tree_id", "trait").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most_drawn))
    moments = drawn_moments(edges, join_null_safe(values, large, ["tree_id", "trait"], "left_anti"), nsim, seed, xs)
    if not large.isEmpty():
        moments = moments.unionByName(sorted_moments(edges, join_null_safe(values, large, ["tree_id", "trait"], "left_semi"), nsim, seed, xs))
    sums = risen_sums(edges, moments, xs, ["trait", "block"])

    top = heights(edges).withColumnRenamed("node", "child").join(edges.where("is_tip"), ["tree_id", "child"])
    scale = top.groupBy("tree_id").agg(F.sum("height").alias("__diag"), F.count(F.lit(1)).alias("n"))
    squares = values.groupBy("tree_id", "trait").agg(F.sum(F.col("x") * F.col("x")).alias("__xx"), F.sum("x").alias("__sx"))
    full = sums.join(scale, "tree_id").join(squares, ["tree_id", "trait"])
    n = F.col("n")
    expected = (F.col("__diag") - n / F.col("root_weight")) / (n - 1)

    def k_of(x: str):
        a = F.col(f"root_{x}")
        spread = F.col("__xx") - 2 * a * F.col("__sx") + n * a * a
        return F.try_divide(F.try_divide(spread, F.col(f"q_{x}")), expected)

    k = cut_lineage(full.select("tree_id", "trait", "block", F.array(*[k_of(x) for x in xs]).alias("ks")))
    observed = k.where("block = 0").select("tree_id", "trait", F.get("ks", F.lit(0)).alias("__k0"))
    reached = F.size(F.filter("ks", lambda c: c >= F.col("__k0") * (1 - 1e-12)))
    return k.join(observed, ["tree_id", "trait"]).groupBy("tree_id", "trait").agg(
        F.max("__k0").alias("k"), F.when(F.max("__k0").isNotNull(), F.sum(reached) / nsim).alias("p_value")
    )


def log_likelihood(sums: DataFrame, x: str) -> DataFrame:
    """Maximised normal log-likelihood of each tree's sums."""
    n, q = F.col("n"), F.col(f"q_{x}_{x}")
    value = -0.5 * (n * F.log(2 * F.pi()) + n * F.log(q / n) + F.col("logdet") + n)
    return sums.withColumn("log_lik", value)


def lambda_profile(edges: DataFrame, values: DataFrame, x: str, grid: DataFrame) -> DataFrame:
    """``tree_id, lam, log_lik`` for every value of ``grid(tree_id, lam)``."""
    many = scale_by_lambda(edges, grid)
    tips = values.join(grid, "tree_id")
    return log_likelihood(tree_sums(many, tips, [x], ["lam"]), x).select("tree_id", "lam", "log_lik")


def signal_lambda(edges: DataFrame, traits: DataFrame, label: str, col: str, points: int = 21, rounds: int = 4) -> DataFrame:
    """Pagel's lambda by maximum likelihood, p by likelihood ratio against zero.

    The upper bound is the largest lambda that keeps every branch length
    positive: tree height over the deepest inner node. Each round evaluates a
    grid for all trees and narrows it around the best point. Trees are cut to
    the tips that have a value.
    """
    edges = cut_to(edges, traits, label, [col])
    tips = edges.where("is_tip").select("tree_id", "label")
    values = tips.join(traits.select(F.col(label).alias("label"), F.col(col).alias("x")), "label").dropna(subset=["x"])
    values = cut_lineage(centred(values, ["x"]).select("tree_id", "label", "x"))
    top = heights(edges).withColumnRenamed("node", "child").join(edges, ["tree_id", "child"])
    limits = top.groupBy("tree_id").agg(
        F.min(F.when(F.col("is_tip"), F.col("height") / F.nullif(F.col("height") - F.col("length"), F.lit(0.0)))).alias("__cap")
    ).select("tree_id", F.lit(0.0).alias("lo"), (F.coalesce("__cap", F.lit(1.0)) * (1 - 1e-9)).alias("hi"))
    limits = cut_lineage(limits)
    everything = None
    for _ in range(rounds):
        steps = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
        grid = limits.withColumn("__i", steps).select(
            "tree_id", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("__i") / (points - 1)).alias("lam")
        )
        profile = cut_lineage(lambda_profile(edges, values, "x", cut_lineage(grid)))
        everything = profile if everything is None else everything.unionByName(profile)
        best = profile.groupBy("tree_id").agg(F.max_by("lam", "log_lik").alias("__b"))
        step = (F.col("hi") - F.col("lo")) / (points - 1)
        limits = cut_lineage(
            limits.join(best, "tree_id").select(
                "tree_id", F.greatest(F.col("lo"), F.col("__b") - step).alias("lo"), F.least(F.col("hi"), F.col("__b") + step).alias("hi")
            )
        )
    out = everything.groupBy("tree_id").agg(
        F.max_by("lam", "log_lik").alias("lam"), F.max("log_lik").alias("log_lik"), F.max(F.when(F.col("lam") == 0, F.col("log_lik"))).alias("__null")
    )
    ratio = 2 * (F.col("log_lik") - F.col("__null"))
    return out.withColumn("p_value", chi2_1_p_value(ratio)).drop("__null")


def tree_gls(edges: DataFrame, traits: DataFrame, label: str, y: str, x: str) -> DataFrame:
    """Regression of ``y`` on ``x`` with tree covariance, branch lengths as given.

    Trees are cut to the tips that have both values.
    """
    edges, traits = cut_to(edges, traits, label, [x, y]), traits.dropna(subset=[x, y])
    tips = edges.where("is_tip").select("tree_id", "label")
    values = tips.join(traits.select(F.col(label).alias("label"), F.col(y).alias("y"), F.col(x).alias("x")), "label")
    values = centred(values, ["x", "y"])
    shift = values.groupBy("tree_id").agg(F.max("__mean_x").alias("__cx"), F.max("__mean_y").alias("__cy"))
    s = tree_sums(edges, values, ["x", "y"]).join(shift, "tree_id")
    qxx, qxy, qyy, n = F.col("q_x_x"), F.col("q_x_y"), F.col("q_y_y"), F.col("n")
    s = s.withColumns({"slope": F.try_divide(qxy, qxx), "rss": qyy - F.try_divide(qxy * qxy, qxx), "df": n - 2})
    s = s.withColumns(
        {
            "intercept": F.col("root_y") + F.col("__cy") - F.col("slope") * (F.col("root_x") + F.col("__cx")),
            "r_squared": 1 - F.try_divide("rss", "q_y_y"),
            "sigma": F.sqrt(F.try_divide("rss", "df")),
            "f_value": F.try_divide(qyy - F.col("rss"), F.try_divide(F.col("rss"), F.col("df"))),
        }
    )
    s = s.withColumn("adj_r_squared", 1 - (1 - F.col("r_squared")) * F.try_divide(n - 1, F.col("df")))
    s = s.withColumn("p_value", f_p_value(F.col("f_value"), F.lit(1.0), F.col("df")))
    return s.select("tree_id", "n", "intercept", "slope", "sigma", "df", "r_squared", "adj_r_squared", "f_value", "p_value")


def gls_fitted(edges: DataFrame, traits: DataFrame, label: str, x: str, model: DataFrame) -> DataFrame:
    """Fitted value per tip."""
    tips = edges.where("is_tip").select("tree_id", "label").join(traits.select(F.col(label).alias("label"), F.col(x).alias("__x")), "label")
    lines = model.select("tree_id", "intercept", "slope")
    return tips.join(lines, "tree_id").select("tree_id", "label", (F.col("intercept") + F.col("slope") * F.col("__x")).alias("fitted"))
