"""Mixed-model grids whose group effects follow a tree.

The effects of the groups, the tips, arise along the branches from zero at the
root, so two tips covary by the length they share. For every point of the
variance grid one pass from the tips to the root gives the cross products of
the design and the response under that covariance: a node carries its weight
and one weighted sum per column, and adds its share to a few sums over all nodes.
Derivatives by the logarithm of the ratio go along. A pass back to the tips gives
the mean effects. No covariance matrix is formed and nothing is sampled; rows
are nodes times grid points, whatever the size of the tree.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.hierarchy import heights, keep_tips
from spanloom.operators.mixed import Term, design, factor_levels
from spanloom.operators.ranks import attach
from spanloom.operators.reshape import to_long
from spanloom.operators.variance_grid import KEYS, Models, deviance_means, posterior_grid, scored
from spanloom.session import cut_lineage

NODE = ["tree_id", "node"]


@dataclass
class TreeModels(Models):
    """Besides the moments per response, the sums of every tip and the nodes with their step from the root and scaled branch."""

    tips: DataFrame
    nodes: DataFrame


def tree_moments(
    df: DataFrame, responses: Sequence[str], factors: Sequence[str], specs: Mapping[str, Sequence[Term]], group: str, edges: DataFrame
) -> TreeModels:
    """Moments of each response, the sums of its tips, and the tree cut to them with height one.

    ``group`` names tips by their labels; rows without a tip are refused. A tip
    label stands in one tree. Rows missing the response or a factor are dropped
    per response.
    """
    levels = factor_levels(df, factors)
    full = design(levels, list(dict.fromkeys(t for terms in specs.values() for t in terms)))
    names = list(full)
    picks = {s: [names.index(n) for n in design(levels, terms)] for s, terms in specs.items()}
    z = [*[f"__x{i}" for i in range(len(names))], "__y"]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]

    long = to_long(df, [group, *factors], responses, "response", "__y").dropna(subset=["__y", *factors])
    long = attach(long, ["response"], __shift=F.avg("__y")).withColumn("__y", F.col("__y") - F.col("__shift"))
    long = long.withColumns(dict(zip(z, full.values())))
    groups = long.groupBy("response", F.col(group).alias("label")).agg(
        F.count(F.lit(1)).alias("size"), F.array(*[F.sum(c) for c in z]).alias("s"), F.max("__shift").alias("shift"),
        F.array(*[F.sum(F.col(z[i]) * F.col(z[j])) for i, j in pairs]).alias("products"),
    )
    groups = cut_lineage(groups)
    tree = cut_lineage(keep_tips(edges, groups.select("label").distinct()))
    places = tree.where("is_tip").select("tree_id", F.col("child").alias("node"), "label")
    tips = groups.join(places, "label", "left")
    lost = F.when(F.col("node").isNull(), F.raise_error(F.concat(F.lit("not a tip of the trees: "), F.coalesce("label", F.lit("null"))))).otherwise(F.col("node"))
    tips = cut_lineage(tips.withColumn("node", lost))
    s, n = F.col("s"), F.col("size")
    moments = groups.groupBy("response").agg(
        F.sum("size").alias("n_rows"), F.max("shift").alias("shift"),
        F.array(*[F.sum(F.col("products")[k]) for k in range(len(pairs))]).alias("total"),
        F.array(*[F.sum(F.col("products")[k] - s[i] * s[j] / n) for k, (i, j) in enumerate(pairs)]).alias("within"),
    )
    return TreeModels(cut_lineage(moments), names, picks, tips.select("response", *NODE, "label", "size", "s"), levelled(tree))


def levelled(tree: DataFrame) -> DataFrame:
    """``tree_id, node, up, level, branch, is_inner``: steps from the root, and lengths as shares of the tree's height."""
    up = tree.select(
        "tree_id", F.col("child").alias("node"), F.col("parent").alias("up"), F.coalesce("length", F.lit(0.0)).alias("length"), (~F.col("is_tip")).alias("is_inner")
    )
    steps = heights(tree.withColumn("length", F.lit(1.0))).withColumnRenamed("height", "level")
    tall = heights(tree).groupBy("tree_id").agg(F.max("height").alias("tall"))
    joined = up.join(steps, NODE).join(tall, "tree_id")
    length = F.when(F.col("up").isNotNull(), F.col("length") / F.col("tall")).otherwise(0.0)
    return cut_lineage(joined.select(*NODE, "up", F.col("level").cast("int").alias("level"), length.alias("branch"), "is_inner"))


def _below(own: DataFrame, k: int) -> DataFrame:
    """Nodes as their parents see them: weight, sums and log determinant below the branch, with derivatives by the log ratio.

    ``w0, dw0``, ``s0_…, ds0_…`` are those of the node itself; ``w, dw, s_…, ds_…, lv, dlv`` follow.
    """
    b, w, dw = F.col("branch") * F.exp("log_ratio"), F.col("w0"), F.col("dw0")
    own = own.withColumn("__b", b).withColumn("f", 1 / (1 + F.col("__b") * w))
    own = own.withColumn("df", -F.col("f") * F.col("f") * F.col("__b") * (w + dw))
    f, df = F.col("f"), F.col("df")
    return own.withColumns({
        "w": w * f, "dw": dw * f + w * df, "lv": F.log1p(F.col("__b") * w), "dlv": f * F.col("__b") * (w + dw),
        **{f"s_{i}": F.col(f"s0_{i}") * f for i in range(k)}, **{f"ds_{i}": F.col(f"ds0_{i}") * f + F.col(f"s0_{i}") * df for i in range(k)},
    }).drop("__b", "f", "df")


def _passed_on(nodes: DataFrame, k: int, tips: bool) -> DataFrame:
    """What nodes give their parents, one row per response, point and parent, in one map-side combined aggregate.

    ``w0, dw0, s0_…, ds0_…`` are the sums the parent sees, ``lv, dlv, share_…,
    slope_…`` what the nodes themselves add to the log determinant and the cross
    products. A tip's own products are those between the rows of its group,
    counted with the moments.
    """

    def product(i, j, a="s_", weight="w"):
        return F.col(f"{a}{i}") * F.col(f"{a}{j}") / F.col(weight)

    def slope(i, j, a="s", weight="w"):
        x, y, dx, dy = F.col(f"{a}_{i}"), F.col(f"{a}_{j}"), F.col(f"d{a}_{i}"), F.col(f"d{a}_{j}")
        return (dx * y + x * dy - x * y * F.col(f"d{weight}") / F.col(weight)) / F.col(weight)

    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    if tips:
        share, steep = [product(i, j) for i, j in pairs], [slope(i, j) for i, j in pairs]
    else:
        share = [product(i, j) - product(i, j, "s0_", "w0") for i, j in pairs]
        steep = [slope(i, j) - slope(i, j, "s0", "w0") for i, j in pairs]
    return nodes.groupBy("response", "log_ratio", "tree_id", F.col("up").alias("node")).agg(
        *[F.sum(c).alias(f"{c}0") for c in ("w", "dw")], *[F.sum(f"{c}_{i}").alias(f"{c}0_{i}") for c in ("s", "ds") for i in range(k)],
        F.sum("lv").alias("lv"), F.sum("dlv").alias("dlv"),
        *[F.sum(c).alias(f"share_{n}") for n, c in enumerate(share)], *[F.sum(c).alias(f"slope_{n}") for n, c in enumerate(steep)],
    )


def tip_rows(models: TreeModels) -> DataFrame:
    """The tips of each response with their nodes, weights and sums; a lone tip is its own root, without a branch."""
    return models.tips.join(models.nodes.drop("is_inner"), NODE).select(
        "response", *NODE, "up", "level", "branch", F.col("size").cast("double").alias("w0"),
        *[F.col("s")[i].alias(f"s0_{i}") for i in range(len(models.names) + 1)],
    )


def upward(models: TreeModels, points: DataFrame) -> tuple[DataFrame | None, DataFrame, int]:
    """One pass from the tips to the root at all ``points(response, log_ratio)``.

    Returns the inner nodes as their parents see them, if there are any below the
    roots; what all nodes added, one row per response, point and parent; and the
    number of columns. Only inner nodes are kept: tips at all
    points are read once and go into the aggregate of their parents. A root with
    branches has no row.
    """
    k = len(models.names) + 1
    deepest = models.nodes.where("is_inner").agg(F.max("level")).first()[0]
    tips = tip_rows(models).join(F.broadcast(points), "response").withColumns({"dw0": F.lit(0.0), **{f"ds0_{i}": F.lit(0.0) for i in range(k)}})
    tips = _below(tips, k)
    given = cut_lineage(_passed_on(tips, k, True))
    summed = [c for c in given.columns if c.startswith(("w0", "dw0", "s0_", "ds0_"))]
    own = given.join(models.nodes.where("is_inner").drop("is_inner"), NODE).select("response", "log_ratio", *NODE, "up", "level", "branch", *summed)
    own = cut_lineage(own)
    inner, added, risen = None, given, None
    for level in range(deepest if deepest is not None else -1, 0, -1):
        here = own.where(F.col("level") == level)
        if risen is not None:
            # children that are tips and children that are not
            here = here.unionByName(risen.where(F.col("level") == level)).groupBy("response", "log_ratio", *NODE, "up", "level", "branch").agg(*[F.sum(c).alias(c) for c in summed])
        here = cut_lineage(_below(here, k))
        inner = here if inner is None else inner.unionByName(here)
        given = cut_lineage(_passed_on(here, k, False))
        added = added.unionByName(given)
        risen = given.join(models.nodes.where("is_inner").drop("is_inner"), NODE).select("response", "log_ratio", *NODE, "up", "level", "branch", *summed)
    return inner, added, k


def tree_sums_at(models: TreeModels, grid: DataFrame) -> DataFrame:
    """``log_det_v, slope_v, __a, __slope`` at every row of ``grid``."""
    points = cut_lineage(grid.select("response", "log_ratio").distinct())
    _, added, k = upward(models, points)
    width = k * (k + 1) // 2
    sums = added.groupBy("response", "log_ratio").agg(
        F.sum("lv").alias("log_det_v"), F.sum("dlv").alias("slope_v"),
        F.array(*[F.sum(f"share_{i}") for i in range(width)]).alias("share"), F.array(*[F.sum(f"slope_{i}") for i in range(width)]).alias("__slope"),
    )
    whole = models.moments.select("response", "n_rows", "shift", "within")
    return grid.join(sums, ["response", "log_ratio"]).join(whole, "response").withColumn("__a", F.zip_with("within", "share", lambda x, y: x + y))


def tree_posterior_grid(models: TreeModels, points: int = 49, rounds: int = 4) -> DataFrame:
    """``posterior_grid`` with effects along the trees."""
    return posterior_grid(models, points, rounds, tree_sums_at, shared=True)


def mean_effects(grid: DataFrame, models: TreeModels) -> DataFrame:
    """``response, spec, tree_id, node, effect``: posterior mean of every node's effect, the root's being zero.

    Inner nodes go down from the root, a row per point of the grid; tips are
    last and are summed over the points as they are read.
    """
    inner, _, k = upward(models, cut_lineage(grid.select("response", "log_ratio").distinct()))
    used = F.create_map(*[x for s, at in models.picks.items() for x in (F.lit(s), F.array(*[F.lit(i) for i in at]))])[F.col("spec")]
    # per column of the full design what the effects take of a node's sums
    taken = [F.coalesce(F.get("beta", F.array_position(used, F.lit(i)).cast("int") - 1), F.lit(0.0)).alias(f"__t{i}") for i in range(k - 1)]
    # the grid is bounded: its points for each model, numbered per response
    order = Window.partitionBy("response").orderBy("spec", "log_ratio")
    spread = cut_lineage(grid.select(*KEYS, "log_ratio", "weight", (F.row_number().over(order) - 1).alias("at"), *taken))
    left = F.col(f"s0_{k - 1}") - sum((F.col(f"__t{i}") * F.col(f"s0_{i}") for i in range(k - 1)), F.lit(0.0))
    b = F.col("branch") * F.exp("log_ratio")
    moved = (1 / (1 + b * F.col("w0"))) * (b * left + F.col("__up"))
    done = None
    ends = tip_rows(models)
    if inner is not None:
        each = inner.select("response", "log_ratio", *NODE, "up", "level", "branch", "w0", *[f"s0_{i}" for i in range(k)])
        each = each.join(F.broadcast(spread), ["response", "log_ratio"])
        above = None
        for level in range(1, inner.agg(F.max("level")).first()[0] + 1):
            here = each.where(F.col("level") == level)
            here = here.withColumn("__up", F.lit(0.0)) if above is None else here.join(above, ["response", "at", "tree_id", "up"])
            here = cut_lineage(here.select(*KEYS, "at", *NODE, "weight", moved.alias("e")))
            done = here if done is None else done.unionByName(here)
            above = here.select("response", "at", "tree_id", F.col("node").alias("up"), F.col("e").alias("__up"))
        # a tip meets its parent once, with the effects at all points in their order
        packed = done.groupBy("response", "tree_id", F.col("node").alias("up")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "e"))), lambda x: x.e).alias("__ups")
        )
        ends = ends.join(packed, ["response", "tree_id", "up"], "left").join(F.broadcast(spread), "response").withColumn("__up", F.coalesce(F.get("__ups", F.col("at")), F.lit(0.0)))
    else:
        ends = ends.join(F.broadcast(spread), "response").withColumn("__up", F.lit(0.0))
    every = ends.select(*KEYS, *NODE, "weight", moved.alias("e"))
    if done is not None:
        every = every.unionByName(done.select(*every.columns))
    return every.groupBy(*KEYS, *NODE).agg(F.sum(F.col("weight") * F.col("e")).alias("effect"))


def tree_grid_dic(grid: DataFrame, models: TreeModels) -> DataFrame:
    """``response, spec, dic, delta_dic``: as ``grid_dic``, conditional on the effects of the tips."""
    means = deviance_means(grid, models)
    k = len(models.names) + 1
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    used = F.create_map(*[x for s, at in models.picks.items() for x in (F.lit(s), F.array(*[F.lit(i) for i in at]))])[F.col("spec")]
    # the mean effects in the places of the full design, then 1 for the response
    at = means.withColumn("__u", used)
    theta = F.array(*[-F.coalesce(F.get("beta_mean", F.array_position("__u", i).cast("int") - 1), F.lit(0.0)) if i < k - 1 else F.lit(1.0) for i in range(k)])
    theta = F.transform(theta, lambda x: F.coalesce(x, F.lit(0.0)))
    at = cut_lineage(at.withColumn("theta", theta).select(*KEYS, "d_mean", "units", "rows", "theta"))
    tips = models.tips.join(mean_effects(grid, models), ["response", *NODE]).join(at, KEYS)
    left = F.aggregate(F.zip_with("theta", "s", lambda t, x: t * x), F.lit(0.0), lambda a, x: a + x)
    own = tips.groupBy(*KEYS).agg(F.sum(F.col("size") * F.col("effect") ** 2 - 2 * F.col("effect") * left).alias("own"))
    around = sum((F.col("theta")[i] * F.col("theta")[j] * F.col("total")[p] * (1 if i == j else 2) for p, (i, j) in enumerate(pairs)), F.lit(0.0))
    fits = at.join(own, KEYS).join(models.moments.select("response", "total"), "response")
    return scored(fits.select(*KEYS, (around + F.col("own")).alias("fit"), "d_mean", "units", "rows"))
