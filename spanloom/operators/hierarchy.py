"""Tree-structured keys as edge tables.

An edge table has ``tree_id, parent, child, length, label, support, is_tip``
and may have ``pos``, the drawing order; the root row has no parent. Trees are
never gathered: order, tip sets and ancestors come from ranked tours (``tours``),
rounds ~ log2 of the nodes; sums from the tips upwards go level by level for all
trees at once, each level one aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.joins import anti, join_null_safe, semi
from spanloom.operators.ranks import attach
from spanloom.operators.tours import pair_ancestors, tour
from spanloom.session import cut_lineage


MAX_DENSE_TIPS = 2000


def _empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def paths(edges: DataFrame, share: str | None = None) -> DataFrame:
    """``tree_id, node, ancestor, steps, dist, share`` for every node and ancestor, itself included.

    Rows grow with nodes times depth; only results of that size need them.
    ``dist`` adds branch lengths, ``share`` multiplies the given column.
    """
    own = F.col(share) if share else F.lit(1.0)
    one = edges.where(F.col("parent").isNotNull()).select(
        "tree_id", F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("steps"),
        F.coalesce("length", F.lit(0.0)).alias("dist"), own.alias("share"),
    )
    self_rows = edges.select(
        "tree_id", F.col("child").alias("node"), F.col("child").alias("ancestor"), F.lit(0).alias("steps"),
        F.lit(0.0).alias("dist"), F.lit(1.0).alias("share"),
    )

    def compose(a: DataFrame, b: DataFrame) -> DataFrame:
        above = b.withColumnsRenamed({c: f"__{c}" for c in b.columns})
        joined = a.join(above, (F.col("tree_id") == F.col("__tree_id")) & (F.col("ancestor") == F.col("__node")))
        return joined.select(
            "tree_id", "node", F.col("__ancestor").alias("ancestor"), (F.col("steps") + F.col("__steps")).alias("steps"),
            (F.col("dist") + F.col("__dist")).alias("dist"), (F.col("share") * F.col("__share")).alias("share"),
        )

    reach, jump = one, one
    while True:
        jump = cut_lineage(jump)
        if _empty(jump):
            return self_rows.unionByName(reach)
        # reach: up to s steps; jump: exactly s steps.
        reach = cut_lineage(reach.unionByName(compose(jump, reach))) if reach is not one else one.unionByName(compose(jump, one))
        jump = compose(jump, jump)


def heights(edges: DataFrame) -> DataFrame:
    """``tree_id, node, height``: distance from the root, by pointer jumping."""
    state = edges.select(
        "tree_id", F.col("child").alias("node"), F.col("parent").alias("up"), F.coalesce("length", F.lit(0.0)).alias("height")
    )
    state = state.withColumn("height", F.when(F.col("up").isNotNull(), F.col("height")).otherwise(0.0))
    while not _empty(state.where(F.col("up").isNotNull())):
        above = state.select("tree_id", F.col("node").alias("up"), F.col("up").alias("__up"), F.col("height").alias("__h"))
        state = state.join(above, ["tree_id", "up"], "left").select(
            "tree_id", "node", F.col("__up").alias("up"), (F.col("height") + F.coalesce("__h", F.lit(0.0))).alias("height")
        )
        state = cut_lineage(state)
    return state.select("tree_id", "node", "height")


def _with_tips(edges: DataFrame, tips: DataFrame, label: str) -> DataFrame:
    """Places of all nodes, and ``tips``, the number of listed tips below each."""
    wanted = semi(edges.where("is_tip"), tips, [("label", label)]).select("tree_id", "child", F.lit(1).alias("__wanted")).distinct()
    return tour(edges.join(wanted, ["tree_id", "child"], "left"), {"tips": F.col("__wanted")})


def keep_tips(edges: DataFrame, tips: DataFrame, label: str = "label") -> DataFrame:
    """Restrict trees to the listed tips.

    Nodes left with one child are removed and their lengths added to the
    child's, also at the root, so the root is the last common ancestor.
    """
    used = _with_tips(edges, tips, label).where("tips > 0").select("tree_id", F.col("node").alias("child"))
    kept = cut_lineage(edges.join(used, ["tree_id", "child"], "left_semi"))
    children = kept.groupBy("tree_id", F.col("parent").alias("child")).agg(F.count(F.lit(1)).alias("__k"))
    marked = kept.join(children, ["tree_id", "child"], "left")
    single = (F.coalesce("__k", F.lit(0)) == 1).alias("single")
    state = marked.select("tree_id", "child", F.col("parent").alias("up"), F.coalesce("length", F.lit(0.0)).alias("length"), single)
    # Jump over chains of single-child nodes, halving them every round.
    while True:
        above = state.select(
            "tree_id", F.col("child").alias("up"), F.col("up").alias("__up"), F.col("length").alias("__len"), F.col("single").alias("__single")
        )
        joined = state.join(above, ["tree_id", "up"], "left")
        skip = F.coalesce("__single", F.lit(False))
        state = cut_lineage(
            joined.select(
                "tree_id", "child", F.when(skip, F.col("__up")).otherwise(F.col("up")).alias("up"),
                F.when(skip, F.col("length") + F.col("__len")).otherwise(F.col("length")).alias("length"), "single", skip.alias("__moved"),
            )
        )
        moved = state.where("__moved")
        state = state.drop("__moved")
        if _empty(moved):
            break
    rest = kept.drop("parent", "length")
    length = F.when(F.col("up").isNotNull(), F.col("length")).alias("length")
    shaped = state.where(~F.col("single")).join(rest, ["tree_id", "child"])
    own = [length if c == "length" else F.col("up").alias("parent") if c == "parent" else F.col(c) for c in edges.columns]
    return shaped.select(*own)


def match_traits(edges: DataFrame, traits: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Traits of the tips in tree order with their position, and the tree cut to them."""
    tree = keep_tips(edges, traits.select(F.col(on).alias("label")).distinct())
    order = tip_order(tree).select("tree_id", F.col("label").alias(on), "position")
    return join_null_safe(order, traits, on), tree


def tip_order(edges: DataFrame) -> DataFrame:
    """``tree_id, label, position``: tips as drawn.

    Siblings follow ``pos``, their place in the tree text, where the edges have
    it, and their names otherwise.
    """
    places = tour(edges, {"tips": F.col("is_tip").cast("long")}).select("tree_id", F.col("node").alias("child"), (F.col("before_tips") + 1).alias("position"))
    return edges.where("is_tip").join(places, ["tree_id", "child"]).select("tree_id", "label", "position")


def tip_sets(edges: DataFrame) -> DataFrame:
    """``tree_id, node, n_tips, tips_key``: a key of the set of tips below each inner node."""
    hashed = F.when(F.col("is_tip"), F.xxhash64("label"))
    below = tour(edges, {"n_tips": F.col("is_tip").cast("long"), "hashes": F.pmod(hashed, F.lit(2**40))}, {"mixed": hashed})
    inner = below.join(edges.where("is_tip").select("tree_id", F.col("child").alias("node")), ["tree_id", "node"], "left_anti")
    return inner.where("n_tips > 0").select("tree_id", "node", "n_tips", F.struct("n_tips", "mixed", "hashes").alias("tips_key"))


def transfer_support(source: DataFrame, target: DataFrame) -> DataFrame:
    """Copy node support between trees of equal topology, whatever their rotation.

    Returns the target edges with the source's support, and ``matched``.
    """
    values = source.where(~F.col("is_tip")).select("tree_id", F.col("child").alias("node"), F.col("support").alias("__sup"))
    keyed = tip_sets(source).join(values, ["tree_id", "node"]).select("tree_id", "tips_key", "__sup", F.lit(True).alias("__hit"))
    named = tip_sets(target).join(keyed, ["tree_id", "tips_key"], "left").select("tree_id", F.col("node").alias("child"), "__sup", "__hit")
    out = target.join(named, ["tree_id", "child"], "left")
    return out.withColumns(
        {"support": F.col("__sup"), "matched": F.col("is_tip") | F.coalesce("__hit", F.lit(False))}
    ).drop("__sup", "__hit")


def common_ancestor(edges: DataFrame, tips: DataFrame, label: str = "label") -> DataFrame:
    """``tree_id, node``: most recent common ancestor of the listed tips in each tree."""
    places = _with_tips(edges, tips, label)
    counts = places.groupBy("tree_id").agg(F.max("tips").alias("__all"))
    full = places.join(counts, "tree_id").where((F.col("tips") == F.col("__all")) & (F.col("tips") > 0))
    return full.groupBy("tree_id").agg(F.min_by("node", F.col("last") - F.col("first")).alias("node"))


def shared_length(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``tree_id, tip_i, tip_j, shared``: branch length shared by each listed pair of tips."""
    edges = cut_lineage(edges)
    tips = edges.where("is_tip").select("tree_id", "label", "child")
    named = pairs.join(tips.withColumnsRenamed({"label": "tip_i", "child": "a"}), ["tree_id", "tip_i"])
    named = named.join(tips.withColumnsRenamed({"label": "tip_j", "child": "b"}), ["tree_id", "tip_j"])
    tops = pair_ancestors(edges, cut_lineage(tour(edges)), named.select("tree_id", "tip_i", "tip_j", "a", "b"))
    top = heights(edges).select("tree_id", F.col("node").alias("top"), F.col("height").alias("shared"))
    return tops.join(top, ["tree_id", "top"]).select("tree_id", "tip_i", "tip_j", "shared")


def covariance(edges: DataFrame, max_tips: int = MAX_DENSE_TIPS) -> DataFrame:
    """Shared length of every pair of tips, for trees small enough for dense use.

    Larger trees are refused: their statistics come from ``tree_sums``, which
    never forms the pairs.
    """
    tips = edges.where("is_tip").select("tree_id", "label")
    most = tips.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    if most > max_tips:
        raise ValueError(f"a tree has {most} tips; at most {max_tips} for a dense covariance")
    pairs = tips.withColumnRenamed("label", "tip_i").join(tips.withColumnRenamed("label", "tip_j"), "tree_id")
    return shared_length(edges, pairs)


def scale_by_lambda(edges: DataFrame, grid: DataFrame) -> DataFrame:
    """Edges once per ``grid(tree_id, lam)`` value: inner branches times lambda.

    Tips are stretched so that their distance from the root stays.
    """
    top = heights(edges).withColumnRenamed("node", "child")
    joined = edges.join(top, ["tree_id", "child"]).join(grid, "tree_id")
    tip = F.col("height") - F.col("lam") * (F.col("height") - F.col("length"))
    scaled = F.when(F.col("is_tip"), tip).otherwise(F.col("length") * F.col("lam"))
    return joined.withColumn("length", F.when(F.col("parent").isNotNull(), scaled)).drop("height")


def node_sums(edges: DataFrame, values: DataFrame, xs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Weighted sums at every node, from the tips upwards.

    ``edges`` may carry extra ``keys`` (several branch-length sets); ``values``
    has ``tree_id, *keys, label`` and the columns ``xs`` for every tip. A node
    with ``c`` children of length ``v`` and value ``x`` gets weight
    ``W = sum(1/v)``, the mean of ``x`` by those weights and, for all pairs of
    columns, the weighted sum of squares around it. That covers nodes with more
    than two children as they are. Its own length grows by ``1/W``.
    """
    by = ["tree_id", *keys]
    n_children = edges.where(F.col("parent").isNotNull()).groupBy(*by, F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("__c")
    )
    own = edges.select(*by, F.col("child").alias("node"), F.col("parent").alias("__up"), F.coalesce("length", F.lit(0.0)).alias("__own"))
    inner = cut_lineage(n_children.join(own, [*by, "node"]))
    tips = edges.where("is_tip").join(values, [*by, "label"])
    bad = (F.col("length") <= 0) | F.col("length").isNull()
    v = F.when(bad, F.raise_error(F.lit("tip branches must be positive"))).otherwise(F.col("length"))
    carry = tips.select(*by, F.col("parent").alias("node"), F.col("child").alias("from"), v.alias("__v"), *xs)
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]]
    done = None
    for number in count():
        w = 1 / F.col("__v")
        sums = carry.groupBy(*by, "node").agg(
            F.count(F.lit(1)).alias("__n"),
            F.sum(w).alias("weight"),
            F.sum(F.log("__v")).alias("__lv"),
            *[F.sum(w * F.col(x)).alias(f"__m_{x}") for x in xs],
            *[F.sum(w * F.col(a) * F.col(b)).alias(f"__q_{a}_{b}") for a, b in pairs],
        )
        ready = sums.join(inner, [*by, "node"]).where(F.col("__n") == F.col("__c"))
        level = ready.select(
            *by, "node", F.col("__up").alias("up"), F.col("__c").alias("children"), F.lit(number).alias("level"), "weight",
            (F.col("__lv") + F.log("weight")).alias("logdet"),
            (F.col("__own") + 1 / F.col("weight")).alias("__v"),
            *[(F.col(f"__m_{x}") / F.col("weight")).alias(x) for x in xs],
            *[(F.col(f"__q_{a}_{b}") - F.col(f"__m_{a}") * F.col(f"__m_{b}") / F.col("weight")).alias(f"q_{a}_{b}") for a, b in pairs],
        )
        level = cut_lineage(level)
        if _empty(level):
            if not _empty(carry):
                raise ValueError("a tip has no value: cut the tree to the tips with values first")
            return done
        done = level if done is None else done.unionByName(level)
        waiting = carry.join(level, [*by, "node"], "left_anti")
        risen = level.where(F.col("up").isNotNull()).select(*by, F.col("up").alias("node"), F.col("node").alias("from"), "__v", *xs)
        carry = cut_lineage(waiting.unionByName(risen))


def tree_sums(edges: DataFrame, values: DataFrame, xs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per tree: tips, root means, ``1'C^-1 1``, log determinant, contrast sums of squares.

    ``q_a_b`` equals ``(a - root)' C^-1 (b - root)`` of the dense formulas.
    """
    by = ["tree_id", *keys]
    sums = node_sums(edges, values, xs, keys)
    root = F.col("up").isNull()
    pairs = [c for c in sums.columns if c.startswith("q_")]
    return sums.groupBy(*by).agg(
        (F.sum("children") - F.sum(F.when(~root, 1).otherwise(0))).alias("n"),
        F.max(F.when(root, F.col("weight"))).alias("root_weight"),
        (F.sum("logdet") - F.log(F.max(F.when(root, F.col("weight"))))).alias("logdet"),
        *[F.max(F.when(root, F.col(x))).alias(f"root_{x}") for x in xs],
        *[F.sum(c).alias(c) for c in pairs],
    )


def column_sums(edges: DataFrame, values: DataFrame, xs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Root means and contrast sums of squares of many columns on one set of branches.

    ``values`` has ``tree_id, *keys, label`` and ``xs``. Returns ``tree_id,
    *keys, root_weight``, ``root_…`` and ``q_…``.
    """
    return risen_sums(edges, tip_moments(edges, values, xs, keys), xs, keys)


def tip_moments(edges: DataFrame, values: DataFrame, xs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``tree_id, *keys, node`` with the weighted sums (``__m_…``) and square sums (``__q_…``) of the tips right below a node."""
    tips = edges.where("is_tip").select("tree_id", "label", F.col("parent").alias("node"), (1 / F.col("length")).alias("__w"))
    w = F.col("__w")
    return values.join(tips, ["tree_id", "label"]).groupBy("tree_id", *keys, "node").agg(
        *[F.sum(w * F.col(x)).alias(f"__m_{x}") for x in xs], *[F.sum(w * F.col(x) * F.col(x)).alias(f"__q_{x}") for x in xs]
    )


def risen_sums(edges: DataFrame, moments: DataFrame, xs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``column_sums`` from the moments of the tips below each node, as ``tip_moments`` gives them.

    Weights and levels of the nodes do not depend on the columns, so they are
    found once; then each level is one map-side combined aggregate over its
    children, one row a node and key.
    """
    by = ["tree_id", *keys]
    zero = edges.where("is_tip").select("tree_id", "label", F.lit(0.0).alias("__zero"))
    shape = cut_lineage(node_sums(edges, zero, ["__zero"]).select("tree_id", "node", "up", "weight", "__v", "level"))
    above = shape.select("tree_id", F.col("node").alias("up"), F.col("level").alias("__at"))
    shape = cut_lineage(shape.join(above, ["tree_id", "up"], "left"))
    summed = [f"__{kind}_{x}" for kind in "mq" for x in xs]
    at = above.withColumnRenamed("up", "node")
    waiting = [cut_lineage(moments.join(at, ["tree_id", "node"]).select(*by, "node", "__at", *summed))]
    done = None
    for number in range((shape.agg(F.max("level")).first()[0] or 0) + 1):
        children = reduce(DataFrame.unionByName, waiting).where(F.col("__at") == number)
        added = children.groupBy(*by, "node").agg(*[F.sum(c).alias(c) for c in summed])
        level = added.join(shape.where(F.col("level") == number), ["tree_id", "node"]).select(
            *by, "up", "weight", "__v", "__at", *[(F.col(f"__m_{x}") / F.col("weight")).alias(x) for x in xs],
            *[(F.col(f"__q_{x}") - F.col(f"__m_{x}") * F.col(f"__m_{x}") / F.col("weight")).alias(f"q_{x}") for x in xs],
        )
        level = cut_lineage(level)
        done = level if done is None else done.unionByName(level)
        w = 1 / F.col("__v")
        waiting.append(level.where(F.col("up").isNotNull()).select(
            *by, F.col("up").alias("node"), "__at",
            *[(w * F.col(x)).alias(f"__m_{x}") for x in xs], *[(w * F.col(x) * F.col(x)).alias(f"__q_{x}") for x in xs],
        ))
    root = F.col("up").isNull()
    return done.groupBy(*by).agg(
        F.max(F.when(root, F.col("weight"))).alias("root_weight"), *[F.max(F.when(root, F.col(x))).alias(f"root_{x}") for x in xs],
        *[F.sum(f"q_{x}").alias(f"q_{x}") for x in xs],
    )


def contrast_weights(edges: DataFrame) -> DataFrame:
    """``tree_id, contrast, tip, coef, var``: node means as linear weights of the tips.

    The mean at node ``contrast`` is ``sum(coef * x)`` over its tips; ``var``
    is its branch length after the upward pass. ``weight`` is the node's
    factor in ``x' C^-1 x`` centred at the root.
    """
    tips = edges.where("is_tip").select("tree_id", "label").withColumn("__one", F.lit(0.0))
    sums = node_sums(edges, tips, ["__one"]).select("tree_id", "node", "weight", "__v", "up")
    inner = sums.select("tree_id", F.col("node").alias("child"), "__v", F.col("weight").alias("__w"))
    above = sums.select("tree_id", F.col("node").alias("parent"), F.col("weight").alias("__wp"))
    full = edges.join(inner, ["tree_id", "child"], "left").join(above, ["tree_id", "parent"], "left")
    v = F.when(F.col("is_tip"), F.col("length")).otherwise(F.col("__v"))
    full = cut_lineage(full.withColumns({"__vv": v, "__share": 1 / (v * F.col("__wp"))}))
    labels = edges.where("is_tip").select("tree_id", F.col("child").alias("node"), F.col("label").alias("tip"))
    factor = F.when(F.col("parent").isNotNull(), 1 / F.col("__vv")).otherwise(0.0) - F.coalesce("__w", F.lit(0.0))
    info = full.select("tree_id", F.col("child").alias("ancestor"), F.col("__vv").alias("var"), factor.alias("weight"))
    up = paths(full, "__share").join(labels, ["tree_id", "node"]).join(info, ["tree_id", "ancestor"])
    return up.select("tree_id", F.col("ancestor").alias("contrast"), "tip", F.col("share").alias("coef"), "var", "weight")


def with_node_attributes(edges: DataFrame, table: DataFrame, on: str, low_support: float = 50.0) -> DataFrame:
    """Attach attributes by label; support below the level is blanked."""
    joined = join_null_safe(edges, table, [("label", on)])
    return joined.withColumn("support", F.when(F.col("support") >= low_support, F.col("support")))


def missing_tips(edges: DataFrame, tips: DataFrame, label: str = "label") -> DataFrame:
    return anti(tips, edges.where("is_tip"), [(label, "label")])


def centred(values: DataFrame, xs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Subtract tree means, so that squared sums do not cancel."""
    by = ["tree_id", *keys]
    out = attach(values, by, **{f"__mean_{x}": F.avg(x) for x in xs})
    return out.withColumns({x: F.col(x) - F.col(f"__mean_{x}") for x in xs})
