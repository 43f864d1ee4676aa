"""Euler tours of trees by parallel list ranking.

A tour enters and leaves every node once. Its links come from sibling numbers;
pointer jumping then turns them into places and running sums, in rounds ~ log2
of the nodes however deep a tree is. A subtree is the range of places between
entering and leaving its top, so sums below a node are differences of two
running sums, and being below a node is a comparison. There are never more
rows than two per node.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.ranks import row_numbers
from spanloom.session import cut_lineage

MOST_ROUNDS = 60  # 2^60 places; more means that the edges hold a cycle


def _links(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Each node with its first child and its next sibling, where it has them."""
    ranked = row_numbers(nodes.where(F.col("parent").isNotNull()).select("tree_id", "parent", "child", *[c for c in order if c != "child"]), ["tree_id", "parent"], order, "rank")
    ranked = cut_lineage(ranked.select("tree_id", "parent", "child", "rank"))
    following = ranked.select("tree_id", "parent", (F.col("rank") - 1).alias("rank"), F.col("child").alias("sibling"))
    siblings = ranked.join(following, ["tree_id", "parent", "rank"]).select("tree_id", "child", "sibling")
    firsts = ranked.where("rank = 1").select("tree_id", F.col("parent").alias("child"), F.col("child").alias("first_child"))
    return nodes.join(siblings, ["tree_id", "child"], "left").join(firsts, ["tree_id", "child"], "left")


def tour(edges: DataFrame, sums: Mapping[str, Column] | None = None, xors: Mapping[str, Column] | None = None) -> DataFrame:
    """``tree_id, node, first, last`` and, for each of ``sums`` and ``xors``, its total over the subtree.

    ``first`` and ``last`` are the places of entering and leaving a node; node
    ``a`` lies in the subtree of ``b`` where ``a.first`` is between ``b.first``
    and ``b.last``. ``sums`` are whole numbers per node, not negative; their
    totals over all nodes entered earlier follow as ``before_…``. Children are
    visited by ``pos`` where the edges have it, else by name. A missing weight
    counts as 0; edges with a cycle raise.
    """
    sums, xors = dict(sums or {}), dict(xors or {})
    order = ["pos", "child"] if "pos" in edges.columns else ["child"]
    weights = {**sums, **xors}
    own = [F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(f"__{n}") for n, c in weights.items()]
    nodes = cut_lineage(edges.select("tree_id", "parent", *order, *own))

    def place(leaving: bool, next_node: Column, next_leaving: Column) -> Column:
        kept = [(F.lit(0).cast("long") if leaving else F.col(f"__{n}")).alias(n) for n in weights]
        return F.struct(
            F.lit(leaving).alias("leaving"), next_node.alias("to"), next_leaving.alias("to_leaving"), F.lit(1).cast("long").alias("places"), *kept
        )

    inner, last_one = F.col("first_child").isNotNull(), F.col("sibling").isNull()
    places = [
        place(False, F.coalesce("first_child", "child"), ~inner),
        place(True, F.coalesce("sibling", "parent"), last_one),
    ]
    state = cut_lineage(_links(nodes, order).select("tree_id", F.col("child").alias("node"), F.inline(F.array(*places))))
    for _ in range(MOST_ROUNDS):
        ahead = state.select(
            "tree_id", F.col("node").alias("__node"), F.col("leaving").alias("__leaving"), F.col("to").alias("__to"),
            F.col("to_leaving").alias("__to_leaving"), *[F.col(c).alias(f"__{c}") for c in ("places", *weights)],
        )
        # A place that has reached the end meets itself, so no key is missing or hot there.
        ended = F.col("to").isNull()
        aimed = state.withColumns({"__node": F.coalesce("to", "node"), "__leaving": F.when(ended, F.col("leaving")).otherwise(F.col("to_leaving"))})

        def ahead_of(name: str) -> Column:
            return F.when(ended, F.lit(0).cast("long")).otherwise(F.col(f"__{name}"))

        state = cut_lineage(
            aimed.join(ahead, ["tree_id", "__node", "__leaving"]).select(
                "tree_id", "node", "leaving", F.col("__to").alias("to"), F.col("__to_leaving").alias("to_leaving"),
                *[(F.col(c) + ahead_of(c)).alias(c) for c in ("places", *sums)], *[F.col(c).bitwiseXOR(ahead_of(c)).alias(c) for c in xors],
            )
        )
        if state.where(F.col("to").isNotNull()).isEmpty():
            return _by_node(state, list(sums), list(xors))
    raise ValueError("the edges hold a cycle")


def _by_node(state: DataFrame, sums: list[str], xors: list[str]) -> DataFrame:
    """Both places of a node in one row; what was summed up to the end becomes what lies between and before."""
    summed = ["places", *sums]
    totals = state.groupBy("tree_id").agg(*[F.max(c).alias(f"__all_{c}") for c in summed])
    ends = [F.max(F.when(F.col("leaving") == flag, F.col(c))).alias(f"{name}_{c}") for flag, name in ((False, "__in"), (True, "__out")) for c in (*summed, *xors)]
    nodes = state.groupBy("tree_id", "node").agg(*ends).join(totals, "tree_id")
    return nodes.select(
        "tree_id", "node", (F.col("__all_places") - F.col("__in_places")).alias("first"), (F.col("__all_places") - F.col("__out_places")).alias("last"),
        *[(F.col(f"__in_{c}") - F.col(f"__out_{c}")).alias(c) for c in sums],
        *[(F.col(f"__all_{c}") - F.col(f"__in_{c}")).alias(f"before_{c}") for c in sums],
        *[F.col(f"__in_{c}").bitwiseXOR(F.col(f"__out_{c}")).alias(c) for c in xors],
    )


def pair_ancestors(edges: DataFrame, places: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(tree_id, a, b)`` with ``top``, the last common ancestor of both nodes.

    Ancestors 1, 2, 4, ... steps up are listed for every node; from the longest
    step on, a pair rises while its node does not yet hold ``b``. One join a
    step length.
    """
    spans = places.select("tree_id", F.col("node").alias("up"), F.col("first").alias("__first"), F.col("last").alias("__last"))
    one = edges.where(F.col("parent").isNotNull()).select("tree_id", F.col("child").alias("node"), F.col("parent").alias("up"))
    steps = [cut_lineage(one.join(spans, ["tree_id", "up"]))]
    while True:
        again = steps[-1].select("tree_id", F.col("node").alias("up"), F.col("up").alias("__up"), F.col("__first").alias("f"), F.col("__last").alias("l"))
        twice = cut_lineage(
            steps[-1].join(again, ["tree_id", "up"]).select("tree_id", "node", F.col("__up").alias("up"), F.col("f").alias("__first"), F.col("l").alias("__last"))
        )
        if twice.isEmpty():
            break
        steps.append(twice)
    goal = places.select("tree_id", F.col("node").alias("b"), F.col("first").alias("__goal"))
    state = pairs.join(goal, ["tree_id", "b"]).withColumn("__at", F.col("a"))
    for step in reversed(steps):
        risen = state.join(step.withColumnRenamed("node", "__at"), ["tree_id", "__at"], "left")
        outside = ~F.col("__goal").between(F.col("__first"), F.col("__last"))
        state = cut_lineage(risen.withColumn("__at", F.when(outside, F.col("up")).otherwise(F.col("__at"))).drop("up", "__first", "__last"))
    here = spans.withColumnRenamed("up", "__at")
    parents = one.select("tree_id", F.col("node").alias("__at"), F.col("up").alias("__parent"))
    ended = state.join(here, ["tree_id", "__at"]).join(parents, ["tree_id", "__at"], "left")
    holds = F.col("__goal").between(F.col("__first"), F.col("__last"))
    return ended.withColumn("top", F.when(holds, F.col("__at")).otherwise(F.col("__parent"))).select(*pairs.columns, "top")
