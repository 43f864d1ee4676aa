"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import settled


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that join the same nodes: each node of a batch and the smallest one it reaches within the batch."""
    for batch in batches:
        ids, at = np.unique(np.concatenate([batch.column(c).to_numpy() for c in (0, 1)]), return_inverse=True)
        a, b = at.reshape(2, -1)
        root = np.arange(len(ids))
        while (x := root[a] != root[b]).any():
            low, high = np.minimum(root[a[x]], root[b[x]]), np.maximum(root[a[x]], root[b[x]])
            np.minimum.at(root, high, low)
            while (root != (root := root[root])).any():
                pass
        yield pa.RecordBatch.from_arrays([pa.array(ids[root]), pa.array(ids)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Each round lets a node take the smallest root of its neighbours, its root
    the smallest that any of its nodes has met, and then jumps to the root's
    root, so long chains close in a number of rounds that grows with the
    logarithm of their length, whatever the order of their ids. Minima are combined before each
    shuffle, and the joins are plain equi-joins that Spark may split. A round is
    one plan and one checkpoint; all uses of ``met`` and ``step`` read the same shuffles.
    What a batch of edges joins by itself is joined before the first round.
    """
    trees = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(forests, "a long, b long")
    both = settled(trees.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct())
    state = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root"))
    while True:
        seen = both.join(state, both.b == state.node).groupBy("a").agg(F.min("root").alias("near"))
        met = state.join(seen, state.node == seen.a).select("node", "root", "near")
        hook = met.groupBy(F.col("root").alias("of")).agg(F.min("near").alias("next"))
        step = met.join(hook, met.node == hook.of, "left").select("node", "root", F.least("root", "near", "next").alias("low"))
        jump = step.select(F.col("node").alias("at"), F.col("low").alias("far"))
        new = step.join(jump, step.low == jump.at).select(
            "node", F.least("low", "far").alias("root"), (F.least("low", "far") < F.col("root")).alias("moved")
        )
        new = settled(new)
        state = new.select("node", "root")
        if new.where("moved").isEmpty():
            return state
