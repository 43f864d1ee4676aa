"""Near copies by chosen paths: a randomised set similarity join.

Documents with equal shingle sets form one class. Every tree sends a class down
from the root by its minwise tokens: at a node one or two places of the sketch
are chosen, the same for all its classes, and the smallest hashes at these places
name the children. On average ``1 / similarity`` children are chosen, so a pair
above the limit goes on meeting while others part; at the root it is two.
Small nodes are compared exhaustively. Independent trees repeat this until the
target recall is met. Each candidate pair is looked up once: lengths, then
sketches, then whole sets.

A child that keeps nearly all classes of its parent consists of near copies that
further branching would not part. It is linked through its first class, and then the members
outside the largest component of the node are compared with all others, block
against block, so nothing in it is left unseen and rows grow with members times
left-over blocks, not with pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.graph import components
from spanloom.llm.jaccard_join import left_over_links, own_sets, signature, signed_sets, verify
from spanloom.llm.texts import U64, mix, shingles, runs
from spanloom.session import settled

WIDTH = 3
PERCENT = 85
#: Minwise tokens of a class, 32 bits each.
SKETCH = 64
#: Classes of a node that is compared exhaustively.
SMALL = 24
#: Share of its parent's classes from which a node counts as near copies.
COHERENT = 0.89
#: Deepest branching; nodes that are still large are compared like those of near copies.
DEEPEST = SKETCH // 2
#: Most trees.
TREES = 64
#: Chance to find a pair that is just similar enough, at the depth of the recall estimate.
RECALL, RECALL_DEPTH = 0.999, 8
#: Entries of large nodes that are branched at once.
AT_ONCE = 1 << 18
#: Standard deviations of a sketch's estimate that a pair may fall short of the limit.
SLACK = 4.75


def meeting_chance(depth: int, similarity: float) -> float:
    """Chance that a pair of this similarity meets in a node of one tree, so deep down: two places at the root, 1 / similarity below."""
    two = 1 / similarity - 1
    chance = 1.0
    for _ in range(depth - 1):
        once = similarity * chance
        chance = (1 - two) * once + two * (1 - (1 - once) ** 2)
    return 1 - (1 - similarity * chance) ** 2


def trees_needed(percent: int, recall: float = RECALL, depth: int = RECALL_DEPTH) -> int:
    missed = 1 - meeting_chance(depth, percent / 100)
    return min(TREES, math.ceil(math.log(1 - recall) / math.log(missed)))


def summarise(width: int):
    """Per document its set's size, signature and sketch."""
    salt = mix(np.arange(1, SKETCH + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    odd = mix(salt) | U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            n, sig, sketch = np.zeros(rows, np.int64), np.zeros(rows, np.int64), [None] * rows
            for first, data, offsets in runs(batch.column(1), 1 << 18):
                of, value = shingles(data, offsets, width)
                if not len(of):
                    continue
                begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                tokens = np.empty((len(begin), SKETCH), dtype="<u4")
                for j in range(SKETCH):
                    tokens[:, j] = np.minimum.reduceat(((value ^ salt[j]) * odd[j]) >> U64(32), begin)
                for k, (a, b) in enumerate(zip(begin, np.append(begin[1:], len(of)))):
                    row = first + int(of[a])
                    found = np.unique(value[a:b])
                    n[row], sig[row], sketch[row] = len(found), signature(found), tokens[k].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(sig), pa.array(sketch, pa.binary())], names=["doc_id", "n", "sig", "sketch"])

    return run


def branch(similarity: float, depth: int, trees: int | None = None):
    """Children (node, sig, n, was): from (sig, n, sketch) those of all roots, else from (sig, n, sketch, nodes) those of large nodes.

    A class comes once, with the list of its large nodes and their sizes (node, m).

    A tree has an order of the sketch's places of its own and two of them for each depth, so
    no path meets a place again. The last bits of a node name its tree.
    """
    two = 1 / similarity - 1
    places = np.stack([np.random.default_rng(tree).permutation(SKETCH) for tree in range(TREES)])[:, 2 * depth - 2 : 2 * depth]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            sig, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            tokens = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<u4").reshape(rows, SKETCH)

            def go(node, was, which, second):
                tree = node % U64(TREES)
                pick = (mix(node) & U64(1)).astype(np.int64) ^ second
                place = places[tree.astype(np.int64), pick]
                child = mix(mix(node * U64(2) + pick.astype(U64)) + tokens[which, place].astype(U64))
                child = child - child % U64(TREES) + tree
                return child.view(np.int64), sig[which], n[which], was

            with np.errstate(over="ignore"):
                if trees is not None:
                    everything = np.arange(rows)
                    yield children([go(np.full(rows, root, U64), np.full(rows, -1, np.int64), everything, second) for root in range(trees) for second in (0, 1)])
                    continue
                of = np.repeat(np.arange(rows), pc.list_value_length(batch.column(3)).to_numpy())
                nodes = batch.column(3).flatten()
                node, m = nodes.field("node").to_numpy().view(U64), nodes.field("m").to_numpy()
                for some in np.split(np.arange(len(of)), range(AT_ONCE, len(of), AT_ONCE)):
                    more = some[(mix(node[some] ^ U64(0xA5A5A5A5)) >> U64(11)).astype(np.float64) / (1 << 53) < two]
                    yield children([go(node[some], m[some], of[some], 0), go(node[more], m[more], of[more], 1)])

    return run


def children(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["node", "sig", "n", "was"])


def pairs_of_small(percent: int):
    """Pairs of classes of like lengths that share a node, from rows (node, n, sig) sorted by them."""

    def found(node, n, sig):
        out = []
        for d in range(1, len(node)):
            i = np.flatnonzero(node[d:] == node[:-d])
            if not len(i):
                break
            fit = i[100 * n[i] >= percent * n[i + d]]
            out.append((np.minimum(sig[fit], sig[fit + d]), np.maximum(sig[fit], sig[fit + d])))
        a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        table = np.unique(np.stack((a, b), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(table[:, 0].copy()), pa.array(table[:, 1].copy())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = tuple(np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            if not batch.num_rows:
                continue
            part = tuple(np.concatenate((a, batch.column(i).to_numpy())) for i, a in enumerate(rest))
            last = int(np.searchsorted(part[0], part[0][-1], side="left"))
            rest = tuple(a[last:] for a in part)
            yield found(*(a[:last] for a in part))
        yield found(*rest)

    return run


def like_sketches(percent: int):
    """Drop pairs whose sketches agree in too few places."""
    p = percent / 100
    least = SKETCH * p - SLACK * math.sqrt(SKETCH * p * (1 - p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u4").reshape(-1, SKETCH) for c in ("x", "y"))
            fit = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(fit) for c in ("a", "b")], names=["a", "b"])

    return run


def candidates(classes: DataFrame, percent: int, trees: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of small nodes, repeated ones too, and members (node, sig) of the nodes of near copies.

    The small nodes of all depths are brought together once, so the plan has one
    shuffle of them however deep the trees are.
    """
    light = classes.select("sig", "n", "sketch")
    entries = light.mapInArrow(branch(percent / 100, 1, trees), "node long, sig long, n long, was long")
    small, near = [], []
    for depth in range(1, DEEPEST + 1):
        sizes = entries.groupBy("node").agg(F.count("*").alias("m")).where("m > 1")
        met = settled(entries.join(sizes, "node"))
        small.append(met.where(F.col("m") <= SMALL).select("node", "n", "sig"))
        large = met.where(F.col("m") > SMALL)
        stays = (F.col("was") > 0) & (F.col("m") >= COHERENT * F.col("was")) if depth < DEEPEST else F.lit(True)
        near.append(large.where(stays).select("node", "sig"))
        on = large.where(~stays)
        if on.isEmpty():
            break
        # a class lists its nodes, so its sketch is joined once a depth however many they are
        below = on.groupBy("sig").agg(F.collect_list(F.struct("node", "m")).alias("nodes")).join(light, "sig").select("sig", "n", "sketch", "nodes")
        # counted and then met, so evaluated once
        entries = settled(below.mapInArrow(branch(percent / 100, depth + 1), "node long, sig long, n long, was long"))
    every, members = small[0], near[0]
    for some, more in zip(small[1:], near[1:]):
        every, members = every.union(some), members.union(more)
    ordered = every.repartition("node").sortWithinPartitions("node", "n", "sig")
    return ordered.mapInArrow(pairs_of_small(percent), "a long, b long"), members


def similar_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, recall: float = RECALL
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    ``docs`` needs an integer id and a text; other columns may have any names
    and are not read. Null and wordless texts have no shingles, link with
    nothing and are kept. Rows without an id are linked like others, but name
    no component; those in a component with an id are not kept. Repeated rows are
    given back as often as they come. An empty table gives an empty result.
    Links are confirmed on whole sets, so none is wrong; a link just at the limit
    is found with the chance ``recall``, a closer one with a higher chance.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    table = settled(base.mapInArrow(summarise(width), "doc_id long, n long, sig long, sketch binary"))
    classes = settled(table.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    pairs, members = candidates(classes, percent, trees_needed(percent, recall))
    members = members.distinct()
    # read for the pairs and for the clusters, so evaluated once
    stars = settled(members.join(members.groupBy("node").agg(F.min("sig").alias("a")), "node").where("sig != a").select("a", F.col("sig").alias("b")).distinct())
    sketches = classes.select("sig", "sketch")
    cold = (
        pairs.union(stars).distinct()
        .join(sketches.select(F.col("sig").alias("a"), F.col("sketch").alias("x")), "a")
        .join(sketches.select(F.col("sig").alias("b"), F.col("sketch").alias("y")), "b")
        .mapInArrow(like_sketches(percent), "a long, b long")
    )
    cold = settled(cold)
    # overlapping nodes of near copies are one cluster
    clusters = components(stars).withColumnRenamed("root", "cluster")

    asked = cold.select(F.col("a").alias("sig")).union(cold.select("b")).union(clusters.select("node")).distinct()
    asked = settled(asked.join(classes.select("sig", "doc_id"), "sig").select("sig", F.col("doc_id").alias("rep")))
    # an id may come with several texts, and a class may have no id; the signature decides
    found = base.join(asked.hint("shuffle_hash"), F.col("doc_id") == F.col("rep")).select("sig", "text").mapInArrow(own_sets(width), "sig long, tokens binary")
    nameless = base.where("doc_id is null").select("text").mapInArrow(signed_sets(width), "sig long, tokens binary")
    sets = settled(found.union(nameless.join(asked.where("rep is null").select("sig"), "sig", "left_semi")).dropDuplicates(["sig"]))
    links = (
        cold.join(sets.select(F.col("sig").alias("a"), F.col("tokens").alias("xs")), "a")
        .join(sets.select(F.col("sig").alias("b"), F.col("tokens").alias("ys")), "b")
        .mapInArrow(verify(percent), "a long, b long")
    )
    links = settled(links)
    roots = components(links)
    more = settled(left_over_links(clusters, roots, sets, percent))
    if not more.isEmpty():
        roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(more))

    named = table.select("doc_id", "n", "sig").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = named.where("n > 0").groupBy(F.col("root").alias("of")).agg(F.min("doc_id").alias("least"))
    out = named.join(least, (F.col("root") == F.col("of")) & (F.col("n") > 0), "left")
    component = F.coalesce("least", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
