"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A prefix of turns is known by sums of position-dependent hashes of its turns,
four lanes of 32 bits, so all prefixes of a conversation are running sums and a
long conversation is cut into segments. Conversations that share a prefix make
one node, named by its smallest member and its depth.

Totals over subtrees come from rounds of joins. In each round every leaf is
raked: its total is final and goes to its parent. At the same time unary chains
are compressed: a node with one child is cut out if its coin shows heads and its
parent's tails, so that no two neighbours go at once; its value goes to its parent
and its child moves up. The coin is a bit of the depth, so a chain halves each
round; when the bits are used up it is a hash. Contracted nodes
point to the child that outlived them; following these pointers, doubled each
step, re-expands them: their total is what was cut out on the way plus the raked
total at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.ranks import row_numbers
from spanloom.session import cut_lineage

WORDS = r"[^\x20\x09-\x0D]+"
#: Turns of a conversation that one task sums up.
SEGMENT = 4096
LANES = 4
#: Conversations that share a base, and the most turns taken from it.
SHARED, MOST_TURNS = 20, 4
KEY = ["conv_id", "depth"]


def numbered_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 1), digest and words of every turn.

    Turns are taken by number, nulls first; equal numbers by role and digest of
    the text. A null role or text is empty. Rows without conv_id are left out.
    """
    role_of, text_of = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    words = F.regexp_count(text_of, F.lit(WORDS)).cast("long")
    # the length of the role keeps role and text apart
    digest = F.md5(F.concat_ws(":", F.length(role_of), role_of, text_of).cast("binary"))
    light = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), role_of.alias("role"), digest.alias("digest"), words.alias("words")
    )
    return row_numbers(light, ["conv_id"], ["turn", "role", "digest"], "pos").select("conv_id", "pos", "digest", "words")


def borrowed_starts(turns: DataFrame) -> DataFrame:
    """Conversations rebuilt with a shared start: the first h turns of c - c % 20, then their own after the first h."""
    turns = cut_lineage(turns)
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("size"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_TURNS
    wanted = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base"), taken.alias("taken"))
    bases = turns.where((F.col("conv_id") % SHARED == 0) & (F.col("pos") < MOST_TURNS)).withColumnRenamed("conv_id", "base")
    first = wanted.join(bases, "base").where("pos <= taken").select("conv_id", "pos", "digest", "words")
    base_sizes = sizes.where(F.col("conv_id") % SHARED == 0).select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    shifts = wanted.join(base_sizes, "base", "left").select("conv_id", "taken", F.least("taken", F.coalesce("base_size", F.lit(0))).alias("had"))
    rest = turns.join(shifts, "conv_id").where("pos > taken").select("conv_id", (F.col("pos") - F.col("taken") + F.col("had")).alias("pos"), "digest", "words")
    return first.union(rest)


def running_sums(turns: DataFrame) -> DataFrame:
    """conv_id, depth, words, and for each lane the sums up to this turn (s) and before it (b)."""
    lanes = [f"x{i}" for i in range(LANES)]
    hashed = F.sha2(F.concat_ws(":", "pos", "digest"), 256)
    rows = turns.withColumn("h", hashed).select(
        "conv_id", "pos", "words", F.floor((F.col("pos") - 1) / SEGMENT).alias("seg"),
        *[F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long").alias(x) for i, x in enumerate(lanes)],
    )
    inside = Window.partitionBy("conv_id", "seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "seg").agg(*[F.sum(x).alias(x) for x in lanes])
    offsets = totals.select("conv_id", "seg", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"o{i}") for i, x in enumerate(lanes)])
    local = rows.select("*", *[F.sum(x).over(inside).alias(f"l{i}") for i, x in enumerate(lanes)])
    joined = local.join(offsets, ["conv_id", "seg"])
    return joined.select(
        "conv_id", F.col("pos").alias("depth"), "words",
        *[(F.col(f"l{i}") + F.col(f"o{i}")).alias(f"s{i}") for i in range(LANES)],
        *[(F.col(f"l{i}") + F.col(f"o{i}") - F.col(x)).alias(f"b{i}") for i, x in enumerate(lanes)],
    )


def trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, n_children, words) and the ends of all ``convs`` (conv_id, depth, member)."""
    sums = cut_lineage(running_sums(turns))
    now, above = [f"s{i}" for i in range(LANES)], [f"b{i}" for i in range(LANES)]
    found = sums.groupBy("depth", *now).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), *[F.max(x).alias(x) for x in above]
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = [F.lit(0).cast("long").alias(x) for x in now]
    root = root.select(F.lit(0).cast("long").alias("depth"), *zero, "conv_id", "n_convs", F.lit(0).cast("long").alias("words"), *[F.lit(None).cast("long").alias(x) for x in above])
    nodes = cut_lineage(found.withColumn("depth", F.col("depth").cast("long")).select(*root.columns).union(root))
    parents = nodes.select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), *[F.col(s).alias(b) for s, b in zip(now, above)])
    named = nodes.join(parents, ["depth", *above], "left")
    children = named.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    out = named.join(children, KEY, "left").select(*KEY, "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "words")
    lengths = sums.groupBy("conv_id").agg(F.max(F.struct("depth", *now)).alias("last"))
    start = F.struct(F.lit(0).cast("long").alias("depth"), *zero)
    last = convs.join(lengths, "conv_id", "left").select(F.col("conv_id").alias("member"), F.coalesce("last", start).alias("last"))
    ends = last.select("member", "last.*").join(nodes.select("depth", *now, "conv_id"), ["depth", *now]).select(*KEY, "member")
    return cut_lineage(out), ends


def subtree_totals(nodes: DataFrame, **values: Column) -> DataFrame:
    """``values`` summed over the subtree of every node (conv_id, depth, parent_conv_id, parent_depth, kids)."""
    names = list(values)
    state = cut_lineage(nodes.select(*KEY, "parent_conv_id", "parent_depth", F.col("kids").cast("long").alias("kids"), *[v.cast("long").alias(n) for n, v in values.items()]))
    deepest = state.agg(F.max("depth")).first()[0] or 0
    raked, cut = [], []
    step = 0
    while state.where("parent_conv_id is not null").limit(1).count():

        def coin(conv: str, depth: str) -> Column:
            if 1 << step <= deepest:
                return F.shiftright(depth, step).bitwiseAND(F.lit(1)) == 1
            return F.xxhash64(conv, depth, F.lit(step)).bitwiseAND(F.lit(1)) == 1

        inner = F.col("parent_conv_id").isNotNull()
        goes = inner & (F.col("kids") == 1) & coin("conv_id", "depth") & ~coin("parent_conv_id", "parent_depth")
        marked = state.withColumn("leaf", inner & (F.col("kids") == 0)).withColumn("cut", F.coalesce(goes, F.lit(False)))
        # a node learns whether its parent is cut out; then it moves up and the parent points to it
        above = marked.where("cut").select(
            F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("parent_depth"), F.col("parent_conv_id").alias("up_conv_id"),
            F.col("parent_depth").alias("up_depth"), *[F.col(n).alias(f"up_{n}") for n in names],
        )
        seen = cut_lineage(marked.join(above, ["parent_conv_id", "parent_depth"], "left"))
        cut.append(seen.where("up_depth is not null").select(
            F.col("parent_conv_id").alias("conv_id"), F.col("parent_depth").alias("depth"), F.col("conv_id").alias("to_conv_id"),
            F.col("depth").alias("to_depth"), *[F.col(f"up_{n}").alias(n) for n in names],
        ))
        raked.append(seen.where("leaf").select(*KEY, *names))
        moved = seen.select(
            *KEY, F.coalesce("up_conv_id", "parent_conv_id").alias("parent_conv_id"), F.coalesce("up_depth", "parent_depth").alias("parent_depth"),
            "kids", *names, "leaf", "cut",
        )
        gains = moved.where("leaf or cut").groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("parent_depth").alias("depth")).agg(
            F.sum(F.col("leaf").cast("long")).alias("gone"), *[F.sum(n).alias(f"got_{n}") for n in names]
        )
        left = moved.where("not leaf and not cut").join(gains, KEY, "left")
        state = cut_lineage(left.select(
            *KEY, "parent_conv_id", "parent_depth", (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids"),
            *[(F.col(n) + F.coalesce(f"got_{n}", F.lit(0))).alias(n) for n in names],
        ))
        step += 1
    known = state.select(*KEY, *names)
    for some in raked:
        known = known.union(some)
    if not cut:
        return known
    pointers = cut[0]
    for some in cut[1:]:
        pointers = pointers.union(some)
    pointers = cut_lineage(pointers)
    while True:
        far = pointers.select(
            F.col("conv_id").alias("to_conv_id"), F.col("depth").alias("to_depth"), F.col("to_conv_id").alias("far_conv_id"), F.col("to_depth").alias("far_depth"),
            *[F.col(n).alias(f"far_{n}") for n in names],
        )
        pointers = cut_lineage(pointers.join(far, ["to_conv_id", "to_depth"], "left").select(
            *KEY, F.coalesce("far_conv_id", "to_conv_id").alias("to_conv_id"), F.coalesce("far_depth", "to_depth").alias("to_depth"),
            *[(F.col(n) + F.coalesce(f"far_{n}", F.lit(0))).alias(n) for n in names], F.col("far_depth").isNotNull().alias("jumped"),
        ))
        if not pointers.where("jumped").limit(1).count():
            break
        pointers = pointers.drop("jumped")
    ends = known.select(F.col("conv_id").alias("to_conv_id"), F.col("depth").alias("to_depth"), *[F.col(n).alias(f"end_{n}") for n in names])
    expanded = pointers.join(ends, ["to_conv_id", "to_depth"]).select(*KEY, *[(F.col(n) + F.col(f"end_{n}")).alias(n) for n in names])
    return known.union(expanded)


def hash_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined members of every node, from sorted rows (conv_id, depth, member)."""
    open_key, digest = None, None
    fields = ((0, pa.int64()), (1, pa.int64()), (2, pa.string()))

    def out(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in fields], names=[*KEY, "sha256"])

    for batch in batches:
        done = []
        for conv, depth, member in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (conv, depth) != open_key:
                if digest is not None:
                    done.append((*open_key, digest.hexdigest()))
                open_key, digest = (conv, depth), hashlib.sha256(str(member).encode())
            else:
                digest.update(f",{member}".encode())
        yield out(done)
    if digest is not None:
        yield out([(*open_key, digest.hexdigest())])


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, pos from 1, digest, words).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. ``convs`` (conv_id) names the
    members, also those without turns; the root is there if any conversation is,
    so empty tables give no rows. Repeated turns are turns of their own.
    """
    nodes, ends = trie(turns, convs)
    tree = nodes.select("*", F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1).alias("parent_depth"), F.col("n_children").alias("kids"))
    totals = subtree_totals(tree, n_leaves=(F.col("n_children") == 0).cast("long"), saved_tokens=(F.col("n_convs") - 1) * F.col("words"))
    # members stream by in order; nothing of a node is gathered
    ordered = ends.repartition(*KEY).sortWithinPartitions(*KEY, "member").select(*KEY, "member")
    digests = ordered.mapInArrow(hash_members, "conv_id long, depth long, sha256 string")
    nothing = hashlib.sha256(b"").hexdigest()
    return nodes.join(totals, KEY).join(digests, KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.lit(nothing)).alias("ends_sha256")
    )
