"""N-gram Jaccard join: rare-first prefix filtering, then one exact check per pair.

Documents with equal shingle sets form one class, so copies cost nothing after
the first pass. A class files its rarest shingles (the prefix that any partner
must share) under their hashes; classes that meet under a hash pass length,
positional and suffix filters and are verified once on their whole sets.

Rarity comes from a table of counts by hash slot, whose size is fixed; any
order gives the same links, a good one only fewer candidates. A hash under
which many classes meet (a large group of near copies) is not expanded into
pairs: its classes form a cluster. After the links to the cluster's first
member are known, only members outside its largest component are compared with
the rest, block against block, so rows grow with members times left-over
blocks. No link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.graph import components
from spanloom.llm.texts import U64, mix, shingle_sets
from spanloom.session import settled

WIDTH = 5
PERCENT = 75
SLOTS = 1 << 20
CHUNK = 1 << 12
LEAST_PARTS, MOST_PARTS = 32, 4096
HOT = 48
BLOCK = 512


def signature(found: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(found + U64(0x51_7C_C1_B7)), dtype=U64)
    return int(mix(np.array([total + U64(len(found))], dtype=U64)).view(np.int64)[0])


def slots(found: np.ndarray) -> np.ndarray:
    return (found >> U64(44)).astype(np.int64)


def partition_sizes(found: np.ndarray) -> bytes:
    """Sizes of a set's parts, about four hashes each; the number of parts is a power of two."""
    parts = min(MOST_PARTS, max(LEAST_PARTS, 1 << max(0, (len(found) // 4 - 1).bit_length())))
    sizes = np.bincount((mix(found) & U64(parts - 1)).astype(np.int64), minlength=parts)
    return bytes([parts.bit_length(), 2 if sizes.max() < 1 << 16 else 4]) + sizes.astype("<u2" if sizes.max() < 1 << 16 else "<u4").tobytes()


def read_sizes(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, f"<u{stored[1]}", offset=2).astype(np.int64)


def most_common(x: np.ndarray, y: np.ndarray) -> int:
    """Bound of the overlap of two sets; the finer parts are folded to the coarser ones."""
    while len(x) > len(y):
        x = x[: len(x) // 2] + x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] + y[len(y) // 2 :]
    return int(np.minimum(x, y).sum())


def summarise(width: int):
    """Per document its set's size, signature and partition sizes; per task the slot counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, dtype=np.int64)
        seen: set[int] = set()
        held: list[np.ndarray] = []
        for batch in batches:
            rows = batch.num_rows
            n, sig, parts = np.zeros(rows, np.int64), np.zeros(rows, np.int64), [None] * rows
            for row, found in shingle_sets(batch.column(1), width):
                n[row], sig[row] = len(found), signature(found)
                parts[row] = partition_sizes(found)
                if sig[row] not in seen:
                    seen.add(int(sig[row]))
                    held.append(slots(found))
                    if len(held) >= 1000 or len(found) > SLOTS:
                        counts += np.bincount(np.concatenate(held), minlength=SLOTS)
                        held = []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(sig), pa.array(parts, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                names=["doc_id", "n", "sig", "parts", "chunk", "counts"],
            )
        if held:
            counts += np.bincount(np.concatenate(held), minlength=SLOTS)
        for k in range(0, SLOTS, CHUNK):
            if (some := counts[k : k + CHUNK]).any():
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([k // CHUNK], pa.int32()), pa.array([np.minimum(some, 2**32 - 1).astype("<u4").tobytes()], pa.binary())],
                    names=["doc_id", "n", "sig", "parts", "chunk", "counts"],
                )

    return run


def add_counts(key, table):
    total = np.zeros(CHUNK, dtype=np.int64)
    for some in table.column("counts"):
        total += np.frombuffer(some.as_py(), dtype="<u4")
    total = np.minimum(total, 2**32 - 1).astype("<u4").tobytes()
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total], pa.binary())})


def postings(width: int, percent: int, shared):
    """The prefix of every class: (token, n, sig, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(shared.value, dtype="<u4")
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for _, found in shingle_sets(batch.column(0), width):
                sig, n = signature(found), len(found)
                if sig in seen:
                    continue
                seen.add(sig)
                keep = n - (percent * n + 99) // 100 + 1
                order = np.lexsort((found, counts[slots(found)]))[:keep]
                out.append((found[order].view(np.int64), np.full(keep, n, np.int32), np.full(keep, sig, np.int64), np.arange(keep, dtype=np.int32)))
                size += keep
                if size > 200_000:
                    yield joined(out)
                    out, size = [], 0
            if out:
                yield joined(out)

    return run


def joined(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["token", "n", "sig", "pos"])


def possible(n1, p1, n2, p2, percent: int):
    """Length and positional filter for pairs that share a token at these places."""
    low, high = np.minimum(n1, n2).astype(np.int64), np.maximum(n1, n2).astype(np.int64)
    most = np.minimum(p1, p2) + 1 + np.minimum(n1 - p1, n2 - p2) - 1
    return (100 * low >= percent * high) & ((100 + percent) * most.astype(np.int64) >= percent * (low + high))


def meet(percent: int, hot: int):
    """Candidate pairs from postings sorted by token, n and sig; of a hot token only a star."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = tuple(np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int32))
        hub: tuple[int, int] | None = None  # token being spread over several batches, its first class
        for batch in batches:
            part = tuple(np.concatenate((a, batch.column(i).to_numpy())) for i, a in enumerate(rest))
            last = int(np.searchsorted(part[0], part[0][-1], side="left"))
            done, rest = tuple(a[:last] for a in part), tuple(a[last:] for a in part)
            if hub and len(done[0]) and done[0][0] == hub[0]:
                end = int(np.searchsorted(done[0], hub[0], side="right"))
                yield pairs([(np.full(end, hub[1]), done[2][:end], 1)])
                done = tuple(a[end:] for a in done)
                hub = None
            if hub and rest[0][0] != hub[0]:
                hub = None
            yield pairs(groups(done, percent, hot))
            if hub or len(rest[0]) > 100_000:
                hub = hub or (int(rest[0][0]), int(rest[2][0]))
                yield pairs([(np.full(len(rest[0]), hub[1]), rest[2], 1)])
                rest = tuple(a[-1:] for a in rest)
        if hub:
            yield pairs([(np.full(len(rest[0]), hub[1]), rest[2], 1)])
        else:
            yield pairs(groups(rest, percent, hot))

    return run


def groups(part: tuple, percent: int, hot: int) -> list[tuple]:
    token, n, sig, pos = part
    if len(token) < 2:
        return []
    same = np.concatenate(([False], (token[1:] == token[:-1]) & (sig[1:] == sig[:-1])))
    token, n, sig, pos = token[~same], n[~same], sig[~same], pos[~same]
    begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    size = np.diff(np.concatenate((begin, [len(token)])))
    two = begin[size == 2]
    two = two[possible(n[two], pos[two], n[two + 1], pos[two + 1], percent)]
    out = [(sig[two], sig[two + 1], 0)]
    for k in np.flatnonzero(size > 2):
        s = slice(begin[k], begin[k] + size[k])
        if size[k] >= hot:
            out.append((np.full(size[k], sig[begin[k]]), sig[s], 1))
            continue
        i, j = np.triu_indices(size[k], 1)
        gn, gp, gs = n[s], pos[s], sig[s]
        fit = possible(gn[i], gp[i], gn[j], gp[j], percent)
        out.append((gs[i[fit]], gs[j[fit]], 0))
    return out


def pairs(found: list[tuple]) -> pa.RecordBatch:
    a = np.concatenate([x[0] for x in found] or [np.zeros(0, np.int64)])
    b = np.concatenate([x[1] for x in found] or [np.zeros(0, np.int64)])
    kind = np.concatenate([np.full(len(x[0]), x[2], np.int32) for x in found] or [np.zeros(0, np.int32)])
    table = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b), kind), axis=1), axis=0) if len(a) else np.zeros((0, 3), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1]), pa.array(table[:, 2].astype(np.int32))], names=["a", "b", "hot"])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def suffix_filter(percent: int):
    """Drop pairs whose sets cannot overlap enough, partition by partition of the hash space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("xn").to_pylist(), batch.column("yn").to_pylist(), batch.column("xp"), batch.column("yp"))
            fit = [(100 + percent) * most_common(read_sizes(x.as_py()), read_sizes(y.as_py())) >= percent * (m + n) for m, n, x, y in sizes]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(fit, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return run


def verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = [similar(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64), percent) for x, y in zip(batch.column("xs"), batch.column("ys"))]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(fit, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return run


def verify_blocks(percent: int):
    """Left-over members of a cluster (side 0) against one block of all members (side 1)."""

    def run(key, table):
        side = table.column("side").to_numpy()
        sig, root = table.column("sig").to_numpy(), table.column("root").to_numpy()
        out = np.array(table.column("left_over").to_pylist(), dtype=bool)
        sets = [np.frombuffer(x.as_buffer(), U64) for x in table.column("tokens").combine_chunks()]
        here, there = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = [], []
        if len(here) and len(there):
            sizes = np.array([len(sets[j]) for j in there], dtype=np.int64)
            flat = np.concatenate([sets[j] for j in there])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], np.repeat(np.arange(len(there)), sizes)[order]
            for i in here:
                lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange(int((hi - lo).sum()))
                both = np.bincount(owner[at], minlength=len(there))
                fit = 100 * both >= percent * (len(sets[i]) + sizes - both)
                other = ~out[there] | (sig[there] > sig[i])  # of two left-over members the smaller one asks
                links = there[fit & other & (root[there] != root[i])]
                # one link per component says as much as all of them
                links = links[np.unique(root[links], return_index=True)[1]]
                a += [sig[i]] * len(links)
                b += sig[links].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def token_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, tokens, size = [], [], 0
            for row, found in shingle_sets(batch.column("text"), width):
                sig.append(batch.column("sig")[row].as_py())
                tokens.append(found.tobytes())
                size += len(tokens[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(tokens, pa.binary())], names=["sig", "tokens"])
                    sig, tokens, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(tokens, pa.binary())], names=["sig", "tokens"])

    return run


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    ``docs`` needs an integer id and a text; other columns may have any names
    and are not read. Null and wordless texts have no shingles and link with
    nothing. Rows without an id are linked like others, but name no component.
    Repeated rows are given back as often as they come. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    first = settled(base.mapInArrow(summarise(width), "doc_id long, n long, sig long, parts binary, chunk int, counts binary"))
    table = first.where("chunk is null").select("doc_id", "n", "sig", "parts")
    sums = first.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(add_counts, "chunk int, counts binary")
    counts = np.zeros(SLOTS, dtype="<u4")
    for row in sums.toLocalIterator():  # SLOTS numbers, whatever the input
        counts[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.counts, "<u4")
    shared = spark.sparkContext.broadcast(counts.tobytes())

    filed = base.select("text").mapInArrow(postings(width, percent, shared), "token long, n int, sig long, pos int")
    ordered = filed.repartition("token").sortWithinPartitions("token", "n", "sig")
    found = settled(ordered.mapInArrow(meet(percent, hot), "a long, b long, hot int").where("a != b").distinct())

    classes = table.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("parts").alias("parts"), F.first("n").alias("n"))
    info = classes.select("sig", "parts", "n")
    cold = (
        found.select("a", "b").distinct()
        .join(info.select(F.col("sig").alias("a"), F.col("parts").alias("xp"), F.col("n").alias("xn")), "a")
        .join(info.select(F.col("sig").alias("b"), F.col("parts").alias("yp"), F.col("n").alias("yn")), "b")
        .mapInArrow(suffix_filter(percent), "a long, b long")
    )
    cold = settled(cold)
    stars = found.where("hot = 1").select("a", "b")
    clusters = components(stars).withColumnRenamed("root", "cluster")

    asked = cold.select(F.col("a").alias("sig")).union(cold.select("b")).union(clusters.select("node")).distinct()
    asked = asked.join(classes.select("sig", "doc_id"), "sig").select("sig", F.col("doc_id").alias("rep"))
    texts = base.join(asked.hint("shuffle_hash"), F.col("doc_id") == F.col("rep")).select("sig", "text")
    # an id may come with several texts; only the one of the class counts
    sets = texts.mapInArrow(own_sets(width), "sig long, tokens binary")
    # classes without any id are found by signature
    nameless = base.where("doc_id is null").select("text").mapInArrow(signed_sets(width), "sig long, tokens binary")
    sets = sets.union(nameless.join(asked.where("rep is null").select("sig"), "sig", "left_semi")).dropDuplicates(["sig"])
    sets = settled(sets)
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

    named = table.select("doc_id", "n", "sig").join(roots.withColumnRenamed("node", "sig"), "sig", "left")
    named = named.withColumn("root", F.coalesce("root", "sig"))
    least = named.where("n > 0").groupBy(F.col("root").alias("of")).agg(F.min("doc_id").alias("least"))
    out = named.join(least, (F.col("root") == F.col("of")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def own_sets(width: int):
    inner = token_sets(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in inner(batches):
            fit = [signature(np.frombuffer(x.as_buffer(), U64)) == s.as_py() for x, s in zip(batch.column("tokens"), batch.column("sig"))]
            yield batch.filter(pa.array(fit, pa.bool_()))

    return run


def signed_sets(width: int):
    """Token sets with the signatures they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found in shingle_sets(batch.column("text"), width):
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array([int(signature(found))], pa.int64()), pa.array([found.tobytes()], pa.binary())], names=["sig", "tokens"])

    return run


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles (cluster, token, sig, n) of members (cluster, sig, tokens)."""

    def rows(found):
        cluster, sig, sets = zip(*found)
        n = np.array([len(x) for x in sets], dtype=np.int64)
        table = [np.repeat(np.array(cluster, np.int64), n), np.concatenate(sets).view(np.int64), np.repeat(np.array(sig, np.int64), n), np.repeat(n, n)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in table], names=["cluster", "token", "sig", "n"])

    for batch in batches:
        found, size = [], 0
        for cluster, sig, tokens in zip(*(batch.column(i) for i in range(3))):
            found.append((cluster.as_py(), sig.as_py(), np.frombuffer(tokens.as_buffer(), U64)))
            size += len(found[-1][2])
            if size > 200_000:
                yield rows(found)
                found, size = [], 0
        if found:
            yield rows(found)


def alone(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members (sig) that link with no other of their cluster, as too many of their shingles are in none.

    A partner would have at least ``percent`` of a member's shingles. Only clusters
    that are not yet one component are read, each shingle of theirs once.
    """
    parted = members.groupBy("cluster").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("cluster")
    tokens = members.join(parted, "cluster").select("cluster", "sig").join(sets, "sig").select("cluster", "sig", "tokens").mapInArrow(listed, "cluster long, token long, sig long, n long")
    own = tokens.groupBy("cluster", "token").agg(F.count("*").alias("have"), F.min("sig").alias("sig"), F.min("n").alias("n")).where("have = 1")
    return own.groupBy("sig").agg(F.count("*").alias("own"), F.min("n").alias("n")).where(100 * F.col("own") > (100 - percent) * F.col("n")).select("sig")


def left_over_links(clusters: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components of a cluster, component by component.

    Members whose own shingles rule out any link are left out before the blocks are made.
    """
    members = settled(clusters.join(roots, "node", "left").select(F.col("node").alias("sig"), "cluster", F.coalesce("root", "node").alias("root")))
    members = settled(members.join(alone(members, sets, percent), "sig", "left_anti"))
    sizes = members.groupBy("cluster", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("cluster").agg(
        F.max_by("root", F.struct("size", F.negate("root"))).alias("main"), F.sum("size").alias("all"), (F.sum("size") - F.max("size")).alias("out")
    ).where("out > 0")
    rows = members.join(main, "cluster").select(
        "sig", "cluster", "root", (F.col("root") != F.col("main")).alias("left_over"),
        F.ceil(F.col("out") / BLOCK).cast("int").alias("outs"), F.ceil(F.col("all") / BLOCK).cast("int").alias("alls"),
    )
    at = F.abs(F.xxhash64("sig"))
    asks = rows.where("left_over").select("*", F.lit(0).alias("side"), (at % F.col("outs")).cast("int").alias("ob"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("ab"))
    told = rows.select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("ob"), (at % F.col("alls")).cast("int").alias("ab"))
    both = asks.unionByName(told).join(sets, "sig")
    return both.select("cluster", "ob", "ab", "side", "sig", "root", "left_over", "tokens").groupBy("cluster", "ob", "ab").applyInArrow(verify_blocks(percent), "a long, b long")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without the near copies: of each component the smallest id stays.

    Rows of texts without words stay. Of several rows with one id all stay or
    none does. Rows without an id stay.
    """
    found = jaccard_components(docs, doc_id, text)
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs[doc_id].cast("long") == F.col("__gone"), "left_anti")
