"""Best-fit packing by a configuration linear program over the length histogram.

Spark cuts documents into pieces and counts lengths; the histogram has at most
``capacity`` numbers, whatever the corpus. On it the configuration program
(fewest sequences whose patterns cover all pieces) is solved by multiplicative
weights: prices of lengths, a knapsack table over the capacity for the
patterns that pay most, weights lowered where patterns cover. Patterns are
rounded down to whole sequences, the rest goes best-fit into the gaps and into
new sequences. The plan lists, for each length, runs of places; pieces are
numbered within their length in Spark and take the place of their number.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.tokens import cuts, document_ids, encoder
from spanloom.session import cut_lineage

CAPACITY = 1024
ROUNDS = 150
RATE = 0.2
ANCHORS = 1024
PER_BUCKET = 20_000


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each capacity, and the length put last to reach it (0: a token stays empty)."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        k = int(np.searchsorted(lengths, c, side="right"))
        best[c] = best[c - 1]
        if k:
            value = best[c - lengths[:k]] + prices[:k]
            j = int(np.argmax(value))
            if value[j] > best[c]:
                best[c], last[c] = value[j], lengths[j]
    return best, last


def trace(last: np.ndarray, capacity: int) -> dict[int, int]:
    found: dict[int, int] = {}
    while capacity > 0:
        if last[capacity]:
            found[int(last[capacity])] = found.get(int(last[capacity]), 0) + 1
            capacity -= int(last[capacity])
        else:
            capacity -= 1
    return found


def fractional(demand: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> dict[tuple, float]:
    """Patterns (sorted (length, times) pairs) and how often each is used, by multiplicative weights."""
    lengths = np.flatnonzero(demand)
    asked = demand[lengths].astype(float)
    weight = asked * lengths
    used: dict[tuple, float] = {}
    covered = np.zeros(len(lengths))
    place = {int(n): i for i, n in enumerate(lengths)}
    for _ in range(rounds):
        best, last = knapsack(lengths, weight / asked, capacity)
        value = weight / asked + best[capacity - lengths]
        anchors = np.argsort(-value, kind="stable")[:ANCHORS]
        share = np.zeros(len(lengths))
        for i in anchors[value[anchors] >= (1 - rate / 4) * value[anchors[0]]]:
            pattern = trace(last, capacity - int(lengths[i]))
            pattern[int(lengths[i])] = pattern.get(int(lengths[i]), 0) + 1
            at, times = [place[n] for n in pattern], np.array(list(pattern.values()), dtype=float)
            amount = float((asked[at] / times).min()) / len(anchors)
            share[at] += amount * times / asked[at]
            key = tuple(sorted(pattern.items()))
            used[key] = used.get(key, 0.0) + amount
        covered += share
        weight = weight * np.exp(-rate * share / max(share.max(), 1e-12))
        weight /= weight.max()
    # scaled so that what is asked for is covered once on the whole
    scale = float((asked * lengths).sum() / (covered * asked * lengths).sum())
    return {key: amount * scale for key, amount in used.items()}


def solve(demand: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    """[(lengths of one sequence, number of such sequences)] for a histogram indexed by length."""
    left = demand.astype(np.int64).copy()
    groups: list[tuple[tuple, int, int]] = []
    if left[capacity]:
        groups.append(((capacity,), 0, int(left[capacity])))
        left[capacity] = 0
    # rounding leaves a bounded rest for each pattern; it is priced anew while there is one
    for rounds in (ROUNDS, ROUNDS // 2, ROUNDS // 4):
        if not left.any():
            break
        used = fractional(left, capacity, rounds)
        for key, amount in sorted(used.items(), key=lambda x: (-x[1], x[0])):
            times = min(math.floor(amount), *(int(left[n]) // k for n, k in key))
            if times > 0:
                for n, k in key:
                    left[n] -= k * times
                inside = tuple(n for n, k in reversed(key) for _ in range(k))
                groups.append((inside, capacity - sum(inside), times))
    return best_fit_decreasing(left, groups, capacity)


def best_fit_decreasing(left: np.ndarray, groups: list[tuple[tuple, int, int]], capacity: int) -> list[tuple[tuple, int]]:
    """Put the rest, longest first, into the tightest gap; equal sequences are handled together."""
    open_: list[list[tuple[tuple, int]]] = [[] for _ in range(capacity + 1)]
    for inside, gap, times in groups:
        open_[gap].append((inside, times))
    for n in np.flatnonzero(left)[::-1].tolist():
        count = int(left[n])
        gap = n
        while count:
            while gap <= capacity and not open_[gap]:
                gap += 1
            if gap > capacity:
                inside, have, gap = (), count, capacity  # new sequences
            else:
                inside, have = open_[gap].pop()
            fit = min(gap // n, count)
            times = min(have, count // fit)
            if have > times:
                if inside:
                    open_[gap].append((inside, have - times))
            open_[gap - fit * n].append((inside + (n,) * fit, times))
            count -= fit * times
            gap = n
    return [(inside, times) for some in open_ for inside, times in some if inside]


def places(plan: list[tuple[tuple, int]]) -> dict[str, np.ndarray]:
    """For each length runs of places: numbers from ``first`` on lie ``times`` a sequence, sequences from ``sequence`` on, from ``offset``."""
    rows, taken, sequence = [], {}, 0
    for inside, times in plan:
        offset = 0
        for n in dict.fromkeys(inside):
            k = inside.count(n)
            rows.append((n, taken.get(n, 0), k, sequence, offset))
            taken[n] = taken.get(n, 0) + k * times
            offset += k * n
        sequence += times
    names = ("length", "first", "times", "sequence", "offset")
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {name: table[:, i] for i, name in enumerate(names)}


def cut_pieces(capacity: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            doc, rows = batch.column(0), []
            for i, text in enumerate(batch.column(1)):
                ids = document_ids(encode, text.as_py())
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    rows.append((i, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            table = np.array(rows, dtype=np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [doc.take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32)), *(pa.array(table[:, c]) for c in (2, 3, 4))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def place_pieces(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        scale = int(table["first"].max(initial=0)) + 1
        order = table["length"] * scale + table["first"]
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            at = np.searchsorted(order, length * scale + np.minimum(number, scale - 1), side="right") - 1
            inside = number - table["first"][at]
            sequence = table["sequence"][at] + inside // table["times"][at]
            offset = table["offset"][at] + inside % table["times"][at] * length
            keep = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of one token. Rows with the same id are
    packed each on their own; a null id stays null. Extra columns are not
    read. An empty table gives an empty result.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = cut_lineage(base.mapInArrow(cut_pieces(capacity, path), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    demand = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        demand[row["length"]] = row["count"]
    shared = docs.sparkSession.sparkContext.broadcast(places(solve(demand, capacity)))
    numbered = number_within(pieces, "length", max(1, math.ceil(int(demand.sum()) / PER_BUCKET)))
    return numbered.mapInArrow(
        place_pieces(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def number_within(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """Add ``number``, from 0 within each value of ``key``; a frequent value is cut into buckets by hash."""
    cut = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(key, "bucket").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sizes = sizes.select(F.col(key).alias("__key"), F.col("bucket").alias("__bucket"), "base")
    inside = Window.partitionBy(key, "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = cut.withColumn("inside", F.row_number().over(inside) - 1)
    joined = numbered.join(sizes, (numbered[key] == sizes["__key"]) & (numbered["bucket"] == sizes["__bucket"]))
    return joined.select(*rows.columns, (F.col("base") + F.col("inside")).cast("long").alias("number"))
