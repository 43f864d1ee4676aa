"""Exact top-k by integer inner product with MaxScore over shards.

Components are terms: the postings of a term are the components of all vectors
of a shard. For a query a term's contribution lies between two bounds that
follow from the largest and smallest component of the shard. Terms are ordered
by the width of that range; those whose ranges together cannot lift a vector
over the k-th best score so far are non-essential. Essential postings are
traversed, then the others are probed in order of width while a vector can
still compete. Shards keep their best k for each query; these are merged.

Queries and vectors meet in cells (a block of queries, a group of vectors) of
bounded size, so no task holds more than one cell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
SCALE = 64
#: Queries and vectors of a cell, vectors traversed at once.
QUERY_BLOCK, GROUP, SHARD = 2048, 32_768, 4096


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null where a component is null or not finite, or the vector is null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def number_kind(queries: np.ndarray, vectors: np.ndarray):
    """The narrowest floating type that holds every sum exactly, or whole numbers."""
    most = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(vectors.astype(np.float64)).max(initial=0)) * max(1, vectors.shape[1])
    return np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the best ``k`` of each query; ties to the smaller vector id; a query's own id takes no part."""
    kind = number_kind(queries, vectors)
    order = np.argsort(ids, kind="stable")
    ids, postings = ids[order], np.ascontiguousarray(vectors[order].T.astype(kind))
    highest = [postings[:, a : a + SHARD].max(axis=1) for a in range(0, len(ids), SHARD)]
    lowest = [postings[:, a : a + SHARD].min(axis=1) for a in range(0, len(ids), SHARD)]
    found: list[tuple] = []
    for query_id, query in zip(query_ids, queries.astype(kind)):
        best, names = np.zeros(0, dtype=kind), np.zeros(0, dtype=np.int64)
        for s, a in enumerate(range(0, len(ids), SHARD)):
            high, low = np.maximum(query * highest[s], query * lowest[s]), np.minimum(query * highest[s], query * lowest[s])
            width = high - low
            terms = np.argsort(-width, kind="stable")
            floor = best.min() if len(best) == k else None
            # what the terms from a place on can still add
            rest = np.concatenate((np.cumsum(high[terms][::-1])[::-1], [0])).astype(kind)
            essential = len(terms)
            if floor is not None:
                spare = np.concatenate((np.cumsum(width[terms][::-1])[::-1], [0]))
                essential = int(np.searchsorted(-(spare + low.sum()), -floor, side="left"))
                if essential == 0:
                    continue
                essential = max(1, min(essential, len(terms)))
            part = terms[:essential]
            shard = postings[:, a : a + SHARD]
            score = query[part] @ shard[part] if essential < len(terms) else query @ shard
            left = np.arange(score.shape[0])
            at = essential
            while floor is not None and len(left):
                # an equal score may still win by its id only against a larger id
                left_now = score + rest[at] >= floor
                left, score = left[left_now], score[left_now]
                if at >= len(terms) or not len(left):
                    break
                more = terms[at : at + 8]
                score = score + query[more] @ shard[np.ix_(more, left)]
                at = min(at + 8, len(terms))
            mine = ids[a : a + SHARD][left]
            other = mine != query_id
            best, names = np.concatenate((best, score[other])), np.concatenate((names, mine[other]))
            if len(best) > k:
                if len(best) > 8 * k:
                    edge = np.partition(best, len(best) - k)[len(best) - k]
                    near = best >= edge
                    best, names = best[near], names[near]
                top = np.lexsort((names, -best))[:k]
                best, names = best[top], names[top]
        found.append((np.full(len(best), query_id, dtype=np.int64), names, best.astype(np.int64)))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))


def search_cell(k: int):
    def run(key, queries, vectors):
        out = [[], [], []]
        if queries.num_rows and vectors.num_rows:
            q, v = matrix(queries.column("v")), matrix(vectors.column("v"))
            out = search(queries.column("id").to_numpy(), q, vectors.column("id").to_numpy(), v, k)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    return run


def top_k(
    vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE,
    query_block: int = QUERY_BLOCK, group: int = GROUP,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its ``k`` best rows, or all if fewer.

    Rows without an id, a vector or a finite component take no part, nor do
    empty vectors; only vectors of equal length are compared. A query's own id
    is left out. A query id that comes twice is answered once, for its
    smallest vector; of a vector id that comes twice the best row counts.
    Other columns are not read. Empty tables give an empty result.
    """

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(vec_id).cast("long").alias("id"), whole(F.col(vector), scale).alias("v"))
        return rows.where(F.col("id").isNotNull() & (F.size("v") > 0)).withColumn("dims", F.size("v"))

    asked = clean(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v"))
    there = clean(vectors)
    lanes = max(1, math.ceil(queries.count() / query_block))
    groups = max(1, math.ceil(vectors.count() / group))
    left = asked.withColumn("lane", F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = there.withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    keys = ("dims", "lane", "lot")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search_cell(k), "query_id long, vec_id long, score long")
    met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
