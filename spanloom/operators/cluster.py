"""Optimal one-dimensional k-means per group, exact at any group size.

Sorted values are cut at k-1 places, and the best cut maximises the gain
``sum(S_c**2 / W_c)`` over clusters (S sum, W count), a convex function of the
prefix sums at the cuts. That allows exact search over coarse cells: a cut
inside a cell has its prefix point in the triangle spanned by the two cell
edges and the corner where the cell's smallest values would all come first,
so the gain at those three points bounds it. Cells that cannot hold a cut of
the optimum are merged, the others are refined, until every cut is an edge.
Each round is one aggregate over the values; a task sees cells, not values.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.joins import _micros, join_null_safe
from spanloom.operators.ranks import attach
from spanloom.session import cut_lineage

MAX_CELLS = 2048


def _layers(w: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """best[q, j]: largest gain of q+1 clusters over the points up to j, with its last cut."""
    n = len(w)
    best = np.full((k, n), -np.inf)
    cut = np.zeros((k, n), dtype=np.int64)
    best[0, 0] = 0.0
    best[0, 1:] = (s[1:] - s[0]) ** 2 / np.maximum(w[1:] - w[0], 1e-300)
    block = 256
    for q in range(1, k):
        for lo in range(0, n, block):
            j = np.arange(lo, min(lo + block, n))
            dw = w[j, None] - w[None, : j[-1] + 1]
            ds = s[j, None] - s[None, : j[-1] + 1]
            gain = np.where(dw > 0, ds * ds / np.where(dw > 0, dw, 1.0), 0.0)
            total = best[q - 1, None, : j[-1] + 1] + gain
            total[np.arange(j[-1] + 1)[None, :] > j[:, None]] = -np.inf
            cut[q, j] = total.argmax(axis=1)
            best[q, j] = total[np.arange(len(j)), cut[q, j]]
    return best, cut


def _optimal_cuts(w: np.ndarray, s: np.ndarray, k: int) -> tuple[float, list[int]]:
    """Gain and cut positions over cell edges; ``w``, ``s`` are prefix sums."""
    best, cut = _layers(w, s, k)
    j, cuts = len(w) - 1, []
    for q in range(k - 1, 0, -1):
        j = int(cut[q, j])
        cuts.append(j)
    return float(best[k - 1, -1]), cuts[::-1]


def _prefix(cells: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    w = np.concatenate([[0.0], np.cumsum(cells["n"].to_numpy(float))])
    s = np.concatenate([[0.0], np.cumsum(cells["s"].to_numpy(float))])
    return w, s


def _through(w: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Largest gain of any solution that has a cut at each point."""
    ahead, _ = _layers(w, s, k)
    back, _ = _layers(w[-1] - w[::-1], s[-1] - s[::-1], k)
    back = back[:, ::-1]
    return np.max([ahead[q] + back[k - 2 - q] for q in range(k - 1)], axis=0)


def _refine(cells: pd.DataFrame, k: int, budget: int) -> tuple[list[float], list[tuple], bool]:
    """Cuts so far, intervals of the next round, and whether the cuts are optimal."""
    lo, hi = cells["lo"].to_numpy(float), cells["hi"].to_numpy(float)
    w, s = _prefix(cells)
    kk = min(k, len(cells))
    gain, cuts = _optimal_cuts(w, s, kk)
    breaks = [float(hi[c - 1]) for c in cuts]
    if k < 2:
        return breaks, [], True
    n, total = np.diff(w), np.diff(s)
    # A cell proven to hold no cut stays whole; only its edges remain candidates.
    wide = (hi > lo) & ~cells["frozen"].to_numpy(bool)
    first = np.where(wide, (n * hi - total) / np.where(wide, hi - lo, 1.0), 0.0)
    corner_w, corner_s = w[:-1] + first, s[:-1] + first * lo
    pw, ps = np.empty(2 * len(n) + 1), np.empty(2 * len(n) + 1)
    pw[0::2], ps[0::2], pw[1::2], ps[1::2] = w, s, corner_w, corner_s
    bound = _through(pw, ps, k)
    slack = gain - 1e-11 * max(abs(gain), 1e-300)
    active = (bound[1::2] >= slack) & wide
    if not wide.any() or (kk == k and not active.any()):
        return breaks, [], True
    if kk < k:
        active = wide
    edge = bound[0::2] >= slack
    chosen = np.zeros(len(n) + 1, dtype=bool)
    chosen[cuts] = edge[cuts] = True

    spans: list[list] = []  # [low, high, active, number of cells]
    for i in range(len(n)):
        if spans and spans[-1][2] == bool(active[i]) and not (chosen[i] if active[i] else edge[i]):
            spans[-1][1], spans[-1][3] = hi[i], spans[-1][3] + 1
        else:
            spans.append([lo[i], hi[i], bool(active[i]), 1])
    while len(spans) > 129:  # merge the closest neighbours; still exact, only coarser
        gaps = [b[0] - a[1] for a, b in zip(spans, spans[1:])]
        i = int(np.argmin(gaps))
        a, b = spans[i], spans.pop(i + 1)
        spans[i] = [a[0], b[1], True, a[3] + b[3]]
    n_active = sum(p[3] for p in spans if p[2])
    # At least four times as fine as before, so every round makes progress.
    pieces = [max(4 * p[3], budget * p[3] // n_active) if p[2] else 1 for p in spans]
    return breaks, [(float(p[0]), float(p[1]), int(c)) for p, c in zip(spans, pieces)], False


def _value(df: DataFrame, col: str) -> Column:
    kind = df.schema[col].dataType.typeName()
    return (_micros(df, col) if kind.startswith("timestamp") else F.col(col)).cast("double")


def kmeans_1d(
    df: DataFrame, by: Sequence[str], col: str, k: int, out: str = "cluster", max_cells: int = MAX_CELLS
) -> DataFrame:
    """Add the optimal cluster number, 1..k ascending in value; null for null.

    A group with fewer than ``k`` distinct values gets one cluster per value.
    """
    keys = [*by, "__g"]
    base = df.withColumns({"__v": _value(df, col), "__g": F.lit(0)})
    values = base.where(F.col("__v").isNotNull()).groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    breaks = _breaks(values, keys, k, max_cells)
    joined = join_null_safe(base, breaks, keys)
    number = F.size(F.filter("__breaks", lambda b: b < F.col("__v"))) + 1
    return joined.withColumn(out, F.when(F.col("__v").isNotNull(), number)).select(*df.columns, out)


def _key_fields(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)


def _breaks(values: DataFrame, keys: list[str], k: int, max_cells: int) -> DataFrame:
    """``keys, __breaks``: upper end of every cluster but the last."""
    centre = F.sum(F.col("__v") * F.col("__n")) / F.sum("__n")
    fields = _key_fields(values, keys)
    most = values.groupBy(*keys).count().agg(F.max("count")).first()[0]

    def direct(key, cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("lo", ignore_index=True)
        w, s = _prefix(cells)
        _, cuts = _optimal_cuts(w, s, min(k, len(cells)))
        ends = cells["lo"].to_numpy()
        return pd.DataFrame([[*key, [float(ends[c - 1]) for c in cuts]]], columns=[*keys, "__breaks"])

    centred = attach(values, keys, __centre=centre)
    offset = (F.col("__v") - F.col("__centre")) * F.col("__n")
    if most is None or most <= max_cells:
        cells = centred.select(*keys, F.col("__v").alias("lo"), F.col("__n").alias("n"), offset.alias("s"))
        return cells.groupBy(*keys).applyInPandas(direct, f"{fields}, __breaks array<double>")

    span = "array<struct<lo: double, hi: double, pieces: int>>"

    def search(key, cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("lo", ignore_index=True)
        shift = float(cells["centre"].iloc[0])
        local = cells.assign(lo=cells["lo"] - shift, hi=cells["hi"] - shift)
        ends, spans, done = _refine(local, k, max_cells // 2)
        # Cells carry true ends; map the shifted ones back to them.
        true_lo = dict(zip(local["lo"], cells["lo"])), dict(zip(local["hi"], cells["hi"]))
        rows = [(true_lo[0][a], true_lo[1][b], c) for a, b, c in spans]
        row = [*key, [true_lo[1][e] for e in ends], rows, done]
        return pd.DataFrame([row], columns=[*keys, "__breaks", "__spans", "__done"])

    # The centred values are read once per round; they may be recomputed, never lost.
    centred = centred.persist()
    start = F.array(F.struct(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.lit(max_cells // 2).alias("pieces")))
    state = centred.groupBy(*keys).agg(start.alias("__spans"))
    finished = None
    while True:
        placed = join_null_safe(centred, state.select(*keys, "__spans"), keys, "inner")
        here = F.element_at(F.filter("__spans", lambda p: p.lo <= F.col("__v")), -1)
        placed = placed.withColumn("__p", here)
        width = F.col("__p.hi") - F.col("__p.lo")
        part = F.floor((F.col("__v") - F.col("__p.lo")) / width * F.col("__p.pieces"))
        piece = F.when(width > 0, F.least(part, F.col("__p.pieces") - 1)).otherwise(F.lit(0))
        cells = placed.groupBy(*keys, F.col("__p.lo").alias("__at"), piece.alias("__piece")).agg(
            F.min("__v").alias("lo"),
            F.max("__v").alias("hi"),
            F.sum("__n").alias("n"),
            F.sum(offset).alias("s"),
            F.max("__centre").alias("centre"),
            (F.max("__p.pieces") == 1).alias("frozen"),
        )
        found = cells.groupBy(*keys).applyInPandas(search, f"{fields}, __breaks array<double>, __spans {span}, __done boolean")
        state = cut_lineage(found)
        solved = state.where("__done").select(*keys, "__breaks")
        finished = solved if finished is None else finished.unionByName(solved)
        state = state.where("not __done")
        if state.limit(1).count() == 0:
            centred.unpersist()
            return finished
