"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Targets: each source gets its weight's share of all words, at most ``MOST``
times its own size, the excess shared again by weight; found in closed form
from running sums over the sources in order of size by weight. Copies: a
source is read in the order of a hash of the id, again from the start when it
is used up, until its target is reached. Positions: a source's weight schedule
over training time is integrated; a copy stands where the source's cumulative
demand meets the words read before it, and documents or copies are range-sorted
by that place.

Running sums go by prefix of the hash: sums by prefix are combined before the
shuffle and then added up, so a source with most rows is spread like any other.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
#: By weight class (place of the source in the cycle 1, 2, 3): (time, weight) points of a piecewise linear schedule.
SCHEDULES = {1: ((0.0, 2.0), (1.0, 1.0)), 2: ((0.0, 1.0), (0.5, 2.0), (1.0, 1.0)), 3: ((0.0, 1.0), (1.0, 3.0))}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def demand_inverse(share: Column, points: tuple) -> Column:
    """Time at which the integral of a piecewise linear schedule reaches ``share`` of its whole."""
    steps = [(t0, t1, w0, w1, (w0 + w1) / 2 * (t1 - t0)) for (t0, w0), (t1, w1) in zip(points, points[1:])]
    whole, done = sum(s[4] for s in steps), 0.0
    pieces = []
    for t0, t1, w0, w1, area in steps:
        x = share * F.lit(whole) - F.lit(done)
        slope = (w1 - w0) / (t1 - t0)
        pieces.append((done + area, F.lit(t0) + F.lit(2.0) * x / (F.lit(w0) + F.sqrt(F.lit(w0 * w0) + F.lit(2.0) * x * F.lit(slope)))))
        done += area
    out = pieces[-1][1]
    for upto, value in reversed(pieces[:-1]):
        out = F.when(share * F.lit(whole) <= F.lit(upto), value).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: tuple = (1, 2, 3), most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row per source.

    Weights repeat along the sources in order of code points, null last.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.select("source", "source_size", cycle.alias("weight"))
    tight = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    part = weighed.select(
        "*",
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
        F.sum("source_size").over(everything).alias("all_size"),
        F.sum("weight").over(everything).alias("all_weight"),
    )
    # the share of one unit of weight when all tighter sources are at their limit
    unit = (F.col("all_size") - most * F.col("size_before")).cast("double") / (F.col("all_weight") - F.col("weight_before")).cast("double")
    part = part.select("*", unit.alias("unit"), (F.col("weight") * unit > (most * F.col("source_size")).cast("double")).alias("full"))
    level = F.min(F.when(~F.col("full"), F.struct("weight_before", "unit"))).over(everything)
    return part.select(
        "source", "source_size", "weight",
        F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(F.coalesce(F.col("weight") * level["unit"], F.lit(0.0))).alias("target"),
    )


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """What ``placed_copies`` gives, range-sorted by the position of the first copy; rows that are not taken come last."""
    found = placed_copies(docs, doc_id, text, source, **options)
    names = docs.columns
    flat = found.toDF(*[f"c{i}" for i in range(len(names))], *found.columns[len(names) :])
    at, tie = F.get("__places", F.lit(0)).asc_nulls_last(), F.col(f"c{names.index(doc_id)}")
    return flat.repartitionByRange(at, F.xxhash64(tie)).sortWithinPartitions(at, F.xxhash64(tie), tie).toDF(*found.columns)


def placed_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = (1, 2, 3), most: int = MOST, schedules: dict | None = None) -> DataFrame:
    """All rows with ``__size``, ``__source_size``, ``__target``, ``__copies`` and ``__places``.

    ``__places`` holds the training position (0 to 1) of each copy. A null text
    has size 0. Null sources are a source of their own, null ids come last in
    hash order, equal rows follow each other. Columns that ``docs`` already has
    keep their names; an empty table gives an empty result.
    """
    schedules = schedules or SCHEDULES
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: F.col(f"c{names.index(n)}") for n in (doc_id, text, source)}
    rows = rows.select(
        "*", at[source].cast("string").alias("source"), word_count(at[text]).alias("size"),
        F.md5(at[doc_id].cast("string").cast("binary")).alias("hash"), at[doc_id].alias("id"),
    ).withColumn("prefix", F.coalesce(F.substring("hash", 1, 4), F.lit("~")))
    cells = rows.groupBy("source", "prefix").agg(F.sum("size").alias("cell"))
    before = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select("source", "prefix", F.coalesce(F.sum("cell").over(before), F.lit(0)).alias("base"))
    targets = source_targets(cells.groupBy("source").agg(F.sum("cell").alias("source_size")), weights, most)
    targets = bases.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        F.col("b.source").alias("of"), F.col("prefix").alias("part"), "base", "source_size", "weight", "target"
    )
    inside = Window.partitionBy("source", "prefix").orderBy(F.col("hash").asc_nulls_last(), F.col("id"), F.col("size"), *[F.xxhash64(f"c{i}") for i in [names.index(text)]])
    placed = rows.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    joined = placed.join(targets, F.col("source").eqNullSafe(F.col("of")) & (F.col("prefix") == F.col("part")))
    starts = [(F.lit(p) * F.col("source_size") + F.col("base") + F.col("inside")) for p in range(most)]
    middle = [s.cast("double") + F.col("size").cast("double") / 2 for s in starts]
    copies = sum(((m <= F.col("target")).cast("int") for m in middle[1:]), (middle[0] <= F.col("target")).cast("int"))

    def place(share: Column) -> Column:
        known = [F.when(F.col("weight") == w, demand_inverse(share, schedules[i + 1])) for i, w in enumerate(weights)]
        return F.coalesce(*known)

    # a source without words has no demand; its rows stand at the start
    shares = [F.when(F.col("target") > 0, m / F.col("target")).otherwise(F.lit(0.0)) for m in middle]
    places = F.slice(F.array(*[place(s) for s in shares]), F.lit(1), copies)
    return joined.select(
        *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)],
        F.col("size").alias("__size"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
        copies.alias("__copies"), places.alias("__places"),
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed table: a row of ``docs`` as often as it is taken, in order of training position."""
    names = docs.columns
    found = placed_copies(docs, doc_id, text, source, **options)
    spread = found.toDF(*[f"c{i}" for i in range(len(names))], "size", "source_size", "target", "copies", "places")
    spread = spread.select(*[f"c{i}" for i in range(len(names))], F.explode("places").alias("place"))
    ordered = spread.repartitionByRange(F.col("place"), F.xxhash64(f"c{names.index(doc_id)}")).sortWithinPartitions("place", f"c{names.index(doc_id)}")
    return ordered.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
