"""Row numbers, ordinals and attached group values that survive hot groups.

A window sorts a whole group in one task. Where a group may be arbitrarily
large, these functions cut it into segments along the order first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.joins import join_null_safe

HOT_ROWS = 2_000_000


def attach(df: DataFrame, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Add group aggregates to every row.

    Aggregates are combined map-side and joined back, so a hot group costs a
    few partial rows instead of one task that holds it whole.
    """
    named = [expr.alias(name) for name, expr in aggs.items()]
    if not by:
        values = df.agg(F.struct(*named).alias("__all")).scalar()
        return df.withColumn("__all", values).select(*df.columns, *[F.col(f"__all.{n}").alias(n) for n in aggs])
    return join_null_safe(df, df.groupBy(*by).agg(*named), list(by))


def row_numbers(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    out: str,
    hot_rows: int = HOT_ROWS,
    segments: int = 256,
) -> DataFrame:
    """1-based position of each row in its group, ascending, nulls first.

    ``order`` should be a total order within a group. One plan serves any
    size: groups are cut at up to ``segments`` of their own order values,
    picked by hash, and a row's number is its number within its segment plus
    the sizes of the segments before it. Any cut gives the same numbers; groups
    of up to ``hot_rows`` rows have no cut and are one segment.
    """
    by = list(by)
    marked = df.withColumn("__o", F.struct(*order))
    hash_of = F.xxhash64("__o")
    if by:
        counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows)
        hot = join_null_safe(marked.select(*by, "__o"), counts, by, "left_semi")
    else:
        hot = marked.select("__o")
    picks = hot.groupBy(*by, F.pmod(hash_of, F.lit(segments)).alias("__s")).agg(
        F.min_by("__o", hash_of).alias("__cut")
    )
    cuts = picks.groupBy(*by).agg(F.array_sort(F.collect_list("__cut")).alias("__cuts"))
    if by:
        tagged = join_null_safe(marked, cuts, by)
    else:
        tagged = marked.withColumn("__cuts", cuts.scalar())  # one row of at most ``segments`` values
    before = F.size(F.filter("__cuts", lambda c: c < F.col("__o")))
    tagged = tagged.withColumn("__seg", F.coalesce(F.when(F.col("__cuts").isNotNull(), before), F.lit(0))).drop("__cuts")

    sizes = tagged.groupBy(*by, "__seg").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*by, *([] if by else [F.lit(1)])).orderBy("__seg").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(*by, "__seg", F.sum("__n").over(earlier).alias("__off"))
    local = F.row_number().over(Window.partitionBy(*by, "__seg").orderBy("__o"))
    numbered = join_null_safe(tagged.withColumn("__rn", local), offsets, [*by, "__seg"])
    number = F.col("__rn") + F.coalesce(F.col("__off"), F.lit(0))
    return numbered.withColumn(out, number.cast("long")).select(*df.columns, out)


def ordinal(df: DataFrame, by: Sequence[str], value: str, out: str, **kw) -> DataFrame:
    """Position of each value among the distinct values of its group: these are numbered and joined back."""
    numbered = row_numbers(df.select(*by, value).distinct(), by, [value], out, **kw)
    return join_null_safe(df, numbered, [*by, value])


def dense_id(df: DataFrame, keys: Sequence[str], out: str, **kw) -> DataFrame:
    """Whole number 1..n for each key combination, in key order."""
    numbered = row_numbers(df.select(*keys).distinct(), [], list(keys), out, **kw)
    return join_null_safe(df, numbered, list(keys))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key under the order; ties broken by the other columns."""
    rest = [c for c in df.columns if c not in keys]
    ranked = [*order, *[c for c in rest if c not in order]]
    first = df.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("__first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"__first.{c}") for c in df.columns])


def occurring_once(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs exactly once."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.max(F.struct(*rest)).alias("__row"))
    kept = one.where(F.col("__n") == 1)
    return kept.select(*[F.col(c) if c in keys else F.col(f"__row.{c}") for c in df.columns])


def keep_extreme(df: DataFrame, by: Sequence[str], value: str, largest: bool = True) -> DataFrame:
    """Rows that hold the largest (smallest) value of their group, ties included."""
    best = F.max(value) if largest else F.min(value)
    top = df.groupBy(*by).agg(best.alias(value)).where(F.col(value).isNotNull())
    return join_null_safe(df, top, [*by, value], "left_semi")


def with_group_count(df: DataFrame, by: Sequence[str], out: str = "n") -> DataFrame:
    return attach(df, by, **{out: F.count(F.lit(1))})


def with_group_max(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    return attach(df, by, **{out: F.max(value)})


def with_delta_min(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Difference from the smallest value of the group."""
    return attach(df, by, __least=F.min(value)).withColumn(out, F.col(value) - F.col("__least")).drop("__least")


def number_duplicates(df: DataFrame, name: str, order: Sequence[str], out: str, **kw) -> DataFrame:
    """Make names unique: the second and later copies get ``.1``, ``.2``, ...

    A suffix that would collide with a name already present is skipped. The
    i-th taken suffix t has t - i free ones below it, so it goes behind that
    many copies, and a copy's suffix is its place among copies and taken ones.
    """
    numbered = row_numbers(df, [name], order, "__rn", **kw)
    copies = numbered.select(*df.columns, (F.col("__rn") - 1).alias("__free"), F.lit(0).alias("__kind"), F.lit(0).cast("long").alias("__taken"))
    base, suffix = (F.regexp_extract(name, r"^(.*)\.([1-9][0-9]*)$", i) for i in (1, 2))
    shaped = df.select(base.alias(name), F.try_to_number(suffix, F.lit("9" * 18)).cast("long").alias("__taken"))
    taken = row_numbers(shaped.where("__taken is not null").distinct(), [name], ["__taken"], "__i", **kw)
    taken = taken.select(name, (F.col("__taken") - F.col("__i")).alias("__free"), F.lit(1).alias("__kind"), "__taken")
    merged = copies.unionByName(taken, allowMissingColumns=True)
    placed = row_numbers(merged, [name], ["__free", "__kind", "__taken"], "__place", **kw).where("__kind = 0")
    unique = F.when(F.col("__free") == 0, F.col(name)).otherwise(F.concat_ws(".", F.col(name), (F.col("__place") - 1).cast("string")))
    return placed.withColumn("__out", unique).select(*df.columns, F.col("__out").alias(out))


def pair_events(
    df: DataFrame, on: Sequence[str], ts: str, status: str, start: str, end: str, tie: Sequence[str] = (),
    carry: Sequence[str] = (), **kw,
) -> DataFrame:
    """One row per consecutive start/end pair of each source.

    Returns ``pair_id, start, end, alternates``; ``alternates`` is false where
    the strict start/end sequence is broken, or the last pair is incomplete.
    Columns in ``carry`` follow as ``start_…`` and ``end_…``, from the pair's own records.
    """
    events = df.where(F.col(status).isin(start, end))
    numbered = row_numbers(events, on, [ts, *tie], "__rn", **kw)
    opens = F.pmod(F.col("__rn"), F.lit(2)) == 1
    right_kind = F.col(status) == F.when(opens, F.lit(start)).otherwise(F.lit(end))
    pair = F.ceil(F.col("__rn") / 2).cast("long").alias("pair_id")
    return numbered.groupBy(*on, pair).agg(
        F.max(F.when(opens, F.col(ts))).alias("start"),
        F.max(F.when(~opens, F.col(ts))).alias("end"),
        ((F.count(F.lit(1)) == 2) & F.bool_and(right_kind)).alias("alternates"),
        *[F.max(F.when(opens, F.col(c))).alias(f"start_{c}") for c in carry],
        *[F.max(F.when(~opens, F.col(c))).alias(f"end_{c}") for c in carry],
    )


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], **kw) -> DataFrame:
    """Linearly interpolated quantiles per group, exact for any group size.

    The two neighbouring order statistics are read by row number, so no
    group's values are held together.
    """
    present = df.select(*by, value).where(F.col(value).isNotNull())
    numbered = row_numbers(present, by, [value], "__rn", **kw)
    numbered = attach(numbered, by, __n=F.count(F.lit(1)))
    exprs = []
    for name, prob in probs.items():
        at = (F.col("__n") - 1) * F.lit(float(prob)) + 1
        low = F.max(F.when(F.col("__rn") == F.floor(at), F.col(value)))
        high = F.max(F.when(F.col("__rn") == F.ceil(at), F.col(value)))
        part = F.max(at - F.floor(at))
        exprs.append((low + (high - low) * part).alias(name))
    return numbered.groupBy(*by).agg(*exprs)
