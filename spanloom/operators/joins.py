"""Joins: null-matching by default, guarded, override, fill-in, interval.

No join forces a broadcast. Spark broadcasts a side only below
``spark.sql.autoBroadcastJoinThreshold``, checked again at run time by AQE,
and AQE splits hot keys of the remaining sort-merge joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Key = str | tuple[str, str]


def _pairs(on: Sequence[Key] | str) -> list[tuple[str, str]]:
    keys = [on] if isinstance(on, str) else list(on)
    return [(k, k) if isinstance(k, str) else k for k in keys]


def join_null_safe(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[Key] | str,
    how: str = "left",
    null_safe: bool = True,
) -> DataFrame:
    """Equi-join in which a missing key matches a missing key.

    ``on`` holds names, or ``(left, right)`` pairs for keys named differently.
    The result keeps the left names; a full join coalesces the two sides.
    ``null_safe=False`` uses plain equality, which keeps the co-location of
    tables bucketed on the key; use it where keys are never null.
    """
    pairs = _pairs(on)
    temp = {r: f"__r_{i}" for i, (_, r) in enumerate(pairs)}
    other = right.withColumnsRenamed(temp)
    terms = [
        left[l].eqNullSafe(other[temp[r]]) if null_safe else left[l] == other[temp[r]]
        for l, r in pairs
    ]
    joined = left.join(other, reduce(Column.__and__, terms), how)
    if how in ("left_semi", "left_anti", "semi", "anti"):
        return joined
    if how in ("full", "outer", "full_outer", "right", "right_outer"):
        merged = {l: F.coalesce(F.col(l), F.col(temp[r])) for l, r in pairs}
        joined = joined.withColumns(merged)
    return joined.drop(*temp.values())


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Null-matching join on every column the two sides share."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("no shared columns")
    return join_null_safe(left, right, shared, how)


def join_all(frames: Sequence[DataFrame], on: Sequence[Key] | str, how: str = "full") -> DataFrame:
    """Fold many frames into one by the same key."""
    return reduce(lambda a, b: join_null_safe(a, b, on, how), frames)


def semi(left: DataFrame, right: DataFrame, on: Sequence[Key] | str) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``."""
    return join_null_safe(left, right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Sequence[Key] | str) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    return join_null_safe(left, right, on, "left_anti")


def replace_rows(df: DataFrame, fixed: DataFrame, on: Sequence[Key] | str) -> DataFrame:
    """Swap rows for their corrected versions, matched by key."""
    return anti(df, fixed, on).unionByName(fixed, allowMissingColumns=True)


def fill_missing_groups(primary: DataFrame, secondary: DataFrame, on: Sequence[Key] | str) -> DataFrame:
    """Union of ``primary`` and those groups of ``secondary`` it lacks."""
    return primary.unionByName(anti(secondary, primary, on), allowMissingColumns=True)


def join_guarded(
    left: DataFrame, right: DataFrame, on: Sequence[Key] | str, how: str = "left"
) -> DataFrame:
    """Join that must not multiply rows of ``left``.

    A join keeps the row count exactly when the right key is unique, so the
    right side is reduced to one row per key and a repeated key raises when
    the result is read. Neither side is counted.
    """
    keys = [r for _, r in _pairs(on)]
    rest = [c for c in right.columns if c not in keys]
    n_copies = F.count(F.lit(1))
    one = right.groupBy(*keys).agg(n_copies.alias("__n"), F.max(F.struct(*rest)).alias("__row"))
    checked = one.select(
        *keys,
        F.when(F.col("__n") > 1, F.raise_error(F.lit("join key is not unique")))
        .otherwise(F.col("__row"))
        .alias("__row"),
    ).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])
    return join_null_safe(left, checked, on, how)


def override(df: DataFrame, table: DataFrame, on: Sequence[Key] | str, col: str, new: str) -> DataFrame:
    """Replace ``col`` by ``table.new`` where the key is listed."""
    keys = [r for _, r in _pairs(on)]
    listed = table.select(*keys, F.col(new).alias("__new"), F.lit(True).alias("__hit"))
    joined = join_null_safe(df, listed, on)
    value = F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(col))
    return joined.withColumn(col, value).select(*df.columns)


def align_to(df: DataFrame, keys: DataFrame, on: str, position: str) -> DataFrame:
    """Rows in the order of a key list; a key without rows gives nulls."""
    return join_null_safe(keys.select(on, position), df, on)


def two_hop_lookup(
    df: DataFrame,
    correction: DataFrame,
    readings: DataFrame,
    first_on: Sequence[Key] | str,
    second_on: Sequence[Key] | str,
) -> DataFrame:
    """Recorded number -> corrected number -> instrument reading."""
    return join_null_safe(join_null_safe(df, correction, first_on), readings, second_on)


def grid(df: DataFrame, **options: Sequence) -> DataFrame:
    """Every combination of option values for each row of ``df``.

    Options are short parameter lists, expanded in place without a join.
    """
    for name, values in options.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def band_filter(
    df: DataFrame, spans: DataFrame, ts: str, start: str, end: str, on: Sequence[str] = ()
) -> DataFrame:
    """Rows within the overall bounds (earliest start, latest end) of ``spans``.

    With ``on`` the bounds hold per group. Without it they form one row, read
    first so that they reach the scan as pushed filters.
    """
    bounds = [F.min(start).alias("__lo"), F.max(end).alias("__hi")]
    if on:
        joined = join_null_safe(df, spans.groupBy(*on).agg(*bounds), list(on), "inner")
        inside = F.col(ts).between(F.col("__lo"), F.col("__hi"))
        return joined.where(inside).drop("__lo", "__hi")
    low, high = spans.agg(*bounds).first()
    dtype = spans.schema[start].dataType
    return df.where(F.col(ts).between(F.lit(low).cast(dtype), F.lit(high).cast(dtype)))


def _micros(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    if kind == "timestamp":
        return F.unix_micros(F.col(name))
    if kind == "timestamp_ntz":
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, F.col(name))
    raise TypeError(f"{name} is not a timestamp")


def interval_join(
    points: DataFrame,
    spans: DataFrame,
    ts: str,
    start: str,
    end: str,
    on: Sequence[str] = (),
) -> DataFrame:
    """Left join of readings to the spans that contain them, both ends included.

    Time is cut into a hierarchy of buckets, the finest as wide as the mean
    span, each next four times wider. A span is filed at the level that fits
    its length, so it covers at most three buckets however long it is, and
    readings are looked up once per level in use. The join is an equi-join on
    ``on``, level and bucket with the exact bounds as residual; a span has one
    level, hence no duplicates. Mean and levels are subqueries of the one plan.
    """
    size = (_micros(spans, end) - _micros(spans, start)).cast("double")
    usable = spans.where(F.col(end) >= F.col(start))
    mean = usable.agg(F.greatest(F.floor(F.avg(size)), F.lit(1)).cast("double").alias("__w")).scalar()
    width = F.coalesce(mean, F.lit(1.0))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size / F.col("__w"), F.lit(1.0))) / 2)).cast("int")
    filed = usable.withColumn("__w", width).withColumn("__level", level)
    levels = filed.agg(F.array_sort(F.collect_set("__level")).alias("__l")).scalar()  # at most ~30 values
    step = F.col("__w") * F.pow(F.lit(4.0), F.col("__level"))
    lo, hi = (F.floor(_micros(spans, c) / step) for c in (start, end))
    pieces = filed.withColumn("__b", F.explode(F.sequence(lo, hi))).drop("__w")
    probes = points.withColumn("__w", width).withColumn("__level", F.explode(levels)).withColumn("__b", F.floor(_micros(points, ts) / step)).drop("__w")
    hits = _bucket_join(probes, pieces, ts, start, end, [*on, "__level"], "inner").drop("__level")
    # Whether a reading has a match depends on its key and time alone.
    misses = anti(points, hits.select(*on, ts).distinct(), [*on, ts])
    return hits.unionByName(misses, allowMissingColumns=True)


def _bucket_join(points, pieces, ts, start, end, on, how):
    keys = [*on, "__b"]
    other = pieces.withColumnsRenamed({k: f"__r{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"__r{k}")) for k in on]
    match += [F.col("__b") == F.col("__r__b"), F.col(ts) >= F.col(start), F.col(ts) <= F.col(end)]
    return points.join(other, reduce(Column.__and__, match), how).drop("__b", *[f"__r{k}" for k in keys])
