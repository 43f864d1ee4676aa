"""Grouped summaries. All are plain aggregates, combined map-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.joins import join_null_safe
from spanloom.operators.ranks import attach, exact_quantiles


def strict(aggregate: Column, col: str) -> Column:
    """Null as soon as one input is missing, instead of skipping it."""
    return F.when(F.count(F.lit(1)) == F.count(col), aggregate)


def aggregate_of(fn: str, col: str, na: str = "skip") -> Column:
    if fn == "n":
        return F.count(F.lit(1))  # rows, missing values included
    known = {"mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}
    value = known[fn](col)
    return strict(value, col) if na == "strict" else value


def summarise(
    df: DataFrame,
    by: Sequence[str],
    cols: Sequence[str],
    fns: Sequence[str] = ("mean", "sd", "n"),
    na: str = "skip",
) -> DataFrame:
    """Several functions of several columns, named ``{col}_{fn}``.

    ``n`` counts rows, also those whose value is missing; the other functions
    skip missing values, or turn null because of them with ``na="strict"``.
    """
    return df.groupBy(*by).agg(*[aggregate_of(f, c, na).alias(f"{c}_{f}") for c in cols for f in fns])


def rollup_max_mean(df: DataFrame, by: Sequence[str], ts: str, col: str, out: str | None = None) -> DataFrame:
    """Mean over days of the daily maximum, per group."""
    daily = df.groupBy(*by, F.to_date(ts).alias("__day")).agg(F.max(col).alias("__max"))
    return daily.groupBy(*by).agg(F.avg("__max").alias(out or col))


def weighted_summary(df: DataFrame, by: Sequence[str], col: str, weight: str) -> DataFrame:
    """Mean, sd and n as if each row were repeated ``weight`` times.

    Weighted sums give this without replicating rows. Deviations are taken
    from the group mean, so large values do not cancel.
    """
    x, w = F.col(col), F.col(weight).cast("double")
    bad = F.count(F.when((w <= 0) | (w != F.floor(w)), F.lit(1)))
    total = F.when(bad > 0, F.raise_error(F.lit("weights must be whole and positive"))).otherwise(F.sum(w))
    used = df.where(x.isNotNull())
    centred = attach(used, by, __mean=F.sum(w * x) / F.sum(w))
    spread = F.sum(w * F.pow(x - F.col("__mean"), 2))
    return centred.groupBy(*by).agg(
        F.max("__mean").alias(f"{col}_mean"),
        F.when(F.sum(w) > 1, F.sqrt(spread / (F.sum(w) - 1))).alias(f"{col}_sd"),
        total.cast("long").alias(f"{col}_n"),
    )


def mean_of_means(df: DataFrame, inner: Sequence[str], outer: Sequence[str], col: str) -> DataFrame:
    """Mean and sd over groups of the group means."""
    means = df.groupBy(*inner).agg(F.avg(col).alias("__m"))
    return means.groupBy(*outer).agg(
        F.avg("__m").alias(f"{col}_mean"), F.stddev_samp("__m").alias(f"{col}_sd"), F.count(F.lit(1)).alias("n_groups")
    )


def mean_time(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean of timestamps per group, to the microsecond."""
    out = []
    for col in cols:
        kind = df.schema[col].dataType.simpleString()
        micros = F.unix_micros(F.col(col).cast("timestamp"))
        total, n = F.sum(micros.cast("decimal(20,0)")), F.count(col).cast("decimal(20,0)")
        whole = (total - F.pmod(total, n)) / n
        out.append(F.timestamp_micros(whole.cast("long")).cast(kind).alias(col))
    return df.groupBy(*by).agg(*out)


def groups_with_all(df: DataFrame, by: Sequence[str], col: str, levels: Sequence) -> DataFrame:
    """Groups in which every listed level occurs."""
    seen = [F.bool_or(F.col(col) == F.lit(v)) for v in levels]
    flags = df.groupBy(*by).agg(*[s.alias(f"__{i}") for i, s in enumerate(seen)])
    for i in range(len(levels)):
        flags = flags.where(F.coalesce(F.col(f"__{i}"), F.lit(False)))
    return flags.select(*by)


def drop_groups_where_all(df: DataFrame, by: Sequence[str], condition: Column) -> DataFrame:
    """Drop the groups in which the condition holds for every row."""
    full = df.groupBy(*by).agg(F.bool_and(F.coalesce(condition, F.lit(False))).alias("__all"))
    return join_null_safe(df, full.where("__all").select(*by), list(by), "left_anti")


def box_stats(df: DataFrame, by: Sequence[str], col: str, **kw) -> DataFrame:
    """Box-plot statistics per group.

    Quartiles interpolate linearly; whiskers end at the last value within 1.5
    times the quartile range; everything beyond counts as an outlier.
    """
    quartiles = exact_quantiles(df, by, col, {"q1": 0.25, "median": 0.5, "q3": 0.75}, **kw)
    joined = join_null_safe(df.where(F.col(col).isNotNull()), quartiles, list(by))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(col).between(F.col("q1") - reach, F.col("q3") + reach)
    return joined.groupBy(*by).agg(
        *[F.max(q).alias(q) for q in ("q1", "median", "q3")],
        F.min(F.when(inside, F.col(col))).alias("whisker_low"),
        F.max(F.when(inside, F.col(col))).alias("whisker_high"),
        F.count(F.when(~inside, F.lit(1))).alias("n_outliers"),
    )


def range_label(df: DataFrame, by: Sequence[str], col: str, out: str = "label") -> DataFrame:
    """``low-high`` of a group, or the value alone when there is only one."""
    low, high = F.min(col).cast("string"), F.max(col).cast("string")
    text = F.when(F.min(col) == F.max(col), low).otherwise(F.concat(low, F.lit("-"), high))
    return df.groupBy(*by).agg(text.alias(out))


def split_moments(df: DataFrame, by: Sequence[str], side: str, levels: Sequence[str], value: str) -> DataFrame:
    """Count, mean and variance of a value on each of two sides, per group."""
    cols = []
    for tag, level in zip(("a", "b"), levels):
        here = F.when(F.col(side) == level, F.col(value))
        cols += [
            F.count(here).alias(f"n_{tag}"),
            F.avg(here).alias(f"mean_{tag}"),
            F.var_samp(here).alias(f"var_{tag}"),
        ]
    return df.groupBy(*by).agg(*cols)
