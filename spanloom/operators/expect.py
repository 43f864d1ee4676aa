"""Data-quality gates.

``report`` evaluates all rules in one scan and at most one shuffle: key counts
of the uniqueness rules and the aggregates of the others are grouping sets of
one aggregate. A report row per rule, or an error in strict mode.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.joins import semi


@dataclass(frozen=True)
class Rule:
    name: str
    column: str
    failed: Column | None = None  # true on rows that break the rule
    unique: tuple[str, ...] = ()
    aggregate: Column | None = None  # number of failures as an aggregate
    empty: int = 0  # failures of a table without rows


class GateError(ValueError):
    """A gate failed in strict mode."""


def not_null(*cols: str) -> list[Rule]:
    return [Rule("not_null", c, F.col(c).isNull()) for c in cols]


def in_set(col: str, values: Sequence, allow_null: bool = True) -> Rule:
    return Rule("in_set", col, ~F.coalesce(F.col(col).isin(*values), F.lit(allow_null)))


def within(col: str, low: float, high: float) -> Rule:
    return Rule("within", col, ~F.coalesce(F.col(col).between(low, high), F.lit(True)))


def holds(name: str, condition: Column) -> Rule:
    """The condition must be true on every row; unknown counts as a failure."""
    return Rule("holds", name, ~F.coalesce(condition, F.lit(False)))


def unique(*cols: str) -> Rule:
    return Rule("unique", ",".join(cols), unique=tuple(cols))


def single_value(col: str) -> Rule:
    same = F.min(col).eqNullSafe(F.max(col)) & ((F.count(col) == F.count(F.lit(1))) | (F.count(col) == 0))
    return Rule("single_value", col, aggregate=F.when(same, 0).otherwise(1))


def row_count(n: int) -> Rule:
    return Rule("row_count", str(n), aggregate=F.abs(F.count(F.lit(1)) - n), empty=abs(n))


def has_type(df: DataFrame, col: str, *kinds: str) -> Rule:
    """Schema check, known before any data is read."""
    failed = 0 if dict(df.dtypes)[col] in kinds else 1
    return Rule("has_type", col, aggregate=F.lit(failed), empty=failed)


def report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rule, column, n_rows, n_failed, passed`` for each rule; one scan whatever their number."""
    scans = {
        f"f{i}": (r.aggregate if r.aggregate is not None else F.count(F.when(r.failed, F.lit(1)))).cast("long")
        for i, r in enumerate(rules)
        if not r.unique
    }
    counts = [F.count(F.lit(1)).alias("n_rows"), *[c.alias(n) for n, c in scans.items()]]
    keys = list(dict.fromkeys(frozenset(r.unique) for r in rules if r.unique))
    if not keys:
        one = df.agg(*counts)
    else:
        # Each set of keys, and the whole table as the set of none, is one grouping set.
        cols = sorted(frozenset().union(*keys))
        sets = [sorted(k) for k in keys] + ([[]] if scans else [])
        masks = [sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in k) for k in sets]
        grouped = df.groupingSets([[F.col(c) for c in k] for k in sets], *cols).agg(F.grouping_id().alias("set"), *counts)
        parts = []
        for i, (key, mask) in enumerate(zip(sets, masks)):
            mine = F.col("set") == mask
            parts.append(F.sum(F.when(mine, F.col("n_rows"))).alias(f"n{i}"))
            if key:
                parts.append(F.sum(F.when(mine & (F.col("n_rows") > 1), F.col("n_rows"))).alias(f"u{i}"))
            else:
                parts += [F.max(F.when(mine, F.col(n))).alias(n) for n in scans]
        one = grouped.agg(*parts).withColumn("n_rows", F.coalesce(*[F.col(f"n{i}") for i in range(len(sets))], F.lit(0)))
    lines = []
    for i, r in enumerate(rules):
        failed = F.col(f"u{keys.index(frozenset(r.unique))}") if r.unique else F.col(f"f{i}")
        failed = F.coalesce(failed, F.when(F.col("n_rows") == 0, F.lit(r.empty)), F.lit(0)).cast("long")
        lines.append(F.struct(F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"), "n_rows", failed.alias("n_failed")))
    return one.select(F.inline(F.array(*lines))).withColumn("passed", F.col("n_failed") == 0)


def failing_rows(df: DataFrame, rule: Rule) -> DataFrame:
    if rule.failed is not None:
        return df.where(rule.failed)
    if rule.unique:
        repeated = df.groupBy(*rule.unique).count().where("count > 1").drop("count")
        return semi(df, repeated, list(rule.unique))
    return df.limit(0)


def expect(df: DataFrame, rules: Sequence[Rule], strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Check ``rules``; strict mode raises with a few offending rows."""
    checked = report(df, rules)
    if strict:
        broken = [r for r in checked.collect() if not r["passed"]]  # one row per rule
        if broken:
            first = next(r for r in rules if (r.name, r.column) == (broken[0]["rule"], broken[0]["column"]))
            sample = [row.asDict() for row in failing_rows(df, first).take(5)]
            names = ", ".join(f"{b['rule']}({b['column']}): {b['n_failed']}" for b in broken)
            raise GateError(f"{names}; e.g. {sample}")
    return df, checked


def verified(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Lazy form: reading a row that breaks the condition raises."""
    ok = F.coalesce(condition, F.lit(False))
    first = df.columns[0]
    return df.withColumn(first, F.when(ok, F.col(first)).otherwise(F.raise_error(F.lit(message))))


def same_order(a: DataFrame, b: DataFrame, position: str, col: str) -> DataFrame:
    """Compare two orderings position by position: ``n_rows, n_failed, passed``."""
    left = a.select(position, F.col(col).alias("__a"), F.lit(1).alias("__in_a"))
    right = b.select(F.col(position).alias("__p"), F.col(col).alias("__b"), F.lit(1).alias("__in_b"))
    both = left.join(right, F.col(position) == F.col("__p"), "full")
    equal = F.col("__in_a").isNotNull() & F.col("__in_b").isNotNull() & F.col("__a").eqNullSafe(F.col("__b"))
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(~equal, F.lit(1))).alias("n_failed")
    ).withColumn("passed", F.col("n_failed") == 0)
