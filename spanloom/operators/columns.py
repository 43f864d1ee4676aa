"""Column-level operators: select, rename, tag, fill, drop."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.ranks import row_numbers


def names_matching(df: DataFrame, pattern: str) -> list[str]:
    """Column names in which the pattern is found, ignoring case."""
    return [c for c in df.columns if re.search(pattern, c, re.IGNORECASE)]


def names_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Column names from ``first`` to ``last`` in table order."""
    cols = df.columns
    return cols[cols.index(first) : cols.index(last) + 1]


def clean_names(df: DataFrame) -> DataFrame:
    """snake_case names; a repeated name gets ``_2``, ``_3``, ..."""
    seen: dict[str, int] = {}
    out = []
    for name in df.columns:
        spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.replace("%", "_percent_").replace("#", "_number_"))
        slug = re.sub(r"[^0-9a-zA-Z]+", "_", spaced).strip("_").lower() or "x"
        slug = f"x{slug}" if slug[0].isdigit() else slug
        seen[slug] = seen.get(slug, 0) + 1
        out.append(slug if seen[slug] == 1 else f"{slug}_{seen[slug]}")
    return df.toDF(*out)


def rename_by_rules(df: DataFrame, rules: Sequence[tuple[Sequence[str], str]]) -> DataFrame:
    """Give heterogeneous headers one schema.

    Each rule is ``(patterns, new_name)`` and renames the column that matches
    all its patterns. A rule matching several columns is an error; a rule
    matching none is skipped.
    """
    renames: dict[str, str] = {}
    for patterns, new in rules:
        free = [c for c in df.columns if c not in renames]
        hits = [c for c in free if all(re.search(p, c, re.IGNORECASE) for p in patterns)]
        if len(hits) > 1:
            raise ValueError(f"rule for {new} matches several columns: {hits}")
        if hits:
            renames[hits[0]] = new
    return df.withColumnsRenamed(renames)


def rename_with(df: DataFrame, fn: Callable[[str], str], cols: Sequence[str] | None = None) -> DataFrame:
    return df.withColumnsRenamed({c: fn(c) for c in (cols if cols is not None else df.columns)})


def mutate_across(df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def columns_of_type(df: DataFrame, *kinds: str) -> list[str]:
    return [name for name, kind in df.dtypes if kind in kinds]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns that hold only nulls; one aggregate pass over the data."""
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first().asDict()
    return df.drop(*[c for c, n in filled.items() if n == 0])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna(how="all")


def drop_incomplete_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=list(cols) if cols else None)


def rule_value(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """First matching rule wins; a condition that is null does not match."""
    value = F
    for condition, result in rules:
        result = result if isinstance(result, Column) else F.lit(result)
        value = value.when(condition, result)
    return value.otherwise(default if isinstance(default, Column) else F.lit(default))


def tag_rules(df: DataFrame, out: str, rules: Sequence[tuple[Column, object]], default: object = None) -> DataFrame:
    return df.withColumn(out, rule_value(rules, default))


def exclude(df: DataFrame, *conditions: Column) -> DataFrame:
    """Drop rows that meet any condition; an unknown condition keeps the row."""
    for condition in conditions:
        df = df.where(~F.coalesce(condition, F.lit(False)))
    return df


def if_else(condition: Column, yes: Column | object, no: Column | object) -> Column:
    """Two-way choice that stays null when the condition is null."""
    yes, no = (v if isinstance(v, Column) else F.lit(v) for v in (yes, no))
    return F.when(condition.isNull(), F.lit(None)).when(condition, yes).otherwise(no)


def fill_ids(df: DataFrame, col: str, order: Sequence[str], **kw) -> DataFrame:
    """Number the rows whose id is missing 1..n in the given order."""
    missing = row_numbers(df.where(F.col(col).isNull()), [], order, "__id", **kw)
    kind = df.schema[col].dataType
    filled = missing.withColumn(col, F.col("__id").cast(kind)).drop("__id")
    return df.where(F.col(col).isNotNull()).unionByName(filled)


def copy_per_treatment(df: DataFrame, out: str, values: Sequence, picks: dict[str, dict]) -> DataFrame:
    """Copy each row once per treatment and pick treatment-specific columns.

    ``picks[col][value]`` names the source column of ``col`` for that value.
    """
    copied = df.withColumn(out, F.explode(F.array(*[F.lit(v) for v in values])))
    chosen = {}
    for col, sources in picks.items():
        chosen[col] = rule_value([(F.col(out) == v, F.col(src)) for v, src in sources.items()])
    return copied.withColumns(chosen)


def index_to_column(df: DataFrame, order: Sequence[str], out: str = "index") -> DataFrame:
    """The position of each row under a total order, 1 to n, as a key column in front."""
    return row_numbers(df, [], list(order), out).select(out, *df.columns)


def column_to_index(df: DataFrame, key: str) -> DataFrame:
    """Rows in the order of a key column, which is dropped; a key that repeats raises."""
    checked = df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    only = F.when(F.col("__n") > 1, F.raise_error(F.lit("the key repeats"))).otherwise(F.col(key))
    return checked.withColumn("__k", only).orderBy("__k").drop("__n", "__k", key)
