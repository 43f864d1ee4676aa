"""Wide/long reshaping, splitting, nesting and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.columns import names_matching


def to_long(df: DataFrame, keys: Sequence[str], cols: Sequence[str] | str, var: str, value: str) -> DataFrame:
    """Wide to long by column list or name pattern; null cells are kept."""
    chosen = names_matching(df, cols) if isinstance(cols, str) else list(cols)
    chosen = [c for c in chosen if c not in keys]
    return df.unpivot(list(keys), chosen, var, value)


def to_wide(
    df: DataFrame,
    keys: Sequence[str],
    var: str,
    values: Sequence[str],
    levels: Sequence,
    name: str = "{value}_{level}",
) -> DataFrame:
    """Long to wide as one conditional aggregate.

    A cell given twice raises when the result is read, instead of silently
    keeping one of its values.
    """
    cells = []
    for level in levels:
        here = F.col(var) == F.lit(level)
        copies = F.count(F.when(here, F.lit(1)))
        for value in values:
            cell = F.when(copies > 1, F.raise_error(F.lit(f"several rows for {var} = {level}"))).otherwise(
                F.max(F.when(here, F.col(value)))
            )
            cells.append(cell.alias(name.format(value=value, level=level)))
    return df.groupBy(*keys).agg(*cells)


def split_column(df: DataFrame, col: str, into: Sequence[str | None], sep: str, drop: bool = True) -> DataFrame:
    """Split on a regex: missing pieces become null, extra pieces are dropped."""
    parts = F.split(F.col(col), sep)
    out = df.withColumns(
        {name: F.try_element_at(parts, F.lit(i + 1)) for i, name in enumerate(into) if name is not None}
    )
    return out.drop(col) if drop and col not in into else out


def split_rows(df: DataFrame, col: str, sep: str) -> DataFrame:
    """One row per piece of a delimited cell, trimmed."""
    return df.withColumn(col, F.explode_outer(F.split(F.col(col), sep))).withColumn(col, F.trim(F.col(col)))


def unite(df: DataFrame, out: str, cols: Sequence[str], sep: str = "_") -> DataFrame:
    """Paste columns into one and drop them; a null pastes as ``NA``."""
    pasted = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in cols])
    return df.withColumn(out, pasted).drop(*[c for c in cols if c != out])


def replicate(df: DataFrame, n: str) -> DataFrame:
    """Each row repeated ``n`` times; ``n`` must be whole and not negative."""
    count = F.col(n)
    bad = (count < 0) | (count != F.floor(count))
    checked = F.when(bad, F.raise_error(F.lit("replication count must be whole and positive"))).otherwise(count)
    copies = F.when(checked > 0, F.sequence(F.lit(1), checked.cast("long")))
    return df.withColumn("__copy", F.explode(copies)).drop("__copy", n)


def nest(df: DataFrame, by: Sequence[str], cols: Sequence[str], out: str = "data", parts: int = 1, part: str = "part") -> DataFrame:
    """Rows of a group gathered in ordered lists: ``by``, ``part``, ``out``.

    The caller chooses in how many lists a group is kept (``parts``, numbered
    from 0 in the column ``part``, rows dealt by hash): one, unless groups may
    be too long for one value. ``unnest`` restores all rows.
    """
    item = F.struct(*cols)
    number = F.pmod(F.xxhash64(item), F.lit(parts)).cast("int")
    return df.groupBy(*by, number.alias(part)).agg(F.array_sort(F.collect_list(item)).alias(out))


def unnest(df: DataFrame, col: str) -> DataFrame:
    kept = [c for c in df.columns if c != col]
    return df.select(*kept, F.explode(col).alias("__item")).select(*kept, "__item.*")


def bind_rows(*frames: DataFrame) -> DataFrame:
    """Union by name; columns missing from a frame are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def bind_distinct(*frames: DataFrame) -> DataFrame:
    return bind_rows(*frames).distinct()


def pick(condition: Column, value: str) -> Column:
    """Aggregate that keeps a value of the rows meeting a condition."""
    return F.max(F.when(condition, F.col(value)))
