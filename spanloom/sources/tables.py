"""Typed tables from CSV, exported sheets and small event tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanloom.functions.scalar import as_missing
from spanloom.operators.reshape import split_rows, to_wide


def blank_tokens(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Null for any missing-value token in the text columns."""
    return df.withColumns({c: as_missing(c, *tokens) for c, kind in df.dtypes if kind == "string"})


def read_csv_typed(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: StructType | str,
    na_tokens: Sequence[str] = ("NA",),
    strict: bool = True,
    file_column: str | None = None,
    **options: str,
) -> DataFrame:
    """CSV with a declared schema; never inferred.

    With one token the reader nulls it while parsing. With several, columns
    are read as text, blanked, and cast; a bad number then raises (``strict``)
    or becomes null.
    """
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    reader = spark.read.option("header", True).options(**options)
    if len(na_tokens) <= 1:
        mode = "FAILFAST" if strict else "PERMISSIVE"
        df = reader.schema(wanted).option("nullValue", na_tokens[0] if na_tokens else "").option("mode", mode).csv(path)
        return df.select("*", F.col("_metadata.file_name").alias(file_column)) if file_column else df
    text = StructType.fromDDL(", ".join(f"`{f.name}` string" for f in wanted))
    df = reader.schema(text).csv(path)
    tagged = df.select("*", F.col("_metadata.file_name").alias("__file"))
    blank = blank_tokens(tagged, na_tokens)
    cols = [(F.col(f.name).cast(f.dataType) if strict else F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in wanted]
    return blank.select(*cols, *([F.col("__file").alias(file_column)] if file_column else []))


def read_sheet(
    spark: SparkSession, path: str | Sequence[str], picks: Mapping[int, str], skip: int = 0, na_tokens: Sequence[str] = ("", "NA")
) -> DataFrame:
    """A spreadsheet tab exported to CSV: skip rows, pick columns by position.

    Columns arrive as text named by ``picks`` (1-based position -> name), with
    ``file`` and ``line_no``; cast them as needed.
    """
    from spanloom.sources.lines import read_lines

    lines = read_lines(spark, path).where(F.col("line_no") > skip)
    last = max(picks)
    schema = ", ".join(f"`c{i}` string" for i in range(1, last + 1))
    cells = lines.withColumn("__c", F.from_csv("line", F.lit(schema), {"quote": '"'}))
    named = cells.select("file", "line_no", *[F.col(f"__c.c{i}").alias(name) for i, name in picks.items()])
    return blank_tokens(named, na_tokens)


def apply_header_map(df: DataFrame, mapping: DataFrame, order: str, name: str) -> DataFrame:
    """Rename all columns in order from a mapping table (two-row headers merged by hand)."""
    names = [r[0] for r in mapping.orderBy(order).select(name).collect()]  # one row per column
    return df.toDF(*names)


def event_bounds(
    df: DataFrame, keys: Sequence[str], event: str = "event", ts: str = "date_time", start: str = "start", end: str = "end"
) -> DataFrame:
    """Event table -> one row per group with ``pre`` and ``post``."""
    wide = to_wide(df, keys, event, [ts], [start, end], name="{level}")
    return wide.withColumnsRenamed({start: "pre", end: "post"})


def event_bounds_multi(df: DataFrame, multi: str, keys: Sequence[str], sep: str = ",", **kw) -> DataFrame:
    """As ``event_bounds`` where one cell lists several keys."""
    return event_bounds(split_rows(df, multi, sep), [multi, *keys], **kw)


def upstream(spark: SparkSession, name: str) -> DataFrame:
    """A stage materialised earlier as a table."""
    return spark.table(name)
