"""File sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header and ``NA`` for missing values."""
    df.write.mode(mode).option("header", True).option("nullValue", "NA").option("emptyValue", "").csv(path)


def csv_with_header(df: DataFrame, header_lines: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Text lines: comment lines, the column names, then the rows in order."""
    head = [*header_lines, ",".join(df.columns)]
    top = df.sparkSession.createDataFrame([(0, i, line) for i, line in enumerate(head)], "part int, pos int, value string")
    line = F.to_csv(F.struct(*df.columns), {"nullValue": "NA", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"})
    body = df.select(F.lit(1).alias("part"), F.lit(0).alias("pos"), line.alias("value"), *[F.col(c).alias(f"__{c}") for c in order_by])
    both = top.unionByName(body, allowMissingColumns=True)
    return both.orderBy("part", "pos", *[f"__{c}" for c in order_by]).select("value")


def write_csv_with_header(df: DataFrame, path: str, variants: dict[str, Sequence[str]], variant: str, order_by: Sequence[str]) -> None:
    """Write the lines of ``csv_with_header`` with the comments of one variant.

    Part files are in order: their concatenation is the document.
    """
    if variant not in variants:
        raise ValueError(f"variant must be one of {sorted(variants)}")
    csv_with_header(df, variants[variant], order_by).write.text(path)


def write_lines(df: DataFrame, path: str, col: str = "line") -> None:
    df.select(col).write.text(path)
