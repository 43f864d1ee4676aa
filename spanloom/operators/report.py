"""Report-ready tables: formatted summaries, labels and page numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.scalar import mean_sd_text, stars
from spanloom.operators.joins import join_null_safe
from spanloom.operators.ranks import attach, ordinal, row_numbers
from spanloom.operators.summaries import range_label, strict, summarise


def formatted_summary(df: DataFrame, by: Sequence[str], col: str, digits: int = 2, out: str = "text") -> DataFrame:
    """``mean ± sd`` text and row count per group."""
    s = summarise(df, by, [col])
    return s.select(*by, mean_sd_text(f"{col}_mean", f"{col}_sd", digits).alias(out), F.col(f"{col}_n").alias("n"))


def block_index(table: DataFrame, block: str, order: Sequence[str]) -> DataFrame:
    """Row number of every line of a printed table and the bounds of its block."""
    numbered = row_numbers(table, [], [block, *order], "row_no")
    return attach(numbered, [block], first_row=F.min("row_no"), last_row=F.max("row_no"))


def size_labels(df: DataFrame, by: Sequence[str], panel: Sequence[str], out: str = "n_label") -> DataFrame:
    """``low-high`` range of group sizes within each panel."""
    sizes = df.groupBy(*dict.fromkeys([*by, *panel])).agg(F.count(F.lit(1)).alias("__n"))
    return range_label(sizes, panel, "__n", out)


def significance_labels(tests: DataFrame, summary: DataFrame, by: Sequence[str], response: str, col: str) -> DataFrame:
    """Stars per group with the height ``max(mean + sd)`` of its response.

    A missing sd leaves the height missing.
    """
    reach = summary.withColumn("__top", F.col(f"{col}_mean") + F.col(f"{col}_sd"))
    tops = reach.groupBy(*by).agg(strict(F.max("__top"), "__top").alias("height"))
    marked = tests.where(F.col("response") == response).select(*by, stars("p_value").alias("label"))
    return join_null_safe(marked, tops, list(by))


def pages(df: DataFrame, panel: Sequence[str], per_page: int, out: str = "page") -> DataFrame:
    """Page number of every panel, ``per_page`` panels to a page."""
    key = F.struct(*panel)
    numbered = ordinal(df.withColumn("__panel", key), [], "__panel", "__no")
    return numbered.withColumn(out, F.ceil(F.col("__no") / per_page).cast("long")).drop("__panel", "__no")


def complete_groups(df: DataFrame, by: Sequence[str], col: str, needed: Column, later: Column) -> DataFrame:
    """Rows of one condition, for groups that also occur in a later condition."""
    seen = df.where(later).select(*by).distinct()
    return join_null_safe(df.where(needed), seen, list(by), "left_semi")
