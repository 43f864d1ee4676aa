"""Text operators over lines and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.scalar import any_pattern, replace_all
from spanloom.operators.expect import GateError
from spanloom.operators.joins import anti, semi


def extract_tokens(df: DataFrame, text: str, split: str, contains: str, strip: str, keep: str, out: str = "token") -> DataFrame:
    """Distinct tokens of a kind, for example citation keys.

    Text is split on a regex; tokens that match ``contains`` lose the ``strip``
    pattern, those that then match ``keep`` lose it as their prefix.
    """
    # Filtered inside the array, so that only tokens of interest become rows.
    found = F.filter(F.split(F.col(text), split), lambda token: token.rlike(contains))
    tokens = df.where(F.col(text).rlike(contains)).select(F.explode(found).alias(out))
    bare = tokens.select(F.regexp_replace(out, strip, "").alias(out)).where(F.col(out).rlike(keep))
    return bare.select(F.regexp_replace(out, keep, "").alias(out)).distinct()


def missing_keys(cited: DataFrame, library: DataFrame, on, strict: bool = False) -> DataFrame:
    """Cited keys the library lacks; in strict mode any such key raises."""
    gone = anti(cited, library, on)
    if strict:
        sample = gone.take(5)
        if sample:
            raise GateError(f"missing keys: {[tuple(r) for r in sample]}")
    return gone


def restrict_library(
    library: DataFrame, cited: DataFrame, on, kind: str, drop_kind: str, blank: dict[str, str], keep: Sequence[str]
) -> DataFrame:
    """Cited entries only; one kind dropped, fields blanked for their kind, columns picked.

    ``blank`` maps a field to the kind for which it is emptied.
    """
    used = semi(library, cited, on).where(~F.col(kind).eqNullSafe(F.lit(drop_kind)))
    fields = {f: F.when(~F.col(kind).eqNullSafe(F.lit(k)), F.col(f)) for f, k in blank.items()}
    return used.withColumns(fields).select(*keep)


def rewrite_lines(df: DataFrame, col: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Ordered regex rewrites of every line."""
    return df.withColumn(col, replace_all(col, rules))


def matching_lines(df: DataFrame, line: str, patterns: Sequence[str], order: str | None = None) -> DataFrame:
    """Distinct lines that match any pattern, with their first position when ordered."""
    hits = df.where(F.col(line).rlike(any_pattern(patterns)))
    if order is None:
        return hits.select(line).distinct()
    return hits.groupBy(line).agg(F.min(order).alias(order))
