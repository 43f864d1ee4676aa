"""Two-sample Welch tests per group as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.scalar import p_text
from spanloom.functions.tails import t_critical, t_p_value
from spanloom.operators.reshape import to_long
from spanloom.operators.summaries import split_moments


def welch_by_group(
    df: DataFrame,
    by: Sequence[str],
    side: str,
    levels: tuple[str, str],
    values: Sequence[str],
    level: float = 0.95,
) -> DataFrame:
    """Two-sided test of unequal variances for each group and response.

    All responses go through one pass over a long table. Groups with fewer
    than two values on either side are dropped.
    """
    long = to_long(df, [*by, side], values, "response", "__value")
    m = split_moments(long, [*by, "response"], side, levels, "__value").where("n_a >= 2 and n_b >= 2")
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    pooled = F.pow(va + vb, 2)
    m = m.withColumns({"difference": F.col("mean_a") - F.col("mean_b"), "__se": F.sqrt(va + vb)}).withColumns(
        {
            "statistic": F.try_divide("difference", "__se"),
            "df": F.try_divide(pooled, va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1)),
        }
    )
    m = m.withColumns({"p_value": t_p_value(F.col("statistic"), F.col("df")), "__q": t_critical(F.col("df"), level)})
    return m.select(
        *by,
        "response",
        "difference",
        "mean_a",
        "mean_b",
        "statistic",
        "p_value",
        "df",
        (F.col("difference") - F.col("__q") * F.col("__se")).alias("conf_low"),
        (F.col("difference") + F.col("__q") * F.col("__se")).alias("conf_high"),
    )


def formatted_p(tests: DataFrame, group: str, value: object, response: str, alpha: float | None = 0.05) -> DataFrame:
    """Text of one p-value; with ``alpha`` it must be below that level."""
    one = tests.where((F.col(group) == F.lit(value)) & (F.col("response") == response))
    text = p_text("p_value")
    if alpha is not None:
        failed = F.raise_error(F.lit(f"p-value of {response} is not below {alpha}"))
        text = F.when(F.col("p_value") < alpha, text).otherwise(failed)
    return one.select(group, "response", text.alias("p_text"))
