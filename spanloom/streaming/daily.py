"""The daily-maximum roll-up over a stream; the batch form is ``rollup_max_mean``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_max(stream: DataFrame, by: Sequence[str], ts: str, col: str, lateness: str = "1 day") -> DataFrame:
    """Daily maximum per group, final once the watermark passes the day.

    State is one row per group and open day. Feed the result to a table and
    average it there, as a mean over days has no final value on a stream.
    """
    days = stream.withWatermark(ts, lateness).groupBy(*by, F.window(ts, "1 day")).agg(F.max(col).alias(f"{col}_max"))
    return days.select(*by, F.to_date("window.start").alias("day"), f"{col}_max")
