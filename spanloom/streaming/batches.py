"""Streams drained into a table of the shared folder, one folder a batch.

A batch replaces the folder of its own number, so a batch that a lost driver
left half written, or that runs again after a restart, counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.joins import interval_join
from spanloom.session import cut_lineage
from spanloom.streaming.daily import daily_max


def drain(
    stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, mode: str = "append"
) -> DataFrame:
    """Process all that the source offers now and return the table so far.

    A later call with the same ``path`` and ``checkpoint`` goes on behind the
    last finished batch. Without any input the table is empty.
    """

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    spark = stream.sparkSession
    write(spark.createDataFrame([], stream.schema), -1)  # gives the table its columns
    writer = stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True)
    writer.option("checkpointLocation", checkpoint).start().awaitTermination()
    return read_batches(spark, path)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/batch_id=-1").schema
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def daily_max_mean(
    stream: DataFrame,
    by: Sequence[str],
    ts: str,
    col: str,
    path: str,
    checkpoint: str,
    lateness: str = "1 day",
) -> DataFrame:
    """Mean over days of the daily maximum; the batch form is ``rollup_max_mean``.

    Each batch writes the days that it changed, and the largest value of a day
    stands. State is one row per group and open day. Rows behind the watermark
    and rows without a time take no part.
    """
    days = daily_max(stream, by, ts, col, lateness)
    changed = drain(days, lambda batch: batch, path, checkpoint, "update")
    whole = changed.groupBy(*by, "day").agg(F.max(f"{col}_max").alias(f"{col}_max"))
    return whole.groupBy(*by).agg(F.avg(f"{col}_max").alias(col))


def interval_lookup(
    stream: DataFrame,
    spans: DataFrame,
    ts: str,
    start: str,
    end: str,
    on: Sequence[str],
    path: str,
    checkpoint: str,
) -> DataFrame:
    """Left join of streamed readings to the spans that contain them; the batch form is ``interval_join``.

    Spans are evaluated once for all batches. No state is kept.
    """
    spans = cut_lineage(spans)
    return drain(stream, lambda batch: interval_join(batch, spans, ts, start, end, on), path, checkpoint)
