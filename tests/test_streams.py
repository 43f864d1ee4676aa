"""Streams drained batch by batch against their batch forms."""

from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from spanloom.operators.joins import interval_join
from spanloom.operators.summaries import rollup_max_mean
from spanloom.streaming.batches import daily_max_mean, drain, interval_lookup

T0 = datetime(2024, 1, 1)
EVENTS = "k string, ts timestamp, v double"


def rows(df):
    return sorted(df.select(*sorted(df.columns)).collect(), key=str)


def add(spark, data, folder, schema=EVENTS):
    """One more file, so one more batch."""
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder, schema=EVENTS):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture
def place(tmp_path):
    return [str(tmp_path / n) for n in ("in", "out", "progress")]


def test_daily_max_over_batches_and_a_restart(spark, place):
    folder, out, progress = place
    first = [("a", T0 + timedelta(hours=5 * i), float(i % 7)) for i in range(12)] + [(None, T0, 2.0), ("b", T0, None)]
    late = [("a", T0 + timedelta(hours=1), 50.0), ("c", T0 + timedelta(days=4), 1.0)]
    add(spark, first, folder)
    daily_max_mean(source(spark, folder), ["k"], "ts", "v", out, progress, "30 days")
    add(spark, late, folder)  # the first day again, three days later
    got = daily_max_mean(source(spark, folder), ["k"], "ts", "v", out, progress, "30 days")
    assert rows(got) == rows(rollup_max_mean(spark.createDataFrame(first + late, EVENTS), ["k"], "ts", "v"))


def test_rows_behind_the_watermark_and_without_time_take_no_part(spark, place):
    folder, out, progress = place
    kept = [("a", T0 + timedelta(days=d), float(d)) for d in range(5)]
    add(spark, kept + [("a", None, 99.0)], folder)
    add(spark, [("a", T0 + timedelta(days=20), 4.0)], folder)
    daily_max_mean(source(spark, folder), ["k"], "ts", "v", out, progress, "1 day")
    add(spark, [("a", T0, 1000.0)], folder)
    got = daily_max_mean(source(spark, folder), ["k"], "ts", "v", out, progress, "1 day")
    expected = spark.createDataFrame([*kept, ("a", T0 + timedelta(days=20), 4.0)], EVENTS)
    assert rows(got) == rows(rollup_max_mean(expected, ["k"], "ts", "v"))


def test_interval_lookup_over_batches_and_a_restart(spark, place):
    folder, out, progress = place
    spans = spark.createDataFrame(
        [("a", 1, T0, T0 + timedelta(hours=2)), ("a", 2, T0 + timedelta(hours=1), T0 + timedelta(days=9)), (None, 3, T0, T0)],
        "k string, id int, t0 timestamp, t1 timestamp",
    )
    points = [(k, T0 + timedelta(minutes=40 * i), float(i)) for i in range(30) for k in ("a", "b", None)] + [("a", None, 1.0)]
    add(spark, points[:40], folder)
    interval_lookup(source(spark, folder), spans, "ts", "t0", "t1", ["k"], out, progress)
    add(spark, points[40:], folder)
    got = interval_lookup(source(spark, folder), spans, "ts", "t0", "t1", ["k"], out, progress)
    assert rows(got) == rows(interval_join(spark.createDataFrame(points, EVENTS), spans, "ts", "t0", "t1", ["k"]))


def test_a_failed_batch_runs_again_and_counts_once(spark, place):
    folder, out, progress = place
    add(spark, [("a", T0, 1.0)], folder)
    add(spark, [("b", T0, 2.0)], folder)
    broken = lambda batch: batch.withColumn("v", F.when(F.col("k") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        drain(source(spark, folder), broken, out, progress)
    got = drain(source(spark, folder), lambda batch: batch, out, progress)
    assert [r.v for r in rows(got)] == [1.0, 2.0]


def test_no_input_gives_an_empty_table(spark, place, tmp_path):
    folder, out, progress = place
    (tmp_path / "in").mkdir()
    got = daily_max_mean(source(spark, folder), ["k"], "ts", "v", out, progress)
    assert got.columns == ["k", "v"] and got.count() == 0
