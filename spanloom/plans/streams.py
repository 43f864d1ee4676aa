"""A, J over a stream: the events are read as a file stream and drained into the shared folder."""

from pyspark.sql import functions as F

from spanloom.plans.aggregates import rounded
from spanloom.plans.registry import SQL, query
from spanloom.session import new_path
from spanloom.streaming import batches as B

FILES = 1_000  # files a batch
HISTORY = "36500 days"  # files of a table come in any order, so a replay drops nothing as late


def stream_of(t, name):
    reader = t.spark.readStream.schema(getattr(t, name).schema).option("maxFilesPerTrigger", FILES)
    return reader.parquet(f"{t.folder}/{name}.parquet*")  # a pattern, as a lone file is not taken


def folders(t, name):
    return new_path(t.spark, name), new_path(t.spark, f"{name}-progress")


@query("a03b_streamed_daily_max_mean", SQL["a03_daily_max_mean"])
def _(t):
    kept = stream_of(t, "events").where("event_type <> 'error'").withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(B.daily_max_mean(kept, ["user_id", "event_type"], "ts", "value", *folders(t, "days"), HISTORY), "value")


@query("j09c_streamed_interval_join", SQL["j09_interval_left_join"])
def _(t):
    sessions = t.events.where("event_type = 'signup'").select(
        F.col("event_id").alias("session_id"), "user_id", F.col("ts").alias("t0"), F.expr("ts + interval 6 hours").alias("t1")
    )
    points = stream_of(t, "events").select("event_id", "user_id", "ts")
    found = B.interval_lookup(points, sessions, "ts", "t0", "t1", ["user_id"], *folders(t, "lookups"))
    return found.select("event_id", "session_id")
