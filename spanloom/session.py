"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with the defaults above; ``conf`` overrides them."""
    builder = SparkSession.builder.appName("spanloom")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators count on, for a session built elsewhere.

    Skewed joins are split even where a following aggregate on the same key
    then needs a shuffle of its own.
    """
    for key in ("enabled", "skewJoin.enabled", "forceOptimizeSkewedJoin"):
        spark.conf.set(f"spark.sql.adaptive.{key}", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    On a cluster it must be named there; only a local session, as in tests,
    gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            named = tempfile.mkdtemp(prefix="spanloom-checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; neither the plan nor an ever longer estimate of its size is kept."""
    shared_folder(df.sparkSession)
    return _estimated(df.checkpoint())


def _estimated(df: DataFrame) -> DataFrame:
    """``df``, a checkpoint, with no larger an estimate of its size than that of an unknown table.

    Spark takes a join to be as large as the product of its sides and keeps that at
    a checkpoint. A table joined with itself every round doubles the digits of its
    estimate each time, which fills the driver's memory after some 20 rounds.
    """
    plan = df._jdf.queryExecution().analyzed()
    try:
        if plan.stats().sizeInBytes() < 1 << 63:
            return df
    except ValueError:  # Python reads no number of more than 4,300 digits
        pass
    java = df.sparkSession._jvm
    bare = plan.copy(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(),
        df.sparkSession._jsparkSession, java.scala.Option.empty(), java.scala.Option.apply(plan.constraints()),
    )
    return type(df)(java.org.apache.spark.sql.classic.Dataset.ofRows(df.sparkSession._jsparkSession, bare), df.sparkSession)


def settled(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage``; the shuffle files of ``df`` are deleted at once.

    Otherwise they stay until the driver happens to collect its garbage, which
    over many short rounds is never.
    """
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        df = df.select("*")  # a plan takes the setting when it is made
    finally:
        conf.set(key, before)
    return cut_lineage(df)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
