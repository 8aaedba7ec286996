"""Session builder and the shared folder for checkpoints and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

UNKNOWN_BYTES = 2**63 - 1  # spark.sql.defaultSizeInBytes


def build_session(
    master: str | None = None, app: str = "fleetlens", **conf: str
) -> SparkSession:
    """Session with the settings the operators are tuned for.

    AQE sizes shuffle partitions, splits skewed join partitions and switches to a
    broadcast join when the measured side is small; nothing in the library forces
    a broadcast of data that grows.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # checkpoint files go away with the DataFrames that own them
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session (tests)
    may fall back to a temporary folder, because other machines cannot see one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="fleetlens-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_staged(spark: SparkSession, path: str) -> None:
    """Remove a staged folder, through the file system that holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage.

    The data is written with replication by the shared file system, so a lost
    executor costs one task and never the rounds that came before.
    """
    shared_dir(df.sparkSession)
    return _bounded(df.checkpoint(eager=True))


def _bounded(df: DataFrame) -> DataFrame:
    """``df`` of a checkpoint with an estimated size of at most that of rows of unknown size.

    A checkpoint hands on the estimate of its plan, and a join multiplies those of its sides.
    Where rounds join what the round before wrote, the digits double every round, up to
    numbers of megabytes that the driver multiplies again for every plan.  Smaller estimates
    stay, so no join is planned in another way: both are far beyond every broadcast limit.
    """
    plan, spark = df._jdf.logicalPlan(), df.sparkSession
    try:
        if plan.stats().sizeInBytes() <= UNKNOWN_BYTES:
            return df
    except ValueError:  # more digits than Python reads
        pass
    option, session = spark._jvm.scala.Option, spark._jsparkSession
    plan = plan.copy(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(),
        session, option.empty(), option.apply(plan.constraints()),
    )
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plan), spark)


def cut_measured(df: DataFrame, measure: Column) -> tuple[DataFrame, int]:
    """``cut``, and an aggregate of the rows taken while they are written, without a job of its own."""
    seen = Observation()
    found = cut(df.observe(seen, measure.alias("measure")))
    value = seen.get.get("measure")
    return found, found.agg(measure).first()[0] if value is None else value
