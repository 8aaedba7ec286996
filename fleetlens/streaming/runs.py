"""Running event streams: a file source, one query per output, a parquet sink.

Offsets in the checkpoint and the commit log of the file sink give each event
exactly one place in the output, whatever executor is lost on the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import stage_path


def read_files(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream; the schema is read from the files once.

    The source wants a folder or a pattern; the path goes in as a pattern, so a
    table that is a single file works like one that is a folder of files.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path if "*" in path else f"{path[:-1]}[{path[-1]}]")


def run_to_parquet(stream: DataFrame, name: str, *, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all available input and return what the sink holds.

    A second run with the same ``path`` and ``checkpoint`` takes only new files.
    """
    spark = stream.sparkSession
    path = path or stage_path(spark, f"{name}-out")
    checkpoint = checkpoint or stage_path(spark, f"{name}-offsets")
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def waiting_state(spark: SparkSession, checkpoint: str, schema: str) -> DataFrame:
    """Keys and keyed state that a run of one stateful operator left in ``checkpoint``.

    ``schema`` is that of the key and the state; a run that never had a file left none.
    """
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/state")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    names = spark.createDataFrame([], schema).columns
    state = spark.read.format("statestore").load(checkpoint).select("key.*", "value.*")
    return state.select("*", "groupState.*").select(*[F.col(n) for n in names])
