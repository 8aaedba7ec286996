"""Several outputs from one read of a stream, committed together, and rows that come late.

Each micro-batch is read once and written to all its outputs, every one in a folder of its own
for the batch.  One ledger row ends the batch; readers see no batch without its row.  A batch
that died half-way is written over when it comes again, and one that had its row already is
passed over, so an output holds each row once and never without the other outputs.

Spark's own watermark drops late rows without a word.  ``split_late`` keeps a watermark in the ledger
and routes them to an output of their own instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators.alerts import ALERT, alert_throttle
from fleetlens.session import stage_path

LEDGER = "_ledger"
LEDGER_SCHEMA = "batch bigint, outputs array<string>, rows array<bigint>, high timestamp_ntz"

# outputs of a batch: name -> DataFrame, from the batch and the highest event time of all batches before
Outputs = Callable[[DataFrame, object], dict[str, DataFrame]]


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The batches that are complete: batch, outputs, rows of each output and highest event time.

    A row is one file, which the commit of its write puts in place as a whole.
    """
    if not _exists(spark, f"{path}/{LEDGER}"):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(f"{path}/{LEDGER}")


def read_output(spark: SparkSession, path: str, name: str, schema: T.StructType | str) -> DataFrame:
    """The rows of one output in all complete batches; empty where no batch had any.

    Batches end in order, so only the one after the last complete batch can be unfinished.
    """
    empty = spark.createDataFrame([], schema)
    last = ledger(spark, path).agg(F.max("batch")).first()[0]
    if last is None or not _exists(spark, f"{path}/{name}"):
        return empty
    whole = T.StructType([*empty.schema.fields, T.StructField("_batch", T.LongType())])
    rows = spark.read.schema(whole).parquet(f"{path}/{name}")
    return rows.where(F.col("_batch") <= last).drop("_batch")


def run_together(
    stream: DataFrame, outputs: Outputs, *, path: str | None = None, checkpoint: str | None = None, time: str | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> str:
    """Run a stream over all available input into several outputs; returns their folder.

    ``time`` names the event time whose highest value the ledger keeps.  A second run with the
    same ``path`` and ``checkpoint`` takes only new files, and first repeats a batch that a crash
    left unfinished.  The source bounds a batch (``files_per_trigger`` of ``read_files``).
    ``prepare`` makes the rows that the outputs share from a batch, before they are held: there a
    batch can be spread by its rows, which a stream cannot.
    """
    spark = stream.sparkSession
    path = path or stage_path(spark, "batches")
    checkpoint = checkpoint or stage_path(spark, "batches-offsets")

    def write(batch: DataFrame, number: int) -> None:
        here = batch.sparkSession
        before = ledger(here, path).agg(F.max("batch").alias("last"), F.max("high").alias("high")).first()
        if before["last"] is not None and before["last"] >= number:
            return  # the crash came after the ledger row
        batch = (prepare(batch) if prepare else batch).persist()
        try:
            counts = {}
            for name, rows in outputs(batch, before["high"]).items():
                folder = f"{path}/{name}/_batch={number}"
                rows.write.mode("overwrite").parquet(folder)
                # what was written, not the plan again
                counts[name] = here.read.schema(rows.schema).parquet(folder).count()
            high = batch.agg(F.max(F.col(time).cast("timestamp_ntz"))).first()[0] if time else None
            entry = [(number, list(counts), list(counts.values()), high)]
            here.createDataFrame(entry, LEDGER_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{LEDGER}")
        finally:
            batch.unpersist()

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return path


def split_late(batch: DataFrame, high, time: str, lateness: str) -> tuple[DataFrame, DataFrame]:
    """(rows on time, rows later than the highest time of the batches before less ``lateness``).

    A row without a time is on time; in the first batch every row is.
    """
    if high is None:
        return batch, batch.where(F.lit(False))
    late = F.coalesce(F.col(time).cast("timestamp_ntz") <= F.lit(high).cast("timestamp_ntz") - F.expr(f"INTERVAL {lateness}"), F.lit(False))
    return batch.where(~late), batch.where(late)


def route_late(stream: DataFrame, time: str, *, lateness: str = "10 minutes", path: str | None = None, checkpoint: str | None = None) -> str:
    """Outputs ``on_time`` and ``late`` of a stream; every row of the input is in one of them."""

    def outputs(batch: DataFrame, high) -> dict[str, DataFrame]:
        on_time, late = split_late(batch, high, time, lateness)
        return {"on_time": on_time, "late": late}

    return run_together(stream, outputs, path=path, checkpoint=checkpoint, time=time)


def late_corrections(responses: DataFrame, late: DataFrame) -> DataFrame:
    """Late alerts that would have had a response: those of a throttle over them and the responses given.

    Responses given are alerts without an id there: they suppress late alerts after them, and a late
    alert before one takes its place, as it would have done on time.  ``late`` has the columns of matched alerts.
    """
    delays = late.where("delay_seconds > 0").groupBy(*ALERT).agg(F.max("delay_seconds").alias("delay_seconds"))
    given = responses.select(*ALERT, "ts").join(delays, ALERT).withColumn("event_id", F.lit(None).cast("bigint"))
    both = late.select(*ALERT, "ts", "delay_seconds", "event_id").unionByName(given)
    return alert_throttle(both).where("event_id IS NOT NULL")
