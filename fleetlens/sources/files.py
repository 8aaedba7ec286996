"""File listings and the deadlock export sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import text as tx

# fixed value: name pattern of dated log files, *_????????_??????.txt
LOG_PATTERN = r"^.*_.{8}_.{6}\.txt$"
LOG_GLOB = "*_????????_??????.txt"


def list_files(spark: SparkSession, folder: str, *, glob: str | None = None, before: str | None = None) -> DataFrame:
    """Listing (path, modified, size) of the files below a folder; contents are not read.

    ``before`` is a time text without zone; empty files are not listed.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if before:
        reader = reader.option("modifiedBefore", before)
    return reader.load(folder).select(
        "path", F.col("modificationTime").cast("timestamp_ntz").alias("modified"), F.col("length").alias("size")
    )


def purge_log_files(listing: DataFrame, *, now: Column, days: int = 30) -> DataFrame:
    """Dated log files older than some days, from a listing (path, modified)."""
    name = F.substring_index(tx.basename("path"), "/", -1)
    return listing.where(name.rlike(LOG_PATTERN) & (F.col("modified") < now - F.expr(f"INTERVAL {int(days)} DAYS")))


def deadlock_documents(reports: DataFrame) -> DataFrame:
    """Export name, day and document of each deadlock report (fixed name format)."""
    return reports.where(F.col("xml_deadlock_report").isNotNull()).select(
        "server_name", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "event_id",
        F.date_format("timestamp", "yyyy-MM-dd ~ HH_mm_ss.SSS").alias("name"), F.col("xml_deadlock_report").alias("document"),
    )


def deadlock_export(reports: DataFrame, path: str) -> DataFrame:
    """Write the documents as JSON lines by server and day and return what is there.

    Each task writes its rows; no file per event and nothing through the driver.
    """
    documents = deadlock_documents(reports)
    documents.write.mode("overwrite").partitionBy("server_name", "day").json(path)
    # partition values stay text because the schema says so
    return documents.sparkSession.read.schema(documents.schema).json(path)
