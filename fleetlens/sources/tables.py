"""Table reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


ROWS_A_TASK = 50_000


def spread_small_scan(scan: DataFrame) -> DataFrame:
    """Spread a scan whose splits are fewer than the session's cores or hold many rows.

    Parsing documents costs far more than moving rows.  A table in one file would leave all
    but one core idle, and a file is cut at row groups only: splits beside one are empty, and the
    others hold whole groups, however many splits are planned.  So the rows of every split are
    counted, which reads no column, and beyond ``ROWS_A_TASK`` the number of tasks follows the rows.
    A table of many small files is returned as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan.groupBy(F.spark_partition_id().alias("split")).count()
    found = splits.agg(F.count("*"), F.max("count"), F.sum("count")).first()
    if found[0] == 0 or (found[0] >= cores and found[1] <= ROWS_A_TASK):
        return scan
    return scan.repartition(max(cores, -(-found[2] // ROWS_A_TASK)))
