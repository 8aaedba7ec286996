"""Reads of tables."""

from pyspark.sql import functions as F

from fleetlens.sources.tables import ROWS_A_TASK, spread_small_scan


def test_scan_with_one_row_group_is_spread(spark, tmp_path):
    spark.range(9 * ROWS_A_TASK).repartition(1).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        scan = spark.read.parquet(str(tmp_path / "t"))
        assert scan.rdd.getNumPartitions() >= 8  # planned, and all but one are empty
        parts = [r["count"] for r in spread_small_scan(scan).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(parts) == 9 * ROWS_A_TASK and len(parts) == 9 and max(parts) <= 1.1 * ROWS_A_TASK
        small = spark.range(80).repartition(8)
        assert spread_small_scan(small) is small and spread_small_scan(small.limit(0)).isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
