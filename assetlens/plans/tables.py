"""Reading the shared tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_PER_TASK = 50_000  # of a scan that is dealt anew


def _dealt(scan: DataFrame, tasks: int) -> DataFrame:
    """``scan`` over ``tasks`` by the number of each row in its file.

    Dealt in turn without a number, the rows of a task would be sorted first, all
    of a row group in the memory of one task. The rows of a file always come in
    one order, so a task that runs again deals them alike.
    """
    return scan.withColumn("_number", F.monotonically_increasing_id()).repartition(tasks, "_number").drop("_number")


def spread(scan: DataFrame) -> DataFrame:
    """A scan that row-heavy parsing follows, dealt over many tasks where its files give few of them rows.

    A row group is read by one task, so a small file keeps one core busy
    however many there are. The rows of each task are counted from the file
    footers; where one task holds more than twice its share of the cores' rows,
    rows are dealt by number. ``spark.assetlens.scanTasks`` fixes the number of
    tasks (a laptop's session does), which saves the count.
    """
    spark = scan.sparkSession
    tasks = spark.conf.get("spark.assetlens.scanTasks", None)
    if tasks:
        return _dealt(scan, int(tasks))
    cores = spark.sparkContext.defaultParallelism
    held = scan.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
    largest, total = held.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if largest <= max(2 * total / cores, 1000):
        return scan
    return _dealt(scan, max(cores, math.ceil(total / ROWS_PER_TASK)))
