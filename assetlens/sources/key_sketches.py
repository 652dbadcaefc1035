"""Different keys over any choice of files and periods, from stored sketches.

A sketch is Spark's HyperLogLog aggregate of one file's (or period's) keys: a few KB
however many rows there were. Sketches merge, so a count over any set of periods reads
lines of the sketch table instead of deals, and a new file adds its own line.
The relative standard error is ``1.04 / sqrt(2 ** LG)``, 0.016; ``exact_keys`` beside
it counts from the rows. Null keys are not counted; no rows, no lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LG = 12  # of a sketch's buckets
ERROR = 1.04 / 2 ** (LG / 2)


def sketches(rows: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """One line per ``by`` (say file and period): ``keys``, the sketch, and ``n_rows``. Combined map side."""
    given = F.when(F.col(key).isNotNull(), F.col(key).cast("string"))
    return rows.groupBy(*by).agg(F.hll_sketch_agg(given, F.lit(LG)).alias("keys"), F.count(F.lit(1)).alias("n_rows"))


def extend(spark: SparkSession, path: str, rows: DataFrame, key: str, by: Sequence[str], files: str = "dataset_file") -> None:
    """Append lines of the files in ``rows`` that the table at ``path`` has none of; ``by`` must name ``files``.

    Run again or restarted, it adds none twice.
    """
    new = rows
    if _exists(spark, path):
        new = rows.join(stored(spark, path, sketches(rows, key, by).schema).select(files).distinct(), files, "left_anti")
    sketches(new, key, by).write.mode("append").parquet(path)


def stored(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def distinct_keys(lines: DataFrame, *per: str, where: Column | None = None) -> DataFrame:
    """Estimated ``keys`` and exact ``n_rows`` per ``per`` (or over all) of the lines that ``where`` lets through."""
    chosen = lines if where is None else lines.where(where)
    merged = F.hll_sketch_estimate(F.hll_union_agg("keys"))
    return chosen.groupBy(*per).agg(F.coalesce(merged, F.lit(0)).alias("keys"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))


def exact_keys(rows: DataFrame, key: str, *per: str) -> DataFrame:
    """The same two columns from the rows: (``per``, key) is made distinct first, so a hot period is no one task."""
    counted = rows.groupBy(*per, F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*per).agg(F.count("_key").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
