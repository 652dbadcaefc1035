"""Landing-zone ingest: each new period file is read once.

The stream's checkpoint is the manifest of what was loaded; a restart without
new files does nothing, and a lost executor or driver never doubles rows, as
the file sink commits per batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import snapshots
from ..sources.deal_files import DEAL_COLUMNS, LINE_OPTIONS, _unquoted, dataset_columns, replace_files, scan_deals, split_fields


def stream_deals(spark: SparkSession, folder: str, delimiter: str | None = None, pattern: str = "dataset_*", max_files: int = 100) -> DataFrame:
    """Deal rows of files as they land; same columns and same delimiter rule as the batch scan."""
    lines = (
        spark.readStream.schema("line string")
        .options(**LINE_OPTIONS)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files)
        .csv(folder)
        .select("line", F.col("_metadata.file_name").alias("file_name"))
        .withColumn("fields", split_fields(F.col("line"), delimiter))
    )
    fields = F.col("fields")
    return lines.where(F.size("fields") >= len(DEAL_COLUMNS)).select(
        *[_unquoted(fields, i).alias(c) for i, c in enumerate(DEAL_COLUMNS)],
        *[e.alias(n) for n, e in dataset_columns(F.url_decode(F.replace(F.col("file_name"), F.lit("+"), F.lit("%2B")))).items()],
    )


def replace_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Load the files that are there now into a store of :func:`replace_files`, then stop.

    A batch that runs again after a failure replaces what it had written.
    """

    def load(batch: DataFrame, _: int) -> None:
        replace_files(batch, path)

    return df.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_available(spark: SparkSession, folder: str, store: str, checkpoint: str, delimiter: str | None = None, pattern: str = "dataset_*", max_files: int = 100) -> StreamingQuery:
    """Load the deal files that are there now into a store of ``sources.snapshots``, then stop.

    The stream carries the listing; a micro-batch of at most ``max_files`` files is
    scanned as a batch, so a file without rows replaces its old rows too. Files
    are kept by path, so the result does not depend on how they fall into
    batches, and a batch that runs again replaces what it had written.
    """
    listing = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
        .select(*snapshots.FILE_COLUMNS)
    )

    def load(batch: DataFrame, _: int) -> None:
        files = batch.collect()  # max_files rows
        if files:
            listed = batch.sparkSession.createDataFrame(files, batch.schema)
            snapshots.load(scan_deals(batch.sparkSession, [f.path for f in files], delimiter, with_path=True), listed, store)

    return listing.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_available(df: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = ()) -> StreamingQuery:
    """Load everything that is there now to Parquet, then stop."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(availableNow=True).start()
