"""Latest row per key with a time to live, kept up by a stream.

Every micro-batch is reduced to one row per key and stored under its number, so a
retry adds nothing; stored batches are merged level by level (``batches``), each
time to one row per key, so their number stays small however long the stream
runs. Reading takes only the hours that can still be alive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.vehicles import fresh_cache
from . import batches


def keep_latest(stream: DataFrame, key: str, fetched_at: str, path: str, checkpoint: str) -> StreamingQuery:
    """Start (and with availableNow, finish) the upkeep of the latest rows."""
    columns = stream.columns

    def newest(rows: DataFrame) -> DataFrame:
        latest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), fetched_at).alias("r")).select("r.*")
        return latest.withColumn("hour", F.date_trunc("hour", F.col(fetched_at)).cast("string"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batches.keep(newest(batch.where("found")), batch_id, path, newest, ("hour",))

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_fresh(spark: SparkSession, path: str, key: str, fetched_at: str, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """Rows still alive at ``now``; folders of older hours are not opened when
    ``now`` is a literal."""
    table = batches.read(spark, path)
    oldest = F.date_trunc("hour", now - F.make_dt_interval(secs=F.lit(ttl_seconds))).cast("string")
    alive = table.where(F.col("hour").cast("string") >= oldest).drop("hour")
    return fresh_cache(alive, key, fetched_at, now, ttl_seconds)
