"""Workload indicators per day and line from a request stream.

``daily_line_kpis`` puts a day out once, when the watermark has closed it.
``keep_days`` has every day out at any time, open ones too: a batch adds sums that
are merged when read, and rows that come after their day closed are stored as
they are, so days and late rows together are the whole input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import batches

SUMS = ("apps", "minutes", "overdue", *(f"csi_{b}" for b in range(1, 6)))


def _sums() -> list[Column]:
    return [
        F.count("*").alias("apps"),
        F.sum("minutes").alias("minutes"),
        F.count_if("overdue").alias("overdue"),
        *[F.count_if(F.col("csi") == b).alias(f"csi_{b}") for b in range(1, 6)],
    ]


def daily_line_kpis(requests: DataFrame, ts: str = "ts", line: str = "line", lateness: str = "1 day") -> DataFrame:
    """Requests, minutes, overdue and score counts per (day, line).

    A day is final once the watermark has passed it; later rows are dropped.
    Only the sums of open days are held as state.
    """
    return (
        requests.withWatermark(ts, lateness)
        .groupBy(F.window(ts, "1 day").alias("w"), line)
        .agg(*_sums())
        .select(F.col("w.start").cast("date").alias("day"), line, "apps", "minutes", "overdue", *[f"csi_{b}" for b in range(1, 6)])
    )


def keep_days(requests: DataFrame, root: str, checkpoint: str, ts: str = "ts", line: str = "line", lateness: str = "1 day") -> StreamingQuery:
    """Keep sums per (day, line) and late rows under ``root``; what is there now is loaded, then the stream stops.

    A row is late if its day ended by the watermark: ``lateness`` before the
    greatest time of all earlier batches. Rows without a time belong to no day and
    are late. A batch that runs again replaces what it had stored.
    """

    def merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("day", line).agg(*[F.sum(c).alias(c) for c in SUMS], F.max("seen").alias("seen"))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = [f for f in batches.folders(spark, f"{root}/days") if f["first"] != batch_id]
        before = _seen(spark, root, batch_id) if earlier else None
        mark = F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {lateness}")
        day_end = F.date_trunc("day", ts) + F.expr("INTERVAL 1 DAY")
        late = F.col(ts).isNull() | F.coalesce(day_end <= mark, F.lit(False))
        rows = batch.withColumn("_late", late)
        days = rows.where("NOT _late").groupBy(F.to_date(ts).alias("day"), line).agg(*_sums(), F.max(ts).alias("seen"))
        batches.keep(days, batch_id, f"{root}/days", merged)
        batches.keep(rows.where("_late").drop("_late"), batch_id, f"{root}/late", lambda several: several)

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _seen(spark: SparkSession, root: str, batch_id: int | None = None):
    """Greatest time of all batches before ``batch_id``."""
    return batches.read(spark, f"{root}/days", before=batch_id).agg(F.max("seen")).first()[0]


def read_days(spark: SparkSession, root: str, line: str = "line", lateness: str = "1 day") -> DataFrame:
    """(day, line, sums, closed) of every day so far; a closed day takes no more rows."""
    mark = F.lit(_seen(spark, root)).cast("timestamp") - F.expr(f"INTERVAL {lateness}")
    days = batches.read(spark, f"{root}/days").groupBy("day", line).agg(*[F.sum(c).alias(c) for c in SUMS])
    closed = F.coalesce((F.col("day") + F.expr("INTERVAL 1 DAY")).cast("timestamp") <= mark, F.lit(False))
    return days.withColumn("closed", closed)


def read_late(spark: SparkSession, root: str) -> DataFrame:
    """The rows that came after their day had closed."""
    return batches.read(spark, f"{root}/late")
