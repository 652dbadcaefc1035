"""Positions in one global order, without one task that sorts everything."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

_ROW_BITS = 33  # of monotonically_increasing_id, below the partition number


def with_rank(rows: DataFrame, order: Sequence[Column], out: str = "rank", ranges: int | None = None) -> DataFrame:
    """``rows`` with ``out``: the position from 1 in ``order``, as long.

    Rows are cut into ranges of the order and sorted inside each; a row's position
    is its place in the range plus the rows of the ranges before, of which there
    is one line each. The cut rows are written, as ranges are found by sampling and
    must not change between counting and numbering. ``order`` should end in what
    tells rows apart: then many rows of one value spread over ranges too, and
    positions are the same in every run. Rows alike in all of ``order`` share no
    position; which of them comes first is open. Collated columns order as their
    collation says. Empty in, empty out; ``rows`` may not have a column ``_at``.
    """
    spark = rows.sparkSession
    cut = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    path = shared_dir(spark, f"ranked-{uuid.uuid4().hex}")
    cut.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    of_range = F.call_function("shiftright", F.col("_at"), F.lit(_ROW_BITS))
    sizes = stored.groupBy(of_range.alias("_range")).agg(F.count(F.lit(1)).alias("n"))
    # one line a range, so the array of all of them is small whatever the rows are
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct("_range", "n"))).alias("s"))
    before = F.transform(
        F.sequence(F.lit(1), F.size("s")),
        lambda i: F.struct(F.element_at("s", i)["_range"].alias("_range"), F.aggregate(F.slice("s", F.lit(1), i - 1), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("_before")),
    )
    starts = listed.where(F.size("s") > 0).select(F.inline(before))
    place = F.col("_at") - F.col("_range") * F.lit(1 << _ROW_BITS) + 1
    return stored.withColumn("_range", of_range).join(starts, "_range").select(*rows.columns, (F.col("_before") + place).alias(out))
