"""Running sums over keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sums(
    rows: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str], sums: Sequence[str], bands_per_unit: float
) -> DataFrame:
    """Add ``<c>_upto``: the sum of ``c`` over the key's rows up to this one,
    ordered by ``value`` then ``ties``.

    Two levels, so that one key may be as large as it likes: running sums inside
    narrow value bands, plus running sums over the bands' totals.
    """
    banded = rows.withColumn("_band", F.floor(F.col(value) * F.lit(bands_per_unit)).cast("bigint"))
    order = [value, *ties]
    inside = W.partitionBy(*keys, "_band").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy(*keys).orderBy("_band").rowsBetween(W.unboundedPreceding, -1)
    totals = banded.groupBy(*keys, "_band").agg(*[F.sum(c).alias(c) for c in sums])
    before = totals.select(*keys, "_band", *[F.sum(c).over(earlier).alias(f"_{c}_before") for c in sums])
    out = banded.join(before, [*keys, "_band"])
    zero = F.lit(0)
    return out.select(
        *rows.columns,
        *[
            (F.coalesce(F.sum(c).over(inside), zero) + F.coalesce(F.col(f"_{c}_before"), zero)).alias(f"{c}_upto")
            for c in sums
        ],
    )
