"""Spreadsheet grids as tables: cells, merged rectangles, rows, headers.

``cells``: file, sheet, row, col, value (zero-based). ``merged``: file, sheet,
r0, r1, c0, c1 (inclusive).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

KEYS = ("file", "sheet")


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def fill_merged(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """Every blank cell of a merged rectangle takes its top-left value.

    Rectangles become their cells (rows below the sheet's last row do not
    count), so cells and rectangles meet on an equi join of the full position.
    """
    last_row = cells.groupBy(*KEYS).agg(F.max("row").alias("_last"))
    corner = cells.select(*KEYS, F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("value").alias("_fill"))
    inside = (
        merged.join(last_row, list(KEYS))
        .join(corner, [*KEYS, "r0", "c0"])
        .where(~is_blank(F.col("_fill")))
        .withColumn("row", F.explode(F.sequence("r0", F.greatest("r0", F.least("r1", "_last")))))
        .withColumn("col", F.explode(F.sequence("c0", "c1")))
        # where rectangles overlap, the first by its corner fills the cell
        .groupBy(*KEYS, "row", "col")
        .agg(F.min_by("_fill", F.struct("r0", "c0")).alias("_fill"))
    )
    joined = cells.join(inside, [*KEYS, "row", "col"], "full_outer")
    return joined.select(
        *KEYS, "row", "col", F.when(is_blank(F.col("value")), F.coalesce("_fill", "value")).otherwise(F.col("value")).alias("value")
    )


def rectangle_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy(*KEYS).agg(F.count("*").alias("merged_regions"))


def rows_of(cells: DataFrame) -> DataFrame:
    """(file, sheet, row, cells array); gaps are null. A row is as wide as a
    sheet may be, which bounds the list per group."""
    packed = cells.groupBy(*KEYS, "row").agg(
        F.max("col").alias("_width"), F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("_m")
    )
    values = F.transform(F.sequence(F.lit(0), F.col("_width")), lambda i: F.try_element_at("_m", i))
    return packed.select(*KEYS, "row", values.alias("cells"))


def at(cells: Column, index: Column) -> Column:
    """Cell text at an ordinal, '' outside the row or for a missing column."""
    return F.coalesce(F.get(cells, F.when(index >= 0, index)), F.lit(""))
