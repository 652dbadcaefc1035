"""Reconciling two registries that describe the same objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, squeeze

AREA_TOLERANCE = 0.01
VALUE_TOLERANCE = 1.0
ADDRESS_PROBE = 40


def _text(c: Column) -> Column:
    return filled(squeeze(F.lower(c)))


def _check(field: str, match: Column, a: Column, b: Column) -> Column:
    """A check exists only where both sides have the field."""
    return F.when(
        match.isNotNull(),
        F.struct(
            F.lit(field).alias("field"),
            match.alias("match"),
            a.cast("string").alias("value_a"),
            b.cast("string").alias("value_b"),
        ),
    )


def field_checks(a: str = "a", b: str = "b") -> Column:
    """Checks over two struct columns with address, area, value, object_type."""
    ca = lambda f: F.col(f"{a}.{f}")
    cb = lambda f: F.col(f"{b}.{f}")
    aa, ab = _text(ca("address")), _text(cb("address"))
    ta, tb = _text(ca("object_type")), _text(cb("object_type"))
    same_place = (
        (aa == ab)
        | aa.contains(F.substring(ab, 1, ADDRESS_PROBE))
        | ab.contains(F.substring(aa, 1, ADDRESS_PROBE))
    )
    checks = F.array(
        _check("address", same_place, ca("address"), cb("address")),
        _check("area", F.abs(ca("area") - cb("area")) < AREA_TOLERANCE, ca("area"), cb("area")),
        _check("value", F.abs(ca("value") - cb("value")) < VALUE_TOLERANCE, ca("value"), cb("value")),
        _check("object_type", ta.contains(tb) | tb.contains(ta), ca("object_type"), cb("object_type")),
    )
    return F.filter(checks, lambda c: c.isNotNull())


def verdict(checks: Column) -> Column:
    """ok, warning (some differ) or partial (nothing to compare)."""
    total, matched = F.size(checks), F.size(F.filter(checks, lambda c: c["match"]))
    return F.struct(
        F.when(total == 0, F.lit("partial")).when(matched < total, F.lit("warning")).otherwise(F.lit("ok")).alias("status"),
        matched.alias("matched"),
        total.alias("total"),
        F.when(total == 0, F.lit("Сверка по открытым полям недоступна"))
        .when(matched == total, F.format_string("Данные реестров совпадают (%d/%d)", matched, total))
        .otherwise(F.format_string("Есть расхождения: совпало %d из %d", matched, total))
        .alias("summary"),
    )


def reconcile(first: DataFrame, second: DataFrame, key: str = "key") -> DataFrame:
    """Full outer comparison by key: checks, status, counts and a sentence.

    Both inputs have one row per key with address, object_type, area, value and
    found. A side that is missing or not found leaves nothing to compare.
    """
    pack = lambda df, name: df.select(
        key, F.struct("address", "object_type", "area", "value", "found").alias(name)
    )
    joined = pack(first, "a").join(pack(second, "b"), key, "full_outer")
    both = F.coalesce(F.col("a.found") & F.col("b.found"), F.lit(False))
    nothing = F.filter(field_checks(), lambda c: F.lit(False))
    out = joined.withColumn("checks", F.when(both, field_checks()).otherwise(nothing)).withColumn("v", verdict(F.col("checks")))
    summary = F.when(both, F.col("v.summary")).otherwise(F.lit("Недостаточно данных для сверки"))
    return out.select(key, "checks", "v.status", "v.matched", "v.total", summary.alias("summary"))


def verdict_counts(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("status").agg(F.count("*").alias("objects"))


def field_counts(reconciled: DataFrame) -> DataFrame:
    """Agreements and differences per field."""
    return (
        reconciled.select(F.explode("checks").alias("c"))
        .groupBy("c.field")
        .agg(F.count_if("c.match").alias("same"), F.count_if(~F.col("c.match")).alias("different"))
    )
