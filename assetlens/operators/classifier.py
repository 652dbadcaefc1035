"""Code -> label look-ups and the deal category rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import digits_only
from ..functions.text import lookup, strip

# fixed values: object types and the deal category each leads to
LAND, BUILDING, PREMISES, PARKING = "002001001000", "002001002000", "002001003000", "002001009000"
CATEGORIES = {
    "land": "Земельные участки",
    "house": "Жилые дома",
    "nonres": "Нежилые здания/помещения",
    "flat": "Жилые помещения",
    "parking": "Машиноместа",
}
# fixed values: purposes by label and by code prefix
RESIDENTIAL_LABELS = ("Жилое", "Жилое строение", "Садовый дом")
NONRESIDENTIAL_LABELS = ("Нежилое",)
RESIDENTIAL_PREFIXES = ("204002", "206002", "204004", "204005")
NONRESIDENTIAL_PREFIXES = ("204001", "206001")


def padded_code(code: Column) -> Column:
    """Digits of a code, zero-filled to twelve."""
    d = digits_only(code)
    return F.when(F.length(d) < 12, F.lpad(d, 12, "0")).otherwise(d)


def _stripped(code: Column) -> Column:
    return F.regexp_replace(code, "^0+", "")


def lookup_tables(codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dictionary by exact code and by code without leading zeros.

    ``codes`` has code, label and pos (file order). Prepare once, join often.
    """
    exact = codes.groupBy("code").agg(F.min_by("label", "pos").alias("label"))
    by_stripped = codes.groupBy(_stripped(F.col("code")).alias("code")).agg(F.min_by("label", "pos").alias("label"))
    return exact, by_stripped


def with_label(df: DataFrame, code: str, out: str, codes: DataFrame, fallback: Column | None = None) -> DataFrame:
    """Add the label of ``code``: exact, zero-filled, then zero-stripped match;
    else a fallback that is no code itself; else the code.

    Three equi joins on prepared keys. The dictionary is small; Spark picks the
    broadcast by its measured size.
    """
    exact, stripped = lookup_tables(codes)
    c = F.col(code)
    raw = strip(c)
    keyed = df.withColumns({"_k1": raw, "_k2": padded_code(raw), "_k3": _stripped(raw)})
    joined = (
        keyed.join(exact.select(F.col("code").alias("_k1"), F.col("label").alias("_l1")), "_k1", "left")
        .join(exact.select(F.col("code").alias("_k2"), F.col("label").alias("_l2")), "_k2", "left")
        .join(stripped.select(F.col("code").alias("_k3"), F.col("label").alias("_l3")), "_k3", "left")
    )
    given = c.isNotNull() & (c != "")
    label = F.when(given, F.coalesce(F.col("_l1"), F.col("_l2"), F.col("_l3")))
    if fallback is not None:
        spare = F.when((fallback != "") & ~strip(fallback).rlike("^[0-9]{11,12}$"), fallback)
        label = F.coalesce(label, spare)
        last = F.when(given, c).otherwise(fallback)
    else:
        last = F.when(given, c)
    return joined.select(*[F.col(x) for x in df.columns if x != out], F.coalesce(label, last).alias(out))


def with_label_list(df: DataFrame, key: list[str], codes_column: str, out: str, codes: DataFrame) -> DataFrame:
    """Labels of a ``a;b;c`` code list, in order, joined by ``"; "``.

    Distinct lists are labelled once and joined back, so a list that fills a
    third of all rows costs one row here.
    """
    c = F.col(codes_column)
    parts = F.filter(F.transform(F.split(c, ";+"), strip), lambda x: x != "")
    lists = df.where(c.isNotNull()).select(codes_column).distinct()
    items = lists.select(codes_column, F.posexplode(parts).alias("_pos", "_code"))
    labelled = with_label(items, "_code", "_label", codes, fallback=F.col("_code"))
    joined = labelled.groupBy(codes_column).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_label"))), lambda s: s["_label"]), "; "
        ).alias(out)
    )
    return df.drop(out).join(joined, codes_column, "left").select(*[x for x in df.columns if x != out], out)


def purpose_kind(code: Column, label: Column) -> Column:
    """Residential or not: by the label first, then by the code's prefix."""
    digits = digits_only(code)
    starts = lambda prefixes: digits.rlike("^(" + "|".join(prefixes) + ")")
    return (
        F.when(label.isin(*RESIDENTIAL_LABELS), F.lit("residential"))
        .when(label.isin(*NONRESIDENTIAL_LABELS), F.lit("nonresidential"))
        .when(starts(RESIDENTIAL_PREFIXES), F.lit("residential"))
        .when(starts(NONRESIDENTIAL_PREFIXES), F.lit("nonresidential"))
    )


def deal_category(type_code: Column, purpose: Column) -> Column:
    t = padded_code(type_code)
    return (
        F.when(t == LAND, F.lit("land"))
        .when(t == PARKING, F.lit("parking"))
        .when(t == PREMISES, F.when(purpose == "residential", F.lit("flat")).otherwise(F.lit("nonres")))
        .when(t == BUILDING, F.when(purpose == "nonresidential", F.lit("nonres")).otherwise(F.lit("house")))
        .otherwise(F.lit("nonres"))
    )


def category_label(category: Column) -> Column:
    return F.coalesce(lookup(CATEGORIES, category), F.lit("Прочее"))
