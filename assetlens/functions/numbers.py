"""Number cleaning. Each source has its own dialect; they are not merged.

Only plain decimals count as numbers (no hex, no exponent, no NaN).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, non_empty

PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"


def _plain(c: Column) -> Column:
    return F.when(c.rlike(PLAIN_NUMBER), c.try_cast("double"))


def _no_blanks(c: Column) -> Column:
    return F.regexp_replace(c, WS, "")


def _first_comma_to_dot(c: Column) -> Column:
    return F.regexp_replace(c, r"^([^,]*),", "$1.")


def price_number(c: Column) -> Column:
    """Deal price: blanks go, a decimal comma is not accepted."""
    return _plain(_no_blanks(c))


def area_number(c: Column) -> Column:
    """Deal area and registry numbers: blanks go, first comma is the point."""
    return _plain(_first_comma_to_dot(_no_blanks(c)))


registry_number = area_number


def work_number(c: Column) -> Column:
    """Work-export cell: as area, blank or bad is 0."""
    return F.coalesce(area_number(c), F.lit(0.0))


def register_number(c: Column) -> Column:
    """Register cell: keep digits, comma, point, minus; all commas are points;
    anything else unreadable is 0."""
    kept = F.translate(F.regexp_replace(c, r"[^0-9,.\-]", ""), ",", ".")
    return F.coalesce(_plain(kept), F.lit(0.0))


def digits_number(c: Column) -> Column:
    """Listing price: all digits of the text, or null."""
    return F.regexp_replace(c, r"[^0-9]", "").try_cast("bigint")


def distance_km(c: Column) -> Column:
    """Kilometres from text such as ``12,5 км``."""
    return _plain(F.regexp_extract(_first_comma_to_dot(c), r"(?iu)([0-9.]+)(?U:\s*)км", 1))


def filter_number(c: Column) -> Column:
    """Number typed into a report filter."""
    return _plain(F.regexp_replace(_first_comma_to_dot(_no_blanks(c)), r"[^0-9.\-]", ""))


def round_half_up(c: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(c + F.lit(0.5))


def money_text(c: Column) -> Column:
    """``1234567.5`` as ``1 234 567,50``; a zero fraction is dropped."""
    text = F.translate(F.format_number(F.coalesce(c, F.lit(0.0)), 2), ",.", " ,")
    return F.regexp_replace(text, ",00$", "")


def price_text(c: Column, unit: str = "₽") -> Column:
    """Whole roubles with no-break spaces; null for nothing or zero."""
    text = F.translate(F.format_number(c, 0), ",", "\u00a0")
    return F.when(c.isNotNull() & (c != 0), F.concat(text, F.lit(f"\u00a0{unit}")))


def collateral_from_discount(cost: Column, discount: Column) -> Column:
    """Cost less the discount per cent, rounded half to even."""
    return (
        F.when(cost <= 0, F.lit(0.0))
        .when(discount <= 0, F.bround(cost, 0))
        .when(discount >= 100, F.lit(0.0))
        .otherwise(F.bround(cost * (1 - discount / 100), 0))
    )


def csi_score(c: Column) -> Column:
    """A satisfaction score of 1..5, else null."""
    n = work_number(c)
    return F.when(n.between(1, 5), n)


def csi_bucket(c: Column) -> Column:
    return round_half_up(csi_score(c)).cast("int")


def load_percent(minutes: Column, plan_hours: Column) -> Column:
    """Minutes worked against planned hours; 999 marks work without a plan."""
    return F.when(
        plan_hours <= 0, F.when(minutes > 0, F.lit(999.0)).otherwise(F.lit(0.0))
    ).otherwise(minutes * 100.0 / (plan_hours * 60))


def digits_only(c: Column) -> Column:
    return non_empty(F.regexp_replace(c, "[^0-9]", ""))
