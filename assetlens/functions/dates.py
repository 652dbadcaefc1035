"""Dates as they come in work exports and documents; working calendar."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import extract, let, strip

_ISO = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[ T]([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?)?"
_DMY = r"^([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4})(?:\s+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?)?"
_SERIAL = r"^[0-9]+(\.[0-9]+)?$"

# fixed values: public holidays as month-day
HOLIDAYS = (
    "01-01", "01-02", "01-03", "01-04", "01-05", "01-06", "01-07", "01-08",
    "02-23", "03-08", "05-01", "05-09", "06-12", "11-04",
)

# fixed values: extra days off moved by decree
EXTRA_DAYS_OFF = ("2026-01-09", "2026-03-09", "2026-05-11", "2026-12-31")


def _int(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("int")


def _from_groups(c: Column, pattern: str, y: int, m: int, d: int) -> Column:
    part = lambda g: F.coalesce(_int(c, pattern, g), F.lit(0))
    return F.when(
        c.rlike(pattern),
        F.try_make_timestamp_ntz(
            _int(c, pattern, y),
            _int(c, pattern, m),
            _int(c, pattern, d),
            part(4),
            part(5),
            part(6).cast("decimal(16,6)"),
        ),
    )


def parse_datetime(c: Column) -> Column:
    """Cell text to a zone-less timestamp.

    Accepts a spreadsheet serial (days from 1899-12-30), ``y-m-d[ h:m[:s]]``
    and ``d.m.y`` / ``d/m/y`` with an optional time, each as a prefix.
    Impossible dates such as 31.02 are null rather than rolled over.
    """
    s = strip(c)
    serial = F.when(s.rlike(_SERIAL), s.try_cast("double"))
    # whole seconds, as the millisecond result is cut
    seconds = F.floor(F.floor((serial - 25569) * 86400000 + 0.5) / 1000)
    from_serial = F.make_timestamp_ntz(
        F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")
    ) + F.make_dt_interval(days=F.lit(0), hours=F.lit(0), mins=F.lit(0), secs=seconds.cast("decimal(18,6)"))
    return F.coalesce(
        F.when(serial < 3000000, from_serial),
        _from_groups(s, _ISO, 1, 2, 3),
        _from_groups(s, _DMY, 3, 2, 1),
    )


def parse_date(c: Column) -> Column:
    return parse_datetime(c).cast("date")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds between two zone-less timestamps (no clock changes)."""
    clock = lambda t: F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t))
    days = F.datediff(end.cast("date"), start.cast("date")).cast("bigint")
    return days * 86400 + clock(end) - clock(start)


def term_hours(start_cell: Column, end_cell: Column) -> Column:
    return seconds_between(parse_datetime(start_cell), parse_datetime(end_cell)) / 3600.0


def term_days(start_cell: Column, end_cell: Column) -> Column:
    return term_hours(start_cell, end_cell) / 24.0


def quarter_start(d: Column) -> Column:
    return F.trunc(d, "quarter")


def is_workday(d: Column, days_off: Iterable[str] = EXTRA_DAYS_OFF) -> Column:
    """Monday to Friday, neither a public holiday nor a moved day off."""
    return (
        (F.weekday(d) < 5)
        & ~F.date_format(d, "MM-dd").isin(*HOLIDAYS)
        & ~d.cast("string").isin(*list(days_off))
    )


def _weekdays_upto(d: Column) -> Column:
    """Mondays to Fridays from a Monday long ago up to ``d``."""
    days = F.datediff(d, F.lit("1799-12-30").cast("date")) + 1  # a Monday
    return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(5))


def workdays_between(start: Column, end: Column, days_off: Iterable[str] = EXTRA_DAYS_OFF) -> Column:
    """Inclusive count of workdays; 0 when ``end`` is before ``start`` or a date is missing.

    By difference: weekdays up to either end, less the holidays and days off between
    that fall on one. No list of days, so a span may be of any length from 1800 on.
    """
    off = F.array(*[F.lit(d).cast("date") for d in sorted(set(days_off)) if d[5:] not in HOLIDAYS]).cast("array<date>")
    marks = F.array(*[F.lit(int(h[:2]) * 100 + int(h[3:])) for h in HOLIDAYS])

    def of_year(y: Column) -> Column:
        return F.transform(marks, lambda m: F.make_date(y, (m / 100).cast("int"), m % 100))

    def count(span: Column) -> Column:
        first, last = span["first"], span["last"]
        free = F.concat(off, F.flatten(F.transform(F.sequence(F.year(first), F.year(last)), of_year)))
        missing = F.size(F.filter(free, lambda d: (F.weekday(d) < 5) & d.between(first, last)))
        weekdays = _weekdays_upto(last) - _weekdays_upto(F.date_sub(first, 1))
        return F.when(last >= first, (weekdays - missing).cast("int")).otherwise(0)

    return let(F.struct(start.alias("first"), end.alias("last")), count)


def calendar(spark: SparkSession, start: str, end: str, days_off: Iterable[str] = EXTRA_DAYS_OFF) -> DataFrame:
    """One row per day: ``day``, ``is_workday``."""
    day = F.col("day")
    return spark.sql(
        f"SELECT explode(sequence(DATE'{start}', DATE'{end}')) AS day"
    ).select(day, is_workday(day, days_off).alias("is_workday"))


def absence_periods(c: Column, year: int) -> Column:
    """``dd.mm-dd.mm; dd.mm`` to an array of (from, to) dates of that year.

    A trailing point is allowed on either side; other chunks are dropped.
    """
    span = r"^([0-9]{1,2})\.([0-9]{1,2})\.?\s*-\s*([0-9]{1,2})\.([0-9]{1,2})\.?$"
    single = r"^([0-9]{1,2})\.([0-9]{1,2})\.?$"

    def day(x: Column, pattern: str, d: int, m: int) -> Column:
        text = F.concat_ws(
            "-",
            F.lit(str(year)),
            F.lpad(F.regexp_extract(x, pattern, m), 2, "0"),
            F.lpad(F.regexp_extract(x, pattern, d), 2, "0"),
        )
        return F.when(x.rlike(pattern), text.try_cast("date"))

    def period(x: Column) -> Column:
        return F.struct(
            F.coalesce(day(x, span, 1, 2), day(x, single, 1, 2)).alias("from"),
            F.coalesce(day(x, span, 3, 4), day(x, single, 1, 2)).alias("to"),
        )

    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: period(strip(x)))
    return F.filter(parts, lambda p: p["from"].isNotNull() & p["to"].isNotNull())


def iso_from_dmy(c: Column) -> Column:
    """``d-m-y`` with any of ``- . /`` (or year first) to ``yyyy-mm-dd`` text."""
    pad = lambda x: F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)

    def joined(p: Column) -> Column:
        part = lambda i: F.get(p, F.lit(i))
        year_first = F.length(part(0)) == 4
        year = F.when(year_first, part(0)).when(F.length(part(2)) == 2, F.concat(F.lit("20"), part(2))).otherwise(part(2))
        day = F.when(year_first, part(2)).otherwise(part(0))
        return F.when(F.size(p) == 3, F.concat_ws("-", year, pad(part(1)), pad(day)))

    return let(F.split(F.translate(F.trim(c), "./", "--"), "-"), joined)


def period_label(year: Column, quarter: Column) -> Column:
    """``N кв YYYY``"""
    return F.concat(quarter.cast("string"), F.lit(" кв "), year.cast("string"))


def period_key(label: Column) -> Column:
    """``N кв YYYY`` to year*10 + quarter, unreadable to null."""
    pattern = r"^([0-9])\s+кв\s+([0-9]{4})$"
    year, quarter = (extract(label, pattern, g).try_cast("int") for g in (2, 1))
    return year * 10 + quarter
