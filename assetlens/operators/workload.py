"""Employee-workload indicators from request exports, absences and a calendar.

A request table has file, sheet, row_no and ``cells`` (array of text). Headers
come as one row per (file, sheet) with a ``headers`` array. Roster and absences
are input tables; nothing about people is built in.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import EXTRA_DAYS_OFF, parse_date, parse_datetime, quarter_start, seconds_between, workdays_between
from ..functions.numbers import csi_bucket, load_percent, work_number
from ..functions.text import first_by_rules, fold_yo, squeeze, strip
from .ranking import with_rank

# fixed values: ordinals of the export's columns
START, END, RETURNS, PERSON, SEGMENT, OVERDUE, TAG, PRIORITY, SCORE = 18, 19, 22, 24, 31, 32, 33, 37, 39

# fixed values: standard minutes per request
MINUTES = {"l1": 24, "inspection": 20, "online": 20, "online_arb": 210, "mdo": 20, "mdo_arb": 150, "mdo_fzh": 240}
HOURS_PER_DAY = 8

# fixed values: line kinds by words in the export's name
KIND_RULES = (
    (r"1[-\s]?я\s*линия|первая\s*линия|линия\s*поддержк", "l1"),
    (r"работа\s*с\s*оо|онлайн\s*оценк", "online"),
    (r"осмотр", "inspection"),
)
# fixed values: segments, first hit wins
SEGMENT_RULES = (
    (r"малого|(^|[^а-яa-z])ммб([^а-яa-z]|$)", "ММБ"),
    (r"данных", "ПМЗ"),
    (r"документарных", "ПКД"),
    (r"залоговой", "ЗС"),
    (r"проблем", "ПРПА"),
    (r"корпоративн|(^|[^а-яa-z])ксб([^а-яa-z]|$)", "КСБ"),
)
SEGMENTS = ("ММБ", "КСБ", "ПМЗ", "ЗС", "ПКД", "ПРПА", "Прочее")
# fixed values: territories, first hit wins
TERRITORY_RULES = (
    (r"центрально[-\s]?черноземн", "ЦЧБ"),
    (r"дальневосточн", "ДВБ"),
    (r"северо[-\s]?западн", "СЗБ"),
    (r"юго[-\s]?западн", "ЮЗБ"),
    (r"волго[-\s]?вятск", "ВВБ"),
    (r"среднерусск", "СРБ"),
    (r"поволжск", "ПБ"),
    (r"уральск", "УБ"),
    (r"байкальск", "ББ"),
    (r"сибирск", "СБ"),
    (r"московск", "МБ"),
    (r"центрального\s+подчинен|подразделен[a-z0-9_]*\s+центральн", "ТМ"),
)
TERRITORIES = ("МБ", "СРБ", "ВВБ", "ПБ", "УБ", "СБ", "ББ", "ДВБ", "СЗБ", "ЮЗБ", "ЦЧБ", "ТМ")
PRIORITY_SEGMENTS = ("КСБ", "ММБ")
KINDS_WITH_SEGMENTS = ("mdo", "l1", "online")


# --- column rules ---------------------------------------------------------------


def line_kind(file_name: Column) -> Column:
    return first_by_rules(F.lower(file_name), KIND_RULES, F.lit("mdo"))


def line_name(file_name: Column) -> Column:
    """Export name before the first underscore, without the extension."""
    base = strip(F.regexp_replace(file_name, r"(?i)\.xlsx?$", ""))
    name = strip(F.substring_index(base, "_", 1))
    return F.when(name == "", base).otherwise(name)


def is_arbitration(c: Column) -> Column:
    return F.coalesce(c.rlike("(?iu)арбитраж"), F.lit(False))


def is_fzh(c: Column) -> Column:
    return F.coalesce(c.rlike("(?iu)фжн"), F.lit(False))


def is_overdue(c: Column) -> Column:
    return F.coalesce(strip(c).rlike("(?iu)^да$"), F.lit(False))


def is_priority(c: Column) -> Column:
    return F.coalesce(c.rlike("(?iu)приоритет"), F.lit(False))


def request_minutes(kind: Column, arbitration: Column, fzh: Column) -> Column:
    """Standard minutes of one request; tags count on some lines only."""
    m = {k: F.lit(v) for k, v in MINUTES.items()}
    return (
        F.when(kind == "l1", m["l1"])
        .when(kind == "inspection", m["inspection"])
        .when(kind == "online", F.when(arbitration, m["online_arb"]).otherwise(m["online"]))
        .otherwise(F.when(fzh, m["mdo_fzh"]).when(arbitration, m["mdo_arb"]).otherwise(m["mdo"]))
    )


def segment(c: Column) -> Column:
    return first_by_rules(fold_yo(F.coalesce(c, F.lit(""))), SEGMENT_RULES, F.lit("Прочее"))


def territory(c: Column) -> Column:
    return first_by_rules(fold_yo(c), TERRITORY_RULES)


def person_name(c: Column) -> Column:
    """Name before a bracket; dashes and nothing are ''."""
    raw = squeeze(F.coalesce(c, F.lit("")))
    return F.when(raw.isin("-", "—"), F.lit("")).otherwise(F.trim(F.substring_index(raw, "(", 1)))


def surname_key(c: Column) -> Column:
    """First word, lower case, ё as е."""
    return fold_yo(F.substring_index(squeeze(c), " ", 1))


def in_quarter(day: Column, as_of: Column) -> Column:
    """From the quarter's first day to the as-of day, inclusive."""
    return F.coalesce(day.between(quarter_start(as_of), as_of), F.lit(False))


# --- column inference -----------------------------------------------------------


def infer_columns(headers: DataFrame, requests: DataFrame, sample_rows: int = 40) -> DataFrame:
    """Person, tag and date ordinals per (file, sheet).

    Header words first; then the fixed ordinal of a wide table; then the share
    of matching cells among the first rows. The sample bounds what is grouped.
    """
    keys = ["file", "sheet"]
    sample = requests.where(F.col("row_no") < sample_rows)
    cells = sample.select(*keys, F.posexplode("cells").alias("col", "cell")).where("cell IS NOT NULL AND cell <> ''")
    rates = cells.groupBy(*keys, "col").agg(
        F.count("*").alias("seen"),
        F.count_if(F.col("cell").rlike(r"\(.*[0-9]")).alias("names"),
        F.count_if(parse_date(F.col("cell")).isNotNull()).alias("dates"),
    )
    enough = F.col("seen") >= 5
    named = enough & (F.col("names") / F.col("seen") >= 0.5)
    dated = enough & (F.col("dates") / F.col("seen") >= 0.6) & (F.col("col") != PERSON)
    guesses = rates.groupBy(*keys).agg(
        F.min(F.when(named, F.col("col"))).alias("name_col"),
        F.max_by(F.when(dated, F.col("col")), F.when(dated, F.struct("dates", -F.col("col")))).alias("date_guess"),
    )
    widths = sample.groupBy(*keys).agg(F.max(F.size("cells")).alias("width"))

    def header_hit(pattern: str) -> Column:
        h = F.transform(F.col("headers"), lambda x: F.coalesce(strip(x), F.lit("")))
        at = F.array_position(F.transform(h, lambda x: x.rlike(pattern)), F.lit(True))
        return F.when(at > 0, (at - 1).cast("int"))

    width = F.greatest(F.size("headers"), F.coalesce("width", F.lit(0)))
    return (
        headers.join(widths, keys, "left")
        .join(guesses, keys, "left")
        .select(
            *keys,
            F.coalesce(
                header_hit("(?iu)фио|сотрудник|исполнитель|эксперт|закрепл"),
                F.when(width > PERSON, F.lit(PERSON)),
                F.col("name_col"),
                F.lit(-1),
            ).alias("person_col"),
            F.coalesce(header_hit("(?iu)^тег$"), F.lit(TAG)).alias("tag_col"),
            F.coalesce(header_hit("(?iu)дат|создан|регистр|поступ|завед"), F.col("date_guess"), F.lit(-1)).alias("date_col"),
        )
    )


def typed_requests(requests: DataFrame, columns: DataFrame, roster: DataFrame, as_of: Column) -> DataFrame:
    """One typed row per request with its first reject ``reason`` (null = used).

    ``roster`` holds person_key values; membership is by surname key.
    """
    cell = lambda i: F.get("cells", F.lit(i))
    at = lambda c: F.get("cells", F.when(F.col(c) >= 0, F.col(c)))
    base = (
        requests.join(columns.select("file", "sheet", "person_col", "tag_col"), ["file", "sheet"], "left")
        .withColumn("person", person_name(F.when(F.col("person_col") >= 0, at("person_col")).otherwise(cell(PERSON))))
        .withColumn("person_key", surname_key(F.col("person")))
    )
    members = roster.select(surname_key(F.col("person_key")).alias("person_key")).distinct()
    base = base.join(members.withColumn("on_roster", F.lit(True)), "person_key", "left")
    started, ended = parse_datetime(cell(START)), parse_datetime(cell(END))
    tag = at("tag_col")
    kind = line_kind(F.col("file"))
    seg = cell(SEGMENT)
    reason = (
        F.when(F.col("person") == "", F.lit("no name"))
        .when(F.col("on_roster").isNull(), F.lit("not on roster"))
        .when(~in_quarter(ended.cast("date"), as_of), F.lit("out of period"))
    )
    return base.select(
        "file",
        "sheet",
        "row_no",
        "person",
        kind.alias("kind"),
        line_name(F.col("file")).alias("line"),
        ended.cast("date").alias("day"),
        is_arbitration(tag).alias("arbitration"),
        is_fzh(tag).alias("fzh"),
        seconds_between(started, ended).alias("term_seconds"),
        is_overdue(cell(OVERDUE)).alias("overdue"),
        work_number(cell(RETURNS)).alias("returns"),
        csi_bucket(cell(SCORE)).alias("csi"),
        segment(seg).alias("segment"),
        territory(seg).alias("territory"),
        is_priority(cell(PRIORITY)).alias("priority"),
        reason.alias("reason"),
    ).withColumn("minutes", request_minutes(F.col("kind"), F.col("arbitration"), F.col("fzh")))


def used(typed: DataFrame) -> DataFrame:
    return typed.where("reason IS NULL")


# --- indicators -----------------------------------------------------------------

_SUMMED = (
    "apps", "apps_arb", "apps_fzh", "apps_l1", "apps_online", "minutes", "term_seconds", "term_n", "overdue",
    "returns", "csi_1", "csi_2", "csi_3", "csi_4", "csi_5",
)


def kpi_parts(requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mergeable sums per ``keys``; everything else is a re-aggregation of them."""
    kind, arb, fzh = F.col("kind"), F.col("arbitration"), F.col("fzh")
    return requests.groupBy(*keys).agg(
        F.count("*").alias("apps"),
        F.count_if(arb & ((kind == "online") | ((kind == "mdo") & ~fzh))).alias("apps_arb"),
        F.count_if(fzh & (kind == "mdo")).alias("apps_fzh"),
        F.count_if(kind == "l1").alias("apps_l1"),
        F.count_if(kind == "online").alias("apps_online"),
        F.sum("minutes").alias("minutes"),
        F.sum("term_seconds").alias("term_seconds"),
        F.count("term_seconds").alias("term_n"),
        F.count_if("overdue").alias("overdue"),
        F.sum("returns").alias("returns"),
        *[F.count_if(F.col("csi") == b).alias(f"csi_{b}") for b in range(1, 6)],
    )


def merge_kpis(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    out = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMMED])
    return with_average_term(out)


def with_average_term(kpis: DataFrame) -> DataFrame:
    """Mean from sums, never a mean of means."""
    hours = F.col("term_seconds") / 3600.0
    return kpis.withColumn("term_hours", hours).withColumn("avg_term_hours", F.try_divide(hours, F.col("term_n")))


def person_line_kpis(requests: DataFrame) -> DataFrame:
    return kpi_parts(requests, ["person", "line", "kind"])


def employee_kpis(person_lines: DataFrame) -> DataFrame:
    return merge_kpis(person_lines, ["person"])


def line_kpis(person_lines: DataFrame) -> DataFrame:
    """Per line, busiest first, then by name in Russian order."""
    return merge_kpis(person_lines, ["line", "kind"]).orderBy(*by_size())


def by_size() -> list[Column]:
    return [F.desc("apps"), F.collate("line", "ru").asc(), F.col("line").asc(), F.col("kind").asc()]


def with_line_rank(person_lines: DataFrame) -> DataFrame:
    """:func:`line_kpis` with ``rank``, the position in its order."""
    return with_rank(merge_kpis(person_lines, ["line", "kind"]), by_size())


def total_kpis(person_lines: DataFrame) -> DataFrame:
    return merge_kpis(person_lines)


def csi_histogram(kpis: DataFrame) -> DataFrame:
    return kpis.withColumn("csi_counts", F.array(*[f"csi_{b}" for b in range(1, 6)]))


def reject_counts(typed: DataFrame) -> DataFrame:
    return typed.groupBy(F.coalesce("reason", F.lit("used")).alias("reason")).agg(F.count("*").alias("rows"))


def _grid(df: DataFrame, **dims: Sequence[str]) -> DataFrame:
    """All combinations of a few fixed labels."""
    grid = df.sparkSession.range(1)
    for name, labels in dims.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(x) for x in labels])))
    return grid.drop("id")


def segment_counts(requests: DataFrame) -> DataFrame:
    """Requests per (kind, segment), zero where there are none."""
    counts = requests.where(F.col("kind").isin(*KINDS_WITH_SEGMENTS)).groupBy("kind", "segment").agg(F.count("*").alias("n"))
    return (
        _grid(requests, kind=KINDS_WITH_SEGMENTS, segment=SEGMENTS)
        .join(counts, ["kind", "segment"], "left")
        .select("kind", "segment", F.coalesce("n", F.lit(0)).alias("apps"))
    )


def priority_counts(requests: DataFrame) -> DataFrame:
    """Priority requests per (segment, territory) and per segment ('all')."""
    hits = requests.where(
        F.col("priority") & F.col("segment").isin(*PRIORITY_SEGMENTS) & F.col("territory").isNotNull()
    )
    cells = hits.groupBy("segment", "territory").agg(F.count("*").alias("n"))
    rolled = cells.groupingSets([["segment", "territory"], ["segment"]], "segment", "territory").agg(F.sum("n").alias("n"))
    rolled = rolled.withColumn("territory", F.coalesce("territory", F.lit("all")))
    return (
        _grid(requests, segment=PRIORITY_SEGMENTS, territory=[*TERRITORIES, "all"])
        .join(rolled, ["segment", "territory"], "left")
        .select("segment", "territory", F.coalesce("n", F.lit(0)).alias("apps"))
    )


# --- plan and absences ----------------------------------------------------------


def team_plan_hours(as_of: Column, days_off: Iterable[str] = EXTRA_DAYS_OFF) -> Column:
    """Eight hours per workday from the quarter's start; never below one day."""
    days = workdays_between(quarter_start(as_of), as_of, days_off)
    return F.greatest(days, F.lit(1)) * HOURS_PER_DAY


def resolve_absences(people: DataFrame, standing: DataFrame, overrides: DataFrame) -> DataFrame:
    """Absence periods per person.

    ``standing`` (person_key, from, to) goes by surname key. ``overrides``
    (person, from, to) hides it for a full name, also with an empty list, which
    is one row with null dates.
    """
    named = overrides.select("person").distinct()
    by_schedule = (
        people.join(named, "person", "left_anti")
        .withColumn("person_key", surname_key(F.col("person")))
        .join(standing.select(surname_key(F.col("person_key")).alias("person_key"), "from", "to"), "person_key")
        .select("person", "from", "to")
    )
    by_name = people.join(overrides, "person").select("person", "from", "to")
    return by_schedule.unionByName(by_name).where(F.col("from").isNotNull() & F.col("to").isNotNull())


def absence_days(absences: DataFrame, as_of: Column, days_off: Iterable[str] = EXTRA_DAYS_OFF) -> DataFrame:
    """Workdays of the quarter each person missed, overlaps counted once."""
    return missed_workdays(absences, quarter_start(as_of), as_of, days_off)


def missed_workdays(absences: DataFrame, start: Column, end: Column, days_off: Iterable[str] = EXTRA_DAYS_OFF) -> DataFrame:
    """(person, absent_days): workdays between ``start`` and ``end`` that a person's periods cover.

    No row per day: of the periods in order of their first day, each adds the
    workdays after the last day reached before it. Periods of one first day are
    one, the longest, before the shuffle, so a person has a row per day of the span
    at most, however many periods they have. A period that ends before it begins,
    lies outside or lacks a date counts for nothing.
    """
    first, last = F.greatest(F.col("from"), start), F.least(F.col("to"), end)
    whole = F.col("from").isNotNull() & (F.col("to") >= F.col("from")) & (last >= first)
    periods = absences.where(whole).groupBy("person", first.alias("first")).agg(F.max(last).alias("last"))
    earlier = W.partitionBy("person").orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    reached = periods.withColumn("reached", F.max("last").over(earlier))
    new_from = F.when(F.col("reached") >= F.col("first"), F.date_add("reached", 1)).otherwise(F.col("first"))
    added = reached.select("person", workdays_between(new_from, F.col("last"), days_off).alias("days"))
    return added.groupBy("person").agg(F.sum("days").cast("bigint").alias("absent_days")).where("absent_days > 0")


def with_plan(kpis: DataFrame, absences: DataFrame, as_of: Column, days_off: Iterable[str] = EXTRA_DAYS_OFF) -> DataFrame:
    """Personal plan hours and load per cent; people without absences keep the
    team plan, others may drop to zero."""
    with_any = absences.select("person").distinct().withColumn("has_absence", F.lit(True))
    workdays = workdays_between(quarter_start(as_of), as_of, days_off)
    personal = F.greatest(workdays - F.coalesce("absent_days", F.lit(0)), F.lit(0)) * HOURS_PER_DAY
    plan = F.when(F.col("has_absence"), personal).otherwise(team_plan_hours(as_of, days_off))
    return (
        kpis.join(with_any, "person", "left")
        .join(absence_days(absences, as_of, days_off), "person", "left")
        .withColumn("plan_hours", plan)
        .withColumn("absent_days", F.coalesce("absent_days", F.lit(0)))
        .drop("has_absence")
        .withColumn("load_pct", load_percent(F.col("minutes"), F.col("plan_hours")))
    )


def by_load() -> list[Column]:
    """Most loaded first, then by name in Russian order; the plain name parts what the collation holds equal."""
    return [F.desc("load_pct"), F.collate("person", "ru").asc(), F.col("person").asc()]


def ranked_by_load(kpis: DataFrame) -> DataFrame:
    return kpis.orderBy(*by_load())


def with_load_rank(kpis: DataFrame) -> DataFrame:
    """``kpis`` with ``rank``, the position in :func:`ranked_by_load`, found in parallel."""
    return with_rank(kpis, by_load())
