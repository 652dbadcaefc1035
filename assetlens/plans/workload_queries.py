"""Workload operators on ``events``: a user is a person, an event a request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import classifier, workload
from .tables import table

AS_OF = "2024-01-25"

# fixed values: event types as lines and kinds, and two texts per value band
KIND_OF_TYPE = {"view": "l1", "signup": "online", "click": "mdo", "error": "inspection", "purchase": "mdo"}


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "value")
    whole = F.floor("value").cast("bigint")
    kind = F.lit("mdo")
    for t, k in KIND_OF_TYPE.items():
        kind = F.when(F.col("event_type") == t, F.lit(k)).otherwise(kind)
    seg_text = F.concat(
        F.when(whole % 4 == 0, F.lit("Управление малого бизнеса, "))
        .when(whole % 4 == 1, F.lit("Департамент КОРПОРАТИВНОГО бизнеса, "))
        .when(whole % 4 == 2, F.lit("Отдел проблемных активов, "))
        .otherwise(F.lit("")),
        F.when(whole % 3 == 0, F.lit("Сибирский банк"))
        .when(whole % 3 == 1, F.lit("Северо-Западный банк"))
        .otherwise(F.lit("Банк")),
    )
    tag = F.when(whole % 11 == 0, F.lit("ФЖН срочно")).when(whole % 7 == 0, F.lit("Арбитраж")).otherwise(F.lit(""))
    on_roster = F.col("user_id") % 2 == 0
    day = F.to_date("ts")
    reason = (
        F.when(F.col("user_id") % 10 == 9, F.lit("no name"))
        .when(~on_roster, F.lit("not on roster"))
        .when(~workload.in_quarter(day, F.lit(AS_OF).cast("date")), F.lit("out of period"))
    )
    return e.select(
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("person"),
        kind.alias("kind"),
        F.col("event_type").alias("line"),
        day.alias("day"),
        workload.is_arbitration(tag).alias("arbitration"),
        workload.is_fzh(tag).alias("fzh"),
        F.when(whole % 13 != 0, whole * 60).alias("term_seconds"),
        (whole % 5 == 0).alias("overdue"),
        (whole % 3).cast("double").alias("returns"),
        F.when((whole % 8).between(1, 5), (whole % 8).cast("int")).alias("csi"),
        workload.segment(seg_text).alias("segment"),
        workload.territory(seg_text).alias("territory"),
        (whole % 2 == 0).alias("priority"),
        reason.alias("reason"),
    ).withColumn("minutes", workload.request_minutes(F.col("kind"), F.col("arbitration"), F.col("fzh")))


TYPED_SQL = f"""
WITH e AS (SELECT *, CAST(floor(value) AS BIGINT) AS w FROM events),
r AS (SELECT 'User ' || user_id AS person, user_id,
        CASE event_type WHEN 'view' THEN 'l1' WHEN 'signup' THEN 'online' WHEN 'error' THEN 'inspection' ELSE 'mdo' END AS kind,
        event_type AS line, CAST(ts AS DATE) AS day, w % 11 = 0 AS fzh, w % 11 <> 0 AND w % 7 = 0 AS arb,
        CASE WHEN w % 13 <> 0 THEN w * 60 END AS term_seconds, w % 5 = 0 AS overdue, w % 3 AS returns,
        CASE WHEN w % 8 BETWEEN 1 AND 5 THEN w % 8 END AS csi,
        CASE w % 4 WHEN 0 THEN 'ММБ' WHEN 1 THEN 'КСБ' WHEN 2 THEN 'ПРПА' ELSE 'Прочее' END AS segment,
        CASE w % 3 WHEN 0 THEN 'СБ' WHEN 1 THEN 'СЗБ' END AS territory, w % 2 = 0 AS priority,
        CASE WHEN user_id % 10 = 9 THEN 'no name' WHEN user_id % 2 <> 0 THEN 'not on roster'
             WHEN CAST(ts AS DATE) NOT BETWEEN DATE '2024-01-01' AND DATE '{AS_OF}' THEN 'out of period' END AS reason
      FROM e),
t AS (SELECT *, CASE kind WHEN 'l1' THEN 24 WHEN 'inspection' THEN 20
                WHEN 'online' THEN CASE WHEN arb THEN 210 ELSE 20 END
                ELSE CASE WHEN fzh THEN 240 WHEN arb THEN 150 ELSE 20 END END AS minutes FROM r),
u AS (SELECT * FROM t WHERE reason IS NULL)
"""
_PLAN_HOURS_SQL = f"""(SELECT 8 * COUNT(*) FROM generate_series(DATE '2024-01-01', DATE '{AS_OF}', INTERVAL 1 DAY) g(d)
  WHERE isodow(d) < 6 AND strftime(d, '%m-%d') NOT IN
  ('01-01','01-02','01-03','01-04','01-05','01-06','01-07','01-08','02-23','03-08','05-01','05-09','06-12','11-04'))"""


def _out(kpis: DataFrame, *keys: str) -> DataFrame:
    return kpis.select(
        *keys,
        "apps",
        "apps_arb",
        "apps_fzh",
        "apps_l1",
        "apps_online",
        F.col("minutes").cast("bigint").alias("minutes"),
        "term_n",
        F.round("avg_term_hours", 6).alias("avg_term_hours"),
        "overdue",
        F.col("returns").cast("bigint").alias("returns"),
        *[f"csi_{b}" for b in range(1, 6)],
    )


_KPI_SQL = """
  CAST(COUNT(*) AS BIGINT) AS apps,
  COUNT(*) FILTER (arb AND (kind = 'online' OR (kind = 'mdo' AND NOT fzh))) AS apps_arb,
  COUNT(*) FILTER (fzh AND kind = 'mdo') AS apps_fzh, COUNT(*) FILTER (kind = 'l1') AS apps_l1,
  COUNT(*) FILTER (kind = 'online') AS apps_online, CAST(SUM(minutes) AS BIGINT) AS minutes,
  COUNT(term_seconds) AS term_n, round(SUM(term_seconds) / 3600.0 / COUNT(term_seconds), 6) AS avg_term_hours,
  COUNT(*) FILTER (overdue) AS overdue, CAST(SUM(returns) AS BIGINT) AS returns,
  COUNT(*) FILTER (csi = 1) AS csi_1, COUNT(*) FILTER (csi = 2) AS csi_2, COUNT(*) FILTER (csi = 3) AS csi_3,
  COUNT(*) FILTER (csi = 4) AS csi_4, COUNT(*) FILTER (csi = 5) AS csi_5
"""


def workload_kpis(spark: SparkSession, sf: str) -> DataFrame:
    """Indicators and load per person against the team plan."""
    kpis = workload.employee_kpis(workload.person_line_kpis(workload.used(_typed(spark, sf))))
    as_of = F.lit(AS_OF).cast("date")
    loaded = kpis.withColumn("plan_hours", workload.team_plan_hours(as_of)).withColumn(
        "load_pct", workload.load_percent(F.col("minutes"), F.col("plan_hours"))
    )
    out = _out(loaded, "person", "plan_hours", "load_pct")
    return out.withColumn("plan_hours", F.col("plan_hours").cast("bigint")).withColumn("load_pct", F.round("load_pct", 6))


WORKLOAD_KPIS_SQL = f"""{TYPED_SQL}
SELECT person, {_PLAN_HOURS_SQL} AS plan_hours,
  round(SUM(minutes) * 100.0 / ({_PLAN_HOURS_SQL} * 60), 6) AS load_pct, {_KPI_SQL}
FROM u GROUP BY person
"""


def workload_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Per line and overall, re-aggregated from the person-line sums."""
    parts = workload.person_line_kpis(workload.used(_typed(spark, sf)))
    rolled = parts.rollup("line").agg(*[F.sum(c).alias(c) for c in workload._SUMMED])
    return _out(workload.with_average_term(rolled).withColumn("line", F.coalesce("line", F.lit("all"))), "line")


WORKLOAD_LINES_SQL = f"{TYPED_SQL} SELECT COALESCE(line, 'all') AS line, {_KPI_SQL} FROM u GROUP BY ROLLUP (line)"


def workload_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Segment counts per kind and the priority matrix, zero-filled."""
    u = workload.used(_typed(spark, sf))
    seg = workload.segment_counts(u).select(F.lit("segment").alias("part"), F.col("kind").alias("a"), F.col("segment").alias("b"), "apps")
    pri = workload.priority_counts(u).select(F.lit("priority").alias("part"), F.col("segment").alias("a"), F.col("territory").alias("b"), "apps")
    return seg.unionByName(pri)


def _values(names) -> str:
    return ", ".join(f"('{n}')" for n in names)


WORKLOAD_MATRIX_SQL = f"""{TYPED_SQL},
k(kind) AS (VALUES {_values(workload.KINDS_WITH_SEGMENTS)}), s(segment) AS (VALUES {_values(workload.SEGMENTS)}),
ps(segment) AS (VALUES {_values(workload.PRIORITY_SEGMENTS)}), pt(territory) AS (VALUES {_values(workload.TERRITORIES)}, ('all')),
p AS (SELECT * FROM u WHERE priority AND territory IS NOT NULL)
SELECT 'segment' AS part, k.kind AS a, s.segment AS b, COUNT(u.person) AS apps
FROM k CROSS JOIN s LEFT JOIN u ON u.kind = k.kind AND u.segment = s.segment GROUP BY 1, 2, 3
UNION ALL
SELECT 'priority', ps.segment, pt.territory, COUNT(p.person)
FROM ps CROSS JOIN pt LEFT JOIN p ON p.segment = ps.segment AND (pt.territory = 'all' OR p.territory = pt.territory)
GROUP BY 1, 2, 3
"""


def reject_counts(spark: SparkSession, sf: str) -> DataFrame:
    return workload.reject_counts(_typed(spark, sf))


REJECT_SQL = f'{TYPED_SQL} SELECT COALESCE(reason, \'used\') AS reason, COUNT(*) AS "rows" FROM t GROUP BY 1'


def absence_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Personal plan from overlapping absences; some people have overrides."""
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"))
    person = F.concat(F.lit("User"), F.col("user_id").cast("string"))
    as_of = F.lit(AS_OF).cast("date")
    people = e.select(person.alias("person")).distinct()
    # standing: one period of 1-3 days around every event day of the user
    standing = e.select(
        person.alias("person_key"), F.col("day").alias("from"), F.date_add("day", F.col("user_id").cast("int") % 3).alias("to")
    ).where(F.col("user_id") % 4 != 3)
    # overrides: every fifth user an empty list, every seventh one period
    overrides = (
        e.where((F.col("user_id") % 5 == 0) | (F.col("user_id") % 7 == 0))
        .groupBy("user_id")
        .agg(F.min("day").alias("first"))
        .select(
            person.alias("person"),
            F.when(F.col("user_id") % 7 == 0, F.col("first")).alias("from"),
            F.when(F.col("user_id") % 7 == 0, F.date_add("first", 9)).alias("to"),
        )
    )
    absences = workload.resolve_absences(people, standing, overrides)
    out = workload.with_plan(people.withColumn("minutes", F.lit(600)), absences, as_of)
    return out.select(
        "person",
        F.col("absent_days").cast("bigint").alias("absent_days"),
        F.col("plan_hours").cast("bigint").alias("plan_hours"),
        F.round("load_pct", 6).alias("load_pct"),
    )


ABSENCE_PLAN_SQL = f"""
WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day FROM events),
p AS (SELECT DISTINCT user_id FROM e),
a AS (
  SELECT user_id, day AS f, CAST(day + CAST(user_id % 3 AS INT) AS DATE) AS t FROM e
  WHERE user_id % 4 <> 3 AND user_id % 5 <> 0 AND user_id % 7 <> 0
  UNION ALL
  SELECT user_id, MIN(day), CAST(MIN(day) + 9 AS DATE) FROM e WHERE user_id % 7 = 0 GROUP BY user_id),
cal AS (SELECT CAST(d AS DATE) AS d FROM generate_series(DATE '2024-01-01', DATE '{AS_OF}', INTERVAL 1 DAY) g(d)
  WHERE isodow(d) < 6 AND strftime(d, '%m-%d') NOT IN
  ('01-01','01-02','01-03','01-04','01-05','01-06','01-07','01-08','02-23','03-08','05-01','05-09','06-12','11-04')),
o AS (SELECT user_id, COUNT(DISTINCT d) AS n FROM a JOIN cal ON d BETWEEN f AND t GROUP BY user_id),
x AS (SELECT p.user_id, COALESCE(n, 0) AS n, 8 * ((SELECT COUNT(*) FROM cal) - COALESCE(n, 0)) AS plan FROM p LEFT JOIN o USING (user_id))
SELECT 'User' || user_id AS person, n AS absent_days, plan AS plan_hours,
       CASE WHEN plan <= 0 THEN 999.0 ELSE round(600 * 100.0 / (plan * 60), 6) END AS load_pct FROM x
"""


def absence_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Absence text of each user to periods, and dates in mixed notations."""
    u = table(spark, sf, "events").select("user_id").distinct()
    d = F.lpad((F.col("user_id") % 28 + 1).cast("string"), 2, "0")
    m = F.lpad((F.col("user_id") % 12 + 1).cast("string"), 2, "0")
    cell = F.concat(d, F.lit("."), m, F.lit(".-28."), m, F.lit("; "), d, F.lit("."), m, F.lit(".; bad"))
    short = F.concat(d, F.lit("/"), (F.col("user_id") % 12 + 1).cast("string"), F.lit("/24"))
    return (
        u.select("user_id", F.explode(dates.absence_periods(cell, 2024)).alias("p"), dates.iso_from_dmy(short).alias("iso"))
        .select("user_id", F.col("p.from").cast("string").alias("from_day"), F.col("p.to").cast("string").alias("to_day"), "iso")
    )


ABSENCE_CELLS_SQL = """
WITH u AS (SELECT DISTINCT user_id, lpad(CAST(user_id % 28 + 1 AS VARCHAR), 2, '0') AS d,
                  lpad(CAST(user_id % 12 + 1 AS VARCHAR), 2, '0') AS m FROM events)
SELECT user_id, '2024-' || m || '-' || d AS from_day, '2024-' || m || '-28' AS to_day, '2024-' || m || '-' || d AS iso FROM u
UNION ALL
SELECT user_id, '2024-' || m || '-' || d, '2024-' || m || '-' || d, '2024-' || m || '-' || d FROM u
"""


def ordered_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered first-match rules over names, types and priorities."""
    part = table(spark, sf, "part").select("p_name", "p_type")
    rules = (("hot|red", "warm"), ("red|blue", "colour"), ("(^|[^a-z])ring([^a-z]|$)", "ring"))
    a = part.select(
        F.lit("part").alias("what"),
        text.first_by_rules(F.lower("p_name"), rules, F.lit("other")).alias("label"),
        F.upper("p_type").alias("extra"),
    )
    b = table(spark, sf, "orders").select(
        F.lit("order").alias("what"),
        text.first_by_rules(F.lower("o_orderpriority"), (("urgent|high", "fast"), ("low", "slow")), F.lit("normal")).alias("label"),
        classifier.purpose_kind(F.concat(F.lit("20400"), F.substring("o_orderpriority", 1, 1), F.lit("000000")), F.lit(None)).alias("extra"),
    )
    return a.unionByName(b).groupBy("what", "label", "extra").agg(F.count("*").alias("n"))


ORDERED_RULES_SQL = """
SELECT 'part' AS what, CASE WHEN regexp_matches(lower(p_name), 'hot|red') THEN 'warm'
  WHEN regexp_matches(lower(p_name), 'red|blue') THEN 'colour'
  WHEN regexp_matches(lower(p_name), '(^|[^a-z])ring([^a-z]|$)') THEN 'ring' ELSE 'other' END AS label,
  upper(p_type) AS extra, COUNT(*) AS n FROM part GROUP BY 1, 2, 3
UNION ALL
SELECT 'order', CASE WHEN regexp_matches(lower(o_orderpriority), 'urgent|high') THEN 'fast'
  WHEN lower(o_orderpriority) LIKE '%low%' THEN 'slow' ELSE 'normal' END,
  CASE WHEN o_orderpriority[1] IN ('2','4','5') THEN 'residential' WHEN o_orderpriority[1] = '1' THEN 'nonresidential' END,
  COUNT(*) FROM orders GROUP BY 1, 2, 3
"""

# fixed values: names that differ by letter, dots and case only, in Russian order
_NAMES = ("ежов", "елкин", "Елкин", "ёлкин", "Ёлкин", "Жуков")


def _named_kpis(spark: SparkSession, sf: str) -> DataFrame:
    """Sums per person and line, persons six to a number, told apart by such a name."""
    typed = workload.used(_typed(spark, sf))
    number = F.substring_index("person", " ", -1).cast("bigint")
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.floor(number / 2) % 6 + 1).cast("int"))
    # roster numbers are even, so six in a row share the number behind the name
    return workload.person_line_kpis(typed.withColumn("person", F.concat(name, F.lit(" "), F.lpad(F.floor(number / 12).cast("string"), 9, "0"))))


def load_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Position of every person by load, and of every line by size."""
    parts = _named_kpis(spark, sf)
    kpis = workload.employee_kpis(parts).withColumn("load_pct", workload.load_percent(F.col("minutes"), F.lit(120)))
    people = workload.with_load_rank(kpis).select(F.lit("person").alias("what"), F.col("person").alias("name"), "rank", "apps")
    lines = workload.with_line_rank(parts).select(F.lit("line").alias("what"), F.concat_ws("/", "line", "kind").alias("name"), "rank", "apps")
    return people.unionByName(lines)


LOAD_RANKING_SQL = f"""{TYPED_SQL},
n AS (SELECT user_id, CAST(user_id // 2 % 6 AS INT) AS k, lpad(CAST(user_id // 12 AS VARCHAR), 9, '0') AS num, SUM(minutes) AS minutes, COUNT(*) AS apps FROM u GROUP BY 1),
p AS (SELECT *, CASE k WHEN 0 THEN 0 WHEN 5 THEN 2 ELSE 1 END AS word FROM n),
l AS (SELECT line, kind, COUNT(*) AS apps FROM u GROUP BY ALL)
SELECT 'person' AS what, [{', '.join(f"'{n}'" for n in _NAMES)}][k + 1] || ' ' || num AS name, apps,
  ROW_NUMBER() OVER (ORDER BY minutes DESC, word, num, k) AS rank FROM p
UNION ALL SELECT 'line', line || '/' || kind, apps, ROW_NUMBER() OVER (ORDER BY apps DESC, line, kind) FROM l
"""


def absence_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Workdays that long overlapping periods cover in a span of seven years, per customer; order dates begin the periods."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    begin = F.to_date("o_orderdate")
    periods = o.select(
        F.col("o_custkey").cast("string").alias("person"),
        begin.alias("from"),
        F.date_add(begin, (F.col("o_orderkey") % 400).cast("int") - 3).alias("to"),
    )
    days_off = ("1995-01-09", "1996-03-11", "1996-03-08", "1997-05-10")  # the third is a holiday as it is, the last a Saturday
    missed = workload.missed_workdays(periods, F.lit("1992-03-01").cast("date"), F.lit("1998-12-31").cast("date"), days_off)
    return missed.select(F.col("person").cast("bigint").alias("o_custkey"), "absent_days")


ABSENCE_SPANS_SQL = """
WITH a AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS f, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 - 3 AS INT) AS t FROM orders),
cal AS (SELECT CAST(d AS DATE) AS d FROM generate_series(DATE '1992-03-01', DATE '1998-12-31', INTERVAL 1 DAY) g(d)
  WHERE isodow(d) < 6 AND strftime(d, '%m-%d') NOT IN
  ('01-01','01-02','01-03','01-04','01-05','01-06','01-07','01-08','02-23','03-08','05-01','05-09','06-12','11-04')
  AND CAST(d AS DATE) NOT IN (DATE '1995-01-09', DATE '1996-03-11'))
SELECT CAST(o_custkey AS BIGINT) AS o_custkey, COUNT(DISTINCT d) AS absent_days FROM a JOIN cal ON d BETWEEN f AND t GROUP BY 1
"""

QUERIES = {
    "load_ranking": load_ranking,
    "absence_spans": absence_spans,
    "workload_kpis": workload_kpis,
    "workload_lines": workload_lines,
    "workload_matrix": workload_matrix,
    "reject_counts": reject_counts,
    "absence_plan": absence_plan,
    "absence_cells": absence_cells,
    "ordered_rules": ordered_rules,
}
ORACLES = {
    "load_ranking": LOAD_RANKING_SQL,
    "absence_spans": ABSENCE_SPANS_SQL,
    "workload_kpis": WORKLOAD_KPIS_SQL,
    "workload_lines": WORKLOAD_LINES_SQL,
    "workload_matrix": WORKLOAD_MATRIX_SQL,
    "reject_counts": REJECT_SQL,
    "absence_plan": ABSENCE_PLAN_SQL,
    "absence_cells": ABSENCE_CELLS_SQL,
    "ordered_rules": ORDERED_RULES_SQL,
}
