"""Global positions, and missed workdays by merged periods, against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from assetlens.functions import dates
from assetlens.operators import workload as w
from assetlens.operators.ranking import with_rank


def test_rank_is_the_place_in_the_order(spark):
    rnd = random.Random(3)
    # a third of all rows share one value
    rows = [(7 if rnd.random() < 0.34 else rnd.randrange(1000), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "v int, i int").repartition(7)
    got = {r.i: r.rank for r in with_rank(df, [F.desc("v"), F.col("i")], ranges=6).collect()}
    want = {i: n for n, (_, i) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)}
    assert got == want


def test_rank_with_nulls_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(None,), (2,), (2,), (1,)], "v int")
    got = sorted((r.place, r.v) for r in with_rank(df, [F.col("v").asc_nulls_last()], "place", ranges=3).collect())
    assert got == [(1, 1), (2, 2), (3, 2), (4, None)]
    none = with_rank(df.where("v > 5"), [F.col("v")])
    assert none.columns == ["v", "rank"] and none.count() == 0


def test_rank_follows_the_collation(spark):
    names = ["Жуков", "ёлкин", "Елкин", "ежов", "Ёлкин", "елкин"]
    kpis = spark.createDataFrame([(n, 5.0) for n in names], "person string, load_pct double")
    got = [r.person for r in sorted(w.with_load_rank(kpis).collect(), key=lambda r: r.rank)]
    assert got == ["ежов", "елкин", "Елкин", "ёлкин", "Ёлкин", "Жуков"] == [r.person for r in w.ranked_by_load(kpis).collect()]


def _workday(d, off):
    return d.weekday() < 5 and d.strftime("%m-%d") not in dates.HOLIDAYS and d.isoformat() not in off


def test_workdays_against_a_list_of_days(spark):
    rnd = random.Random(5)
    base, off = dt.date(1999, 12, 1), ("2001-04-30", "2004-02-23", "2004-05-08", *dates.EXTRA_DAYS_OFF)
    spans = [(base + dt.timedelta(rnd.randrange(12000)), rnd.choice([-2, -1, 0, 1, 6, 30, 400, 5000])) for _ in range(300)]
    spans = [(n, a, a + dt.timedelta(k)) for n, (a, k) in enumerate(spans)]
    df = spark.createDataFrame([*spans, (-1, None, base), (-2, base, None)], "n int, a date, b date")
    got = {r[0]: r[1] for r in df.select("n", dates.workdays_between(F.col("a"), F.col("b"), off)).collect()}
    want = {n: sum(_workday(a + dt.timedelta(i), off) for i in range((b - a).days + 1)) for n, a, b in spans}
    assert got == {**want, -1: 0, -2: 0}


def test_missed_workdays_against_a_set_of_days(spark):
    rnd = random.Random(9)
    lo, hi = dt.date(2023, 2, 10), dt.date(2026, 5, 20)
    periods = []
    for _ in range(900):
        a = lo + dt.timedelta(rnd.randrange(-90, 1300))
        who = "hot" if rnd.random() < 0.34 else f"p{rnd.randrange(60)}"
        periods.append((who, a, a + dt.timedelta(rnd.choice([-3, 0, 1, 4, 40, 500]))))
    periods += periods[:50] + [("p0", None, hi), ("p1", lo, None), ("only null", None, None)]
    df = spark.createDataFrame(periods, "person string, from date, to date")
    got = {r.person: r.absent_days for r in w.missed_workdays(df, F.lit(lo), F.lit(hi)).collect()}
    days = {}
    for who, a, b in periods:
        if a and b:
            days.setdefault(who, set()).update(d for i in range((b - a).days + 1) if lo <= (d := a + dt.timedelta(i)) <= hi and _workday(d, dates.EXTRA_DAYS_OFF))
    assert got == {who: len(d) for who, d in days.items() if d}
    assert "Generate" not in w.missed_workdays(df, F.lit(lo), F.lit(hi))._jdf.queryExecution().optimizedPlan().toString()
