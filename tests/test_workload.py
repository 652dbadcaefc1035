"""Workload: goldens of load, plan, absences, segments and rejects."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from assetlens.operators import workload as w

AS_OF = F.lit("2026-08-18").cast("date")
NAME = "Ветров В.В. (111)"


def cells(**at):
    row = [""] * 40
    for k, v in at.items():
        row[getattr(w, k)] = v
    return row


def table(spark, file, rows, headers=None):
    width = max(len(r) for r in rows)
    return (
        spark.createDataFrame([(file, "S", i, r) for i, r in enumerate(rows)], "file string, sheet string, row_no int, cells array<string>"),
        spark.createDataFrame([(file, "S", headers or [""] * width)], "file string, sheet string, headers array<string>"),
    )


def typed(spark, *tables, roster=("Ветров", "Ёлкин")):
    rows = tables[0][0]
    heads = tables[0][1]
    for r, h in tables[1:]:
        rows, heads = rows.unionByName(r), heads.unionByName(h)
    people = spark.createDataFrame([(p,) for p in roster], "person_key string")
    return w.typed_requests(rows, w.infer_columns(heads, rows), people, AS_OF)


def load(spark, *tables):
    kpis = w.employee_kpis(w.person_line_kpis(w.used(typed(spark, *tables))))
    none = spark.createDataFrame([], "person string, from date, to date")
    return w.with_plan(kpis, none, AS_OF).collect()


def test_load_of_41_requests(spark):
    rows = [cells(END="10.07.2026", PERSON=NAME) for _ in range(41)]
    (r,) = load(spark, table(spark, "a.xlsx", rows))
    assert (r.person, r.apps, r.minutes, r.plan_hours) == ("Ветров В.В.", 41, 820, 280)
    assert r.load_pct == pytest.approx(4.880952380952)
    arb = rows + [cells(END="10.07.2026", PERSON=NAME, TAG="Арбитраж")]
    (r,) = load(spark, table(spark, "a.xlsx", arb))
    assert r.load_pct == pytest.approx(5.773809523810) and r.apps_arb == 1
    (r,) = load(spark, table(spark, "1-я линия.xlsx", rows))
    assert r.load_pct == pytest.approx(5.857142857143) and r.apps_l1 == 41


def test_minutes_by_line_and_tag(spark):
    df = spark.createDataFrame(
        [("Осмотры.xlsx", True, False), ("MDO.xlsx", True, False), ("MDO.xlsx", True, True), ("Онлайн оценка.xlsx", False, False), ("Онлайн оценка.xlsx", True, False)],
        "f string, a boolean, z boolean",
    )
    got = [r[0] for r in df.select(w.request_minutes(w.line_kind(F.col("f")), F.col("a"), F.col("z"))).collect()]
    assert got == [20, 150, 240, 20, 210]


def test_reject_order(spark):
    rows = [
        cells(END="10.07.2026", PERSON=" - "),
        cells(END="10.07.2026", PERSON="Сидоров С.С. (1)"),
        cells(END="19.08.2026", PERSON=NAME),
        cells(END="", PERSON=NAME),
        cells(END="10.07.2026", PERSON="елкин е.е."),
    ]
    counts = {r.reason: r.rows for r in w.reject_counts(typed(spark, table(spark, "MDO.xlsx", rows))).collect()}
    assert counts == {"no name": 1, "not on roster": 1, "out of period": 2, "used": 1}


def test_term_from_sums_and_scores(spark):
    rows = [cells(START="07.07.2026", END="10.07.2026", PERSON=NAME, SCORE="4", OVERDUE="Да", RETURNS="1,5") for _ in range(40)]
    rows.append(cells(START="05.07.2026", END="10.07.2026", PERSON=NAME, SCORE="0"))
    k = w.total_kpis(w.person_line_kpis(w.used(typed(spark, table(spark, "MDO.xlsx", rows))))).first()
    assert k.avg_term_hours == pytest.approx(73.170731707317)
    assert (k.csi_4, k.csi_1, k.overdue, k.returns) == (40, 0, 40, 60)


def test_column_inference(spark):
    people = [["x", f"Имя (№{i})", f"0{i}.07.2026"] for i in range(1, 7)]
    rows, heads = table(spark, "t.xlsx", people, ["ID", "Кто", "Когда"])
    r = w.infer_columns(heads, rows).first()
    assert (r.person_col, r.tag_col, r.date_col) == (1, w.TAG, 2)
    rows, heads = table(spark, "t.xlsx", [[""] * 25], ["ID", "", "", "Дата создания", "", " тег "] + [""] * 18 + ["Исполнитель"])
    r = w.infer_columns(heads, rows).first()
    assert (r.person_col, r.tag_col, r.date_col) == (24, 5, 3)
    rows, heads = table(spark, "t.xlsx", [["a"]], ["b"])
    assert w.infer_columns(heads, rows).first().person_col == -1


def test_segments_and_territories(values):
    x = F.col("x")
    given = ["Управление малого и корпоративного бизнеса", "КСБ", "отдел данных", None, "ПОВОЛЖСКИЙ банк", "Юго-Западный"]
    assert values(w.segment(x), given) == ["ММБ", "КСБ", "ПМЗ", "Прочее", "Прочее", "Прочее"]
    assert values(w.territory(x), given) == [None, None, None, None, "ПБ", "ЮЗБ"]
    assert values(w.line_name(x), ["MDO_июль.xlsx", "Осмотры.xls", "_x.xlsx"]) == ["MDO", "Осмотры", "_x"]


def test_matrices_are_zero_filled(spark):
    rows = [cells(END="10.07.2026", PERSON=NAME, SEGMENT="малого, Уральский", PRIORITY="Приоритет")]
    u = w.used(typed(spark, table(spark, "MDO.xlsx", rows)))
    seg = {(r.kind, r.segment): r.apps for r in w.segment_counts(u).collect()}
    assert len(seg) == 21 and seg["mdo", "ММБ"] == 1 and sum(seg.values()) == 1
    pri = {(r.segment, r.territory): r.apps for r in w.priority_counts(u).collect()}
    assert len(pri) == 26 and pri["ММБ", "УБ"] == 1 and pri["ММБ", "all"] == 1 and pri["КСБ", "all"] == 0


def test_absences(spark):
    d = dt.date
    kpis = spark.createDataFrame([("Ветров В.В.", 100), ("Ёлкин Е.Е.", 100), ("Роза Р.Р.", 100)], "person string, minutes int")
    standing = spark.createDataFrame(
        [("ветров", d(2026, 7, 6), d(2026, 7, 10)), ("Ветров", d(2026, 7, 8), d(2026, 7, 10)), ("Елкин", d(2026, 6, 1), d(2026, 12, 31)), ("роза", d(2026, 7, 6), d(2026, 7, 7))],
        "person_key string, from date, to date",
    )
    overrides = spark.createDataFrame([("Роза Р.Р.", None, None)], "person string, from date, to date")
    absences = w.resolve_absences(kpis.select("person"), standing, overrides)
    out = {r.person: r for r in w.with_plan(kpis, absences, AS_OF).collect()}
    assert (out["Ветров В.В."].absent_days, out["Ветров В.В."].plan_hours) == (5, 240)
    assert (out["Ёлкин Е.Е."].plan_hours, out["Ёлкин Е.Е."].load_pct) == (0, 999)
    assert (out["Роза Р.Р."].absent_days, out["Роза Р.Р."].plan_hours) == (0, 280)
    assert [r.person for r in w.ranked_by_load(w.with_plan(kpis, absences, AS_OF)).collect()][0] == "Ёлкин Е.Е."
