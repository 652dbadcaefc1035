"""Conclusion documents: header, reference section, risks, report."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from assetlens.operators import documents as d

SAMPLE = """КРАТКАЯ ФОРМА ЗАЛОГОВОГО ЗАКЛЮЧЕНИЯ

Номер заключения: ASZ1000000000456
Дата заключения: 10.04.2026
Наименование залогодателя: ООО "Тестовая Компания"
ИНН залогодателя: 1234567890

Выявленные риски:
З-01 - Расхождение площади. Минимизация: запросить выписку.
З-02 - Обременение не отражено. Минимизация: сверка с выпиской.
З-01 - Расхождение площади. Минимизация: повтор.
"""
SHORT = """КРАТКАЯ ФОРМА ЗАЛОГОВОГО ЗАКЛЮЧЕНИЯ
ASZ0001234567-2
123456789012 ПРЕДПРИНИМАТЕЛЬ ВЕТРОВ ПЁТР 10-04-2026
АНТОНОВИЧ
Риски
Риск утраты ТС_001, ТС_002.
До заключения договора застраховать
далее ежегодно
ые номера
Риск порчи большого имущества
Справочная информация
Срок действия заключения: 01.02.2027
Срок кредита: 36 мес
Клиент известен банку
ABCDEF!!GH
null,
"""
BULLETS = "Таблица рисков\n- риск затопления объекта; минимизация: страхование объекта\n2) риск пожара в здании меры: установить сигнализацию\n" + " " * 5


@pytest.fixture(scope="module")
def out(spark):
    docs = [("sample", SAMPLE), ("short", SHORT), ("bullets", BULLETS), ("tiny", "x"), ("latin", "ÈÍÍ: 1234567890 " + "." * 30)]
    df = d.extract_documents(spark.createDataFrame(docs, "doc_id string, text string"))
    objects = spark.createDataFrame([("sample",), ("sample",)], "doc_id string")
    return {r.doc_id: r for r in d.report(df, objects).collect()}


def test_sample_document(out):
    r = out["sample"]
    assert (r.conclusion_number, r.conclusion_date, r.tax_id, r.client_name) == ("ASZ1000000000456", "2026-04-10", "1234567890", 'ООО "Тестовая Компания"')
    assert [(x.identifier, x.risk, x.minimization) for x in r.risks] == [
        ("З-01", "Расхождение площади", "запросить выписку"), ("З-02", "Обременение не отражено", "сверка с выпиской"),
    ]
    assert r.notes == [] and "объектов: 2." in r.summary and "рисков: 2." in r.summary


def test_short_form(out):
    r = out["short"]
    assert (r.conclusion_number, r.client_name, r.tax_id) == ("ASZ0001234567-2", "ИП Ветров Пётр Антонович", "123456789012")
    assert (r.validity_date, r.credit_term, r.reference_text) == ("2027-02-01", "36 мес", "Клиент известен банку")
    assert [(x.identifier, x.minimization) for x in r.risks] == [
        ("ТС_001, ТС_002", "До заключения договора застраховать далее ежегодно"), ("Риск-2", "—"),
    ]


def test_bullets_notes_and_encoding(out):
    assert [x.identifier for x in out["bullets"].risks] == ["Риск-1", "Риск-2"]
    assert len(out["bullets"].notes) == 4 and len(out["tiny"].notes) == 1
    assert out["latin"].tax_id == "1234567890"
    assert out["tiny"].summary.startswith("Залоговое заключение номер не распознан")


def test_caps_are_parameters(spark):
    text = "Таблица рисков\n" + "\n".join(f"З-{i} - Риск {i} тут. Минимизация: мера {i}" for i in range(1, 31))
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(F.size(d.free_text_risks(F.col("text")))).first()[0] == 30
    assert df.select(F.size(d.free_text_risks(F.col("text"), limit=d.REPORT_FREE_LIMIT))).first()[0] == 20


def test_far_and_many_risks_reach_the_documents_table(spark):
    far = "Таблица рисков\n" + "x " * 4000 + "\n" + "\n".join(f"З-{i} - Риск {i} тут. Минимизация: мера {i}" for i in range(1, 61))
    got = d.extract_documents(spark.createDataFrame([(1, far)], "doc_id int, text string"))
    assert got.select(F.size("risks")).first()[0] == 60
    cut = d.extract_documents(spark.createDataFrame([(1, far)], "doc_id int, text string"), window=d.REPORT_WINDOW)
    assert cut.select(F.size("risks")).first()[0] == 0


def test_clients(values):
    given = ["предприниматель ВЕТРОВ ПЁТР", "ип Ветров", "ооо «Ромашка»", 'АО Завод "Рост"', "Прочее лицо", ""]
    assert values(d.client_display(F.col("x")), given) == ["ИП Ветров Пётр", "ИП Ветров", 'ООО "Ромашка"', 'АО "Завод "Рост"', "Прочее лицо", ""]


def test_table_risks(spark):
    rows = [
        ["Шапка"], ["Риски"], ["Об_1,\nОб_2", "3.4.", "Риск А\nриск Б\nДля смены категории"], ["Об_1,\nОб_2", "3.4", "Риск А\nриск Б"],
        ["исходные", "", ""], ["исходные", "5", "Риск В"], ["Справочная информация"], ["Об_9", "1", "Риск Г"],
    ]
    df = spark.createDataFrame([("d", 1, i, r) for i, r in enumerate(rows)], "doc_id string, table_no int, row int, cells array<string>")
    got = {(r.identifier, r.risk_number, r.risk) for r in d.table_risks(df).collect()}
    assert got == {("Об_1, Об_2", "3.4", "Риск А риск Б"), ("—", "5", "Риск В"), ("—", "", "—")}


def test_mitigation(spark):
    rows = [(0, 1, "3.4. Что делать?", "старое"), (1, 0, "3.4 Что делать?", " новое "), (1, 1, "ЗС_1.2. x", "по зс"), (1, 2, "без номера", "x"), (1, 3, "5. y", "")]
    dictionary = d.mitigation_dictionary(spark.createDataFrame(rows, "sheet_no int, row int, question string, answer string"))
    assert {(r.risk_number, r.answer) for r in dictionary.collect()} == {("3.4", "новое"), ("ЗС_1.2", "по зс")}
    risks = spark.createDataFrame([("3.4.", "x"), ("9", "x"), ("", "своё"), (None, "своё")], "risk_number string, minimization string")
    assert [r.minimization for r in d.with_mitigation(risks, dictionary).orderBy("minimization").collect()] == ["новое", "своё", "своё", "—"]


def test_client_card(spark, out):
    rows = [(r.conclusion_number, r.conclusion_date, r.client_name, r.tax_id, r.summary, "", "", "", [tuple(x) for x in r.risks]) for r in (out["sample"], out["tiny"])]
    df = spark.createDataFrame(rows, "conclusion_number string, conclusion_date string, client_name string, tax_id string, summary string, validity_date string, credit_term string, reference_text string, risks array<struct<identifier:string,risk_number:string,risk:string,minimization:string>>")
    cards = d.client_card(df, F.lit(dt.date(2026, 1, 2))).collect()
    assert [c.date for c in cards] == ["2026-04-10", "2026-01-02"] and len(cards[0].risks) == 2


def test_a_pattern_reads_a_text_once(spark):
    docs = spark.createDataFrame([(1, SAMPLE)], "doc_id int, text string")
    plan = d.with_header(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(p) for p in (*d._DATES, *d._TAX_IDS, *d._CLIENTS, d._NUMBER_LABELLED)] == [1] * 9
