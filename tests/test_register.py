"""Registers: grid filling, headers, fields, verdicts, totals."""

import pytest
from pyspark.sql import functions as F

from assetlens.operators import register as r
from assetlens.sources import grids

X = F.col("x")


def cells_of(spark, **sheets):
    data = [(f, "S", i, j, v) for f, rows in sheets.items() for i, row in enumerate(rows) for j, v in enumerate(row)]
    return spark.createDataFrame(data, "file string, sheet string, row int, col int, value string")


HEADER = ["Вид обеспечения", "Залогодатель", "Описание обеспечения", "Оценочная стоимость", "Залоговая стоимость", "Срок экспозиции"]
STRUCTURED = [
    ["Перечень"],
    HEADER,
    ["Имущество/Легковой автомобиль\nТС_1", "ООО", "Автомобиль; Марка: LADA; Тип идентификатора: VIN: xtagfl350s0948232; Вид оценочной стоимости: Прочая;", "1 000", "", "90"],
    ["Итого", None, None, "1 000"],
    ["Обеспечение, учитываемое при расчёте", "", "", "0"],
    ["1. Основное - отсутствует", "", "", "0"],
    ["", "", ""],
    ["Земля|ЗУ_2", "", "", "0"],
    ["Прочее имущество", "", "Без полей, но с текстом", "0", "5"],
]
SIMPLE = [
    ["Условное обозначение", "Классификатор", "Наименование", "Идентификатор", "Примечание", "Оценочная стоимость"],
    ["З-01", "квартира", "Квартира на Мира", "59:01:0001005:19", "", "500"],
    ["", "", "Вид обеспечения", "", "", ""],
    ["З-02", "310.01", "Наименование", "", "LADA Vesta серая", "0"],
    ["x", "", "", "", "", "нет"],
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = r.parse_registers(grids.rows_of(cells_of(spark, a=STRUCTURED, b=SIMPLE)))
    return {(x.file, x.row): x for x in df.collect()}


def test_every_row_with_text_has_a_verdict(parsed):
    assert {k: (v.status, v.reasons[0]) for k, v in parsed.items()} == {
        ("a", 2): ("accepted", "есть оценочная стоимость"),
        ("a", 3): ("skipped", "строка «Итого»"),
        ("a", 4): ("skipped", "нет стоимости и описания"),
        ("a", 5): ("skipped", "секция без объектов"),
        ("a", 7): ("skipped", "нет стоимости и описания"),
        ("a", 8): ("accepted", "есть залоговая стоимость"),
        ("b", 1): ("accepted", "есть оценочная стоимость"),
        ("b", 2): ("skipped", "служебная/шаблонная строка"),
        ("b", 3): ("accepted", "есть наименование"),
        ("b", 4): ("skipped", "нет осмысленного наименования"),
    }


def test_structured_fields(parsed):
    o = parsed["a", 2]
    assert (o.conditional, o.klassifikator, o.identifier, o.valuation_type, o.liquidity) == ("ТС_1", "310.01", "XTAGFL350S0948232", "Прочая", "90")
    assert (o.cost, o.collateral_value, o.bank_market_price, o.quality_category) == (1000, 1000, 1050, "Стандарт")
    assert o.name.splitlines()[1] == "Марка: LADA | VIN: XTAGFL350S0948232"


def test_simple_fields(parsed):
    assert parsed["b", 1].klassifikator == "101.01" and parsed["b", 1].identifier == "59:01:0001005:19"
    assert parsed["b", 3].raw_name == "LADA Vesta серая"  # the name cell is a label
    assert parsed["b", 4].conditional == "x"


def test_merged_cells(spark):
    cells = cells_of(spark, f=[["a", None, "b"], ["  ", "x", ""]])
    merged = spark.createDataFrame([("f", "S", 0, 5, 0, 1), ("f", "S", 0, 0, 2, 3)], "file string, sheet string, r0 int, r1 int, c0 int, c1 int")
    got = {(c.row, c.col): c.value for c in grids.fill_merged(cells, merged).collect()}
    assert got == {(0, 0): "a", (0, 1): "a", (0, 2): "b", (0, 3): "b", (1, 0): "a", (1, 1): "x", (1, 2): ""}
    assert grids.rectangle_counts(merged).first().merged_regions == 2


def test_header_rows_and_defaults(spark):
    rows = grids.rows_of(cells_of(spark, a=STRUCTURED, b=SIMPLE, c=[["x", "y"], ["1", "2"]]))
    got = {(h.file): (h.layout, h.header_row) for h in r.header_rows(rows).collect()}
    assert got == {"a": ("structured", 1), "b": ("simple", 0), "c": ("simple", 0)}
    maps = {c.file: c for c in r.column_map(r.header_rows(rows)).collect()}
    assert maps["a"].s.cost == 3 and maps["a"].s.liquidity == 5 and maps["a"].s.location == -1
    assert (maps["b"].p.note, maps["b"].p.cost, maps["b"].p.quality) == (4, 5, 10)
    assert maps["c"].p.name == 2


def test_blank_first_row_keeps_the_sheet(spark):
    rows = spark.createDataFrame([("f", "S", 1, ["M1", "", "Гараж", "x"]), ("f", "S", 90, ["M2", "", "Склад", "y"])], "file string, sheet string, row int, cells array<string>")
    headers = r.header_rows(rows)
    assert [tuple(h) for h in headers.collect()] == [("f", "S", "simple", 0, [])]
    assert r.data_rows(rows, r.column_map(headers)).count() == 2


def test_statuses(values):
    assert values(r.status_of(X), [45, 44, 20, 19], "int") == ["accepted", "suspicious", "suspicious", "skipped"]
    assert values(r.status_of(X, F.lit(True)), [90], "int") == ["skipped"]


def test_valuation(values):
    assert values(r.valuation_type(X), ["Рыночная", "кадастровая", "Прочая;", "Балансовая", "н/д", "Иная | x"]) == [
        "Рыночная", "Кадастровая", "Прочая", "Балансовая", "", "Иная",
    ]
    from assetlens.functions.text import semicolon_fields

    texts = ["Вид оценочной стоимости: Кадастровая; Площадь: 10", "foo", "x, вид стоимости: льготная"]
    assert values(r.described_valuation(X, semicolon_fields(X)), texts) == ["Кадастровая", "", "Льготная"]


def test_identifier_steps(values):
    from assetlens.functions.text import semicolon_fields

    texts = [
        "a; Тип идентификатора: VIN: xtagfl350s0948232; Кадастровый номер: 1", "Кадастровый номер: 59:1; номер: 5", "Тип идентификатора: VIN; Номер: abc",
        "Номер контракта/договора: Д-1; Номер: 7", "Номер: xtagfl350s0948232", "Номер: н/д; Инвентарный номер: И-9", "ничего",
    ]
    assert values(r.object_identifier(X, semicolon_fields(X)), texts) == ["XTAGFL350S0948232", "59:1", "ABC", "Д-1", "XTAGFL350S0948232", "И-9", ""]


def test_totals_filter_facets(spark):
    rows = [("a", "к1", 100.0, 0.0, 40.0, "Рыночная"), ("b", "к1", 50.0, 70.0, 0.0, "—"), ("c", "К2", 10.0, None, None, "")]
    df = spark.createDataFrame(rows, "conditional string, classifier_name string, cost double, collateral_value double, discount double, valuation_type string")
    got = {(t.classifier_name, t.is_total): (t.objects, float(t.estimate), float(t.collateral)) for t in r.totals(df).collect()}
    assert got == {("к1", False): (2, 150, 130), ("К2", False): (1, 10, 6), (None, True): (3, 160, 136)}
    assert df.where(r.matches(code="A", cost_from=50)).count() == 1
    facets = [(f.facet, f.value) for f in r.facets(df, ["classifier_name", "valuation_type"]).collect()]
    assert facets == [("classifier_name", "к1"), ("classifier_name", "К2"), ("valuation_type", "Рыночная")]


def test_client_objects_and_names(spark, parsed):
    df = spark.createDataFrame([(None, "", 0.0), ("x", "d", 5.0)], "name string, d string, n double").withColumn("i", F.lit(7))
    assert [x.name for x in r.with_default_names(df, "name", "Obj-", "i").collect()] == ["Obj-7", "x"]
