"""Golden values of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from assetlens.functions import address, dates, geo, ids, names, numbers, text

X = F.col("x")
NBSP = " "


def test_quarter_and_object_keys(values):
    given = ["1:2:0001005", "77:05:0001005:19", "77:05", None, "", "№ 7:5:1:2 x"]
    assert values(ids.quarter_key(X), given) == ["01:02:0001005", "77:05:0001005", None, None, None, "07:05:1"]
    assert values(ids.object_key(X), given) == [None, "77:05:0001005:19", None, None, None, "07:05:1:2"]


def test_number_dialects(values):
    given = ["1 200", "1000,50", "", None, f"1{NBSP}200", "5f", "NaN", "1e5"]
    assert values(numbers.price_number(X), given) == [1200, None, None, None, 1200, None, None, None]
    assert values(numbers.area_number(X), given) == [1200, 1000.5, None, None, 1200, None, None, None]
    assert values(numbers.work_number(X), given) == [1200, 1000.5, 0, 0, 1200, 0, 0, 0]
    assert values(numbers.register_number(X), ["1,234.5", "5-10", "1 000 руб", None, "12,5%"]) == [0, 0, 1000, 0, 12.5]
    assert values(numbers.digits_number(X), ["1 200,50", "нет", None]) == [120050, None, None]
    assert values(numbers.distance_km(X), ["12,5 км", "3км", "далеко", None]) == [12.5, 3, None, None]
    assert values(numbers.filter_number(X), ["1 000,5 ₽", "", "-3"]) == [1000.5, None, -3]


def test_rounding_and_money(values):
    assert values(numbers.round_half_up(X), [-2.5, 2.5, 7.5], "double") == [-2, 3, 8]
    assert values(numbers.money_text(X), [1234567.5, 1000.0, None], "double") == ["1 234 567,50", "1 000", "0"]
    assert values(numbers.price_text(X), [0.0, 1234.0, None], "double") == [None, f"1{NBSP}234{NBSP}₽", None]


def test_collateral_from_discount(spark):
    df = spark.createDataFrame([(0.0, 10.0), (101.0, 0.0), (100.0, 40.0), (100.0, 100.0), (5.0, 50.0)], "c double, d double")
    got = [r[0] for r in df.select(numbers.collateral_from_discount(F.col("c"), F.col("d"))).collect()]
    assert got == [0, 101, 60, 0, 2]  # 2.5 rounds to even


def test_csi_and_load(values, spark):
    assert values(numbers.csi_score(X), ["0", "", "4", "5", None, "5,4"]) == [None, None, 4, 5, None, None]
    assert values(numbers.csi_bucket(X), ["1,5", "4,4", "6"]) == [2, 4, None]
    df = spark.createDataFrame([(820, 280), (820 + 150, 280), (41 * 24, 280), (5, 0), (0, 0)], "m int, h int")
    got = [r[0] for r in df.select(numbers.load_percent(F.col("m"), F.col("h"))).collect()]
    assert got == pytest.approx([4.880952380952, 5.773809523810, 5.857142857143, 999, 0])


def test_dates(values):
    given = ["15.07.2026", "2026-07-15T08:05", "46218.5", "31.02.2026", "", None, "1/2/2026 7:08:09 tail", "x"]
    got = values(dates.parse_datetime(X), given)
    assert got[0] == dt.datetime(2026, 7, 15)
    assert got[1] == dt.datetime(2026, 7, 15, 8, 5)
    assert got[2] == dt.datetime(2026, 7, 15, 12)
    assert got[3:6] == [None, None, None]
    assert got[6] == dt.datetime(2026, 2, 1, 7, 8, 9)
    assert got[7] is None


def test_calendar(values, spark):
    day = dt.date
    assert values(dates.quarter_start(X), [day(2026, 8, 18)], "date") == [day(2026, 7, 1)]
    assert values(dates.is_workday(X), [day(2026, 1, 9), day(2026, 1, 12), day(2026, 8, 15)], "date") == [False, True, False]
    assert values(dates.workdays_between(dates.quarter_start(X), X), [day(2026, 8, 18)], "date") == [35]
    off = dates.calendar(spark, "2026-05-01", "2026-05-31").where("NOT is_workday").count()
    assert off == 10 + 2  # weekends, 1 May, 11 May (9 May is a Saturday)


def test_absence_cells(values):
    got = values(dates.absence_periods(X, 2026), ["06.04.-19.04", "02.07.", "12.03-14.03; 14.08; 02.07.", "x; 31.02", None])
    assert [tuple(p) for p in got[0]] == [(dt.date(2026, 4, 6), dt.date(2026, 4, 19))]
    assert [tuple(p) for p in got[1]] == [(dt.date(2026, 7, 2), dt.date(2026, 7, 2))]
    assert len(got[2]) == 3 and got[3] == [] and got[4] == []
    assert values(dates.iso_from_dmy(X), ["1.2.26", "10-04-2026", "2026/4/1", "1.2"]) == ["2026-02-01", "2026-04-10", "2026-04-01", None]


def test_period_key(values):
    assert values(dates.period_key(X), ["1 кв 2024", "4 кв 2023", "—", None]) == [20241, 20234, None, None]


def test_vin(values):
    assert values(ids.normalize_vin(X), ["ХТА219010С0123456", "чца0фрд35в0011102", " xta-219 ", None]) == [
        "XTA219010C0123456", "XWF0AHL35D0011102", "XTA219", "",
    ]
    assert values(ids.check_digit(X), ["1HGCM82633A004352", "1HGCM82633A004353", "SHORT"]) == ["3", "5", None]
    codes = values(F.transform(ids.structure_issues(X), lambda i: i["code"]), ["1HGCM82633A004352", "1HGCM82633A004353", "IOQ", "", None])
    assert codes == [[], ["check_digit"], ["wrong_length"] + ["forbidden_char"] * 3, ["empty"], ["empty"]]
    spelling = values(F.transform(ids.spelling_issues(X), lambda i: i["code"]), ["1HGCM82633A004352", "1hgcm82633a-00435O", "ХТА219010С0123456"])
    assert spelling[0] == []
    assert spelling[1] == ["lowercase", "separators", "forbidden_letter", "suggestion"]
    assert spelling[2] == ["cyrillic"]


def test_plates(values):
    assert values(ids.normalize_plate(X), ["a123aa77", "А123АА77 RUS"]) == ["А123АА77", "А123АА77"]
    assert values(ids.is_probable_plate(X), ["А123АА77", "1HGCM82633A004352", "x"]) == [True, False, False]
    assert values(ids.plate_error(X), ["А123АА77", "", "А1"]) == [None, "Госномер не указан", "Госномер должен содержать 7–9 символов (сейчас 2)"]


def test_lookalikes_and_placeholders(values):
    assert values(ids.fold_lookalikes(X), ["ВМW Х5", " ", None]) == ["BMW X5", None, None]
    assert values(ids.clean_value(X), [" N/A ", "Not Applicable", "x", ""]) == [None, None, "x", None]


def test_key_variants(values):
    assert values(ids.key_variants(X), ["77:05:0001005:19"]) == [
        ["77:05:0001005:19", "77 05 0001005 19", "77-05-0001005-19", "77:05:1005:19", "0001005:19"]
    ]


def test_mercator_and_bearing(spark):
    row = spark.range(1).select(
        geo.to_wgs84(F.lit(4187000.0), F.lit(7508000.0)).alias("p"),
        geo.bearing(F.lit(55.0), F.lit(37.0), F.lit(56.0), F.lit(37.0)).alias("b"),
        geo.offset_point(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(1000.0)).alias("o"),
    ).first()
    assert (round(row.p.lon, 6), round(row.p.lat, 6)) == (37.612461, 55.745915)
    assert row.b == pytest.approx(0)
    assert row.o.lon == pytest.approx(0.0089932, abs=1e-6) and row.o.lat == pytest.approx(0)


def test_address_parts(values):
    given = ["Пермский край, г. Пермь, ул. Ленина, д. 5", "Тульская область, Узловая, Садовая улица, 7", "Москва, Тверская ул", None]
    assert values(address.city(X), given) == ["Пермь", "Узловая", "Москва", None]
    assert values(address.street(X), given) == ["Ленина", "Садовая", "Тверская", None]
    assert values(address.house_number(X), given) == ["5", "7", None, None]
    assert values(address.address_slug(X), ["г. Пермь, ул. Щорса, д. 5"]) == ["gorod-perm-ulica-schorsa-5"]
    assert values(address.short_for_geocoding(X), ["Российская Федерация, город Москва, улица Мира, д. 1"]) == ["Москва, Мира, 1"]


def test_semicolon_fields(values):
    got = values(text.semicolon_fields(X), ["Авто; Марка : LADA;; марка: ВАЗ; Цвет: н/д", None, "  "])
    assert got == [{"kind": "авто", "марка": "ВАЗ"}, {}, {}]


def test_latin1_repair(values):
    assert values(text.repair_latin1_cyrillic(X), ["ÈÍÍ 123", "ИНН", "plain"]) == ["ИНН 123", "ИНН", "plain"]


def test_garbage_lines(values):
    assert values(text.is_garbage_line(X), ["ABC!!DEF", "Обычная строка", "", "AB"]) == [True, False, False, False]


def test_labelled_text_and_names(values):
    assert values(names.labelled_fields(X), ["Вид обеспечения: квартира Площадь: 50 кв.м", "без меток", None]) == [
        {"kind": "квартира", "area": "50 кв.м"}, {}, {},
    ]
    assert values(names.normal_code(X), ["310.01", "310 01", "10101", "1"]) == ["310.01", "310.01", "101.01", ""]
    assert values(names.classifier_display(X, F.lit("101.01")), ["310.01", "квартира", "", "Вид обеспечения"]) == [
        "Легковой автомобиль", "квартира", "Квартира", "Квартира",
    ]
    assert values(names.land_plot_only(X), ["Земельный участок, 10 соток", "Дом"]) == ["Земельный участок", "Дом"]


def test_boxes_and_links(spark):
    square = "array(array(array(array(0D,1D),array(2D,5D),array(1D,-3D))), array(array(array(9D,9D))))"
    row = spark.range(1).select(
        geo.bounding_box(F.expr(square)).alias("box"),
        geo.ring_centroid(F.expr(square)).alias("mid"),
        geo.bounding_box(F.expr("cast(array() as array<array<array<array<double>>>>)")).alias("none"),
        geo.map_link("https://maps.example/?layer=x", F.lit("77:01:1:2"), F.lit(55.5), F.lit(37.5)).alias("at"),
        geo.map_link("https://maps.example/?layer=x", F.lit("77:01:1:2"), F.lit(None), F.lit(37.5)).alias("bare"),
        address.search_link("https://list.example/land", F.lit("Москва"), F.lit(None).cast("string")).alias("search"),
    ).first()
    assert tuple(row.box) == (0, -3, 9, 9) and tuple(row.mid) == (1, 1) and row.none is None
    assert row["at"] == "https://maps.example/?layer=x&zoom=18&lat=55.5&lon=37.5&cadastralNumber=77%3A01%3A1%3A2"
    assert row.bare == "https://maps.example/?layer=x&cadastralNumber=77%3A01%3A1%3A2"
    assert row.search == "https://list.example/land?region=%D0%9C%D0%BE%D1%81%D0%BA%D0%B2%D0%B0"


def test_object_paths_and_short_addresses(values):
    given = ["Россия, Пермский край, г. Пермь, ул. Мира, д. 5", None]
    assert values(address.object_paths(F.lit("59:1:1:1"), X), given) == [
        ["/object-59:1:1:1-rossiya-permskij-kraj-gorod-perm-ulica-mira-5/", "/object-59:1:1:1-g-perm-ul-mira-d-5/", "/object-59:1:1:1/"],
        ["/object-59:1:1:1/"],
    ]
    assert values(address.short_for_street_view(X), ["Почтовый адрес ориентира: Тульская область, г. Узловая, д. 3"]) == ["Узловая, 3"]


def test_terms_and_histogram(spark):
    from assetlens.operators import workload

    df = spark.createDataFrame([("01.07.2026 12:00", "2026-07-04 00:00:00"), ("x", "01.07.2026")], "s string, t string")
    assert [r[0] for r in df.select(dates.term_days(F.col("s"), F.col("t"))).collect()] == [2.5, None]
    k = spark.createDataFrame([(1, 0, 2, 0, 3)], ", ".join(f"csi_{b} int" for b in range(1, 6)))
    assert workload.csi_histogram(k).first().csi_counts == [1, 0, 2, 0, 3]


def test_lookup_quotes(values):
    assert values(text.lookup({"a'b": "x\\y", "c": "d"}, X), ["a'b", "c", "?", None]) == ["x\\y", "d", None, None]
