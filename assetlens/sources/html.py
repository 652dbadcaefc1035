"""Listing tables, label/value cards and outbound links out of HTML text.

Everything is a Column expression over one page per row; only the listing rows
are exploded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import digits_number, price_text, registry_number
from ..functions.text import extract, extract_first, filled, map_last_wins, non_empty, squeeze, strip_page, strip_tags

# fixed values: mark-up of a listing table
_ROW = r'(?is)<tr class="ads-table__row"[^>]*>(.*?)</tr>'
_CELL = r"(?is)<td[^>]*>(.*?)</td>"
_AD_PATH = r'href="(/ads/[0-9]+)'
_AD_LABEL = r'(?s)class="ads-table__link"[^>]*>(.*?)</a>'
_LOCATION = r'(?s)class="col-location"[^>]*>(.*?)</td>'
_PRICE = r'(?s)class="col-price"[^>]*>(.*?)</td>'
_PHOTO = r'<img[^>]+src="([^"]+)"'


def absolute_url(c: Column, base: str) -> Column:
    return (
        F.when(c.rlike("(?i)^https?://"), c)
        .when(c.startswith("//"), F.concat(F.lit("https:"), c))
        .when(c.startswith("/"), F.concat(F.lit(base), c))
        .when(c.isNotNull(), F.concat(F.lit(base + "/"), c))
    )


def listing_rows(pages: DataFrame, html: str, matched_by: str, base: str, source: str, *keep: str) -> DataFrame:
    """One row per listing of a result table; ``keep`` columns are carried."""
    rows = pages.select(*keep, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(_ROW), F.lit(1))).alias("seq", "row"))
    row = F.col("row")
    cells = F.transform(F.regexp_extract_all(row, F.lit(_CELL), F.lit(1)), strip_tags)
    rows = rows.withColumns({"path": extract(row, _AD_PATH), "cells": cells}).where("path IS NOT NULL")

    def cell(test) -> Column:
        return F.get(F.filter("cells", test), F.lit(0))

    in_class = lambda pattern: filled(strip_tags(F.regexp_extract(row, pattern, 1)))
    location = F.coalesce(in_class(_LOCATION), cell(lambda c: c.rlike(r"(?iu)обл\.|край|г\.|ул\.|р-н|поселен")))
    price_cell = F.coalesce(in_class(_PRICE), cell(lambda c: c.contains("₽") & ~c.contains("км")))
    area = cell(lambda c: c.rlike("(?iu)сот\\.|м²|м2"))
    distance = cell(lambda c: c.rlike("(?iu)км"))
    suitable = row.contains("badge--active")
    badge = F.when(suitable, F.lit("Подходит")).when(row.contains("badge--inactive"), F.lit("Не подходит"))
    external = in_class(_AD_LABEL)
    rows = rows.withColumns(
        {
            "id": F.substring_index("path", "/", -1),
            "address": location,
            "price_cell": price_cell,
            "price": digits_number(price_cell),
            "area": area,
            "distance": distance,
        }
    )
    title = F.concat_ws(", ", "area", "price_cell")
    return rows.select(
        *keep,
        "seq",
        F.lit(source).alias("source"),
        "id",
        F.when(title != "", title)
        .otherwise(F.concat(F.lit("Объявление "), F.coalesce(external, F.col("id"))))
        .alias("title"),
        "address",
        non_empty(
            F.concat_ws(
                ". ",
                F.concat(F.lit("Расстояние: "), F.col("distance")),
                badge,
                F.concat(F.lit("ID источника: "), external),
            )
        ).alias("description"),
        "price",
        F.coalesce("price_cell", price_text(F.col("price"))).alias("price_text"),
        F.filter(F.array(absolute_url(extract(row, _PHOTO), base)), lambda u: u.isNotNull()).alias("photos"),
        F.concat(F.lit(base), F.col("path")).alias("url"),
        F.lit(matched_by).alias("matched_by"),
        "area",
        "distance",
        suitable.alias("suitable"),
    )


# fixed values: sites whose links lead to the original listing
LISTING_HOSTS = ("avito.ru", "cian.ru", "domclick.ru", "youla.ru", "m.avito.ru")


def outbound_link(html: Column, label: str = "Ссылка на объявление", hosts: Sequence[str] = LISTING_HOSTS) -> Column:
    """The labelled link, else the first link to a listed site."""
    names = "|".join(h.replace(".", r"\.") for h in hosts)
    return extract_first(
        html,
        [
            rf'(?isu){label}.{{0,400}}?href="(https?://[^"]+)"',
            rf'(?i)href="(https?://(?:www\.)?(?:{names})[^"]*)"',
        ],
    )


# --- registry card ----------------------------------------------------------------

# fixed values: mark-up and labels of a registry card
_FIELD = (
    r'(?is)<div class="row_sser">.*?<div class="left left_sser">(.*?)</div>.*?'
    r'<div class="tx_sser[^"]*">(.*?)</div>'
)
_PAID = "доступно в платной версии"
_BRIEF = (
    r'(?isu)Краткая информация по объекту.*?<div class="lable_2 short_info">(.*?)</div>\s*<div class="clear">'
)
_RIGHTS, _RESTRICTIONS = "Зарегистрированные права", "Зарегистрированные ограничения"
_NUMBER = r"([0-9\s,.]+)"
_RECORD_MARK = "&#128994;"


def card_fields(html: Column) -> Column:
    """Label -> value map of a card; values behind a paywall are dropped."""
    blocks = F.regexp_extract_all(html, F.lit(_FIELD), F.lit(0))
    pairs = F.transform(
        blocks,
        lambda b: F.struct(
            strip_page(F.regexp_extract(b, _FIELD, 1)).alias("key"), strip_page(F.regexp_extract(b, _FIELD, 2)).alias("value")
        ),
    )
    return map_last_wins(F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != "") & ~p["value"].contains(_PAID)))


def _status(block: Column, label: str) -> Column:
    direct = extract(block, rf"(?isu){label}\s*-\s*(?:<[^>]+>\s*)*([^<]+(?:<[^>]+>[^<]+</[^>]+>)?[^<]*)")
    spare = extract(block, rf"(?isu){label}\s*-\s*.*?(найдено\s+[0-9]+|не обнаружены)")
    return filled(squeeze(F.regexp_replace(F.coalesce(direct, spare), r"<[^>]+>", " ")))


def status_count(status: Column) -> Column:
    """``найдено N`` to N, "none found" to 0, else null."""
    n = extract(status, r"(?iu)найдено\s+([0-9]+)").try_cast("int")
    return F.coalesce(n, F.when(F.lower(status).contains("не обнаруж"), F.lit(0)))


def _records(section: Column) -> Column:
    parts = F.split(F.coalesce(section, F.lit("")), _RECORD_MARK)
    parts = F.filter(parts, lambda p, i: (i > 0) & (p.contains("вид") | p.contains("дата")))

    def record(p: Column) -> Column:
        kind_hidden = p.rlike(rf"(?isu)вид.*?{_PAID}")
        number_hidden = p.rlike(rf"(?isu)№.*?{_PAID}")
        text = lambda mark: strip_page(F.regexp_extract(p, rf"(?isu){mark}.*?</div>([^<]+)", 1))
        return F.struct(
            F.when(~kind_hidden, text("вид")).alias("kind"),
            F.when(~number_hidden, text("№")).alias("number"),
            extract(p, r"(?isu)дата\s*</span>.*?([0-9]{2}\.[0-9]{2}\.)").alias("date_partial"),
            (kind_hidden | number_hidden).alias("details_hidden"),
        )

    return F.transform(parts, record)


def registry_card(pages: DataFrame, html: str, key: str, *keep: str) -> DataFrame:
    """One typed row per card: fields, area and value (prose first), rights and
    encumbrances with their records, number of related objects."""
    h = F.col(html)
    brief = strip_page(F.coalesce(extract(h, _BRIEF), h))
    rnb = F.concat(F.lit('id="rnb"'), extract(h, r'(?is)id="rnb"(.*?)(?:id="pay_lk_service"|\z)'))
    between = extract(F.col("rnb"), rf"(?isu)({_RIGHTS}.*?)(?:{_RESTRICTIONS}|\z)")
    after = extract(F.col("rnb"), rf'(?isu)({_RESTRICTIONS}.*?)(?:class="services_bl"|\z)')
    cards = pages.select(
        *keep, F.col(key).alias("key"), h.alias("html"), card_fields(h).alias("f"), brief.alias("brief"), rnb.alias("rnb")
    )
    field = lambda *names: F.coalesce(*[filled(F.try_element_at("f", F.lit(n))) for n in names])
    h = F.col("html")
    prose_area = registry_number(
        F.coalesce(
            extract(F.col("brief"), rf"(?isu)Кадастровая площадь[^.]*составляет\s+{_NUMBER}\s*кв\.?\s*м"),
            extract(h, rf'(?isu)<meta name="description"[^>]*Content="[^"]*площад[ья]:\s*{_NUMBER}\s*кв'),
            extract(h, rf"(?isu)Кадастровая площадь объекта[^.]*составляет\s+{_NUMBER}\s*кв"),
        )
    )
    listed_area = registry_number(F.regexp_replace(field("Площадь"), r"[^0-9.,]", ""))
    rights, limits = _status(F.col("rnb"), _RIGHTS), _status(F.col("rnb"), _RESTRICTIONS)
    checked = filled(extract(h, r"(?isu)на момент последней проверки\s*-\s*([^)<]+)"))
    area = F.coalesce(prose_area, listed_area)
    return cards.select(
        *keep,
        F.lit(True).alias("found"),
        F.coalesce(field("Кадастровый номер"), F.col("key")).alias("key"),
        field("Адрес").alias("address"),
        field("Тип").alias("object_type"),
        field("Статус объекта").alias("status"),
        area.alias("area"),
        F.when(area.isNotNull(), F.lit("кв. м")).alias("area_unit"),
        registry_number(
            extract(F.col("brief"), rf"(?isu)Кадастровая стоимость[^.]*составляет\s+{_NUMBER}\s*руб")
        ).alias("value"),
        field("Дата внесения стоимости").alias("value_date"),
        field("Категория земель").alias("land_category"),
        field("Разрешенное использование (ВРИ)", "Разрешенное использование").alias("permitted_use"),
        field("Разрешенное использование по документам").alias("permitted_use_document"),
        field("Объект входит в ЗОУИТ по данным", "Объект входит в ЗОУИТ").alias("protected_zone"),
        field("Границы").alias("boundaries"),
        field("ФИАС ID").alias("fias_id"),
        F.coalesce(field("Дата обновления информации по объекту в"), checked).alias("updated_at"),
        rights.alias("rights"),
        limits.alias("restrictions"),
        status_count(rights).alias("rights_count"),
        status_count(limits).alias("restrictions_count"),
        _records(between).alias("rights_records"),
        _records(after).alias("restriction_records"),
        extract(h, r"(?isu)Связи с другими объектами.*?Найдено\s*-\s*([0-9]+)").try_cast("int").alias("related_objects"),
    )
