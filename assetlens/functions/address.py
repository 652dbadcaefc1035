"""Russian postal addresses and listing texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extract, extract_first, filled, slug, squeeze, strip, word_tokens

# fixed values: words for kinds of street
_STREET = (
    r"улица|ул\.?|проспект|пр-?т|переулок|пер\.?|шоссе|ш\.?|набережная|наб\.?|"
    r"бульвар|б-?р|площадь|пл\.?|аллея|ал\.?"
)
# The kind of street must not start inside a word ("малыш " is no "ш ").
_STREET_FIRST = rf"(?iu)(?<![\p{{L}}])(?:{_STREET})(?U:\s+)([^,]+)"
_STREET_LAST = rf"(?iu)([^,]+?)(?U:\s+)(?:{_STREET})(?=(?U:\s)|,|$)"

# fixed values: words that say nothing about a place
STOP_WORDS = (
    "россия", "российская", "федерация", "город", "г", "москва", "ул", "улица", "пр", "проспект", "пер",
    "переулок", "д", "дом", "кв", "квартира", "вн", "тер", "муниципальный", "округ", "земельный", "участок",
    "область", "край", "республика", "район", "продаю", "продажа", "продаётся",
)


def city(address: Column) -> Column:
    """City by its label, else the part after the region, else a capital."""
    labelled = extract(address, r"(?iu)(?<![\p{L}])(?:г\.?|город)(?U:\s+)([^,]+)")
    after_region = extract(address, r"(?iu)область,(?U:\s*)([^,]+)")
    after_region = F.when(
        ~after_region.rlike(r"(?iu)^(ул|улица|пр|пер|ш|наб|б-?р|пл)"),
        F.regexp_replace(after_region, r"(?iu)^г\.?(?U:\s*)", ""),
    )
    capital = F.when(address.rlike(r"(?iu)^(г\.?(?U:\s*))?Москва"), F.lit("Москва")).when(
        address.rlike(r"(?iu)^(г\.?(?U:\s*))?Санкт-Петербург"), F.lit("Санкт-Петербург")
    )
    return F.coalesce(filled(labelled), filled(after_region), capital)


def street(address: Column) -> Column:
    """Street name without its kind and the house."""
    after = F.regexp_replace(extract(address, _STREET_LAST), r"(?iu)^.*(?:мкр\.?|район|р-н|пос\.?)(?U:\s+)", "")
    return F.coalesce(filled(extract(address, _STREET_FIRST)), filled(after))


def street_label(address: Column) -> Column:
    """Street with its kind, as written."""
    return squeeze(F.coalesce(extract(address, _STREET_FIRST, 0), extract(address, _STREET_LAST, 0)))


def street_token(address: Column) -> Column:
    """What to look for in listings: the street without a leading kind."""
    raw = F.coalesce(street(address), street_label(address))
    return filled(squeeze(F.regexp_replace(raw, rf"(?iu)^(?:{_STREET})(?U:\s+)", "")))


def on_street(listing_text: Column, token: Column) -> Column:
    """The street name, or its stem of 4+ letters, is in the listing's text."""
    hay, t = F.lower(listing_text), F.lower(token)
    stem = F.regexp_replace(t, "(ая|яя|ое|ий|ый|ой)$", "")
    return hay.contains(t) | ((F.length(stem) >= 4) & hay.contains(stem))


def street_tokens(address: Column) -> Column:
    """Words of the street part longer than two letters."""
    part = F.coalesce(
        extract(
            address,
            r"(?iu)(?<![\p{L}])(?:улица|ул\.?|проспект|пр-?т|переулок|пер\.?|шоссе|ш\.?|набережная|наб\.?|"
            r"бульвар|б-?р)(?U:\s+)([^,]+)",
        ),
        F.substring_index(address, ",", -1),
    )
    return F.filter(word_tokens(part, STOP_WORDS), lambda w: F.length(w) > 2)


def house_number(address: Column) -> Column:
    # the longer words stand first so that "дом 5" is not read as "д" + "ом 5"
    return F.lower(
        extract_first(
            address,
            [
                r"(?iu)(?<![\p{L}])(?:дом|д\.?|участок|владение|вл\.?)(?U:\s*)([0-9]+[0-9A-Za-z_/\-]*)",
                r"([0-9]+[0-9A-Za-z_/\-]*)(?U:\s*)$",
            ],
        )
    )


# fixed values: leading and inner parts a geocoder does not need
_GEOCODE_CUTS = (
    (r"(?iu)^Почтовый адрес ориентира:\s*", ""),
    (r"(?iu)^Российская Федерация,\s*", ""),
    (r"(?iu)^[А-Яа-яЁё\s-]+\s+область,\s*", ""),
    (r"(?iu)вн\.?тер\.?г\.\s*муниципальный округ\s+[^,]+,\s*", ""),
    (r"(?iu),\s*земельный участок\s+", ", "),
    (r"(?iu),\s*д\.?\s*", ", "),
    (r"(?iu),\s*улица\s+", ", "),
    (r"(?iu)город\s+Москва", "Москва"),
    (r"(?iu)город\s+Санкт-Петербург", "Санкт-Петербург"),
    (r"(?iu)^город\s+", ""),
)
_STREET_VIEW_CUTS = (
    (r"(?iu)^Почтовый адрес ориентира:\s*", ""),
    (r"(?iu)^Российская Федерация,\s*", ""),
    (r"(?iu)^[А-Яа-яЁё\s-]+\s+область,\s*", ""),
    (r"(?iu)^область\s+[^,]+,\s*", ""),
    (r"(?iu)^муниципальный округ\s+[^,]+,\s*", ""),
    (r"(?iu)вн\.?тер\.?г\.\s*муниципальный округ\s+[^,]+,\s*", ""),
    (r"(?iu)городской округ\s+[^,]+,\s*", ""),
    (r"(?iu)^г\.?\s+", ""),
    (r"(?iu),\s*д\.?\s*", ", "),
)


def _cut(address: Column, cuts: Sequence[tuple[str, str]]) -> Column:
    """Apply each cut once, to its first hit."""
    x = address
    for pattern, replacement in cuts:
        body = pattern.removeprefix("(?iu)")
        if body.startswith("^"):
            x = F.regexp_replace(x, pattern, replacement)
        else:
            x = F.regexp_replace(x, rf"(?ius)^(.*?){body}", rf"$1{replacement}")
    return strip(x)


def short_for_geocoding(address: Column) -> Column:
    return _cut(address, _GEOCODE_CUTS)


def short_for_street_view(address: Column) -> Column:
    return _cut(address, _STREET_VIEW_CUTS)


# fixed values: abbreviations spelled out before an address becomes a slug
_SPELL_OUT = (
    (r"(?iu)вн\.?\s*тер\.?\s*г\.?", "внтерг"),
    (r"(?iu)(?<![\p{L}])г\.\s*", "город "),
    (r"(?iu)(?<![\p{L}])ул\.\s*", "улица "),
    (r"(?iu)(?<![\p{L}])пер\.\s*", "переулок "),
    (r"(?iu)(?<![\p{L}])пр\.\s*", "проспект "),
    (r"(?iu)(?<![\p{L}])д\.\s*", ""),
)
_COUNTRY_PART = r"(?iu)^(российская федерация|рф|россия|федеральный округ|федеральная территория)"
_DISTRICT_PART = r"(?iu)(муниципальный округ|внутригородск|район|округ)"


def address_slug(address: Column) -> Column:
    x = squeeze(address)
    for pattern, word in _SPELL_OUT:
        x = F.regexp_replace(x, pattern, word)
    return slug(x)


def short_address_slug(address: Column) -> Column:
    """Slug of the last three parts that are neither country nor district."""
    parts = F.filter(F.transform(F.split(address, r"[,;]+"), strip), lambda p: p != "")
    parts = F.filter(parts, lambda p: ~p.rlike(_COUNTRY_PART) & ~p.rlike(_DISTRICT_PART))
    picked = F.when(F.size(parts) >= 3, F.slice(parts, -3, 3)).otherwise(parts)
    return slug(F.concat_ws(" ", picked))


def object_paths(key: Column, address: Column) -> Column:
    """Page paths to try: full slug, short slug, key alone."""
    path = lambda s: F.when(s.isNotNull(), F.concat(F.lit("/object-"), key, F.lit("-"), s, F.lit("/")))
    tries = F.array(
        path(address_slug(address)),
        path(short_address_slug(address)),
        F.concat(F.lit("/object-"), key, F.lit("/")),
    )
    return F.array_distinct(F.filter(tries, lambda p: p.isNotNull()))


def region_from_text(address: Column) -> Column:
    """Region named in an address."""
    oblast = extract(address, r"(?iu)([А-Яа-яЁё-]+(?:\s+[А-Яа-яЁё-]+)?)\s+обл(?:асть|\.)?")
    krai = extract(address, r"(?iu)([А-Яа-яЁё-]+(?:\s+[А-Яа-яЁё-]+)?)\s+край")
    return (
        F.when(oblast.isNotNull(), F.concat(F.trim(oblast), F.lit(" область")))
        .when(krai.isNotNull(), F.concat(F.trim(krai), F.lit(" край")))
        .when(address.rlike("(?iu)Москва"), F.lit("Москва"))
        .when(address.rlike("(?iu)Петербург"), F.lit("Санкт-Петербург"))
    )


def listing_kind(object_type: Column, category: Column) -> Column:
    """Commercial or land; land when nothing says otherwise."""
    text = F.lower(F.concat_ws(" ", object_type, category))
    commercial = text.rlike("здан|строен|помещен|квартир|коммер|псн|офис|торгов|нежил|building|room")
    return F.when(commercial, F.lit("commercial")).otherwise(F.lit("land"))


def search_link(base: str, region: Column, location: Column) -> Column:
    """Search page with region and location parameters."""
    arg = lambda name, v: F.when(
        filled(v).isNotNull(), F.concat(F.lit(f"{name}="), F.url_encode(v))
    )
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", arg("region", region), arg("location", location)))
