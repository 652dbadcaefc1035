"""Listings against registry objects: mentions, relevance, radius, de-duplication.

Listings carry object_key, source, id, url, title, address, description, price,
area, distance, matched_by, suitable and seq (arrival order within a source).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import address as addr
from ..functions.ids import key_variants, text_mentions
from ..functions.numbers import distance_km, round_half_up
from ..functions.text import lookup
from .sums import running_sums

MIN_RELEVANCE = 50
# fixed values: points per kind of match, and which kind beats which
MATCH_POINTS = {"analog": 60, "street": 55, "address": 45, "region": 40}
MATCH_RANK = {"analog": 4, "street": 3, "address": 2, "region": 1}
RADIUS_STEPS = (30.0, 50.0, 100.0)
MIN_HITS = 3


def _map(values: dict[str, int], c: Column) -> Column:
    return F.coalesce(lookup(values, c), F.lit(0))


# --- relevance --------------------------------------------------------------------


def object_terms(objects: DataFrame, key: str = "object_key", address: str = "object_address") -> DataFrame:
    """What relevance looks for, worked out once per object: written variants
    of the key, city, street words, house number."""
    a = F.col(address)
    once = objects.groupBy(key).agg(F.min(address).alias(address))
    return once.select(
        key,
        F.transform(key_variants(F.coalesce(F.col(key), F.lit(""))), F.lower).alias("_variants"),
        addr.city(a).alias("_city"),
        addr.street_tokens(F.coalesce(a, F.lit(""))).alias("_street"),
        addr.house_number(a).alias("_house"),
    )


def with_relevance(listings: DataFrame, objects: DataFrame, key: str = "object_key", object_address: str = "object_address") -> DataFrame:
    """Score and reasons of listings against the object they were found for.

    ``objects`` has one address per key; only its few derived terms travel to
    the listings.
    """
    matched = F.col("matched_by")
    joined = listings.join(object_terms(objects, key, object_address), key)
    prepared = joined.withColumn("_hay", F.lower(F.concat_ws(" ", "title", "description", "address"))).withColumns(
        {
            "_words": addr.word_tokens(F.col("_hay"), addr.STOP_WORDS),
            "_key_hit": F.exists("_variants", lambda v: F.col("_hay").contains(v)),
        }
    )
    prepared = prepared.withColumn("_hits", F.filter("_street", lambda t: F.array_contains("_words", t)))
    hits, asked = F.size("_hits"), F.size("_street")
    street_points = (
        F.when((asked >= 2) & (hits >= 2), hits * 25).when((asked == 1) & (hits == 1), F.lit(30)).otherwise(F.lit(0))
    )
    city_hit = F.coalesce(F.col("_hay").contains(F.lower("_city")), F.lit(False))
    house_hit = F.coalesce((hits > 0) & F.col("_hay").contains(F.col("_house")), F.lit(False))
    score = (
        F.when(F.col("_key_hit"), F.lit(100)).otherwise(F.lit(0))
        + _map(MATCH_POINTS, matched)
        + F.when(city_hit, F.lit(20)).otherwise(F.lit(0))
        + street_points
        + F.when(house_hit, F.lit(25)).otherwise(F.lit(0))
    )
    reasons = F.array(
        F.when(F.col("_key_hit"), F.lit("кадастровый номер в тексте объявления")),
        F.when(
            matched == "analog",
            F.concat(F.lit("аналог"), F.coalesce(F.concat(F.lit(" ("), F.col("distance"), F.lit(")")), F.lit(""))),
        )
        .when(matched == "street", F.lit("тот же город и улица"))
        .when(matched == "address", F.lit("тот же город"))
        .when(matched == "region", F.lit("тот же регион")),
        F.when(city_hit, F.concat(F.lit("город ("), F.col("_city"), F.lit(")"))),
        F.when(
            street_points > 0, F.concat(F.lit("совпадение улицы ("), F.array_join("_hits", ", "), F.lit(")"))
        ),
        F.when(house_hit, F.concat(F.lit("совпадение номера ("), F.col("_house"), F.lit(")"))),
        F.when(matched == "street", F.lit("объявление на той же улице")),
    )
    return prepared.withColumns(
        {"score": score, "reasons": F.filter(reasons, lambda r: r.isNotNull()), "mentions_key": F.col("_key_hit")}
    ).drop("_hay", "_city", "_street", "_house", "_words", "_hits", "_key_hit", "_variants")


def keep_relevant(scored: DataFrame) -> DataFrame:
    """The key is named, or the kind of match is known, or the score suffices."""
    return scored.where(
        F.col("mentions_key") | F.col("matched_by").isin(*MATCH_POINTS) | (F.col("score") >= MIN_RELEVANCE)
    )


def most_relevant_first(scored: DataFrame) -> DataFrame:
    return scored.orderBy("object_key", F.desc("score"), "seq")


def shared_tokens(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


# --- one row per listing ------------------------------------------------------------


def keep_best(df: DataFrame, keys: Sequence[str | Column], better: Sequence[Column]) -> DataFrame:
    """The best row per key; ``better`` sorts best first.

    An aggregate, not a window: each map task keeps one row per key before the
    shuffle, so a key with a third of all rows costs nothing extra.
    """
    named = [k if isinstance(k, Column) else F.col(k) for k in keys]
    kept = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(named)]).agg(
        F.min_by(F.struct(*df.columns), F.struct(*better)).alias("_row")
    )
    return kept.select("_row.*")


def dedupe_listings(scored: DataFrame, per: Sequence[str] = ("object_key",)) -> DataFrame:
    """Highest score per source and id (or url); the earlier row wins a tie."""
    ident = F.coalesce(F.when(F.col("id") != "", F.col("id")), F.col("url"))
    return keep_best(scored, [*per, "source", ident], [-F.coalesce("score", F.lit(0)), F.col("seq")])


def dedupe_matches(found: DataFrame, per: Sequence[str] = ("object_key",)) -> DataFrame:
    """Strongest kind of match per listing id; the first row wins a tie."""
    return keep_best(found, [*per, "id"], [-_map(MATCH_RANK, F.col("matched_by")), F.col("seq")])


def first_by_link(results: DataFrame, per: Sequence[str] = ("object_key",)) -> DataFrame:
    """First arrival per url, or per title where there is none."""
    link = F.coalesce(F.when(F.col("url") != "", F.col("url")), F.col("title"))
    return keep_best(results, [*per, link], [F.col("seq")])


# --- street and radius ---------------------------------------------------------------


def refine_by_street(found: DataFrame, per: str = "object_key", city: str = "city", token: str = "street_token") -> DataFrame:
    """Where city and street are known and any listing is on the street, keep
    those, of them the ones in the city if there are any.

    The flags are aggregated per object and joined back, so an object with very
    many listings is not held in one task.
    """
    asked = F.col(city).isNotNull() & F.col(token).isNotNull()
    text = F.concat_ws(" ", F.coalesce("address", F.lit("")), F.coalesce("title", F.lit("")))
    on_street = asked & F.coalesce(addr.on_street(text, F.col(token)), F.lit(False))
    in_city = on_street & F.coalesce(F.lower("address").contains(F.lower(F.col(city))), F.lit(False))
    level = F.when(in_city, F.lit(2)).when(on_street, F.lit(1)).otherwise(F.lit(0))
    tagged = found.withColumn("_level", level)
    best = tagged.groupBy(per).agg(F.max("_level").alias("_best"))
    return (
        tagged.join(best, per)
        .where(F.col("_level") >= F.col("_best"))
        .withColumn("matched_by", F.when(F.col("_best") > 0, F.lit("street")).otherwise(F.col("matched_by")))
        .drop("_level", "_best")
    )


def within_radius(
    found: DataFrame,
    per: str = "object_key",
    steps: Sequence[float] = RADIUS_STEPS,
    min_hits: int = MIN_HITS,
    km: str | None = None,
) -> DataFrame:
    """Listings within the smallest radius that holds ``min_hits`` (else the
    largest); listings without a distance stay only when matched by street or
    address. Adds distance_km, radius_km and near_count.
    """
    d = F.col("distance_km")
    located = found.withColumn("distance_km", F.col(km).cast("double") if km else distance_km(F.col("distance")))
    counts = located.groupBy(per).agg(
        *[F.count_if(d <= s).alias(f"_n{i}") for i, s in enumerate(steps)]
    )
    radius = F.coalesce(
        *[F.when(F.col(f"_n{i}") >= min_hits, F.lit(float(s))) for i, s in enumerate(steps)], F.lit(float(steps[-1]))
    )
    chosen = counts.select(per, radius.alias("radius_km"), F.col("_n0").alias("near_count"))
    by_place = d.isNull() & F.coalesce(F.col("matched_by").isin("street", "address"), F.lit(False))
    return located.join(chosen, per).where((d <= F.col("radius_km")) | by_place)


def nearest_first(kept: DataFrame, per: str = "object_key") -> DataFrame:
    return kept.orderBy(per, F.col("distance_km").asc_nulls_last(), "seq")


def counts_by_source(listings: DataFrame) -> DataFrame:
    return listings.groupBy("source").agg(F.count("*").alias("listings"))


# --- mentions ------------------------------------------------------------------------


def number_tokens(c: Column) -> Column:
    """Distinct digit runs of a text."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1)))


def token_mentions(docs: DataFrame, doc_id: str, text: str, tokens: DataFrame, token: str) -> DataFrame:
    """(doc_id, token) where a number of the list stands in the text."""
    found = docs.select(F.col(doc_id).alias("doc_id"), F.explode(number_tokens(F.col(text))).alias("token"))
    wanted = tokens.select(F.col(token).cast("string").alias("token")).distinct()
    return found.join(wanted, "token")


def _tail_keys(variant: Column) -> Column:
    # the last two numbers with the separator between them
    return F.regexp_extract(variant, r"([0-9]+[: -][0-9]+)$", 1)


def mentions(docs: DataFrame, doc_id: str, text: str, objects: DataFrame, key: str) -> DataFrame:
    """(doc_id, key) where the text holds any written variant of the key.

    Not every text against every key: both sides meet on the variant's last two
    numbers. A text number may go on left of the first or right of the second,
    so each neighbouring pair offers its endings x beginnings, none longer than
    the longest among the keys: a run of many digits offers no more than a short
    one. The substring test then runs on the few pairs that met.
    """
    keys = objects.select(F.col(key).alias("key")).distinct()
    tails = keys.select(
        "key", F.explode(F.array_distinct(F.transform(key_variants(F.col("key")), _tail_keys))).alias("tail")
    ).where("tail <> ''")
    pairs = F.array_distinct(
        F.regexp_extract_all(F.col(text), F.lit("(?<![0-9])(?=([0-9]+[: -][0-9]+))"), F.lit(1))
    )
    found = docs.select(F.col(doc_id).alias("doc_id"), F.explode(pairs).alias("pair"))
    numbers = "^([0-9]+)([: -])([0-9]+)$"
    longest = lambda g: tails.agg(F.max(F.length(F.regexp_extract("tail", numbers, g)))).scalar()
    left, mark, right = (F.regexp_extract("pair", numbers, g) for g in (1, 2, 3))
    found = found.select(
        "doc_id", left.alias("l"), mark.alias("m"), right.alias("r"), longest(1).alias("_l"), longest(3).alias("_r")
    ).withColumn("l", F.explode(F.transform(F.sequence(F.greatest(F.lit(1), F.length("l") - F.col("_l") + 1), F.length("l")), lambda i: F.substring("l", i, F.length("l")))))
    found = found.withColumn(
        "r", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("r"), F.col("_r"))), lambda i: F.substring("r", F.lit(1), i)))
    )
    met = (
        found.select("doc_id", F.concat("l", "m", "r").alias("tail"))
        .join(tails, "tail")
        .select("doc_id", "key")
        .distinct()
    )
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return met.join(texts, "doc_id").where(text_mentions(F.col("_text"), F.col("key"))).select("doc_id", "key")


# --- comparables -----------------------------------------------------------------------


def area_range(area_m2: Column, land: Column) -> Column:
    """Search bounds of +-30 %: land in hundredths of a hectare to 0.1, else m2."""
    plots = area_m2 / 100.0
    tenth = lambda x: round_half_up(x * 10) / 10.0
    known = area_m2 > 0
    low = F.when(land, F.greatest(F.lit(0.1), tenth(plots * 0.7))).otherwise(
        F.greatest(F.lit(1.0), round_half_up(area_m2 * 0.7).cast("double"))
    )
    high = F.when(land, tenth(plots * 1.3)).otherwise(round_half_up(area_m2 * 1.3).cast("double"))
    return F.struct(F.when(known, low).alias("low"), F.when(known, high).alias("high"))


def comparables(
    objects: DataFrame, listings: DataFrame, block: Sequence[str], low: str, high: str, value: str, base: float = 1.3
) -> DataFrame:
    """Listings of the object's block whose ``value`` lies between its bounds.

    A range join made an equi join: values fall in bands that grow by ``base``
    on either side of zero, an object asks only for the bands its bounds touch.
    """

    def band(c: Column) -> Column:
        size = F.floor(F.ln(F.greatest(F.abs(c), F.lit(1.0))) / math.log(base)) + 1
        return F.when(c < 0, -size).otherwise(size).cast("bigint")

    asked = objects.where(F.col(low) <= F.col(high)).withColumn(
        "_band", F.explode(F.sequence(band(F.col(low)), band(F.col(high))))
    )
    offered = listings.where(F.col(value).isNotNull()).withColumn("_band", band(F.col(value)))
    return (
        asked.join(offered, [*block, "_band"]).where(F.col(value).between(F.col(low), F.col(high))).drop("_band")
    )


def comparable_totals(
    objects: DataFrame, listings: DataFrame, block: Sequence[str], low: str, high: str, value: str, bands_per_unit: float
) -> DataFrame:
    """Per object, how many listings of its block lie between its bounds and
    what their values sum to, without forming a single pair.

    An object needs the running sum below its lower and up to its upper bound.
    Listings collapse to (block, value) sums first and bounds to distinct ones,
    so neither a crowded block nor one popular value grows the work.
    ``bands_per_unit`` sets how finely a block is split over tasks; the result
    does not depend on it.
    """
    keys = list(block)
    points = (
        listings.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("v"))
        .agg(F.count("*").alias("n"), F.sum(value).alias("s"))
        .withColumn("kind", F.lit(1))
    )
    # at equal values a lower bound sorts before the points, an upper one after
    asks = (
        objects.select(*keys, F.col(low).alias("v"), F.lit(0).alias("kind"))
        .unionByName(objects.select(*keys, F.col(high).alias("v"), F.lit(2).alias("kind")))
        .where("v IS NOT NULL")
        .distinct()
    )
    sums = running_sums(points.unionByName(asks, allowMissingColumns=True), keys, "v", ["kind"], ["n", "s"], bands_per_unit)
    at = lambda kind, name: sums.where(F.col("kind") == kind).select(
        *keys, F.col("v").alias(name), F.struct("n_upto", "s_upto").alias(f"_{name}")
    )
    joined = objects.join(at(0, low), [*keys, low], "left").join(at(2, high), [*keys, high], "left")
    return joined.select(
        *objects.columns,
        (F.col(f"_{high}.n_upto") - F.col(f"_{low}.n_upto")).alias("comparables"),
        (F.col(f"_{high}.s_upto") - F.col(f"_{low}.s_upto")).alias("value_sum"),
    )


# --- map points -------------------------------------------------------------------------


def with_fallback_point(objects: DataFrame, gazetteer: DataFrame, address: str, lon: str, lat: str) -> DataFrame:
    """Point of the address where the object has none, flagged approximate.

    ``gazetteer`` has address, lon and lat.
    """
    known = gazetteer.groupBy(F.col("address").alias(address)).agg(F.min(F.struct("lon", "lat")).alias("_p"))
    missing = F.col(lon).isNull() | F.col(lat).isNull()
    return (
        objects.join(known, address, "left")
        .withColumn("approximate", missing & F.col("_p").isNotNull())
        .withColumns(
            {
                lon: F.when(missing, F.col("_p.lon")).otherwise(F.col(lon)),
                lat: F.when(missing, F.col("_p.lat")).otherwise(F.col(lat)),
            }
        )
        .drop("_p")
    )


# fixed values: regions by the first part of a cadastral key
REGIONS = {
    1: "Адыгея", 2: "Башкортостан", 3: "Бурятия", 4: "Алтай", 5: "Дагестан", 6: "Ингушетия",
    7: "Кабардино-Балкария", 8: "Калмыкия", 9: "Карачаево-Черкесия", 10: "Карелия", 11: "Коми", 12: "Марий Эл",
    13: "Мордовия", 14: "Саха (Якутия)", 15: "Северная Осетия", 16: "Татарстан", 17: "Тыва", 18: "Удмуртия",
    19: "Хакасия", 20: "Чечня", 21: "Чувашия", 22: "Алтайский край", 23: "Краснодарский край",
    24: "Красноярский край", 25: "Приморский край", 26: "Ставропольский край", 27: "Хабаровский край",
    28: "Амурская область", 29: "Архангельская область", 30: "Астраханская область", 31: "Белгородская область",
    32: "Брянская область", 33: "Владимирская область", 34: "Волгоградская область", 35: "Вологодская область",
    36: "Воронежская область", 37: "Ивановская область", 38: "Иркутская область", 39: "Калининградская область",
    40: "Калужская область", 41: "Камчатский край", 42: "Кемеровская область", 43: "Кировская область",
    44: "Костромская область", 45: "Курганская область", 46: "Курская область", 47: "Ленинградская область",
    48: "Липецкая область", 49: "Магаданская область", 50: "Московская область", 51: "Мурманская область",
    52: "Нижегородская область", 53: "Новгородская область", 54: "Новосибирская область", 55: "Омская область",
    56: "Оренбургская область", 57: "Орловская область", 58: "Пензенская область", 59: "Пермский край",
    60: "Псковская область", 61: "Ростовская область", 62: "Рязанская область", 63: "Самарская область",
    64: "Саратовская область", 65: "Сахалинская область", 66: "Свердловская область", 67: "Смоленская область",
    68: "Тамбовская область", 69: "Тверская область", 70: "Томская область", 71: "Тульская область",
    72: "Тюменская область", 73: "Ульяновская область", 74: "Челябинская область", 75: "Забайкальский край",
    76: "Ярославская область", 77: "Москва", 78: "Санкт-Петербург", 79: "Еврейская АО", 86: "Ханты-Мансийский АО",
    89: "Ямало-Ненецкий АО", 91: "Крым", 92: "Севастополь",
}


def region(key: Column, address: Column) -> Column:
    """Region by the key's first part, else by the address."""
    code = F.substring_index(key, ":", 1).try_cast("int")
    return F.coalesce(lookup(REGIONS, code), addr.region_from_text(address))
