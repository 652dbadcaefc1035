"""Vehicle identifiers: routing, validation, correction, decoding, merging.

Provider rows are long: query_key, source, priority (1 = asked first),
fetched_at, the vehicle fields, ``extra`` (map), found, lookup_error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.ids import VIN_LENGTH
from ..functions.text import empty_map, extract, filled, lookup, map_first_wins, map_last_wins, non_empty, squeeze, strip

MAX_BATCH = 50
NOT_FOUND = "По этому номеру данных о марке и модели не найдено"

# fixed values: text fields of a vehicle card
FIELDS = (
    "make", "model", "model_year", "manufacturer", "series", "trim", "body_class", "vehicle_type", "doors",
    "drive_type", "fuel_type", "color", "category", "body_number", "engine_number", "power_hp", "power_kw",
    "engine_cylinders", "displacement_l", "engine_model", "engine_configuration", "transmission_style",
    "transmission_speeds", "plant_country", "plant_city", "plant_state", "gvwr",
)
_TELLING = ("make", "model", "model_year", "vehicle_type")


# --- routing --------------------------------------------------------------------------


def route_queries(lines: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per asked number: a line that looks like a plate is one plate,
    any other is a list of ids; comments and blanks go."""
    line = strip(F.col(text))
    plate = ids.is_probable_plate(line)
    listed = F.filter(F.transform(F.split(line, "[;,]"), strip), lambda x: x != "")
    asked = F.when(plate, F.array(ids.normalize_plate(line))).when(~line.startswith("#"), listed)
    out = lines.where(line != "").select(*keep, F.posexplode(asked).alias("pos", "query"), plate.alias("from_plate"))
    probable = ids.is_probable_plate(F.col("query"))
    return out.select(
        *keep,
        "pos",
        "query",
        F.when(F.col("from_plate") | probable, F.lit("plate")).otherwise(F.lit("vin")).alias("kind"),
    )


def with_batch_check(queries: DataFrame, batch: str, limit: int = MAX_BATCH) -> DataFrame:
    """Flag the numbers of batches over the size limit; none is dropped."""
    sizes = queries.groupBy(batch).agg((F.count("*") > limit).alias("batch_too_large"))
    return queries.join(sizes, batch)


# --- validation -----------------------------------------------------------------------


def vin_report(df: DataFrame, raw: str) -> DataFrame:
    """Structure and spelling report of every id."""
    c = F.col(raw)
    vin = ids.normalize_vin(c)
    out = df.withColumns({"normalized": vin, "issues": ids.structure_issues(c), "spelling": ids.spelling_issues(c)})
    countable = ~F.exists("issues", lambda i: i["code"].isin("forbidden_char", "invalid_char")) & (
        F.length("normalized") == VIN_LENGTH
    )
    sections = ids.vin_sections(F.col("normalized"))
    written = filled(c).isNotNull()
    out = out.withColumns(
        {
            "suggested": F.when(written, ids.suggested_vin(c)),
            "expected_digit": F.when(countable, ids.check_digit(F.col("normalized"))),
            "actual_digit": F.when(countable, F.substring("normalized", 9, 1)),
            "wmi": sections["wmi"],
            "vds": sections["vds"],
            "vis": sections["vis"],
            "structure_ok": F.size("issues") == 0,
            "spelling_ok": written & (F.size("spelling") == 0),
        }
    )
    return out.withColumn("valid", F.col("structure_ok") & F.col("spelling_ok"))


def issue_tally(report: DataFrame) -> DataFrame:
    """How often each issue code occurs, and in how many ids."""
    codes = report.select(
        F.explode(F.concat(F.transform("issues", lambda i: i["code"]), F.transform("spelling", lambda i: i["code"]))).alias("code"),
    )
    return codes.groupBy("code").agg(F.count("*").alias("issues"))


# --- correction -----------------------------------------------------------------------

# fixed values: confused characters (8-B, N-H, N-M, P-R, V-W, 6-9, 5-0, 2-Z),
# each written as the first of its group
_GROUP = ("BHMRW90Z", "8NNPV652")
# H and M are confused only by way of N
_TWO_STEPS = ("HM", "MH")
MAX_STEPS = 3
# with three steps at least one of four parts is untouched
_PARTS = ((1, 4), (5, 4), (9, 4), (13, 5))


def confusion_steps(a: Column, b: Column) -> Column:
    """Steps between two ids of one confusion group."""
    total = F.lit(0)
    for i in range(1, VIN_LENGTH + 1):
        x, y = F.substring(a, i, 1), F.substring(b, i, 1)
        total = total + F.when(x == y, 0).when(F.concat(x, y).isin(*_TWO_STEPS), 2).otherwise(1)
    return total


def changed_chars(a: Column, b: Column) -> Column:
    total = F.lit(0)
    for i in range(1, VIN_LENGTH + 1):
        total = total + F.when(F.substring(a, i, 1) == F.substring(b, i, 1), 0).otherwise(1)
    return total


def confusable(asked: DataFrame, known: DataFrame, vin: str = "vin", max_steps: int = MAX_STEPS) -> DataFrame:
    """(vin, candidate, steps, changed): known ids within a few confusions.

    Equal after writing every confused character as its group's first, and
    equal in one of four parts as written: an equi join on both. A pair that
    meets in several parts is kept in the first only.
    """
    if max_steps >= len(_PARTS):
        raise ValueError("the four-part blocking holds for up to three steps")
    v = F.col(vin)
    parts = F.array(*[F.substring(v, start, size) for start, size in _PARTS])

    def prepared(df: DataFrame, name: str) -> DataFrame:
        one = df.where(F.length(v) == VIN_LENGTH).select(v.alias(vin)).distinct()
        return one.select(
            v.alias(name), F.translate(v, *_GROUP).alias("_group"), F.posexplode(parts).alias("_part", "_text")
        )

    pairs = prepared(asked, "vin").join(prepared(known, "candidate"), ["_group", "_part", "_text"])
    a, b = F.col("vin"), F.col("candidate")
    earlier = F.lit(False)
    for i, (start, size) in enumerate(_PARTS):
        earlier = earlier | ((F.col("_part") > i) & (F.substring(a, start, size) == F.substring(b, start, size)))
    steps = confusion_steps(a, b)
    return (
        pairs.where(~earlier)
        .select("vin", "candidate", steps.alias("steps"), changed_chars(a, b).alias("changed"))
        .where(F.col("steps").between(1, max_steps))
    )


def best_correction(candidates: DataFrame) -> DataFrame:
    """Per id the candidate of the fewest steps, then the smallest."""
    return candidates.groupBy("vin").agg(
        F.min_by(F.struct("candidate", "steps", "changed"), F.struct("steps", "candidate")).alias("b"),
        F.count("*").alias("candidates"),
    ).select("vin", "b.candidate", "b.steps", "b.changed", "candidates")


def correction_message(candidate: Column, title: Column, changed: Column) -> Column:
    note = F.when(changed > 0, F.format_string(" (исправлено символов: %d)", changed)).otherwise("")
    return F.concat(
        F.lit("Возможно, в VIN номере ошибка. Возможно, правильный номер: "),
        candidate,
        F.lit(" — по нему найдена информация: "),
        title,
        F.lit("."),
        note,
    )


def vehicle_title(make: Column, model: Column, year: Column) -> Column:
    return F.coalesce(non_empty(F.concat_ws(" ", non_empty(make), non_empty(model), non_empty(year))), F.lit("Данные не найдены"))


# --- decoder output -------------------------------------------------------------------

# fixed values: decoder variables and the card field each fills
DECODER_FIELDS = {
    "Make": "make",
    "Model": "model",
    "Model Year": "model_year",
    "Manufacturer Name": "manufacturer",
    "Series": "series",
    "Trim": "trim",
    "Body Class": "body_class",
    "Vehicle Type": "vehicle_type",
    "Doors": "doors",
    "Drive Type": "drive_type",
    "Fuel Type - Primary": "fuel_type",
    "Engine Number of Cylinders": "engine_cylinders",
    "Displacement (L)": "displacement_l",
    "Engine Model": "engine_model",
    "Engine Configuration": "engine_configuration",
    "Transmission Style": "transmission_style",
    "Transmission Speeds": "transmission_speeds",
    "Plant Country": "plant_country",
    "Plant City": "plant_city",
    "Plant State": "plant_state",
    "Gross Vehicle Weight Rating From": "gvwr",
    "Engine Brake (hp) From": "power_hp",
    "Error Code": "error_code",
    "Error Text": "error_text",
}
# fixed values: further decoder variables kept under a label
DECODER_EXTRAS = {
    "Vehicle Descriptor": "Дескриптор",
    "Series2": "Серия 2",
    "Trim2": "Комплектация 2",
    "Note": "Примечание",
    "Base Price ($)": "Базовая цена ($)",
    "Windows": "Окна",
    "Wheel Base (inches) From": "Колёсная база (дюймы)",
    "Curb Weight (pounds)": "Снаряжённая масса (фунты)",
    "Fuel Type - Secondary": "Топливо (вторичное)",
    "Turbo": "Турбо",
    "Anti-lock Braking System (ABS)": "ABS",
    "Electronic Stability Control (ESC)": "ESC",
    "Traction Control": "Антипробуксовка",
    "Air Bag Loc Front": "Подушки спереди",
    "Air Bag Loc Side": "Подушки сбоку",
    "Seat Belt Type": "Ремни безопасности",
    "Entertainment System": "Мультимедиа",
    "Steering Location": "Расположение руля",
    "Number of Seats": "Число мест",
    "Number of Rows": "Число рядов",
    "Bed Type": "Тип кузова (пикап)",
    "Cab Type": "Тип кабины",
    "Trailer Type Connection": "Тип прицепа",
    "Battery Type": "Тип батареи",
    "EV Drive Unit": "Электропривод",
    "Electrification Level": "Уровень электрификации",
}


def last_values(eav: DataFrame, key: str, variable: str, value: str, order: str, columns: dict[str, str]) -> DataFrame:
    """Entity-attribute-value rows to one row per key; the last of equal
    variables wins. One aggregate, no pivot pass over the names."""
    return eav.groupBy(key).agg(
        *[
            F.max_by(value, F.when(F.col(variable) == name, F.col(order))).alias(out)
            for name, out in columns.items()
        ]
    )


def decoded_cards(eav: DataFrame) -> DataFrame:
    """Decoder rows (query_key, pos, variable, value) to vehicle cards."""
    rows = eav.where(F.col("variable").isNotNull() & (F.col("variable") != ""))
    rows = rows.withColumn("value", ids.clean_value(F.col("value")))
    label = lookup(DECODER_EXTRAS, F.col("variable"))
    # a later empty value does not take an earlier label's value away
    extras = (
        rows.withColumn("label", label)
        .where("label IS NOT NULL AND value IS NOT NULL")
        .groupBy("query_key", "label")
        .agg(F.max_by("value", "pos").alias("value"))
        .groupBy("query_key")
        .agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("extra"))
    )
    wide = last_values(rows, "query_key", "variable", "value", "pos", DECODER_FIELDS)
    clean = F.coalesce("error_code", F.lit("")).isin("", "0")
    unknown = {f: F.lit(None).cast("string") for f in FIELDS if f not in DECODER_FIELDS.values()}
    return (
        wide.join(extras, "query_key", "left")
        .withColumns({**unknown, "extra": F.coalesce("extra", empty_map())})
        .withColumn("found", F.coalesce("make", "model", "model_year").isNotNull() & clean)
    )


# --- provider payloads ------------------------------------------------------------------


def _money_free(c: Column) -> Column:
    return non_empty(F.regexp_replace(c, "[^0-9]", ""))


def _card(df: DataFrame, keep: Sequence[str], values: dict[str, Column]) -> DataFrame:
    blank = F.lit(None).cast("string")
    return df.select(
        *keep,
        *[values.get(f, blank).alias(f) for f in FIELDS],
        values["extra"].alias("extra"),
        values["found"].alias("found"),
        values["lookup_error"].alias("lookup_error"),
    )


def _extra(**pairs: Column) -> Column:
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()])
    return map_last_wins(F.filter(entries, lambda e: e["value"].isNotNull()))


_HISTORY = "struct<status string, message string, error string, state string, carData string>"
_HISTORY_CAR = "struct<model string, volume string, vin string, year string, color string, type string, power string>"


def history_cards(df: DataFrame, payload: str, query: str, is_plate: Column, *keep: str) -> DataFrame:
    """Cards from the history provider's JSON: ``status`` plus ``carData`` with
    one make-and-model text and the engine volume in cm3."""
    # two parses a row; nested objects come back as their JSON text
    df = df.withColumn("_p", F.from_json(payload, _HISTORY)).withColumn("_car", F.from_json("_p.carData", _HISTORY_CAR))
    at = lambda name: F.col(f"_p.{name}")
    car = lambda name: F.col(f"_car.{name}")
    truthy = ~F.coalesce(at("status"), F.lit("false")).isin("false", "0", "", "null")
    has_car = F.coalesce(~at("carData").isin("{}", "", "[]", "null"), F.lit(False))
    found = truthy & has_car
    name = squeeze(ids.fold_lookalikes(car("model")))
    make = F.substring_index(name, " ", 1)
    model = non_empty(F.regexp_replace(name, r"^\S+\s*", ""))
    volume = car("volume")
    litres = F.coalesce(
        F.regexp_replace((F.round(volume.try_cast("double") / 1000.0, 3)).cast("string"), "^$", ""), volume
    )
    vin = F.coalesce(ids.fold_lookalikes(car("vin")), F.col(query))
    no_data = F.when(is_plate, F.lit("По этому госномеру бесплатных данных нет. Попробуйте VIN, если он известен.")).otherwise(
        F.lit("По этому VIN бесплатных данных нет.")
    )
    silent = F.when(is_plate, F.lit("Сервер не вернул данные по этому госномеру")).otherwise(
        F.lit("Сервер не вернул данные по этому VIN")
    )
    error = (
        F.when(~truthy, F.coalesce(filled(at("message")), filled(at("error")), F.lit("Источник не вернул данные")))
        .when(~has_car, F.when(at("state") == "no-data", no_data).otherwise(silent))
    )
    when_found = lambda c: F.when(found, c)
    return _card(
        df,
        keep,
        {
            "make": when_found(make),
            "model": when_found(F.coalesce(model, name)),
            "model_year": when_found(car("year")),
            "color": when_found(ids.fold_lookalikes(car("color"))),
            "vehicle_type": when_found(ids.fold_lookalikes(car("type"))),
            "power_hp": when_found(car("power")),
            "displacement_l": when_found(litres),
            "extra": F.when(
                found,
                _extra(
                    **{
                        "Объём (см³)": volume,
                        "Госномер": F.when(is_plate, F.col(query)),
                        "VIN": F.when(is_plate & (vin != F.col(query)), vin),
                    }
                ),
            ).otherwise(empty_map()),
            "found": found,
            "lookup_error": error,
        },
    )


_REPORT = (
    "struct<status string, error string, report struct<header struct<title string>, vin string, "
    "pts_info map<string, string>, vehicle map<string, string>>>"
)


def report_cards(df: DataFrame, payload: str, query: str, *keep: str) -> DataFrame:
    """Cards from the report provider's JSON: registration block first, then
    the vehicle block, then the report's title (``Make Model, 2016``)."""
    # nested objects come back as their JSON text
    df = df.withColumn("_p", F.from_json(payload, _REPORT))

    def field(*places: tuple[str, str]) -> Column:
        # a field is a plain value or an object with one of these texts
        tries = []
        for block, name in places:
            raw = F.try_element_at(F.col(f"_p.report.{block}"), F.lit(name))
            inner = F.coalesce(*[F.get_json_object(raw, f"$.{k}") for k in ("value", "text", "name")])
            tries.append(F.when(raw.startswith("{"), inner).otherwise(raw))
        return F.coalesce(*[ids.fold_lookalikes(x) for x in tries])

    title = ids.fold_lookalikes(F.col("_p.report.header.title"))
    head = squeeze(extract(title, r"^([^,]+?)(?:,\s*[0-9]{4})?$"))
    title_year = extract(title, r"^[^,]+?,\s*([0-9]{4})$")
    make0, model0 = field(("pts_info", "mark"), ("vehicle", "mark")), field(("pts_info", "model"), ("vehicle", "model"))
    year0 = field(("pts_info", "year"), ("vehicle", "year"))
    year0 = F.coalesce(_money_free(year0), year0)
    from_title = make0.isNull() & model0.isNull() & head.isNotNull()
    make = F.when(from_title, F.substring_index(head, " ", 1)).otherwise(make0)
    model = F.when(from_title, non_empty(F.regexp_replace(head, r"^\S+\s*", ""))).otherwise(model0)
    year = F.when(from_title, F.coalesce(year0, title_year)).otherwise(year0)
    vin = F.coalesce(
        ids.fold_lookalikes(F.try_element_at("_p.report.pts_info", F.lit("vin"))), ids.fold_lookalikes(F.col("_p.report.vin"))
    )
    failed = F.coalesce((F.col("_p.status") == "ERROR") | filled(F.col("_p.error")).isNotNull(), F.lit(False))
    nothing = F.coalesce(make, model, year, vin).isNull()
    code = F.coalesce(ids.fold_lookalikes(F.col("_p.error")), F.lit("NOT_FOUND"))
    missing = F.lit("По этому госномеру данных не найдено")
    error = F.when(
        failed, F.when(F.upper(code).isin("NOT_FOUND", "NOT_FOUND_ERROR"), missing).otherwise(F.concat(F.lit("Отчёт: "), code))
    ).when(nothing, missing)
    found = ~failed & ~nothing
    power, color, volume = field(("pts_info", "horse_power")), field(("pts_info", "color")), field(("pts_info", "displacement"))
    when_found = lambda c: F.when(found, c)
    return _card(
        df,
        keep,
        {
            "make": when_found(make),
            "model": when_found(model),
            "model_year": when_found(year),
            "color": when_found(color),
            "power_hp": when_found(_money_free(power)),
            "extra": F.when(
                found,
                _extra(
                    **{
                        "Госномер": F.col(query),
                        "VIN": vin,
                        "Цвет": color,
                        "Мощность": power,
                        "Объём": volume,
                        "Заголовок отчёта": title,
                    }
                ),
            ).otherwise(empty_map()),
            "found": found,
            "lookup_error": error,
        },
    )


# --- merge and waterfall ----------------------------------------------------------------


def _has_data() -> Column:
    return F.coalesce(*[non_empty(F.col(c)) for c in _TELLING]).isNotNull()


def latest_per_source(rows: DataFrame) -> DataFrame:
    """One row per (query_key, source): the latest fetch."""
    kept = rows.groupBy("query_key", "source").agg(F.max_by(F.struct(*rows.columns), "fetched_at").alias("r"))
    return kept.select("r.*")


def merge_sources(rows: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """One card per key: first non-empty field by priority, maps merged with
    the earlier source winning, sources in order, found if any is.

    Rows must be one per (key, source); their number per key is that of the
    sources, so the small per-key lists below stay small. One shuffle for any
    number of sources.
    """
    gives = F.coalesce(F.col("found"), F.lit(False)) | (F.size(F.coalesce("extra", empty_map())) > 0)
    for name in ("make", "model"):
        if name in fields:
            gives = gives | non_empty(F.col(name)).isNotNull()
    # the first source is the base whether or not it gives anything
    first = lambda c: F.min_by(c, F.when(non_empty(F.col(c)).isNotNull() & F.col("_gives"), F.col("priority"))).alias(c)
    merged = (
        rows.withColumn("_gives", gives)
        .groupBy("query_key")
        .agg(
            *[first(c) for c in fields],
            F.array_sort(
                F.collect_list(
                    F.struct("priority", "source", F.map_entries(F.coalesce("extra", empty_map())).alias("extra"), "_gives")
                )
            ).alias("_all"),
            F.coalesce(F.bool_or("found"), F.lit(False)).alias("found"),
            F.min_by("source", F.when(F.col("found"), F.col("priority"))).alias("_found_source"),
            F.min_by("source", "priority").alias("_first_source"),
            F.min_by("lookup_error", "priority").alias("_error"),
        )
    )
    entries = F.flatten(
        F.transform(F.filter("_all", lambda x: x["_gives"]), lambda x: x["extra"])
    )
    return merged.select(
        "query_key",
        *fields,
        map_first_wins(entries).alias("extra"),
        F.array_distinct(F.transform("_all", lambda x: x["source"])).alias("sources_used"),
        "found",
        F.coalesce("_found_source", "_first_source").alias("source"),
        F.when(~F.col("found"), F.col("_error")).alias("lookup_error"),
    )


def is_rate_limited(error: Column) -> Column:
    e = F.lower(F.coalesce(error, F.lit("")))
    return e.contains("429") | e.contains("слишком много запросов") | e.contains("временно ограничил")


def is_soft_miss(error: Column, has_data: Column) -> Column:
    """An empty answer, not a broken connection: the next source may be asked."""
    e = F.lower(F.coalesce(error, F.lit("")))
    blocked = e.contains("csrf") | e.contains("не открыть /history")
    broken = e.rlike("429|недоступен|сети|таймаут")
    return ~has_data & (blocked | ~broken)


def waterfall(attempts: DataFrame) -> DataFrame:
    """Per key the first attempt with vehicle data; where there is none the most
    telling miss: rate limit, then the first hard miss, then the last one."""
    rows = attempts.withColumn("_data", _has_data())
    row = F.struct(*attempts.columns)
    error = F.col("lookup_error")
    wrong = non_empty(error).isNotNull()
    when = lambda cond, order: F.when(cond, order)
    rank = F.col("priority")
    picked = rows.groupBy("query_key").agg(
        F.min_by(row, when(F.col("_data"), rank)).alias("hit"),
        F.min_by(row, when(is_rate_limited(error), rank)).alias("limited"),
        F.min_by(row, when(wrong & ~is_soft_miss(error, F.col("_data")), rank)).alias("hard"),
        F.max_by(row, when(wrong, rank)).alias("soft"),
        F.min_by(row, rank).alias("any"),
    )
    columns = [c for c in attempts.columns if c not in ("query_key", "found", "lookup_error")]
    chosen = F.coalesce("hit", "limited", "hard", "soft", "any")
    hit = F.col("hit").isNotNull()
    return picked.withColumn("c", chosen).select(
        "query_key",
        *[F.col(f"c.{c}").alias(c) for c in columns],
        hit.alias("found"),
        F.when(~hit, F.coalesce(non_empty(F.col("c.lookup_error")), F.lit(NOT_FOUND))).alias("lookup_error"),
    )


def enrich_by_id(cards: DataFrame, decoded: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Fill empty fields from cards decoded by the vehicle id found in ``extra``.

    ``decoded`` has one row per query_key, which is the id here.
    """
    vin = F.try_element_at("extra", F.lit("VIN"))
    usable = (F.length(vin) == VIN_LENGTH) & ~vin.contains("*")
    left = cards.withColumn("_vin", F.when(F.col("found") & usable, vin))
    right = decoded.select(
        F.col("query_key").alias("_vin"), F.struct(*fields, "extra").alias("_d"), F.lit(True).alias("_known")
    )
    joined = left.join(right, "_vin", "left")
    merged = joined.withColumns(
        {
            **{f: F.coalesce(non_empty(F.col(f)), F.col(f"_d.{f}")) for f in fields},
            "extra": map_first_wins(
                F.concat(
                    F.map_entries(F.coalesce("extra", empty_map())), F.map_entries(F.coalesce("_d.extra", empty_map()))
                )
            ),
        }
    )
    return merged.select(*cards.columns)


def fresh_cache(rows: DataFrame, key: str, fetched_at: str, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """Latest found row per key that is still within its time to live."""
    found = rows.where("found")
    kept = found.groupBy(key).agg(F.max_by(F.struct(*rows.columns), fetched_at).alias("r")).select("r.*")
    return kept.where(F.col(fetched_at) + F.make_dt_interval(secs=F.lit(ttl_seconds)) >= now)


def batch_report(cards: DataFrame) -> DataFrame:
    return cards.agg(
        F.count("*").alias("total"),
        F.count_if("found").alias("found"),
        F.count_if(~F.coalesce("found", F.lit(False))).alias("not_found"),
    )
