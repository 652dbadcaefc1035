"""Names and classifiers of register objects: labelled text, codes, the report
name of several lines and the older one-line name.

The name builders add several intermediate columns (all prefixed ``_n_``) and
drop them, so that a map is parsed once per row and not once per use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import (
    empty_map,
    entry_if,
    extract,
    first_bare_chunk,
    first_by_rules,
    let,
    lookup,
    map_first_wins,
    map_last_wins,
    map_merge,
    non_empty,
    semicolon_entries,
    squeeze,
    strip,
)

# fixed values: labels inside cells and the field each names
LABELS = {
    "вид обеспечения": "kind",
    "описание обеспечения": "description",
    "местонахождение обеспечения": "location",
    "год выпуска": "year",
    "vin номер": "vin",
    "vin": "vin",
    "vin-код": "vin",
    "кадастровый номер": "cadastral",
    "площадь": "area",
    "марка": "brand",
    "модель": "model",
    "наименование": "description",
    "наименование объекта": "description",
    "категория качества": "quality",
}
# fixed values: kinds by third-level code, and the words that lead to a code
CODE_KINDS = {
    "310.01": "легковой автомобиль",
    "310.02": "грузовой автомобиль",
    "101.01": "квартира",
    "102.03": "коммерческое помещение",
    "101.02": "жилой дом",
    "201.05": "земельный участок",
}
CODE_WORDS = (
    ("легковой", "310.01"),
    ("грузовой", "310.02"),
    ("квартира|жилое помещение", "101.01"),
    ("коммерческое помещение|офис", "102.03"),
    ("земельный участок", "201.05"),
    ("жилой дом", "101.02"),
)
NO_CODE = "999.99"

VIN_LIKE = "^[A-HJ-NPR-Z0-9]{11,17}$"
CADASTRAL = "^[0-9]{2}:[0-9]{2}:[0-9]+:[0-9]+$"
_MARK = "[:：\\-–—]"
_ANY_LABEL = "|".join(sorted(LABELS, key=len, reverse=True))
_STRUCTURED = "(?iu)вид обеспечения|описание обеспечения|местонахождение обеспечения"


def _edges(c: Column, chars: str = " \\t,;") -> Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


# --- labels -----------------------------------------------------------------------


def _normal_label(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(strip(c)), ":+$", ""))


def label_key(c: Column) -> Column:
    """Field a label names, null for any other text."""
    return lookup(LABELS, _normal_label(c))


def is_label(c: Column) -> Column:
    return F.coalesce(_normal_label(c).isin(*LABELS), F.lit(False))


def segments_of(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[\n\t]+"), strip), lambda s: s != "")


def neighbour_entries(segments: Column) -> Column:
    """A label followed by something that is none: (field, value) structs."""

    def pairs(segs: Column) -> Column:
        return F.transform(
            segs,
            lambda s, i: F.struct(
                label_key(s).alias("key"),
                F.when(~is_label(F.get(segs, i + 1)), strip(F.get(segs, i + 1))).alias("value"),
            ),
        )

    return F.filter(let(segments, pairs), lambda p: p["key"].isNotNull() & p["value"].isNotNull())


def neighbour_fields(segments: Column) -> Column:
    return map_first_wins(neighbour_entries(segments))


def labelled_fields(c: Column) -> Column:
    """Labelled text to a map: ``label: value``, then ``label value``; pairs of
    neighbouring lines or cells override both. A value ends at the next label."""
    text = strip(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    marked = rf"(?iu)({_ANY_LABEL})\s*{_MARK}\s*"
    spaced = rf"(?isu)({_ANY_LABEL})\s+(.+?)(?=\s+(?:{_ANY_LABEL})\s+|\z)"
    empty = F.array().cast("array<struct<key:string,value:string>>")

    def usable(entries: Column) -> Column:
        return F.filter(entries, lambda p: p["key"].isNotNull() & (p["value"] != ""))

    def after_marks(t: Column) -> Column:
        # one pass: every "label:" starts a piece, its value is the rest of it
        pieces = F.split(F.regexp_replace(t, marked, "\u0001$1\u0002"), "\u0001")
        return usable(
            F.transform(
                F.filter(pieces, lambda x: x.contains("\u0002")),
                lambda x: F.struct(
                    label_key(F.substring_index(x, "\u0002", 1)).alias("key"),
                    _edges(squeeze(F.substring_index(x, "\u0002", -1))).alias("value"),
                ),
            )
        )

    def after_blanks(t: Column) -> Column:
        hits = F.regexp_extract_all(t, F.lit(spaced), F.lit(0))
        found = F.transform(
            hits,
            lambda h: F.struct(
                label_key(F.regexp_extract(h, spaced, 1)).alias("key"),
                _edges(squeeze(F.regexp_extract(h, spaced, 2))).alias("value"),
            ),
        )
        return F.when(t.rlike(rf"(?iu)(?:{_ANY_LABEL})\s+[^\s]"), usable(found)).otherwise(empty)

    def read(t: Column) -> Column:
        flat = F.regexp_replace(t, r"[\n\t]+", " ")
        inline = map_first_wins(F.concat(after_marks(t), after_blanks(flat)))
        full = F.map_zip_with(inline, neighbour_fields(segments_of(t)), lambda _k, a, b: F.coalesce(b, a))
        return F.when(t.rlike(rf"(?iu){_ANY_LABEL}"), full).otherwise(empty_map())

    return let(text, read)


def has_label_layout(segments: Column) -> Column:
    """The first cell is a label, or at least two are."""
    return F.coalesce(is_label(F.get(segments, F.lit(0))), F.lit(False)) | (F.size(F.filter(segments, is_label)) >= 2)


def description_segments(cells: Column, classifier_at: Column, cost_at: Column) -> Column:
    """Filled cells between classifier and cost, if they lie as label/value."""
    start = F.when(classifier_at < 0, F.lit(1)).otherwise(classifier_at)
    stop = F.least(F.when(cost_at < 0, F.size(cells)).otherwise(cost_at), F.size(cells))
    part = F.slice(cells, start + 1, F.greatest(stop - start, F.lit(0)))
    found = F.filter(F.transform(part, lambda c: strip(F.coalesce(c, F.lit("")))), lambda c: c != "")
    return F.when(has_label_layout(found), found).otherwise(F.array().cast("array<string>"))


def description_fields(raw: Column, segments: Column) -> Column:
    """Fields of the name cell, filled up from the row's label/value cells."""
    return map_merge(map_merge(labelled_fields(raw), labelled_fields(F.array_join(segments, "\t"))), neighbour_fields(segments))


# --- classifier -------------------------------------------------------------------


def code_from_text(c: Column) -> Column:
    """Third-level code by key words, 999.99 when none is there."""
    return let(F.lower(F.coalesce(c, F.lit(""))), lambda t: first_by_rules(t, CODE_WORDS, F.lit(NO_CODE)))


def normal_code(c: Column) -> Column:
    """``dddddd``, ``ddddd`` or ``ddd.dd`` to the dotted form, else ''."""
    t = F.replace(strip(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit(""))
    digits = F.regexp_replace(t, "[^0-9]", "")
    dotted = F.concat(F.substring(digits, 1, 3), F.lit("."), F.substring(digits, 4, 3))
    return F.when(t.rlike(r"^[0-9]{3}\.[0-9]{2}$"), t).when(F.length(digits).isin(5, 6), dotted).otherwise(F.lit(""))


def is_code(c: Column) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    compact = F.replace(t, F.lit(" "), F.lit(""))
    return t.isin("", NO_CODE) | (~is_label(t) & compact.rlike(r"^([0-9]{3}\.[0-9]{2}|[0-9]{4,6})$"))


def label_of_code(c: Column) -> Column:
    return let(lookup(CODE_KINDS, normal_code(c)), _cap)


def classifier_display(raw: Column, code: Column) -> Column:
    """Classifier without codes; a dash when there is nothing to show."""

    def shown(r: Column) -> Column:
        plain = F.when(~is_code(r), r)
        return F.coalesce(F.when(~is_label(r), plain), label_of_code(r), label_of_code(code), plain, F.lit("—"))

    return let(strip(F.coalesce(raw, F.lit(""))), shown)


def kind_label(raw: Column, code: Column, fields: Column) -> Column:
    """Kind in lower case: stated, else the classifier text, else the code's."""
    stated = F.lower(strip(F.try_element_at(fields, F.lit("kind"))))
    part = strip(F.substring_index(F.coalesce(raw, F.lit("")), "/", 1))
    from_text = F.when(~strip(F.coalesce(raw, F.lit(""))).rlike(r"^[0-9.]+$") & ~is_label(part), F.lower(non_empty(part)))
    return F.coalesce(non_empty(stated), from_text, lookup(CODE_KINDS, code), F.lit(""))


def kind_code(kind: Column, raw: Column, code: Column) -> Column:
    by_words = code_from_text(F.coalesce(non_empty(kind), raw))
    return F.coalesce(F.nullif(by_words, F.lit(NO_CODE)), code)


def shown_classifier(raw: Column, kind: Column) -> Column:
    """The classifier text, or the kind where the text is a label or missing."""
    r = F.coalesce(raw, F.lit(""))
    return F.when((kind != "") & ((r == "") | is_label(r)), kind).otherwise(r)


def land_plot_only(c: Column) -> Column:
    """"Земельный участок" with more text after it becomes just that."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(t.rlike(r"(?isu)^земельный(?U:\s+)участок(?U:\s+|\s*,\s*).+"), F.lit("Земельный участок")).otherwise(t)


# --- pieces of a name -----------------------------------------------------------------


def field(fields: str, *keys: str) -> Column:
    """First exact key of a map column, else the first field whose name holds
    one of the keys, else ''."""
    exact = ", ".join(f"try_element_at({fields}, '{k}')" for k in keys)
    held = " OR ".join(f"contains(e.key, '{k}')" for k in keys)
    fuzzy = f"get(filter(map_entries({fields}), e -> NOT startswith(e.key, '_') AND ({held})), 0).value"
    return F.expr(f"coalesce({exact}, {fuzzy}, '')")


def _clean(c: Column) -> Column:
    text = squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\n\r\t]+", " "))
    text = F.regexp_replace(
        text, r"(?isu)\s*(?:местонахождение обеспечения|категория качества|вид стоимости)\s*[:：]?.*$", ""
    )
    cut = lambda t: F.concat(F.rtrim(F.substring(t, 1, 157)), F.lit("…"))
    return let(_edges(text, " ,;"), lambda t: F.when(F.length(t) > 160, cut(t)).otherwise(t))


def _described(fields: Column, raw: Column, kind: Column) -> Column:
    brand = F.concat_ws(
        " ", non_empty(strip(F.try_element_at(fields, F.lit("brand")))), non_empty(strip(F.try_element_at(fields, F.lit("model"))))
    )
    lines = F.filter(
        segments_of(raw),
        lambda s: ~is_label(s)
        & ~s.rlike(r"(?iu)^(вид|описание|местонахождение)\s")
        & ((kind == "") | (F.lower(s) != kind))
        & ~F.upper(s).rlike(VIN_LIKE)
        & ~s.rlike(CADASTRAL),
    )
    return F.coalesce(
        non_empty(_clean(F.try_element_at(fields, F.lit("description")))),
        non_empty(_clean(brand)),
        _clean(F.get(lines, F.lit(0))),
        F.lit(""),
    )


def _longest_segment(segments: Column, kind: Column, identifier: Column) -> Column:
    usable = F.filter(
        segments,
        lambda s: ~is_label(s)
        & ((kind == "") | (F.lower(s) != kind))
        & ((identifier == "") | (s != identifier))
        & ~F.upper(s).rlike(VIN_LIKE)
        & ~s.rlike(CADASTRAL),
    )
    # longest first, the earlier of two equally long ones
    ranked = F.transform(usable, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("i"), s.alias("s")))
    return F.coalesce(F.array_max(ranked)["s"], F.lit(""))


def vin_in(c: Column) -> Column:
    hit = extract(F.upper(c), "(?<![\\p{L}\\p{N}_])([A-HJ-NPR-Z0-9]{11,17})(?![\\p{L}\\p{N}_])")
    return F.coalesce(hit, strip(c))


def is_vehicle(code: Column, kind: Column) -> Column:
    return code.isin("310.01", "310.02") | kind.contains("автомобил") | kind.contains("транспорт")


def is_real_estate(code: Column, kind: Column) -> Column:
    return code.rlike(r"^(101|102|201)\.") | kind.rlike("квартир|помещен|участок|дом|здани|офис")


def _pairs(*pairs: tuple[str, Column]) -> Column:
    return F.concat_ws(" | ", *[F.when(v != "", F.concat(F.lit(f"{k}: "), v)) for k, v in pairs])


def _cap(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def _report_entries(c: Column) -> Column:
    """Title, ``key: value`` chunks, labelled fields of one text."""
    return F.concat(
        entry_if("_title", first_bare_chunk(c)),
        F.map_entries(map_last_wins(semicolon_entries(c))),
        F.map_entries(labelled_fields(c)),
    )


def report_fields(raw: Column, segments: Column) -> Column:
    """All fields a report name can use; earlier sources win."""
    return map_first_wins(F.concat(_report_entries(raw), _report_entries(F.array_join(segments, "\t"))))


def _guessed_fields(text: Column, raw: Column, code: Column, identifier: Column) -> Column:
    """Fields by pattern, for text without a single readable pair."""
    kind = non_empty(kind_label(raw, code, empty_map()))
    vin = F.coalesce(non_empty(vin_in(text)), vin_in(identifier))
    cadastral = F.coalesce(
        extract(text, r"(?iu)кадастровый номер\s*[:：]?\s*([0-9]{2}:[0-9]{2}:[0-9]+:[0-9]+)"),
        F.when(identifier.rlike("[0-9]{2}:[0-9]{2}:[0-9]+:[0-9]+"), identifier),
    )
    described = extract(
        text,
        r"(?isu)описание обеспечения\s*[:：]?\s*(.+?)(?=вид обеспечения|местонахождение|год выпуска|vin|кадастровый|\z)",
    )
    return map_first_wins(
        F.concat(
            entry_if("kind", kind),
            entry_if("vin", F.when(F.length(vin) >= 11, vin)),
            entry_if("year", extract(text, r"(?iu)год выпуска\s*[:：]?\s*((?:19|20)[0-9]{2})")),
            entry_if("cadastral", cadastral),
            entry_if("description", _edges(squeeze(described))),
        )
    )


def _without_repeated_type(title: Column, display: Column, raw: Column, *more: Column) -> Column:
    """Cut a closing bracket that only repeats classifier or type of value."""
    inner = F.lower(squeeze(F.regexp_extract(title, r"\(([^)]+)\)(?U:\s*)$", 1)))
    last_part = strip(F.substring_index(display, "/", -1))
    known = F.concat(
        F.array(last_part, display, raw, *more),
        F.split(F.coalesce(raw, F.lit("")), "/"),
    )
    known = F.filter(F.transform(known, lambda k: F.lower(strip(F.coalesce(k, F.lit(""))))), lambda k: ~k.isin("", "—"))
    repeats = F.exists(known, lambda k: inner.contains(k) | k.contains(inner))
    return F.when((inner != "") & repeats, strip(F.regexp_replace(title, r"\([^)]+\)(?U:\s*)$", ""))).otherwise(title)


def _exposure(fields: str, cell: Column) -> Column:
    stated = squeeze(
        field(fields, "срок реализации", "срок реализации в днях", "срок экспозиции", "срок экспозиции в днях")
    )
    number = r"^[0-9]+(?:[.,][0-9]+)?$"
    days = lambda c: F.concat(F.translate(c, ",", "."), F.lit(" дн."))
    return (
        F.when((stated != "") & stated.rlike(r"(?iu)дн\.?"), stated)
        .when(stated.rlike(number), days(stated))
        .when(stated != "", F.concat(stated, F.lit(" дн.")))
        .when(cell.rlike(number), days(cell))
        .otherwise(F.lit(""))
    )


def with_report_name(
    df: DataFrame,
    out: str,
    raw: str,
    classifier: str,
    code: str,
    identifier: str,
    segments: Column | None = None,
    liquidity: Column | None = None,
    valuation: Column | None = None,
) -> DataFrame:
    """The several-line name of an object, or the one-line name when there is
    nothing for the lines below the title."""
    blank = F.lit("")
    text = lambda c: strip(F.coalesce(c, blank))
    kept = df.columns
    df = df.withColumns(
        {
            "_n_raw": text(F.col(raw)),
            "_n_seg": segments if segments is not None else F.array().cast("array<string>"),
            "_n_cls": text(F.col(classifier)),
            "_n_id": text(F.col(identifier)),
            "_n_liq": text(liquidity) if liquidity is not None else blank,
            "_n_val": text(valuation) if valuation is not None else blank,
        }
    )
    df = df.withColumn(
        "_n_all", F.concat_ws("\n", non_empty(F.col("_n_raw")), non_empty(F.array_join("_n_seg", "\t")))
    ).withColumn("_n_read", report_fields(F.col("_n_raw"), F.col("_n_seg")))
    df = df.withColumn(
        "_n_f",
        F.when(
            (F.size("_n_read") == 0) & (F.col("_n_all") != ""),
            _guessed_fields(F.col("_n_all"), F.col("_n_cls"), F.col(code), F.col("_n_id")),
        ).otherwise(F.col("_n_read")),
    )
    f, cls, ident = F.col("_n_f"), F.col("_n_cls"), F.col("_n_id")
    df = df.withColumn("_n_kind", kind_label(cls, F.col(code), f))
    kind = F.col("_n_kind")
    df = df.withColumns(
        {
            "_n_code": kind_code(kind, cls, F.col(code)),
            "_n_title": F.coalesce(
                non_empty(F.try_element_at(f, F.lit("_title"))),
                non_empty(field("_n_f", "описание обеспечения", "description", "kind", "вид обеспечения")),
                non_empty(_described(f, F.col("_n_all"), kind)),
                non_empty(_clean(_longest_segment(F.col("_n_seg"), kind, ident))),
                non_empty(_cap(kind)),
                non_empty(F.substring(strip(F.substring_index("_n_all", ";", 1)), 1, 160)),
                blank,
            ),
            "_n_show": classifier_display(cls, F.col(code)),
        }
    )
    label = F.col("_n_val")
    title = _without_repeated_type(F.col("_n_title"), F.col("_n_show"), cls, label, F.lower(label))
    key = F.coalesce(non_empty(field("_n_f", "кадастровый номер", "cadastral")), ident)
    key = F.when(key.rlike("[0-9]{2}:[0-9]{2}:") | F.upper(key).rlike(VIN_LIKE), key).otherwise(blank)
    stated_vin = F.coalesce(non_empty(field("_n_f", "vin", "vin номер")), ident)
    line2 = F.when(
        is_vehicle(F.col("_n_code"), kind),
        _pairs(
            ("Марка", field("_n_f", "марка", "brand")),
            ("Модель", field("_n_f", "модель", "model")),
            ("Год выпуска", field("_n_f", "год выпуска", "year")),
            ("VIN", vin_in(stated_vin)),
        ),
    ).otherwise(_pairs(("Площадь", field("_n_f", "площадь", "area")), ("Этаж", field("_n_f", "этаж", "floor")), ("КН", key)))
    rights = F.coalesce(non_empty(field("_n_f", "права", "право", "вид права", "форма права", "право собственности")), F.lit("—"))
    burden = F.coalesce(non_empty(field("_n_f", "обременения", "обременение")), F.lit("нет"))
    liq = F.col("_n_liq")
    liquid = F.coalesce(
        non_empty(F.lower(field("_n_f", "ликвидность"))),
        F.when(~liq.rlike(r"^[0-9]+(?:[.,][0-9]+)?$"), F.lower(liq)),
        blank,
    )
    cost_label = F.lower(
        F.coalesce(non_empty(label), field("_n_f", "вид оценочной стоимости", "вид стоимости", "тип стоимости"))
    )
    provision = F.lower(field("_n_f", "обеспеченность", "учитываемое обеспечение", "учет обеспеченности"))
    lgd, vat = F.lower(field("_n_f", "lgd")), field("_n_f", "ндс", "ндс %", "ставка ндс")
    account = F.concat_ws(
        " | ",
        non_empty(
            F.concat_ws(
                ", ",
                F.when(provision != "", F.concat(F.lit("обеспеченность - "), provision)),
                F.when(lgd != "", F.concat(F.lit("LGD - "), lgd)),
            )
        ),
        F.when(vat != "", F.concat(F.lit("НДС: "), vat)),
    )
    df = df.withColumns(
        {
            "_n_1": F.rtrim(F.concat(F.lit("[ОБЪЕКТ] "), title)),
            "_n_2": line2,
            "_n_3": F.concat(F.lit("[ПРАВА]: "), rights, F.lit(". Обременения: "), burden, F.lit(".")),
            "_n_5": _pairs(("Ликвидность", liquid), ("Срок реализации", _exposure("_n_f", liq))),
            "_n_6": _pairs(("Дата оценки", field("_n_f", "дата оценки")), ("Стоимость", cost_label)),
            "_n_7": F.when(account != "", F.concat(F.lit("Учет: "), account)).otherwise(blank),
        }
    )
    df = df.withColumn("_n_thin", F.concat("_n_2", "_n_5", "_n_6", "_n_7") == "")
    df = _with_short_name(df, code)
    lines = F.concat_ws(
        "\n",
        "_n_1",
        non_empty(F.col("_n_2")),
        "_n_3",
        F.lit("[ОЦЕНКА / ЗАЛОГ]"),
        *[non_empty(F.col(f"_n_{i}")) for i in (5, 6, 7)],
    )
    return df.withColumn("_n_out", F.when(F.col("_n_thin"), F.col("_n_short")).otherwise(lines)).select(
        *[c for c in kept if c != out], F.col("_n_out").alias(out)
    )


def _with_short_name(df: DataFrame, code: str) -> DataFrame:
    """``_n_short``, one line: kind, description, then year and id, or key and
    area. Needs the columns :func:`with_report_name` prepares. Rows that have a
    full name get nulls, which makes the steps below cheap for them."""
    cls, ident = F.col("_n_cls"), F.col("_n_id")
    df = df.withColumns(
        {"_s_raw": F.when(F.col("_n_thin"), F.col("_n_raw")), "_s_seg": F.when(F.col("_n_thin"), F.col("_n_seg"))}
    )
    raw, seg = F.col("_s_raw"), F.col("_s_seg")
    blank = F.lit("")
    structured = raw.rlike(_STRUCTURED)
    long = F.length(raw) > 120
    df = df.withColumn("_s_cells", (F.size(neighbour_entries(seg)) > 0) | is_label(raw) | structured | long)
    by_cells = F.col("_s_cells")
    df = df.withColumn("_s_all", F.when(by_cells & (F.size(seg) > 0), F.col("_n_all")).otherwise(raw))
    df = df.withColumn("_s_src", F.when(structured | long, raw).otherwise(F.col("_s_all")))
    joined, source = F.col("_s_all"), F.col("_s_src")
    used = F.when(by_cells, seg).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("_s_read", description_fields(source, used))
    guess = (F.size("_s_read") == 0) & source.rlike(_STRUCTURED)
    df = df.withColumn(
        "_s_f", F.when(guess, _guessed_fields(source, cls, F.col(code), ident)).otherwise(F.col("_s_read"))
    )
    f = F.col("_s_f")
    df = df.withColumns(
        {"_s_kind": kind_label(cls, F.col(code), f), "_s_plain": kind_label(cls, F.col(code), empty_map())}
    )
    kind = F.col("_s_kind")
    df = df.withColumns(
        {
            "_s_code": kind_code(kind, cls, F.col(code)),
            "_s_text": F.coalesce(non_empty(_described(f, joined, kind)), _clean(_longest_segment(seg, kind, ident))),
        }
    )
    described, final_code = F.col("_s_text"), F.col("_s_code")
    get = lambda k: F.coalesce(strip(F.try_element_at(f, F.lit(k))), blank)
    year = F.coalesce(
        extract(get("year"), r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"),
        non_empty(get("year")),
        extract(described, r"(?iu)год выпуска\s*((?:19|20)[0-9]{2})"),
    )
    vehicle, estate = is_vehicle(final_code, kind), is_real_estate(final_code, kind)
    df = df.withColumns(
        {
            "_s_vin": vin_in(F.coalesce(non_empty(get("vin")), ident)),
            "_s_key": F.coalesce(non_empty(get("cadastral")), ident),
            "_s_area": get("area"),
            "_s_year": year,
            "_s_class": F.when(vehicle, F.lit("vehicle")).when(estate, F.lit("estate")).otherwise(F.lit("other")),
        }
    )
    of = lambda c, cond, value: F.when((F.col("_s_class") == c) & cond, value)
    low = F.lower(described)
    name = F.concat_ws(
        ", ",
        non_empty(kind),
        F.when(low != kind, non_empty(described)),
        of("vehicle", ~low.contains("год выпуска"), F.concat(F.lit("год выпуска "), F.col("_s_year"))),
        of("vehicle", F.length("_s_vin") >= 11, F.concat(F.lit("vin номер "), F.col("_s_vin"))),
        of("estate", F.col("_s_key").rlike("[0-9]{2}:[0-9]{2}:"), F.concat(F.lit("кадастровый номер "), F.col("_s_key"))),
        of("estate", ~low.contains(F.lower("_s_area")), non_empty(F.col("_s_area"))),
        of("other", ~is_label(ident), non_empty(ident)),
    )
    with_kind = lambda k, t: F.when(
        (k != "") & ~F.lower(t).contains(k), F.concat(k, F.lit(", "), t)
    ).otherwise(t)
    bare = (F.size(f) == 0) & (F.length(joined) <= 120) & ~joined.rlike(_STRUCTURED)
    cut = F.when(F.length(joined) > 200, F.concat(F.substring(joined, 1, 200), F.lit("…"))).otherwise(joined)
    return df.withColumn(
        "_n_short",
        F.when((raw != "") & ~by_cells, with_kind(F.col("_s_plain"), raw))
        .when(joined == "", F.lit("Не указано"))
        .when(bare, with_kind(kind, joined))
        .otherwise(F.coalesce(non_empty(name), cut)),
    )
