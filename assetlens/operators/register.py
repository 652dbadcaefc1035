"""Collateral registers: header and column detection, gates, fields, scores.

Two layouts are read: ``structured`` (kind path, pledgor, description ...) and
``simple`` (mark, classifier, name ...). Every input row keeps its verdict.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.names import CADASTRAL, NO_CODE, VIN_LIKE
from ..functions.numbers import collateral_from_discount, filter_number, register_number
from ..functions.text import NO_DATA, extract, filled, first_bare_chunk, let, non_empty, semicolon_fields, squeeze, strip
from ..sources.grids import KEYS, at

ACCEPT, SUSPECT = 45, 20
MARKET_FACTOR = 1.05

# fixed values: words that mark a header row
STRUCTURED_MARKERS = ("вид обеспечения", "описание обеспечения", "залогодатель")
SIMPLE_MARKERS = ("условн", "наименован|описание", "стоимост")

# fixed values: header patterns per layout; the first pattern a header matches
# names its field
STRUCTURED_HEADERS = (
    ("^вид обеспечения", "kind_path"),
    ("залогодатель", "pledgor"),
    ("описание обеспечения", "description"),
    ("местонахождение обеспечения", "location"),
    ("оценочная стоимость", "cost"),
    ("залоговый дисконт|^дисконт", "discount"),
    ("залоговая стоимость", "collateral"),
    ("категория качества", "quality"),
    ("вид оценочной стоимости|^вид стоимости$|^тип стоимости$", "valuation_type"),
    ("срок экспозиции|^(?!.*ликвидацион).*ликвидность", "liquidity"),
)
SIMPLE_HEADERS = (
    ("условное обозначение|^условное$", "conditional"),
    ("классификатор", "classifier"),
    ("наименование", "name"),
    ("описание обеспечения|объект", "other_name"),
    ("идентификатор|vin|кадастр", "identifier"),
    ("примечан", "note"),
    ("вид оценочной стоимости|вид стоимости|тип стоимости", "valuation_type"),
    ("оценочная стоимость|стоимость оцен", "cost"),
    ("дисконт", "discount"),
    ("залоговая стоимость", "collateral"),
    ("категория качества", "quality"),
)
# fixed values: ordinals used when a header is missing
STRUCTURED_DEFAULTS = {"liquidity": 11}
SIMPLE_DEFAULTS = {
    "conditional": 0, "classifier": 1, "name": 2, "identifier": 3, "cost": 5, "discount": 8, "collateral": 9,
    "quality": 10,
}


# --- header and columns ------------------------------------------------------------


def _row_text(cells: Column) -> Column:
    return F.lower(F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " "))


def header_rows(
    rows: DataFrame,
    structured_markers: Sequence[str] = STRUCTURED_MARKERS,
    simple_markers: Sequence[str] = SIMPLE_MARKERS,
    structured_rows: int | None = None,
    simple_rows: int | None = None,
) -> DataFrame:
    """(file, sheet, layout, header_row, header_cells): the first row with all
    three markers, else the first with the simple ones, else row 0.

    The row limits, if given, end the search at that row. Every sheet has a
    result; header_cells is empty where its header row is blank or missing.
    """
    text = _row_text(F.col("cells"))
    has_all = lambda markers: reduce(and_, [text.rlike(m) for m in markers])
    until = lambda limit: F.lit(True) if limit is None else F.col("row") < limit
    structured = F.when(has_all(structured_markers) & until(structured_rows), F.col("row"))
    simple = F.when(has_all(simple_markers) & until(simple_rows), F.col("row"))
    top = F.when(F.col("row") == 0, F.col("row"))
    found = rows.groupBy(*KEYS).agg(
        F.min(structured).alias("_s"),
        F.min(simple).alias("_p"),
        F.min_by("cells", structured).alias("_s_cells"),
        F.min_by("cells", simple).alias("_p_cells"),
        F.min_by("cells", top).alias("_top_cells"),
    )
    cells = F.when(F.col("_s").isNotNull(), F.col("_s_cells")).when(F.col("_p").isNotNull(), F.col("_p_cells")).otherwise(F.col("_top_cells"))
    return found.select(
        *KEYS,
        F.when(F.col("_s").isNotNull(), F.lit("structured")).otherwise(F.lit("simple")).alias("layout"),
        F.coalesce("_s", "_p", F.lit(0)).alias("header_row"),
        F.coalesce(cells, F.array().cast("array<string>")).alias("header_cells"),
    )


def _ordinals(header: Column, rules: Sequence[tuple[str, str]], defaults: dict[str, int]) -> dict[str, Column]:
    """Field -> ordinal from one header array; the last hit of a field wins."""

    def named(c: Column) -> Column:
        text = F.trim(F.lower(F.coalesce(strip(c), F.lit(""))))
        expr = None
        for pattern, name in rules:
            expr = F.when(text.rlike(pattern), name) if expr is None else expr.when(text.rlike(pattern), name)
        return F.coalesce(expr, F.lit(""))

    fields = F.transform(header, named)
    last = lambda name: F.size(fields) - F.array_position(F.reverse(fields), name).cast("int")
    first = lambda name: F.array_position(fields, name).cast("int") - 1
    has = lambda name: F.array_contains(fields, name)
    out = {}
    for name in dict.fromkeys(n for _, n in rules):
        if name == "other_name":
            continue
        found = F.when(has(name), last(name))
        if name == "name" and any(n == "other_name" for _, n in rules):
            # a weaker name header counts only until a real one is seen
            found = F.coalesce(found, F.when(has("other_name"), first("other_name")))
        out[name] = F.coalesce(found, F.lit(defaults.get(name, -1)))
    return out


def column_map(headers: DataFrame) -> DataFrame:
    """One row per (file, sheet): layout, header_row and a struct of ordinals
    per layout (-1 = the column is missing). A blank header gives the defaults."""
    pack = lambda rules, defaults: F.struct(
        *[c.alias(n) for n, c in _ordinals(F.col("header_cells"), rules, defaults).items()]
    )
    return headers.select(
        *KEYS,
        "layout",
        "header_row",
        pack(STRUCTURED_HEADERS, STRUCTURED_DEFAULTS).alias("s"),
        pack(SIMPLE_HEADERS, SIMPLE_DEFAULTS).alias("p"),
    )


def data_rows(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows below the header with the column map; row_index counts from 1."""
    return (
        rows.join(columns, list(KEYS))
        .where(F.col("row") > F.col("header_row"))
        .withColumn("row_index", F.col("row") - F.col("header_row"))
    )


# --- structured layout: fields --------------------------------------------------------

# fixed values: shapes of an object mark and of a classifier code
_MARK_TOKEN = r"(?iuU)^([A-ZА-Я]{1,5}[_-]?\w+|[0-9]+[_-]\w+|З-[0-9]{1,4})$"
_SCORED_MARK = r"(?iuU)^([A-ZА-Я]{1,5}[_-]?\w+|[0-9]+[_-]\w+|З-[0-9]{1,4}|Объект_[0-9]+)$"
_CODE = r"^([0-9]{3}\.[0-9]{2}|[0-9]{6})$"
# fixed values: kinds of value
VALUATIONS = ("Рыночная", "Кадастровая", "Прочая", "Балансовая", "Льготная")


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\r\n|\r|\n"), strip), lambda x: x != "")


def conditional_mark(kind_path: Column) -> Column:
    """Object mark in a kind-path cell: after the bar, on the last line, as the
    last step of the path, or the first mark-like word."""
    t = strip(F.coalesce(kind_path, F.lit("")))
    lines = _lines(t)
    last_step = strip(F.substring_index(t, "/", -1))
    word = extract(t, r"(?U)\b([A-ZА-Я]{1,5}[_-]?\w+)\b")
    return (
        F.when(t == "", F.lit(""))
        .when(t.contains("|"), strip(F.substring_index(t, "|", -1)))
        .when(F.size(lines) >= 2, F.try_element_at(lines, F.lit(-1)))
        .when(t.contains("/") & last_step.rlike(_MARK_TOKEN), last_step)
        .when(F.length(word) <= 20, word)
        .otherwise(F.substring(F.get(lines, F.lit(0)), 1, 40))
    )


def path_before_mark(kind_path: Column, mark: Column) -> Column:
    t = strip(F.coalesce(kind_path, F.lit("")))
    lines = _lines(t)
    head = F.substring(t, F.lit(1), F.length(t) - F.length(mark))
    return (
        F.when(t == "", F.lit(""))
        .when(t.contains("|"), strip(F.substring_index(t, "|", 1)))
        .when(F.size(lines) >= 2, F.get(lines, F.lit(0)))
        .when((mark != "") & t.endswith(mark), strip(F.regexp_replace(head, "[/| ]+$", "")))
        .otherwise(t)
    )


def classifier_text(kind_path: Column, mark: Column) -> Column:
    """Last step of the path before the mark, or the text after its number."""

    def last_step(line: Column) -> Column:
        text = F.when(line.contains("/"), strip(F.substring_index(line, "/", -1))).otherwise(
            strip(F.regexp_replace(line, r"^[0-9]+(?:\.[0-9]+)?\s+", ""))
        )
        return F.coalesce(non_empty(text), strip(line))

    return let(path_before_mark(kind_path, mark), last_step)


def classifier_code(text: Column) -> Column:
    compact = F.replace(text, F.lit(" "), F.lit(""))
    dotted = F.when(compact.contains("."), compact).otherwise(
        F.concat(F.substring(compact, 1, 3), F.lit("."), F.substring(compact, 4, 3))
    )
    return F.when(text == "", F.lit(NO_CODE)).when(compact.rlike(_CODE), dotted).otherwise(names.code_from_text(text))


def _vin_upper(c: Column) -> Column:
    return let(c, lambda x: F.when(F.upper(x).rlike(VIN_LIKE), F.upper(x)).otherwise(x))


def _stated(c: Column) -> Column:
    return let(filled(c), lambda v: F.when(~F.lower(v).isin(*NO_DATA), v))


def object_identifier(description: Column, fields: Column) -> Column:
    """Identifier by six steps: typed id, cadastral number, vehicle number,
    contract, number, inventory number."""
    get = lambda k: non_empty(F.try_element_at(fields, F.lit(k)))
    d = F.coalesce(description, F.lit(""))
    typed = _vin_upper(_stated(extract(d, r"(?iu)тип\s+идентификатора\s*:\s*[^:;]+:\s*([^;]+)")))
    cadastral = F.coalesce(_stated(extract(d, r"(?iu)кадастровый\s+номер\s*:\s*([^;]+)")), get("кадастровый номер"))
    number = get("номер")
    vehicle = F.when(
        F.coalesce(F.lower(get("тип идентификатора")).contains("vin"), F.lit(False)) | F.upper(number).rlike(VIN_LIKE),
        F.upper(number),
    )
    inventory = F.coalesce(
        get("инвентарный номер"), _stated(extract(d, r"(?iu)инвентарный\s+номер\s*:\s*([^;]+)"))
    )
    return F.coalesce(
        typed, cadastral, vehicle, get("номер контракта/договора"), _vin_upper(number), inventory, F.lit("")
    )


def valuation_type(c: Column) -> Column:
    """Kind of value in one spelling; the text itself when unknown."""

    def spelled(text: Column) -> Column:
        head = strip(F.substring_index(F.regexp_replace(text, "[;/|]", ";"), ";", 1))
        key = F.lower(squeeze(head))
        expr = F.when(F.lower(text).isin("", *NO_DATA, "none", "-"), F.lit(""))
        for label in VALUATIONS:
            expr = expr.when(key.startswith(label.lower()), F.lit(label))
        return expr.otherwise(F.substring(head, 1, 40))

    return let(strip(F.coalesce(c, F.lit(""))), spelled)


def described_valuation(description: Column, fields: Column) -> Column:
    get = lambda k: non_empty(valuation_type(F.try_element_at(fields, F.lit(k))))
    return F.coalesce(
        get("вид оценочной стоимости"),
        get("вид стоимости"),
        get("тип стоимости"),
        get("вид оценки"),
        valuation_type(extract(description, r"(?iu)вид\s+(?:оценочной\s+)?стоимост[иы]?\s*:\s*([^;]+)")),
        F.lit(""),
    )


def structured_reject(kind_path: Column, description: Column, cost: Column) -> Column:
    """Why a structured row holds no object; null when it may."""
    low = F.lower(kind_path)
    section = r"(?U)^[0-9]+\.\s*(основное|комфортное|бланковое)"
    return (
        F.when((kind_path == "") & (description == ""), F.lit("пустая строка"))
        .when(low.startswith("итого"), F.lit("строка «Итого»"))
        .when(low.contains("перечень залогов к ко"), F.lit("заголовок перечня"))
        .when(
            low.contains("отсутствует")
            & (low.startswith("обеспечение, учитываемое") | low.rlike(section + r"\s*-?\s*отсутствует") | ((cost <= 0) & (description == ""))),
            F.lit("секция без объектов"),
        )
        .when((cost <= 0) & (description == ""), F.lit("нет стоимости и описания"))
        .when(low.startswith("обеспечение, учитываемое") | low.rlike(section + r"\s*$"), F.lit("служебная строка"))
    )


def _points(*rules: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for cond, points in rules:
        total = total + F.when(F.coalesce(cond, F.lit(False)), points).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def _reasons(*rules: tuple[Column, Column | str]) -> Column:
    listed = [F.when(cond, F.lit(r) if isinstance(r, str) else r) for cond, r in rules]
    return F.filter(F.array(*listed), lambda r: r.isNotNull())


def structured_score(c: dict[str, Column]) -> tuple[Column, Column]:
    """Score 0..100 and its reasons; ``c`` holds the row's expressions."""
    cost, coll = c["cost"] > 0, (c["cost"] <= 0) & (c["collateral_cell"] > 0)
    n_fields = c["n_fields"]
    rich = n_fields >= 2
    text = (n_fields < 2) & (F.length(c["description"]) >= 15)
    mark = c["conditional"].rlike(_SCORED_MARK)
    short = ~mark & (c["conditional"] != "") & (F.length(c["conditional"]) <= 25)
    ident = c["identifier"] != ""
    named = F.length(c["name"]) >= 10
    known = F.lower(c["kind_path"]).rlike("автомобил|имуществен|земель|помещен")
    long_mark = F.length(c["conditional"]) > 40
    nothing = (c["cost"] <= 0) & (c["collateral_cell"] <= 0) & (c["description"] == "")
    absent = F.lower(c["kind_path"]).contains("отсутствует") & (c["cost"] <= 0)
    score = _points(
        (cost, 30), (coll, 20), (rich, 25), (text, 12), (mark, 20), (short, 8), (ident, 15), (named, 10), (known, 5),
        (long_mark, -25), (nothing, -35), (absent, -40),
    )
    vin = c["identifier"].rlike("(?i)" + VIN_LIKE)
    cad = c["identifier"].rlike(CADASTRAL)
    reasons = _reasons(
        (cost, "есть оценочная стоимость"),
        (coll, "есть залоговая стоимость"),
        (rich, F.format_string("структурированное описание (%d полей)", n_fields)),
        (text, "есть текст описания"),
        (mark, "валидное условное обозначение"),
        (ident & vin, "VIN найден"),
        (ident & ~vin & cad, "кадастровый номер найден"),
        (ident & ~vin & ~cad, "идентификатор найден"),
        (named, "сформировано краткое наименование"),
        (long_mark, "слишком длинное условное обозначение"),
        (nothing, "нет стоимости и описания"),
        (absent, "секция «отсутствует»"),
    )
    return score, reasons


def status_of(score: Column, hard_skip: Column | None = None) -> Column:
    verdict = F.when(score >= ACCEPT, F.lit("accepted")).when(score >= SUSPECT, F.lit("suspicious")).otherwise(F.lit("skipped"))
    return verdict if hard_skip is None else F.when(hard_skip, F.lit("skipped")).otherwise(verdict)


def preview(*parts: Column, limit: int = 120) -> Column:
    text = F.concat_ws(" | ", *[filled(p) for p in parts])
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


_PREPARED = (
    "file", "sheet", "row", "row_index", "layout", "raw_name", "classifier_raw", "code", "name_code", "identifier", "segments",
    "liquidity", "valuation_type", "conditional", "cost", "discount", "collateral", "quality", "kind_path",
    "description", "n_fields", "reject", "template", "classifier_cell", "raw_preview",
)


def _structured_fields(data: DataFrame) -> DataFrame:
    """Fields of structured rows (output of :func:`data_rows`)."""
    cell = lambda f: strip(at(F.col("cells"), F.col(f"s.{f}")))
    df = data.where("layout = 'structured'").select(
        *KEYS,
        "row",
        "row_index",
        "layout",
        *[cell(f).alias(f) for f in ("kind_path", "description", "quality", "liquidity")],
        *[register_number(cell(f)).alias(f) for f in ("cost", "discount", "collateral")],
        cell("valuation_type").alias("valuation_cell"),
    )
    # an empty row leaves no trace, any other keeps its reason
    df = df.where("kind_path <> '' OR description <> ''")
    kind, what = F.col("kind_path"), F.col("description")
    df = df.withColumns(
        {
            "reject": structured_reject(kind, what, F.col("cost")),
            "fields": semicolon_fields(what),
            "_mark": conditional_mark(kind),
        }
    )
    df = df.withColumn("_class", classifier_text(kind, F.col("_mark")))
    own_code = F.nullif(classifier_code(F.col("_class")), F.lit(NO_CODE))
    stated = non_empty(valuation_type(F.col("valuation_cell")))
    return df.withColumns(
        {
            "raw_name": F.coalesce(non_empty(what), kind),
            "classifier_raw": F.coalesce(non_empty(F.col("_class")), F.substring(F.get(_lines(kind), F.lit(0)), 1, 80)),
            "code": F.coalesce(own_code, names.code_from_text(F.substring_index(what, ";", 1))),
            "identifier": object_identifier(what, F.col("fields")),
            "valuation_type": F.coalesce(stated, described_valuation(what, F.col("fields"))),
            "conditional": F.coalesce(non_empty(F.col("_mark")), _default_mark()),
            "n_fields": F.size("fields"),
            "segments": F.array().cast("array<string>"),
            "template": F.lit(False),
            "classifier_cell": F.lit(""),
            "raw_preview": preview(kind, what),
        }
    ).withColumn("name_code", F.col("code")).select(*_PREPARED)


def _default_mark() -> Column:
    return F.concat(F.lit("Объект_"), F.col("row_index").cast("string"))


# --- simple layout ----------------------------------------------------------------------

# fixed values: words of template rows and of names that say nothing
_TEMPLATE_NAMES = ("вид обеспечения", "описание обеспечения", "местонахождение обеспечения")
_TEMPLATE_LABELS = (*_TEMPLATE_NAMES, "категория качества")
_EMPTY_NAMES = ("н/д", "нет", "без названия", "без названия.")


def simple_name(name_cell: Column, note: Column) -> Column:
    """The name cell, or the note where the name is missing or a label."""
    unusable = (name_cell == "") | names.is_label(name_cell)
    return F.when(unusable & (note != ""), note).otherwise(name_cell)


def valid_mark(c: Column) -> Column:
    return (c != "") & (F.length(c) <= 40) & ~c.rlike(r"[\n\t]") & ~names.is_label(c)


def is_template_row(row_text: Column, code: Column, classifier_cell: Column, name: Column, mark: Column, cost: Column) -> Column:
    """Rows of the form itself: field captions without an object's data."""
    n = F.lower(strip(name))
    probe = F.lower(strip(F.when(name != "", name).otherwise(mark)))
    no_code, free = code == NO_CODE, cost == 0
    captioned = F.lit(False)
    for label in _TEMPLATE_LABELS:
        captioned = captioned | (probe == label) | probe.startswith(label + " ")
    place = row_text.contains("местонахождение обеспечения")
    return (
        n.isin(*_TEMPLATE_NAMES)
        | (place & (row_text.contains(NO_CODE) | no_code) & free)
        | captioned
        | ((classifier_cell == NO_CODE) & row_text.rlike("вид обеспечения|описание обеспечения|местонахождение"))
        | (no_code & free & row_text.rlike("вид обеспечения|описание обеспечения"))
    )


def is_empty_name(raw: Column, shown: Column) -> Column:
    d = strip(F.coalesce(shown, F.lit("")))
    return (
        (F.coalesce(strip(raw), F.lit("")) == "")
        | F.lower(d).rlike(r"(?U)^не\s*указано\.?$")
        | F.lower(d).isin(*_EMPTY_NAMES)
        | d.rlike(r"(?U)^[-–—_.\s]+$")
        | (F.length(d) < 3)
    )


def simple_score(c: dict[str, Column]) -> tuple[Column, Column]:
    cost, coll = c["cost"] > 0, (c["cost"] <= 0) & (c["collateral_cell"] > 0)
    probe = F.when(c["raw_name"] != "", c["raw_name"]).otherwise(c["name"])
    long_name, any_name = F.length(probe) >= 8, (probe != "") & (F.length(probe) < 8)
    mark = c["conditional"].rlike(_SCORED_MARK)
    ident = c["identifier"] != ""
    empty = (probe == "") & (c["conditional"] == "")
    classified = ~c["classifier_cell"].isin("", NO_CODE)
    score = _points(
        (cost, 30), (coll, 20), (long_name, 25), (any_name, 8), (mark, 20), (ident, 15),
        (F.length(c["name"]) >= 10, 10), (classified, 5), (empty, -30),
    )
    reasons = _reasons(
        (cost, "есть оценочная стоимость"),
        (coll, "есть залоговая стоимость"),
        (long_name, "есть наименование"),
        (mark, "валидное условное обозначение"),
        (ident, "идентификатор найден"),
        (empty, "пустая строка"),
    )
    return score, reasons


def _simple_fields(data: DataFrame) -> DataFrame:
    """Fields of simple rows (output of :func:`data_rows`)."""
    cell = lambda f: strip(at(F.col("cells"), F.col(f"p.{f}")))
    cells = F.transform("cells", lambda c: strip(F.coalesce(c, F.lit(""))))
    df = data.where("layout = 'simple'").select(
        *KEYS,
        "row",
        "row_index",
        "layout",
        F.lower(F.array_join(cells, " ")).alias("row_text"),
        simple_name(cell("name"), cell("note")).alias("raw_name"),
        cell("conditional").alias("mark_cell"),
        cell("classifier").alias("classifier_cell"),
        cell("identifier").alias("identifier_cell"),
        cell("quality").alias("quality"),
        cell("valuation_type").alias("valuation_cell"),
        *[register_number(cell(f)).alias(f) for f in ("cost", "discount", "collateral")],
        names.description_segments(cells, F.col("p.classifier"), F.col("p.cost")).alias("segments"),
    )
    df = df.where("raw_name <> '' OR mark_cell <> ''")
    raw, cls = F.col("raw_name"), F.col("classifier_cell")
    df = df.withColumns(
        {
            "fields": names.description_fields(raw, F.col("segments")),
            "stated": semicolon_fields(raw),
            "name_code": names.code_from_text(cls),
        }
    )
    scanned = F.get(F.filter("segments", lambda s: F.upper(s).rlike(VIN_LIKE) | s.rlike(CADASTRAL)), F.lit(0))
    own_id = F.when(~names.is_label(F.col("identifier_cell")), non_empty(F.col("identifier_cell")))
    df = df.withColumns(
        {
            "_kind": names.kind_label(cls, F.col("name_code"), F.col("fields")),
            "conditional": F.when(valid_mark(F.col("mark_cell")), F.col("mark_cell")).otherwise(_default_mark()),
            "identifier": F.coalesce(own_id, _vin_upper(scanned), F.lit("")),
            "valuation_type": F.coalesce(
                non_empty(valuation_type(F.col("valuation_cell"))), described_valuation(raw, F.col("stated"))
            ),
        }
    )
    df = df.withColumn("code", names.kind_code(F.col("_kind"), cls, F.col("name_code")))
    template = is_template_row(F.col("row_text"), F.col("code"), cls, raw, F.col("conditional"), F.col("cost"))
    return df.withColumns(
        {
            "classifier_raw": names.shown_classifier(cls, F.col("_kind")),
            "template": template,
            "reject": F.lit(None).cast("string"),
            "liquidity": F.lit(""),
            "kind_path": F.lit(""),
            "description": F.lit(""),
            "n_fields": F.lit(0),
            "raw_preview": preview(F.col("mark_cell"), raw),
        }
    ).select(*_PREPARED)


def parse_registers(rows: DataFrame) -> DataFrame:
    """All registers of a row table: one verdict per row with text.

    Both layouts are brought to the same fields, then named and scored once.
    """
    data = data_rows(rows, column_map(header_rows(rows)))
    df = _structured_fields(data).unionByName(_simple_fields(data))
    simple = F.col("layout") == "simple"
    # the simple layout is named by its classifier cell as it stands
    df = df.withColumn("_named_by", F.when(simple, F.col("classifier_cell")).otherwise(F.col("classifier_raw")))
    df = names.with_report_name(
        df, "name", "raw_name", "_named_by", "name_code", "identifier",
        segments=F.col("segments"), liquidity=F.col("liquidity"), valuation=F.col("valuation_type"),
    )
    c = {x: F.col(x) for x in ("cost", "raw_name", "name", "conditional", "identifier", "classifier_cell", "kind_path", "description", "n_fields")}
    c["collateral_cell"] = F.col("collateral")
    (s_score, s_reasons), (p_score, p_reasons) = structured_score(c), simple_score(c)
    hard = F.coalesce(
        F.col("reject"),
        F.when(simple & F.col("template"), F.lit("служебная/шаблонная строка")),
        F.when(simple & is_empty_name(F.col("raw_name"), F.col("name")), F.lit("нет осмысленного наименования")),
    )
    df = df.withColumns(
        {
            "_hard": hard,
            "_score": F.when(F.col("reject").isNotNull(), F.lit(0)).when(simple, p_score).otherwise(s_score),
            "_reasons": F.when(simple, p_reasons).otherwise(s_reasons),
        }
    )
    rejected, hard_skip = F.col("reject").isNotNull(), F.col("_hard").isNotNull()
    given = lambda x: F.when(~rejected, x)
    cost, coll = F.col("cost"), F.col("collateral")
    no_collateral = F.when(simple, coll == 0).otherwise(coll <= 0)
    raw_name = F.coalesce(non_empty(F.col("raw_name")), F.array_join("segments", "\t"))
    return df.select(
        *KEYS,
        "row",
        "row_index",
        "layout",
        F.when(rejected, F.lit("")).otherwise(F.col("conditional")).alias("conditional"),
        given(F.col("code")).alias("klassifikator"),
        given(F.col("classifier_raw")).alias("klassifikator_raw"),
        given(names.classifier_display(F.col("classifier_raw"), F.col("code"))).alias("classifier_name"),
        F.when(rejected, F.lit("")).otherwise(F.col("name")).alias("name"),
        given(raw_name).alias("raw_name"),
        given(F.col("identifier")).alias("identifier"),
        given(F.coalesce(non_empty(F.col("quality")), F.lit("Стандарт"))).alias("quality_category"),
        given(F.col("valuation_type")).alias("valuation_type"),
        cost.alias("cost"),
        given(F.when(no_collateral & (cost > 0), cost).otherwise(coll)).alias("collateral_value"),
        given(F.col("discount")).alias("discount"),
        given(F.lower("valuation_type")).alias("cost_type"),
        given(F.when(cost > 0, F.bround(cost * MARKET_FACTOR, 2)).otherwise(F.lit(0.0))).alias("bank_market_price"),
        given(F.col("liquidity")).alias("liquidity"),
        F.col("_score").alias("score"),
        F.when(rejected, F.array("reject"))
        .when(hard_skip, F.concat(F.array("_hard"), F.col("_reasons")))
        .otherwise(F.col("_reasons"))
        .alias("reasons"),
        status_of(F.col("_score"), hard_skip).alias("status"),
        "raw_preview",
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("status = 'accepted'")


# --- totals, filter, facets -----------------------------------------------------------------


def collateral_of(cost: Column, collateral: Column, discount: Column) -> Column:
    """The given value if positive, else the cost less its discount."""
    by_discount = collateral_from_discount(cost, F.coalesce(discount, F.lit(40.0)))
    return F.when(collateral > 0, collateral).otherwise(by_discount)


def totals(objects: DataFrame, by: str = "classifier_name") -> DataFrame:
    """Estimate and collateral per group and overall (null group)."""
    value = collateral_of(F.col("cost"), F.col("collateral_value"), F.col("discount"))
    parts = objects.groupBy(by).agg(
        F.count("*").alias("objects"),
        F.sum(F.col("cost").cast("decimal(24,2)")).alias("estimate"),
        F.sum(value.cast("decimal(24,2)")).alias("collateral"),
    )
    rolled = parts.rollup(by).agg(
        F.sum("objects").alias("objects"),
        F.sum("estimate").alias("estimate"),
        F.sum("collateral").alias("collateral"),
        F.grouping(by).alias("is_total"),
    )
    return rolled.withColumn("is_total", F.col("is_total") == 1)


def status_counts(parsed: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Accepted, suspicious and skipped rows per file."""
    s = F.col("status")
    return parsed.groupBy(*by).agg(*[F.count_if(s == v).alias(v) for v in ("accepted", "suspicious", "skipped")])


def matches(
    *,
    code: str = "",
    name: str = "",
    identifier: str = "",
    classifier: str = "",
    quality: str = "",
    valuation: str = "",
    liquidity: str = "",
    cost_from: float | None = None,
    cost_to: float | None = None,
) -> Column:
    """The report's filter: parts of code, name and id; equality on the lists;
    a cost range. Empty values do not filter."""
    cond = F.lit(True)
    for column, part in (("conditional", code), ("name", name), ("identifier", identifier)):
        if part.strip():
            cond = cond & F.lower(column).contains(part.strip().lower())
    for column, value in (
        ("classifier_name", classifier),
        ("quality_category", quality),
        ("valuation_type", valuation),
        ("liquidity", liquidity),
    ):
        if value.strip():
            cond = cond & (F.col(column) == value.strip())
    if cost_from is not None:
        cond = cond & (F.col("cost") >= cost_from)
    if cost_to is not None:
        cond = cond & (F.col("cost") <= cost_to)
    return cond


typed_bound = filter_number


def facets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct filled values per column, in case-folded order."""
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), strip(F.col(c)).alias("value")) for c in columns]))
    return (
        df.select(named.alias("x"))
        .select("x.*")
        .where("value IS NOT NULL AND value NOT IN ('', '—')")
        .distinct()
        .orderBy("facet", F.lower("value"), "value")
    )


def with_default_names(df: DataFrame, column: str, prefix: str, ordinal: str) -> DataFrame:
    """``<prefix><n>`` where a name is missing; ``n`` is an ordinal column."""
    return df.withColumn(
        column,
        F.when(F.coalesce(F.col(column), F.lit("")) != "", F.col(column)).otherwise(
            F.concat(F.lit(prefix), F.col(ordinal).cast("string"))
        ),
    )


def client_objects(objects: DataFrame) -> DataFrame:
    """Object rows for a client card, every field with its default."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    cost = F.coalesce("cost", F.lit(0.0))
    return objects.select(
        text("conditional").alias("conditional"),
        text("klassifikator").alias("klassifikator"),
        F.coalesce(non_empty(F.col("klassifikator_raw")), text("classifier_name")).alias("klassifikator_raw"),
        text("classifier_name").alias("classifier_name"),
        text("name").alias("name"),
        text("identifier").alias("identifier"),
        F.coalesce(non_empty(F.col("quality_category")), F.lit("Стандарт")).alias("quality_category"),
        text("valuation_type").alias("valuation_type"),
        cost.alias("cost"),
        F.coalesce("collateral_value", cost).alias("collateral_value"),
        F.coalesce("discount", F.lit(0.0)).alias("discount"),
        F.coalesce(non_empty(F.col("cost_type")), F.lower(text("valuation_type"))).alias("cost_type"),
        F.when(F.coalesce(F.col("bank_market_price"), F.lit(0.0)) != 0, F.col("bank_market_price"))
        .otherwise(cost * MARKET_FACTOR)
        .alias("bank_market_price"),
        text("liquidity").alias("liquidity"),
    )


def short_display_name(kind_path: Column, description: Column) -> Column:
    """First phrase of the description, else the kind."""
    first = strip(F.substring_index(F.coalesce(description, F.lit("")), ";", 1))
    kind = let(conditional_mark(kind_path), lambda mark: F.lower(classifier_text(kind_path, mark)))
    return names.land_plot_only(F.coalesce(non_empty(first), kind))


def bare_title(description: Column) -> Column:
    return first_bare_chunk(description)
