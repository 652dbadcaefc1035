"""Fields and risks of conclusion documents given as text.

A document is one row (doc_id, text) and is read inside that row: lines and
blocks are arrays, so no step of the extraction shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import iso_from_dmy
from ..functions.text import (
    drop_garbage_runs,
    extract,
    extract_first,
    filled,
    is_garbage_line,
    let,
    non_empty,
    repair_latin1_cyrillic,
    squeeze,
    strip,
)

MIN_TEXT = 30
# how many risks a printed report shows and how far its risk section reaches; nothing is cut unless asked for
REPORT_FREE_LIMIT, REPORT_SHORT_LIMIT, REPORT_WINDOW = 20, 30, 6000
NONE = "—"

# fixed values: titles, labels and patterns of the documents (i: any case, U:
# Unicode letters and blanks)
SHORT_FORM_TITLE = "краткая форма залогового заключения"
_NUMBER = r"ASZ[0-9]{10,16}(?:-[0-9]+)?"
_NUMBER_LABELLED = rf"(?iU)(?:номер\s+заключения|заключение\s*№?|№\s*заключения)\s*[:\-]?\s*({_NUMBER})"
_NUMBER_ANY = rf"(?iU)\b({_NUMBER})\b"
_DATES = (
    r"(?iU)(?:дата\s+заключения|от)\s*[:\-]?\s*([0-9]{2}[./][0-9]{2}[./][0-9]{4})",
    r"(?iU)(?:дата\s+заключения|от)\s*[:\-]?\s*([0-9]{4}-[0-9]{2}-[0-9]{2})",
    r"(?iU)\b([0-9]{2}[./][0-9]{2}[./][0-9]{4})\b",
)
_TAX_IDS = (
    r"(?iU)ИНН\s*(?:залогодателя|заёмщика|клиента|организации)?\s*[:\-]?\s*([0-9]{10}|[0-9]{12})",
    r"(?iU)\bИНН\s*[:\-]?\s*([0-9]{10}|[0-9]{12})\b",
)
_FORMS = "ООО|АО|ПАО|ИП|ЗАО|ОАО"
_CLIENTS = (
    rf"(?iU)(?:наименование\s+залогодателя|залогодатель|клиент|заёмщик)\s*[:\-]?\s*((?:{_FORMS})\s*[\"«]?[^.\n;]{{3,120}})",
    rf"(?iU)\b((?:{_FORMS})\s+[\"«][^\"»\n]{{2,120}}[\"»])",
    rf"(?iU)\b((?:{_FORMS})\s+[А-ЯЁA-Z][^\n,;]{{2,100}})",
)
_SHORT_COMPANY = (
    rf"(?imU)^([0-9]{{10}}|[0-9]{{12}})\s+((?:{_FORMS})\s*(?:\"[^\"\n]+\"|«[^»\n]+»|[^\n0-9]{{3,120}}?))"
    r"\s+([0-9]{2}[./][0-9]{2}[./][0-9]{4})\s*$"
)
_SHORT_PERSON = (
    r"(?imU)^([0-9]{12})\s+(ПРЕДПРИНИМАТЕЛЬ\s+[^\n0-9]+?)\s+([0-9]{2}[./-][0-9]{2}[./-][0-9]{4})\s*$\s*([^\n]*)"
)
_NAME_LINE = r"^[А-ЯЁA-Z][А-ЯЁA-Zа-яёa-z]+(?:\s+[А-ЯЁA-Z][А-ЯЁA-Zа-яёa-z]+){0,2}$"
_REFERENCE = r"(?isU)Справочная информация(.*)\z"
_VALIDITY = r"(?iU)Срок действия заключения\s*:\s*([0-9]{2}[-./][0-9]{2}[-./][0-9]{4})"
_TERM = r"(?iU)Срок кредита\s*:\s*([^\n]+)"


def normal_text(c: Column) -> Column:
    """Encoding repaired, blanks squeezed, at most one empty line in a row."""
    t = F.regexp_replace(repair_latin1_cyrillic(c), r"[ \t]{2,}|\t", " ")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def is_short_form(c: Column) -> Column:
    return F.lower(c).contains(SHORT_FORM_TITLE)


def _strip_chars(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def client_display(c: Column) -> Column:
    """Entrepreneurs as ``ИП Name``, companies as ``ООО "Name"``."""

    def shown(name: Column) -> Column:
        person = F.coalesce(extract(name, r"(?iU)^предприниматель\s+(.+)$"), extract(name, r"(?iU)^ип\s+(.+)$"))
        # only words written in capitals are re-cased
        word = lambda w: F.when(
            (F.length(w) > 1) & (w == F.upper(w)) & w.rlike(r"\p{L}"),
            F.concat(F.substring(w, 1, 1), F.lower(F.substr(w, F.lit(2)))),
        ).otherwise(w)
        full = F.array_join(F.transform(F.split(person, " "), word), " ")
        company = r"(?iU)^(ООО|АО|ПАО|ЗАО|ОАО)\s*[\"«]([^\"»]+)[\"»]\s*$"
        bare = r"(?iU)^(ООО|АО|ПАО|ЗАО|ОАО)\s+(.+)$"
        quoted = lambda p: F.concat(
            F.upper(F.regexp_extract(name, p, 1)), F.lit(' "'), _strip_chars(strip(F.regexp_extract(name, p, 2)), '"«»'), F.lit('"')
        )
        return (
            F.when(person.isNotNull(), F.concat(F.lit("ИП "), full))
            .when(name.rlike(company), quoted(company))
            .when(name.rlike(bare), quoted(bare))
            .otherwise(name)
        )

    return let(squeeze(c), shown)


def _client(text: Column) -> Column:
    def cleaned(pattern: str) -> Column:
        return let(_strip_chars(squeeze(extract(text, pattern)), ' "«»'), lambda name: F.when(F.length(name) >= 5, name))

    return client_display(F.coalesce(*[cleaned(p) for p in _CLIENTS]))


def with_header(docs: DataFrame, text: str = "text") -> DataFrame:
    """Number, date, tax id and client; a short form is read from its table
    line first. Missing fields are ''.

    Every step is a column of its own, so each pattern reads a text once; the
    groups of a table line are taken from the line that was found.
    """
    t, short = F.col(text), F.col("_short")
    df = docs.withColumns({"_short": is_short_form(t), "_enough": F.length(t) >= MIN_TEXT})
    df = df.withColumns(
        {"_company": F.when(short, extract(t, _SHORT_COMPANY, 0)), "_person": F.when(short, extract(t, _SHORT_PERSON, 0))}
    )
    company = lambda g: extract(F.col("_company"), _SHORT_COMPANY, g)
    person = lambda g: extract(F.col("_person"), _SHORT_PERSON, g)
    df = df.withColumns(
        {
            "_own": squeeze(person(2)),
            "_next": let(F.regexp_extract("_person", _SHORT_PERSON, 4), lambda x: F.when(x.rlike(_NAME_LINE), strip(x))),
            "_date": F.coalesce(company(3), person(3), extract_first(t, _DATES)),
            "_number": F.coalesce(F.when(short, extract(t, _NUMBER_ANY)), extract(t, _NUMBER_LABELLED), extract(t, _NUMBER_ANY)),
        }
    )
    own, next_line, date = F.col("_own"), F.col("_next"), F.col("_date")
    full = F.when(
        next_line.isNotNull() & ~F.upper(own).contains(F.upper(next_line)), F.concat(own, F.lit(" "), next_line)
    ).otherwise(own)
    or_blank = lambda c: F.coalesce(F.when(F.col("_enough"), c), F.lit(""))
    return df.withColumns(
        {
            "conclusion_number": or_blank(F.upper("_number")),
            "conclusion_date": or_blank(F.when(date.rlike("^[0-9]{4}-"), date).otherwise(iso_from_dmy(date))),
            "tax_id": or_blank(F.coalesce(company(1), person(1), extract_first(t, _TAX_IDS))),
            "client_name": or_blank(F.coalesce(client_display(company(2)), client_display(full), _client(t))),
        }
    ).drop("_short", "_enough", "_company", "_person", "_own", "_next", "_date", "_number")


def reference_prose(section: Column) -> Column:
    """The reference section without its own fields and broken lines."""
    lines = F.transform(F.split(F.regexp_replace(section, "\r", ""), "\n"), drop_garbage_runs)
    text = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    text = F.regexp_replace(text, _VALIDITY + r"\s*", "")
    text = F.regexp_replace(text, _TERM, "")
    kept = F.filter(
        F.transform(F.split(text, "\n"), strip),
        lambda x: ~x.rlike(r"(?iU)^срок (действия заключения|кредита)\s*:|^null[,\s]*$") & ~is_garbage_line(x),
    )
    return strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def with_reference(docs: DataFrame, text: str = "text") -> DataFrame:
    """Validity date, credit term and prose of a short form's last section."""
    t = F.col(text)
    section = F.when(is_short_form(t), extract(t, _REFERENCE))
    df = docs.withColumn("_section", section)
    s = F.col("_section")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return df.withColumns(
        {
            "validity_date": blank(iso_from_dmy(extract(s, _VALIDITY))),
            "credit_term": blank(strip(extract(s, _TERM))),
            "reference_text": blank(reference_prose(s)),
        }
    ).drop("_section")


# --- risks ----------------------------------------------------------------------------

# fixed values: how risks are written
_RISK_SECTION = r"(?isU)(?:выявленн\w*\s+риск\w*|риск\w*\s+залогового|таблица\s+риск\w*)"
_RISK_ID = r"З-[0-9]{1,3}|VIN\s*[A-HJ-NPR-Z0-9]{11,17}|[0-9]{2}:[0-9]{2}:[0-9]{6,7}:[0-9]+"
_RISK_LINE = (
    rf"(?iU)({_RISK_ID})\s*[-–—|]\s*(.+?)(?:минимизац\w*|мер\w*\s+минимизац\w*)\s*[:\-]\s*(.+?)\s*$"
)
_RISK_PIPES = r"(?iU)(З-[0-9]{1,3})[\s|]+([^|;\n]{8,200})[\s|]+([^|;\n]{8,200})"
_RISK_BULLET = (
    r"(?iU)(?:^|\n)\s*(?:[-•]|[0-9]+[).])\s*(риск[^:\n]{5,200}?)(?:минимизац\w*|мер\w*)\s*[:\-]\s*([^\n]{5,200})"
)
_SHORT_SECTION = r"(?isU)\bРиски\b(.*?)(?:Справочная информация|\z)"
_OBJECT_ID = r"(?iU)\b((?:ТС|ИП|МиО|ЗУ|ЗиС|З-[0-9]{1,3})_[\w.,-]+)"
_NOISE = ("ые номера", "объектов не", "заполнены", "ип_исходн", "null")
_STOP_LINES = r"^(для смены|до заключения|категория качества до|в случае невыполнения)"
_GARBAGE_MARK = "исходн|заполнены|объектов не|ые номера|null"

_RISK = "struct<identifier:string,risk_number:string,risk:string,minimization:string>"


def _risk(identifier: Column, number: Column, risk: Column, minimization: Column) -> Column:
    return F.struct(
        identifier.alias("identifier"),
        number.alias("risk_number"),
        risk.alias("risk"),
        minimization.alias("minimization"),
    )


def _first_of_each(items: Column, *fields: str) -> Column:
    """Array without later items that equal an earlier one in these fields.

    Sorted by the fields, equal items are neighbours, so a long document costs
    n log n comparisons.
    """
    key = lambda x: F.lower(F.concat_ws("\u0001", *[x[f] for f in fields]))
    tagged = lambda xs: F.array_sort(F.transform(xs, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))

    def firsts(ts: Column) -> Column:
        new = F.filter(ts, lambda t, j: (j == 0) | (t["k"] != F.get(ts, F.greatest(j - 1, F.lit(0)))["k"]))
        return F.transform(F.array_sort(F.transform(new, lambda t: F.struct(t["i"].alias("i"), t["x"].alias("x")))), lambda t: t["x"])

    return let(items, lambda xs: F.when(F.size(xs) < 2, xs).otherwise(let(tagged(xs), firsts)))


def free_text_risks(text: Column, window: int | None = None, limit: int | None = None) -> Column:
    """Risks written one per line (or in pipes), else as bullets.

    ``window`` is how far the risk section reaches after its heading and
    ``limit`` how many risks are returned; None, the default, cuts nothing.
    """
    reach = f"{{0,{window}}}" if window else "*"
    section = F.coalesce(extract(text, _RISK_SECTION + f"(.{reach})"), text)

    def from_line(line: Column) -> Column:
        def parts(pattern: str) -> Column:
            return F.when(
                line.rlike(pattern),
                _risk(
                    squeeze(F.regexp_extract(line, pattern, 1)),
                    F.lit(""),
                    _strip_chars(squeeze(F.regexp_extract(line, pattern, 2)), r" \-–—:|."),
                    _strip_chars(squeeze(F.regexp_extract(line, pattern, 3)), r" \-–—:|."),
                ),
            )

        # most lines name neither word; the plain tests spare them the patterns
        low = F.lower(line)
        return F.coalesce(
            F.when(low.contains("минимизац"), parts(_RISK_LINE)), F.when(low.contains("з-"), parts(_RISK_PIPES))
        )

    def from_bullet(hit: Column, i: Column) -> Column:
        return _risk(
            F.concat(F.lit("Риск-"), (i + 1).cast("string")),
            F.lit(""),
            _strip_chars(squeeze(F.regexp_extract(hit, _RISK_BULLET, 1)), r" :\-"),
            squeeze(F.regexp_extract(hit, _RISK_BULLET, 2)),
        )

    def read(s: Column) -> Column:
        rows = F.filter(F.transform(F.transform(F.split(s, r"\r\n|\r|\n"), strip), from_line), lambda r: r.isNotNull())
        bullets = F.transform(F.regexp_extract_all(s, F.lit(_RISK_BULLET), F.lit(0)), from_bullet)
        rows = _first_of_each(rows, "identifier", "risk")
        bullets = _first_of_each(bullets, "risk", "minimization")
        return let(rows, lambda r: F.when(F.size(r) > 0, r).otherwise(bullets))

    found = let(section, read)
    return F.slice(found, 1, limit) if limit else found


def _is_noise(line: Column) -> Column:
    low = _strip_chars(F.lower(line), " ,.")
    return low.isin(*_NOISE) | ((F.length(line) < 10) & ~line.rlike(_OBJECT_ID))


def _is_risk_heading(line: Column) -> Column:
    low = F.lower(line)
    return low.startswith("риск ") & ~low.contains("минимизир")


def _is_minimization(line: Column) -> Column:
    low = F.lower(line)
    return (
        low.contains("минимизир")
        | low.rlike(r"^(до заключения|для смены категории|в случае невыполнения)")
        | line.rlike(r"^[0-9]+\.[0-9]+\.")
        | line.rlike(r"(?U)^[А-ЯA-ZЁ][\w.-]*_[0-9]")
    )


def _object_ids(lines: Column) -> Column:
    tokens = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(_OBJECT_ID), F.lit(1))))
    tokens = F.transform(tokens, lambda t: F.struct(F.regexp_replace(t, "[,.]+$", "").alias("t")))
    tokens = F.filter(tokens, lambda t: ~F.lower(t["t"]).endswith("_исходн"))
    return F.array_join(F.transform(_first_of_each(tokens, "t"), lambda t: t["t"]), ", ")


def short_form_risks(text: Column, limit: int | None = None) -> Column:
    """Risk blocks of a short form: a block starts at a risk heading, its
    mitigation at the first line that looks like one."""

    def block_risk(block: Column) -> Column:
        start = F.array_position(F.transform(F.slice(block, 2, F.size(block)), _is_minimization), F.lit(True)).cast("int")
        lines = let(start, lambda n: F.when(n > 0, F.slice(block, n + 1, F.size(block))))
        how = _strip_chars(squeeze(F.coalesce(F.array_join(lines, " "), F.lit(""))), r" \-–—.")
        return _risk(
            _object_ids(block),
            F.lit(""),
            _strip_chars(squeeze(F.get(block, F.lit(0))), r" \-–—."),
            F.coalesce(non_empty(how), F.lit(NONE)),
        )

    def read(lines: Column) -> Column:
        starts = F.filter(
            F.transform(lines, lambda x, i: F.when(_is_risk_heading(x), i + 1)), lambda i: i.isNotNull()
        )

        def cut(s: Column) -> Column:
            stop = lambda k: F.coalesce(F.get(s, k + 1), F.size(lines) + 1)
            return F.transform(s, lambda i, k: let(F.slice(lines, i, stop(k) - i), block_risk))

        return _first_of_each(let(starts, cut), "identifier", "risk", "minimization")

    section = F.coalesce(extract(text, _SHORT_SECTION), F.lit(""))
    lines = F.filter(
        F.transform(F.split(section, r"\r\n|\r|\n"), strip), lambda x: (x != "") & ~_is_noise(x)
    )
    named = F.transform(
        let(lines, read),
        lambda r, i: _risk(
            F.coalesce(non_empty(r["identifier"]), F.concat(F.lit("Риск-"), (i + 1).cast("string"))),
            r["risk_number"],
            r["risk"],
            r["minimization"],
        ),
    )
    return F.slice(named, 1, limit) if limit else named


def with_risks(
    docs: DataFrame, text: str = "text", free_limit: int | None = None, short_limit: int | None = None, window: int | None = None
) -> DataFrame:
    """``risks`` array: short-form blocks first, free text where there are none. None cuts nothing."""
    t = F.col(text)
    df = docs.withColumn("_short", F.when(is_short_form(t), short_form_risks(t, short_limit)))
    chosen = F.when(F.size("_short") > 0, F.col("_short")).otherwise(free_text_risks(t, window, free_limit))
    enough = F.length(t) >= MIN_TEXT
    return df.withColumn("risks", F.when(enough, chosen).otherwise(F.array().cast(f"array<{_RISK}>"))).drop("_short")


def risk_rows(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return docs.select(doc_id, F.posexplode("risks").alias("pos", "r")).select(doc_id, "pos", "r.*")


# --- risks from table cells ----------------------------------------------------------------


def _cell_objects(c: Column) -> Column:
    lines = F.filter(
        F.transform(F.split(c, r"\r\n|\r|\n"), lambda x: squeeze(F.regexp_replace(strip(x), ",+$", ""))),
        lambda x: (x != "") & ~F.lower(x).rlike(_GARBAGE_MARK),
    )
    usable = (c != "") & ~F.lower(c).rlike(_GARBAGE_MARK)
    return F.coalesce(F.when(usable, non_empty(F.array_join(lines, ", "))), F.lit(NONE))


def _cell_risk(c: Column) -> Column:
    """The risk's wording: the first line and further "risk" lines, up to the
    mitigation text."""
    lines = F.filter(F.transform(F.split(c, r"\r\n|\r|\n"), strip), lambda x: x != "")

    def cut(xs: Column) -> Column:
        goes_on = F.transform(xs, lambda x, i: (i == 0) | (F.lower(x).startswith("риск ") & ~F.lower(x).rlike(_STOP_LINES)))
        stop = F.array_position(goes_on, F.lit(False)).cast("int")
        kept = F.when(stop > 0, F.slice(xs, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(xs)
        return F.coalesce(non_empty(squeeze(F.array_join(kept, " "))), F.lit(NONE))

    return let(lines, cut)


def table_risks(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Risks out of document tables: (doc_id, table_no, row, cells).

    They stand between the row titled as risks and the reference section. The
    two rows are found by aggregates; equal risks keep the first.
    """
    first = strip(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))
    keyed = rows.withColumn("_first", first)
    begins = keyed.where(F.lower("_first") == "риски").groupBy("doc_id", "table_no").agg(F.min("row").alias("_from"))
    inside = keyed.join(begins, ["doc_id", "table_no"]).where("row > _from")
    ends = inside.where(F.lower("_first").startswith("справочная")).groupBy("doc_id", "table_no").agg(F.min("row").alias("_to"))
    inside = inside.join(ends, ["doc_id", "table_no"], "left").where("(_to IS NULL OR row < _to) AND _first <> ''")
    cell = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    number = F.regexp_replace(F.regexp_replace(cell(1), r"(?U)\s+", ""), r"\.+$", "")
    risk = F.when(F.size("cells") > 2, _cell_risk(cell(2))).otherwise(F.lit(""))
    # a row without a risk cell counts when it names objects; the cheap test first
    inside = inside.where((F.size("cells") > 2) | (_cell_objects(F.col("_first")) != NONE))
    found = inside.select(
        "doc_id",
        F.struct("table_no", "row").alias("_at"),
        _cell_objects(F.col("_first")).alias("identifier"),
        number.alias("risk_number"),
        risk.alias("risk"),
    )
    low = [F.lower(c).alias(f"_{c}") for c in ("identifier", "risk_number", "risk")]
    once = found.groupBy("doc_id", *low).agg(F.min_by(F.struct("_at", "identifier", "risk_number", "risk"), "_at").alias("r"))
    out = once.select("doc_id", "r.*")
    if limit:
        order = W.partitionBy("doc_id").orderBy("_at")
        out = out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
    return out.select(
        "doc_id",
        "identifier",
        "risk_number",
        F.coalesce(non_empty(F.col("risk")), F.lit(NONE)).alias("risk"),
        F.lit(NONE).alias("minimization"),
    )


# --- mitigation dictionary ------------------------------------------------------------------

_RISK_NUMBER = r"^([0-9]+(?:\.[0-9]+)*|[А-ЯA-ZЁ]+_[0-9.]+)"


def mitigation_dictionary(rows: DataFrame) -> DataFrame:
    """(risk_number, answer) from question/answer rows over all sheets; the
    number leads the question, the last row wins. ``rows``: sheet_no, row,
    question, answer."""
    number = F.regexp_replace(extract(strip(F.col("question")), _RISK_NUMBER), r"\.+$", "")
    return (
        rows.where(filled(F.col("answer")).isNotNull())
        .withColumn("risk_number", number)
        .where("risk_number IS NOT NULL")
        .groupBy("risk_number")
        .agg(F.max_by(strip(F.col("answer")), F.struct("sheet_no", "row")).alias("answer"))
    )


def with_mitigation(risks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Mitigation by risk number; risks without a number keep their own text,
    an unknown number gives a dash."""
    key = F.regexp_replace(strip(F.coalesce("risk_number", F.lit(""))), r"\.+$", "")
    known = dictionary.select(F.col("risk_number").alias("_key"), "answer")
    own = F.coalesce("risk_number", F.lit("")) == ""
    return (
        risks.withColumn("_key", key)
        .join(known, "_key", "left")
        .withColumn("minimization", F.when(own, F.col("minimization")).otherwise(F.coalesce("answer", F.lit(NONE))))
        .drop("_key", "answer")
    )


# --- report --------------------------------------------------------------------------------

# fixed values: notes on what could not be read
_NOTE_SHORT = "Не удалось извлечь достаточно текста из PDF (возможно, скан без текстового слоя)."
_NOTES = (
    ("conclusion_number", "Номер заключения ASZ… не найден в тексте."),
    ("conclusion_date", "Дата заключения не распознана."),
    ("client_name", "Наименование клиента не распознано."),
    ("tax_id", "ИНН не найден в тексте PDF."),
)


def quality_notes(text: Column, checks: Sequence[tuple[str, str]] = _NOTES, min_text: int = MIN_TEXT) -> Column:
    """What is missing; a text too short to read gets that one note."""
    missing = F.filter(
        F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(note)) for c, note in checks]), lambda n: n.isNotNull()
    )
    return F.when(F.coalesce(F.length(text), F.lit(0)) < min_text, F.array(F.lit(_NOTE_SHORT))).otherwise(missing)


def note_counts(docs: DataFrame, notes: str = "notes") -> DataFrame:
    return docs.select(F.explode(notes).alias("note")).groupBy("note").agg(F.count("*").alias("documents"))


def summary(number: Column, date: Column, client: Column, tax_id: Column, validity: Column, term: Column, objects: Column, risks: Column) -> Column:
    """The report's opening sentences."""
    said = lambda c, text: F.when(F.coalesce(c, F.lit("")) != "", text)
    return F.concat_ws(
        " ",
        F.concat(
            F.lit("Залоговое заключение "),
            F.coalesce(non_empty(number), F.lit("номер не распознан")),
            F.lit(" от "),
            F.coalesce(non_empty(date), F.lit("дата не распознана")),
            F.lit(" подготовлено для "),
            F.coalesce(non_empty(client), F.lit("клиент не указан в PDF")),
            F.lit("."),
        ),
        said(tax_id, F.concat(F.lit("ИНН залогодателя: "), tax_id, F.lit("."))),
        said(validity, F.concat(F.lit("Срок действия заключения: до "), validity, F.lit("."))),
        said(term, F.concat(F.lit("Срок кредита: "), term, F.lit("."))),
        F.when(
            objects > 0,
            F.concat(
                F.lit("В перечне залога указано объектов: "),
                objects.cast("string"),
                F.lit(". Стоимостные показатели приведены в таблице ниже."),
            ),
        ),
        F.when(
            risks > 0,
            F.concat(
                F.lit("В тексте заключения выявлено рисков: "), risks.cast("string"), F.lit(". Подробности — в разделе «Риски».")
            ),
        ).otherwise(
            F.lit("Явные формулировки рисков в PDF не распознаны автоматически. Проверьте исходный документ вручную.")
        ),
    )


def extract_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    free_limit: int | None = None,
    short_limit: int | None = None,
    window: int | None = None,
) -> DataFrame:
    """All fields, risks and notes of every document. The limits are those of :func:`with_risks`; None cuts nothing."""
    df = docs.withColumn(text, normal_text(F.col(text)))
    df = with_risks(with_reference(with_header(df, text), text), text, free_limit, short_limit, window)
    return df.withColumn("notes", quality_notes(F.col(text)))


def report(conclusions: DataFrame, objects: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Conclusions with the number of their register objects and the summary.
    Objects are counted first, so one row per document is joined."""
    counts = objects.groupBy(doc_id).agg(F.count("*").alias("object_count"))
    joined = conclusions.join(counts, doc_id, "left").withColumn("object_count", F.coalesce("object_count", F.lit(0)))
    c = F.col
    return joined.withColumn(
        "summary",
        summary(
            c("conclusion_number"), c("conclusion_date"), c("client_name"), c("tax_id"), c("validity_date"),
            c("credit_term"), c("object_count"), F.size("risks"),
        ),
    )


def client_card(reports: DataFrame, today: Column) -> DataFrame:
    """Report fields for a client card; an unreadable date becomes today."""
    text = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    date = text("conclusion_date")
    return reports.select(
        text("conclusion_number").alias("id"),
        F.when(date.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), date).otherwise(today.cast("string")).alias("date"),
        text("client_name").alias("client_name"),
        text("tax_id").alias("tax_id"),
        text("summary").alias("summary"),
        text("validity_date").alias("validity_date"),
        text("credit_term").alias("credit_term"),
        text("reference_text").alias("reference_text"),
        F.transform(
            "risks",
            lambda r: F.struct(
                *[F.coalesce(non_empty(strip(r[f])), F.lit(NONE)).alias(f) for f in ("identifier", "risk", "minimization")],
                strip(r["risk_number"]).alias("risk_number"),
            ),
        ).alias("risks"),
    )
