"""Vehicle identifiers, number plates and cadastral keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, filled, let, strip

VIN_LENGTH = 17

# fixed values: the keyboard rows of the Russian and the Latin layout
_LAYOUT_RU = "ЙЦУКЕНГШЩЗХЪФЫВАПРОЛДЖЭЯЧСМИТЬБЮЁ"
_LAYOUT_EN = "QWERTYUIOP[]ASDFGHJKL;'ZXCVBNM,.`"
# fixed values: Cyrillic letters and the identifier characters they look like
_LOOK_RU = "АВСЕНКМОРТУХІЗ"
_LOOK_EN = "ABCEHKM0PTYX13"
# fixed values: Cyrillic letters that no look-alike explains
_LAYOUT_MARKERS = "ЙЦГШЩЗЪФЫПЛДЖЭЯЧИЬБЮЁ"

# fixed values: letter values and position weights of the check digit
_VALUE_OF = ("ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789")
_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)


def fix_keyboard(c: Column) -> Column:
    """Cyrillic to Latin: by keyboard layout if a marker letter shows that the
    layout was wrong, else by look. Text without Cyrillic is left as it is."""

    def both_cases(ru: str, en: str) -> tuple[str, str]:
        return ru + ru.lower(), en + en

    wrong_layout = F.upper(c).rlike(f"[{_LAYOUT_MARKERS}]")
    return F.when(wrong_layout, F.translate(c, *both_cases(_LAYOUT_RU, _LAYOUT_EN))).otherwise(
        F.translate(c, *both_cases(_LOOK_RU, _LOOK_EN))
    )


def normalize_vin(c: Column) -> Column:
    """Latin upper case without blanks and dashes; null becomes ''."""
    return F.regexp_replace(F.upper(fix_keyboard(F.coalesce(c, F.lit("")))), r"(?U)\s+|-", "")


def _digit_values(vin: Column) -> Column:
    return F.translate(vin, *_VALUE_OF)


def check_digit(vin: Column) -> Column:
    """Expected 9th character of a normalised 17-character id, else null."""
    values = _digit_values(vin)
    total = F.lit(0)
    for i, weight in enumerate(_WEIGHTS, start=1):
        if weight:
            total = total + F.substring(values, i, 1).try_cast("int") * weight
    rest = total % 11
    usable = (F.length(vin) == VIN_LENGTH) & values.rlike("^[0-9]{17}$")
    return F.when(usable, F.when(rest == 10, F.lit("X")).otherwise(rest.cast("string")))


def vin_sections(vin: Column) -> Column:
    """Maker, descriptor and serial sections of a 17-character id."""
    ok = F.length(vin) == VIN_LENGTH
    return F.struct(
        F.when(ok, F.substring(vin, 1, 3)).alias("wmi"),
        F.when(ok, F.substring(vin, 4, 6)).alias("vds"),
        F.when(ok, F.substring(vin, 10, 8)).alias("vis"),
    )


def issue(code: str, message: Column | str, position: Column | None = None, suggestion: Column | None = None) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(
        F.lit(code).alias("code"),
        text.alias("message"),
        (F.lit(None) if position is None else position).cast("int").alias("position"),
        (F.lit(None) if suggestion is None else suggestion).cast("string").alias("suggestion"),
    )


def _present(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _positions(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.sequence(F.lit(1), F.length(c))).otherwise(F.array().cast("array<int>"))


def structure_issues(raw: Column) -> Column:
    """Issues against the 17-character standard, in reading order."""

    def char_issue(vin: Column, pos: Column) -> Column:
        ch = F.substring(vin, pos, F.lit(1))
        return F.when(
            ch.isin("I", "O", "Q"),
            issue("forbidden_char", F.format_string("Символ «%s» запрещён в VIN (позиция %d)", ch, pos), pos),
        ).when(
            ~ch.rlike("^[0-9A-Z]$"),
            issue("invalid_char", F.format_string("Недопустимый символ «%s» (позиция %d)", ch, pos), pos),
        )

    def found(vin: Column) -> Column:
        size = F.length(vin)
        # most ids are clean, so characters are walked only where one is wrong
        chars = F.when(
            vin.rlike("[^0-9A-HJ-NPR-Z]"),
            F.filter(F.transform(_positions(vin), lambda pos: char_issue(vin, pos)), lambda x: x.isNotNull()),
        ).otherwise(F.array().cast(_ISSUES))
        actual = F.substring(vin, 9, 1)
        wrong_digit = let(
            check_digit(vin),
            lambda expected: F.when(
                expected.isNotNull() & (actual != expected),
                issue(
                    "check_digit",
                    F.format_string("Неверная контрольная цифра в позиции 9: ожидается «%s», указано «%s»", expected, actual),
                    F.lit(9),
                ),
            ),
        )
        return F.concat(
            _present(
                F.when(vin.rlike(r"[^\x00-\x7f]"), issue("non_ascii", "Обнаружены недопустимые не-ASCII символы")),
                F.when(
                    size != VIN_LENGTH,
                    issue("wrong_length", F.format_string("Длина VIN должна быть 17 символов, получено %d", size)),
                ),
            ),
            chars,
            _present(wrong_digit),
        )

    return F.when(filled(raw).isNull(), F.array(issue("empty", "VIN не указан"))).otherwise(let(normalize_vin(raw), found))


# fixed values: Latin characters confused with identifier digits
_CONFUSED = ("IOQloiq", "1001010")


def _core(raw: Column) -> Column:
    return F.replace(F.replace(strip(F.coalesce(raw, F.lit(""))), F.lit("-"), F.lit("")), F.lit(" "), F.lit(""))


def spelling_issues(raw: Column) -> Column:
    """How the id was written: case, blanks, dashes, Cyrillic, confused letters."""
    text = F.coalesce(raw, F.lit(""))

    def char_issue(fixed: Column, pos: Column) -> Column:
        ch = F.substring(fixed, pos, F.lit(1))
        digit = F.translate(ch, *_CONFUSED)
        return F.when(
            ch.rlike("^[IOQoiq]$"),
            issue(
                "forbidden_letter",
                F.format_string("Запрещённая буква «%s» в позиции %d (в VIN используйте «%s»)", ch, pos, digit),
                pos,
                digit,
            ),
        ).when(
            ch == "l",
            issue("confusable", F.format_string("Символ «%s» похож на «%s» (позиция %d)", ch, digit, pos), pos, digit),
        )

    def found(w: Column) -> Column:
        fixed, vin, cyrillic = w["fixed"], w["vin"], w["core"] != w["fixed"]
        confused = fixed.rlike("[IOQloiq]")
        chars = F.when(
            confused,
            F.filter(F.transform(_positions(fixed), lambda pos: char_issue(fixed, pos)), lambda x: x.isNotNull()),
        ).otherwise(F.array().cast(_ISSUES))
        suggested = F.upper(F.translate(fixed, *_CONFUSED))
        return F.concat(
            _present(
                F.when(
                    text != F.upper(text),
                    issue("lowercase", "VIN должен записываться заглавными латинскими буквами и цифрами"),
                ),
                F.when(text.rlike(r"(?U)\s"), issue("whitespace", "VIN не должен содержать пробелы")),
                F.when(text.contains("-"), issue("separators", "VIN не должен содержать дефисы")),
                F.when(
                    cyrillic,
                    issue(
                        "cyrillic",
                        "Обнаружена кириллица — исправлена с учётом раскладки клавиатуры",
                        suggestion=normalize_vin(fixed),
                    ),
                ),
            ),
            chars,
            _present(
                F.when(
                    (cyrillic | confused) & (F.length(suggested) == VIN_LENGTH) & (suggested != vin),
                    issue("suggestion", F.concat(F.lit("Возможный исправленный VIN: "), suggested), suggestion=suggested),
                ),
                F.when(
                    F.length(vin) > VIN_LENGTH,
                    issue("extra_chars", F.format_string("Лишние символы: длина %d вместо 17", F.length(vin))),
                ),
            ),
        )

    core = _core(raw)
    written = F.struct(core.alias("core"), fix_keyboard(core).alias("fixed"), normalize_vin(raw).alias("vin"))
    return F.when(filled(raw).isNull(), F.array().cast(_ISSUES)).otherwise(let(written, found))


_ISSUES = "array<struct<code:string,message:string,position:int,suggestion:string>>"


def suggested_vin(raw: Column) -> Column:
    """The spelling check's proposal, null where nothing was changed."""
    core = _core(raw)
    changed = lambda fixed: F.when(
        (fixed != core) | fixed.rlike("[IOQloiq]"), F.upper(F.translate(fixed, *_CONFUSED))
    )
    return let(fix_keyboard(core), changed)


# fixed values: letters of a Russian plate and their Latin doubles
_PLATE_RU = "АВЕКМНОРСТУХ"
_PLATE_EN = "ABEKMHOPCTYX"
_PLATE = f"^[{_PLATE_RU}][0-9]{{3}}[{_PLATE_RU}]{{2}}[0-9]{{2,3}}$"


def normalize_plate(c: Column) -> Column:
    s = F.regexp_replace(strip(F.upper(F.coalesce(c, F.lit("")))), r"[ \-_.|]", "")
    return F.translate(F.regexp_replace(s, "RUS$", ""), _PLATE_EN, _PLATE_RU)


def is_probable_plate(c: Column) -> Column:
    n = normalize_plate(c)
    return n.rlike(_PLATE) | (F.length(n).between(7, 9) & n.rlike(f"[{_PLATE_RU}]"))


def plate_error(n: Column) -> Column:
    """Why a normalised plate is not one; null when it is."""
    return (
        F.when(n == "", F.lit("Госномер не указан"))
        .when(
            ~F.length(n).between(7, 9),
            F.format_string("Госномер должен содержать 7–9 символов (сейчас %d)", F.length(n)),
        )
        .when(~n.rlike(_PLATE), F.lit("Неверный формат госномера (пример: А123АА77)"))
    )


# fixed values: Cyrillic letters in provider text and their Latin doubles
_FOLD_RU = "АВЕКМНОРСТХУаеорсухІі"
_FOLD_EN = "ABEKMHOPCTXYaeopcyxIi"


def fold_lookalikes(c: Column) -> Column:
    """Provider text: Cyrillic doubles to Latin (О is the letter O here)."""
    return filled(F.translate(strip(c), _FOLD_RU, _FOLD_EN))


# fixed values: placeholders that mean "no value"
PLACEHOLDERS = ("null", "not applicable", "n/a")


def clean_value(c: Column) -> Column:
    s = filled(c)
    return F.when(~F.lower(s).isin(*PLACEHOLDERS), s)


def _key_parts(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9:]", ""), ":"), lambda x: x != "")


def _pad2(c: Column) -> Column:
    # lpad alone would cut longer parts
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def quarter_key(c: Column) -> Column:
    """First three parts of a cadastral key, null when there are fewer."""
    p = _key_parts(c)
    at = lambda i: F.get(p, F.lit(i))
    return F.when(F.size(p) >= 3, F.concat_ws(":", _pad2(at(0)), _pad2(at(1)), at(2)))


def object_key(c: Column) -> Column:
    """Full cadastral key of exactly four parts, else null."""
    p = _key_parts(c)
    at = lambda i: F.get(p, F.lit(i))
    return F.when(F.size(p) == 4, F.concat_ws(":", _pad2(at(0)), _pad2(at(1)), at(2), at(3)))


def squeeze_upper(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, WS, ""))


def key_variants(key: Column) -> Column:
    """Ways a cadastral key is written in a text: with colons, blanks or
    dashes, with the third part not zero-filled, or its last two parts."""
    k = strip(key)
    p = F.split(k, ":")
    third = F.get(p, F.lit(2))
    short = F.regexp_replace(third, "^0+(?=[0-9])", "")
    four = F.size(p) == 4
    return F.array_distinct(
        F.filter(
            F.array(
                k,
                F.replace(k, F.lit(":"), F.lit(" ")),
                F.replace(k, F.lit(":"), F.lit("-")),
                F.when(four, F.concat_ws(":", F.get(p, F.lit(0)), F.get(p, F.lit(1)), short, F.get(p, F.lit(3)))),
                F.when(four, F.concat_ws(":", third, F.get(p, F.lit(3)))),
            ),
            lambda v: v.isNotNull() & (v != ""),
        )
    )


def text_mentions(text: Column, key: Column) -> Column:
    """The text holds one of the key's variants."""
    hay = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(key_variants(F.coalesce(key, F.lit(""))), lambda v: hay.contains(F.lower(v)))
