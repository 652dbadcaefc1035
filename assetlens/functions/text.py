"""Text helpers: blanks, first matches, labelled text, tags, tokens."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's plain \s misses the no-break space, the Unicode class does not.
WS = r"(?U)\s+"


def squeeze(c: Column) -> Column:
    """Runs of blanks to one space, ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, WS, " "))


def strip(c: Column) -> Column:
    """Trim any Unicode blank from both ends, keep the inside."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def non_empty(c: Column) -> Column:
    """'' to null. ``nullif`` would compute ``c`` twice in a branch or lambda, and four times where two are nested."""
    return F.get(F.array_remove(F.array(c), F.lit("")), F.lit(0))


def filled(c: Column) -> Column:
    """Blank text to null."""
    return non_empty(strip(c))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` with null instead of '' on a miss."""
    return non_empty(F.regexp_extract(c, pattern, group))


def extract_first(c: Column, patterns: Sequence[str], group: int = 1) -> Column:
    """First pattern that matches wins."""
    return F.coalesce(*[extract(c, p, group) for p in patterns])


def contains_any(c: Column, needles: Sequence[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def fold_yo(c: Column) -> Column:
    """Lower case with ё written as е."""
    return F.translate(F.lower(c), "ё", "е")


def first_by_rules(c: Column, rules: Sequence[tuple[str, str]], default: Column | None = None) -> Column:
    """Ordered regex rules to a label; the first that hits wins."""
    expr = None
    for pattern, label in rules:
        hit = c.rlike(pattern)
        expr = F.when(hit, F.lit(label)) if expr is None else expr.when(hit, F.lit(label))
    return expr.otherwise(default) if default is not None else expr


def _map_of(entries: Column, pick: int) -> Column:
    def build(e: Column) -> Column:
        value = lambda k: F.try_element_at(F.filter(e, lambda x: x["key"] == k), F.lit(pick))["value"]
        keys = F.array_distinct(F.transform(e, lambda x: x["key"]))
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), value(k).alias("value"))))

    return let(entries, build)


def map_last_wins(entries: Column) -> Column:
    """Array of (key, value) structs to a map in order of first appearance; the
    last of equal keys gives the value."""
    return _map_of(entries, -1)


def map_first_wins(entries: Column) -> Column:
    """As :func:`map_last_wins`, but the first of equal keys gives the value."""
    return _map_of(entries, 1)


def lookup(table: dict, key: Column) -> Column:
    """Value of a small fixed table, null for an unknown key."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else str(x)
    pairs = ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def map_merge(base: Column, other: Column) -> Column:
    """Union of two maps; values of ``base`` win (a null there does not)."""
    return F.map_zip_with(base, other, lambda _k, a, b: F.coalesce(a, b))


def empty_map() -> Column:
    return F.expr("cast(map() as map<string,string>)")


# fixed values: words that mean "no data" in a register cell
NO_DATA = ("н/д", "не указано")


def _chunks(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), strip), lambda x: x != "")


def semicolon_entries(c: Column) -> Column:
    """``key: value; key: value`` text to (key, value) structs, in order.

    Keys are lower case with single blanks; "no data" values are dropped.
    """
    pairs = F.transform(
        F.filter(_chunks(c), lambda x: x.contains(":")),
        lambda x: F.struct(
            squeeze(F.lower(F.substring_index(x, ":", 1))).alias("key"),
            strip(F.regexp_replace(x, r"(?s)^[^:]*:", "")).alias("value"),
        ),
    )
    return F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != "") & ~F.lower(p["value"]).isin(*NO_DATA))


def first_bare_chunk(c: Column) -> Column:
    """The first ``;`` chunk without a colon."""
    return F.get(F.filter(_chunks(c), lambda x: ~x.contains(":")), F.lit(0))


def entry_if(key: str, value: Column) -> Column:
    """One (key, value) struct in an array, or an empty array."""
    return F.filter(
        F.array(F.struct(F.lit(key).alias("key"), value.alias("value"))), lambda e: e["value"].isNotNull()
    )


def semicolon_fields(c: Column) -> Column:
    """Map of :func:`semicolon_entries`, the last of equal keys wins; the first
    bare chunk becomes ``kind``."""
    return map_last_wins(F.concat(entry_if("kind", F.lower(first_bare_chunk(c))), semicolon_entries(c)))


def strip_tags(c: Column) -> Column:
    """Tags to blanks, the common entities decoded, blanks squeezed."""
    x = F.regexp_replace(c, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&#34;", '"'), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return squeeze(x)


def strip_page(c: Column) -> Column:
    """As :func:`strip_tags`, but scripts and styles vanish with their content
    and numeric entities become blanks."""
    x = F.regexp_replace(c, r"(?is)<script.*?</script>", "")
    x = F.regexp_replace(x, r"(?is)<style.*?</style>", "")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    x = F.regexp_replace(x, r"&nbsp;|&#[0-9]+;", " ")
    return squeeze(x)


def word_tokens(c: Column, stop_words: Sequence[str] = (), min_len: int = 2) -> Column:
    """Lower-case letter/digit words of at least ``min_len`` without stop words."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " ")
    keep = F.filter(words, lambda w: F.length(w) >= min_len)
    if stop_words:
        keep = F.filter(keep, lambda w: ~w.isin(*stop_words))
    return keep


def index_tokens(c: Column) -> Column:
    """All letter/digit runs, lower case, Latin diacritics folded."""
    return F.regexp_extract_all(fold_latin(F.lower(c)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


# fixed values: accented Latin letters and their plain forms
_ACCENTED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįñńňòóôõöōőřśšťùúûüūůűųýÿźżž"
_PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiinnnooooooorsstuuuuuuuuyyzzz"


def fold_latin(c: Column) -> Column:
    return F.translate(c, _ACCENTED, _PLAIN)


# fixed values: the Russian letters and the Latin-1 letters their windows-1251
# bytes turn into
_CYRILLIC = "".join(chr(x) for x in range(0x410, 0x450)) + "Ёё№"
_AS_LATIN1 = "".join(chr(x) for x in range(0xC0, 0x100)) + "¨¸¹"


def repair_latin1_cyrillic(c: Column) -> Column:
    """Text whose Cyrillic bytes were read as Latin-1; others pass unchanged."""
    fixable = ~c.rlike("[А-Яа-яЁё]") & ~c.rlike(r"[^\x00-\xff]")
    fixed = F.translate(c, _AS_LATIN1, _CYRILLIC)
    return F.when(fixable & fixed.rlike("[А-Яа-яЁё]"), fixed).otherwise(c)


def symbol_count(c: Column) -> Column:
    """Capital Latin letters and ASCII punctuation."""
    return F.regexp_count(c, F.lit(SYMBOLS))


# fixed values: what a broken PDF text layer is made of
SYMBOLS = r"""[!"#$%&'()*+,\-./:;<=>?@A-Z\[\\\]^_`{|}~]"""


def is_garbage_line(c: Column) -> Column:
    """A line from a broken text layer: nearly no Cyrillic, many symbols."""
    cyr = F.regexp_count(c, F.lit("[А-Яа-яЁё]"))
    sym = symbol_count(c)
    return (F.trim(c) != "") & (cyr < 10) & (((cyr == 0) & (sym >= 6)) | ((sym >= 12) & (cyr < 5)))


def drop_garbage_runs(c: Column) -> Column:
    """Cut runs of 12+ symbols out of a line."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, rf"(?:{SYMBOLS}\s*){{12,}}", " "), r"[ \t]+", " "))


# fixed values: letter table of the listing-site slug
_TRANSLIT_ONE = ("абвгдеёзийклмнопрстуфхцыэ", "abvgdeezijklmnoprstufhcye")
_TRANSLIT_MANY = (("ж", "zh"), ("ч", "ch"), ("щ", "sch"), ("ш", "sh"), ("ю", "yu"), ("я", "ya"), ("ъ", ""), ("ь", ""))


def slug(c: Column) -> Column:
    """Russian text to a lower-case Latin slug with single dashes."""
    x = F.translate(F.lower(c), *_TRANSLIT_ONE)
    for letter, latin in _TRANSLIT_MANY:
        x = F.replace(x, F.lit(letter), F.lit(latin))
    x = F.regexp_replace(x, r"[^a-z0-9]+", "-")
    return non_empty(F.regexp_replace(x, r"^-|-$", ""))
