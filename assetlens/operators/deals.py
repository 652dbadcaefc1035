"""Property deals: keys, enrichment, search, price statistics."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import object_key, quarter_key
from ..functions.numbers import area_number, price_number, round_half_up
from ..functions.text import lookup, non_empty
from ..session import label_table
from .classifier import (
    BUILDING,
    CATEGORIES,
    LAND,
    PREMISES,
    category_label,
    deal_category,
    purpose_kind,
    with_label,
    with_label_list,
)

PAGE_LIMIT = 10_000  # rows that one page of results shows; nothing is cut unless asked for

# fixed values: how people name the two kinds and the three object types
KIND_WORDS = {
    "deal": ("deal", "deals", "сделка", "сделки", "продажа", "продажи"),
    "rent": ("rent", "аренда"),
}
TYPE_WORDS = {"land": LAND, "building": BUILDING, "premises": PREMISES, "зу": LAND, "здание": BUILDING, "помещение": PREMISES}


def with_keys(df: DataFrame, raw: str) -> DataFrame:
    """Quarter and object key of a free-form number; a reject reason if neither."""
    c = F.col(raw)
    return df.withColumns(
        {
            "quarter_key": quarter_key(c),
            "object_key": object_key(c),
            "key_reject": F.when(quarter_key(c).isNull(), F.lit("fewer than three parts")),
        }
    )


def enrich(deals: DataFrame, codes: DataFrame) -> DataFrame:
    """Clean numbers, unit price, labels, category and location of scanned deals."""
    price, area = price_number(F.col("deal_price")), area_number(F.col("area"))
    typed = deals.withColumns(
        {
            "deal_price": price.cast("decimal(18,2)"),
            "area": area,
            "unit_price": F.when(area > 0, round_half_up(price / area)),
            "location_label": non_empty(
                F.concat_ws(", ", *[non_empty(F.col(c)) for c in ("city", "district", "street")])
            ),
        }
    )
    typed = apply_labels(typed, codes)
    # the purpose kind looks at the dictionary's label, which a miss is not
    known = F.when(F.col("purpose_label") != F.col("purpose_code"), F.col("purpose_label"))
    category = deal_category(F.col("realestate_type_code"), purpose_kind(F.col("purpose_code"), known))
    return typed.withColumn("category", category).withColumn("category_label", category_label(F.col("category")))


def apply_labels(deals: DataFrame, codes: DataFrame) -> DataFrame:
    """All three label columns of a deal."""
    out = with_label(deals, "realestate_type_code", "realestate_type_label", codes)
    out = with_label(out, "purpose_code", "purpose_label", codes)
    return with_label_list(out, [], "wall_material_code", "wall_material_label", codes)


def kinds_from_words(words: Iterable[str] | None) -> list[str] | None:
    """User words to operation kinds; None (no filter) when nothing is known."""
    known = {w: kind for kind, ws in KIND_WORDS.items() for w in ws}
    hits = dict.fromkeys(known[w] for w in (str(x).strip().lower() for x in words or ()) if w in known)
    return list(hits) or None


def types_from_words(words: Iterable[str] | None) -> list[str] | None:
    """User words (id, code or Russian label) to object-type codes."""
    codes = set(TYPE_WORDS.values())
    out: dict[str, None] = {}
    for word in (str(x).strip() for x in words or ()):
        hit = word if word in codes else TYPE_WORDS.get(word) or TYPE_WORDS.get(word.lower())
        if hit:
            out[hit] = None
    return list(out) or None


def synonym_ids(df: DataFrame, word: str, out: str, table: Mapping[str, Sequence[str]]) -> DataFrame:
    """Column form of the vocabularies: trimmed lower-case word to its id."""
    ids = {w: key for key, ws in table.items() for w in ws}
    return df.withColumn(out, lookup(ids, F.lower(F.trim(F.col(word)))))


def matching(
    quarter: str | Column | None = None,
    year: int | None = None,
    types: Sequence[str] | None = None,
    kinds: Sequence[str] | None = None,
) -> Column:
    """The search predicate; plain comparisons, so it reaches the Parquet scan."""
    cond = F.lit(True)
    if quarter is not None:
        cond = cond & (F.col("quarter_cad_number") == quarter)
    if year is not None:
        cond = cond & (F.col("year") == year)
    if types:
        cond = cond & F.col("realestate_type_code").isin(list(types))
    if kinds:
        cond = cond & F.col("kind").isin(list(kinds))
    return cond


def quarter_argument(text: str) -> str:
    """The key of a search call; a literal, so that the scan can use it."""
    parts = [p for p in re.sub(r"[^0-9:]", "", text or "").split(":") if p]
    if len(parts) < 3:
        raise ValueError(f"not a cadastral quarter (XX:XX:XXXXXXX): {text!r}")
    return f"{parts[0]:0>2}:{parts[1]:0>2}:{parts[2]}"


def newest_first(tie_break: Sequence[str] = ()) -> list[Column]:
    return [F.desc("sort_key"), F.col("deal_price").desc_nulls_last(), *[F.col(c) for c in tie_break]]


def search(
    deals: DataFrame,
    quarter: str,
    *,
    year: int | None = None,
    object_types: Iterable[str] | None = None,
    operation_kinds: Iterable[str] | None = None,
    limit: int | None = None,
    tie_break: Sequence[str] = ("dataset_file", "number"),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deals of one quarter key: (rows, up to ``limit`` if given, statistics, summary).

    Statistics and summary cover the full match, not the shown rows.
    """
    key = quarter_argument(quarter)
    hits = deals.where(matching(key, year, types_from_words(object_types), kinds_from_words(operation_kinds)))
    rows = hits.orderBy(*newest_first(tie_break))
    rows = rows.limit(limit) if limit else rows
    most = F.lit(limit).cast("bigint") if limit else F.col("total")
    summary = hits.agg(F.count("*").alias("total")).select(
        F.lit(key).alias("quarter_cad_number"),
        "total",
        F.least("total", most).alias("shown"),
        (F.col("total") > most).alias("truncated"),
        F.when(
            F.col("total") == 0,
            F.lit(f"Записей по кварталу {key} за {year} год не найдено")
            if year
            else F.lit(f"Записей по кварталу {key} в подключённых датасетах не найдено"),
        ).alias("message"),
    )
    return rows, price_stats_by_category(hits), summary


def index_prunes(deals_files: DataFrame, index: DataFrame, quarter: str) -> DataFrame:
    """Dataset rows worth scanning for a key: the index names it, or the file
    has no (or an empty) index."""
    hit = index.where(F.col("quarter_cad_number") == quarter).select("dataset_file")
    indexed = index.select("dataset_file").distinct()
    return deals_files.join(hit, "dataset_file", "left_semi").unionByName(
        deals_files.join(indexed, "dataset_file", "left_anti")
    )


# --- price statistics ---------------------------------------------------------


def stat_parts(price: Column, area: Column) -> list[Column]:
    """Sums that merge: aggregate these by anything, then merge or finish."""
    priced = price > 0
    sized = priced & (area > 0)
    return [
        F.count("*").alias("n"),
        F.count_if(priced).alias("n_priced"),
        F.min(F.when(priced, price)).alias("p_min"),
        F.max(F.when(priced, price)).alias("p_max"),
        F.sum(F.when(priced, price)).alias("p_sum"),
        F.sum(F.when(sized, price)).alias("pa_sum"),
        F.sum(F.when(sized, area)).alias("a_sum"),
    ]


def merge_parts() -> list[Column]:
    return [
        F.sum("n").alias("n"),
        F.sum("n_priced").alias("n_priced"),
        F.min("p_min").alias("p_min"),
        F.max("p_max").alias("p_max"),
        F.sum("p_sum").alias("p_sum"),
        F.sum("pa_sum").alias("pa_sum"),
        F.sum("a_sum").alias("a_sum"),
    ]


def finish_stats() -> list[Column]:
    """Figures from merged parts; averages round half up, zero rows give null."""
    d = lambda c: F.col(c).cast("double")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    n_priced = F.coalesce(F.col("n_priced"), F.lit(0)).cast("bigint")
    return [
        n.alias("deals"),
        n_priced.alias("with_price"),
        d("p_min").alias("price_min"),
        d("p_max").alias("price_max"),
        round_half_up(F.try_divide(d("p_sum"), d("n_priced"))).alias("price_avg"),
        round_half_up(d("p_sum")).cast("bigint").alias("price_sum"),
        round_half_up(F.try_divide(d("pa_sum"), d("a_sum"))).alias("unit_price_avg"),
    ]


def price_stats(deals: DataFrame, price: str = "deal_price", area: str = "area") -> DataFrame:
    """Statistics over all rows."""
    return deals.agg(*stat_parts(F.col(price), F.col(area).cast("decimal(24,6)"))).select(*finish_stats())


def price_stats_by_category(
    deals: DataFrame,
    price: str = "deal_price",
    area: str = "area",
    category: str = "category",
    categories: Iterable[str] = CATEGORIES,
) -> DataFrame:
    """Statistics per category and overall (``category`` = 'all'), with a zero
    row for categories without deals.

    One pass: rows collapse to one line of sums per category (map side first),
    and only those few lines are rolled up.
    """
    parts = deals.groupBy(F.coalesce(F.col(category), F.lit("nonres")).alias("category")).agg(
        *stat_parts(F.col(price), F.col(area).cast("decimal(24,6)"))
    )
    return rolled_up_stats(parts, categories)


def rolled_up_stats(parts: DataFrame, categories: Iterable[str]) -> DataFrame:
    """Category lines of :func:`stat_parts` plus their total, zero-filled."""
    names = [*categories, "all"]
    totals = parts.rollup("category").agg(*merge_parts(), F.grouping("category").alias("is_total"))
    named = totals.withColumn(
        "category", F.when(F.col("is_total") == 1, F.lit("all")).otherwise(F.col("category"))
    )
    dim = label_table(parts.sparkSession, "category", *[(n,) for n in names])
    return dim.join(named, "category", "left").select("category", *finish_stats())


def counts_by_key(deals: DataFrame, key: str = "quarter_cad_number") -> DataFrame:
    return deals.groupBy(key).count()


def union_periods(*frames: DataFrame) -> DataFrame:
    """Datasets of several periods and kinds as one."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def difference(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows of ``current`` that ``previous`` does not hold, copies counted."""
    return current.exceptAll(previous)
