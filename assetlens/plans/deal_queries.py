"""Deal-analytics operators on the shared tables.

Price is l_extendedprice, area is l_quantity, the category follows from p_type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, ids, numbers
from ..operators import classifier, deals
from ..sources import deal_files
from .tables import spread, table

# fixed values: which deal category stands for which part type
PART_CATEGORY = {
    "ECONOMY": "flat",
    "STANDARD": "house",
    "PROMO": "nonres",
    "LARGE": "land",
    "MEDIUM": "land",
}


def _category(part_type):
    expr = F.lit("nonres")
    for name, category in PART_CATEGORY.items():
        expr = F.when(part_type == name, F.lit(category)).otherwise(expr)
    return expr


def _category_sql(column: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PART_CATEGORY.items())
    return f"CASE {column} {arms} ELSE 'nonres' END"


def unit_price_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: price statistics overall and per category, zero-filled.

    Line items collapse to one row of sums per part before anything else moves,
    so a part that holds a third of all lines arrives as one row per map task,
    and the join to ``part`` reuses that partitioning.
    """
    line = table(spark, sf, "lineitem").select(
        "l_partkey",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.col("l_quantity").cast("decimal(18,2)").alias("area"),
    )
    per_part = line.groupBy("l_partkey").agg(*deals.stat_parts(F.col("price"), F.col("area")))
    part = table(spark, sf, "part").select("p_partkey", _category(F.col("p_type")).alias("category"))
    per_category = (
        per_part.join(part, per_part.l_partkey == part.p_partkey).groupBy("category").agg(*deals.merge_parts())
    )
    return deals.rolled_up_stats(per_category, classifier.CATEGORIES)


UNIT_PRICE_SQL = f"""
WITH x AS (
  SELECT {_category_sql('p_type')} AS category,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_quantity AS DECIMAL(18,2)) AS area
  FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (
  SELECT COALESCE(category, 'all') AS category, COUNT(*) AS n, COUNT(*) FILTER (price > 0) AS np,
         MIN(price) FILTER (price > 0) AS lo, MAX(price) FILTER (price > 0) AS hi,
         SUM(price) FILTER (price > 0) AS ps,
         SUM(price) FILTER (price > 0 AND area > 0) AS pas, SUM(area) FILTER (price > 0 AND area > 0) AS ars
  FROM x GROUP BY GROUPING SETS ((), (category))),
d(category) AS (VALUES ('land'), ('house'), ('nonres'), ('flat'), ('parking'), ('all'))
SELECT d.category, CAST(COALESCE(n, 0) AS BIGINT) AS deals, CAST(COALESCE(np, 0) AS BIGINT) AS with_price,
       CAST(lo AS DOUBLE) AS price_min, CAST(hi AS DOUBLE) AS price_max,
       CAST(floor(CAST(ps AS DOUBLE) / np + 0.5) AS BIGINT) AS price_avg,
       CAST(floor(CAST(ps AS DOUBLE) + 0.5) AS BIGINT) AS price_sum,
       CAST(floor(CAST(pas AS DOUBLE) / CAST(ars AS DOUBLE) + 0.5) AS BIGINT) AS unit_price_avg
FROM d LEFT JOIN s ON d.category = s.category
"""


def key_lookup_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Search by key and year: dearest 100 rows, with totals over the full match.

    The key is the part with the most lines in the table.
    """
    line = table(spark, sf, "lineitem").select(
        "l_partkey",
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("deal_price"),
        F.year("l_shipdate").alias("year"),
        (F.year("l_shipdate") * 100 + F.quarter("l_shipdate")).alias("sort_key"),
    )
    busiest = (
        line.groupBy("l_partkey").count().agg(F.max_by("l_partkey", F.struct("count", -F.col("l_partkey"))).alias("k"))
    )
    hits = line.where((F.col("l_partkey") == busiest.scalar()) & F.col("year").between(1996, 2000))
    total = hits.agg(F.count("*"))
    return (
        hits.orderBy(
            F.desc("sort_key"), F.desc("deal_price"), "l_orderkey", "l_linenumber"
        )
        .limit(100)
        .select(
            "l_partkey",
            "l_orderkey",
            F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
            F.col("sort_key").cast("bigint").alias("sort_key"),
            F.col("deal_price").cast("double").alias("deal_price"),
            total.scalar().alias("total"),
            (total.scalar() > 100).alias("truncated"),
        )
    )


KEY_LOOKUP_SQL = """
WITH x AS (
  SELECT l_partkey, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
         CAST(year(l_shipdate) * 100 + quarter(l_shipdate) AS BIGINT) AS sort_key,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS deal_price, COUNT(*) OVER () AS total
  FROM lineitem
  WHERE year(l_shipdate) BETWEEN 1996 AND 2000
    AND l_partkey = (SELECT l_partkey FROM lineitem GROUP BY l_partkey ORDER BY COUNT(*) DESC, l_partkey LIMIT 1))
SELECT l_partkey, l_orderkey, l_linenumber, sort_key, deal_price, total, total > 100 AS truncated
FROM x ORDER BY sort_key DESC, deal_price DESC, l_orderkey, l_linenumber LIMIT 100
"""


def _brand_codes(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary made of the brands with an even number, padded to twelve."""
    number = F.regexp_extract("p_brand", "([0-9]+)", 1)
    return (
        table(spark, sf, "part")
        .where(number.cast("int") % 2 == 0)
        .groupBy(F.lpad(number, 12, "0").alias("code"))
        .agg(F.min("p_brand").alias("label"))
        .withColumn("pos", F.col("code").cast("bigint"))
    )


def code_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Three-stage code look-up of every part's brand number."""
    part = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 3 == 0, F.lpad(F.regexp_extract("p_brand", "([0-9]+)", 1), 14, "0"))
        .otherwise(F.regexp_extract("p_brand", "([0-9]+)", 1))
        .alias("code"),
    )
    out = classifier.with_label(part, "code", "label", _brand_codes(spark, sf))
    return out.select("p_partkey", "code", "label")


CODE_LABELS_SQL = r"""
WITH b AS (SELECT p_partkey, p_brand, regexp_extract(p_brand, '([0-9]+)', 1) AS num FROM part),
d AS (SELECT lpad(num, 12, '0') AS code, MIN(p_brand) AS label FROM b WHERE CAST(num AS INT) % 2 = 0 GROUP BY 1),
c AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN lpad(num, 14, '0') ELSE num END AS code FROM b)
SELECT p_partkey, c.code,
       COALESCE((SELECT label FROM d WHERE d.code = c.code),
                (SELECT label FROM d WHERE d.code = CASE WHEN length(c.code) < 12 THEN lpad(c.code, 12, '0') ELSE c.code END),
                (SELECT label FROM d WHERE ltrim(d.code, '0') = ltrim(c.code, '0')), c.code) AS label
FROM c
"""


def multi_code_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Code lists (the words of p_name) to labels, order kept."""
    part = table(spark, sf, "part").select(
        "p_partkey", F.regexp_replace("p_name", " ", ";").alias("codes"), F.split("p_name", " ").alias("words")
    )
    words = (
        part.select(F.explode("words").alias("code"))
        .where(F.length("code") > 3)
        .distinct()
        .select("code", F.upper("code").alias("label"), F.lit(0).alias("pos"))
    )
    out = classifier.with_label_list(part.drop("words"), [], "codes", "labels", words)
    return out.select("p_partkey", "codes", "labels")


MULTI_CODE_SQL = """
SELECT p_partkey, replace(p_name, ' ', ';') AS codes,
       array_to_string(list_transform(string_split(p_name, ' '),
         lambda w: CASE WHEN length(w) > 3 THEN upper(w) ELSE w END), '; ') AS labels
FROM part
"""


def pruned_by_index(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of the years that a search for one customer has to scan: those
    whose index names it, and one year that has no index."""
    orders = table(spark, sf, "orders").select(
        F.year("o_orderdate").cast("string").alias("dataset_file"), F.col("o_custkey").cast("string").alias("quarter_cad_number"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("p"),
    )
    index = orders.where("dataset_file <> '1995'").select("dataset_file", "quarter_cad_number").distinct()
    files = orders.select("dataset_file").distinct()
    kept = deals.index_prunes(files, index, "7")
    return orders.join(kept, "dataset_file", "left_semi").groupBy("dataset_file").agg(F.count("*").alias("orders"), F.sum("p").cast("double").alias("total"))


PRUNED_SQL = """
SELECT CAST(year(o_orderdate) AS VARCHAR) AS dataset_file, COUNT(*) AS orders, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders WHERE year(o_orderdate) = 1995 OR year(o_orderdate) IN (SELECT year(o_orderdate) FROM orders WHERE o_custkey = 7) GROUP BY 1
"""


def deal_search(spark: SparkSession, sf: str) -> DataFrame:
    """All deals of one quarter key, kind and object type, newest and dearest
    first, with the summary's totals; words name kind and type."""
    li = table(spark, sf, "lineitem")
    typed = li.select(
        F.concat_ws(":", F.lit("77"), F.lpad((F.col("l_suppkey") % 10).cast("string"), 2, "0"), F.lit("0001005")).alias("quarter_cad_number"),
        F.year("l_shipdate").alias("year"),
        (F.year("l_shipdate") * 100 + F.quarter("l_shipdate")).alias("sort_key"),
        F.when(F.col("l_linestatus") == "O", "rent").otherwise("deal").alias("kind"),
        F.when(F.col("l_linenumber") % 2 == 0, deals.LAND).otherwise(deals.PREMISES).alias("realestate_type_code"),
        F.when(F.col("l_linenumber") % 2 == 0, "land").otherwise("nonres").alias("category"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("deal_price"),
        F.col("l_quantity").cast("decimal(18,2)").alias("area"),
        F.col("l_returnflag").alias("dataset_file"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("number"),
    )
    rows, _, summary = deals.search(typed, "77:5:0001005", year=1996, object_types=["зу"], operation_kinds=["продажа"])
    return rows.select(
        "number", F.col("sort_key").cast("bigint").alias("sort_key"), F.col("deal_price").cast("double").alias("deal_price"),
        summary.select("total").scalar().alias("total"), summary.select("truncated").scalar().alias("truncated"),
    )


DEAL_SEARCH_SQL = """
SELECT l_orderkey || '-' || l_linenumber AS number, CAST(year(l_shipdate) * 100 + quarter(l_shipdate) AS BIGINT) AS sort_key,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS deal_price, COUNT(*) OVER () AS total, false AS truncated
FROM lineitem WHERE l_suppkey % 10 = 5 AND year(l_shipdate) = 1996 AND l_linenumber % 2 = 0 AND l_linestatus <> 'O'
"""


def changed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that differ from an older copy (some prices altered, some rows gone)."""
    current = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), "o_orderstatus"
    )
    k = F.col("o_orderkey")
    previous = current.where(k % 7 != 0).withColumn(
        "price", F.when(k % 5 == 0, F.col("price") + 1).otherwise(F.col("price")).cast("decimal(18,2)")
    )
    new = deal_files.changed_files(current, previous, ["o_orderkey", "price", "o_orderstatus"])
    return new.select("o_orderkey", F.col("price").cast("double").alias("price"), "o_orderstatus")


CHANGED_SQL = """
SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price, o_orderstatus
FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0
"""


def normalised_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Cadastral keys out of noisy text, and the number dialects on prices."""
    line = spread(table(spark, sf, "lineitem"))
    raw = F.concat(
        F.lit("№ "),
        F.concat_ws(
            ":",
            F.col("l_linenumber").cast("string"),
            (F.col("l_suppkey") % 90).cast("string"),
            F.lpad((F.col("l_partkey")).cast("string"), 7, "0"),
            F.when(F.col("l_orderkey") % 4 != 0, F.col("l_orderkey").cast("string")),
        ),
        F.lit(" x"),
    )
    whole = F.floor(F.col("l_extendedprice")).cast("bigint").cast("string")
    text = (
        F.when(F.col("l_orderkey") % 3 == 0, F.concat(whole, F.lit(",50")))
        .when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit("1 "), whole))
        .otherwise(F.concat(whole, F.lit(".5.5")))
    )
    t = F.col("text")
    keyed = line.select(raw.alias("raw"), text.alias("text"))
    return (
        deals.with_keys(keyed, "raw")
        .select(
            F.col("quarter_key"),
            F.col("object_key"),
            numbers.price_number(t).alias("price_n"),
            numbers.area_number(t).alias("area_n"),
            numbers.work_number(t).alias("work_n"),
            numbers.register_number(t).alias("register_n"),
            numbers.digits_number(t).alias("digits_n"),
        )
        .groupBy("quarter_key")
        .agg(
            F.count("*").alias("n"),
            F.count("object_key").alias("full_keys"),
            F.max("object_key").alias("last_key"),
            F.max("price_n").alias("price_n"),
            F.max("area_n").alias("area_n"),
            F.max("work_n").alias("work_n"),
            F.max("register_n").alias("register_n"),
            F.max("digits_n").alias("digits_n"),
        )
    )


NORMALISED_SQL = r"""
WITH t AS (
  SELECT '№ ' || l_linenumber || ':' || (l_suppkey % 90) || ':' || lpad(CAST(l_partkey AS VARCHAR), 7, '0')
         || CASE WHEN l_orderkey % 4 <> 0 THEN ':' || l_orderkey ELSE '' END || ' x' AS raw,
         CASE l_orderkey % 3 WHEN 0 THEN CAST(floor(l_extendedprice) AS BIGINT) || ',50'
              WHEN 1 THEN '1 ' || CAST(floor(l_extendedprice) AS BIGINT)
              ELSE CAST(floor(l_extendedprice) AS BIGINT) || '.5.5' END AS text
  FROM lineitem),
p AS (SELECT list_filter(string_split(regexp_replace(raw, '[^0-9:]', '', 'g'), ':'), lambda x: x <> '') AS parts, text,
             regexp_replace(text, '[ ]', '', 'g') AS nb FROM t),
n AS (SELECT lpad(parts[1], 2, '0') || ':' || CASE WHEN length(parts[2]) < 2 THEN lpad(parts[2], 2, '0') ELSE parts[2] END
             || ':' || parts[3] AS quarter_key, parts,
             CASE WHEN regexp_matches(nb, '^[0-9]+(\.[0-9]*)?$') THEN TRY_CAST(nb AS DOUBLE) END AS price_n,
             CASE WHEN regexp_matches(regexp_replace(nb, ',', '.'), '^[0-9]+(\.[0-9]*)?$')
                  THEN TRY_CAST(regexp_replace(nb, ',', '.') AS DOUBLE) END AS area_n,
             TRY_CAST(regexp_replace(text, '[^0-9]', '', 'g') AS BIGINT) AS digits_n
      FROM p)
SELECT quarter_key, COUNT(*) AS n, COUNT(*) FILTER (len(parts) = 4) AS full_keys,
       MAX(CASE WHEN len(parts) = 4 THEN quarter_key || ':' || parts[4] END) AS last_key,
       MAX(price_n) AS price_n, MAX(area_n) AS area_n, MAX(COALESCE(area_n, 0.0)) AS work_n,
       MAX(COALESCE(area_n, 0.0)) AS register_n, MAX(digits_n) AS digits_n
FROM n GROUP BY quarter_key
"""


def period_union(spark: SparkSession, sf: str) -> DataFrame:
    """Two kinds of dataset as one, counted per period label and sort key."""

    def labelled(df, ts, kind):
        return df.select(F.lit(kind).alias("kind"), F.year(ts).alias("y"), F.quarter(ts).alias("q"))

    both = deals.union_periods(
        labelled(table(spark, sf, "events"), "ts", "rent"), labelled(table(spark, sf, "orders"), "o_orderdate", "deal")
    )
    label = dates.period_label(F.col("y"), F.col("q"))
    return (
        both.groupBy("kind", label.alias("period"))
        .agg(F.count("*").alias("rows"))
        .withColumn("period_key", dates.period_key(F.col("period")).cast("bigint"))
    )


PERIOD_UNION_SQL = """
WITH x AS (SELECT 'rent' AS kind, ts AS t FROM events UNION ALL SELECT 'deal', o_orderdate FROM orders)
SELECT kind, quarter(t) || ' кв ' || year(t) AS period, COUNT(*) AS "rows",
       CAST(year(t) * 10 + quarter(t) AS BIGINT) AS period_key
FROM x GROUP BY kind, year(t), quarter(t)
"""


def counts_and_years(spark: SparkSession, sf: str) -> DataFrame:
    """Row count per key and the years each key covers."""
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey", F.year("l_shipdate").alias("year"))
        .agg(F.count("*").alias("n"))
        .groupBy("l_suppkey")
        .agg(F.sum("n").alias("n"), F.count("*").alias("years"), F.max("year").cast("bigint").alias("last_year"))
    )


COUNTS_SQL = """
SELECT l_suppkey, COUNT(*) AS n, COUNT(DISTINCT year(l_shipdate)) AS years,
       CAST(MAX(year(l_shipdate)) AS BIGINT) AS last_year
FROM lineitem GROUP BY l_suppkey
"""

QUERIES = {
    "unit_price_by_category": unit_price_by_category,
    "key_lookup_topk": key_lookup_topk,
    "code_labels": code_labels,
    "multi_code_labels": multi_code_labels,
    "pruned_by_index": pruned_by_index,
    "deal_search": deal_search,
    "changed_rows": changed_rows,
    "normalised_keys": normalised_keys,
    "period_union": period_union,
    "counts_and_years": counts_and_years,
}
ORACLES = {
    "deal_search": DEAL_SEARCH_SQL,
    "unit_price_by_category": UNIT_PRICE_SQL,
    "key_lookup_topk": KEY_LOOKUP_SQL,
    "code_labels": CODE_LABELS_SQL,
    "multi_code_labels": MULTI_CODE_SQL,
    "pruned_by_index": PRUNED_SQL,
    "changed_rows": CHANGED_SQL,
    "normalised_keys": NORMALISED_SQL,
    "period_union": PERIOD_UNION_SQL,
    "counts_and_years": COUNTS_SQL,
}
