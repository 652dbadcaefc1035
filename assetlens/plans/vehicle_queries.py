"""Identifier, decoder and multi-source operators on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import vehicles
from .tables import spread, table


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "customer")).select("c_custkey", F.substring(F.upper(F.md5("c_name")), 1, 17).alias("vin"))


_IDS_SQL = "ids AS (SELECT c_custkey, substr(upper(md5(c_name)), 1, 17) AS vin FROM customer)"
_VALUES_SQL = "translate(vin, 'ABCDEFGHJKLMNPRSTUVWXYZ', '12345678123457923456789')"
_WEIGHTS_SQL = "[8,7,6,5,4,3,2,10,0,9,8,7,6,5,4,3,2]"
_DIGIT_SQL = f"""list_sum(list_transform(range(1, 18),
  lambda i: CAST(substr({_VALUES_SQL}, i, 1) AS INT) * {_WEIGHTS_SQL}[i])) % 11"""


def id_check_digit(spark: SparkSession, sf: str) -> DataFrame:
    """Expected against actual check digit and the three sections."""
    v = F.col("vin")
    s = ids.vin_sections(v)
    return _ids(spark, sf).select(
        "c_custkey",
        ids.check_digit(v).alias("expected"),
        F.substring(v, 9, 1).alias("actual"),
        s["wmi"].alias("wmi"),
        s["vds"].alias("vds"),
        s["vis"].alias("vis"),
    )


CHECK_DIGIT_SQL = f"""
WITH {_IDS_SQL}, d AS (SELECT *, {_DIGIT_SQL} AS r FROM ids)
SELECT c_custkey, CASE WHEN r = 10 THEN 'X' ELSE CAST(CAST(r AS INT) AS VARCHAR) END AS expected, substr(vin, 9, 1) AS actual,
       substr(vin, 1, 3) AS wmi, substr(vin, 4, 6) AS vds, substr(vin, 10, 8) AS vis FROM d
"""


def _written(spark: SparkSession, sf: str) -> DataFrame:
    """The ids as people write them: lower case, dashes, I/O/Q, cut, Cyrillic."""
    k, v = F.col("c_custkey"), F.col("vin")
    raw = (
        F.when(k % 6 == 0, F.lower(v))
        .when(k % 6 == 1, F.concat(F.substring(v, 1, 8), F.lit("-"), F.substring(v, 9, 9)))
        .when(k % 6 == 2, F.concat(F.lit("O"), F.substring(v, 2, 16)))
        .when(k % 6 == 3, F.substring(v, 1, 15))
        .when(k % 6 == 4, F.translate(v, "ABCE", "АВСЕ"))
        .otherwise(v)
    )
    return _ids(spark, sf).select("c_custkey", raw.alias("raw"))


def id_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Tally of structure and spelling issues over all ids."""
    return vehicles.issue_tally(vehicles.vin_report(_written(spark, sf), "raw"))


ID_ISSUES_SQL = f"""
WITH {_IDS_SQL},
w AS (SELECT c_custkey % 6 AS m, vin, CASE c_custkey % 6 WHEN 2 THEN 'O' || substr(vin, 2, 16)
        WHEN 3 THEN substr(vin, 1, 15) ELSE vin END AS n FROM ids),
d AS (SELECT m, vin, n, {_DIGIT_SQL} AS r FROM w),
i AS (
  SELECT 'lowercase' AS code FROM d WHERE m = 0 AND lower(vin) <> vin
  UNION ALL SELECT 'separators' FROM d WHERE m = 1
  UNION ALL SELECT 'forbidden_char' FROM d WHERE m = 2
  UNION ALL SELECT 'forbidden_letter' FROM d WHERE m = 2
  UNION ALL SELECT 'suggestion' FROM d WHERE m = 2
  UNION ALL SELECT 'wrong_length' FROM d WHERE m = 3
  UNION ALL SELECT 'cyrillic' FROM d WHERE m = 4 AND regexp_matches(vin, '[ABCE]')
  UNION ALL SELECT 'check_digit' FROM d WHERE m NOT IN (2, 3)
    AND substr(n, 9, 1) <> CASE WHEN r = 10 THEN 'X' ELSE CAST(CAST(r AS INT) AS VARCHAR) END)
SELECT code, COUNT(*) AS issues FROM i GROUP BY code
"""


def confusable_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Mistyped ids and the known id each most likely stands for."""
    known = _ids(spark, sf)
    k, v = F.col("c_custkey"), F.col("vin")
    asked = known.select(
        F.when(k % 3 == 0, F.concat(F.translate(F.substring(v, 1, 2), "B50", "805"), F.substring(v, 3, 15)))
        .when(k % 3 == 1, F.concat(F.substring(v, 1, 15), F.translate(F.substring(v, 16, 2), "698B", "96B8")))
        .otherwise(v)
        .alias("vin")
    )
    return vehicles.best_correction(vehicles.confusable(asked, known)).select(
        "vin", "candidate", F.col("steps").cast("bigint").alias("steps"), F.col("changed").cast("bigint").alias("changed"), "candidates"
    )


CONFUSABLE_SQL = f"""
WITH {_IDS_SQL},
a AS (SELECT DISTINCT CASE c_custkey % 3
   WHEN 0 THEN translate(substr(vin, 1, 2), 'B50', '805') || substr(vin, 3, 15)
   WHEN 1 THEN substr(vin, 1, 15) || translate(substr(vin, 16, 2), '698B', '96B8') ELSE vin END AS vin FROM ids),
k AS (SELECT DISTINCT vin AS candidate FROM ids),
p AS (SELECT vin, candidate,
   list_sum(list_transform(range(1, 18), lambda i: CASE WHEN substr(vin, i, 1) = substr(candidate, i, 1) THEN 0 ELSE 1 END)) AS changed
   FROM a JOIN k ON translate(vin, 'BHMRW90Z', '8NNPV652') = translate(candidate, 'BHMRW90Z', '8NNPV652'))
SELECT vin, candidate, CAST(changed AS BIGINT) AS steps, CAST(changed AS BIGINT) AS changed,
       COUNT(*) OVER (PARTITION BY vin) AS candidates
FROM p WHERE changed BETWEEN 1 AND 3
QUALIFY row_number() OVER (PARTITION BY vin ORDER BY changed, candidate) = 1
"""


def _three_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as seen by three sources with different holes."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    hole = lambda m, r, x: F.when(k % m != r, x)

    def source(name, priority, make, model, year, extra, error):
        return c.select(
            k.cast("string").alias("query_key"),
            F.lit(name).alias("source"),
            F.lit(priority).alias("priority"),
            make.alias("make"),
            model.alias("model"),
            year.alias("model_year"),
            F.lit(None).cast("string").alias("vehicle_type"),
            extra.alias("extra"),
            (make.isNotNull() | model.isNotNull()).alias("found"),
            F.when(make.isNull() & model.isNull(), error).alias("lookup_error"),
        )

    seg, name, nat = F.col("c_mktsegment"), F.col("c_name"), F.col("c_nationkey").cast("string")
    m = lambda *kv: F.create_map(*kv)
    none = F.lit(None).cast("string")
    a = source(
        "a", 1, hole(2, 0, seg), F.when(k % 2 != 0, hole(3, 0, name)), none,
        m(F.lit("nation"), nat), F.when(k % 8 == 0, F.lit("HTTP 429")).otherwise(F.lit("нет данных")),
    )
    b = source(
        "b", 2, F.when(k % 4 == 2, F.concat(seg, F.lit("-b"))), none, hole(5, 0, F.lit("2020")),
        m(F.lit("nation"), F.lit("x"), F.lit("b"), k.cast("string")), F.lit("таймаут"),
    )
    d = source(
        "d", 3, F.when(k % 4 == 2, seg), F.when(k % 5 == 0, name), F.lit("1999"),
        m(F.lit("d"), nat), F.lit("пусто"),
    )
    return a.unionByName(b).unionByName(d)


_SOURCES_SQL = """
c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS query_key, c_mktsegment AS seg, c_name AS name,
             CAST(c_nationkey AS VARCHAR) AS nat FROM customer),
s AS (
  SELECT k, query_key, nat, 'a' AS source, 1 AS priority, CASE WHEN k % 2 <> 0 THEN seg END AS make,
         CASE WHEN k % 2 <> 0 AND k % 3 <> 0 THEN name END AS model, NULL AS model_year,
         CASE WHEN k % 8 = 0 THEN 'HTTP 429' ELSE 'нет данных' END AS err FROM c
  UNION ALL SELECT k, query_key, nat, 'b', 2, CASE WHEN k % 4 = 2 THEN seg || '-b' END, NULL,
         CASE WHEN k % 5 <> 0 THEN '2020' END, 'таймаут' FROM c
  UNION ALL SELECT k, query_key, nat, 'd', 3, CASE WHEN k % 4 = 2 THEN seg END, CASE WHEN k % 5 = 0 THEN name END, '1999', 'пусто' FROM c)
"""


def merge_sources(spark: SparkSession, sf: str) -> DataFrame:
    fields = ("make", "model", "model_year")
    out = vehicles.merge_sources(_three_sources(spark, sf), fields)
    return out.select(
        "query_key", *fields, "found", "source", F.array_join("sources_used", ",").alias("sources_used"),
        F.try_element_at("extra", F.lit("nation")).alias("nation"),
        F.try_element_at("extra", F.lit("b")).alias("extra_b"), "lookup_error",
    )


MERGE_SQL = f"""
WITH {_SOURCES_SQL}
SELECT query_key, arg_min(make, priority) FILTER (make IS NOT NULL) AS make,
  arg_min(model, priority) FILTER (model IS NOT NULL) AS model,
  arg_min(model_year, priority) FILTER (model_year IS NOT NULL) AS model_year,
  bool_or(make IS NOT NULL OR model IS NOT NULL) AS found,
  COALESCE(arg_min(source, priority) FILTER (make IS NOT NULL OR model IS NOT NULL), 'a') AS source,
  'a,b,d' AS sources_used, MIN(nat) AS nation, query_key AS extra_b,
  CASE WHEN NOT bool_or(make IS NOT NULL OR model IS NOT NULL) THEN MIN(err) FILTER (source = 'a') END AS lookup_error
FROM s GROUP BY query_key
"""


def source_waterfall(spark: SparkSession, sf: str) -> DataFrame:
    rows = _three_sources(spark, sf).withColumn(
        "model_year", F.when(F.col("make").isNotNull() | F.col("model").isNotNull(), F.col("model_year"))
    )
    return vehicles.waterfall(rows).select("query_key", "source", "make", "model", "model_year", "found", "lookup_error")


WATERFALL_SQL = f"""
WITH {_SOURCES_SQL},
x AS (SELECT *, make IS NOT NULL OR model IS NOT NULL AS data FROM s),
r AS (SELECT *, CASE WHEN data THEN 0 WHEN contains(err, '429') THEN 100 WHEN err = 'таймаут' THEN 200 ELSE 300 END
        + CASE WHEN data OR contains(err, '429') OR err = 'таймаут' THEN priority ELSE 10 - priority END AS o FROM x)
SELECT query_key, source, make, model, CASE WHEN data THEN model_year END AS model_year, data AS found,
  CASE WHEN NOT data THEN err END AS lookup_error
FROM r QUALIFY row_number() OVER (PARTITION BY query_key ORDER BY o) = 1
"""


def batch_report(spark: SparkSession, sf: str) -> DataFrame:
    return vehicles.batch_report(vehicles.waterfall(_three_sources(spark, sf).drop("model_year").withColumn("model_year", F.lit(None).cast("string"))))


BATCH_SQL = """
SELECT COUNT(*) AS total, COUNT(*) FILTER (f) AS found, COUNT(*) FILTER (NOT f) AS not_found
FROM (SELECT c_custkey % 2 <> 0 OR c_custkey % 4 = 2 OR c_custkey % 5 = 0 AS f FROM customer)
"""


def eav_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Last value of each event type per user as columns."""
    names = {t: f"last_{t}" for t in ("view", "signup", "click", "error", "purchase")}
    return vehicles.last_values(table(spark, sf, "events"), "user_id", "event_type", "value", "event_id", names)


EAV_SQL = """
SELECT user_id, """ + ", ".join(
    f"arg_max(value, event_id) FILTER (event_type = '{t}') AS last_{t}" for t in ("view", "signup", "click", "error", "purchase")
) + " FROM events GROUP BY user_id"


def ttl_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Latest purchase or click per user, if not older than five hours at the
    table's end."""
    e = table(spark, sf, "events").withColumn("found", F.col("event_type").isin("purchase", "click"))
    now = e.agg(F.max("ts")).scalar()
    out = vehicles.fresh_cache(e.select("user_id", "event_id", "ts", "found"), "user_id", "ts", now, 5 * 3600)
    return out.select("user_id", "event_id")


TTL_SQL = """
SELECT user_id, event_id FROM (
  SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events
  WHERE event_type IN ('purchase', 'click'))
WHERE r = 1 AND ts + INTERVAL 5 HOUR >= (SELECT MAX(ts) FROM events)
"""


def router(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of ids, plates and comments to one row per asked number."""
    k = F.col("c_custkey")
    plate = F.concat(F.lit("a"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("Bc77 rus"))
    line = (
        F.when(k % 4 == 0, plate)
        .when(k % 4 == 1, F.concat(F.lit("# "), F.col("vin")))
        .when(k % 4 == 2, F.concat(F.col("vin"), F.lit("; ,"), F.reverse("vin")))
        .otherwise(F.concat(F.lit("  "), F.col("vin"), F.lit(" ")))
    )
    lines = _ids(spark, sf).select("c_custkey", line.alias("line"))
    return vehicles.route_queries(lines, "line", "c_custkey").select(
        "c_custkey", F.col("pos").cast("bigint").alias("pos"), "query", "kind"
    )


ROUTER_SQL = f"""
WITH {_IDS_SQL}
SELECT c_custkey, CAST(0 AS BIGINT) AS pos, 'А' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || 'ВС77' AS query, 'plate' AS kind
FROM ids WHERE c_custkey % 4 = 0
UNION ALL SELECT c_custkey, 0, vin, 'vin' FROM ids WHERE c_custkey % 4 IN (2, 3)
UNION ALL SELECT c_custkey, 1, reverse(vin), 'vin' FROM ids WHERE c_custkey % 4 = 2
"""

QUERIES = {
    "id_check_digit": id_check_digit,
    "id_issues": id_issues,
    "confusable_ids": confusable_ids,
    "merge_sources": merge_sources,
    "source_waterfall": source_waterfall,
    "batch_report": batch_report,
    "eav_pivot": eav_pivot,
    "ttl_latest": ttl_latest,
    "router": router,
}
ORACLES = {
    "id_check_digit": CHECK_DIGIT_SQL,
    "id_issues": ID_ISSUES_SQL,
    "confusable_ids": CONFUSABLE_SQL,
    "merge_sources": MERGE_SQL,
    "source_waterfall": WATERFALL_SQL,
    "batch_report": BATCH_SQL,
    "eav_pivot": EAV_SQL,
    "ttl_latest": TTL_SQL,
    "router": ROUTER_SQL,
}
