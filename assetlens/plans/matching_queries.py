"""Matching, reconciliation, HTML and geometry operators on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as addr
from ..functions import geo
from ..functions.text import extract, squeeze, strip_tags
from ..operators import matching, registry
from ..sources import html, responses
from .tables import spread, table


def keep_best(spark: SparkSession, sf: str) -> DataFrame:
    """Per user and event type the event of the highest value, lowest id on a tie."""
    e = table(spark, sf, "events").select("user_id", "event_type", "value", "event_id")
    return matching.keep_best(e, ["user_id", "event_type"], [-F.col("value"), F.col("event_id")])


KEEP_BEST_SQL = """
SELECT user_id, event_type, value, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1
"""


def first_by_link(spark: SparkSession, sf: str) -> DataFrame:
    """First page per host and title, counted per host."""
    p = table(spark, sf, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
        F.lit("").alias("url"),
        extract(F.col("html"), "(?s)<title>(.*?)</title>").alias("title"),
        F.col("page_id").alias("seq"),
    )
    kept = matching.first_by_link(p, ["host"])
    return kept.groupBy("host").agg(F.count("*").alias("pages"), F.min("seq").alias("first_page"))


FIRST_BY_LINK_SQL = r"""
SELECT host, COUNT(*) AS pages, MIN(page_id) AS first_page FROM (
  SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, page_id,
         row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/]+)', 1),
           nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') ORDER BY page_id) AS r FROM pages)
WHERE r = 1 GROUP BY host
"""


def adaptive_radius(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as listings of their part, quantity as distance, steps 2/5/20."""
    found = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("object_key"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("km"),
        F.when(F.col("l_returnflag") == "A", F.lit("street")).otherwise(F.lit("region")).alias("matched_by"),
    )
    kept = matching.within_radius(found, steps=(2.0, 5.0, 20.0), km="km")
    return kept.groupBy("object_key").agg(
        F.max("radius_km").alias("radius_km"),
        F.max("near_count").alias("near_count"),
        F.count("*").alias("kept"),
        F.count_if(F.col("distance_km").isNull()).alias("unlocated"),
    )


ADAPTIVE_RADIUS_SQL = """
WITH x AS (SELECT l_partkey AS object_key, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS d,
                  l_returnflag = 'A' AS street FROM lineitem),
c AS (SELECT object_key, COUNT(*) FILTER (d <= 2) AS n2, COUNT(*) FILTER (d <= 5) AS n5, COUNT(*) FILTER (d <= 20) AS n20
      FROM x GROUP BY 1),
r AS (SELECT object_key, n2, CASE WHEN n2 >= 3 THEN 2.0 WHEN n5 >= 3 THEN 5.0 ELSE 20.0 END AS radius FROM c)
SELECT object_key, CAST(MAX(radius) AS DOUBLE) AS radius_km, MAX(n2) AS near_count, COUNT(*) AS kept,
       COUNT(*) FILTER (d IS NULL) AS unlocated
FROM x JOIN r USING (object_key) WHERE d <= radius OR (d IS NULL AND street) GROUP BY object_key
"""


def comparables(spark: SparkSession, sf: str) -> DataFrame:
    """Per part, how many parts of its type and size cost +-30 %, and their mean."""
    part = table(spark, sf, "part").select(
        "p_partkey", "p_type", "p_size", F.col("p_retailprice").cast("decimal(18,4)").alias("price")
    )
    objects = part.select(
        "p_partkey",
        "p_type",
        "p_size",
        (F.col("price") * F.lit("0.7").cast("decimal(2,1)")).cast("decimal(18,4)").alias("low"),
        (F.col("price") * F.lit("1.3").cast("decimal(2,1)")).cast("decimal(18,4)").alias("high"),
    )
    out = matching.comparable_totals(objects, part, ["p_type", "p_size"], "low", "high", "price", 0.01)
    return out.select(
        "p_partkey",
        "comparables",
        F.round(F.col("value_sum").cast("double") / F.col("comparables"), 4).alias("mean_price"),
    )


COMPARABLES_SQL = """
WITH p AS (SELECT p_partkey, p_type, p_size, CAST(p_retailprice AS DECIMAL(18,4)) AS price FROM part)
SELECT a.p_partkey, COUNT(*) AS comparables, round(CAST(SUM(b.price) AS DOUBLE) / COUNT(*), 4) AS mean_price
FROM p a JOIN p b ON a.p_type = b.p_type AND a.p_size = b.p_size
 AND b.price BETWEEN CAST(a.price * 0.7 AS DECIMAL(18,4)) AND CAST(a.price * 1.3 AS DECIMAL(18,4)) GROUP BY 1
"""


def comparable_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Customers a supplier of the same nation compares to: balance +-2 %."""
    s = table(spark, sf, "supplier").select(
        "s_suppkey",
        F.col("s_nationkey").alias("nation"),
        F.least(F.col("s_acctbal") * 0.98, F.col("s_acctbal") * 1.02).alias("low"),
        F.greatest(F.col("s_acctbal") * 0.98, F.col("s_acctbal") * 1.02).alias("high"),
    )
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("value"))
    return matching.comparables(s, c, ["nation"], "low", "high", "value").select(
        "s_suppkey", "c_custkey", "value"
    )


COMPARABLE_PAIRS_SQL = """
SELECT s_suppkey, c_custkey, c_acctbal AS value FROM supplier JOIN customer ON s_nationkey = c_nationkey
WHERE c_acctbal BETWEEN least(s_acctbal * 0.98, s_acctbal * 1.02) AND greatest(s_acctbal * 0.98, s_acctbal * 1.02)
"""


def reconcile_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Orders against the sums of their lines as two registries."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.concat(F.lit("Order  "), F.col("o_orderpriority")).alias("address"),
        F.col("o_orderstatus").alias("object_type"),
        F.lit(None).cast("double").alias("area"),
        F.col("o_totalprice").alias("value"),
        (F.col("o_orderstatus") != "P").alias("found"),
    )
    lines = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("key"))
        .agg(
            F.concat(F.lit("ORDER "), F.max("l_returnflag")).alias("address"),
            F.max("l_linestatus").alias("object_type"),
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("area"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("value"),
            F.lit(True).alias("found"),
        )
    )
    out = registry.reconcile(o, lines)
    return out.groupBy("status", "matched", "total", "summary").agg(F.count("*").alias("objects")).select(
        "status", F.col("matched").cast("bigint").alias("matched"), F.col("total").cast("bigint").alias("total"), "summary", "objects"
    )


RECONCILE_SQL = """
WITH l AS (SELECT l_orderkey AS key, 'order ' || lower(MAX(l_returnflag)) AS addr, lower(MAX(l_linestatus)) AS typ,
                  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem GROUP BY 1),
j AS (SELECT o_orderstatus <> 'P' AND l.key IS NOT NULL AS two,
  contains('order ' || lower(o_orderpriority), addr) OR contains(addr, 'order ' || lower(o_orderpriority)) AS a,
  abs(o_totalprice - value) < 1 AS v, contains(lower(o_orderstatus), typ) OR contains(typ, lower(o_orderstatus)) AS t
  FROM orders FULL JOIN l ON l.key = o_orderkey),
m AS (SELECT CASE WHEN two THEN a::INT + v::INT + t::INT ELSE 0 END AS matched, CASE WHEN two THEN 3 ELSE 0 END AS total
      FROM (SELECT COALESCE(two, FALSE) AS two, a, v, t FROM j))
SELECT CASE WHEN total = 0 THEN 'partial' WHEN matched < total THEN 'warning' ELSE 'ok' END AS status,
  CAST(matched AS BIGINT) AS matched, CAST(total AS BIGINT) AS total,
  CASE WHEN total = 0 THEN 'Недостаточно данных для сверки'
       WHEN matched = total THEN 'Данные реестров совпадают (' || matched || '/' || total || ')'
       ELSE 'Есть расхождения: совпало ' || matched || ' из ' || total END AS summary,
  COUNT(*) AS objects FROM m GROUP BY matched, total
"""


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Order numbers that stand in document texts."""
    return matching.token_mentions(
        spread(table(spark, sf, "documents")), "doc_id", "text", table(spark, sf, "orders"), "o_orderkey"
    ).select("doc_id", "token")


MENTIONS_SQL = """
SELECT doc_id, token FROM (SELECT DISTINCT doc_id, UNNEST(regexp_extract_all(text, '[0-9]+')) AS token FROM documents)
WHERE token IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders)
"""


def token_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items per document by distinct shared words of 4+ letters.

    Words that stand in a document are joined by word, so only pairs sharing
    one are formed, and all of those are returned.
    """
    words = lambda c: F.array_distinct(addr.word_tokens(c, min_len=4))
    d = spread(table(spark, sf, "documents")).select("doc_id", F.explode(words(F.col("text"))).alias("w"))
    b = table(spark, sf, "benchmark").select("item_id", F.explode(words(F.col("text"))).alias("w"))
    return d.join(b, "w").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


TOKEN_RELEVANCE_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, UNNEST(regexp_extract_all(lower(text), '[\p{L}\p{N}]{4,}')) AS w FROM documents),
b AS (SELECT DISTINCT item_id, UNNEST(regexp_extract_all(lower(text), '[\p{L}\p{N}]{4,}')) AS w FROM benchmark),
s AS (SELECT doc_id, item_id, COUNT(*) AS shared FROM d JOIN b USING (w) GROUP BY 1, 2)
SELECT doc_id, item_id, shared FROM s
"""

_LINK = '<li><a href="([^"]+)">(.*?)</a></li>'


def html_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Navigation items of every page as rows."""
    p = table(spark, sf, "pages")
    items = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(0))).alias("seq", "item"))
    return items.select(
        "page_id",
        F.col("seq").cast("bigint").alias("seq"),
        F.regexp_extract("item", _LINK, 1).alias("href"),
        strip_tags(F.regexp_extract("item", _LINK, 2)).alias("label"),
    )


HTML_ROWS_SQL = f"""
WITH i AS (SELECT page_id, UNNEST(l) AS item, UNNEST(range(len(l))) AS seq
  FROM (SELECT page_id, regexp_extract_all(html, '{_LINK}') AS l FROM pages))
SELECT page_id, CAST(seq AS BIGINT) AS seq, regexp_extract(item, '{_LINK}', 1) AS href,
  trim(regexp_replace(replace(replace(regexp_replace(regexp_extract(item, '{_LINK}', 2), '<[^>]+>', ' ', 'g'),
    '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\n]+', ' ', 'g')) AS label FROM i
"""


def html_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Title, heading, language, number of paragraphs and prose size per page."""
    h = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id",
        squeeze(F.regexp_replace(extract(h, "(?s)<title>(.*?)</title>"), "&amp;", "&")).alias("title"),
        extract(h, '<html lang="([a-z]+)"').alias("lang"),
        F.regexp_count(h, F.lit("<p>")).cast("bigint").alias("paragraphs"),
        F.length(squeeze(F.regexp_replace(F.regexp_extract(h, "(?s)<article>(.*?)</article>", 1), "<[^>]+>", " "))).cast("bigint").alias("prose_chars"),
    )


HTML_CARDS_SQL = r"""
SELECT page_id, trim(regexp_replace(replace(nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ''), '&amp;', '&'), '\s+', ' ', 'g')) AS title,
  nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang,
  CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs,
  CAST(length(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS BIGINT) AS prose_chars
FROM pages
"""


def out_links(spark: SparkSession, sf: str) -> DataFrame:
    """Per page the first link to an absolute address, else its canonical host."""
    h = F.col("html")
    link = F.coalesce(extract(h, '(?s)<article>.{0,400}?href="(https?://[^"]+)"'), extract(h, 'href="(https?://[^"]*)"'))
    return table(spark, sf, "pages").select(
        "page_id",
        link.alias("link"),
        F.parse_url("url", F.lit("HOST")).alias("host"),
    )


OUT_LINKS_SQL = r"""
SELECT page_id, COALESCE(nullif(regexp_extract(html, '(?s)<article>.{0,400}?href="(https?://[^"]+)"', 1), ''),
                         nullif(regexp_extract(html, 'href="(https?://[^"]*)"', 1), '')) AS link,
  regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages
"""


def geo_points(spark: SparkSession, sf: str) -> DataFrame:
    """Metres to degrees, then centroid, box and bearing per order."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", (F.col("l_extendedprice") * 40).alias("x"), (F.col("l_partkey") * 37.0 + 5000000).alias("y")
    )
    # area mean over vertices in degrees; the vertex table form of the centroid
    deg = li.select("l_orderkey", geo.mercator_lon(F.col("x")).alias("lon"), geo.mercator_lat(F.col("y")).alias("lat"))
    lon, lat = (F.round(c, 6).cast("decimal(18,6)") for c in ("lon", "lat"))
    mean = lambda c: F.floor(F.sum(c).cast("double") / F.count("*") * 1e5 + 0.5) / 1e5
    box = deg.groupBy("l_orderkey").agg(
        mean(lon).alias("lon"),
        mean(lat).alias("lat"),
        F.round(F.min("lon"), 6).alias("min_lon"),
        F.round(F.max("lat"), 6).alias("max_lat"),
    )
    moved = geo.offset_point(F.col("lat"), F.col("lon"), F.lit(45.0), F.lit(1000.0))
    return box.select(
        "*",
        F.round(moved["lat"], 6).alias("moved_lat"),
        F.round(geo.bearing(F.col("lat"), F.col("lon"), F.lit(55.75), F.lit(37.62)), 4).alias("bearing"),
    )


GEO_SQL = """
WITH d AS (SELECT l_orderkey, l_extendedprice * 40 / 20037508.34 * 180.0 AS lon,
                  atan(sinh((l_partkey * 37.0 + 5000000)::DOUBLE / 20037508.34 * pi())) * 180.0 / pi() AS lat FROM lineitem),
b AS (SELECT l_orderkey, floor(CAST(SUM(CAST(round(lon, 6) AS DECIMAL(18,6))) AS DOUBLE) / COUNT(*) * 1e5 + 0.5) / 1e5 AS lon,
             floor(CAST(SUM(CAST(round(lat, 6) AS DECIMAL(18,6))) AS DOUBLE) / COUNT(*) * 1e5 + 0.5) / 1e5 AS lat,
             round(MIN(lon), 6) AS min_lon, round(MAX(lat), 6) AS max_lat FROM d GROUP BY 1)
SELECT *, round(lat + degrees(1000.0 * cos(radians(45.0)) / 6371000.0), 6) AS moved_lat,
  round(degrees(atan2(sin(radians(37.62 - lon)) * cos(radians(55.75)),
    cos(radians(lat)) * sin(radians(55.75)) - sin(radians(lat)) * cos(radians(55.75)) * cos(radians(37.62 - lon)))), 4) AS bearing
FROM b
"""


def envelope_status(spark: SparkSession, sf: str) -> DataFrame:
    """Responses with three outcomes: props of events, some made unusable."""
    k = F.col("event_id")
    body = (
        F.when(k % 7 == 0, F.lit("OK"))
        .when(k % 7 == 1, F.lit("  "))
        .when(k % 7 == 2, F.concat(F.col("props"), F.lit("x")))
        .when(k % 7 == 3, F.lit('{"code": 204}'))
        .when(k % 7 == 4, F.concat(F.lit('{"data": {"type": "FeatureCollection", "features": ['), F.col("props"), F.lit("]}}")))
        .when(k % 7 == 5, F.lit('{"data": {"type": "FeatureCollection", "features": []}}'))
        .otherwise(F.col("props"))
    )
    status = F.when(k % 7 == 3, F.lit(404)).otherwise(F.lit(200))
    e = table(spark, sf, "events").select("event_type", body.alias("body"), status.alias("http"))
    return (
        e.select("event_type", responses.outcome(F.col("body"), F.col("http")).alias("outcome"))
        .groupBy("event_type", "outcome")
        .agg(F.count("*").alias("n"))
    )


ENVELOPE_SQL = """
SELECT event_type, CASE WHEN event_id % 7 = 3 OR event_id % 7 = 5 THEN 'not found' WHEN event_id % 7 = 4 THEN 'found'
  ELSE 'broken' END AS outcome, COUNT(*) AS n FROM events GROUP BY 1, 2
"""


def related_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of each supplier; the earliest line's flag names the group."""
    li = table(spark, sf, "lineitem")
    pairs = li.select(
        "l_suppkey", "l_partkey", "l_returnflag", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag").alias("ord")
    )
    out = responses.first_group(pairs, "l_suppkey", "l_partkey", "l_returnflag", "ord")
    return out.select(F.col("key").alias("l_suppkey"), F.col("related_key").alias("l_partkey"), F.col("group").alias("first_group"))


RELATED_SQL = """
SELECT l_suppkey, l_partkey, l_returnflag AS first_group FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_returnflag) = 1
"""


def fallback_points(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without a point take that of their nation, flagged."""
    c = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    objects = c.select(
        "c_custkey",
        F.col("n_name").alias("address"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") / 100).alias("lon"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") / 200).alias("lat"),
    )
    gazetteer = table(spark, sf, "nation").where("n_nationkey <> 5").select(
        F.col("n_name").alias("address"),
        (F.col("n_nationkey") * 1.5).cast("double").alias("lon"),
        (F.col("n_nationkey") * 2.5).cast("double").alias("lat"),
    )
    out = matching.with_fallback_point(objects, gazetteer, "address", "lon", "lat")
    return out.select("c_custkey", "address", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "approximate")


FALLBACK_POINTS_SQL = """
SELECT c_custkey, n_name AS address,
  round(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal / 100 WHEN n_nationkey <> 5 THEN CAST(n_nationkey * 1.5 AS DOUBLE) END, 6) AS lon,
  round(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal / 200 WHEN n_nationkey <> 5 THEN CAST(n_nationkey * 2.5 AS DOUBLE) END, 6) AS lat,
  c_custkey % 3 = 0 AND n_nationkey <> 5 AS approximate
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""


def source_counts(spark: SparkSession, sf: str) -> DataFrame:
    return matching.counts_by_source(table(spark, sf, "documents"))


SOURCE_COUNTS_SQL = "SELECT source, COUNT(*) AS listings FROM documents GROUP BY source"

def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Link to the original listing on every page, two search links and the map link of its place."""
    p = table(spark, sf, "pages")
    n = F.col("page_id") % 4
    url = F.concat(F.lit("https://x.example/"), F.col("page_id").cast("string"))
    listed = F.concat(F.lit("https://www.cian.ru/"), F.col("page_id").cast("string"))
    mark = (
        F.when(n == 0, F.concat(F.lit('<b>Ссылка на объявление</b> <a href="'), url, F.lit('">')))
        .when(n == 1, F.concat(F.lit('<a href="'), listed, F.lit('">')))
        .when(n == 2, F.concat(F.lit('<a href="'), listed, F.lit('">Ссылка на объявление: <a href="'), url, F.lit('">')))
        .otherwise(F.lit(""))
    )
    lat = F.when(n != 3, F.lit(55.5))
    return p.select(
        "page_id",
        html.outbound_link(F.concat(F.coalesce("html", F.lit("")), mark)).alias("link"),
        addr.search_link("https://list.example/land", F.lit("Perm region"), F.when(n != 1, F.col("page_id").cast("string"))).alias("search"),
        geo.map_link("https://maps.example/?layer=x", F.concat(F.lit("59:01:"), F.col("page_id").cast("string")), lat, F.lit(56.25)).alias("map"),
    )


PAGE_LINKS_SQL = """
SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'https://www.cian.ru/' || page_id WHEN 3 THEN NULL ELSE 'https://x.example/' || page_id END AS link,
  'https://list.example/land?region=Perm+region' || CASE WHEN page_id % 4 <> 1 THEN '&location=' || page_id ELSE '' END AS search,
  'https://maps.example/?layer=x' || CASE WHEN page_id % 4 <> 3 THEN '&zoom=18&lat=55.5&lon=56.25' ELSE '' END || '&cadastralNumber=59%3A01%3A' || page_id AS map
FROM pages
"""

QUERIES = {
    "page_links": page_links,
    "keep_best": keep_best,
    "first_by_link": first_by_link,
    "adaptive_radius": adaptive_radius,
    "comparables": comparables,
    "comparable_pairs": comparable_pairs,
    "reconcile_totals": reconcile_totals,
    "mentions": mentions,
    "token_relevance": token_relevance,
    "html_rows": html_rows,
    "html_cards": html_cards,
    "out_links": out_links,
    "geo_points": geo_points,
    "envelope_status": envelope_status,
    "related_objects": related_objects,
    "fallback_points": fallback_points,
    "source_counts": source_counts,
}
ORACLES = {
    "page_links": PAGE_LINKS_SQL,
    "keep_best": KEEP_BEST_SQL,
    "first_by_link": FIRST_BY_LINK_SQL,
    "adaptive_radius": ADAPTIVE_RADIUS_SQL,
    "comparables": COMPARABLES_SQL,
    "comparable_pairs": COMPARABLE_PAIRS_SQL,
    "reconcile_totals": RECONCILE_SQL,
    "mentions": MENTIONS_SQL,
    "token_relevance": TOKEN_RELEVANCE_SQL,
    "html_rows": HTML_ROWS_SQL,
    "html_cards": HTML_CARDS_SQL,
    "out_links": OUT_LINKS_SQL,
    "geo_points": GEO_SQL,
    "envelope_status": ENVELOPE_SQL,
    "related_objects": RELATED_SQL,
    "fallback_points": FALLBACK_POINTS_SQL,
    "source_counts": SOURCE_COUNTS_SQL,
}
