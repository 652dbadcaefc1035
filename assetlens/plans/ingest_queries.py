"""Reading and writing operators: text files are made from ``lineitem``, then
scanned, catalogued, gated, written as a serving table or read as a stream.

Each run uses a new folder under the cluster's shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deals, workload
from ..session import shared_dir
from ..sources import codes, deal_files, key_filters, key_sketches, snapshots
from ..streaming import ingest, latest, live
from .tables import spread, table


def _run_dir(spark: SparkSession, name: str) -> str:
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex}")


def _raw_deals(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as the 17 text columns of a deal file."""
    li = spread(table(spark, sf, "lineitem"))
    own = {
        "number": F.col("l_orderkey").cast("string"),
        "region_code": F.col("l_linenumber").cast("string"),
        "district": F.lit("a;b"),
        "city": F.col("l_returnflag"),
        "quarter_cad_number": F.concat_ws(":", F.lit("77"), F.lpad((F.col("l_suppkey") % 100).cast("string"), 2, "0"), F.lit("0001005")),
        "realestate_type_code": F.when(F.col("l_linenumber") % 2 == 0, F.lit("002001001000")).otherwise(F.lit("2001003000")),
        "purpose_code": F.when(F.col("l_linestatus") == "O", F.lit("206002000000")).otherwise(F.lit("206001000000")),
        "wall_material_code": F.concat(F.lit("10;"), F.col("l_linenumber").cast("string")),
        "area": F.translate(F.col("l_quantity").cast("decimal(18,2)").cast("string"), ".", ","),
        "deal_price": F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice").cast("decimal(18,2)").cast("string")),
        "currency": F.lit("RUB"),
    }
    return li.select(*[own.get(c, F.lit("")).alias(c) for c in deal_files.DEAL_COLUMNS], F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q"))


def _write_text(df: DataFrame, path: str, delimiter: str = "~") -> None:
    # quoted, so that an empty field is "" as in the published files
    (
        df.select(*deal_files.DEAL_COLUMNS)
        .write.option("sep", delimiter)
        .option("header", True)
        .option("quoteAll", True)
        .option("emptyValue", "")
        .option("nullValue", "")
        .csv(path)
    )


def _codes(spark: SparkSession, sf: str) -> DataFrame:
    """A small dictionary read from a JSON document, as published."""
    path = _run_dir(spark, "codes")
    labels = table(spark, sf, "lineitem").select((F.col("l_linenumber") + 0).cast("string").alias("n")).distinct()
    entries = labels.select(F.struct(F.lpad("n", 12, "0").alias("key"), F.concat(F.lit("Material "), F.col("n")).alias("value")).alias("e"))
    fixed = F.array(
        *[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (
            ("002001001000", "Земельный участок"), ("002001003000", "Помещение"), ("206002000000", "Жилое"), ("206001000000", "Нежилое"))]
    )
    # line numbers are 1..7, so the document is tiny whatever the table's size
    document = entries.agg(F.map_from_entries(F.concat(fixed, F.collect_set("e"))).alias("codes"))
    document.select(F.to_json(F.struct("codes")).alias("value")).write.text(path)
    return codes.read_code_dictionary(spark, path)


def text_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Write deal text files, scan and enrich them, statistics per category."""
    path = _run_dir(spark, "scan")
    _write_text(_raw_deals(spark, sf), path)
    scanned = deal_files.scan_deals(spark, [path])
    enriched = deals.enrich(scanned, _codes(spark, sf))
    return deals.price_stats_by_category(enriched)


TEXT_SCAN_SQL = """
WITH x AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'land' WHEN l_linestatus = 'O' THEN 'flat' ELSE 'nonres' END AS category,
   CASE WHEN l_linenumber <> 7 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS price, CAST(l_quantity AS DECIMAL(18,2)) AS area FROM lineitem),
s AS (SELECT COALESCE(category, 'all') AS category, COUNT(*) AS n, COUNT(*) FILTER (price > 0) AS np,
   MIN(price) FILTER (price > 0) AS lo, MAX(price) FILTER (price > 0) AS hi, SUM(price) FILTER (price > 0) AS ps,
   SUM(price) FILTER (price > 0 AND area > 0) AS pas, SUM(area) FILTER (price > 0 AND area > 0) AS ars
   FROM x GROUP BY GROUPING SETS ((), (category))),
d(category) AS (VALUES ('land'), ('house'), ('nonres'), ('flat'), ('parking'), ('all'))
SELECT d.category, CAST(COALESCE(n, 0) AS BIGINT) AS deals, CAST(COALESCE(np, 0) AS BIGINT) AS with_price,
  CAST(lo AS DOUBLE) AS price_min, CAST(hi AS DOUBLE) AS price_max, CAST(floor(CAST(ps AS DOUBLE) / np + 0.5) AS BIGINT) AS price_avg,
  CAST(floor(CAST(ps AS DOUBLE) + 0.5) AS BIGINT) AS price_sum,
  CAST(floor(CAST(pas AS DOUBLE) / CAST(ars AS DOUBLE) + 0.5) AS BIGINT) AS unit_price_avg
FROM d LEFT JOIN s ON d.category = s.category
"""


def code_mining(spark: SparkSession, sf: str) -> DataFrame:
    """Code/label pairs out of a book whose lines are the parts."""
    part = table(spark, sf, "part")
    text = F.concat(
        (F.col("p_partkey") + 10_000_000_000).cast("string"), F.lit("  "), F.col("p_name"), F.lit("\n tail "),
        F.lpad((F.col("p_partkey") % 7).cast("string"), 12, "2"), F.lit(" "), F.col("p_type"), F.lit(" СПРАВОЧНИК x"),
    )
    return codes.mine_codes(part.select(text.alias("text"), "p_partkey"), page="p_partkey").select("code", "label")


CODE_MINING_SQL = """
SELECT '0' || (p_partkey + 10000000000) AS code, p_name || ' tail' AS label FROM part
UNION ALL SELECT lpad(CAST(p_partkey % 7 AS VARCHAR), 12, '2'), arg_max(p_type, p_partkey) FROM part GROUP BY 1
UNION ALL SELECT * FROM (VALUES ('002001001000', 'Земельный участок'), ('002001002000', 'Здание'), ('002001003000', 'Помещение'),
 ('002001004000', 'Сооружение'), ('002001005000', 'Объект незавершенного строительства'), ('002001009000', 'Машино-место'))
"""


def quarter_index(spark: SparkSession, sf: str) -> DataFrame:
    """Index of quarter keys over written text files, with row counts."""
    path = _run_dir(spark, "index")
    _write_text(_raw_deals(spark, sf), path)
    lines = deal_files.scan_lines(spark, [path])
    index = deal_files.quarter_index(lines).select("quarter_cad_number").distinct()
    counts = deals.counts_by_key(deal_files.scan_deals(spark, [path], delimiter="~"))
    return index.join(counts, "quarter_cad_number")


QUARTER_INDEX_SQL = """
SELECT '77:' || lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0') || ':0001005' AS quarter_cad_number, COUNT(*) AS count FROM lineitem GROUP BY 1
"""


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """A listing made of the orders: one dataset per (period, customer group),
    plain text before .gz, the first folder before the second."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    name = F.concat(
        F.when(k % 2 == 0, F.lit("dataset_АРЕНДА_r-r_y_")).otherwise(F.lit("dataset_СДЕЛКИ_r-r_y_")),
        F.year("o_orderdate").cast("string"), F.lit("_q_"), F.quarter("o_orderdate").cast("string"),
        F.lit("_"), (F.col("o_custkey") % 50).cast("string"), F.lit(".csv"), F.when(k % 3 == 0, F.lit(".gz")).otherwise(F.lit("")),
    )
    rank = F.when(k % 5 == 0, 0).otherwise(1)
    listing = o.select(
        F.concat(F.lit("/landing/"), rank.cast("string"), F.lit("/"), k.cast("string"), F.lit("/"), name).alias("path"),
        (k * 10000).cast("bigint").alias("length"),
        F.col("o_orderdate").alias("modificationTime"),
        rank.alias("folder_rank"),
    )
    found = deal_files.resolve_catalogue(listing)
    return found.select(
        "dataset_file", "kind", "period_label", "period_short_label", F.col("sort_key").cast("bigint").alias("sort_key"), "path", "size_mb"
    )


CATALOGUE_SQL = """
WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS rank, o_orderkey % 3 = 0 AS gz, year(o_orderdate) AS y,
    quarter(o_orderdate) AS q, CASE WHEN o_orderkey % 2 = 0 THEN 'rent' ELSE 'deal' END AS kind,
    'dataset_' || CASE WHEN o_orderkey % 2 = 0 THEN 'АРЕНДА' ELSE 'СДЕЛКИ' END || '_r-r_y_' || year(o_orderdate) || '_q_' || quarter(o_orderdate)
      || '_' || (o_custkey % 50) || '.csv' AS dataset_file FROM orders),
p AS (SELECT *, '/landing/' || rank || '/' || k || '/' || dataset_file || CASE WHEN gz THEN '.gz' ELSE '' END AS path FROM x)
SELECT dataset_file, kind, q || ' квартал ' || y || ' года' AS period_label, q || ' кв ' || y AS period_short_label,
  CAST(y * 100 + q AS BIGINT) AS sort_key, path, round(k * 10000 / 1048576.0, 1) AS size_mb FROM p
QUALIFY row_number() OVER (PARTITION BY dataset_file ORDER BY rank, gz, path) = 1
"""


def file_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Landing verdicts over pages as files: markup, text and broken heads."""
    p = table(spark, sf, "pages")
    k = F.col("page_id")
    body = (
        F.when(k % 5 == 0, F.col("html"))
        .when(k % 5 == 1, F.concat(F.lit("a~b~c\n"), F.col("html")))
        .when(k % 5 == 2, F.lit("PK\u0003\u0004 body"))
        .when(k % 5 == 3, F.lit("%PDF-1.7"))
        .otherwise(F.concat(F.lit("no mark "), F.repeat(F.lit("x"), 2000)))
    )
    name = F.concat(
        F.when(k % 10 == 7, F.lit("~$")).otherwise(F.lit("")), k.cast("string"),
        F.when(k % 5 == 2, F.lit(".xlsx")).when(k % 5 == 3, F.lit(".pdf")).otherwise(F.lit(".csv")),
    )
    files = p.select(
        name.alias("file_name"),
        F.when(k % 5 == 2, F.lit(600)).otherwise(F.octet_length(body)).cast("bigint").alias("length"),
        F.substring(F.encode(body, "UTF-8"), 1, 200).alias("head"),
    )
    return deal_files.gate_files(files).groupBy(F.coalesce("reason", F.lit("accepted")).alias("verdict")).agg(F.count("*").alias("files"))


FILE_GATE_SQL = """
SELECT CASE WHEN page_id % 10 = 7 THEN 'temporary file'
  WHEN page_id % 5 = 0 THEN CASE WHEN strlen(html) < 1024 THEN 'too small' WHEN html[1:2] = '<!' OR html[1:5] = '<html' THEN 'html page'
       WHEN NOT contains(substr(html, 1, 200), '~') THEN 'no delimiter' ELSE 'accepted' END
  WHEN page_id % 5 = 1 THEN CASE WHEN strlen(html) + 6 < 1024 THEN 'too small' ELSE 'accepted' END
  WHEN page_id % 5 = 4 THEN 'no delimiter' ELSE 'accepted' END AS verdict, COUNT(*) AS files
FROM pages GROUP BY 1
"""


def serving_table(spark: SparkSession, sf: str) -> DataFrame:
    """Write the serving table, then search it by key and year."""
    path = _run_dir(spark, "serving")
    li = table(spark, sf, "lineitem")
    typed = li.select(
        F.col("l_suppkey").cast("string").alias("quarter_cad_number"),
        F.year("l_shipdate").alias("year"),
        (F.year("l_shipdate") * 100 + F.quarter("l_shipdate")).alias("sort_key"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("deal_price"),
    )
    deal_files.write_serving_table(typed, path)
    stored = spark.read.parquet(path).where(deals.matching(quarter="7"))
    return stored.groupBy("year", "sort_key").agg(F.count("*").alias("deals"), F.max("deal_price").cast("double").alias("dearest")).select(
        F.col("year").cast("bigint").alias("year"), F.col("sort_key").cast("bigint").alias("sort_key"), "deals", "dearest"
    )


SERVING_SQL = """
SELECT CAST(year(l_shipdate) AS BIGINT) AS year, CAST(year(l_shipdate) * 100 + quarter(l_shipdate) AS BIGINT) AS sort_key, COUNT(*) AS deals,
  CAST(MAX(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS dearest FROM lineitem WHERE l_suppkey = 7 GROUP BY 1, 2
"""


def json_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Results as JSON lines and back."""
    path = _run_dir(spark, "json")
    cols = "c_custkey bigint, c_name string, c_nationkey int"
    deal_files.write_json_lines(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), path)
    back = spark.read.schema(cols).json(path)
    return deal_files.as_json(back.select("c_custkey", "c_name")).withColumn("n", F.length("document").cast("bigint"))


JSON_SQL = """
SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' AS document,
  CAST(length('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') AS BIGINT) AS n FROM customer
"""


def ingest_available_now(spark: SparkSession, sf: str) -> DataFrame:
    """The line items as a file stream to Parquet; a second run adds nothing."""
    base = _run_dir(spark, "ingest")
    source = table(spark, sf, "lineitem")
    for _ in range(2):
        stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
        ingest.append_available(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    loaded = spark.read.parquet(f"{base}/out")
    return loaded.groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))


INGEST_SQL = 'SELECT l_returnflag, COUNT(*) AS "rows", CAST(SUM(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1'


def stream_deal_files(spark: SparkSession, sf: str) -> DataFrame:
    """Deal files of both delimiters as a stream into a store; a second run adds nothing."""
    base = _run_dir(spark, "deal-stream")
    raw = _raw_deals(spark, sf)
    even = F.col("number").cast("bigint") % 2 == 0
    _write_text(raw.where(even), f"{base}/in/tilde")
    plain = raw.where(~even).select(*[F.replace(c, F.lit(";"), F.lit(",")).alias(c) for c in deal_files.DEAL_COLUMNS])
    _write_text(plain, f"{base}/in/semicolon", ";")
    for _ in range(2):
        rows = ingest.stream_deals(spark, f"{base}/in/*", pattern="part-*")
        ingest.replace_available(rows, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    price = F.col("deal_price").cast("decimal(18,2)")
    return spark.read.parquet(f"{base}/out").groupBy("city").agg(F.count("*").alias("deals"), F.sum(price).cast("double").alias("price"))


STREAM_DEALS_SQL = """
SELECT l_returnflag AS city, COUNT(*) AS deals, CAST(SUM(CASE WHEN l_linenumber <> 7 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS price
FROM lineitem GROUP BY 1
"""


def reload_changed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files by year in a store; two changed files are loaded again and replace their rows."""
    path = _run_dir(spark, "reload")
    li = table(spark, sf, "lineitem")
    year = F.year("l_shipdate")
    rows = li.select(
        F.concat(F.lit("dataset_y_"), year.cast("string")).alias("dataset_file"), year.alias("y"), "l_linenumber",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
    )
    deal_files.replace_files(rows.drop("y", "l_linenumber"), path)
    again = rows.where("y IN (1994, 1996) AND l_linenumber <= 3").withColumn("price", (F.col("price") + 1).cast("decimal(18,2)"))
    deal_files.replace_files(again.drop("y", "l_linenumber"), path)
    return spark.read.parquet(path).groupBy("dataset_file").agg(F.count("*").alias("deals"), F.sum("price").cast("double").alias("price"))


RELOAD_SQL = """
SELECT 'dataset_y_' || year(l_shipdate) AS dataset_file, COUNT(*) AS deals,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) + CASE WHEN year(l_shipdate) IN (1994, 1996) THEN 1 ELSE 0 END) AS DOUBLE) AS price
FROM lineitem WHERE year(l_shipdate) NOT IN (1994, 1996) OR l_linenumber <= 3 GROUP BY 1
"""


def _year_files(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as rows of files by year, with the path of each."""
    li = table(spark, sf, "lineitem")
    path = F.concat(F.lit("file:/landing/dataset_y_"), F.year("l_shipdate").cast("string"), F.lit(".csv"))
    return li.select(
        path.alias("path"), F.year("l_shipdate").alias("y"), "l_linenumber", F.col("l_suppkey").cast("string").alias("quarter_cad_number"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
    )


def _listing(rows: DataFrame, time: str) -> DataFrame:
    return rows.select("path").distinct().select("path", F.length("path").cast("bigint").alias("length"), F.lit(time).cast("timestamp").alias("modificationTime"))


def store_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A store over four loads: all years; 1994 shrunk and 1996 empty; 1995 also as .gz, which changes nothing;
    1997 taken out. Each version as its readers see it."""
    root = _run_dir(spark, "store")
    rows = _year_files(spark, sf)
    columns = ["path", "quarter_cad_number", "price"]
    snapshots.load(rows.select(columns), _listing(rows, "2026-01-01"), root)
    again = rows.where("y IN (1994, 1996)")
    snapshots.load(again.where("y = 1994 AND l_linenumber <= 3").select(columns), _listing(again, "2026-01-02"), root)
    packed = rows.where("y = 1995").withColumn("path", F.concat("path", F.lit(".gz")))
    snapshots.load(packed.select(columns), _listing(packed, "2026-01-03"), root)
    snapshots.remove(rows.where("y = 1997").select("path").distinct(), root)
    snapshots.vacuum(spark, root, keep=4)
    seen = [snapshots.snapshot(spark, root, v).withColumn("version", F.lit(v)) for v in (1, 2, 3, 4)]
    whole = seen[0].unionByName(seen[1]).unionByName(seen[2]).unionByName(seen[3])
    return whole.groupBy("version", "dataset_file").agg(F.count("*").alias("deals"), F.sum("price").cast("double").alias("price"))


STORE_VERSIONS_SQL = """
WITH r AS (SELECT year(l_shipdate) AS y, l_linenumber AS n, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem),
v AS (SELECT 1 AS version, y, price FROM r
  UNION ALL SELECT v, y, price FROM r CROSS JOIN (VALUES (2), (3), (4)) t(v) WHERE y <> 1996 AND (y <> 1994 OR n <= 3) AND (y <> 1997 OR v < 4))
SELECT version, 'dataset_y_' || y || '.csv' AS dataset_file, COUNT(*) AS deals, CAST(SUM(price) AS DOUBLE) AS price FROM v GROUP BY 1, 2
"""


def key_search_files(spark: SparkSession, sf: str) -> DataFrame:
    """A key searched in a store whose files have key filters, but for the last one, which was loaded after them."""
    root = _run_dir(spark, "filtered")
    rows = _year_files(spark, sf).withColumn("quarter_cad_number", F.concat("quarter_cad_number", F.lit(":"), (F.col("y") % 3).cast("string")))
    columns = ["path", "quarter_cad_number", "price"]
    early = rows.where("y < 1998")
    snapshots.load(early.select(columns), _listing(early, "2026-01-01"), root)
    key_filters.extend(spark, root, "quarter_cad_number")
    late = rows.where("y >= 1998")
    snapshots.load(late.select(columns), _listing(late, "2026-01-02"), root)
    found = [key_filters.search(spark, root, "quarter_cad_number", k) for k in ("7:0", "7:1", "none")]
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy("quarter_cad_number", "dataset_file").agg(
        F.count("*").alias("deals"), F.max("price").cast("double").alias("dearest")
    )


KEY_SEARCH_SQL = """
SELECT l_suppkey || ':' || (year(l_shipdate) % 3) AS quarter_cad_number, 'dataset_y_' || year(l_shipdate) || '.csv' AS dataset_file, COUNT(*) AS deals,
  CAST(MAX(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS dearest
FROM lineitem WHERE l_suppkey = 7 AND year(l_shipdate) % 3 IN (0, 1) GROUP BY 1, 2
"""


def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Latest purchase or click per user kept by a stream, alive for five hours."""
    base = _run_dir(spark, "latest")
    events = table(spark, sf, "events")
    stream = (
        spark.readStream.schema(events.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
        .withColumn("found", F.col("event_type").isin("purchase", "click"))
        .select("user_id", "event_id", "ts", "found")
    )
    latest.keep_latest(stream, "user_id", "ts", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    now = events.agg(F.max("ts")).scalar()
    return latest.read_fresh(spark, f"{base}/out", "user_id", "ts", now, 5 * 3600).select("user_id", "event_id")


STREAM_LATEST_SQL = """
SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events
  WHERE event_type IN ('purchase', 'click')) WHERE r = 1 AND ts + INTERVAL 5 HOUR >= (SELECT MAX(ts) FROM events)
"""


def live_kpis(spark: SparkSession, sf: str) -> DataFrame:
    """Workload per day and line from the event stream; only days the
    watermark has closed are out."""
    base = _run_dir(spark, "live")
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    whole = F.floor("value").cast("bigint")
    requests = stream.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("line"),
        workload.request_minutes(F.lit("mdo"), whole % 7 == 0, whole % 11 == 0).alias("minutes"),
        (whole % 5 == 0).alias("overdue"),
        F.when((whole % 8).between(1, 5), (whole % 8).cast("int")).alias("csi"),
    )
    ingest.append_available(live.daily_line_kpis(requests), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select(
        F.col("day").cast("string").alias("day"), "line", "apps", F.col("minutes").cast("bigint").alias("minutes"), "overdue",
        *[f"csi_{b}" for b in range(1, 6)],
    )


LIVE_SQL = """
WITH e AS (SELECT CAST(ts AS DATE) AS d, event_type AS line, CAST(floor(value) AS BIGINT) AS w FROM events)
SELECT CAST(d AS VARCHAR) AS day, line, COUNT(*) AS apps,
  CAST(SUM(CASE WHEN w % 11 = 0 THEN 240 WHEN w % 7 = 0 THEN 150 ELSE 20 END) AS BIGINT) AS minutes, COUNT(*) FILTER (w % 5 = 0) AS overdue,
  COUNT(*) FILTER (w % 8 = 1) AS csi_1, COUNT(*) FILTER (w % 8 = 2) AS csi_2, COUNT(*) FILTER (w % 8 = 3) AS csi_3,
  COUNT(*) FILTER (w % 8 = 4) AS csi_4, COUNT(*) FILTER (w % 8 = 5) AS csi_5
FROM e WHERE d + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2
"""

def live_days(spark: SparkSession, sf: str) -> DataFrame:
    """The events in four files, every 50th held back to the last one: all days with their sums, open ones too, and
    the rows that came after their day had closed."""
    base = _run_dir(spark, "days")
    events = table(spark, sf, "events")
    whole = F.floor("value").cast("bigint")
    rows = events.select(
        F.when(F.col("event_id") % 50 == 0, 3).otherwise(F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))).cast("int").alias("part"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("line"),
        workload.request_minutes(F.lit("mdo"), whole % 7 == 0, whole % 11 == 0).cast("bigint").alias("minutes"),
        (whole % 5 == 0).alias("overdue"), F.when((whole % 8).between(1, 5), (whole % 8).cast("int")).alias("csi"),
    )
    for part in range(4):
        rows.where(F.col("part") == part).drop("part").coalesce(1).write.parquet(f"{base}/in/{part}")
        stream = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
        live.keep_days(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    late = live.read_late(spark, f"{base}/out").groupBy(F.to_date("ts").alias("day"), "line").agg(F.count("*").alias("late"))
    days = live.read_days(spark, f"{base}/out")
    return days.join(late, ["day", "line"], "full").select(
        F.col("day").cast("string").alias("day"), "line", "minutes", F.coalesce("closed", F.lit(True)).alias("closed"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("apps", "overdue", "csi_1", "csi_5", "late")],
    )


LIVE_DAYS_SQL = """
WITH e AS (SELECT ts, CAST(ts AS DATE) AS d, event_type AS line, CAST(floor(value) AS BIGINT) AS w, event_id % 50 = 0 AS held FROM events),
m AS (SELECT MAX(ts) - INTERVAL 1 DAY AS mark FROM e WHERE NOT held),
x AS (SELECT e.*, held AND d + INTERVAL 1 DAY <= mark AS late FROM e CROSS JOIN m),
n AS (SELECT MAX(ts) - INTERVAL 1 DAY AS mark FROM x WHERE NOT late)
SELECT CAST(d AS VARCHAR) AS day, line, COUNT(*) FILTER (NOT late) AS apps,
  CAST(SUM(CASE WHEN w % 11 = 0 THEN 240 WHEN w % 7 = 0 THEN 150 ELSE 20 END) FILTER (NOT late) AS BIGINT) AS minutes,
  COUNT(*) FILTER (NOT late AND w % 5 = 0) AS overdue, COUNT(*) FILTER (NOT late AND w % 8 = 1) AS csi_1, COUNT(*) FILTER (NOT late AND w % 8 = 5) AS csi_5,
  d + INTERVAL 1 DAY <= MAX(mark) AS closed, COUNT(*) FILTER (late) AS late
FROM x CROSS JOIN n GROUP BY d, line
"""

def labelled_deals(spark: SparkSession, sf: str) -> DataFrame:
    """Text files scanned and enriched: unit price, location and all three labels of the deals, counted."""
    path = _run_dir(spark, "labelled")
    _write_text(_raw_deals(spark, sf), path)
    enriched = deals.enrich(deal_files.scan_deals(spark, [path]), _codes(spark, sf))
    labels = ["location_label", "realestate_type_label", "purpose_label", "wall_material_label", "category_label"]
    out = enriched.groupBy(*labels).agg(F.count("*").alias("n"), F.sum("unit_price").alias("unit_price"), F.count("unit_price").alias("with_unit_price"))
    return out.withColumn("unit_price", F.col("unit_price").cast("bigint"))


LABELLED_SQL = """
WITH x AS (SELECT l_returnflag || ', a;b' AS location_label, l_linenumber % 2 = 0 AS land, l_linestatus = 'O' AS living, l_linenumber AS k,
  CASE WHEN l_linenumber <> 7 THEN floor(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) / CAST(CAST(l_quantity AS DECIMAL(18,2)) AS DOUBLE) + 0.5) END AS up FROM lineitem)
SELECT location_label, CASE WHEN land THEN 'Земельный участок' ELSE 'Помещение' END AS realestate_type_label,
  CASE WHEN living THEN 'Жилое' ELSE 'Нежилое' END AS purpose_label, '10; Material ' || k AS wall_material_label,
  CASE WHEN land THEN 'Земельные участки' WHEN living THEN 'Жилые помещения' ELSE 'Нежилые здания/помещения' END AS category_label,
  COUNT(*) AS n, CAST(SUM(up) AS BIGINT) AS unit_price, COUNT(up) AS with_unit_price FROM x GROUP BY ALL
"""


def period_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Different quarter keys of each year and over all, from sketches stored per quarter, and exactly."""
    rows = _raw_deals(spark, sf).select("quarter_cad_number", "y", "q", F.concat_ws("-", "y", "q").alias("dataset_file"))
    path, by = _run_dir(spark, "sketches"), ["dataset_file", "y", "q"]
    # two loads, the second with the first one's files again
    key_sketches.extend(spark, path, rows.where("y < 1995"), "quarter_cad_number", by)
    key_sketches.extend(spark, path, rows, "quarter_cad_number", by)
    lines = key_sketches.stored(spark, path)
    total = lambda counts: counts.withColumn("y", F.lit(0))
    estimated = key_sketches.distinct_keys(lines, "y").unionByName(total(key_sketches.distinct_keys(lines)))
    exact = key_sketches.exact_keys(rows, "quarter_cad_number", "y").unionByName(total(key_sketches.exact_keys(rows, "quarter_cad_number")))
    both = estimated.withColumn("exact", F.lit(None).cast("long")).unionByName(exact.select("y", F.lit(None).cast("long").alias("keys"), "n_rows", F.col("keys").alias("exact")))
    return both.groupBy("y").agg(*(F.max(c).alias(c) for c in ("keys", "n_rows", "exact")))


# a hundred keys at most: so few are counted exactly by a sketch too
PERIOD_KEYS_SQL = """
WITH r AS (SELECT CAST(year(l_shipdate) AS INT) AS y, l_suppkey % 100 AS k FROM lineitem)
SELECT COALESCE(y, 0) AS y, COUNT(DISTINCT k) AS keys, COUNT(*) AS n_rows, COUNT(DISTINCT k) AS exact FROM r GROUP BY ROLLUP (y)
"""

QUERIES = {
    "labelled_deals": labelled_deals,
    "period_keys": period_keys,
    "text_scan": text_scan,
    "code_mining": code_mining,
    "quarter_index": quarter_index,
    "catalogue": catalogue,
    "file_gate": file_gate,
    "serving_table": serving_table,
    "json_sink": json_sink,
    "ingest_available_now": ingest_available_now,
    "stream_deal_files": stream_deal_files,
    "reload_changed_files": reload_changed_files,
    "store_versions": store_versions,
    "key_search_files": key_search_files,
    "stream_latest": stream_latest,
    "live_kpis": live_kpis,
    "live_days": live_days,
}
ORACLES = {
    "labelled_deals": LABELLED_SQL,
    "period_keys": PERIOD_KEYS_SQL,
    "stream_deal_files": STREAM_DEALS_SQL,
    "reload_changed_files": RELOAD_SQL,
    "store_versions": STORE_VERSIONS_SQL,
    "key_search_files": KEY_SEARCH_SQL,
    "text_scan": TEXT_SCAN_SQL,
    "code_mining": CODE_MINING_SQL,
    "quarter_index": QUARTER_INDEX_SQL,
    "catalogue": CATALOGUE_SQL,
    "file_gate": FILE_GATE_SQL,
    "serving_table": SERVING_SQL,
    "json_sink": JSON_SQL,
    "ingest_available_now": INGEST_SQL,
    "stream_latest": STREAM_LATEST_SQL,
    "live_kpis": LIVE_SQL,
    "live_days": LIVE_DAYS_SQL,
}
