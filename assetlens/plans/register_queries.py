"""Register and document operators on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_garbage_line, map_last_wins, map_merge, repair_latin1_cyrillic, semicolon_fields, strip
from ..operators import documents, register
from ..operators.sums import running_sums
from ..sources import grids
from .tables import spread, table


def _orders_as_objects(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("З-"), k.cast("string")).alias("conditional"),
        F.col("o_orderpriority").alias("classifier_name"),
        F.concat(F.lit("Order of "), F.col("o_custkey").cast("string")).alias("name"),
        k.cast("string").alias("identifier"),
        F.col("o_orderstatus").alias("quality_category"),
        F.when(k % 2 == 0, F.lit("Рыночная")).otherwise(F.lit("—")).alias("valuation_type"),
        F.lit("").alias("liquidity"),
        F.round("o_totalprice", 2).alias("cost"),
        F.when(k % 3 == 0, F.round("o_totalprice", 2)).otherwise(F.lit(0.0)).alias("collateral_value"),
        (k % 120).cast("double").alias("discount"),
    )


def register_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of the objects a report filter leaves, per classifier and overall."""
    hits = _orders_as_objects(spark, sf).where(
        register.matches(code="з-1", name="order", valuation="Рыночная", cost_from=50000, cost_to=450000)
    )
    return register.totals(hits).select(
        F.coalesce("classifier_name", F.lit("all")).alias("classifier_name"),
        "is_total",
        "objects",
        F.col("estimate").cast("double").alias("estimate"),
        F.col("collateral").cast("double").alias("collateral"),
    )


REGISTER_FILTER_SQL = """
WITH x AS (SELECT o_orderpriority AS c, CAST(round(o_totalprice, 2) AS DECIMAL(24,2)) AS cost, round(o_totalprice, 2) AS d, o_orderkey AS k
           FROM orders WHERE o_orderkey % 2 = 0 AND CAST(o_orderkey AS VARCHAR) LIKE '1%'
             AND round(o_totalprice, 2) BETWEEN 50000 AND 450000),
y AS (SELECT c, cost, CASE WHEN k % 3 = 0 THEN cost WHEN k % 120 = 0 THEN CAST(round_even(d, 0) AS DECIMAL(24,2)) WHEN k % 120 >= 100 THEN 0
             ELSE CAST(round_even(d * (1 - (k % 120) / 100.0::DOUBLE), 0) AS DECIMAL(24,2)) END AS coll FROM x)
SELECT COALESCE(c, 'all') AS classifier_name, c IS NULL AS is_total, COUNT(*) AS objects,
       CAST(SUM(cost) AS DOUBLE) AS estimate, CAST(SUM(coll) AS DOUBLE) AS collateral
FROM y GROUP BY GROUPING SETS ((c), ())
"""


def facets(spark: SparkSession, sf: str) -> DataFrame:
    """Filter lists of the register."""
    return register.facets(_orders_as_objects(spark, sf), ["classifier_name", "quality_category", "valuation_type", "liquidity"])


FACETS_SQL = """
SELECT 'classifier_name' AS facet, o_orderpriority AS value FROM orders
UNION SELECT 'quality_category', o_orderstatus FROM orders
UNION SELECT 'valuation_type', 'Рыночная' FROM orders WHERE o_orderkey % 2 = 0
"""


def row_status(spark: SparkSession, sf: str) -> DataFrame:
    """Documents scored as simple register rows, statuses per language."""
    d = table(spark, sf, "documents")
    n = F.col("n_chars")
    c = {
        "cost": F.when(n > 500, n.cast("double")).otherwise(F.lit(0.0)),
        "collateral_cell": F.when(n > 200, n.cast("double")).otherwise(F.lit(0.0)),
        "raw_name": F.col("text"),
        "name": F.col("source"),
        "conditional": F.concat(F.lit("Doc_"), F.col("doc_id").cast("string")),
        "identifier": F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.lit("")),
        "classifier_cell": F.coalesce("lang", F.lit("")),
    }
    score, reasons = register.simple_score(c)
    scored = d.select("lang", F.col("source"), score.alias("score"), F.size(reasons).alias("n_reasons"))
    parsed = scored.withColumn("status", register.status_of(F.col("score"), F.col("lang") == "de"))
    sums = parsed.groupBy("lang").agg(F.sum("score").alias("points"), F.sum("n_reasons").alias("reasons"))
    return register.status_counts(parsed, ["lang"]).join(sums, "lang")


ROW_STATUS_SQL = """
WITH x AS (SELECT lang, CASE WHEN n_chars > 500 THEN 30 WHEN n_chars > 200 THEN 20 ELSE 0 END
    + CASE WHEN length(text) >= 8 THEN 25 WHEN text <> '' THEN 8 ELSE 0 END + 20
    + CASE WHEN doc_id % 2 = 0 THEN 15 ELSE 0 END + CASE WHEN length(source) >= 10 THEN 10 ELSE 0 END + 5 AS s,
    (n_chars > 200)::INT + (length(text) >= 8)::INT + 1 + (doc_id % 2 = 0)::INT AS r FROM documents),
y AS (SELECT lang, greatest(0, least(100, s)) AS score, r FROM x),
z AS (SELECT *, CASE WHEN lang = 'de' THEN 'skipped' WHEN score >= 45 THEN 'accepted' WHEN score >= 20 THEN 'suspicious' ELSE 'skipped' END AS st FROM y)
SELECT lang, COUNT(*) FILTER (st = 'accepted') AS accepted, COUNT(*) FILTER (st = 'suspicious') AS suspicious,
  COUNT(*) FILTER (st = 'skipped') AS skipped, CAST(SUM(score) AS BIGINT) AS points, CAST(SUM(r) AS BIGINT) AS reasons FROM z GROUP BY lang
"""


def _conversation_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("file"),
        F.lit("s").alias("sheet"),
        F.col("turn").cast("int").alias("row"),
        F.split("text", " ").alias("cells"),
    )


# fixed values: header words looked for in conversations
_MARKERS = (("the", "and", "of"), ("de", "la|le", "en"))
_COLUMNS = (("^the$", "first"), ("and|of", "second"), ("on", "name"), ("er", "other_name"))


def header_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Header row of every conversation and the ordinals of its columns."""
    rows = _conversation_rows(spark, sf)
    headers = register.header_rows(rows, *_MARKERS)
    ordinals = register._ordinals(F.col("header_cells"), _COLUMNS, {"second": 7})
    return headers.select(
        F.col("file").cast("bigint").alias("conv_id"),
        "layout",
        F.col("header_row").cast("bigint").alias("header_row"),
        *[e.cast("bigint").alias(f"col_{n}") for n, e in ordinals.items()],
    )


HEADER_SQL = r"""
WITH r AS (SELECT conv_id, turn, string_split(text, ' ') AS cells, lower(text) AS t FROM conversations),
h AS (SELECT conv_id,
   MIN(turn) FILTER (contains(t, 'the') AND contains(t, 'and') AND contains(t, 'of')) AS s,
   MIN(turn) FILTER (contains(t, 'de') AND regexp_matches(t, 'la|le') AND contains(t, 'en')) AS p FROM r GROUP BY 1),
k AS (SELECT conv_id, CASE WHEN s IS NOT NULL THEN 'structured' ELSE 'simple' END AS layout, COALESCE(s, p, 0) AS header_row FROM h),
c AS (SELECT k.*, list_transform(cells, lambda x: CASE WHEN trim(lower(x)) = 'the' THEN 'first'
     WHEN regexp_matches(lower(x), 'and|of') THEN 'second' WHEN contains(lower(x), 'on') THEN 'name'
     WHEN contains(lower(x), 'er') THEN 'other_name' ELSE '' END) AS f
     FROM k JOIN r ON r.conv_id = k.conv_id AND r.turn = k.header_row)
SELECT conv_id, layout, header_row,
  CAST(COALESCE(len(f) - list_position(list_reverse(f), 'first'), -1) AS BIGINT) AS col_first,
  CAST(COALESCE(len(f) - list_position(list_reverse(f), 'second'), 7) AS BIGINT) AS col_second,
  CAST(COALESCE(len(f) - list_position(list_reverse(f), 'name'), list_position(f, 'other_name') - 1, -1) AS BIGINT) AS col_name
FROM c
"""


def merged_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as a grid; blanks under merged rectangles are filled."""
    conv = table(spark, sf, "conversations")
    k, t = F.col("conv_id"), F.col("turn")
    # twenty conversations are the rows of one file
    file = F.floor(k / 20).cast("string").alias("file")
    cells = conv.select(
        file,
        F.lit("s").alias("sheet"),
        k.cast("int").alias("row"),
        t.cast("int").alias("col"),
        F.when((k + t) % 3 != 0, F.col("role")).otherwise(F.lit("  ")).alias("value"),
    )
    corners = conv.where((k % 4 == 1) & (t % 2 == 0)).select(
        file,
        F.lit("s").alias("sheet"),
        k.cast("int").alias("r0"),
        (k + 2).cast("int").alias("r1"),
        t.cast("int").alias("c0"),
        (t + 1).cast("int").alias("c1"),
    )
    filled = grids.fill_merged(cells, corners)
    return filled.select(
        F.col("row").cast("bigint").alias("row_no"), F.col("col").cast("bigint").alias("col_no"), strip(F.col("value")).alias("value")
    )


MERGED_SQL = """
WITH c AS (SELECT conv_id AS r, turn AS c, CASE WHEN (conv_id + turn) % 3 <> 0 THEN role ELSE '' END AS v FROM conversations),
l AS (SELECT r // 20 AS f, MAX(r) AS last FROM c GROUP BY 1),
m AS (SELECT r AS r0, r + 2 AS r1, c AS c0, c + 1 AS c1, v AS fill, last FROM c JOIN l ON f = r // 20 WHERE r % 4 = 1 AND c % 2 = 0 AND v <> ''),
x AS (SELECT DISTINCT r, c, fill FROM m, UNNEST(range(r0, least(r1, last) + 1)) a(r), UNNEST(range(c0, c1 + 1)) b(c))
SELECT COALESCE(c.r, x.r) AS row_no, COALESCE(c.c, x.c) AS col_no,
       CASE WHEN COALESCE(c.v, '') = '' THEN COALESCE(x.fill, c.v) ELSE c.v END AS value
FROM c FULL JOIN x ON c.r = x.r AND c.c = x.c
"""


def block_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of a conversation begin at each user turn."""
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", (F.col("role") == "user").cast("bigint").alias("start")
    )
    # blocks of 1 000 turns, so one endless conversation is many tasks
    out = running_sums(c, ["conv_id"], "turn", [], ["start"], 0.001)
    return out.select("conv_id", "turn", "role", F.col("start_upto").alias("block"))


BLOCK_SQL = """
SELECT conv_id, turn, role, CAST(SUM(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS block
FROM conversations
"""


def text_fields(spark: SparkSession, sf: str) -> DataFrame:
    """How many card-like numbers, phones, links and dates each text holds."""
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("bigint")
    return spread(table(spark, sf, "documents")).select(
        "doc_id",
        n("[0-9]{16}").alias("card_like"),
        n("[0-9]{3}-[0-9]{4}").alias("phone_like"),
        n("https?://[a-z0-9./]+").alias("links"),
        n("[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}").alias("addresses"),
    )


TEXT_FIELDS_SQL = """
SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]{16}')) AS BIGINT) AS card_like,
  CAST(len(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}')) AS BIGINT) AS phone_like,
  CAST(len(regexp_extract_all(text, 'https?://[a-z0-9./]+')) AS BIGINT) AS links,
  CAST(len(regexp_extract_all(text, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}')) AS BIGINT) AS addresses
FROM documents
"""


def line_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Lines per document and how many of them are symbol garbage."""
    lines = F.transform(F.split("text", "\n"), F.trim)
    filled = F.filter(lines, lambda x: x != "")
    return spread(table(spark, sf, "documents")).select(
        "doc_id",
        F.size(filled).cast("bigint").alias("lines"),
        F.size(F.filter(filled, is_garbage_line)).cast("bigint").alias("garbage"),
    )


LINE_FILTER_SQL = r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS lines,
  CAST(len(list_filter(ls, lambda x: len(regexp_extract_all(x, '[!"#$%&''()*+,\-./:;<=>?@A-Z\[\\\]^_`{|}~]')) >= 6)) AS BIGINT) AS garbage
FROM l
"""


def doc_report(spark: SparkSession, sf: str) -> DataFrame:
    """Summary sentence per order with the number of its lines."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit("ASZ"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("conclusion_number"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("conclusion_date"),
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("Client "), F.col("o_custkey").cast("string"))).otherwise(F.lit("")).alias("client_name"),
        F.lit("").alias("tax_id"),
        F.lit("").alias("validity_date"),
        F.lit("").alias("credit_term"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("r"), F.lit("s"))).otherwise(F.array().cast("array<string>")).alias("risks"),
    )
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"))
    return documents.report(o, lines).select("doc_id", "object_count", "summary")


DOC_REPORT_SQL = """
WITH c AS (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS doc_id, COALESCE(n, 0) AS object_count,
  'Залоговое заключение ASZ' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || ' от ' || strftime(o_orderdate, '%Y-%m-%d') || ' подготовлено для '
  || CASE WHEN o_custkey % 2 = 0 THEN 'Client ' || o_custkey ELSE 'клиент не указан в PDF' END || '.'
  || CASE WHEN n > 0 THEN ' В перечне залога указано объектов: ' || n || '. Стоимостные показатели приведены в таблице ниже.' ELSE '' END
  || CASE WHEN o_orderstatus = 'F' THEN ' В тексте заключения выявлено рисков: 2. Подробности — в разделе «Риски».'
     ELSE ' Явные формулировки рисков в PDF не распознаны автоматически. Проверьте исходный документ вручную.' END AS summary
FROM orders LEFT JOIN c ON l_orderkey = o_orderkey
"""


def semi_structured_fields(spark: SparkSession, sf: str) -> DataFrame:
    """``key: value`` text with repeated keys, merged with event properties."""
    e = spread(table(spark, sf, "events"))
    text = F.concat(
        F.lit("Kind; User : "), F.col("user_id").cast("string"), F.lit("; type: н/д; USER: "),
        F.col("event_type"), F.lit(";; Value: "), F.floor("value").cast("string"),
    )
    props = map_last_wins(
        F.array(F.struct(F.lit("k").alias("key"), F.get_json_object("props", "$.k").alias("value")),
                F.struct(F.lit("value").alias("key"), F.lit("-1").alias("value")))
    )
    merged = e.select("event_id", map_merge(semicolon_fields(text), props).alias("f"))
    get = lambda k: F.try_element_at("f", F.lit(k))
    return merged.select(
        "event_id", get("kind").alias("kind"), get("user").alias("user"), get("type").alias("type"),
        get("value").alias("value"), get("k").alias("k"), F.size("f").cast("bigint").alias("fields"),
    )


SEMI_SQL = """
SELECT event_id, 'kind' AS kind, event_type AS "user", CAST(NULL AS VARCHAR) AS type, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value,
  json_extract_string(props, '$.k') AS k, CAST(4 AS BIGINT) AS fields FROM events
"""


def quality_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Which fields documents lack, per note."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    d = d.withColumn("label_text", F.col("quality").cast("string"))
    checks = (("lang", "no language"), ("source", "no source"), ("label_text", "no label"))
    noted = d.select("doc_id", documents.quality_notes(F.col("text"), checks, 300).alias("notes"))
    return documents.note_counts(noted)


QUALITY_SQL = """
SELECT note, COUNT(*) AS documents FROM (
  SELECT CASE WHEN length(text) < 300 THEN
    'Не удалось извлечь достаточно текста из PDF (возможно, скан без текстового слоя).' END AS note FROM documents
  UNION ALL SELECT CASE WHEN length(text) >= 300 AND COALESCE(lang, '') = '' THEN 'no language' END FROM documents
  UNION ALL SELECT CASE WHEN length(text) >= 300 AND COALESCE(source, '') = '' THEN 'no source' END FROM documents
  UNION ALL SELECT CASE WHEN length(text) >= 300 AND quality IS NULL THEN 'no label' END FROM documents LEFT JOIN labels USING (doc_id))
WHERE note IS NOT NULL GROUP BY note
"""

def repaired_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names whose Cyrillic was read as Latin-1 mended, missing ones numbered."""
    n = F.col("c_custkey") % 4
    tail = F.concat(F.lit(" "), F.col("c_custkey").cast("string"))
    given = (
        F.when(n == 0, F.concat(F.lit("ÈÍÍ ¹¸"), tail))
        .when(n == 1, F.concat(F.lit("Çàëîã ИНН"), tail))
        .when(n == 2, F.col("c_name"))
    )
    named = table(spark, sf, "customer").select("c_custkey", repair_latin1_cyrillic(given).alias("name"))
    return register.with_default_names(named, "name", "Obj-", "c_custkey")


REPAIRED_SQL = """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'ИНН №ё ' || c_custkey WHEN 1 THEN 'Çàëîã ИНН ' || c_custkey
  WHEN 2 THEN c_name ELSE 'Obj-' || c_custkey END AS name FROM customer
"""

QUERIES = {
    "repaired_names": repaired_names,
    "register_filter": register_filter,
    "facets": facets,
    "row_status": row_status,
    "header_columns": header_columns,
    "merged_fill": merged_fill,
    "block_ids": block_ids,
    "text_fields": text_fields,
    "line_filter": line_filter,
    "doc_report": doc_report,
    "semi_structured_fields": semi_structured_fields,
    "quality_notes": quality_notes,
}
ORACLES = {
    "repaired_names": REPAIRED_SQL,
    "register_filter": REGISTER_FILTER_SQL,
    "facets": FACETS_SQL,
    "row_status": ROW_STATUS_SQL,
    "header_columns": HEADER_SQL,
    "merged_fill": MERGED_SQL,
    "block_ids": BLOCK_SQL,
    "text_fields": TEXT_FIELDS_SQL,
    "line_filter": LINE_FILTER_SQL,
    "doc_report": DOC_REPORT_SQL,
    "semi_structured_fields": SEMI_SQL,
    "quality_notes": QUALITY_SQL,
}
