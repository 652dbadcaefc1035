"""Whole flows on inputs rendered from the shared tables.

Each query writes its table's rows as the raw material an operator reads (an
export row, a page, a document, a payload) and reads them back; the SQL states
what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as addr
from ..functions import names, numbers
from ..operators import documents, matching, register, retrieval, vehicles, workload
from ..sources import html, responses
from .tables import spread, table


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# --- request exports --------------------------------------------------------------------

_EXPORT = {"view": "1-я линия_a.xlsx", "signup": "Онлайн оценка_b.xlsx", "click": "MDO_c.xlsx", "error": "Осмотры_d.xls", "purchase": "Экспертизы.xlsx"}


def request_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Events as rows of five exports: columns inferred, rows typed, rejected
    or counted per person and line."""
    e = spread(table(spark, sf, "events"))
    w = F.floor("value").cast("bigint")
    file = F.lit("")
    for t, name in _EXPORT.items():
        file = F.when(F.col("event_type") == t, F.lit(name)).otherwise(file)
    end = F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    values = {
        workload.START: F.date_format(end - F.make_dt_interval(secs=w * 60), "dd.MM.yyyy HH:mm:ss"),
        workload.END: F.date_format(end, "yyyy-MM-dd HH:mm:ss"),
        workload.RETURNS: _cat(_s(w % 3), ",0"),
        workload.PERSON: F.when(F.col("user_id") % 10 == 9, F.lit(" - ")).otherwise(_cat("User", _s("user_id"), "  A. (", _s("event_id"), ")")),
        workload.SEGMENT: F.when(w % 2 == 0, F.lit("Управление малого бизнеса, Сибирский банк")).otherwise(F.lit("Иное")),
        workload.OVERDUE: F.when(w % 5 == 0, F.lit("Да")).otherwise(F.lit("нет")),
        5: F.when(w % 11 == 0, F.lit("ФЖН")).when(w % 7 == 0, F.lit("срочно, АРБИТРАЖ")),
        workload.PRIORITY: F.when(w % 4 == 0, F.lit("Приоритетная")),
        workload.SCORE: _s(w % 8),
    }
    cells = F.array(*[values.get(i, F.lit(None).cast("string")) for i in range(40)])
    requests = e.select(file.alias("file"), F.lit("s").alias("sheet"), F.col("event_id").alias("row_no"), cells.alias("cells"))
    header = F.array(*[F.lit({5: "Тег", workload.PERSON: "Исполнитель"}.get(i, f"c{i}")) for i in range(40)])
    headers = requests.select("file", "sheet").distinct().withColumn("headers", header)
    roster = e.where("user_id % 2 = 0").select(_cat("USER", _s("user_id")).alias("person_key")).distinct()
    typed = workload.typed_requests(
        requests, workload.infer_columns(headers, requests), roster, F.lit("2024-01-25").cast("date")
    )
    kpis = workload.merge_kpis(workload.person_line_kpis(workload.used(typed)), ["person", "line"])
    return kpis.select(
        "person", "line", "apps", "apps_arb", "apps_fzh", F.col("minutes").cast("bigint").alias("minutes"), "overdue",
        F.col("returns").cast("bigint").alias("returns"), F.col("term_seconds").alias("term_seconds"), "csi_1", "csi_5",
    )


REQUEST_EXPORTS_SQL = """
WITH e AS (SELECT *, CAST(floor(value) AS BIGINT) AS w FROM events),
k AS (SELECT *, w % 11 = 0 AS fzh, w % 11 <> 0 AND w % 7 = 0 AS arb,
  CASE event_type WHEN 'view' THEN 'l1' WHEN 'signup' THEN 'online' WHEN 'error' THEN 'inspection' ELSE 'mdo' END AS kind,
  CASE event_type WHEN 'view' THEN '1-я линия' WHEN 'signup' THEN 'Онлайн оценка' WHEN 'click' THEN 'MDO' WHEN 'error' THEN 'Осмотры' ELSE 'Экспертизы' END AS line
  FROM e WHERE user_id % 2 = 0 AND CAST(ts AS DATE) <= DATE '2024-01-25')
SELECT 'User' || user_id || ' A.' AS person, line, COUNT(*) AS apps,
  COUNT(*) FILTER (arb AND kind IN ('online', 'mdo')) AS apps_arb, COUNT(*) FILTER (fzh AND kind = 'mdo') AS apps_fzh,
  CAST(SUM(CASE kind WHEN 'l1' THEN 24 WHEN 'inspection' THEN 20 WHEN 'online' THEN CASE WHEN arb THEN 210 ELSE 20 END
      ELSE CASE WHEN fzh THEN 240 WHEN arb THEN 150 ELSE 20 END END) AS BIGINT) AS minutes,
  COUNT(*) FILTER (w % 5 = 0) AS overdue, CAST(SUM(w % 3) AS BIGINT) AS returns, CAST(SUM(w * 60) AS BIGINT) AS term_seconds,
  COUNT(*) FILTER (w % 8 = 1) AS csi_1, COUNT(*) FILTER (w % 8 = 5) AS csi_5
FROM k GROUP BY 1, 2
"""

# --- documents ---------------------------------------------------------------------------


def conclusion_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as conclusions, read back: header, risks, notes."""
    k = F.col("o_orderkey")
    text = _cat(
        "Залоговое заключение\n",
        F.when(k % 5 != 0, _cat("Номер заключения: asz", F.lpad(_s(k), 12, "0"), "\n")).otherwise(""),
        "Дата заключения: ", F.date_format("o_orderdate", "dd.MM.yyyy"), "\n",
        "Наименование залогодателя: ", F.when(k % 2 == 0, _cat('ооо "Client ', _s("o_custkey"), '"')).otherwise(_cat("ИП ИВАНОВ N", _s("o_custkey"))), "\n",
        "ИНН залогодателя: ", F.lpad(_s("o_custkey"), 10, "7"), "\n\n\n\nВыявленные риски:\n",
        "З-01 - Риск ", _s("o_orderstatus"), ". Минимизация: запросить выписку.\n",
        F.when(k % 3 == 0, _cat("З-02 | Второй риск объекта | Сверить документы\n", "З-01 - Риск ", _s("o_orderstatus"), ". Минимизация: ещё раз\n")).otherwise(""),
    )
    docs = spread(table(spark, sf, "orders")).select(k.alias("doc_id"), text.alias("text"))
    out = documents.extract_documents(docs)
    risk = F.get("risks", F.lit(0))
    return out.select(
        "doc_id", "conclusion_number", "conclusion_date", "tax_id", "client_name", F.size("risks").cast("bigint").alias("risks"),
        risk["identifier"].alias("first_id"), risk["risk"].alias("first_risk"), risk["minimization"].alias("first_minimization"),
        F.array_join("notes", "; ").alias("notes"),
    )


CONCLUSION_SQL = """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 <> 0 THEN 'ASZ' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') ELSE '' END AS conclusion_number,
  strftime(o_orderdate, '%Y-%m-%d') AS conclusion_date, lpad(CAST(o_custkey AS VARCHAR), 10, '7') AS tax_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'ООО "Client ' || o_custkey || '"' ELSE 'ИП Иванов N' || o_custkey END AS client_name,
  CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS risks, 'З-01' AS first_id, 'Риск ' || o_orderstatus AS first_risk,
  'запросить выписку' AS first_minimization,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Номер заключения ASZ… не найден в тексте.' ELSE '' END AS notes
FROM orders
"""


def short_form_risks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as short forms: table line, risk blocks, reference."""
    k = F.col("o_orderkey")
    text = _cat(
        "КРАТКАЯ ФОРМА ЗАЛОГОВОГО ЗАКЛЮЧЕНИЯ\nASZ", F.lpad(_s(k), 10, "0"), "\n", F.lpad(_s("o_custkey"), 10, "5"),
        ' АО "Завод ', _s("o_custkey"), '" ', F.date_format("o_orderdate", "dd.MM.yyyy"), "\nРиски\nРиск утраты ТС_", _s(k), ",\nобъектов не\n",
        F.when(k % 2 == 0, F.lit("До заключения договора застраховать\nи далее ежегодно\n")).otherwise(""),
        F.when(k % 3 == 0, F.lit("Риск порчи имущества\n")).otherwise(""),
        "Справочная информация\nСрок действия заключения: ", F.date_format(F.date_add("o_orderdate", 365), "dd.MM.yyyy"),
        "\nСрок кредита: ", _s(k % 60), " мес\nКлиент известен банку\nABCDEFGH\n",
    )
    out = documents.extract_documents(spread(table(spark, sf, "orders")).select(k.alias("doc_id"), text.alias("text")))
    r = lambda i, f: F.get("risks", F.lit(i))[f]
    return out.select(
        "doc_id", "conclusion_number", "client_name", "tax_id", "validity_date", "credit_term", "reference_text",
        r(0, "identifier").alias("id_1"), r(0, "minimization").alias("how_1"), r(1, "identifier").alias("id_2"),
    )


SHORT_FORM_SQL = """
SELECT o_orderkey AS doc_id, 'ASZ' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS conclusion_number, 'АО "Завод ' || o_custkey || '"' AS client_name,
  lpad(CAST(o_custkey AS VARCHAR), 10, '5') AS tax_id, strftime(o_orderdate + INTERVAL 365 DAY, '%Y-%m-%d') AS validity_date,
  (o_orderkey % 60) || ' мес' AS credit_term, 'Клиент известен банку' AS reference_text, 'ТС_' || o_orderkey AS id_1,
  CASE WHEN o_orderkey % 2 = 0 THEN 'До заключения договора застраховать и далее ежегодно' ELSE '—' END AS how_1,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Риск-2' END AS id_2
FROM orders
"""


def table_risks(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as rows of document tables; risks between two headings."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag").distinct()
    body = li.select(
        F.col("l_orderkey").alias("doc_id"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber") + 1).alias("row"),
        F.array(
            _cat("Объект_", _s("l_linenumber"), ",\nисходные данные"),
            _cat(" ", _s("l_linenumber"), ". 1."),
            _cat("Риск ", _s("l_returnflag"), "\nриск иной\nДля смены категории"),
        ).alias("cells"),
    )
    ids = li.select(F.col("l_orderkey").alias("doc_id")).distinct()
    heads = ids.select("doc_id", F.lit(0).cast("bigint").alias("row"), F.array(F.lit("Риски")).alias("cells"))
    tails = ids.select("doc_id", F.lit(10**12).cast("bigint").alias("row"), F.array(F.lit("Справочная информация")).alias("cells"))
    rows = heads.unionByName(body).unionByName(tails).withColumn("table_no", F.lit(1))
    found = documents.table_risks(rows, limit=None)
    return found.groupBy("doc_id", "risk_number", "risk", "minimization").agg(F.max("identifier").alias("identifier"), F.count("*").alias("n"))


TABLE_RISKS_SQL = """
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem)
SELECT l_orderkey AS doc_id, l_linenumber || '.1' AS risk_number, 'Риск ' || l_returnflag || ' риск иной' AS risk, '—' AS minimization,
  '—' AS identifier, COUNT(*) AS n FROM d GROUP BY ALL
"""


def risk_mitigation(spark: SparkSession, sf: str) -> DataFrame:
    """Mitigations by risk number out of question rows, joined to risks."""
    p = table(spark, sf, "part")
    rows = p.select(
        (F.col("p_partkey") % 3).alias("sheet_no"),
        F.col("p_partkey").alias("row"),
        _cat(_s("p_size"), ".", _s(F.col("p_partkey") % 4), ". Что делать?").alias("question"),
        _cat(" ", F.col("p_name"), " ").alias("answer"),
    )
    risks = table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") == 1, F.lit("")).otherwise(_cat(_s(F.col("l_quantity").cast("int")), ".", _s(F.col("l_linenumber") % 4), ".")).alias("risk_number"),
        F.lit("own").alias("minimization"),
    )
    out = documents.with_mitigation(risks, documents.mitigation_dictionary(rows))
    return out.groupBy("risk_number", "minimization").agg(F.count("*").alias("n"))


RISK_MITIGATION_SQL = """
WITH d AS (SELECT p_size || '.' || (p_partkey % 4) AS key, arg_max(p_name, (p_partkey % 3) * 1000000000000 + p_partkey) AS answer FROM part GROUP BY 1),
r AS (SELECT CASE WHEN l_linenumber = 1 THEN '' ELSE CAST(l_quantity AS INT) || '.' || (l_linenumber % 4) || '.' END AS risk_number FROM lineitem)
SELECT risk_number, CASE WHEN risk_number = '' THEN 'own' ELSE COALESCE(answer, '—') END AS minimization, COUNT(*) AS n
FROM r LEFT JOIN d ON d.key = rtrim(risk_number, '.') GROUP BY 1, 2
"""

# --- registers ---------------------------------------------------------------------------

_STRUCTURED_HEADER = ("Вид обеспечения", "Залогодатель", "Описание обеспечения", "Оценочная стоимость", "Залоговая стоимость", "Срок экспозиции")


def register_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as rows of registers (one file per customer): kinds, identifiers,
    sums, scores and verdicts."""
    o = spread(table(spark, sf, "orders"))
    k = F.col("o_orderkey")
    vin = F.upper(F.substring(F.translate(F.md5(_s(k)), "abcdef", "ABCDEF"), 1, 17))
    kind = (
        F.when(k % 4 == 0, _cat("Имущество/Транспорт/Легковой автомобиль\nТС_", _s(k)))
        .when(k % 4 == 1, _cat("Недвижимость/Земельный участок|ЗУ_", _s(k)))
        .when(k % 4 == 2, F.lit("Итого по разделу"))
        .otherwise(F.lit("Прочее имущество без обозначения и описания очень длинное"))
    )
    what = (
        F.when(k % 4 == 0, _cat("Автомобиль; Марка: M", _s(k % 10), "; Год выпуска: 2020; Тип идентификатора: VIN: ", vin, "; Вид оценочной стоимости: рыночная"))
        .when(k % 4 == 1, _cat("Земельный участок; Кадастровый номер: 59:01:0001005:", _s(k), "; Площадь: 10 кв.м"))
        .otherwise(F.lit(""))
    )
    cells = F.array(kind, F.lit("ООО Р"), what, F.translate(_s(F.col("o_totalprice").cast("decimal(18,2)")), ".", ","), F.lit("-"), F.when(k % 8 == 0, F.lit("90")))
    body = o.select(_s("o_custkey").alias("file"), F.lit("L").alias("sheet"), (k + 1).cast("int").alias("row"), cells.alias("cells"))
    header = F.array(*[F.lit(h) for h in _STRUCTURED_HEADER])
    heads = body.select("file", "sheet").distinct().select("file", "sheet", F.lit(0).alias("row"), header.alias("cells"))
    parsed = register.parse_registers(heads.unionByName(body))
    return parsed.select(
        F.col("file").cast("bigint").alias("custkey"), (F.col("row") - 1).cast("bigint").alias("orderkey"), "status",
        F.col("score").cast("bigint").alias("score"), "conditional", "klassifikator", "identifier", "valuation_type", "cost",
        "collateral_value", "name", F.get("reasons", F.lit(0)).alias("first_reason"),
    )


REGISTER_ROWS_SQL = """
WITH x AS (SELECT *, o_orderkey AS k, upper(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 17)) AS vin, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS c FROM orders)
SELECT o_custkey AS custkey, k AS orderkey,
  CASE WHEN k % 4 = 2 THEN 'skipped' ELSE 'accepted' END AS status,
  CASE k % 4 WHEN 2 THEN 0 WHEN 3 THEN 60 ELSE 100 END::BIGINT AS score,
  CASE k % 4 WHEN 0 THEN 'ТС_' || k WHEN 1 THEN 'ЗУ_' || k WHEN 2 THEN '' ELSE 'Прочее' END AS conditional,
  CASE k % 4 WHEN 0 THEN '310.01' WHEN 1 THEN '201.05' WHEN 3 THEN '999.99' END AS klassifikator,
  CASE k % 4 WHEN 0 THEN vin WHEN 1 THEN '59:01:0001005:' || k WHEN 3 THEN '' END AS identifier,
  CASE k % 4 WHEN 0 THEN 'Рыночная' WHEN 2 THEN NULL ELSE '' END AS valuation_type, c AS cost,
  CASE WHEN k % 4 <> 2 THEN c END AS collateral_value,
  CASE k % 4 WHEN 0 THEN '[ОБЪЕКТ] Автомобиль' || chr(10) || 'Марка: M' || (k % 10) || ' | Год выпуска: 2020 | VIN: ' || vin || chr(10)
      || '[ПРАВА]: —. Обременения: нет.' || chr(10) || '[ОЦЕНКА / ЗАЛОГ]' || chr(10)
      || CASE WHEN k % 8 = 0 THEN 'Срок реализации: 90 дн.' || chr(10) ELSE '' END || 'Стоимость: рыночная'
    WHEN 1 THEN '[ОБЪЕКТ] Земельный участок' || chr(10) || 'Площадь: 10 кв.м | КН: 59:01:0001005:' || k || chr(10)
      || '[ПРАВА]: —. Обременения: нет.' || chr(10) || '[ОЦЕНКА / ЗАЛОГ]'
    WHEN 2 THEN '' ELSE 'Прочее имущество без обозначения и описания очень длинное' END AS name,
  CASE WHEN k % 4 = 2 THEN 'строка «Итого»' ELSE 'есть оценочная стоимость' END AS first_reason
FROM x
"""


def cell_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Label/value pairs of neighbouring cells and of running text."""
    p = spread(table(spark, sf, "part"))
    cells = F.array(F.lit("Марка"), F.col("p_brand"), F.lit("Модель:"), F.lit("Площадь"), F.col("p_type"), F.lit("x"))
    text = _cat("Вид обеспечения: ", F.col("p_name"), " Год выпуска: ", _s("p_size"), "\nVIN номер\n", F.upper("p_type"))
    a = p.select("p_partkey", names.neighbour_fields(cells).alias("c"), names.labelled_fields(text).alias("t"))
    get = lambda m, k: F.try_element_at(m, F.lit(k))
    return a.select(
        "p_partkey", get("c", "brand").alias("brand"), get("c", "model").alias("model"), get("c", "area").alias("area"),
        get("t", "kind").alias("kind"), get("t", "year").alias("year"), get("t", "vin").alias("vin"),
    )


CELL_PAIRS_SQL = """
SELECT p_partkey, p_brand AS brand, CAST(NULL AS VARCHAR) AS model, p_type AS area, p_name AS kind, p_size || ' VIN номер ' || upper(p_type) AS year,
  upper(p_type) AS vin FROM part
"""

# --- listings ----------------------------------------------------------------------------


def listing_table(spark: SparkSession, sf: str) -> DataFrame:
    """Parts rendered as a result table of listings and parsed back."""
    k = F.col("p_partkey")
    row = _cat(
        '<tr class="ads-table__row" id="x"><td><a class="ads-table__link" href="/ads/', _s(k), '"><b>EXT-', _s(k), "</b></a></td>",
        '<td class="col-location">г.&nbsp;Пермь,  ул. ', F.col("p_name"), "</td>", "<td>", _s("p_size"), " сот.</td>",
        '<td class="col-price"> ', _s(F.floor("p_retailprice")), " 000 ₽</td><td>", _s(F.col("p_size") % 9), ",5 км</td>",
        F.when(k % 2 == 0, F.lit('<td><i class="badge--active"></i></td>')).otherwise(F.lit('<td><i class="badge--inactive"></i></td>')),
        F.when(k % 3 == 0, _cat('<td><img alt="" src="/img/', _s(k), '.jpg"></td>')).otherwise(""), "</tr>",
    )
    page = spread(table(spark, sf, "part")).select(k.alias("page"), _cat("<table>", row, '<tr class="ads-table__row"><td>no link</td></tr></table>').alias("html"))
    out = html.listing_rows(page, "html", "analog", "https://example.org", "catalog", "page")
    return out.select(
        "page", "id", "title", "address", "description", "price", "distance", numbers.distance_km(F.col("distance")).alias("km"),
        "suitable", "url", F.get("photos", F.lit(0)).alias("photo"),
    )


LISTING_SQL = """
SELECT p_partkey AS page, CAST(p_partkey AS VARCHAR) AS id, p_size || ' сот., ' || CAST(floor(p_retailprice) AS BIGINT) || ' 000 ₽' AS title,
  'г. Пермь, ул. ' || p_name AS address, 'Расстояние: ' || (p_size % 9) || ',5 км. ' || CASE WHEN p_partkey % 2 = 0 THEN 'Подходит' ELSE 'Не подходит' END
  || '. ID источника: EXT-' || p_partkey AS description, CAST(floor(p_retailprice) AS BIGINT) * 1000 AS price, (p_size % 9) || ',5 км' AS distance,
  CAST(p_size % 9 AS DOUBLE) + 0.5 AS km, p_partkey % 2 = 0 AS suitable, 'https://example.org/ads/' || p_partkey AS url,
  CASE WHEN p_partkey % 3 = 0 THEN 'https://example.org/img/' || p_partkey || '.jpg' END AS photo FROM part
"""


def registry_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Parts rendered as registry cards and parsed back."""
    k = F.col("p_partkey")
    field = lambda label, value: _cat(
        '<div class="row_sser"><div class="left left_sser">', label, '</div><div class="tx_sser x">', value, "</div></div>"
    )
    body = _cat(
        "<html><script>var a;</script>", field("Адрес", F.col("p_name")), field("Тип", _cat("<b>", F.col("p_type"), "</b>")),
        field("Площадь", _cat(_s("p_size"), ",5 кв м")), field("Границы", F.lit("доступно в платной версии")),
        field("Кадастровый номер", F.when(k % 2 == 0, _cat("59:01:1:", _s(k))).otherwise("")),
        'Краткая информация по объекту <div class="lable_2 short_info">',
        F.when(k % 3 == 0, _cat("Кадастровая площадь объекта составляет ", _s("p_size"), " 000,25 кв. м. ")).otherwise(""),
        "Кадастровая стоимость составляет ", _s(F.floor("p_retailprice")), ",5 руб</div> <div class=\"clear\"></div>",
        '<div id="rnb">Зарегистрированные права - <b>найдено ', _s(k % 4), "</b><p>Зарегистрированные ограничения - <i>не обнаружены</i>",
        "&#128994; <div><span>вид </span></div>Ипотека<span> дата </span> <b>12.03.</b>2020 &#128994; x</div>",
        '<div id="pay_lk_service"></div>Связи с другими объектами Найдено - ', _s(k % 5), "</html>",
    )
    cards = html.registry_card(spread(table(spark, sf, "part")).select(k.alias("page"), body.alias("html"), F.lit("?").alias("asked")), "html", "asked", "page")
    rec = F.get("restriction_records", F.lit(0))
    return cards.select(
        "page", "key", "address", "object_type", "area", "value", "boundaries", F.col("rights_count").cast("bigint").alias("rights_count"),
        F.col("restrictions_count").cast("bigint").alias("restrictions_count"), F.col("related_objects").cast("bigint").alias("related_objects"),
        F.size("restriction_records").cast("bigint").alias("records"), rec["kind"].alias("kind"), rec["date_partial"].alias("date_partial"),
    )


REGISTRY_CARDS_SQL = """
SELECT p_partkey AS page, CASE WHEN p_partkey % 2 = 0 THEN '59:01:1:' || p_partkey ELSE '?' END AS key, p_name AS address, p_type AS object_type,
  CASE WHEN p_partkey % 3 = 0 THEN p_size * 1000 + 0.25 ELSE p_size + 0.5 END::DOUBLE AS area, (floor(p_retailprice) + 0.5)::DOUBLE AS value,
  CAST(NULL AS VARCHAR) AS boundaries, (p_partkey % 4)::BIGINT AS rights_count, 0::BIGINT AS restrictions_count, (p_partkey % 5)::BIGINT AS related_objects,
  1::BIGINT AS records, 'Ипотека' AS kind, '12.03.' AS date_partial FROM part
"""


def _object_columns() -> dict[str, Column]:
    size = F.col("p_size")
    street = F.when(size % 2 == 0, F.lit("Садовая Большая")).otherwise(F.lit("Комсомольская"))
    return {
        "object_key": F.concat_ws(":", F.lit("59"), F.lit("01"), F.lpad(_s(size), 7, "0"), _s("p_partkey")),
        "object_address": _cat("Пермский край, г. Пермь, ул. ", street, ", д. ", _s(size)),
        "street": street,
    }


def _line_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as objects with an address."""
    c = _object_columns()
    return table(spark, sf, "part").select(*[c[n].alias(n) for n in ("object_key", "object_address")])


def _line_listings(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as listings of their part: text, match kind, distance, order."""
    c = _object_columns()
    part = table(spark, sf, "part").select("p_partkey", "p_size", *[e.alias(n) for n, e in c.items()])
    n, size, street = F.col("l_linenumber"), F.col("p_size"), F.col("street")
    seen = F.when(n % 3 == 0, _cat("продаю дом, ", street)).when(n % 3 == 1, F.lit("участок садовая роща")).otherwise(F.lit("гараж"))
    return spread(table(spark, sf, "lineitem")).join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "object_key",
        "object_address",
        F.lit("catalog").alias("source"),
        _s(F.col("l_suppkey") % 5).alias("id"),
        F.lit("").alias("url"),
        seen.alias("title"),
        F.when(n == 4, _cat("кн 59 01 ", F.lpad(_s(size), 7, "0"), " ", _s("l_partkey"))).otherwise(F.lit("")).alias("description"),
        F.when(n % 2 == 0, _cat("город Пермь ", _s(size))).otherwise(F.lit("Кунгур")).alias("address"),
        F.when(n == 1, F.lit("analog")).when(n == 2, F.lit("street")).when(n == 3, F.lit("address")).when(n == 5, F.lit("region")).alias("matched_by"),
        _cat(_s(F.col("l_quantity").cast("int")), " км").alias("distance"),
        (F.col("l_orderkey") * 10 + n).alias("seq"),
    )


def listing_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all listings against their object, the keep rule applied."""
    found = _line_listings(spark, sf)
    objects = _line_objects(spark, sf)
    kept = matching.keep_relevant(matching.with_relevance(found.drop("object_address"), objects))
    return kept.groupBy("score", F.coalesce("matched_by", F.lit("-")).alias("matched_by"), "mentions_key").agg(
        F.count("*").alias("n"), F.min(F.size("reasons")).cast("bigint").alias("reasons")
    ).withColumn("score", F.col("score").cast("bigint"))


_LISTINGS_SQL = """
l AS (SELECT l_partkey, l_suppkey, l_linenumber AS n, p_size AS s, l_orderkey * 10 + l_linenumber AS seq, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT *, CASE n WHEN 1 THEN 'analog' WHEN 2 THEN 'street' WHEN 3 THEN 'address' WHEN 5 THEN 'region' END AS matched,
  CASE WHEN n % 3 = 0 THEN CASE WHEN s % 2 = 0 THEN 2 ELSE 1 END WHEN n % 3 = 1 AND s % 2 = 0 THEN 1 ELSE 0 END AS hits,
  CASE WHEN s % 2 = 0 THEN 2 ELSE 1 END AS asked, n % 2 = 0 AS city, n = 4 AS key FROM l),
h AS (SELECT *, hits > 0 AND contains(CASE WHEN n = 4 THEN 'кн 59 01 ' || lpad(CAST(s AS VARCHAR), 7, '0') || ' ' || l_partkey ELSE '' END
    || CASE WHEN n % 2 = 0 THEN 'пермь ' || s ELSE '' END, CAST(s AS VARCHAR)) AS house FROM m),
x AS (SELECT *, CASE WHEN key THEN 100 ELSE 0 END + CASE matched WHEN 'analog' THEN 60 WHEN 'street' THEN 55 WHEN 'address' THEN 45 WHEN 'region' THEN 40 ELSE 0 END
  + CASE WHEN city THEN 20 ELSE 0 END + CASE WHEN asked >= 2 AND hits >= 2 THEN 50 WHEN asked = 1 AND hits = 1 THEN 30 ELSE 0 END
  + CASE WHEN house THEN 25 ELSE 0 END AS score,
  key::INT + (matched IS NOT NULL)::INT + city::INT + ((asked >= 2 AND hits >= 2) OR (asked = 1 AND hits = 1))::INT + house::INT + COALESCE(matched = 'street', FALSE)::INT AS reasons FROM h)
"""

LISTING_RELEVANCE_SQL = f"""
WITH {_LISTINGS_SQL}
SELECT CAST(score AS BIGINT) AS score, COALESCE(matched, '-') AS matched_by, key AS mentions_key, COUNT(*) AS n, CAST(MIN(reasons) AS BIGINT) AS reasons
FROM x WHERE key OR matched IS NOT NULL OR score >= 50 GROUP BY 1, 2, 3
"""


def listing_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Best match kind per listing id, street refinement, best score."""
    found = _line_listings(spark, sf).where("matched_by IS NOT NULL")
    once = matching.dedupe_matches(found)
    refined = matching.refine_by_street(
        once.withColumns({"city": addr.city(F.col("object_address")), "street_token": addr.street_token(F.col("object_address"))})
    )
    return refined.groupBy("object_key").agg(
        F.count("*").alias("kept"), F.count_if(F.col("matched_by") == "street").alias("on_street"), F.sum("seq").alias("seq_sum")
    )


LISTING_DEDUPE_SQL = f"""
WITH {_LISTINGS_SQL},
o AS (SELECT *, n % 3 = 0 AS street FROM x WHERE matched IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY s, l_partkey, l_suppkey % 5
    ORDER BY CASE matched WHEN 'analog' THEN 4 WHEN 'street' THEN 3 WHEN 'address' THEN 2 ELSE 1 END DESC, seq) = 1),
v AS (SELECT *, CASE WHEN street AND city THEN 2 WHEN street THEN 1 ELSE 0 END AS lvl FROM o),
b AS (SELECT *, MAX(lvl) OVER (PARTITION BY s, l_partkey) AS best FROM v)
SELECT '59:01:' || lpad(CAST(s AS VARCHAR), 7, '0') || ':' || l_partkey AS object_key, COUNT(*) AS kept,
  COUNT(*) FILTER (best > 0 OR matched = 'street') AS on_street, CAST(SUM(seq) AS BIGINT) AS seq_sum
FROM b WHERE lvl >= best GROUP BY 1
"""


def key_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Which suppliers' keys stand in line texts, in any written form."""
    key = F.concat_ws(":", F.lit("59"), F.lit("01"), F.lpad(_s("s_suppkey"), 7, "0"), _s(F.col("s_suppkey") % 7 + 1))
    objects = table(spark, sf, "supplier").select(key.alias("key"))
    k, n = F.col("l_suppkey"), F.col("l_linenumber")
    tail = _s(k % 7 + 1)
    wide = F.lpad(_s(k), 7, "0")
    text = (
        F.when(n == 1, _cat("объект 59:01:", wide, ":", tail, "."))
        .when(n == 2, _cat("объект 59-01-", wide, "-", tail))
        .when(n == 3, _cat("объект 59:01:", _s(k), ":", tail))
        .when(n == 4, _cat("кн ", wide, ":", tail, " и телефон 555-1234"))
        .when(n == 5, _cat("59 01 ", wide, " ", tail, " руб"))
        .otherwise(_cat("цена ", _s(k), " руб"))
    )
    docs = spread(table(spark, sf, "lineitem")).select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("doc"), text.alias("text")).distinct()
    return matching.mentions(docs, "doc", "text", objects, "key").groupBy("key").agg(F.count("*").alias("texts"))


KEY_MENTIONS_SQL = """
WITH k AS (SELECT '59:01:' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') || ':' || (s_suppkey % 7 + 1) AS key, lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS p2,
  s_suppkey AS p2s, s_suppkey % 7 + 1 AS p3 FROM supplier),
t AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber
   WHEN 1 THEN '59:01:' || lpad(CAST(l_suppkey AS VARCHAR), 7, '0') || ':' || (l_suppkey % 7 + 1)
   WHEN 2 THEN '59-01-' || lpad(CAST(l_suppkey AS VARCHAR), 7, '0') || '-' || (l_suppkey % 7 + 1)
   WHEN 3 THEN '59:01:' || l_suppkey || ':' || (l_suppkey % 7 + 1)
   WHEN 4 THEN lpad(CAST(l_suppkey AS VARCHAR), 7, '0') || ':' || (l_suppkey % 7 + 1)
   WHEN 5 THEN '59 01 ' || lpad(CAST(l_suppkey AS VARCHAR), 7, '0') || ' ' || (l_suppkey % 7 + 1) ELSE '' END AS text FROM lineitem),
u AS (SELECT text, COUNT(*) AS n FROM t GROUP BY text)
SELECT key, CAST(SUM(n) AS BIGINT) AS texts FROM k JOIN u ON contains(text, key) OR contains(text, replace(key, ':', ' ')) OR contains(text, replace(key, ':', '-'))
  OR contains(text, '59:01:' || p2s || ':' || p3) OR contains(text, p2 || ':' || p3) GROUP BY key
"""


def address_parts(spark: SparkSession, sf: str) -> DataFrame:
    """City, street, house, slug and kind of addresses made of customers."""
    k = F.col("c_custkey")
    a = F.when(k % 2 == 0, _cat("Российская Федерация, Пермский край, г. Город", _s("c_nationkey"), ", ул. Ленина ", _s(k % 50), ", д. ", _s(k))).otherwise(
        _cat("Тульская область, Узловая, Садовая улица, ", _s(k))
    )
    c = spread(table(spark, sf, "customer")).select("c_custkey", a.alias("a"), F.when(k % 3 == 0, F.lit("Здание")).otherwise(F.lit("Земельный участок")).alias("kind"))
    x = F.col("a")
    return c.select(
        "c_custkey", addr.city(x).alias("city"), addr.street(x).alias("street"), addr.house_number(x).alias("house"),
        addr.address_slug(x).alias("slug"), addr.short_address_slug(x).alias("short_slug"), addr.short_for_geocoding(x).alias("short"),
        addr.listing_kind(F.col("kind"), F.lit(None).cast("string")).alias("kind"), matching.region(F.lit("99:1"), x).alias("region"),
    )


ADDRESS_SQL = """
SELECT c_custkey, 'Город' || c_nationkey AS city, 'Ленина ' || (c_custkey % 50) AS street, CAST(c_custkey AS VARCHAR) AS house,
  'rossijskaya-federaciya-permskij-kraj-gorod-gorod' || c_nationkey || '-ulica-lenina-' || (c_custkey % 50) || '-' || c_custkey AS slug,
  'g-gorod' || c_nationkey || '-ul-lenina-' || (c_custkey % 50) || '-d-' || c_custkey AS short_slug,
  'Пермский край, г. Город' || c_nationkey || ', ул. Ленина ' || (c_custkey % 50) || ', ' || c_custkey AS short,
  CASE WHEN c_custkey % 3 = 0 THEN 'commercial' ELSE 'land' END AS kind, 'Пермский край' AS region FROM customer WHERE c_custkey % 2 = 0
UNION ALL
SELECT c_custkey, 'Узловая', 'Садовая', CAST(c_custkey AS VARCHAR), 'tulskaya-oblast-uzlovaya-sadovaya-ulica-' || c_custkey,
  'uzlovaya-sadovaya-ulica-' || c_custkey, 'Узловая, Садовая улица, ' || c_custkey,
  CASE WHEN c_custkey % 3 = 0 THEN 'commercial' ELSE 'land' END, 'Тульская область' FROM customer WHERE c_custkey % 2 <> 0
"""

# --- registry features and providers ---------------------------------------------------------


def registry_features(spark: SparkSession, sf: str) -> DataFrame:
    """Responses with two features per part: the right one picked, projected,
    its centre in degrees."""
    k, size = F.col("p_partkey"), F.col("p_size")
    sq = _cat("[[[", _s(size * 100), ",", _s(size * 100), "],[", _s(size * 100 + 400), ",", _s(size * 100), "],[", _s(size * 100), ",", _s(size * 100 + 400), "]]]")
    feature = lambda key, extra: _cat('{"properties":{"categoryName":"Cat","options":{"cad_num":"', key, '","address":"', F.col("p_name"), '"', extra, '}},"geometry":{"type":"Polygon","coordinates":', sq, "}}")
    extra = F.when(k % 2 == 0, _cat(',"land_record_area":', _s(size), ',"cost_value":"', _s(F.floor("p_retailprice")), '"')).otherwise(_cat(',"area":', _s(size + 1)))
    body = _cat('{"data":{"type":"FeatureCollection","features":[', feature(F.lit("other"), F.lit("")), ",", feature(_cat("59:01:1:", _s(k)), extra), "]}}")
    df = spread(table(spark, sf, "part")).select(k.alias("page"), _cat("59:01:1:", _s(k)).alias("asked"), body.alias("body"))
    picked = df.withColumn("feature", responses.pick_feature(responses.features_of(F.col("body")), F.col("asked")))
    out = responses.registry_object(picked, "feature", "asked", "page")
    return out.select(
        "page", "key", "address", "object_type", "area", "area_unit", "value", F.col("region_code").cast("bigint").alias("region_code"),
        F.round("location.lon", 6).alias("lon"), F.round("location.lat", 6).alias("lat"),
        F.size(F.get(F.get("polygons", F.lit(0)), F.lit(0))).cast("bigint").alias("vertices"),
    )


REGISTRY_FEATURES_SQL = """
WITH c AS (SELECT *, (p_size * 100 * 3 + 400) / 3.0::DOUBLE AS m FROM part)
SELECT p_partkey AS page, '59:01:1:' || p_partkey AS key, p_name AS address, 'Cat' AS object_type,
  CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size + 1 END::DOUBLE AS area, CASE WHEN p_partkey % 2 = 0 THEN 'кв. м' END AS area_unit,
  CASE WHEN p_partkey % 2 = 0 THEN floor(p_retailprice) END::DOUBLE AS value, 59::BIGINT AS region_code,
  round(m / 20037508.34 * 180.0, 6) AS lon, round(atan(sinh(m / 20037508.34 * pi())) * 180.0 / pi(), 6) AS lat, 3::BIGINT AS vertices FROM c
"""


def provider_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Two providers' payloads and decoder rows per customer, merged and
    enriched by id."""
    k = F.col("c_custkey")
    vin = _cat("XTA", F.lpad(_s(k), 14, "0"))
    c = spread(table(spark, sf, "customer")).select(_s(k).alias("query_key"), vin.alias("vin"), "c_mktsegment", "c_nationkey", k.alias("k"))
    history = F.when(F.col("k") % 3 == 0, F.lit('{"status":false,"message":"нет данных"}')).otherwise(
        _cat('{"status":true,"carData":{"model":"', F.col("c_mktsegment"), ' Mod', _s("c_nationkey"), '","year":', _s(F.col("k") % 20 + 2000), ',"volume":1598,"vin":"', F.col("vin"), '"}}')
    )
    report = F.when(F.col("k") % 5 == 0, F.lit('{"status":"ERROR","error":"NOT_FOUND"}')).otherwise(
        _cat('{"report":{"header":{"title":"', F.col("c_mktsegment"), ' Rep, 2011"},"pts_info":{"color":"синий","horse_power":"', _s(F.col("k") % 300 + 50), ' л.с."}}}')
    )
    h = vehicles.history_cards(c.withColumn("p", history), "p", "query_key", F.lit(True), "query_key").withColumns({"source": F.lit("history"), "priority": F.lit(1)})
    r = vehicles.report_cards(c.withColumn("p", report), "p", "query_key", "query_key").withColumns({"source": F.lit("report"), "priority": F.lit(2)})
    merged = vehicles.merge_sources(h.unionByName(r))
    variables = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("Make").alias("variable"), F.lit("Not Applicable").alias("value")),
        F.struct(F.lit(1).alias("pos"), F.lit("Doors").alias("variable"), F.lit("3").alias("value")),
        F.struct(F.lit(2).alias("pos"), F.lit("Doors").alias("variable"), _s(F.col("k") % 3 + 2).alias("value")),
        F.struct(F.lit(3).alias("pos"), F.lit("Turbo").alias("variable"), F.lit("Yes").alias("value")),
    )
    eav = c.where("k % 4 = 0").select(F.col("vin").alias("query_key"), F.explode(variables).alias("v")).select("query_key", "v.*")
    cards = vehicles.enrich_by_id(merged, vehicles.decoded_cards(eav))
    x = lambda key: F.try_element_at("extra", F.lit(key))
    return cards.select(
        "query_key", "make", "model", "model_year", "color", "power_hp", "displacement_l", "doors", "found", "source",
        F.array_join("sources_used", ",").alias("sources_used"), x("VIN").alias("vin"), x("Турбо").alias("turbo"), "lookup_error",
    )


PROVIDER_SQL = """
WITH c AS (SELECT *, c_custkey AS k, 'XTA' || lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS v, c_custkey % 3 <> 0 AS a, c_custkey % 5 <> 0 AS b FROM customer)
SELECT CAST(k AS VARCHAR) AS query_key, CASE WHEN a OR b THEN c_mktsegment END AS make, CASE WHEN a THEN 'Mod' || c_nationkey WHEN b THEN 'Rep' END AS model,
  CASE WHEN a THEN CAST(k % 20 + 2000 AS VARCHAR) WHEN b THEN '2011' END AS model_year, CASE WHEN b THEN 'cиний' END AS color,
  CASE WHEN b THEN CAST(k % 300 + 50 AS VARCHAR) END AS power_hp, CASE WHEN a THEN '1.598' END AS displacement_l,
  CASE WHEN a AND k % 4 = 0 THEN CAST(k % 3 + 2 AS VARCHAR) END AS doors, a OR b AS found, CASE WHEN a THEN 'history' WHEN b THEN 'report' ELSE 'history' END AS source,
  'history,report' AS sources_used, CASE WHEN a THEN v END AS vin, CASE WHEN a AND k % 4 = 0 THEN 'Yes' END AS turbo,
  CASE WHEN NOT a AND NOT b THEN 'нет данных' END AS lookup_error FROM c
"""

# --- questions and answers ----------------------------------------------------------------


def qa_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as workbook rows of the five sheets, mapped to question pairs."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    sheet = F.element_at(F.array(*[F.lit(r.sheet) for r in retrieval.SHEET_RULES]), (k % 5 + 1).cast("int"))
    word = lambda i: F.when((k + i) % 6 != 0, _cat(" w", _s(k % 97), "_", str(i), " ")).otherwise(F.lit(" "))
    cells = F.array(F.when(k % 7 == 0, F.lit("a question of some length here")).otherwise(word(0)), *[word(i) for i in range(1, 9)])
    rows = o.select(sheet.alias("sheet"), F.floor(k / 5).alias("row_no"), cells.alias("cells"))
    return retrieval.qa_corpus(rows).groupBy("sheet").agg(
        F.count("*").alias("pairs"), F.sum(F.length("question")).alias("q_chars"), F.sum(F.length("answer")).alias("a_chars"),
        F.count("ref_id").alias("refs"), F.countDistinct("id").alias("ids"),
    )


_W = "CASE WHEN (k + {i}) % 6 <> 0 THEN 'w' || (k % 97) || '_{i}' ELSE '' END"
QA_SQL = f"""
WITH r AS (SELECT o_orderkey AS k, o_orderkey % 5 AS s, o_orderkey // 5 AS n FROM orders),
c AS (SELECT *, [CASE WHEN k % 7 = 0 THEN 'a question of some length here' ELSE {_W.format(i=0)} END, {', '.join(_W.format(i=i) for i in range(1, 9))}] AS c FROM r),
a AS (SELECT s, n, k, CASE s WHEN 0 THEN c[7] WHEN 3 THEN c[8] ELSE c[1] END AS q, CASE s WHEN 0 THEN c[8] WHEN 3 THEN c[9]
    ELSE array_to_string(list_filter(c[2:], lambda x: x <> ''), chr(10) || '---' || chr(10)) END AS a,
  CASE s WHEN 0 THEN c[1] WHEN 3 THEN c[3] ELSE '' END AS ref FROM c)
SELECT CASE s WHEN 0 THEN 'ГЛ' WHEN 1 THEN 'Для ГЛ' WHEN 2 THEN 'Осмотры' WHEN 3 THEN 'Ошибки экспертов' ELSE 'Страховки' END AS sheet,
  COUNT(*) AS pairs, CAST(SUM(length(q)) AS BIGINT) AS q_chars, CAST(SUM(length(a)) AS BIGINT) AS a_chars, COUNT(*) FILTER (ref <> '') AS refs, COUNT(*) AS ids
FROM a WHERE q <> '' AND a <> '' AND NOT (s IN (0, 3) AND n = 0) AND (s <> 4 OR length(q) >= 20) GROUP BY s
"""


def money_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts as register and listing text."""
    p = F.round("o_totalprice", 2)
    return table(spark, sf, "orders").select(
        "o_orderkey",
        numbers.money_text(F.when(F.col("o_orderkey") % 2 == 0, p).otherwise(F.floor(p).cast("double"))).alias("money"),
        numbers.price_text(F.floor(p)).alias("price"),
    )


MONEY_SQL = """
WITH x AS (SELECT o_orderkey, CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS d FROM orders),
y AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN printf('%,.2f', CAST(d AS DOUBLE)) ELSE printf('%,.2f', CAST(floor(d) AS DOUBLE)) END AS t FROM x)
SELECT o_orderkey, regexp_replace(translate(t, ',.', ' ,'), ',00$', '') AS money,
  replace(printf('%,d', CAST(floor(d) AS BIGINT)), ',', chr(160)) || chr(160) || '₽' AS price FROM y
"""

QUERIES = {
    "request_exports": request_exports,
    "conclusion_fields": conclusion_fields,
    "short_form_risks": short_form_risks,
    "table_risks": table_risks,
    "risk_mitigation": risk_mitigation,
    "register_rows": register_rows,
    "cell_pairs": cell_pairs,
    "listing_table": listing_table,
    "registry_cards": registry_cards,
    "listing_relevance": listing_relevance,
    "listing_dedupe": listing_dedupe,
    "key_mentions": key_mentions,
    "address_parts": address_parts,
    "registry_features": registry_features,
    "provider_cards": provider_cards,
    "qa_pairs": qa_pairs,
    "money_texts": money_texts,
}
ORACLES = {
    "request_exports": REQUEST_EXPORTS_SQL,
    "conclusion_fields": CONCLUSION_SQL,
    "short_form_risks": SHORT_FORM_SQL,
    "table_risks": TABLE_RISKS_SQL,
    "risk_mitigation": RISK_MITIGATION_SQL,
    "register_rows": REGISTER_ROWS_SQL,
    "cell_pairs": CELL_PAIRS_SQL,
    "listing_table": LISTING_SQL,
    "registry_cards": REGISTRY_CARDS_SQL,
    "listing_relevance": LISTING_RELEVANCE_SQL,
    "listing_dedupe": LISTING_DEDUPE_SQL,
    "key_mentions": KEY_MENTIONS_SQL,
    "address_parts": ADDRESS_SQL,
    "registry_features": REGISTRY_FEATURES_SQL,
    "provider_cards": PROVIDER_SQL,
    "qa_pairs": QA_SQL,
    "money_texts": MONEY_SQL,
}
