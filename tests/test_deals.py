"""Deal files, classifier, statistics, search."""

import gzip

import pytest
from pyspark.sql import functions as F

from assetlens.operators import classifier, deals
from assetlens.sources import codes as code_source
from assetlens.sources import deal_files

CODES = {
    "204001000000": "Нежилое", "204002000000": "Жилое", "206002000000": "Жилое", "206001000000": "Нежилое",
    "061001001001": "Кирпичные", "061001006000": "Бетонные", "002001003000": "Помещение", "002001001000": "Земельный участок",
}


@pytest.fixture(scope="module")
def codes(spark):
    return spark.createDataFrame([(c, v, i) for i, (c, v) in enumerate(CODES.items())], "code string, label string, pos int")


def _line(sep="~", **fields):
    row = {c: "" for c in deal_files.DEAL_COLUMNS} | fields
    return sep.join(f'"{v}"' for v in row.values())


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    folder = tmp_path_factory.mktemp("landing")
    head = "~".join(deal_files.DEAL_COLUMNS)
    a = [
        head,
        _line(number="1", quarter_cad_number="77:05:0001005", deal_price="1 000", area="10,5", realestate_type_code="002001003000", purpose_code="206002000000", city="Москва", street="Мира"),
        "",
        "too~short",
        _line(number="2", quarter_cad_number="77:05:0001005", deal_price="1000,5", area="", realestate_type_code="002001001000") + "~extra",
        "a~b~c~d~e~99:01:1~g",
    ]
    (folder / "dataset_СДЕЛКИ_r-r_01-92_y_2025_q_4.csv").write_text("\n".join(a), encoding="utf-8")
    b = [head.replace("~", ";"), _line(";", number="3", quarter_cad_number="77:05:0001006", deal_price="500", area="5", realestate_type_code="2001003000", wall_material_code="x")]
    with gzip.open(folder / "dataset_АРЕНДА_r-r_01-92_y_2025_q_3.csv.gz", "wt", encoding="utf-8") as f:
        f.write("\r\n".join(b))
    with gzip.open(folder / "dataset_СДЕЛКИ_r-r_01-92_y_2025_q_4.csv.gz", "wt", encoding="utf-8") as f:
        f.write("never read")
    return str(folder)


def test_catalogue_prefers_plain_text(spark, landing):
    rows = deal_files.catalogue(spark, [landing]).collect()
    assert [(r.kind, r.sort_key, r.path.endswith(".gz")) for r in rows] == [("deal", 202504, False), ("rent", 202503, True)]
    assert rows[0].period_short_label == "4 кв 2025"
    assert [r.year for r in deal_files.available_years(deal_files.catalogue(spark, [landing])).collect()] == [2025]


def _paths(spark, landing):
    return [r.path for r in deal_files.catalogue(spark, [landing]).collect()]


def test_scan_keeps_full_rows_of_both_delimiters(spark, landing):
    rows = {r.number: r for r in deal_files.scan_deals(spark, _paths(spark, landing)).collect()}
    assert set(rows) == {"1", "2", "3"}
    assert rows["1"].city == "Москва" and rows["1"].okato is None and rows["1"].kind == "deal"
    assert rows["3"].kind == "rent" and rows["3"].quarter == 3
    # two columns only: short rows must still be dropped
    assert deal_files.scan_deals(spark, _paths(spark, landing)).select("number").count() == 3


def test_quarter_index_covers_short_rows(spark, landing):
    index = deal_files.quarter_index(deal_files.scan_lines(spark, _paths(spark, landing)))
    assert {r.quarter_cad_number for r in index.collect()} == {"77:05:0001005", "77:05:0001006", "99:01:1"}


def test_enrich_and_categories(spark, landing, codes):
    rows = {r.number: r for r in deals.enrich(deal_files.scan_deals(spark, _paths(spark, landing)), codes).collect()}
    assert rows["1"].category == "flat" and rows["1"].unit_price == 95 and rows["1"].location_label == "Москва, Мира"
    assert rows["1"].realestate_type_label == "Помещение" and rows["1"].purpose_label == "Жилое"
    assert rows["2"].category == "land" and rows["2"].deal_price is None and rows["2"].unit_price is None
    assert rows["3"].category == "nonres" and rows["3"].realestate_type_label == "Помещение" and rows["3"].wall_material_label == "x"


def test_category_rules(spark):
    df = spark.createDataFrame(
        [(classifier.PREMISES, "residential"), (classifier.PREMISES, None), (classifier.BUILDING, None), (classifier.BUILDING, "nonresidential"), ("?", None), (classifier.PARKING, None)],
        "t string, p string",
    )
    got = [r[0] for r in df.select(classifier.deal_category(F.col("t"), F.col("p"))).collect()]
    assert got == ["flat", "nonres", "house", "nonres", "nonres", "parking"]


def test_code_lookup_stages(spark, codes):
    df = spark.createDataFrame([("204001000000",), ("61001001001",), ("00061001001001",), ("nope",), (None,), ("",)], "c string")
    got = {r.c: r.label for r in classifier.with_label(df, "c", "label", codes).collect()}
    assert got == {"204001000000": "Нежилое", "61001001001": "Кирпичные", "00061001001001": "Кирпичные", "nope": "nope", None: None, "": None}


def test_code_lists_keep_order(spark, codes):
    df = spark.createDataFrame([("061001001001;061001006000",), ("x; 061001006000 ;",), (None,)], "c string")
    got = {r.c: r.label for r in classifier.with_label_list(df, [], "c", "label", codes).collect()}
    assert got["061001001001;061001006000"] == "Кирпичные; Бетонные"
    assert got["x; 061001006000 ;"] == "x; Бетонные" and got[None] is None


def test_price_stats(spark):
    df = spark.createDataFrame([(100.0, 10.0), (300.0, None), (None, 5.0), (0.0, 4.0), (200.0, 30.0)], "p double, area double")
    df = df.select(F.col("p").cast("decimal(18,2)").alias("deal_price"), "area", F.lit("flat").alias("category"))
    r = deals.price_stats(df).first()
    assert (r.deals, r.with_price, r.price_min, r.price_max, r.price_avg, r.price_sum, r.unit_price_avg) == (5, 3, 100, 300, 200, 600, 8)
    by = {x.category: x for x in deals.price_stats_by_category(df).collect()}
    assert set(by) == {*classifier.CATEGORIES, "all"}
    assert by["parking"].deals == 0 and by["parking"].price_avg is None and by["all"].deals == 5


def test_stats_do_not_depend_on_partitioning(spark):
    df = spark.range(5000).select(
        (F.rand(1) * 1000).cast("decimal(18,2)").alias("deal_price"), (F.rand(2) * 100).alias("area"),
        F.when(F.col("id") % 3 == 0, "flat").otherwise("land").alias("category"),
    )
    df = df.persist()
    one = {tuple(r) for r in deals.price_stats_by_category(df.coalesce(1)).collect()}
    many = {tuple(r) for r in deals.price_stats_by_category(df.repartition(50)).collect()}
    df.unpersist()
    assert one == many


def test_vocabularies():
    assert deals.kinds_from_words(["Сделки", "аренда", "?"]) == ["deal", "rent"]
    assert deals.kinds_from_words(["?"]) is None and deals.kinds_from_words(None) is None
    assert deals.types_from_words(["ЗУ", "building", classifier.PREMISES]) == [classifier.LAND, classifier.BUILDING, classifier.PREMISES]


def test_serving_table_and_search(spark, landing, codes, tmp_path):
    enriched = deals.enrich(deal_files.scan_deals(spark, _paths(spark, landing)), codes)
    deal_files.write_serving_table(enriched, str(tmp_path / "serving"))
    stored = spark.read.parquet(str(tmp_path / "serving"))
    rows, stats, summary = deals.search(stored, "77:5:0001005", year=2025, limit=1)
    assert [r.number for r in rows.collect()] == ["1"]  # a null price sorts last
    s = summary.first()
    assert (s.total, s.shown, s.truncated, s.message) == (2, 1, True, None)
    assert {r.category: r.deals for r in stats.collect()}["all"] == 2
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(quarter_cad_number,77:05:0001005)" in plan and "PartitionFilters: [isnotnull(year" in plan
    with pytest.raises(ValueError):
        deals.quarter_argument("77:05")


def test_index_pruning(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "dataset_file string")
    index = spark.createDataFrame([("a", "77:05:1"), ("b", "77:05:2")], "dataset_file string, quarter_cad_number string")
    assert {r.dataset_file for r in deals.index_prunes(files, index, "77:05:1").collect()} == {"a", "c"}


def test_code_mining_last_wins(spark):
    book = spark.createDataFrame([("Классификационный код\n 204001000000 Нежилое  помещение\n 61001000000 Стены СПРАВОЧНИК видов\n 204001000000 Нежилое 204009000000 X",)], "text string")
    got = {r.code: r.label for r in code_source.mine_codes(book).collect()}
    assert got["204001000000"] == "Нежилое" and got["061001000000"] == "Стены"
    assert "204009000000" not in got and got["002001009000"] == "Машино-место"


def test_changed_files(spark):
    now = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "path string, length int, modificationTime int")
    before = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "path string, length int, modificationTime int")
    assert [r.path for r in deal_files.changed_files(now, before).collect()] == ["b"]


def test_file_gate(spark, tmp_path):
    (tmp_path / "page.csv").write_text("<!DOCTYPE html>" + "x" * 2000)
    (tmp_path / "good.csv").write_text("a~b\n" + "я" * 2000, encoding="utf-8")
    (tmp_path / "small.csv").write_text("a~b")
    (tmp_path / "book.xlsx").write_bytes(b"PK" + b"\0" * 600)
    (tmp_path / "~$book.xlsx").write_bytes(b"PK" + b"\0" * 600)
    (tmp_path / "doc.pdf").write_bytes(b"%PDX-1")
    got = {r.file_name: r.reason for r in deal_files.file_gate(spark, str(tmp_path)).collect()}
    assert got == {
        "page.csv": "html page", "good.csv": None, "small.csv": "too small", "book.xlsx": None,
        "~$book.xlsx": "temporary file", "doc.pdf": "not a pdf",
    }


def test_union_and_difference(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x")], "k int, v string")
    assert sorted(tuple(r) for r in deals.difference(a, b).collect()) == [(1, "x"), (2, "y")]
    both = deals.union_periods(a, b.withColumn("extra", F.lit(1)))
    assert both.count() == 4 and both.columns == ["k", "v", "extra"]
    assert {(r.k, r["count"]) for r in deals.counts_by_key(a, "k").collect()} == {(1, 2), (2, 1)}


def test_json_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "я")], "k int, v string")
    deal_files.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().v == "я"
    assert deal_files.as_json(df).first().document == '{"k":1,"v":"я"}'


def test_code_dictionary_from_json(spark, tmp_path):
    (tmp_path / "codes.json").write_text('{"source": "x",\n "codes": {"1": "a", "02": "b"}}', encoding="utf-8")
    rows = code_source.read_code_dictionary(spark, str(tmp_path / "codes.json")).collect()
    assert [(r.code, r.label) for r in sorted(rows, key=lambda r: r.pos)] == [("1", "a"), ("02", "b")]
