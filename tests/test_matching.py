"""Relevance, radius, de-duplication, mentions, comparables, registries."""

import random

import pytest
from pyspark.sql import functions as F

from assetlens.operators import matching as m
from assetlens.operators import registry
from assetlens.operators.sums import running_sums
from assetlens.sources import html, responses

COLS = "object_key string, object_address string, source string, id string, url string, title string, address string, description string, distance string, matched_by string, seq int"
ADDRESS = "Пермский край, г. Пермь, ул. Большая Садовая, д. 5"


def listings(spark, *rows):
    base = dict(object_key="59:01:0001005:19", object_address=ADDRESS, source="s", id="1", url="", title="", address="", description="", distance=None, matched_by=None, seq=0)
    return spark.createDataFrame([tuple((base | r | {"seq": i}).values()) for i, r in enumerate(rows)], COLS)


def test_relevance_points(spark):
    df = listings(
        spark,
        dict(id="key", description="КН 59 01 0001005 19"),
        dict(id="analog", matched_by="analog", distance="3 км"),
        dict(id="full", title="дом, Большая Садовая 5", address="г. Пермь", matched_by="street"),
        dict(id="one", title="большая комната"),
        dict(id="house", title="дом 5"),
    )
    objects = df.select("object_key", "object_address").distinct()
    scored = m.with_relevance(df.drop("object_address"), objects)
    got = {r.id: (r.score, r.mentions_key, list(r.reasons)) for r in scored.collect()}
    assert got["key"][:2] == (100, True)
    assert got["analog"] == (60, False, ["аналог (3 км)"])
    assert got["full"][0] == 55 + 20 + 50 + 25
    assert got["one"][0] == 0  # one of two street words is not enough
    assert got["house"][0] == 0  # a house number needs a street word
    assert {r.id for r in m.keep_relevant(scored).collect()} == {"key", "analog", "full"}


def test_best_listing_wins_and_ties_keep_the_first(spark):
    df = listings(spark, dict(id="a", title="x"), dict(id="a", title="y"), dict(id="a", title="z"), dict(id="", url="u"))
    df = df.withColumn("score", F.when(F.col("title") == "x", 1).when(F.col("title").isin("y", "z"), 5))
    assert {(r.id, r.title) for r in m.dedupe_listings(df).collect()} == {("a", "y"), ("", "")}


def test_match_rank(spark):
    df = listings(spark, dict(id="a", matched_by="region"), dict(id="a", matched_by="street"), dict(id="a", matched_by="analog"), dict(id="b", matched_by="address"))
    assert {(r.id, r.matched_by) for r in m.dedupe_matches(df).collect()} == {("a", "analog"), ("b", "address")}


def test_first_by_link(spark):
    df = listings(spark, dict(url="u", title="1"), dict(url="u", title="2"), dict(url="", title="t"), dict(url="", title="t"))
    assert [r.seq for r in m.first_by_link(df).orderBy("seq").collect()] == [0, 2]


@pytest.mark.parametrize(
    "km, radius, kept", [([10, 25, 40, 80], 50, 3), ([5, 12, 28, 45], 30, 3), ([28, 29, 51, 80], 100, 4), ([200], 100, 0)]
)
def test_adaptive_radius(spark, km, radius, kept):
    rows = [dict(id=str(i), distance=f"{d},0 км") for i, d in enumerate(km)]
    rows += [dict(id="street", matched_by="street"), dict(id="region", matched_by="region")]
    out = m.within_radius(listings(spark, *rows)).collect()
    assert {r.radius_km for r in out} == {radius}
    assert sorted(r.id for r in out if r.distance_km is None) == ["street"]
    assert sum(r.distance_km is not None for r in out) == kept


def test_street_refinement(spark):
    df = listings(
        spark,
        dict(id="1", address="Пермь, Большая Садовая", matched_by="address"),
        dict(id="2", address="Кунгур, Большая Садовая", matched_by="street"),
        dict(id="3", address="Пермь", matched_by="address"),
    ).withColumns({"city": F.lit("Пермь"), "street_token": F.lit("Большая Садовая")})
    assert {(r.id, r.matched_by) for r in m.refine_by_street(df).collect()} == {("1", "street")}
    far = df.where("id <> '1'")
    assert {r.id for r in m.refine_by_street(far).collect()} == {"2"}
    off = df.where("id = '3'")
    assert {(r.id, r.matched_by) for r in m.refine_by_street(off).collect()} == {("3", "address")}


def test_mentions_equal_brute_force(spark):
    rng = random.Random(3)
    keys = [f"{rng.randint(1, 3)}:{rng.randint(1, 9):02d}:{rng.randint(1, 40):07d}:{rng.randint(1, 30)}" for _ in range(40)]
    seps = [":", " ", "-"]
    texts = []
    for i in range(300):
        k = rng.choice(keys).split(":")
        if rng.random() < 0.3:
            k[2] = str(int(k[2]))
        part = rng.choice([k, k[2:], k[1:]])
        # digits may run on at either end
        texts.append((i, "x " + rng.choice(["", "1", "9 "]) + rng.choice(seps).join(part) + rng.choice(["", "7", " 5", "."])))
    docs = spark.createDataFrame(texts, "d int, t string")
    objects = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {(r.doc_id, r.key) for r in m.mentions(docs, "d", "t", objects, "k").collect()}

    def variants(k):
        p = k.split(":")
        return {k, k.replace(":", " "), k.replace(":", "-"), ":".join([p[0], p[1], str(int(p[2])), p[3]]), ":".join(p[2:])}

    want = {(i, k) for i, t in texts for k in set(keys) if any(v in t for v in variants(k))}
    assert got == want and want


def test_comparables_equal_brute_force(spark):
    rng = random.Random(5)
    objects = [(i, rng.choice("ab"), float(rng.randint(1, 60)), float(rng.randint(30, 130))) for i in range(60)]
    offers = [(i, rng.choice("abc"), float(rng.randint(1, 120))) for i in range(200)] + [(900 + i, "a", 50.0) for i in range(200)]
    o = spark.createDataFrame(objects, "oid int, g string, low double, high double")
    p = spark.createDataFrame(offers, "pid int, g string, v double")
    want = {(i, j) for i, g, lo, hi in objects for j, h, v in offers if g == h and lo <= v <= hi}
    assert {(r.oid, r.pid) for r in m.comparables(o, p, ["g"], "low", "high", "v").collect()} == want
    for width in (0.01, 0.2, 5.0):
        totals = {r.oid: (r.comparables, r.value_sum) for r in m.comparable_totals(o, p, ["g"], "low", "high", "v", width).collect()}
        for i, g, lo, hi in objects:
            hit = [v for _, h, v in offers if h == g and lo <= v <= hi]
            assert totals[i] == (len(hit), sum(hit)) or lo > hi


def test_running_sums_over_one_hot_key(spark):
    df = spark.range(1000).select(F.lit("hot").alias("k"), "id", F.lit(1).alias("n"))
    got = [r.n_upto for r in running_sums(df, ["k"], "id", [], ["n"], 0.01).orderBy("id").collect()]
    assert got == list(range(1, 1001))


def test_area_range(spark):
    df = spark.createDataFrame([(1000.0, True), (100.0, False), (0.0, True), (None, False)], "a double, land boolean")
    got = [tuple(r[0]) for r in df.select(m.area_range(F.col("a"), F.col("land"))).collect()]
    assert got == [(7.0, 13.0), (70.0, 130.0), (None, None), (None, None)]


def test_regions(values):
    given = ["76:17:010101:15", "04:01:010101:1", "77:07:0015009:12", "99:1"]
    assert values(m.region(F.col("x"), F.lit("Самарская обл., Тольятти")), given) == ["Ярославская область", "Алтай", "Москва", "Самарская область"]


def test_fallback_point(spark):
    o = spark.createDataFrame([("a", "адрес", None, None), ("b", "адрес", 1.0, 2.0), ("c", "нет", None, None)], "k string, address string, lon double, lat double")
    g = spark.createDataFrame([("адрес", 37.0, 55.0)], "address string, lon double, lat double")
    got = {r.k: (r.lon, r.lat, r.approximate) for r in m.with_fallback_point(o, g, "address", "lon", "lat").collect()}
    assert got == {"a": (37, 55, True), "b": (1, 2, False), "c": (None, None, False)}


def test_reconciliation(spark):
    cols = "key string, address string, object_type string, area double, value double, found boolean"
    a = spark.createDataFrame([("1", "Пермь,  Мира 1", "Земельный участок", 100.0, 5.0, True), ("2", "x", None, 1.0, None, True), ("3", None, None, None, None, True), ("4", "x", None, None, None, True)], cols)
    b = spark.createDataFrame([("1", "пермь, мира 1", "участок", 100.001, 5.5, True), ("2", "y", "t", 2.0, 1.0, True), ("3", "z", None, None, None, True), ("5", "x", None, None, None, True)], cols)
    got = {r.key: (r.status, r.matched, r.total) for r in registry.reconcile(a, b).collect()}
    assert got == {"1": ("ok", 4, 4), "2": ("warning", 0, 2), "3": ("partial", 0, 0), "4": ("partial", 0, 0), "5": ("partial", 0, 0)}
    counts = {r.status: r.objects for r in registry.verdict_counts(registry.reconcile(a, b)).collect()}
    assert counts == {"ok": 1, "warning": 1, "partial": 3}
    fields = {r.field: (r.same, r.different) for r in registry.field_counts(registry.reconcile(a, b)).collect()}
    assert fields["address"] == (1, 1) and fields["object_type"] == (1, 0)


def test_response_outcomes(spark):
    df = spark.createDataFrame(
        [("OK", 200), ("", 200), ("not-json", 200), ('{"data":{"type":"FeatureCollection","features":[{"a":1}]}}', 200), ('{"code":204}', 404), ('{"message":"Не найден"}', 404), ('{"code":500}', 404), (None, 200)],
        "b string, s int",
    )
    got = [r[0] for r in df.select(responses.outcome(F.col("b"), F.col("s"))).collect()]
    assert got == ["broken", "broken", "broken", "found", "not found", "not found", "broken", "broken"]


def test_geometry(values):
    point = '{"type":"Point","coordinates":[37.5,55.7]}'
    poly = '{"type":"Polygon","coordinates":[[[4187000,7508000],[4187000,7508000]]],"crs":{"properties":{"name":"EPSG:3857"}}}'
    got = values(responses.location_of(F.col("x")), [point, poly, "{}", None])
    assert (got[0].lon, got[0].lat) == (37.5, 55.7)
    assert (round(got[1].lon, 6), round(got[1].lat, 6)) == (37.612461, 55.745915)
    assert got[2] is None and got[3] is None


def test_related_objects_first_group_wins(spark):
    a = '{"object":[{"title":"Здания:","value":["1","2"]},{"title":"Пусто","value":[]}]}'
    b = '{"object":[{"title":"Участки","value":["2","3",""]}]}'
    df = spark.createDataFrame([("k", a, b)], "key string, t1 string, t2 string")
    assert {(r.related_key, r.group) for r in responses.related_objects(df, "key", ["t1", "t2"]).collect()} == {("1", "Здания"), ("2", "Здания"), ("3", "Участки")}


def test_outbound_link(values):
    labelled = '<b>Ссылка на объявление</b> <a href="https://x.example/1">'
    listed = '<a href="https://other.example"><a href="https://www.cian.ru/2">'
    assert values(html.outbound_link(F.col("x")), [labelled, listed, "<a>"]) == ["https://x.example/1", "https://www.cian.ru/2", None]


def test_a_long_run_of_digits_offers_no_more_than_a_short_one(spark):
    docs = spark.createDataFrame([(1, "7" * 100_000 + ":" + "8" * 100_000), (2, "77:01:0001005:12 here")], "doc_id int, text string")
    keys = spark.createDataFrame([("77:01:0001005:12",)], "key string")
    assert [tuple(r) for r in m.mentions(docs, "doc_id", "text", keys, "key").collect()] == [(2, "77:01:0001005:12")]
