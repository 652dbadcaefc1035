"""Routing, validation, correction, providers, merge, cache."""

import datetime as dt
import random

from pyspark.sql import functions as F

from assetlens.operators import vehicles as v


def test_routing(spark):
    df = spark.createDataFrame([(1, "a123aa77"), (2, "# note"), (3, "VIN1; VIN2,,"), (4, "  "), (5, None)], "i int, line string")
    got = [(r.i, r.query, r.kind) for r in v.route_queries(df, "line", "i").orderBy("i", "pos").collect()]
    assert got == [(1, "А123АА77", "plate"), (3, "VIN1", "vin"), (3, "VIN2", "vin")]
    flagged = v.with_batch_check(spark.range(60).select(F.when(F.col("id") < 51, "a").otherwise("b").alias("batch")), "batch")
    assert {(r.batch, r.batch_too_large) for r in flagged.distinct().collect()} == {("a", True), ("b", False)}


def test_report(spark):
    df = spark.createDataFrame([("1HGCM82633A004352",), ("1hgcm82633a004353",), (None,)], "raw string")
    good, bad, none = v.vin_report(df, "raw").collect()
    assert good.valid and (good.wmi, good.vds, good.vis) == ("1HG", "CM8263", "3A004352") and good.expected_digit == "3"
    assert not bad.valid and not bad.structure_ok and (bad.expected_digit, bad.actual_digit) == ("5", "3")
    assert not none.valid and [i.code for i in none.issues] == ["empty"]
    tally = {r.code: r.issues for r in v.issue_tally(v.vin_report(df, "raw")).collect()}
    assert tally["empty"] == 1 and tally["lowercase"] == 1


def test_confusable_steps(spark):
    base = "XTA21901HC0123456"
    known = ["XTA21901MC0123456", "XTA21901NC0123456", "XTA21901HC0123496", "XTA21901HC5123496", "XTA21901HC5123459", base, "SHORT"]
    df = spark.createDataFrame([(k,) for k in known], "vin string")
    got = {r.candidate: (r.steps, r.changed) for r in v.confusable(df.where(F.col("vin") == base), df).collect()}
    assert got == {"XTA21901MC0123456": (2, 1), "XTA21901NC0123456": (1, 1), "XTA21901HC5123459": (2, 2)}
    best = v.best_correction(v.confusable(df.where(F.col("vin") == base), df)).first()
    assert (best.candidate, best.steps) == ("XTA21901NC0123456", 1)


def test_confusable_equals_brute_force(spark):
    rng = random.Random(1)
    groups = [set("8B"), set("NHM"), set("PR"), set("VW"), set("69"), set("50"), set("2Z")]
    near = {("H", "M"), ("M", "H")}
    chars = "8BNHMPRVW69502Z"
    seed = ["".join(rng.choice(chars) for _ in range(17)) for _ in range(12)]
    ids = set(seed)
    for s in seed:
        for _ in range(12):
            t = list(s)
            for _ in range(rng.randint(1, 4)):
                i = rng.randrange(17)
                t[i] = rng.choice([c for g in groups if t[i] in g for c in g])
            ids.add("".join(t))

    def steps(a, b):
        n = 0
        for x, y in zip(a, b):
            if x == y:
                continue
            if not any(x in g and y in g for g in groups):
                return None
            n += 2 if (x, y) in near else 1
        return n

    want = {(a, b, steps(a, b)) for a in ids for b in ids if a != b and (steps(a, b) or 9) <= 3}
    df = spark.createDataFrame([(i,) for i in ids], "vin string")
    rows = v.confusable(df, df).collect()
    assert {(r.vin, r.candidate, r.steps) for r in rows} == want and len(rows) == len(want)


def _row(spark, *rows):
    fields = ("query_key", "source", "priority", "fetched_at", "make", "model", "model_year", "vehicle_type", "extra", "found", "lookup_error")
    types = "query_key string, source string, priority int, fetched_at timestamp, make string, model string, model_year string, vehicle_type string, extra map<string,string>, found boolean, lookup_error string"
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], types)


F4 = ("make", "model", "model_year", "vehicle_type")


def test_merge(spark):
    df = _row(
        spark,
        dict(query_key="k", source="a", priority=1, make="", model="M", extra={"x": "1"}, found=False, lookup_error="e"),
        dict(query_key="k", source="b", priority=2, make="B", model="N", extra={"x": "2", "y": "3"}, found=True),
        dict(query_key="k", source="c", priority=3, model_year="1999", found=False),
        dict(query_key="q", source="a", priority=1, found=False, lookup_error="пусто"),
    )
    got = {r.query_key: r for r in v.merge_sources(df, F4).collect()}
    k = got["k"]
    assert (k.make, k.model, k.model_year, k.extra, k.sources_used, k.found, k.source, k.lookup_error) == (
        "B", "M", None, {"x": "1", "y": "3"}, ["a", "b", "c"], True, "b", None,
    )
    assert (got["q"].found, got["q"].lookup_error) == (False, "пусто")


def test_waterfall(spark):
    df = _row(
        spark,
        dict(query_key="hit", source="a", priority=1, lookup_error="HTTP 429"),
        dict(query_key="hit", source="b", priority=2, make="B", found=True),
        dict(query_key="limit", source="a", priority=1, lookup_error="пусто"),
        dict(query_key="limit", source="b", priority=2, lookup_error="слишком много запросов"),
        dict(query_key="hard", source="a", priority=1, lookup_error="csrf"),
        dict(query_key="hard", source="b", priority=2, lookup_error="сервис недоступен"),
        dict(query_key="soft", source="a", priority=1, lookup_error="пусто 1"),
        dict(query_key="soft", source="b", priority=2, lookup_error="пусто 2"),
        dict(query_key="none", source="a", priority=1),
    )
    got = {r.query_key: (r.source, r.found, r.lookup_error) for r in v.waterfall(df).collect()}
    assert got == {
        "hit": ("b", True, None), "limit": ("b", False, "слишком много запросов"), "hard": ("b", False, "сервис недоступен"),
        "soft": ("b", False, "пусто 2"), "none": ("a", False, v.NOT_FOUND),
    }
    report = v.batch_report(v.waterfall(df)).first()
    assert tuple(report) == (5, 1, 4)


def test_cache(spark):
    t = dt.datetime(2026, 1, 1, 12)
    df = _row(
        spark,
        dict(query_key="a", source="s", fetched_at=t, found=True, make="old"),
        dict(query_key="a", source="s", fetched_at=t + dt.timedelta(minutes=30), found=True, make="new"),
        dict(query_key="a", source="s", fetched_at=t + dt.timedelta(minutes=50), found=False),
        dict(query_key="b", source="s", fetched_at=t, found=True),
    )
    now = F.lit(t + dt.timedelta(minutes=61))
    assert [(r.query_key, r.make) for r in v.fresh_cache(df, "query_key", "fetched_at", now).collect()] == [("a", "new")]
    assert v.latest_per_source(df).count() == 2


def test_decoder(spark):
    rows = [("k", 0, "Make", "LADA"), ("k", 1, "Make", "null"), ("k", 2, "Model", "Vesta"), ("k", 3, "Turbo", "Yes"), ("k", 4, "Turbo", "N/A"), ("k", 5, "Error Code", "0"), ("e", 0, "Make", "X"), ("e", 1, "Error Code", "7"), ("e", 2, "", "y")]
    got = {r.query_key: r for r in v.decoded_cards(spark.createDataFrame(rows, "query_key string, pos int, variable string, value string")).collect()}
    assert (got["k"].make, got["k"].model, got["k"].extra, got["k"].found) == (None, "Vesta", {"Турбо": "Yes"}, True)
    assert got["e"].found is False


def test_messages(spark):
    r = spark.range(1).select(v.correction_message(F.lit("NEW"), v.vehicle_title(F.lit("LADA"), F.lit(""), F.lit("2020")), F.lit(2))).first()[0]
    assert r.endswith("информация: LADA 2020. (исправлено символов: 2)") and "NEW" in r
