"""Incremental forms: only new files are loaded, restarts do nothing."""

import datetime as dt

from pyspark.sql import functions as F

from assetlens.sources import deal_files
from assetlens.streaming import batches, ingest, latest, live


def _file(folder, name, *numbers):
    rows = ["~".join(deal_files.DEAL_COLUMNS)]
    for n in numbers:
        values = {c: "" for c in deal_files.DEAL_COLUMNS} | {"number": n, "quarter_cad_number": "77:05:1"}
        rows.append("~".join(f'"{v}"' for v in values.values()))
    rows.append("short~row")
    (folder / name).write_text("\n".join(rows), encoding="utf-8")


def test_two_runs_add_only_the_new_file(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        ingest.append_available(ingest.stream_deals(spark, str(land)), out, check, ("year",)).awaitTermination()
        return sorted((r.number, r.kind, r.sort_key) for r in spark.read.parquet(out).collect())

    _file(land, "dataset_СДЕЛКИ_y_2025_q_1.csv", "1", "2")
    _file(land, "other.txt", "9")
    assert run() == [("1", "deal", 202501), ("2", "deal", 202501)]
    assert len(run()) == 2
    _file(land, "dataset_АРЕНДА_y_2025_q_2.csv", "3")
    assert run() == [("1", "deal", 202501), ("2", "deal", 202501), ("3", "rent", 202502)]


def test_latest_state_with_time_to_live(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    t = dt.datetime(2026, 1, 1, 10)
    schema = "k string, at timestamp, found boolean, v int"

    def feed(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        latest.keep_latest(stream, "k", "at", out, check).awaitTermination()

    feed(("a", t, True, 1), ("a", t + dt.timedelta(minutes=5), False, 2), ("b", t - dt.timedelta(hours=3), True, 3))
    feed(("a", t + dt.timedelta(minutes=30), True, 4))
    now = F.lit(t + dt.timedelta(minutes=40))
    got = latest.read_fresh(spark, out, "k", "at", now, 3600)
    assert [(r.k, r.v) for r in got.collect()] == [("a", 4)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "hour" in plan


def test_live_days_close_with_the_watermark(spark, tmp_path):
    t = dt.datetime(2026, 1, 1, 10)
    rows = [(t, "mdo", 20, True, 4), (t, "mdo", 150, False, None), (t + dt.timedelta(days=3), "mdo", 20, False, 1)]
    schema = "ts timestamp, line string, minutes int, overdue boolean, csi int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    ingest.append_available(live.daily_line_kpis(stream), out, str(tmp_path / "check")).awaitTermination()
    got = [(str(r.day), r.apps, r.minutes, r.overdue, r.csi_4) for r in spark.read.parquet(out).collect()]
    assert got == [("2026-01-01", 2, 170, 1, 1)]


def test_folders_stay_few_and_rows_the_same(spark, tmp_path):
    """Many batches, one of them run twice, merged level by level."""
    root, want = str(tmp_path / "b"), {}
    merge = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"), F.max("t").alias("t"))
    for i in range(40):
        rows = [(i % 5, i), (7, 1)]
        df = spark.createDataFrame([(k, n, i) for k, n in rows], "k int, n int, t int").groupBy("k").agg(F.sum("n").alias("n"), F.max("t").alias("t"))
        for _ in range(2 if i in (9, 33) else 1):
            batches.keep(df, i, root, merge, fan=3)
        for k, n in rows:
            want[k] = want.get(k, 0) + n
    assert {r.k: r.n for r in merge(batches.read(spark, root)).collect()} == want
    live_folders = batches.folders(spark, root)
    assert len(live_folders) <= 3 * 4 and max(f["level"] for f in live_folders) >= 3
    assert sorted(i for f in live_folders for i in (f["first"], f["last"]) if f["first"] == f["last"])[-1] == 39
    assert len(list((tmp_path / "b/data").iterdir())) <= len(live_folders) + 3 * batches.KEPT
    assert len([f for f in (tmp_path / "b/versions").iterdir() if not f.name.startswith(".")]) <= batches.KEPT


def test_days_and_late_rows_are_the_whole_input(spark, tmp_path):
    source, root, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    day = lambda d, h: dt.datetime(2026, 1, d, h)
    schema = "ts timestamp, line string, minutes int, overdue boolean, csi int"
    for rows in (
        [(day(1, 9), "a", 20, True, 5), (day(1, 10), "b", 30, False, None)],
        [(day(3, 8), "a", 10, False, 1), (day(1, 11), "a", 40, False, 5)],  # day 1 is open until a batch after this one
        [(day(1, 12), "a", 99, True, 2), (day(2, 1), "a", 1, False, None), (None, "b", 5, False, None)],
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        live.keep_days(spark.readStream.schema(schema).parquet(source), root, check).awaitTermination()
    got = sorted((str(r.day), r.line, r.apps, r.minutes, r.overdue, r.csi_5, r.closed) for r in live.read_days(spark, root).collect())
    assert got == [
        ("2026-01-01", "a", 2, 60, 1, 2, True), ("2026-01-01", "b", 1, 30, 0, 0, True), ("2026-01-02", "a", 1, 1, 0, 0, False), ("2026-01-03", "a", 1, 10, 0, 0, False),
    ]
    assert sorted((r.minutes, r.line) for r in live.read_late(spark, root).collect()) == [(5, "b"), (99, "a")]
