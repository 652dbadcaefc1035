"""Stored sketches: within the stated error, additive, appended once."""

from pyspark.sql import functions as F

from assetlens.sources import key_sketches as ks


def rows(spark, n=40_000):
    # file f3 holds the keys of f1 again; one key fills a third of f0; some keys are null
    df = spark.range(n).select((F.col("id") % 4).alias("f"), F.col("id").alias("i"))
    key = F.when(F.col("i") % 11 == 0, None).when((F.col("f") == 0) & (F.col("i") % 3 == 0), F.lit("hot")).otherwise(
        F.concat(F.when(F.col("f") == 3, "1").otherwise(F.col("f").cast("string")), F.lit(":"), F.floor(F.col("i") / 8).cast("string"))
    )
    return df.select(F.concat(F.lit("f"), "f").alias("dataset_file"), (2020 + F.col("f") % 2).alias("year"), key.alias("key"))


def test_estimates_are_within_the_error_and_merge(spark):
    df = rows(spark)
    lines = ks.sketches(df, "key", ["dataset_file", "year"])
    assert lines.count() == 4
    for per in (["dataset_file"], ["year"], []):
        names = lambda r: tuple(r[p] for p in per)
        got = {names(r): r for r in ks.distinct_keys(lines, *per).collect()}
        want = {names(r): r for r in ks.exact_keys(df, "key", *per).collect()}
        assert got.keys() == want.keys()
        for k, r in want.items():
            assert got[k].n_rows == r.n_rows and abs(got[k]["keys"] - r["keys"]) <= 4 * ks.ERROR * r["keys"]
    one = ks.distinct_keys(lines, where=F.col("dataset_file") == "f2").first()
    assert one.n_rows == 10_000


def test_files_are_added_once(spark, tmp_path):
    df, path, by = rows(spark, 4000), str(tmp_path / "sketches"), ["dataset_file", "year"]
    ks.extend(spark, path, df.where("dataset_file < 'f2'"), "key", by)
    ks.extend(spark, path, df, "key", by)
    ks.extend(spark, path, df, "key", by)
    lines = ks.stored(spark, path)
    assert sorted(r.dataset_file for r in lines.collect()) == ["f0", "f1", "f2", "f3"]
    assert ks.distinct_keys(lines).first() == ks.distinct_keys(ks.sketches(df, "key", by)).first()


def test_no_rows_and_no_keys(spark):
    df = rows(spark, 100)
    none = ks.sketches(df.where("year = 1"), "key", ["year"])
    assert none.count() == 0 and ks.distinct_keys(none, "year").count() == 0
    assert tuple(ks.distinct_keys(none).first()) == (0, 0) == tuple(ks.exact_keys(df.where("year = 1"), "key").first())
    assert tuple(ks.distinct_keys(ks.sketches(df.withColumn("key", F.lit(None).cast("string")), "key", ["year"])).first()) == (0, 100)
