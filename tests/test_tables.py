"""Reading the shared tables: scans dealt over tasks."""

import pytest
from pyspark.sql import functions as F

from assetlens.plans import flow_queries, tables


@pytest.fixture
def unset(spark):
    before = spark.conf.get("spark.assetlens.scanTasks")
    spark.conf.unset("spark.assetlens.scanTasks")
    yield spark
    spark.conf.set("spark.assetlens.scanTasks", before)


def test_one_row_group_is_dealt_over_the_cores(unset, tmp_path):
    unset.range(20_000, numPartitions=1).write.parquet(f"{tmp_path}/t.parquet")
    dealt = tables.spread(tables.table(unset, str(tmp_path), "t"))
    assert dealt.rdd.getNumPartitions() >= 8 and dealt.count() == 20_000


def test_an_even_scan_stays_as_it_is(unset, tmp_path):
    unset.range(20_000, numPartitions=16).write.parquet(f"{tmp_path}/t.parquet")
    scan = tables.table(unset, str(tmp_path), "t")
    assert "Repartition" not in tables.spread(scan)._jdf.queryExecution().optimizedPlan().toString()


# findings F6, F7, F8, F11
@pytest.mark.parametrize("name", ["registry_cards", "provider_cards", "registry_features", "address_parts"])
def test_row_heavy_parsing_is_dealt(unset, name):
    plan = flow_queries.QUERIES[name](unset, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan


# finding F9
@pytest.mark.parametrize("fixed", [None, "8"])
def test_a_row_group_is_dealt_without_sorting_it(unset, tmp_path, fixed):
    """Dealing in turn sorts a task's rows first, so one row group would have to fit the memory of one task."""
    if fixed:
        unset.conf.set("spark.assetlens.scanTasks", fixed)
    unset.range(20_000, numPartitions=1).selectExpr("1 AS same", "'x' AS too").write.parquet(f"{tmp_path}/t.parquet")
    dealt = tables.spread(tables.table(unset, str(tmp_path), "t"))
    assert dealt.columns == ["same", "too"]
    assert "RoundRobin" not in dealt._jdf.queryExecution().executedPlan().toString()
    sizes = [r.n for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and sum(sizes) == 20_000 and max(sizes) < 2 * min(sizes)
