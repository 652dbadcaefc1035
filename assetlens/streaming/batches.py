"""Rows kept per micro-batch, merged level by level.

    root/data/folder=<name>/*.parquet   rows of one batch, or of several merged ones
    root/versions/<n>                   the folders that count now (see ``sources.versions``)

A batch that runs again replaces its folder. When ``FAN`` folders of one level
have gathered, they are merged into one of the next level, so after n batches
about FAN * log(n) folders count, and a row is rewritten log(n) times. The
newest batch is left out of merges, as only that one can run again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructType

from ..sources import versions

FAN = 8  # folders of a level that are merged
KEPT = 3  # versions whose folders stay, for readers that began before


def folders(spark: SparkSession, root: str) -> list[dict]:
    """The folders that count: name, level, first and last batch."""
    content = versions.latest(spark, root)[1]
    return content["folders"] if content else []


def _read(spark: SparkSession, root: str, content: dict, names: list[str]) -> DataFrame:
    schema = StructType.fromJson(json.loads(content["schema"]))
    base = f"{root.rstrip('/')}/data"
    if not names:
        return spark.createDataFrame([], schema)
    full = StructType([*schema, *StructType().add("folder", StringType())])
    return spark.read.schema(full).option("basePath", base).parquet(*[f"{base}/folder={n}" for n in names]).drop("folder")


def read(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """All rows that count, of one version; of batches before ``before`` if given."""
    _, content = versions.at_version(spark, root)
    return _read(spark, root, content, [f["name"] for f in content["folders"] if before is None or f["last"] < before])


def _write(df: DataFrame, root: str, partition_by: tuple[str, ...]) -> str:
    name = uuid.uuid4().hex
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{root.rstrip('/')}/data/folder={name}")
    return name


def keep(batch: DataFrame, batch_id: int, root: str, merge: Callable[[DataFrame], DataFrame], partition_by: tuple[str, ...] = (), fan: int = FAN) -> None:
    """Store the rows of a batch; ``merge`` makes one table of several (it must give the same for any grouping of its input)."""
    spark = batch.sparkSession
    new = {"name": _write(batch, root, partition_by), "level": 0, "first": batch_id, "last": batch_id}

    def added(old: dict | None) -> dict:
        others = [f for f in (old or {"folders": []})["folders"] if f["first"] != batch_id]
        return {"folders": [*others, new], "schema": batch.schema.json()}

    versions.update(spark, root, added)
    while _merge_one(spark, root, batch_id, merge, partition_by, fan):
        pass
    _forget(spark, root)


def _merge_one(spark: SparkSession, root: str, newest: int, merge, partition_by: tuple[str, ...], fan: int) -> bool:
    _, content = versions.latest(spark, root)
    levels: dict[int, list[dict]] = {}
    for f in content["folders"]:
        if f["last"] < newest:
            levels.setdefault(f["level"], []).append(f)
    full = next((level for level, group in sorted(levels.items()) if len(group) >= fan), None)
    if full is None:
        return False
    group = sorted(levels[full], key=lambda f: f["first"])
    names = {f["name"] for f in group}
    rows = merge(_read(spark, root, content, sorted(names)))
    merged = {"name": _write(rows, root, partition_by), "level": full + 1, "first": group[0]["first"], "last": group[-1]["last"]}
    versions.update(spark, root, lambda old: {"folders": [*(f for f in old["folders"] if f["name"] not in names), merged], "schema": old["schema"]})
    return True


def _forget(spark: SparkSession, root: str) -> None:
    """Delete folders and versions that only versions older than the last ``KEPT`` name."""
    newest, live = versions.latest(spark, root)[0], set()
    for n in range(max(1, newest - KEPT + 1), newest + 1):
        live |= {f["name"] for f in versions.at_version(spark, root, n)[1]["folders"]}
    for name in versions.subfolders(spark, f"{root.rstrip('/')}/data"):
        if name.startswith("folder=") and name.removeprefix("folder=") not in live:
            versions.remove_folder(spark, f"{root.rstrip('/')}/data/{name}")
    versions.forget(spark, root, KEPT)
