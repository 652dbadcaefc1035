"""A store of deal rows by source file, with snapshots.

    root/data/load=<id>/source=<digest of the path>/*.parquet   rows, never changed once written
    root/manifest/<id>/                                         (path, dataset_file, length, modificationTime, load, rows)
    root/versions/<n>                                           the manifest of version n (see ``versions``)

A load writes rows under an id of its own, then a manifest that maps each of its
files to that id, then the version. A file that became empty or shrank so leaves
exactly its new rows: its old load is no longer named. A removed file is a row
of the manifest less. Files are told apart by their full path; where several
give one dataset (plain and .gz, or two folders) the snapshot shows the one that
the catalogue prefers, whatever the order they came in. A reader fixes its
version first, so loads that end meanwhile do not show.

Only the pointer of a version passes through the driver; manifests are tables,
and a snapshot is a join of the rows' partition columns with one, which prunes
the folders it reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from . import versions
from .deal_files import _file_name, dataset_columns

FILE_COLUMNS = ("path", "length", "modificationTime")
MANIFEST = "path string, dataset_file string, length bigint, modificationTime timestamp, load string, rows bigint"


def plain_path(path: Column) -> Column:
    """A file's path as one text, however the reader wrote it: decoded, one slash after the scheme."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^([a-z0-9]+):/+", "$1:/")


def _source(path: Column) -> Column:
    return F.sha1(path.cast("binary"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Files of a version: path, dataset_file, length, modificationTime, load, rows; empty before the first load."""
    if version is None and versions.latest(spark, root)[1] is None:
        return spark.createDataFrame([], MANIFEST)
    content = versions.at_version(spark, root, version)[1]
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/{content['manifest']}")


def current_version(spark: SparkSession, root: str) -> int:
    return versions.latest(spark, root)[0]


def _write_manifest(spark: SparkSession, root: str, rows: DataFrame) -> str:
    name = uuid.uuid4().hex
    rows.select(*[c.split()[0] for c in MANIFEST.split(", ")]).write.parquet(f"{root}/manifest/{name}")
    return name


def load(rows: DataFrame, files: DataFrame, root: str) -> int:
    """Store ``rows`` (with the ``path`` each came from) of ``files``, one load; the new version.

    ``files`` (path, length, modificationTime, maybe dataset_file) lists every
    file of the load, those without rows too; rows of other files are not taken.
    Each file replaces what the store has of it.
    """
    spark, number = files.sparkSession, uuid.uuid4().hex
    root = root.rstrip("/")
    own = rows.withColumn("path", plain_path(F.col("path")))
    listed = files.withColumn("path", plain_path(F.col("path")))
    if "dataset_file" not in files.columns:
        listed = listed.withColumn("dataset_file", dataset_columns(_file_name(F.col("path")))["dataset_file"])
    listed = listed.groupBy("path").agg(F.max_by(F.struct("dataset_file", "length", "modificationTime"), "modificationTime").alias("f")).select("path", "f.*")
    taken = own.join(listed.select("path"), "path", "left_semi")
    versions.make_folder(spark, f"{root}/data")
    taken.withColumn("source", _source(F.col("path"))).drop("path").write.partitionBy("source").parquet(f"{root}/data/load={number}")
    schema = StructType([f for f in rows.schema if f.name != "path"])
    stored = _read(spark, root, schema).where(F.col("load") == number)
    counts = stored.groupBy(F.col("source").alias("its_source")).agg(F.count("*").alias("n"))
    new = listed.join(counts, _source(F.col("path")) == F.col("its_source"), "left")
    new = new.withColumn("load", F.lit(number)).withColumn("rows", F.coalesce("n", F.lit(0)).cast("bigint"))
    new = new.select(*[c.split()[0] for c in MANIFEST.split(", ")])

    def change(content: dict | None) -> dict:
        before = spark.read.schema(MANIFEST).parquet(f"{root}/manifest/{content['manifest']}") if content else spark.createDataFrame([], MANIFEST)
        return {"manifest": _write_manifest(spark, root, before.join(new.select("path"), "path", "left_anti").unionByName(new)), "schema": schema.json()}

    return versions.update(spark, root, change)


def remove(paths: DataFrame, root: str) -> int:
    """A version without the files of ``paths`` (path)."""
    spark = paths.sparkSession
    gone = paths.select(plain_path(F.col("path")).alias("path"))

    def change(content: dict | None) -> dict:
        before = spark.read.schema(MANIFEST).parquet(f"{root}/manifest/{content['manifest']}")
        return {"manifest": _write_manifest(spark, root, before.join(gone, "path", "left_anti")), "schema": content["schema"]}

    return versions.update(spark, root, change)


def preferred(files: DataFrame) -> DataFrame:
    """Of several files of one dataset the one shown: plain text before .gz, then the first path."""
    order = F.struct(F.col("path").rlike(r"(?i)\.gz$"), "path")
    return files.groupBy("dataset_file").agg(F.min_by(F.struct(*files.columns), order).alias("f")).select("f.*")


def _read(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    full = StructType([*schema, *StructType().add("load", StringType()).add("source", StringType())])
    return spark.read.schema(full).parquet(f"{root}/data")


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Rows of a version, with ``dataset_file``."""
    root = root.rstrip("/")
    content = versions.at_version(spark, root, version)[1]
    shown = preferred(spark.read.schema(MANIFEST).parquet(f"{root}/manifest/{content['manifest']}")).where("rows > 0")
    shown = shown.select(F.col("load").alias("its_load"), _source(F.col("path")).alias("its_source"), F.col("dataset_file").alias("its_file"))
    rows = _read(spark, root, StructType.fromJson(json.loads(content["schema"])))
    met = rows.join(shown, (F.col("load") == F.col("its_load")) & (F.col("source") == F.col("its_source")))
    return met.withColumn("dataset_file", F.col("its_file")).drop("load", "source", "its_load", "its_source", "its_file")


def changed(files: DataFrame, root: str) -> DataFrame:
    """Files (path, length, modificationTime) that the newest version does not hold as they are."""
    spark = files.sparkSession
    known = manifest(spark, root).select(F.col("path").alias("known"), F.col("length").alias("its_length"), F.col("modificationTime").alias("its_time"))
    same = (plain_path(F.col("path")) == F.col("known")) & (F.col("length") == F.col("its_length")) & (F.col("modificationTime") == F.col("its_time"))
    return files.join(known, same, "left_anti")


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete loads that none of the newest ``keep`` versions names; the number of loads deleted.

    A reader or writer that is still at work on an older version loses it, so
    ``keep`` must cover them. Manifests hold one load id per file, so the ids of
    ``keep`` versions are what reaches the driver.
    """
    root = root.rstrip("/")
    newest = current_version(spark, root)
    live: set[str] = set()
    for v in range(max(1, newest - keep + 1), newest + 1):
        live |= {r.load for r in manifest(spark, root, v).select("load").distinct().collect()}
    old = [n for n in versions.subfolders(spark, f"{root}/data") if n.startswith("load=") and n.removeprefix("load=") not in live]
    for name in old:
        versions.remove_folder(spark, f"{root}/data/{name}")
    return len(old)
