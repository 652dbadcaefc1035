"""Which files of a snapshot store can hold a key: a filter per stored file.

A filter is the least and greatest key of the file and a bitmap of its keys'
hashes (32,768 bits, Spark's own bitmap aggregate). Stored files never change,
so a filter is made once and never stale: ``extend`` adds those of new files.
A search reads the folders whose filters let the key through, and those of
files without a filter; all others are not opened.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from . import versions
from .snapshots import MANIFEST, _source, preferred

BITS = 32768  # of a bitmap, fixed by the aggregate
LISTED = 10_000  # folders named in a read; beyond that they are joined, and pruned when the query runs
FILTER = "load string, source string, least string, greatest string, bits binary"


def _position(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def _has_bit(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def _folder(root: str, key: str) -> str:
    return f"{root.rstrip('/')}/key_filters/{key}"


def filters(spark: SparkSession, root: str, key: str) -> DataFrame:
    """Filters made so far."""
    versions.make_folder(spark, _folder(root, key))
    return spark.read.schema(FILTER).parquet(_folder(root, key))


def _shown(spark: SparkSession, root: str, version: int | None) -> tuple[DataFrame, StructType]:
    content = versions.at_version(spark, root, version)[1]
    files = preferred(spark.read.schema(MANIFEST).parquet(f"{root.rstrip('/')}/manifest/{content['manifest']}")).where("rows > 0")
    files = files.select("dataset_file", "load", _source(F.col("path")).alias("source"))
    return files, StructType.fromJson(json.loads(content["schema"]))


def _stored(spark: SparkSession, root: str, schema: StructType, folders: list[str]) -> DataFrame:
    full = StructType([*schema, *StructType().add("load", StringType()).add("source", StringType())])
    return spark.read.schema(full).option("basePath", f"{root.rstrip('/')}/data").parquet(*folders)


def extend(spark: SparkSession, root: str, key: str) -> None:
    """Filters of the files that have none yet; a filter made twice does no harm."""
    files, schema = _shown(spark, root, None)
    new = files.join(filters(spark, root, key).select("load", "source"), ["load", "source"], "left_anti").select("load", "source")
    rows = _stored(spark, root, schema, [f"{root.rstrip('/')}/data"]).join(new, ["load", "source"], "left_semi")
    text = F.col(key).cast("string")
    made = rows.where(text.isNotNull()).groupBy("load", "source").agg(
        F.min(text).alias("least"), F.max(text).alias("greatest"), F.bitmap_construct_agg(_position(text)).alias("bits")
    )
    # a file whose keys are all null has a filter that lets nothing through
    out = new.join(made, ["load", "source"], "left").select(*[c.split()[0] for c in FILTER.split(", ")])
    out.write.mode("append").parquet(_folder(root, key))


def candidate_files(spark: SparkSession, root: str, key: str, value: str, version: int | None = None) -> DataFrame:
    """(load, source, dataset_file) of the files that can hold ``value``, those without a filter included."""
    files, _ = _shown(spark, root, version)
    known = filters(spark, root, key).dropDuplicates(["load", "source"]).withColumn("known", F.lit(True))
    text = F.lit(value)
    passes = F.coalesce(text.between(F.col("least"), F.col("greatest")) & _has_bit(F.col("bits"), _position(text)), F.lit(False))
    return files.join(known, ["load", "source"], "left").where(F.col("known").isNull() | passes).select("load", "source", "dataset_file")


def search(spark: SparkSession, root: str, key: str, value: str, version: int | None = None) -> DataFrame:
    """Rows of a version whose ``key`` is ``value``, with ``dataset_file``; other files' folders are not opened."""
    base = f"{root.rstrip('/')}/data"
    number, _ = versions.at_version(spark, root, version)
    found = candidate_files(spark, root, key, value, number)
    schema = _shown(spark, root, number)[1]
    listed = found.limit(LISTED + 1).collect()
    if len(listed) <= LISTED:
        found = spark.createDataFrame(listed, found.schema)
        rows = _stored(spark, root, schema, [f"{base}/load={r.load}/source={r.source}" for r in listed]) if listed else _stored(spark, root, schema, [base]).limit(0)
    else:
        rows = _stored(spark, root, schema, [base])
    rows = rows.where(F.col(key).cast("string") == value)
    if "dataset_file" in rows.columns:
        rows = rows.drop("dataset_file")
    return rows.join(found, ["load", "source"]).drop("load", "source")
