"""Small pieces that several operators of this subpackage share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: A word of the whitespace contracts: a run of anything but space and \t..\r.
WORD_GAP = r"[\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the shared tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the cluster's shared folder and read back.

    Cuts the lineage: a lost executor costs the tasks that read, not those that
    wrote. The folder is the one ``spark.checkpoint.dir`` names.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark, 'assetlens-llm')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch, where the session leaves Spark's default of 10,000: that many long
#: texts, in the executor and in its Python worker at once, are more than a small executor has.
BATCH_ROWS, BATCH_CONF = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(df: DataFrame) -> DataFrame:
    """``df`` unchanged, about to go through Python workers.

    Workers that start from now on also look for modules where the driver found
    this package, and batches get ``BATCH_ROWS`` rows unless the session says otherwise.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF) == "10000":
        conf.set(BATCH_CONF, str(BATCH_ROWS))
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, PACKAGE_ROOT])
    return df


def map_texts(docs: DataFrame, function, schema: str) -> DataFrame:
    """``function`` over Arrow batches of ``docs`` (columns as selected by the caller)."""
    return ship(docs).mapInArrow(function, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The texts of a batch one by one, null as empty."""
    for value in batch.column(name):
        yield value.as_py() or ""


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)
