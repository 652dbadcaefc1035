"""Session set-up and the few runtime settings the operators rely on."""

from __future__ import annotations

import functools
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings safe to change on a running session. Nothing here alters results;
# they let adaptive execution split hot keys and size reduce partitions.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even if that costs one more exchange above it
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, app: str = "assetlens", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("ASSETLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        # small tables come in one row group; see plans.tables.spread
        .config("spark.assetlens.scanTasks", os.environ.get("ASSETLENS_SCAN_TASKS", str(cores) if str(cores).isdigit() else "8"))
        # small local stages keep all cores busy instead of one
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # no Python call site per column expression: it doubles planning time
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "assetlens-warehouse"))
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def label_table(spark: SparkSession, columns: str, *rows: tuple[str, ...]) -> DataFrame:
    """A few fixed rows of text as a literal relation, whose size Spark knows."""
    quoted = lambda v: "'" + v.replace("'", "\\'") + "'"
    values = ", ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


@functools.cache
def _local_dir() -> str:
    """The stand-in of this process."""
    return tempfile.mkdtemp(prefix="assetlens-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A folder every executor can reach, under the cluster's checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master
    (tests, a laptop) may do without: one temporary folder then stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/{name}"
