"""Quarterly deal files: catalogue, scan, quality gate, serving table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import period_label
from ..functions.text import extract, non_empty

# fixed values: the 17 columns of a deal file, by position
DEAL_COLUMNS = (
    "number", "okato", "region_code", "district", "city", "quarter_cad_number", "street",
    "realestate_type_code", "wall_material_code", "year_build", "floor", "purpose_code", "area",
    "period_start_date", "deal_price", "currency", "doc_type",
)
QUARTER_FIELD = DEAL_COLUMNS.index("quarter_cad_number")


def dataset_columns(file_name: Column) -> dict[str, Column]:
    """Kind, period and sort key read from a file name."""
    base = F.regexp_replace(file_name, r"(?i)\.gz$", "")
    period = r"(?i)y_([0-9]{4})_q_([0-9])"
    year = extract(base, period, 1).try_cast("int")
    quarter = extract(base, period, 2).try_cast("int")
    is_rent = base.rlike("(?iu)АРЕНДА")
    return {
        "dataset_file": base,
        "kind": F.when(is_rent, F.lit("rent")).otherwise(F.lit("deal")),
        "kind_label": F.when(is_rent, F.lit("Аренда")).otherwise(F.lit("Продажа")),
        "year": year,
        "quarter": quarter,
        "period_label": F.when(
            year.isNotNull(), F.concat(quarter.cast("string"), F.lit(" квартал "), year.cast("string"), F.lit(" года"))
        ).otherwise(F.lit("Период не указан")),
        "period_short_label": period_label(year, quarter),
        "sort_key": F.coalesce(year * 100 + quarter, F.lit(0)),
    }


def _file_name(path: Column) -> Column:
    # listed paths come percent-encoded; + is a plain character in a path
    return F.url_decode(F.replace(F.substring_index(path, "/", -1), F.lit("+"), F.lit("%2B")))


def catalogue(spark: SparkSession, folders: Sequence[str], pattern: str = "dataset_*") -> DataFrame:
    """One row per dataset: plain text preferred to .gz, an earlier folder to a
    later one, newest period first. File contents are not read."""
    listed = None
    for rank, folder in enumerate(folders):
        part = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", pattern)
            .load(folder)
            .select("path", "length", "modificationTime", F.lit(rank).alias("folder_rank"))
        )
        listed = part if listed is None else listed.unionByName(part)
    return resolve_catalogue(listed)


def resolve_catalogue(files: DataFrame) -> DataFrame:
    """:func:`catalogue` on a listing: path, length, modificationTime and
    folder_rank (0 = first folder)."""
    named = files.withColumns(dataset_columns(_file_name(F.col("path"))))
    preference = F.struct("folder_rank", F.col("path").rlike(r"(?i)\.gz$"), "path")
    columns = [c for c in named.columns if c != "folder_rank"]
    best = named.groupBy("dataset_file").agg(F.min_by(F.struct(*columns), preference).alias("row"))
    return (
        best.select("row.*")
        .withColumn("size_mb", F.round(F.col("length") / F.lit(1048576.0), 1))
        .orderBy(F.desc("sort_key"), "dataset_file")
    )


def available_years(datasets: DataFrame) -> DataFrame:
    return datasets.where("year IS NOT NULL").select("year").distinct().orderBy(F.desc("year"))


def file_gate(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Landing-zone verdict per file: ``accepted`` and the first ``reason``.

    Only the head of each file is looked at. It is meant for a landing zone of
    upload-sized files, since the reader takes a file's content as one value.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = _file_name(F.col("path"))
    return _gate(files.withColumn("file_name", name).withColumn("head", F.substring("content", 1, 200)).drop("content"))


def _gate(files: DataFrame) -> DataFrame:
    """``file_gate`` on a table with file_name, length and head (binary)."""
    name, head, length = F.lower(F.col("file_name")), F.col("head"), F.col("length")
    # one byte one character, so that a cut in a multi-byte letter is no error
    text = F.ltrim(F.decode(head, "ISO-8859-1"))
    starts_hex = lambda prefix: F.startswith(F.hex(head), F.lit(prefix))
    is_text = name.rlike(r"\.(csv|txt)(\.gz)?$")
    reason = (
        F.when(F.col("file_name").startswith("~$"), F.lit("temporary file"))
        .when(length == 0, F.lit("empty"))
        .when(is_text & (length < 1024), F.lit("too small"))
        .when(is_text & (text.startswith("<!") | text.startswith("<html")), F.lit("html page"))
        .when(is_text & ~name.endswith(".gz") & ~text.contains("~"), F.lit("no delimiter"))
        .when(name.endswith(".xlsx") & (length < 512), F.lit("too small"))
        .when(name.endswith(".xlsx") & ~starts_hex("504B"), F.lit("not a workbook"))
        .when(name.endswith(".pdf") & ~starts_hex("255044462D"), F.lit("not a pdf"))
    )
    return files.select(
        *[c for c in files.columns if c != "head"], reason.isNull().alias("accepted"), reason.alias("reason")
    )


gate_files = _gate


#: One text column: the separator never occurs. The CSV reader is used as it
#: drops the header of every file and blank lines, gz or plain, and still splits
#: large plain files.
LINE_OPTIONS = {"sep": "\u0001", "quote": "", "header": "true", "enforceSchema": "true"}


def split_fields(line: Column, delimiter: str | None = None) -> Column:
    """Fields of a line, split at ``delimiter`` or at the mark that gives it all its fields.

    That is ``~`` if the line has enough of them, else ``;`` if it has; a line
    too short under both is split at the more frequent one. So no file has to be
    opened for its header first, in a batch or in a stream.
    """
    if delimiter:
        return F.split(line, delimiter, -1)
    tildes, semicolons = (F.length(line) - F.length(F.replace(line, F.lit(m), F.lit(""))) for m in "~;")
    enough = len(DEAL_COLUMNS) - 1
    by_semicolon = (tildes < enough) & ((semicolons >= enough) | (semicolons > tildes))
    return F.when(by_semicolon, F.split(line, ";", -1)).otherwise(F.split(line, "~", -1))


def _unquoted(fields: Column, i: int) -> Column:
    # '""' and nothing are null; one pair of outer quotes goes
    return non_empty(F.regexp_replace(F.get(fields, F.lit(i)), r'(?s)^"(.*)"$', "$1"))


def scan_lines(spark: SparkSession, paths: Sequence[str], delimiter: str | None = None) -> DataFrame:
    """Data lines of deal files with ``fields``, all files in one scan.

    The split is naive: quotes do not protect the delimiter.
    """
    lines = spark.read.schema("line string").options(**LINE_OPTIONS).csv(list(paths))
    lines = lines.select("line", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("path"))
    return lines.withColumn("fields", split_fields(F.col("line"), delimiter))


def scan_deals(
    spark: SparkSession, paths: Sequence[str], delimiter: str | None = None, partitions: int | None = None, with_path: bool = False
) -> DataFrame:
    """The 17 text columns plus what the file name says, and the file's ``path`` if asked for.

    Rows with fewer fields are dropped, extra fields ignored. A .gz file is one
    task; pass ``partitions`` to spread its rows afterwards.
    """
    lines = scan_lines(spark, paths, delimiter).where(F.size("fields") >= len(DEAL_COLUMNS))
    if partitions:
        lines = lines.repartition(partitions)
    fields = F.col("fields")
    return lines.select(
        *[_unquoted(fields, i).alias(c) for i, c in enumerate(DEAL_COLUMNS)],
        *[e.alias(n) for n, e in dataset_columns(F.col("file_name")).items()],
        *(["path"] if with_path else []),
    )


def quarter_index(lines: DataFrame) -> DataFrame:
    """Distinct (file, quarter key) over lines of :func:`scan_lines`.

    Needs six fields only, so it covers at least the rows of a full scan.
    """
    return (
        lines.where(F.size("fields") > QUARTER_FIELD)
        .select(
            F.regexp_replace("file_name", r"(?i)\.gz$", "").alias("dataset_file"),
            _unquoted(F.col("fields"), QUARTER_FIELD).alias("quarter_cad_number"),
        )
        .where("quarter_cad_number IS NOT NULL")
        .distinct()
    )


def write_serving_table(deals: DataFrame, path: str, partitions: int | None = None) -> None:
    """Typed deals by year, sorted by quarter key, newest and dearest first.

    The range also covers period and price, so one hot quarter spreads over
    several files instead of one.
    """
    order = [
        F.col("year"),
        F.col("quarter_cad_number"),
        F.col("sort_key").desc(),
        F.col("deal_price").desc_nulls_last(),
    ]
    kept = deals.where("quarter_cad_number IS NOT NULL")
    ranged = kept.repartitionByRange(partitions, *order) if partitions else kept.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("year").parquet(path)


def replace_files(deals: DataFrame, path: str) -> None:
    """Rows of whole files into a store with one partition per ``dataset_file``.

    A file that is there already is replaced, so loading a changed file again
    leaves none of its old rows, and a repeated or restarted load doubles none.
    Other files stay as they are.
    """
    deals.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_file").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame, column: str = "document") -> DataFrame:
    """Every row as one JSON text column."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(column))


def changed_files(current: DataFrame, manifest: DataFrame, columns: Iterable[str] = ("path", "length", "modificationTime")) -> DataFrame:
    """Catalogue rows whose (path, size, time) the manifest does not hold."""
    keys = list(columns)
    return current.join(manifest.select(*keys).distinct(), keys, "left_anti")
