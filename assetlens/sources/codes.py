"""Code dictionaries: from nested JSON and mined from reference-book text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeeze
from ..session import label_table

# fixed values: object-type codes that override whatever the book says
TYPE_CODES = {
    "002001001000": "Земельный участок",
    "002001002000": "Здание",
    "002001003000": "Помещение",
    "002001004000": "Сооружение",
    "002001005000": "Объект незавершенного строительства",
    "002001009000": "Машино-место",
}

# fixed values: headings that end a label
_HEADINGS = "СПРАВОЧНИК|Классификатор видов|Назначение зданий|Назначение помещений|Перечень наименований"
_COLUMN_HEADING = "Классификационный код"


def read_code_dictionary(spark: SparkSession, path: str, field: str = "codes") -> DataFrame:
    """(code, label, pos) rows of a JSON document holding a code -> label object."""
    documents = spark.read.text(path, wholetext=True)
    codes = F.from_json(F.get_json_object("value", f"$.{field}"), "map<string,string>")
    return documents.select(F.posexplode(F.map_entries(codes)).alias("pos", "entry")).select(
        F.col("entry.key").alias("code"), F.col("entry.value").alias("label"), "pos"
    )


def mine_codes(books: DataFrame, text: str = "text", page: str | None = None) -> DataFrame:
    """Code/label pairs in running text: an 11-12 digit code and the words up
    to the next code. The last of equal codes wins, in the order of the ``page``
    column, then of a hash of the text and the place in it; the type codes override.
    """
    found = F.regexp_extract_all(
        F.col(text), F.lit(r"(?s)(?<!\S)([0-9]{11,12}\s+(?:(?!\s[0-9]{11,12}\s).)+)"), F.lit(1)
    )
    pairs = books.select(F.struct(*([page] if page else []), F.xxhash64(text)).alias("book"), F.posexplode(found).alias("pos", "hit"))
    code = F.regexp_extract("hit", r"^([0-9]+)", 1)
    label = squeeze(F.regexp_replace("hit", r"(?s)^[0-9]+\s+", ""))
    label = F.trim(F.regexp_replace(label, rf"(?s)\s*(?:{_HEADINGS}).*$", ""))
    mined = (
        pairs.select(
            "book",
            "pos",
            F.when(F.length(code) < 12, F.lpad(code, 12, "0")).otherwise(code).alias("code"),
            label.alias("label"),
        )
        .where((F.length("label") >= 2) & ~F.col("label").contains(_COLUMN_HEADING))
        .groupBy("code")
        .agg(F.max_by("label", F.struct("book", "pos")).alias("label"))
    )
    fixed = label_table(books.sparkSession, "code, label", *TYPE_CODES.items())
    return mined.where(~F.col("code").isin(*TYPE_CODES)).unionByName(fixed)
