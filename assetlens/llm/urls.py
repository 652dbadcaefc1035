"""URL filter: allow and block rules, then gradient-boosted trees over lexical features.

A rule is a host and a path. It fits its host and all subdomains, for URLs whose
path starts with the rule's; of those that fit, the longest decides. URLs that no
rule fits are judged by boosted trees, trained from labelled URLs on what the
address itself shows: length, depth, share of digits, entropy of its
characters, parameters, and how common and how spread its suffix is.

The trees are fitted on a bounded, documented sample (``MAX_FITTED`` labelled
rows, those with the smallest hashes); suffix statistics cover all URLs, and
every URL is judged. All of it is DataFrame and Spark ML code.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, saved, table
from .discriminant import labelled

#: (verdict, host and path)
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
FEATURES = ("length", "depth", "digit_share", "entropy", "parameters", "suffix_pages", "suffix_hosts", "host_labels", "host_length")
MAX_FITTED = 20_000  # labelled rows that the trees are fitted on
TREES, DEPTH, STEP, SEED = 10, 3, 0.2, 11
BLOCK_FROM = 0.5  # probability of the block label from which a URL is blocked


def host_of(url: Column) -> Column:
    """After the first ://, up to the next / ? # or the end, A-Z lower-cased; empty without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ? or # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of equally long ones the first in the list. Meant for lists of some hundred rules."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits a character, over the characters' own frequencies."""
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.greatest(F.length(text), F.lit(1))
    shares = F.transform(F.array_distinct(F.split(text, "")), share)
    return F.coalesce(F.aggregate(shares, F.lit(0.0), lambda sum_, p: sum_ - F.when(p > 0, p * F.log2(p)).otherwise(0.0)), F.lit(0.0))


def addressed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, suffix and lexical features) of every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    query = F.regexp_extract("url", r"(?s)^[^?#]*\?([^#]*)", 1)
    digits = F.length("url") - F.length(F.translate("url", "0123456789", ""))
    return rows.select(
        "page_id", "host", "path",
        F.substring_index("host", ".", -1).alias("suffix"),
        F.log1p(F.length("url")).alias("length"),
        (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double").alias("depth"),
        (digits / F.greatest(F.length("url"), F.lit(1))).alias("digit_share"),
        _entropy(F.col("url")).alias("entropy"),
        F.when(F.length(query) > 0, F.length(query) - F.length(F.replace(query, F.lit("&"), F.lit(""))) + 1).otherwise(0).cast("double").alias("parameters"),
        (F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).cast("double").alias("host_labels"),
        F.log1p(F.length("host")).alias("host_length"),
    )


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """(of_suffix, suffix_pages, suffix_hosts): logarithms of the pages and of the different hosts of each suffix."""
    hosts = rows.groupBy("suffix", "host").agg(F.count(F.lit(1)).alias("n"))  # a hot host is summed before it meets its suffix
    return hosts.groupBy("suffix").agg(F.log1p(F.sum("n")).alias("suffix_pages"), F.log1p(F.count(F.lit(1))).alias("suffix_hosts")).withColumnRenamed("suffix", "of_suffix")


def featured(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``addressed`` rows with the statistics of their suffix."""
    rows = addressed(pages, id_col, url_col)
    return rows.join(suffix_statistics(rows), F.col("suffix") == F.col("of_suffix"), "left").drop("of_suffix", "suffix")


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(rows)


def fit(rows: DataFrame, labels: DataFrame) -> GBTClassificationModel | None:
    """Trees from featured rows and (labelled_page, blocked 0/1); None without rows of both labels."""
    known = rows.join(labels, F.col("page_id") == F.col("labelled_page")).select("page_id", F.col("blocked").cast("double").alias("label"), *FEATURES)
    sample = known.orderBy(F.xxhash64("page_id"), "page_id", "label", *FEATURES).limit(MAX_FITTED)
    sample = saved(sample, "labelled-urls")
    if sample.select("label").distinct().count() < 2:
        return None
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, featuresCol="features", labelCol="label")
    return trees.fit(_assembled(sample).select("features", "label"))


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of ``pages``.

    ``labels`` is (labelled_page, blocked 0/1). score is the trees' probability
    of the block label; without labels of both kinds it is 0, so what no rule
    decides is allowed. A null URL, or one without ://, has an empty host and
    path, which no rule fits. Null ids and repeated rows are kept. Empty in,
    empty out.
    """
    rows = saved(featured(pages, id_col, url_col), "url-features")
    model = fit(rows, labels)
    if model is None:
        scored = rows.withColumn("score", F.lit(0.0))
    else:
        scored = model.transform(_assembled(rows)).withColumn("score", vector_to_array("probability")[1])
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("score") >= BLOCK_FROM, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learnt).alias("verdict"), "score")


def labels_by_document(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(labelled_page, blocked): pages whose path names a labelled document; low quality is the block label.

    Pages that repeat an id are labelled once, blocked if any of them is.
    """
    number = F.regexp_extract(path_of(F.col("url").cast("string")), r"/(\d{1,18})(?:[/.]|$)", 1)
    named = pages.select(F.col("page_id").alias("labelled_page"), F.when(number != "", number.cast("long")).alias("document"))
    met = named.join(labelled(labels), F.col("document") == F.col("labelled_id"))
    return met.groupBy("labelled_page").agg(F.max(1 - F.col("label")).alias("blocked"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, labels_by_document(pages, table(spark, sf_dir, "labels")))


QUERIES = {"op9_urls": op9_urls}
ORACLES: dict[str, str] = {}  # boosted trees are not SQL; tests compare hosts, paths and rules with brute force
