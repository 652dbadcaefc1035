"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint holds, for each of 64 bits, the majority over the hashes
of its three-word shingles. Fingerprints that differ in ``radius`` bits or fewer
are linked. A fingerprint is cut into segments; if two differ in at most
``radius`` bits, then in one segment they differ in at most ``radius //
segments``. So every fingerprint is stored once under each segment, and looks
up all keys of the small Hamming ball around its own segments; what is found is
compared over the whole fingerprint.

Equal fingerprints are one row before any link is sought, so a group of copies
costs one row. A fingerprint has a bounded number of others within two bits
(64 + 2016), so links grow with the input, not with the square of a group.
The balls are never broadcast: they are 34 rows or more a fingerprint, and Spark
takes them for the size of the fingerprints.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_texts, saved, table, texts_of
from .components import components

BITS, SHINGLE, SEED = 64, 3, 42
RADIUS, SEGMENTS = 2, 2
CHUNK = 1 << 16  # shingles counted at a time


def fingerprint(text: str | None) -> int:
    """SimHash of a text; zero without a word. UTF-8, A-Z lower-cased, split at space and \\t..\\r."""
    words = (text or "").encode("utf-8").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    shingles = zip(words, words[1:], words[2:], strict=False)
    total, ones = len(words) - SHINGLE + 1, np.zeros(BITS, dtype=np.int64)
    while chunk := [digest(b"%b %b %b" % s, SEED) for s in itertools.islice(shingles, CHUNK)]:
        bits = np.unpackbits(np.array(chunk, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t) for t in texts_of(batch)), dtype=np.uint64, count=batch.num_rows)
        rest = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(found.view(np.int64))], [*(n for n in batch.schema.names if n != "text"), "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp long) of every row; null texts count as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, _fingerprints, "doc_id long, text_hash long, fp long")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _ball(width: int, radius: int) -> list[int]:
    """All masks over ``width`` bits with at most ``radius`` bits set."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(width), r)]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """Pairs (a, b), a < b, of the fingerprints in ``distinct`` (fp long, each once) that differ in ``radius`` bits at most."""
    width = BITS // segments
    fp, low = F.col("fp"), F.lit((1 << width) - 1)
    parts = [F.shiftrightunsigned(fp, s * width).bitwiseAND(low) for s in range(segments)]
    stored = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(s).alias("segment"), p.alias("key")) for s, p in enumerate(parts)))).alias("at"))
    masks = F.array(*(F.lit(m).cast("long") for m in _ball(width, radius // segments)))

    def ball(part: Column) -> Column:
        # of two keys in each other's ball, only the smaller one looks up the other
        return F.filter(F.transform(masks, lambda m: part.bitwiseXOR(m)), lambda key: key >= part)

    balls = [ball(p) for p in parts]
    sought = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(s).alias("segment"), b.alias("keys")) for s, b in enumerate(balls)))).alias("ball"))
    sought = sought.select(F.col("fp").alias("other"), F.col("ball.segment").alias("segment"), F.explode("ball.keys").alias("key"))
    stored = stored.select("fp", "at.segment", "at.key")
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius) & (F.col("fp") != F.col("other"))
    met = stored.hint("merge").alias("s").join(
        sought.alias("q"), (F.col("s.segment") == F.col("q.segment")) & (F.col("s.key") == F.col("q.key")) & near
    )
    return met.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()


def _rooted(prints: DataFrame, radius: int, segments: int) -> DataFrame:
    """(its_fp, root) of every fingerprint in ``prints``; root is one fingerprint of its group."""
    distinct = saved(prints.select("fp").distinct(), "distinct-fingerprints")
    groups = components(fingerprint_links(distinct, radius, segments))
    return distinct.join(groups, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("its_fp"), F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the smallest id among the rows whose fingerprints a chain of
    links reaches, the row itself included. Repeated rows are all returned. Null
    ids are returned with the component of their text, which is null only if no
    row of it has an id. Texts without a word share fingerprint zero.
    """
    prints = saved(fingerprints(docs).select("doc_id", "fp"), "fingerprints")
    rooted = saved(_rooted(prints, radius, segments), "fingerprint-roots")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    named = rooted.join(least, F.col("its_fp") == F.col("fp")).groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_fp = rooted.join(named, "root").select("its_fp", "component_id")
    return prints.join(of_fp, F.col("fp") == F.col("its_fp"), "left").select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """``docs`` with all its columns, one row of each near-duplicate group: that of the smallest id.

    If rows repeat that id, the one whose text has the smallest hash stays, once.
    Rows without id come last, so a group keeps one of them only if it has no other.
    """
    prints = saved(fingerprints(docs), "fingerprints")
    rooted = _rooted(prints, radius, segments)
    # before the join, one row for each fingerprint: copies meet in no task
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    firsts = prints.groupBy("fp").agg(F.min(order).alias("first"))
    kept = firsts.join(rooted, F.col("fp") == F.col("its_fp")).groupBy("root").agg(F.min("first").alias("first"))
    return _only(docs, kept)


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are a ``first`` in ``kept``, each once."""
    kept = kept.select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash"))
    mine = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), _text_hash().alias("text_hash"))
    chosen = mine.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash")), "left_semi")
    turn = F.row_number().over(W.partitionBy("id", "text_hash").orderBy(F.lit(0)))
    return chosen.withColumn("turn", turn).where("turn = 1").select("row.*")


def hex_of(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
ORACLES: dict[str, str] = {}  # seeded XXH64 is not SQL; tests compare with brute force
