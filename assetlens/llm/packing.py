"""Best-fit packing of documents into windows, under conflicts.

A window (bin) holds ``capacity`` words. It must not hold two pieces of one
source, nor of one duplicate cluster. Text longer than a window is cut: full
pieces fill windows alone, the rest is packed like a short text.

Documents are dealt by hash into shards of about ``SHARD`` rows; shards are
packed independently and side by side, so no group grows with the data, and a
hot source or cluster is spread over all of them. Inside a shard, pieces go from
large to small. Open bins are kept in the order of their residual, each with a
bitmap of its sources and one of its clusters. The search starts at the smallest
residual that holds the piece and goes on to the successor until the bitmaps
agree: the tightest compatible bin. If there is none, a new bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, lower_ascii, saved, ship, table
from .resemble import resembling_groups

CAPACITY = 2048  # words of a window
SHARD = 4096  # rows that are packed together

SCHEMA = "doc_id long, piece int, first_word long, n_words long, bin_id long, slot int"


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of every piece. Pieces are taken from large to small, ties in the order given; a null source or cluster conflicts with nothing."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    cluster_bit = {c: 1 << i for i, c in enumerate(dict.fromkeys(c for c in clusters if c is not None))}
    source_bit[None] = cluster_bit[None] = 0
    open_bins: list[tuple[int, int]] = []  # (residual, bin), sorted
    in_sources: list[int] = []
    in_clusters: list[int] = []
    placed = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, s, c = sizes[i], source_bit[sources[i]], cluster_bit[clusters[i]]
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not (in_sources[b] & s or in_clusters[b] & c):
                break
            at += 1
        if at < len(open_bins):
            residual, b = open_bins.pop(at)
        else:
            residual, b = capacity, len(in_sources)
            in_sources.append(0)
            in_clusters.append(0)
        in_sources[b] |= s
        in_clusters[b] |= c
        if residual > size:
            insort(open_bins, (residual - size, b))
        placed[i] = b
    return placed


def _packed(capacity: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("cluster", "ascending"), ("n_words", "ascending"), ("source", "ascending")])
        ids, sources, clusters, words = (rows[c].to_pylist() for c in ("doc_id", "source", "cluster", "n_words"))
        # the last piece of each document is shared out; the others are full windows
        rests = [w - (max(0, w - 1) // capacity) * capacity for w in words]
        placed = best_fit(rests, sources, clusters, capacity)
        lone = max(placed) + 1
        out: list[tuple[int | None, int, int, int, int]] = []
        for i, b in enumerate(placed):
            whole = (words[i] - rests[i]) // capacity
            for piece in range(whole):
                out.append((ids[i], piece, piece * capacity, capacity, lone))
                lone += 1
            out.append((ids[i], whole, whole * capacity, rests[i], b))
        shard = rows["shard"][0].as_py()
        slots: dict[int, int] = {}
        columns = list(zip(*out, strict=True))
        slot = [slots[b] - 1 for b in columns[4] if slots.update({b: slots.get(b, 0) + 1}) is None]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        columns[4] = [shard << 32 | b for b in columns[4]]
        return pa.table([pa.array(c, k) for c, k in zip([*columns, slot], kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return run


def words_of(text: Column) -> Column:
    """The words of a text, split at space and \\t..\\r."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def same_text_cluster(text: Column) -> Column:
    """A cluster of texts that are equal but for ASCII case and white space."""
    return F.xxhash64(F.array_join(words_of(lower_ascii(text)), " "))


def sized(docs: DataFrame, cluster: str | None = None) -> DataFrame:
    """(doc_id, source, cluster, n_words) of every row; the cluster is that of the column named, else that of equal texts."""
    text = F.col("text").cast("string")
    own = F.col(cluster).cast("string") if cluster else same_text_cluster(text).cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), own.alias("cluster"),
        F.size(words_of(text)).cast("long").alias("n_words"),
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, cluster: str | None = None) -> DataFrame:
    """(doc_id, piece, first_word, n_words, bin_id, slot): where every piece of every row of ``docs`` goes.

    ``docs`` has doc_id, text and source; ``cluster`` names its column of
    duplicate clusters, if it has one. Pieces of a document follow one another
    without gap. Empty and null texts have one piece without words. A null source or
    cluster conflicts with nothing. Repeated rows are packed each on their own;
    equal ones share a cluster, so never a window. The result depends on the
    rows only, not on their order. Extra columns are not read. Empty in, empty out.
    """
    return pack_sized(sized(docs, cluster), capacity, shard)


def pack_sized(sizes: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``pack`` of (doc_id, source, cluster, n_words) rows."""
    rows = saved(sizes, "sized")
    shards = max(1, -(-rows.count() // shard))
    # the hash of a repeated row is the same, so many exact repeats would meet: they are dealt by their number too
    copies = rows.groupBy("doc_id", "source", "cluster", "n_words").agg(F.count(F.lit(1)).alias("n"))
    dealt = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    dealt = dealt.select("doc_id", "source", "cluster", "n_words", F.pmod(F.xxhash64("doc_id", "n_words", "copy"), F.lit(shards)).alias("shard"))
    return ship(dealt).groupBy("shard").applyInArrow(_packed(capacity), SCHEMA)


def packed_texts(docs: DataFrame, capacity: int = CAPACITY, separator: str = "\n\n") -> DataFrame:
    """(bin_id, n_words, text): the windows themselves, pieces in slot order. Ids of ``docs`` must be unique."""
    pieces = pack(docs, capacity)
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text").cast("string")).alias("words"))
    part = F.slice("words", (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int"))
    texts = pieces.join(words, "doc_id").select("bin_id", "slot", "n_words", F.array_join(part, " ").alias("part"))
    bins = texts.groupBy("bin_id").agg(F.sum("n_words").alias("n_words"), F.array_sort(F.collect_list(F.struct("slot", "part"))).alias("parts"))
    return bins.select("bin_id", "n_words", F.array_join("parts.part", separator).alias("text"))


def clustered(docs: DataFrame) -> DataFrame:
    """(doc_id, source, cluster, n_words) of every row of ``docs``, with its near-duplicate component as cluster.

    Rows without a word resemble nothing; they share a cluster, as equal texts do.
    """
    return resembling_groups(docs).select("doc_id", "source", F.col("component").cast("string").alias("cluster"), "n_words")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window, slot and span of every piece of every document; near copies never share a window."""
    return pack_sized(clustered(table(spark, sf_dir, "documents")))


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}  # a sequential search; tests check it against a plain one
