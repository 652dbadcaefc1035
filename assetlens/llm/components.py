"""Connected components of a link table, by alternating star contraction.

Each round replaces the links so that every node points at the smallest node it
can see: first from its larger neighbours, then from its smaller ones. The
number of rounds grows with the logarithm of the longest chain. Links are two
longs a row; each round is written to the checkpoint folder, so no lineage
builds up and a lost executor costs one round at most.

A node with very many links (the middle of a star) is no task of its own: the
minima are aggregated before the shuffle, and the join that hands them back has
plain exchanges on both sides, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _handed_back(links: DataFrame, least: DataFrame) -> DataFrame:
    """``links`` (u, v) with the minimum ``m`` of u. The key is wrapped, so that the minima are dealt anew and either side can be split."""
    keyed = least.select(F.struct(F.col("u").alias("k")).alias("key"), "m")
    return links.withColumn("key", F.struct(F.col("u").alias("k"))).join(keyed, "key").drop("key")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _handed_back(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _handed_back(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``links`` (two long columns, any names); component is the smallest node reachable.

    Nulls and links of a node with itself are ignored; repeated links count
    once; no links give no rows.
    """
    a, b = links.columns
    stars = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct()
    stars, before = saved(stars, "links"), None
    while True:
        # the links are stars exactly when another round leaves them as they are
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before, stars = state, saved(_small_star(_large_star(stars)).where("u <> v").distinct(), "links")
    hubs = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(hubs.select("node", F.col("node").alias("component")))
