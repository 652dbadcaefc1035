"""Centroid clustering of vectors in JVM expressions, with integer arithmetic throughout.

Components become integers first, so every distance and every sum is exact and
the result depends neither on the order of rows nor on their partitioning. A
round is one pass: ``zip_with`` and ``aggregate`` give the squared distance to
each centroid, a literal array in the plan; ``array_min`` over structs of
(distance, number) chooses the cluster; sums of the single columns, one partial
row a cluster and task, give the next centroids. Only ``clusters`` rows of sums
reach the driver a round, whatever the input. A hot cluster is no hot task: its
rows are summed where they are read.

Defined results: a vector that is null, has another number of components than
``dims`` or holds a null, NaN or infinite component is left out. An integer
beyond +-2**27 counts as that bound, so that a squared distance fits a long; an
inertia beyond a long counts as the largest long. Repeated rows and rows without
id are vectors of their own; a row without id starts a centroid only where too
few have one. Fewer vectors than ``clusters``: one centroid each at the start.
None: no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
LARGEST = 1 << 27  # of an integer component: DIMS * (2 * LARGEST) ** 2 is below 2 ** 63
LONG_MAX = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component of the usable vectors."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    bound = F.lit(LARGEST).cast("long")
    whole = F.transform(v, lambda x: F.greatest(-bound, F.least(bound, F.floor(x * float(scale)))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(v.isNotNull() & (F.size(v) == dims) & ~bad).select("vec_id", whole.alias("v"))


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors whose ids have the smallest digests."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = rows.select(digest.alias("digest"), "v").orderBy(F.asc_nulls_last("digest"), "v").limit(clusters)
    return [list(r.v) for r in chosen.collect()]


def _literal(numbers: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{n}L' for n in numbers)})")


def distance(v: Column, centroid: list[int]) -> Column:
    """Squared Euclidean distance of a vector to a centroid."""
    squares = F.zip_with(v, _literal(centroid), lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0).cast("long"), lambda total, square: total + square)


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid, ties to the smaller number."""
    return F.array_min(F.array(*(F.struct(distance(v, c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids))))


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round; an empty one stays where it is."""
    dims = len(centroids[0])
    columns = rows.select(nearest(F.col("v"), centroids)["cluster"].alias("cluster"), *(F.get("v", F.lit(j)).alias(f"c{j}") for j in range(dims)))
    sums = columns.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"c{j}").alias(f"c{j}") for j in range(dims)))
    out = list(centroids)
    for r in sums.collect():
        out[r.cluster] = [r[f"c{j}"] // r.n for j in range(dims)]  # floor, also below zero
    return out


def trained(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    """Centroids after ``rounds`` rounds over (vec_id, v); fewer where a round moves none, as no later one would."""
    centroids = first_centroids(rows, clusters, seed)
    for _ in range(rounds if centroids else 0):
        before, centroids = centroids, moved(rows, centroids)
        if before == centroids:
            break
    return centroids


def assigned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of every row of (vec_id, v)."""
    return rows.select("vec_id", nearest(F.col("v"), centroids).alias("at")).select("vec_id", F.col("at.cluster").alias("cluster"), F.col("at.distance").alias("distance"))


def clustering(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every usable vector, the final centroids)."""
    rows = saved(whole_vectors(vectors, id_col, vector_col, dims, scale), "whole-vectors")
    centroids = trained(rows, clusters, rounds, seed)
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    return assigned(rows, centroids), centroids


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every vector, with the inertia of its cluster and of all, and its centroid's digest."""
    found, centroids = clustering(table(spark, sf_dir, "embeddings"))
    by_cluster = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    inertia = [min(by_cluster.get(i, 0), LONG_MAX) for i in range(max(1, len(centroids)))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids] or [""]
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        F.get(_literal(inertia), F.col("cluster")).alias("cluster_inertia"),
        F.lit(min(sum(by_cluster.values()), LONG_MAX)).cast("long").alias("inertia"),
        F.get(F.array(*map(F.lit, digests)), F.col("cluster")).alias("centroid_sha256"),
    )


def _oracle() -> str:
    """The same rounds, one after the other, as common table expressions."""
    assign = """a{r} AS MATERIALIZED (
  SELECT vec_id, v, list_min(list_transform(c, lambda k: {{'d': CAST(list_sum(list_transform(list_zip(v, k.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'k': k.k}})) AS near
  FROM q, (SELECT list(c{r} ORDER BY k) AS c FROM c{r}))"""
    update = """c{n} AS MATERIALIZED (
  SELECT c{r}.k AS k, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY j) AS v
    FROM (SELECT near.k AS k, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, 65) t(j) GROUP BY ALL) GROUP BY k) m ON m.k = c{r}.k)"""
    parts = [
        """q AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))))""",
        """c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS k, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM q ORDER BY h LIMIT 8))""",
    ]
    for r in range(ROUNDS):
        parts += [assign.format(r=r), update.format(r=r, n=r + 1)]
    parts.append(assign.format(r=ROUNDS))
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, near.k AS cluster, near.d AS distance,
       CAST(sum(near.d) OVER (PARTITION BY near.k) AS BIGINT) AS cluster_inertia, CAST(sum(near.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.k = near.k"""
    )


QUERIES = {"op13_centroids": op13_centroids}
ORACLES = {"op13_centroids": _oracle()}
