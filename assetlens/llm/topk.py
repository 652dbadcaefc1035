"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

Vectors are dealt into blocks of bounded size. A block's index lists its
postings (row, dimension, sign) in segments of equal quantised impact, largest
impact first. A query block scores a block segment by segment: every segment
adds its quantised impact to the accumulators. What is still missing for a row
- the postings not yet read and the rounding of those read - is a vector whose
length the accumulators' owner knows, so by Cauchy-Schwarz the true score lies
within ``|query| * |missing|`` of the accumulator. Reading stops only when that
interval proves that few rows can still be among the best k; those are scored
exactly from the stored components.

Query blocks meet index blocks through an equi-join on the block number: a
stated query set against all rows, in blocks. No block grows with the data.
Both sides are shuffled and sorted, never broadcast: a query block has a row for
every index block there, many times what Spark takes it for.

Defined results: a vector that is null or holds a null, NaN or infinite
component takes no part, neither does a row without id. Rows that repeat an id
count once (the smallest vector). Vectors of unequal length are compared as if
the shorter one ended in zeros. Ties go to the smaller id. No rows: no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, ship, table

BLOCK_ROWS = 8192  # rows of one index block
QUERY_ROWS = 1024  # queries that go through a block together
LEVELS = 32  # quantised impacts of a block
CHECKS = (0.5, 0.75, 0.875, 0.95)  # shares of the postings after which the proof is tried
RESCORE = 48  # possible members a query may have when reading stops early

INDEX_SCHEMA = "block int, dims int, step long, ids array<long>, components array<long>, impacts array<long>, ends array<int>, slots array<int>"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, one row per id; unusable vectors are left out."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad)
        .select("vec_id", F.transform(v, lambda x: F.floor(x * float(scale))).alias("v"))
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
    )


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Integer lists as rows of a matrix, short ones filled with zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), int(lengths.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _index_block(rows: pa.Table) -> pa.Table:
    """One index row from the vectors of one block."""
    rows = rows.combine_chunks()
    ids = rows["vec_id"].to_numpy()
    v = _matrix(rows["v"].combine_chunks() if isinstance(rows["v"], pa.ChunkedArray) else rows["v"])
    flat = v.ravel()
    size = np.abs(flat)
    step = max(1, -(-int(size.max(initial=0)) // LEVELS))
    level = size // step
    order = np.argsort(-level, kind="stable")
    order = order[: np.count_nonzero(level)]  # level 0 adds nothing: it is in what is missing
    levels, counts = np.unique(-level[order], return_counts=True)
    slots = np.where(flat[order] < 0, ~order, order).astype(np.int32)
    return pa.table(
        {
            "block": pa.array([rows["block"][0].as_py()], pa.int32()),
            "dims": pa.array([v.shape[1]], pa.int32()),
            "step": pa.array([step], pa.int64()),
            "ids": pa.array([ids], pa.list_(pa.int64())),
            "components": pa.array([flat], pa.list_(pa.int64())),
            "impacts": pa.array([-levels * step + step // 2], pa.list_(pa.int64())),
            "ends": pa.array([np.cumsum(counts).astype(np.int32)], pa.list_(pa.int32())),
            "slots": pa.array([slots], pa.list_(pa.int32())),
        }
    )


def build_index(vectors: DataFrame, blocks: int) -> DataFrame:
    """Index of (vec_id, v) rows, one row per block; every vector is in it."""
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return ship(dealt).groupBy("block").applyInArrow(_index_block, INDEX_SCHEMA)


def _best(query_ids, queries, ids, v, impacts, ends, slots, k):
    """Yield (query_id, ids, scores) of the best k of one block for every query."""
    n, dims = v.shape
    q = np.zeros((len(queries), max(dims, queries.shape[1])), dtype=np.int64)
    q[:, : queries.shape[1]] = queries
    wide = np.zeros((n, q.shape[1]), dtype=np.int64)
    wide[:, :dims] = v
    exact_in_float = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, dims) < 2.0**52
    qf = q[:, :dims].astype(np.float64)
    q_norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    scores = np.zeros((len(q), n))
    read, missing = np.zeros(n * dims), v.astype(np.float64).ravel()
    own = query_ids[:, None] == ids[None, :]
    done, possible = 0, np.ones((len(q), n), dtype=bool)
    marks = sorted({int(np.searchsorted(ends, share * len(slots))) + 1 for share in CHECKS} | {len(ends)})
    for mark in (m for m in marks if m <= len(ends)):
        read[:] = 0
        for s in range(done, mark):  # segments in descending impact
            part = slots[ends[s - 1] if s else 0 : ends[s]]
            up, down = part[part >= 0], ~part[part < 0]
            read[up], read[down] = impacts[s], -impacts[s]
        done = mark
        scores += qf @ read.reshape(n, dims).T
        missing -= read
        bound = np.outer(q_norm, np.sqrt((missing.reshape(n, dims) ** 2).sum(1)))
        bound += 1e-9 * (np.abs(scores) + bound) + 1e-6  # rounding of the sums
        low = np.where(own, -np.inf, scores - bound)
        least = np.partition(low, n - k, axis=1)[:, n - k] if n >= k else np.full(len(q), -np.inf)
        possible = ~own & (scores + bound >= least[:, None])
        if exact_in_float and possible.sum() <= RESCORE * len(q):
            break
    possible &= ~own
    for i, query_id in enumerate(query_ids):
        rows = np.flatnonzero(possible[i])
        exact = wide[rows] @ q[i]
        top = np.lexsort((ids[rows], -exact))[:k]
        yield query_id, ids[rows][top], exact[top]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name, r=r, b=batch: b.column(name)[r].values.to_numpy()
                ids = get("ids")
                v = get("components").reshape(len(ids), batch.column("dims")[r].as_py())
                query_ids, queries = get("query_ids"), _matrix(batch.column("queries")[r].values)
                for at in range(0, len(query_ids), 256):
                    cut = slice(at, at + 256)
                    found = list(_best(query_ids[cut], queries[cut], ids, v, get("impacts"), get("ends"), get("slots"), k))
                    yield pa.record_batch(
                        {
                            "query_id": pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int64()),
                            "vec_id": pa.array(np.concatenate([f[1] for f in found]), pa.int64()),
                            "score": pa.array(np.concatenate([f[2] for f in found]), pa.int64()),
                        }
                    )

    return run


def search(index: DataFrame, queries: DataFrame, blocks: int, query_blocks: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the best ``k`` of the index for every (vec_id, v) query."""
    packed = (
        queries.withColumn("query_block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)))
        .groupBy("query_block")
        .agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
        .select("query_block", F.col("rows.vec_id").alias("query_ids"), F.col("rows.v").alias("queries"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    met = packed.hint("merge").join(index, "block").select("query_ids", "queries", "dims", "ids", "components", "impacts", "ends", "slots")
    found = ship(met).mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """The ``k`` best other rows for each row whose id ``every`` divides."""
    rows = saved(quantised(vectors, id_col, vector_col, scale), "vectors")
    is_query = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    blocks, query_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_queries // QUERY_ROWS))
    index = saved(build_index(rows, blocks), "impact-index")
    return search(index, rows.where(is_query), blocks, query_blocks, k)


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products for every fiftieth vector, against all others."""
    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_top_k": op1_top_k}

ORACLES = {
    "op1_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
}
