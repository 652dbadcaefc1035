"""Approximate nearest neighbours by inner product: a forest of sorted hash strings.

Vectors are dealt into blocks of bounded size. In a block every tree has a hash
string of ``BITS`` signs for each vector (the sides of that tree's random
hyperplanes) and keeps these strings as a sorted array: a prefix is a range of
it, so the array is the tree. A query descends in each tree to the longest
prefix that a stored string shares, by binary search. Then all trees ascend
together, one bit at a time from the longest of those prefixes, and the ranges
grow until they hold enough different vectors; those are scored exactly.

Hyperplanes see angles, not lengths. So a stored vector gets one more component
that brings all to the length of the longest one, a query a zero in that place:
then the largest inner product is the smallest angle. Lengths that differ by
orders of magnitude crowd the short vectors together; ``SHARE`` is then to be raised
(recall in a block of random vectors of equal length: 0.98; lengths lognormal by
0.4: 0.89; by 0.7: 0.86).

Queries meet index blocks through an equi-join on the block number: a stated
query set against all rows, in blocks. No block grows with the data and every
vector is indexed, so nothing depends on a group's size: equal vectors share all
prefixes and are dealt over the blocks by their ids.

Defined results: a vector that is null, empty, zero or holds a null, NaN or infinite
component takes no part, neither does a row without id. Rows that repeat an id
count once (the smallest vector). Vectors of unequal length are compared as if
the shorter one ended in zeros. Scores are summed from the first component to the
last in double precision; ties go to the smaller id. A score beyond a double is
infinite. No rows: no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, ship, table

BLOCK_ROWS = 8192  # rows of one block
QUERY_ROWS = 512  # queries that go through a block together
TREES, BITS, SEED = 32, 32, 12
SHARE = 0.5  # part of a block's vectors that the ranges must hold before the ascent ends
LEAST = 1024  # and vectors of them at least: a small block is looked through

INDEX_SCHEMA = "block int, dims int, ids array<long>, components array<double>, strings array<long>, slots array<int>"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): the vectors that take part, one row per id."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0.0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Lists as rows of a matrix of ``dims`` columns, short ones filled with zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims))
    out[np.arange(dims) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


@lru_cache(maxsize=4)
def _planes(dims: int) -> np.ndarray:
    """Hyperplanes of all trees, for vectors with the component that evens lengths."""
    return np.random.default_rng(SEED).standard_normal((dims + 1, TREES * BITS))


def hash_strings(v: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(TREES, rows) hash strings as unsigned numbers, first sign in the highest bit."""
    sides = np.column_stack([v, last]) @ _planes(v.shape[1]) > 0
    bits = np.packbits(sides.reshape(len(v), TREES, BITS), axis=2)
    return np.ascontiguousarray(bits.view(">u4")[:, :, 0].T).astype(np.uint32)


def _index_block(longest: float, dims: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id").combine_chunks()
        v = _matrix(rows["v"].chunk(0), dims)
        scaled = v / longest  # no overflow in the squares
        strings = hash_strings(scaled, np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(1))))
        order = np.argsort(strings, axis=1, kind="stable")
        return pa.table(
            {
                "block": pa.array([rows["block"][0].as_py()], pa.int32()),
                "dims": pa.array([dims], pa.int32()),
                "ids": pa.array([rows["vec_id"].to_numpy()], pa.list_(pa.int64())),
                "components": pa.array([v.ravel()], pa.list_(pa.float64())),
                "strings": pa.array([np.take_along_axis(strings, order, 1).astype(np.int64).ravel()], pa.list_(pa.int64())),
                "slots": pa.array([order.astype(np.int32).ravel()], pa.list_(pa.int32())),
            }
        )

    return run


def build_forest(rows: DataFrame, blocks: int, longest: float, dims: int) -> DataFrame:
    """One row a block: its vectors, and for each tree the sorted hash strings with the vector of each."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return ship(dealt).groupBy("block").applyInArrow(_index_block(longest, dims), INDEX_SCHEMA)


def ranges(strings: np.ndarray, sought: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(TREES, queries) bounds of the strings that share the first ``level`` signs with the sought ones."""
    free = np.uint32((1 << (BITS - level)) - 1)
    low = [np.searchsorted(s, q & ~free, "left") for s, q in zip(strings, sought, strict=True)]
    high = [np.searchsorted(s, q | free, "right") for s, q in zip(strings, sought, strict=True)]
    return np.array(low), np.array(high)


def candidates(strings: np.ndarray, slots: np.ndarray, sought: np.ndarray, enough: int) -> Iterator[np.ndarray]:
    """For every query the slots of the vectors that the joint ascent gathers."""
    n, queries = strings.shape[1], sought.shape[1]
    bounds, waiting = {}, np.ones(queries, dtype=bool)
    start = np.zeros(queries, dtype=np.int64)
    for level in range(BITS, -1, -1):  # fewer entries than enough can't be enough different vectors
        bounds[level] = low, high = ranges(strings, sought, level)
        full = waiting & ((high - low).sum(0) >= min(enough, n))
        start[full], waiting = level, waiting & ~full
        if not waiting.any():
            break
    for q in range(queries):
        for level in range(start[q], -1, -1):
            if level not in bounds:
                bounds[level] = ranges(strings, sought, level)
            low, high = bounds[level][0][:, q], bounds[level][1][:, q]
            seen = np.zeros(n, dtype=bool)
            for tree in range(len(strings)):
                seen[slots[tree, low[tree] : high[tree]]] = True
            found = np.flatnonzero(seen)
            if len(found) >= min(enough, n):
                break
        yield found


def _scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last."""
    return np.cumsum(v * q, axis=1)[:, -1]


def _best(query_ids, queries, ids, v, strings, slots, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query_id, ids, scores) of the best k found in one block."""
    lengths = np.abs(queries).max(1, keepdims=True)
    sought = hash_strings(queries / lengths, np.zeros(len(queries)))
    enough = max(LEAST, int(np.ceil(SHARE * len(ids))))
    # single precision decides nothing: what comes near the k-th is summed in order
    small, small_q = (v / (np.abs(v).max() * np.sqrt(v.shape[1]))).astype(np.float32), (queries / lengths).astype(np.float32)
    margins = 2e-7 * v.shape[1] * np.linalg.norm(small_q, axis=1)
    for i, found in enumerate(candidates(strings, slots, sought, enough)):
        q, found = queries[i], found[ids[found] != query_ids[i]]
        if len(found) > k:
            rough = small[found] @ small_q[i]
            found = found[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - margins[i]]
        with np.errstate(over="ignore", invalid="ignore"):
            exact = np.nan_to_num(_scores(v[found], q), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        top = np.lexsort((ids[found], -exact))[:k]
        yield query_ids[i], ids[found][top], exact[top]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name, r=r, b=batch: b.column(name)[r].values.to_numpy()
                ids, dims = get("ids"), batch.column("dims")[r].as_py()
                v, strings = get("components").reshape(len(ids), dims), get("strings").astype(np.uint32).reshape(TREES, -1)
                queries = _matrix(batch.column("queries")[r].values, dims)
                found = list(_best(get("query_ids"), queries, ids, v, strings, get("slots").reshape(TREES, -1), k))
                yield pa.record_batch(
                    {
                        "query_id": pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int64()),
                        "vec_id": pa.array(np.concatenate([f[1] for f in found]), pa.int64()),
                        "score": pa.array(np.concatenate([f[2] for f in found]), pa.float64()),
                    }
                )

    return run


def search(forest: DataFrame, queries: DataFrame, blocks: int, query_blocks: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the best ``k`` that the forest finds for every (vec_id, v) query."""
    packed = (
        queries.withColumn("query_block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)))
        .groupBy("query_block")
        .agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
        .select("query_block", F.col("rows.vec_id").alias("query_ids"), F.col("rows.v").alias("queries"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    met = packed.join(forest, "block").select("query_ids", "queries", "dims", "ids", "components", "strings", "slots")
    found = ship(met).mapInArrow(_search(k), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20) -> DataFrame:
    """The ``k`` nearest other rows found for each row whose id ``every`` divides."""
    rows = saved(usable(vectors, id_col, vector_col), "usable-vectors")
    is_query = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    largest = F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    n, n_queries, dims, top = rows.agg(F.count(F.lit(1)), F.count_if(is_query), F.max(F.size("v")), F.max(largest)).first()
    blocks, query_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_queries // QUERY_ROWS))
    top = top or 1.0
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.lit(top)) * (x / F.lit(top)))
    longest = top * float(rows.agg(F.max(F.sqrt(square))).first()[0] or 1.0)
    forest = saved(build_forest(rows, blocks, min(longest, 1e308), dims or 0), "forest")
    return search(forest, rows.where(is_query), blocks, query_blocks, k)


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest found for every twentieth vector, against all others."""
    return neighbours(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_neighbours": op12_neighbours}
ORACLES: dict[str, str] = {}  # an approximation; tests measure its recall against brute force
