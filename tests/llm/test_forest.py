"""The forest of hash strings: exact on small blocks, recall on large ones, work of a search."""

import math

import numpy as np
import pytest

from assetlens.llm import forest
from assetlens.llm.common import table

SF = "/root/testdata/sf0.1"


def plain(rows, k, every):
    """Exact result of (id, vector) rows, summed in order."""
    best = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            best[i] = min(best.get(i, v), v)
    out = []
    for q in (i for i in best if i % every == 0):
        scored = []
        for i, v in best.items():
            total = 0.0
            for a, b in zip(best[q], v, strict=False):
                total += a * b
            scored += [(-total, i)] if i != q else []
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def run(spark, rows, k=3, every=2):
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int, query_id int")
    return sorted(tuple(r) for r in forest.neighbours(df, k=k, every=every).collect())


ODD = [
    (0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [-1.0, 0.25]), (2, [-2.0, 0.25]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]),
    (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (10, [3.0]), (-4, [100.0, -7.0, 2.0]), (11, [1.0, 0.5]),
]


def test_odd_rows(spark):
    assert run(spark, ODD) == plain(ODD, 3, 2)


def test_fewer_candidates_than_asked(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 2.0)]
    assert run(spark, [(0, [1.0])]) == []


def test_no_rows(spark):
    assert run(spark, [(4, None)]) == []


def test_copies_of_one_vector(spark):
    rows = [(i, [0.6, 0.8, 0.1]) if i % 3 else (i, [math.sin(i), math.cos(i), 0.0]) for i in range(400)]
    assert run(spark, rows, k=20, every=20) == plain(rows, 20, 20)


def test_lengths_count():
    """A long vector at a wider angle is found before a short one at a small angle; recall as the docstring gives it."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((6000, 16))
    v *= rng.lognormal(0, 0.4, (6000, 1))
    longest = np.sqrt((v**2).sum(1)).max()
    scaled = v / longest
    strings = forest.hash_strings(scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1))))
    order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
    ids, queries = np.arange(6000), rng.standard_normal((50, 16))
    found = forest._best(np.full(50, -1), queries, ids, v, np.take_along_axis(strings, order, 1), order, 20)
    hits = [len(set(f[1]) & set(np.argsort(-(v @ q))[:20])) for f, q in zip(found, queries, strict=True)]
    assert np.mean(hits) / 20 >= 0.85


def test_ranges_are_prefixes():
    rng = np.random.default_rng(6)
    strings = np.sort(rng.integers(0, 1 << 32, (forest.TREES, 500), dtype=np.uint32), axis=1)
    sought = rng.integers(0, 1 << 32, (forest.TREES, 7), dtype=np.uint32)
    for level in (0, 1, 5, 31, 32):
        low, high = forest.ranges(strings, sought, level)
        same = (strings[:, None, :].astype(np.int64) >> (32 - level)) == (sought[:, :, None].astype(np.int64) >> (32 - level))
        assert (high - low == same.sum(2)).all()


@pytest.mark.parametrize("block_rows", [8192, 700])
def test_recall_over_the_given_vectors(spark, monkeypatch, block_rows):
    """Also where blocks are so small that most of the result lies in other blocks, with no block looked through."""
    monkeypatch.setattr(forest, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(forest, "LEAST", 50)
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    got = forest.op12_neighbours(spark, SF).collect()
    want = {}
    v, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        s[i] = -np.inf
        want[ids[i]] = set(ids[np.lexsort((ids, -s))[:20]])
    assert len(got) == 20 * len(want)
    assert sum(r.vec_id in want[r.query_id] for r in got) / len(got) >= 0.9
    at = dict(rows)
    assert all(abs(r.score - float(np.dot(at[r.query_id], at[r.vec_id]))) < 1e-12 for r in got)
