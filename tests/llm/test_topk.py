import numpy as np
import pytest

from assetlens.llm import topk


def brute(rows, k, every):
    """Straight from the definition, in Python integers."""
    import math

    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(256 * float(x)) for x in v]
            best[i] = min(best.get(i, w), w)
    out = []
    for q, a in best.items():
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in best.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, k=5, every=50):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, ids string")
    return sorted(tuple(r) for r in topk.top_k(df, k=k, every=every).collect())


def vectors(n, dims, seed, scale=0.3):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(0, scale, dims)], 1, "x") for i in range(n)]


@pytest.mark.parametrize("n,dims,k", [(400, 16, 5), (120, 1, 3), (3, 4, 5), (1, 4, 5)])
def test_equals_brute_force(spark, n, dims, k):
    rows = vectors(n, dims, n)
    assert run(spark, rows, k=k) == brute([r[:2] for r in rows], k, 50)


def test_several_blocks_and_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    rows = vectors(500, 8, 7)
    assert run(spark, rows, every=10) == brute([r[:2] for r in rows], 5, 10)


def test_ties_go_to_smaller_ids_even_for_one_vector_only(spark):
    rows = [(i, [0.5, -0.25], 0, "") for i in range(300)]
    got = run(spark, rows)
    assert got == brute([r[:2] for r in rows], 5, 50)
    assert [g[2] for g in got if g[0] == 50] == [0, 1, 2, 3, 4]


def test_nulls_odd_values_repeats_and_unequal_lengths(spark):
    rows = vectors(60, 4, 3)
    rows += [(100, None, 1, ""), (150, [1.0, None, 0.0, 0.0], 1, ""), (200, [float("nan")] * 4, 1, ""), (250, [float("inf"), 0.0, 0.0, 0.0], 1, "")]
    rows += [(None, [1.0] * 4, 1, ""), rows[50], rows[7]]
    assert run(spark, rows) == brute([r[:2] for r in rows], 5, 50)
    short = [(0, [1.0, 1.0], 1, ""), (1, [1.0], 1, ""), (2, [0.5, 1.0], 1, ""), (3, [], 1, "")]
    assert [(r[2], r[3]) for r in run(spark, short)] == [(2, 256 * 128 + 256 * 256), (1, 256 * 256), (3, 0)]


def test_large_components_are_exact(spark):
    rows = [(i, [1e6 + i, -1e6, 3.0], 1, "") for i in range(80)]
    assert run(spark, rows) == brute([r[:2] for r in rows], 5, 50)


def test_empty(spark):
    assert run(spark, []) == []


def test_query_blocks_are_not_broadcast(spark, monkeypatch):
    """They have a row for every index block, many times the size that Spark takes them for."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    df = spark.createDataFrame(vectors(500, 8, 7), "vec_id long, embedding array<float>, score int, ids string")
    found = topk.top_k(df)
    assert len(found.collect()) == 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
