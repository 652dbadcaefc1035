"""Centroid clustering against plain integer rounds."""

import hashlib
import math
import os

import duckdb
import pytest

from assetlens.llm import centroids

SF = "/root/testdata/sf0.001"


def plain(rows, dims, clusters, rounds, scale, seed):
    """(final centroids, {row number: (cluster, distance)}) of (id, vector) rows."""
    top = centroids.LARGEST
    kept = [
        (i, [max(-top, min(top, math.floor(scale * x))) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    digest = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "~"
    at = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:clusters]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((dist(v, c), k) for k, c in enumerate(at))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        at = [[sum(col) // len(groups[k]) for col in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(at)]
    return at, sorted((-1 if i is None else i, nearest(v)[1], nearest(v)[0]) for i, v in kept)


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(i, v, "x", 7) for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance int")
    found, at = centroids.clustering(docs, **kw)
    return at, sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in found.collect())


ODD = [
    (1, [0.5, -0.25]), (2, [0.5, -0.25]), (2, [0.5, -0.25]), (3, None), (4, [1.0]), (5, [None, 1.0]), (6, [float("nan"), 0.0]),
    (7, [float("inf"), 0.0]), (8, []), (None, [9.0, 9.0]), (9, [-3.0, 2.0]), (10, [-3.1, 2.2]), (11, [0.0, -0.0]), (12, [3e38, -3e38]),
]


@pytest.mark.parametrize("clusters", [1, 3, 20])
def test_odd_rows(spark, clusters):
    kw = {"dims": 2, "clusters": clusters, "rounds": 4, "scale": 16, "seed": 3}
    assert run(spark, ODD, **kw) == plain(ODD, **kw)


def test_no_rows(spark):
    assert run(spark, [(3, None)]) == ([], [])


def test_most_rows_alike(spark):
    rows = [(i, [1.0, 1.0] if i % 3 else [i / 50, -i / 70]) for i in range(300)]
    kw = {"dims": 2, "clusters": 5, "rounds": 10, "scale": 1024, "seed": 3}
    assert run(spark, rows, **kw) == plain(rows, **kw)


def test_query_equals_sql(spark):
    got = centroids.op13_centroids(spark, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{os.path.join(SF, 'embeddings.parquet')}'")
    want = con.sql(centroids.ORACLES["op13_centroids"]).project(", ".join(got.columns)).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert not any(word in got._jdf.queryExecution().executedPlan().toString() for word in ("Python", "Arrow", "Window"))
