import os
import random
from collections import defaultdict

import pytest

from assetlens.llm import packing

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_best_fit(sizes, sources, clusters, capacity):
    """Every bin looked at for every piece; the smallest residual that fits, then the oldest bin."""
    bins, placed = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [
            (room, b) for b, (room, so, cl) in enumerate(bins)
            if room >= max(sizes[i], 1) and (sources[i] is None or sources[i] not in so) and (clusters[i] is None or clusters[i] not in cl)
        ]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append([capacity, set(), set()])
        bins[b][0] -= sizes[i]
        bins[b][1].add(sources[i])
        bins[b][2].add(clusters[i])
        placed[i] = b
    return placed


@pytest.mark.parametrize("seed", range(8))
def test_equals_a_plain_search(seed):
    rng = random.Random(seed)
    n = 300
    sizes = [rng.choice([0, 1, 5, 100, rng.randrange(101)]) for _ in range(n)]
    sources = [rng.choice([None, "hot", "hot", "hot", *map(str, range(9))]) for _ in range(n)]
    clusters = [rng.choice([None, *range(60), 1, 1, 1]) for _ in range(n)]
    assert packing.best_fit(sizes, sources, clusters, 100) == plain_best_fit(sizes, sources, clusters, 100)


def check(rows, pieces, capacity):
    """Every word once, no window too full, no conflict."""
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    assert set(by_doc) == set(rows)
    windows = defaultdict(list)
    for d, (words, source, cluster) in rows.items():
        at = 0
        for k, p in enumerate(sorted(by_doc[d], key=lambda p: p.piece)):
            assert (p.piece, p.first_word) == (k, at)
            at += p.n_words
            windows[p.bin_id].append((p.slot, p.n_words, source, cluster))
        assert at == words
    for held in windows.values():
        assert sum(h[1] for h in held) <= capacity
        assert sorted(h[0] for h in held) == list(range(len(held)))
        for k in (2, 3):
            named = [h[k] for h in held if h[k] is not None]
            assert len(named) == len(set(named))
    return windows


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: (len(r.text.split()), r.source, r.text.lower()) for r in docs.collect()}
    windows = check(rows, packing.op5_packing(spark, SF).collect(), packing.CAPACITY)
    assert len(windows) < len(rows)


def test_shards_long_texts_and_own_clusters(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.choice([0, 3, 40, 50, 51, 170]))), rng.choice(["hot", "a", "b", None]), i % 7) for i in range(400)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, cluster int, n_words string")
    pieces = packing.pack(df, capacity=50, shard=64, cluster="cluster").collect()
    check({r[0]: (len(r[1].split()), r[2], r[3]) for r in rows}, pieces, 50)
    assert len({p.bin_id >> 32 for p in pieces}) > 1
    assert sorted(map(tuple, packing.pack(df.repartition(7), capacity=50, shard=64, cluster="cluster").collect())) == sorted(map(tuple, pieces))


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string, source string"
    rows = [(None, None, None), (None, "a b", "s"), (1, "a b", "s"), (1, "a b", "s"), (2, "A  B", "t"), (3, "", "u")]
    pieces = packing.pack(spark.createDataFrame(rows, schema)).collect()
    assert len(pieces) == 6 and sorted(p.n_words for p in pieces) == [0, 0, 2, 2, 2, 2]
    same = [p.bin_id for p in pieces if p.n_words == 2]
    assert len(set(same)) == 4  # one cluster
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0


def test_many_exact_repeats_are_dealt_over_all_shards(spark):
    df = spark.createDataFrame([(5, "a b c", "s")] * 1000, "doc_id long, text string, source string")
    pieces = packing.pack(df, shard=100).collect()
    assert len(pieces) == 1000 == len({p.bin_id for p in pieces}) and len({p.bin_id >> 32 for p in pieces}) == 10


def test_texts_of_windows(spark):
    df = spark.createDataFrame([(1, "a b c d e", "s"), (2, "f g", "t")], "doc_id long, text string, source string")
    got = sorted((r.n_words, r.text) for r in packing.packed_texts(df, capacity=3, separator="|").collect())
    assert got == [(2, "d e"), (2, "f g"), (3, "a b c")] or sum(len(t.replace("|", " ").split()) for _, t in got) == 7


def test_edited_copies_of_other_sources_never_share_a_window(spark, tmp_path):
    words = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(6):  # a chain of copies with a word or two changed, each of its own source
        rows.append((k, " ".join([*words[:70], f"x{k}", *words[71:]]), f"s{k}"))
    rows.append((9, " ".join(f"other{i}" for i in range(150)), "s9"))
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    bins = {p.doc_id: p.bin_id for p in packing.op5_packing(spark, str(tmp_path)).collect()}
    assert len({bins[k] for k in range(6)}) == 6 and bins[9] in {bins[k] for k in range(6)}
