import os
import random
import re

import pytest
import xxhash

from assetlens.llm import simhash
from assetlens.llm.components import components

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def naive_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(rows):
    """Every pair of fingerprints compared; smallest id of each connected group."""
    prints = [naive_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, prints[i], least.get(top(i))) for i, (d, _) in enumerate(rows)), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    return sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)


def test_given_documents_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == naive_components(rows)


def test_nulls_empty_repeats_chains_and_case(spark):
    rng = random.Random(5)
    words = ["w%d" % rng.randrange(400) for _ in range(300)]
    rows = [(None, "a b c"), (9, "A B  c"), (9, "a b c"), (None, "only here, no id"), (None, "only here, no id"), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "ONE")]
    rows += [(30 + i, " ".join(words[: 300 - i] + ["x"] * i)) for i in range(12)]  # each near the next
    rows += [(60, "É a é"), (61, "é a é"), (62, "x y z w"), (63, "word " * 5000)]
    assert run(spark, rows) == naive_components(rows)


def test_links_hold_every_pair_within_two_bits(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)] + [0, 2**64 - 1]
    prints = set(base)
    for b in base:
        for bits in ([0], [31, 32], [63], [5, 6], [40, 41], [1, 2, 3]):
            prints.add(b ^ sum(1 << x for x in bits))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {(r.a, r.b) for r in simhash.fingerprint_links(df).collect()}
    want = {tuple(sorted((signed(p), signed(q)))) for p in prints for q in prints if p != q and (p ^ q).bit_count() <= 2}
    assert got == want


def test_one_of_each_group_stays_with_all_columns(spark):
    rows = [(3, "a b c d", 1), (2, "a b c d", 2), (2, "a b c d", 2), (7, "x y z", 3), (None, "p q r", 4), (None, "p q r", 4), (None, "x y z", 5), (8, None, 6), (9, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, turn int")
    got = simhash.first_of_each(df)
    assert got.columns == ["doc_id", "text", "turn"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([(2, "a b c d", 2), (7, "x y z", 3), (None, "p q r", 4), (8, None, 6)], key=repr)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0 and simhash.first_of_each(df).count() == 0


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(5, 4), (4, 5), (9, 8), (8, 5), (20, 21), (None, 3)]])
def test_components(spark, links):
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    near = {}
    for a, b in links:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        if n not in want:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = n
                    todo += near[x]
    assert got == want


def test_balls_are_not_broadcast(spark):
    """They are many rows a fingerprint, which Spark takes for the size of the fingerprints."""
    df = spark.range(300).selectExpr("xxhash64(id) AS fp")
    found = simhash.fingerprint_links(df)
    assert found.count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
