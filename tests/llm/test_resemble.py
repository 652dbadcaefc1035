"""Resembling texts: fingerprints, recall of the index, groups against all pairs, hot groups."""

import random

import numpy as np
import pytest

from assetlens.llm import resemble

VOCABULARY = [f"v{i}" for i in range(4000)]
LONG = " ".join(f"x{i}" for i in range(200_000))


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = rng.choice(VOCABULARY)
    return out


def test_fingerprint_is_the_majority():
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (0, 1, 2, 255, 256, 1000)]
    got = resemble.fingerprints_of(sets)
    for s, print_ in zip(sets, got, strict=True):
        for lane, number in enumerate(resemble.LANES):
            mixed = [int(x) for x in resemble._mixed(s ^ np.uint64(number))]
            ones = [sum(x >> b & 1 for x in mixed) for b in range(64)]
            want = sum(1 << b for b, k in enumerate(ones) if 2 * k > len(mixed) or (2 * k == len(mixed) > 0 and mixed[0] >> b & 1))
            assert int(print_[lane]) == want


def test_sets_do_not_depend_on_the_batch():
    texts = ["a b c d e f a b c d e f", None, "one", "x y z", "q w e r t", "", "a b c d e F"]
    whole, counts, sets = resemble.shingle_sets(texts)
    assert counts == [12, 0, 1, 3, 5, 0, 6] and [len(s) for s in sets] == [6, 0, 1, 1, 1, 0, 2]
    for i, t in enumerate(texts):
        w, _, s = resemble.shingle_sets([t])
        assert w[0] == whole[i] and (s[0] == sets[i]).all()
    assert set(sets[6]) < set(sets[0])


def test_recall_of_the_index_at_the_limit():
    """Share of pairs that meet in a ball within the radii, at Jaccard 0.8 to 0.82 and above."""
    rng, met, near = random.Random(5), [], []
    for _ in range(600):
        base = rng.choices(VOCABULARY, k=400)
        copy = edited(rng, base, rng.randrange(2, 10))
        a, b = resemble.shingle_sets([" ".join(t) for t in (base, copy)])[2]
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        if j < 0.8:
            continue
        x, y = (int(p[0]) | int(p[1]) << 64 for p in resemble.fingerprints_of([a, b]))
        d, w = x ^ y, resemble.WIDTH
        halves, half = (d & (1 << 64) - 1, d >> 64), resemble.SEGMENTS // 2
        found = any((d >> s * w & (1 << w) - 1).bit_count() <= 1 and halves[s < half].bit_count() <= resemble.RADIUS_HALF for s in range(resemble.SEGMENTS))
        found = found and d.bit_count() <= resemble.RADIUS
        met.append(found)
        near += [found] if j <= 0.82 else []
    assert len(near) > 30 and np.mean(near) >= 0.85 and np.mean(met) >= 0.95


def plain_groups(rows):
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            one, two = a.lower().split(), b.lower().split()
            if one == two or (one and two and jaccard(a, b) >= 0.8):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i: top(i) for i, _ in rows}


def test_groups_against_all_pairs(spark):
    """Copies with few edits, a chain, other texts of one passage, texts of few words."""
    rng, texts = random.Random(11), []
    passage = rng.choices(VOCABULARY, k=60)
    for _ in range(25):
        base = rng.choices(VOCABULARY, k=rng.choice([60, 200, 500]))
        texts += [base, *(edited(rng, base, max(1, len(base) // 100)) for _ in range(3)), passage + rng.choices(VOCABULARY, k=60)]
    link = rng.choices(VOCABULARY, k=300)
    for _ in range(6):
        link = edited(rng, link, 2)
        texts.append(link)
    texts = [" ".join(t) for t in texts] + ["", "  \t", "one two", "One  TWO", "one two three", texts[0] and " ".join(texts[0]).upper()]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, a int")
    want = plain_groups(sorted(rows))
    by = {}
    for r in resemble.resembling_groups(df).collect():
        by.setdefault(r.component, set()).add(r.doc_id)
    # no group joins what all pairs keep apart; few of the links are missed
    assert all(len({want[i] for i in g}) == 1 for g in by.values())
    links = len(rows) - len(set(want.values()))
    assert links > 75 and len(by) - len(set(want.values())) <= 0.1 * links
    kept = resemble.first_resembling(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in by.values())


def test_a_large_group_is_not_compared_with_itself(spark, monkeypatch):
    """Checked pairs stay linear in a group of near copies and in texts that share most of their beginning."""
    rng, checked = random.Random(2), []
    resembling = resemble._resembling

    def counted(docs, texts, pairs):
        checked.append(pairs.count())
        return resembling(docs, texts, pairs)

    monkeypatch.setattr(resemble, "_resembling", counted)
    base, common = rng.choices(VOCABULARY, k=300), rng.choices(VOCABULARY, k=5)
    texts = [edited(rng, base, 3) for _ in range(400)] + [common + rng.choices(VOCABULARY, k=8) for _ in range(400)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = sorted(r.doc_id for r in resemble.first_resembling(df).collect())
    assert kept == [0, *range(400, 800)]
    assert sum(checked) < 4 * len(texts)


@pytest.mark.parametrize("rows", [
    [],
    [(None, None), (None, ""), (None, "a b"), (None, "a b"), (4, "A  b"), (4, "a b"), (4, "a b"), (5, None)],
    [(1, LONG), (2, LONG + " y"), (3, "z" * 1_000_000)],
])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, its_id string")
    got = sorted(((r.doc_id, r.text) for r in resemble.first_resembling(df).collect()), key=repr)
    want = {}
    for i, t in rows:
        words = tuple((t or "").lower().split())
        key = words[:9]
        want.setdefault(key, []).append((i is None, i or 0, i, t))
    assert len(got) == len(want)
    for i, t in got:
        words = tuple((t or "").lower().split())
        assert (i is None, i or 0) == min(w[:2] for w in want[words[:9]])
    assert resemble.resembling_groups(df).count() == len(rows)
