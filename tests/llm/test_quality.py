import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlens.llm import discriminant, rules

SF = os.environ.get("TEST_LLM_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, x int")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    ones = np.array(labels) == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_discriminant_tells_held_out_rows(given):
    docs, labels = given
    rows = discriminant.classify(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    assert len(rows) > 80
    assert auc([r.score for r in rows], [r.quality for r in rows]) > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_discriminant_covers_every_row_and_ignores_held_out_labels(spark, given):
    docs, labels = given
    got = discriminant.classify(docs, labels)
    assert got.count() == docs.count()
    assert {r.doc_id for r in got.where("held_out").collect()} == {r.doc_id for r in docs.select("doc_id").collect() if held_out(r.doc_id)}
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in got.collect()}
    b = {r.doc_id: r.score for r in discriminant.classify(docs, flipped).collect()}
    assert all(abs(a[d] - b[d]) < 1e-9 for d in a)


def test_discriminant_without_labels_with_nulls_and_repeats(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, None), (1, None), (None, "text"), (3, ""), (4, " \n\t"), (5, "w " * 50_000)]
    got = discriminant.classify(corpus(spark, rows), labels).collect()
    assert len(got) == 6 and {(r.score, r.predicted) for r in got} == {(0.5, 1)} and not any(r.held_out for r in got if r.doc_id is None)
    assert discriminant.classify(corpus(spark, []), labels).count() == 0
    assert discriminant.labelled(labels).collect() == [(1, 0)]


def test_discriminant_scores_odd_texts_and_filters(spark, given):
    docs, labels = given
    odd = docs.select("doc_id", "text").union(spark.createDataFrame([(None, None), (-1, ""), (-2, "ж" * 30_000)], "doc_id long, text string"))
    got = discriminant.classify(odd, labels)
    assert got.where("score IS NULL OR score < 0 OR score > 1 OR isnan(score)").count() == 0
    good = {r.doc_id for r in discriminant.classify(docs, labels).where("predicted = 1").collect()}
    kept = discriminant.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good


def plain_base(text):
    """The base counts, written out."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside |= set(range(i, i + 8))
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(inside), failed


def test_base_counts_equal_brute_force(spark, given):
    rng = random.Random(3)
    phrase = [f"w{i}" for i in range(9)]
    odd = ["", None, "one", "a\xa0b c " * 9, "é|ü " * 30, "x\n x\nx\n\n\n \nx", " ".join(phrase * 2), " ".join(phrase[:8] + ["y"] + phrase[:8])]
    odd += [" ".join(rng.choice("abc") for _ in range(60)) for _ in range(10)] + ["a\x0bb\x0cc\r\nd " * 30, "same " * 3000]
    rows = [(i, t) for i, t in enumerate(odd)]
    rows += [(1000 + r.doc_id, r.text) for r in given[0].where("n_chars < 4000").select("doc_id", "text").collect()[:150]]
    got = {r.doc_id: tuple(r)[1:7] for r in rules.judge(corpus(spark, rows), rules.Model(None, 0.0, 1.0, 0.0)).collect()}
    assert got == {i: plain_base(t) for i, t in rows}


def test_rules_tell_held_out_rows(given):
    docs, labels = given
    model = rules.fit(docs, labels)
    rows = [r for r in rules.judge(docs, model).join(labels, "doc_id").select("doc_id", "score", "kept", "base_failed", "quality").collect()]
    left = [r for r in rows if held_out(r.doc_id)]
    assert auc([r.score for r in left], [r.quality for r in left]) > 0.95
    clean = [r for r in left if r.quality == 1 and not r.base_failed]
    assert np.mean([r.kept for r in clean]) > 0.97
    assert np.mean([r.kept for r in left if r.quality == 0]) < 0.15
    assert not any(r.kept and r.base_failed for r in rows)


def test_scores_are_calibrated(given):
    docs, labels = given
    model = rules.fit(docs, labels)
    rows = [r for r in rules.judge(docs, model).join(labels, "doc_id").select("doc_id", "score", "quality").collect() if held_out(r.doc_id)]
    assert abs(np.mean([r.score for r in rows]) - np.mean([r.quality for r in rows])) < 0.08


def test_rules_without_labels_nulls_repeats_empty(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(None, None), (None, None), (2, " ".join(f"w{i}" for i in range(22)))]
    docs = corpus(spark, rows)
    model = rules.fit(docs, labels)
    assert model.weights is None
    got = rules.judge(docs, model).collect()
    assert sorted(((r.doc_id, r.n_words, r.base_failed, r.kept) for r in got), key=repr) == [(2, 22, False, True), (None, 0, True, False), (None, 0, True, False)]
    assert rules.judge(corpus(spark, []), model).count() == 0
    kept = rules.accepted(docs, labels)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]


def test_sample_is_bounded(spark, given, monkeypatch):
    monkeypatch.setattr(rules, "SAMPLE_PER_CLASS", 20)
    model = rules.fit(*given)
    assert model.weights is not None and model.weights.shape == (rules.KINDS * rules.BUCKETS,)
