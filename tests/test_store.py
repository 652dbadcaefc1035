"""Versions, snapshots of a file store, key filters, the stored search index."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from assetlens.operators import retrieval, search_index
from assetlens.sources import deal_files, key_filters, snapshots, versions
from assetlens.streaming import ingest


def deal_file(folder, name, *numbers, packed=False):
    folder.mkdir(exist_ok=True)
    rows = ["~".join(deal_files.DEAL_COLUMNS)]
    rows += ["~".join(f'"{v}"' for v in ({c: "" for c in deal_files.DEAL_COLUMNS} | {"number": n, "quarter_cad_number": f"77:{n}"}).values()) for n in numbers]
    text = "\n".join(rows).encode()
    (folder / name).write_bytes(gzip.compress(text) if packed else text)


def numbers(spark, store, version=None):
    rows = snapshots.snapshot(spark, store, version).select("dataset_file", "number").collect()
    return sorted((r.dataset_file, r.number) for r in rows)


def test_a_version_is_made_once_and_whole(spark, tmp_path):
    root = str(tmp_path / "v")
    assert versions.latest(spark, root) == (0, None)
    assert versions.commit(spark, root, 1, {"a": 1}) == 1
    with pytest.raises(versions.Overtaken):
        versions.commit(spark, root, 1, {"a": 2})
    (tmp_path / "v/versions/00000002").write_text('{"a": 3}')  # a writer that died before the line end
    assert versions.latest(spark, root) == (1, {"a": 1})
    with pytest.raises(LookupError):
        versions.at_version(spark, root, 2)


def test_update_starts_again_when_overtaken(spark, tmp_path):
    root, seen = str(tmp_path / "v"), []

    def change(old):
        seen.append(old)
        if len(seen) == 1:
            versions.commit(spark, root, 1, {"n": 10})
        return {"n": (old or {"n": 0})["n"] + 1}

    assert versions.update(spark, root, change) == 2
    assert versions.latest(spark, root) == (2, {"n": 11}) and seen == [None, {"n": 10}]


@pytest.mark.parametrize("max_files", [1, 100])
def test_stream_of_same_named_and_packed_files(spark, tmp_path, max_files):
    """The store does not depend on how the files fall into batches; plain text is preferred to .gz, then the first path."""
    deal_file(tmp_path / "b", "dataset_СДЕЛКИ_y_2025_q_1.csv", *"12345")
    deal_file(tmp_path / "a", "dataset_СДЕЛКИ_y_2025_q_1.csv", *"1234567")
    deal_file(tmp_path / "a", "dataset_x+y z_y_2025_q_2.csv.gz", "8", packed=True)
    deal_file(tmp_path / "b", "dataset_x+y z_y_2025_q_2.csv", "9")
    deal_file(tmp_path / "b", "dataset_АРЕНДА_y_2025_q_3.csv.gz", "7", packed=True)
    deal_file(tmp_path / "b", "dataset_none_y_2025_q_4.csv")
    store = str(tmp_path / "store")
    for _ in range(2):
        ingest.load_available(spark, str(tmp_path / "[ab]"), store, str(tmp_path / "check"), max_files=max_files).awaitTermination()
    first = "dataset_СДЕЛКИ_y_2025_q_1.csv"
    assert numbers(spark, store) == sorted([(first, n) for n in "1234567"] + [("dataset_x+y z_y_2025_q_2.csv", "9"), ("dataset_АРЕНДА_y_2025_q_3.csv", "7")])
    kept = {(os.path.basename(os.path.dirname(r.path)), r.dataset_file): r.rows for r in snapshots.manifest(spark, store).collect()}
    assert kept[("b", first)] == 5 and kept[("a", first)] == 7 and kept[("b", "dataset_none_y_2025_q_4.csv")] == 0


def test_changed_shrunk_emptied_and_removed_files(spark, tmp_path):
    land, store = tmp_path / "land", str(tmp_path / "store")
    names = [f"dataset_y_2025_q_{q}.csv" for q in (1, 2, 3)]

    def sync():
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "dataset_*").load(str(land)).select(*snapshots.FILE_COLUMNS)
        new = snapshots.changed(listed, store)
        paths = [r.path for r in new.collect()]
        if paths:
            snapshots.load(deal_files.scan_deals(spark, paths, with_path=True), spark.createDataFrame(new.collect(), new.schema), store)
        return sorted(os.path.basename(p) for p in paths)

    for name in names:
        deal_file(land, name, "1", "2")
    assert sync() == names and sync() == []
    deal_file(land, names[0])
    deal_file(land, names[1], "2")
    assert sync() == names[:2]
    assert numbers(spark, store) == [(names[1], "2"), (names[2], "1"), (names[2], "2")]
    assert len(numbers(spark, store, 1)) == 6  # a reader of the version before
    snapshots.remove(snapshots.manifest(spark, store).where(F.col("dataset_file") == names[2]).select("path"), store)
    assert numbers(spark, store) == [(names[1], "2")]
    assert snapshots.vacuum(spark, store) == 1
    assert numbers(spark, store) == [(names[1], "2")]


def test_key_search_opens_few_files(spark, tmp_path):
    store, rng = str(tmp_path / "store"), random.Random(3)
    rows = [(f"file:/d/dataset_{f}.csv", str(rng.randrange(10**6)), f * 100 + i) for f in range(20) for i in range(50)]
    rows += [("file:/d/dataset_3.csv", "000500", -1), ("file:/d/dataset_17.csv", "000500", -2), ("file:/d/dataset_5.csv", None, -3)]
    df = spark.createDataFrame(rows, "path string, key string, v int")
    files = df.select("path").distinct().select("path", F.lit(1).cast("bigint").alias("length"), F.current_timestamp().alias("modificationTime"))
    snapshots.load(df, files, store)
    key_filters.extend(spark, store, "key")
    key_filters.extend(spark, store, "key")
    assert key_filters.filters(spark, store, "key").count() == 20

    def opened(key):
        found = key_filters.search(spark, store, "key", key)
        return sorted((r.v, r.dataset_file) for r in found.collect()), len({os.path.dirname(f) for f in found.inputFiles()})

    got, n = opened("000500")
    assert got == [(-2, "dataset_17.csv"), (-1, "dataset_3.csv")] and n <= 3
    late = spark.createDataFrame([("file:/d/dataset_99.csv", "000500", 7), ("file:/d/dataset_3.csv", "1", 8)], "path string, key string, v int")
    snapshots.load(late, late.select("path").distinct().select("path", F.lit(1).cast("bigint").alias("length"), F.current_timestamp().alias("modificationTime")), store)
    got, n = opened("000500")  # files without a filter are read, replaced ones no longer
    assert got == [(-2, "dataset_17.csv"), (7, "dataset_99.csv")] and n <= 5
    assert [v for v, _ in opened("no such key")[0]] == []
    every = {r.key for r in df.where("key IS NOT NULL").collect()}
    for key in rng.sample(sorted(every), 5):
        want = sorted(r.v for r in snapshots.snapshot(spark, store).where(F.col("key") == key).collect())
        assert [v for v, _ in opened(key)[0]] == want


def corpus(spark, n, seed):
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.expovariate(0.08)), 60)}"
    rows = [(i, "common " * rng.randrange(4) + " ".join(word() for _ in range(rng.randrange(25)))) for i in range(n)] + [(n, ""), (n + 1, None), (n + 2, "alone")]
    return spark.createDataFrame(rows, "id long, text string")


def ranked(hits):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in hits.collect())


@pytest.mark.parametrize("budget", [1, 40, 65_536])
def test_stored_index_equals_a_plain_search(spark, tmp_path, monkeypatch, budget):
    """Whatever the reading budget: proofs end the reading, they never change the result."""
    monkeypatch.setattr(search_index, "BUDGET", budget)
    monkeypatch.setattr(search_index, "BLOCK", 16)
    docs, root = corpus(spark, 400, budget), str(tmp_path / "ix")
    texts = ["common w1 w40", "w0 w2 w3 w5 w8 w13 w55", "alone", "nothing of it", "", "common common", "w60 w59 w58"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    tokens, terms = retrieval.tokenised(docs, "id", "text"), retrieval.query_terms(queries, "query_id", "text")
    for step, part in enumerate(("id % 3 = 0", "id % 3 = 1", "id % 3 = 2"), 1):
        assert search_index.add(docs.where(part), root, "id", ("text",)) == step
    whole = ranked(retrieval.bm25(retrieval.postings(tokens), retrieval.corpus_stats(tokens), terms, 7))
    assert ranked(search_index.search(spark, root, queries, 7)) == whole
    first = retrieval.tokenised(docs.where("id % 3 = 0"), "id", "text")
    old = ranked(retrieval.bm25(retrieval.postings(first), retrieval.corpus_stats(first), terms, 7))
    assert ranked(search_index.search(spark, root, queries, 7, version=1)) == old != whole
    if budget == 40:
        search_index.merge(spark, root)
        assert ranked(search_index.search(spark, root, queries, 7)) == whole
        df = {r.term: r.df for r in search_index.term_statistics(spark, root).collect()}
        assert df == {r.term: r.n for r in retrieval.postings(tokens).groupBy("term").agg(F.count("*").alias("n")).collect()}
        biggest = spark.read.parquet(f"{root}/segments/*/postings").agg(F.max("n")).first()[0]
        assert biggest < 60  # blocks stay bounded though one word is in most documents


def test_common_words_are_not_read(spark, tmp_path, monkeypatch):
    """The postings of a word in every document stay unread where rare words settle the query."""
    read = []
    sums = search_index._sums
    monkeypatch.setattr(search_index, "BUDGET", 50)
    monkeypatch.setattr(search_index, "_sums", lambda chosen, postings, mean: read.append(postings.join(chosen, ["term", "level"]).agg(F.sum(postings["n"])).first()[0]) or sums(chosen, postings, mean))
    rows = [(i, "everywhere " + (f"rare{i % 40} " * 3 if i % 40 < 5 else "filler")) for i in range(2000)]
    docs, root = spark.createDataFrame(rows, "id long, text string"), str(tmp_path / "ix")
    search_index.add(docs, root, "id", ("text",))
    queries = spark.createDataFrame([(i, f"everywhere rare{i}") for i in range(5)], "query_id int, text string")
    found = ranked(search_index.search(spark, root, queries, 5))
    assert [f[2] for f in found if f[0] == 2] == [2, 42, 82, 122, 162]
    assert sum(read) <= 5 * 60  # of 5 * 2050


def test_empty_index_parts(spark, tmp_path):
    root = str(tmp_path / "ix")
    none = spark.createDataFrame([], "id long, text string")
    search_index.add(none, root, "id", ("text",))
    queries = spark.createDataFrame([(1, "word")], "query_id int, text string")
    assert ranked(search_index.search(spark, root, queries)) == []
    search_index.add(spark.createDataFrame([(1, "Word!")], "id long, text string"), root, "id", ("text",))
    assert [f[2] for f in ranked(search_index.search(spark, root, queries))] == [1]


def test_words_are_counted_inside_the_row(spark):
    """The counts of a document need no shuffle: its words are in one row."""
    texts = ["b a b", "", None, "c c c a Ä 1 a", "one"]
    tokens = retrieval.tokenised(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text")
    counted = search_index._counted(tokens)
    got = {r.doc_id: (r.dl, [(t.term, t.tf) for t in r.terms]) for r in counted.collect()}
    assert got == {0: (3, [("a", 1), ("b", 2)]), 1: (0, []), 2: (0, []), 3: (7, [("1", 1), ("a", 3), ("c", 3)]), 4: (1, [("one", 1)])}
    assert "Exchange" not in counted._jdf.queryExecution().toString()


def test_postings_are_dealt_once(spark, tmp_path, monkeypatch):
    """Only the cells of several blocks are joined to the postings, and a merge tokenises and sorts nothing."""
    monkeypatch.setattr(search_index, "BLOCK", 16)
    docs, root = corpus(spark, 300, 5), str(tmp_path / "ix")
    search_index.add(docs.where("id % 2 = 0"), root, "id", ("text",))
    search_index.add(docs.where("id % 2 = 1"), root, "id", ("text",))
    search_index.merge(spark, root)
    name = versions.at_version(spark, root)[1]["segments"][0]["name"]
    split, terms = (spark.read.parquet(f"{root}/segments/{name}/{t}") for t in ("split", "terms"))
    assert 0 < split.count() == terms.where("df > 16").count() < terms.count()
    assert split.where("blocks < 2").isEmpty()
    held = spark.read.parquet(f"{root}/segments/{name}/postings").groupBy("term", "level").agg(F.sum("n").alias("df"))
    assert held.exceptAll(terms.select("term", "level", "df")).isEmpty() and held.count() == terms.count()
