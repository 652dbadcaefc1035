import os
import random
import re

import pytest

from assetlens.llm import licenses

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def as_regex(template):
    """The template as a regular expression over words with a space after each."""
    out = ""
    for i, piece in enumerate(re.split(r"<<(beginOptional|endOptional|var;[^>]*)>>", template)):
        if i % 2 == 0:
            out += "".join(re.escape(w) + " " for w in plain_words(piece))
        elif piece == "beginOptional":
            out += "(?:"
        elif piece == "endOptional":
            out += ")?"
        else:
            lo, hi = re.search(r'min="(\d+)"', piece)[1], re.search(r'max="(\d+)"', piece)[1]
            out += rf"(?:[^ ]+ ){{{lo},{hi}}}"
    return re.compile("(?<![^ ])" + out)


def plain_scan(text):
    words = plain_words(text)
    at, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += found
        base |= {label} if found else set()
    joined = "".join(w + " " for w in words)
    labels = {label for label, t in licenses.TEMPLATES if as_regex(t).search(joined)}
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels))


def scan(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, labels string")
    return licenses.scan_licenses(df).collect()


def test_given_documents_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:7] for r in scan(spark, rows)}
    assert got == {i: plain_scan(t) for i, t in rows}
    assert any(g[5] for g in got.values())


def test_random_wordings_equal_regular_expressions(spark):
    rng = random.Random(6)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in plain_words(re.sub("<<.*?>>", " ", t))})
    rows = []
    for n in range(1500):
        _, template = rng.choice(licenses.TEMPLATES)
        pieces = re.split(r"<<(beginOptional|endOptional|var;[^>]*)>>", template)
        keep, words = [True], []
        for i, p in enumerate(pieces):
            if i % 2 == 0:
                words += plain_words(p) if all(keep) else []
            elif p == "beginOptional":
                keep.append(rng.random() < 0.5)
            elif p == "endOptional":
                keep.pop()
            elif all(keep):
                words += rng.choices(vocabulary, k=rng.randrange(0, 10))
        if rng.random() < 0.4 and words:
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((n, " ".join(rng.choices(vocabulary, k=3) + words + rng.choices(vocabulary, k=2))))
    got = {r.doc_id: tuple(r)[1:7] for r in scan(spark, rows)}
    want = {i: plain_scan(t) for i, t in rows}
    assert got == want
    assert 300 < sum(bool(w[5]) for w in want.values()) < 1500


def test_cases_with_a_known_answer(spark):
    texts = [
        ("Released under the MIT License.", (5, 1, 1, 1, "mit", "mit", 1.0)),
        ("UNDER THE\nmit-license under the MIT license", (8, 2, 0, 4, "mit", "mit", 1.0)),
        ("This work is licensed under the GNU General Public License, version 3.", (12, 0, None, None, "", "gpl-3", 1.0)),
        ("licensed under the GNU General Public version 3", (8, 0, None, None, "", "", 0.0)),
        ("under the MITé license", (4, 0, None, None, "", "", 0.0)),
        ("cc by nc cc by nc", (6, 2, 0, 3, "cc-by-nc", "cc-by-nc", 1.0)),
        ("", (0, 0, None, None, "", "", 0.0)),
        (None, (0, 0, None, None, "", "", 0.0)),
    ]
    got = {r.doc_id: tuple(r)[1:] for r in scan(spark, [(i, t) for i, (t, _) in enumerate(texts)])}
    assert got == {i: w for i, (_, w) in enumerate(texts)}


def test_null_ids_repeats_long_texts_empty(spark):
    long = "word " * 200_000 + "apache license version 2"
    got = scan(spark, [(None, "cc by nc"), (7, "x"), (7, "x"), (8, long)])
    assert sorted((r.doc_id or 0, r.n_words, r.n_base, r.first_word or 0) for r in got) == [(0, 3, 1, 0), (7, 1, 0, 0), (7, 1, 0, 0), (8, 200_004, 1, 200_000)]
    assert scan(spark, []) == []


@pytest.mark.parametrize("template", ["<<beginOptional>>a<<endOptional>>", '<<var;name="x";min="1";max="2">> a', "", "a <<beginOptional>> b"])
def test_templates_that_cannot_be_anchored_are_refused(template):
    with pytest.raises(ValueError):
        licenses.compiled("x", template)
