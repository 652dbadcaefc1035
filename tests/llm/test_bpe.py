import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from assetlens.llm import bpe

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def own():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(own, text):
    return np.array(own.encode_ordinary(text or ""), dtype="<u4").tobytes()


def test_query_equals_the_rank_formats_library(spark, own):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = bpe.op7_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = ids_of(own, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_odd_texts(spark, own):
    rng = random.Random(4)
    texts = ["", None, None, " ", "\n\n  x", "a\x1cb\x85c d﻿", "é" * 500, "x" * 30_000, " <|endoftext|> ▁▁<unk>", "日本語 テキスト", "🙂" * 9, "\x00\x01"]
    texts += ["".join(rng.choice("  \n\t\r\x0b 　abc'stÀé9½!<▁") for _ in range(50)) for _ in range(300)]
    texts += ["".join(chr(rng.choice([c for c in range(0x20, 0x3000)])) for _ in range(80)) for _ in range(50)]
    df = spark.createDataFrame([(i if i else None, t, b"") for i, t in enumerate(texts)], "doc_id long, text string, ids binary")
    got = bpe.encode(df)
    by_id = {r.doc_id or 0: bytes(r.ids) for r in got.collect()}
    assert by_id == {i: ids_of(own, t) for i, t in enumerate(texts)}
    assert {r.doc_id or 0: bytes(r.decoded).decode() for r in bpe.decode(got).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_empty(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cache_is_bounded(monkeypatch, own):
    monkeypatch.setattr(bpe, "CACHED", 10)
    with open(bpe.VOCABULARY, "rb") as f:
        work = bpe.Tokenizer(f.read())
    for i in range(50):
        text = f"word{i} other{i} thing{i}"
        assert work.encode(text) == ids_of(own, text)
        assert len(work.known) <= 10 + 9


def test_token_that_no_merge_reaches_is_still_a_token(tmp_path):
    import base64

    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256}  # no "ab", no "bc"
    lines = b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items())
    own = tiktoken.Encoding("toy", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "abcd", "xabc abc"):
        assert bpe.Tokenizer(lines).encode(text) == ids_of(own, text)
