"""Byte-level BPE through a sentencepiece model written from a vocabulary of ranks.

A vocabulary file (base64 token and rank on each line) becomes a sentencepiece
BPE model, serialised here: every token's bytes, each mapped to one character,
are a piece whose score is the negative rank; the normaliser is the identity.
Sentencepiece then merges the pair of highest score, leftmost first, which is
the pair of lowest rank. A pre-token that is a token itself is that token, as in
the rank format's own library. Decoding maps ids to pieces and characters back
to bytes.

The vocabulary is read on the driver and broadcast (one file, below ``MAX_BYTES``),
so executors need no copy of it. Each Python worker builds the model once.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MAX_BYTES = 64 << 20  # no vocabulary file is larger; it is broadcast
CACHED = 300_000  # pre-tokens a worker remembers
FIRST_CHARACTER = 0x100  # byte b is the character FIRST_CHARACTER + b

_TO_CHARACTERS = {b: FIRST_CHARACTER + b for b in range(256)}


def characters(token: bytes) -> str:
    """One character for each byte."""
    return token.decode("latin-1").translate(_TO_CHARACTERS)


def as_bytes(piece: str) -> bytes:
    """The bytes that ``characters`` was given."""
    return bytes(ord(c) - FIRST_CHARACTER for c in piece)


def _varint(n: int) -> bytes:
    n, out = n & (1 << 64) - 1, bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def serialised(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece i is ``tokens[i]``; one more piece at the end is the unknown one."""
    piece = lambda text, score, kind: _bytes(1, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))
    pieces = b"".join(piece(characters(t), -float(rank), 1) for rank, t in enumerate(tokens))
    unknown = piece("<unk>", 0.0, 2)
    # trainer: BPE, vocabulary size, ids of unknown, begin, end and padding
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    # normaliser: identity; no space in front, none removed, none replaced
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return pieces + unknown + _bytes(2, trainer) + _bytes(3, normaliser)


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Rank of each token in a vocabulary file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


class Tokenizer:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: bytes):
        self.ranks = read_ranks(vocabulary)
        tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"the vocabulary has no token for the bytes {missing}")
        self.rank_of_piece = np.array([self.ranks[t] for t in tokens], dtype="<u4")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(tokens))
        pieces = (self.model.id_to_piece(i) for i in range(len(tokens)))
        self.bytes_of_rank = dict(zip(self.rank_of_piece.tolist(), map(as_bytes, pieces), strict=True))
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.known: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        merged = []
        for text in new:
            raw = text.encode("utf-8")
            rank = self.ranks.get(raw)
            if rank is None:
                merged.append((text, characters(raw)))
            else:
                self.known[text] = struct.pack("<I", rank)
        found = self.model.encode([c for _, c in merged], num_threads=1) if merged else []
        for (text, _), ids in zip(merged, found, strict=True):
            self.known[text] = self.rank_of_piece[ids].tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        parts = self.split(text)
        if len(self.known) > CACHED:
            self.known.clear()
        if new := [p for p in set(parts) if p not in self.known]:
            self._learn(new)
        return b"".join(map(self.known.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of a text from its ids."""
        return b"".join(map(self.bytes_of_rank.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.lru_cache(maxsize=2)
def tokenizer(vocabulary: bytes) -> Tokenizer:
    """The tokenizer of a vocabulary, built once in a worker."""
    return Tokenizer(vocabulary)


def _broadcast(spark: SparkSession, path: str):
    with open(path, "rb") as file:
        lines = file.read(MAX_BYTES + 1)
    if len(lines) > MAX_BYTES:
        raise ValueError(f"{path} is larger than {MAX_BYTES} bytes")
    return spark.sparkContext.broadcast(lines)


def _mapped(function, source: str, *targets: str):
    """Batches with ``source`` replaced by ``targets``, which ``function(tokenizer, value)`` gives; other columns stay."""

    def run(sent):
        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                work = tokenizer(sent.value)
                found = [function(work, v.as_py()) for v in batch.column(source)]
                rest = [n for n in batch.schema.names if n != source]
                arrays = [pa.array([f[i] for f in found], pa.binary()) for i in range(len(targets))]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *arrays], [*rest, *targets])

        return mapped

    return run


def _round_trip(work: Tokenizer, text: str | None) -> tuple[bytes, bytes]:
    ids = work.encode(text or "")
    return ids, work.decode(ids)


def _texts(docs: DataFrame) -> DataFrame:
    return ship(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text, as little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids; null ids of documents and
    repeated rows are kept; an empty table gives no rows.
    """
    run = _mapped(lambda work, text: (work.encode(text or ""),), "text", "ids")
    return _texts(docs).mapInArrow(run(_broadcast(docs.sparkSession, vocabulary)), "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, decoded): the bytes that the ids stand for; null ids give no bytes."""
    run = _mapped(lambda work, ids: (work.decode(ids or b""),), "ids", "decoded")
    return ship(encoded.select("doc_id", "ids")).mapInArrow(run(_broadcast(encoded.sparkSession, vocabulary)), "doc_id long, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, decoded): ids, and the bytes decoded from those very ids, in one pass over the texts."""
    run = _mapped(_round_trip, "text", "ids", "decoded")
    return _texts(docs).mapInArrow(run(_broadcast(docs.sparkSession, vocabulary)), "doc_id long, ids binary, decoded binary")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids of every document, and of the bytes decoded from them."""
    found = round_trip(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op7_bpe": op7_bpe}
ORACLES: dict[str, str] = {}  # merges are not SQL; tests compare with the rank format's own library
