"""Quality rules: fixed base rules, then a calibrated n-gram model.

The base rules count words, symbols, repeated lines and repeated word windows.
A text that passes them is judged by a logistic regression over hashed n-grams:
single words, word pairs and three-byte character n-grams, each kind hashed into
its own block of buckets, as log counts of length one.

The model is fitted in one task on a bounded, documented sample: at most
``SAMPLE_PER_CLASS`` labelled rows of each class, those whose ids have the
smallest hashes, among ids whose crc32 does not leave 1 modulo 3 (those stay for
measuring). A fifth of the sample is not fitted on; it calibrates the scores
(a logistic curve over the margin, weighted to the labels' true class shares).
Everything else covers all rows: texts are scored whole, in Arrow batches,
against fixed thresholds.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_of_id, map_texts, ship, table, texts_of
from .discriminant import labelled

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
THRESHOLD = 0.5  # calibrated probability from which a text is kept
BUCKETS = 2048  # of each of the three kinds of n-grams
KINDS = 3
SAMPLE_PER_CLASS = 2000  # bound of the fitting sample
ROUNDS, STEP, DECAY = 300, 1.2, 1e-4  # accelerated gradient descent; penalty on the weights
CHUNK = 1 << 20
_ODD = np.array([0x9E3779B97F4A7C15 + 2 * i * 0x632BE59BD9B4E019 & (1 << 64) - 1 | 1 for i in range(WINDOW)], dtype=np.uint64)


def repeated_words(words: list[bytes], hashes: np.ndarray) -> int:
    """Words that lie in a window of ``WINDOW`` words found twice or more in the text, the first one included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    wide = hashes.astype(np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for j in range(WINDOW):
        mixed += (wide[j : j + n] ^ (wide[j : j + n] << np.uint64(29))) * _ODD[j]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    # equal hashes only: now the words themselves
    at = np.flatnonzero(again).tolist()
    windows = [tuple(words[i : i + WINDOW]) for i in at]
    found = Counter(windows)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for i, w in zip(at, windows, strict=True):
        if found[w] > 1:
            edges[i] += 1
            edges[i + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


class Base(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool


def base_of(text: str, words: list[bytes], hashes: np.ndarray) -> Base:
    """The base counts of a text and whether they fail it."""
    lines = [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c")]
    repeats = repeated_words(words, hashes)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    blanks = sum(text.count(c) for c in " \t\n\r\x0b\x0c")
    return Base(len(words), len(text) - blanks, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeats, failed)


def _unit(counts: np.ndarray) -> np.ndarray:
    value = np.log1p(counts)
    return value / max(1.0, float(np.sqrt((value**2).sum())))


def ngrams(raw: bytes, hashes: np.ndarray) -> np.ndarray:
    """The hashed n-gram vector of a text, ``KINDS * BUCKETS`` numbers."""
    shift, mul = np.uint32(32 - BUCKETS.bit_length() + 1), np.uint32(0x9E3779B1)
    single = np.bincount((hashes * mul) >> shift, minlength=BUCKETS)
    pairs = np.bincount(((hashes[:-1] * np.uint32(31) + hashes[1:]) * mul) >> shift, minlength=BUCKETS)
    chars = np.zeros(BUCKETS, dtype=np.int64)
    codes = np.frombuffer(raw, dtype=np.uint8)
    for i in range(0, len(codes) - 2, CHUNK):
        c = codes[i : i + CHUNK + 2].astype(np.uint32)
        chars += np.bincount(((c[:-2] << np.uint32(16) | c[1:-1] << np.uint32(8) | c[2:]) * mul) >> shift, minlength=BUCKETS)
    return np.concatenate([_unit(single), _unit(pairs), _unit(chars)]).astype(np.float32)


def read(text: str) -> tuple[bytes, list[bytes], np.ndarray]:
    """UTF-8 bytes, words and word hashes of a text."""
    raw = text.encode("utf-8")
    words = raw.split()
    return raw, words, np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))


class Model(NamedTuple):
    """weights None: nothing was learnt, every text scores 1."""

    weights: np.ndarray | None
    bias: float
    slope: float
    shift: float

    def score(self, raw: bytes, hashes: np.ndarray) -> float:
        if self.weights is None:
            return 1.0
        margin = float(self.weights @ ngrams(raw, hashes)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def regression(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Penalised logistic regression, both classes weighing the same."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    last_w, last_b = w, b
    for t in range(ROUNDS):
        pull = t / (t + 3)
        vw, vb = w + pull * (w - last_w), b + pull * (b - last_b)
        slope = (_sigmoid(x @ vw + vb) - y) * weight
        last_w, last_b = w, b
        w = (vw - STEP * (x.T @ slope + DECAY * vw)).astype(np.float32)
        b = vb - STEP * float(slope.sum())
    return w, b


def calibration(margin: np.ndarray, y: np.ndarray, share_of_ones: float) -> tuple[float, float]:
    """Slope and shift of the curve from margins to probabilities, by Newton steps, at the given share of label 1."""
    ones, zeros = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    weight = np.where(y == 1, share_of_ones / ones, (1 - share_of_ones) / zeros)
    features = np.stack([margin, np.ones_like(margin)])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(theta @ features)
        gradient = features @ (weight * (p - target)) + 1e-3 * (theta - [1.0, 0.0])
        hessian = (features * (weight * p * (1 - p))) @ features.T + 1e-3 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(max(theta[0], 1e-3)), float(theta[1])


def _fit(share_of_ones: float):
    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["id"].to_numpy(), kind="stable")
        x = np.empty((len(order), KINDS * BUCKETS), dtype=np.float32)
        for to, at in enumerate(order.tolist()):
            x[to] = np.frombuffer(rows["x"][at].as_buffer(), dtype=np.float32)
        y, aside = rows["label"].to_numpy()[order], rows["aside"].to_numpy()[order]
        out = (None, 0.0, 1.0, 0.0)
        if {0, 1} <= set(y[~aside].tolist()):
            w, b = regression(x[~aside], y[~aside])
            held = aside if {0, 1} <= set(y[aside].tolist()) else ~aside
            out = (w.tobytes(), b, *calibration(x[held] @ w + b, y[held], share_of_ones))
        return pa.table({n: pa.array([v], t) for n, v, t in zip(("weights", "bias", "slope", "shift"), out, (pa.binary(), *[pa.float64()] * 3), strict=True)})

    return run


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in texts_of(batch):
            raw, _, hashes = read(text)
            found.append(ngrams(raw, hashes).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("aside"), pa.array(found, pa.binary())], ["id", "label", "aside", "x"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from the bounded sample of labelled rows; without rows of both classes it accepts everything."""
    known = labelled(labels)
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(shares) < 2:
        return Model(None, 0.0, 1.0, 0.0)
    known = known.where(crc_of_id("labelled_id") % 3 != 1)
    ranked = [known.where(F.col("label") == c).orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(SAMPLE_PER_CLASS) for c in (0, 1)]
    known = ranked[0].union(ranked[1])
    # at most 2 * SAMPLE_PER_CLASS rows of two numbers: a proven bound for the broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(known.select("labelled_id", "label")), F.col("id") == F.col("labelled_id"))
    once = F.row_number().over(W.partitionBy("id").orderBy(F.xxhash64("text")))  # an id may repeat
    rows = rows.withColumn("turn", once).where("turn = 1").select("id", "label", (F.pmod(F.xxhash64(F.lit("aside"), "id"), F.lit(5)) == 0).alias("aside"), "text")
    sample = map_texts(rows, _vectors, "id long, label int, aside boolean, x binary").withColumn("all", F.lit(0))
    one = ship(sample).groupBy("all").applyInArrow(_fit(shares[1] / sum(shares.values())), "weights binary, bias double, slope double, shift double")
    row = one.first()
    if row is None or row["weights"] is None:
        return Model(None, 0.0, 1.0, 0.0)
    return Model(np.frombuffer(row["weights"], dtype=np.float32), row["bias"], row["slope"], row["shift"])


def judged(text: str, model: Model) -> tuple[Base, float, bool]:
    """Base counts, calibrated score and verdict of one text."""
    raw, words, hashes = read(text)
    base = base_of(text, words, hashes)
    score = model.score(raw, hashes)
    return base, score, not base.base_failed and score >= THRESHOLD


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """Base counts, score and verdict of every row of ``docs``.

    A null text counts as empty and fails the base rules; null ids and repeated
    rows are judged and returned like any other. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(*base, score, kept) for base, score, kept in (judged(t, model) for t in texts_of(batch))]
            columns = zip(*found, strict=True) if found else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], [f.split()[0] for f in SCHEMA.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, run, SCHEMA)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep."""
    model = fit(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([judged(t, model)[2] for t in texts_of(batch)], pa.bool_()))

    return ship(docs).mapInArrow(keep, docs.schema)


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, score and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op4_rules": op4_rules}
ORACLES: dict[str, str] = {}  # a fitted model; tests check the base counts by brute force and measure the model
