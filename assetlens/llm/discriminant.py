"""Quality classifier: regularised quadratic discriminant over document statistics.

Every whole text becomes a short vector of transformed statistics. Each class
(label 1, label 0) is a Gaussian: its mean and covariance come from one
distributed pass of sums over all labelled rows, and the covariance is shrunk
towards the pooled diagonal. The Cholesky factors are computed once on the
driver, from two small matrices, and travel with the scoring function; a score
is the difference of the two Mahalanobis log densities plus the log prior.

Statistics of a text are computed once, kept as a table of ``len(FEATURES)``
doubles a row, and used for fitting and scoring. Nothing but class sums
(a few hundred numbers) reaches the driver.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, map_texts, saved, ship, table, texts_of

FEATURES = (
    "words", "word_length", "capitals", "symbols", "exclamations", "bars", "digits", "stops", "commas",
    "distinct_words", "equal_neighbours", "repeated_lines", "line_words", "bytes_beyond_ascii",
)
SHRINKAGE = 0.15  # share of the pooled diagonal in each class covariance
RIDGE = 1e-4  # added to every variance
TEMPER = len(FEATURES) / 2  # log densities of correlated statistics overstate; halves them per pair

_KINDS = {
    "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "symbols": b"#*$%&<>@^~=+{}[]\\/_",
    "exclamations": b"!?",
    "bars": b"|",
    "digits": b"0123456789",
    "stops": b".",
    "commas": b",;:",
    "bytes_beyond_ascii": bytes(range(128, 256)),
}
_MASKS = np.array([[b in chars for b in range(256)] for chars in _KINDS.values()], dtype=np.int64)
CHUNK = 1 << 20


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of FEATURES; all zero without a word.

    Counts and lengths enter as logarithms, shares as square roots, which brings
    both near a Gaussian.
    """
    raw = text.encode("utf-8")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, codes = len(words), np.frombuffer(raw, dtype=np.uint8)
    counts = sum(np.bincount(codes[i : i + CHUNK], minlength=256) for i in range(0, len(codes), CHUNK))
    inked = float(counts.sum() - counts[[9, 10, 11, 12, 13, 32]].sum())
    kinds = dict(zip(_KINDS, (_MASKS @ counts) / inked, strict=True))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    shares = kinds | {
        "distinct_words": len(set(words)) / n,
        "equal_neighbours": sum(map(operator.eq, words, words[1:])) / n,
        "repeated_lines": 1 - len(set(lines)) / len(lines),
    }
    logs = {"words": np.log1p(n), "word_length": np.log(inked / n), "line_words": np.log1p(n / len(lines))}
    return [float(logs[f]) if f in logs else float(np.sqrt(shares[f])) for f in FEATURES]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([statistics(t) for t in texts_of(batch)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "x"])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row: its id and its statistics."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, _measure, "doc_id long, x array<double>")


class Gaussian(NamedTuple):
    mean: np.ndarray
    factor: np.ndarray  # lower Cholesky factor of the covariance
    log_scale: float  # log prior less half the log determinant


class Model(NamedTuple):
    """No classes: nothing was learnt, every score is 0.5."""

    classes: tuple[Gaussian, Gaussian] | None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), 0.5)
        log = []
        for mean, factor, log_scale in self.classes:
            z = np.linalg.solve(factor, (x - mean).T)
            log.append(log_scale - 0.5 * (z**2).sum(axis=0))
        return 1 / (1 + np.exp(-np.clip((log[1] - log[0]) / TEMPER, -700, 700)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a class and partition: count, sums, sums of products."""
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        y = batch.column("label").to_numpy(zero_copy_only=False)
        for c in (0, 1):
            part = x[y == c]
            total[c] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
    at = np.tile(np.arange(total.shape[1]), 2)
    yield pa.record_batch({"label": pa.array(np.repeat([0, 1], total.shape[1]), pa.int32()), "at": pa.array(at, pa.int32()), "total": pa.array(total.ravel())})


def labelled(labels: DataFrame) -> DataFrame:
    """(labelled_id, label): one row per id, 1 only if all its rows say 1; rows without id or label are left out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("labelled_id"), F.col("quality").cast("int").alias("label"))
    return rows.where("labelled_id IS NOT NULL AND label IN (0, 1)").groupBy("labelled_id").agg(F.min("label").alias("label"))


def fit(measures: DataFrame, labels: DataFrame) -> Model:
    """Model from all labelled rows of (doc_id, x); only rows whose crc32 of the id leaves 0 or 2 modulo 3 are learnt from."""
    learnt = measures.where(crc_of_id() % 3 != 1).join(labelled(labels), F.col("doc_id") == F.col("labelled_id")).select("label", "x")
    sums = ship(learnt).mapInArrow(_sums, "label int, at int, total double").groupBy("label", "at").agg(F.sum("total").alias("total"))
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for row in sums.collect():  # 2 * (1 + d + d * d) numbers
        total[row["label"], row["at"]] = row["total"]
    n = total[:, 0]
    if n.min() < 2:
        return Model(None)
    means = total[:, 1 : 1 + d] / n[:, None]
    covs = [total[c, 1 + d :].reshape(d, d) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = np.diag(np.diag(sum(n[c] * covs[c] for c in (0, 1)) / n.sum()))
    classes = []
    for c in (0, 1):
        factor = np.linalg.cholesky((1 - SHRINKAGE) * covs[c] + SHRINKAGE * pooled + RIDGE * np.eye(d))
        classes.append(Gaussian(means[c], factor, float(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())))
    return Model(tuple(classes))


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x), pa.float64())], ["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Null and empty texts have all statistics zero and are scored like any other;
    a null id is never held out and never learnt from; repeated rows are all
    returned. With fewer than two labelled rows of either class every score is
    0.5. Labels, language and source never enter a score.
    """
    measures = saved(measured(docs), "statistics")
    scored = ship(measures).mapInArrow(_scored(fit(measures, labels)), "doc_id long, score double")
    held_out = F.coalesce(crc_of_id() % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier takes for label 1.

    ``learn_from`` has the labelled texts, ``docs`` itself if not given. An earlier
    filter leaves few bad ones, so a pipeline names the documents it began with.
    """
    model = fit(measured(docs if learn_from is None else learn_from), labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in texts_of(batch)]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.scores(x) >= 0.5))

    return ship(docs).mapInArrow(keep, docs.schema)


def op3_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_discriminant": op3_discriminant}
ORACLES: dict[str, str] = {}  # a fitted model; tests measure held-out accuracy
