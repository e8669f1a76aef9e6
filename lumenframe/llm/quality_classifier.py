"""Quality of a text by regularised quadratic discriminant analysis over document statistics.

Each text gives ``STATISTICS``, transformed to logarithms of smoothed ratios. The sums of the
statistics and of their products over all labelled training rows, gathered in Spark, give each class
its mean and covariance, which is shrunk towards a multiple of the identity (in units of the pooled
deviations) by ``shrinkage``. The score is the logistic of the difference of the classes' log
densities (Mahalanobis distances by cached Cholesky factors, and log determinants) and log priors.

Null and empty texts have the statistics of no words and get a score too. Without any training row
every score is 0.5, with one class only it is that class's (0 or 1). A document with several labels
counts as often; labels without a document, or null, don't count. Repeated rows each get their
result. Further columns are ignored. An empty table gives no rows. A very long text is a slice of its
own, of some 60 bytes a word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import storage

STATISTICS = ["words", "word_length", "letters", "capitals", "symbols", "shouts", "stops", "distinct", "again", "line_again", "commonest", "line_words"]
DIGITS = 4
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))  # and digits
STOPS, SHOUTS = b".,;:'\"()-", b"!?"
SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = bytes(c for c in range(33, 127) if c not in LETTERS + STOPS + SHOUTS)


def statistics_of(text: bytes | None) -> list[float]:
    """``STATISTICS`` of one UTF-8 text before the logarithm: ratios, smoothed by what some 50 plain words would add."""
    text = text or b""
    words = text.split()
    n, size = len(words), len(text)
    held = lambda some: size - len(text.translate(None, some))
    solid, letters = size - held(SPACE), held(LETTERS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        n + 30,
        (solid + 250) / (n + 50),
        (letters + 250) / (solid - letters + 20),
        (held(UPPER) + 5) / (letters + 250),
        (held(SYMBOLS) + 3) / (solid + 300),
        (held(SHOUTS) + 3) / (solid + 300),
        (held(STOPS) + 10) / (n + 80),
        (len(counts) + 80) / (n + 100),
        (again + 3) / (n + 150),
        (len(lines) - len(set(lines)) + 2) / (len(lines) + 20),
        (max(counts.values(), default=0) + 5) / (n + 80),
        (n + 50) / (len(lines) + 2),
    ]


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the transformed statistics of every row, from whole texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in storage.by_size(batch, "text", 2_000_000):
                x = np.round(np.log(np.array([statistics_of(t) for t in part.column("text").cast(pa.binary()).to_pylist()])), DIGITS)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), flat], names=["doc_id", "x"])

    return storage.in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(work, "doc_id long, x array<double>")


class Discriminant:
    """Two Gaussian classes from their counts, sums and sums of products, in whole units of 10 to the minus ``DIGITS``."""

    def __init__(self, sums: dict[int, tuple[int, np.ndarray, np.ndarray]], shrinkage: float):
        self.classes = sorted(k for k, s in sums.items() if s[0] > 0)
        total, unit = sum(sums[k][0] for k in self.classes), 10**DIGITS
        self.mean, self.inverse, self.log_det, self.log_prior, covs = {}, {}, {}, {}, {}
        for k in self.classes:
            n, x, xx = sums[k]
            self.mean[k] = np.array([int(v) / (n * unit) for v in x])
            exact = n * xx - np.outer(x, x)  # Python's whole numbers
            covs[k] = np.array([[int(v) / (n * n * unit * unit) for v in row] for row in exact])
            self.log_prior[k] = np.log(n / total)
        self.unit = np.sqrt(np.maximum(sum(sums[k][0] * np.diag(covs[k]) for k in self.classes) / total, 1e-9)) if self.classes else None
        for k in self.classes:
            c = covs[k] / np.outer(self.unit, self.unit)
            d = len(c)
            c = (1 - shrinkage) * c + (shrinkage * max(np.trace(c) / d, 1e-3) + 1e-6) * np.eye(d)
            factor = np.linalg.cholesky(c)
            self.inverse[k] = np.tril(np.linalg.inv(factor))
            self.log_det[k] = 2 * np.log(np.diag(factor)).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of class 1 for each row of ``x``."""
        if self.classes != [0, 1]:
            return np.full(len(x), float(self.classes[0]) if self.classes else 0.5)
        log = {}
        for k in self.classes:
            z = ((x - self.mean[k]) / self.unit) @ self.inverse[k].T
            log[k] = self.log_prior[k] - 0.5 * ((z * z).sum(axis=1) + self.log_det[k])
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def held_out(doc_id: Column) -> Column:
    """The contract's fold: crc32 of the id as text, mod 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality", shrinkage: float = 0.05) -> Discriminant:
    """Class sums over all training rows: tasks add up theirs (whole numbers that fit for 6e8 rows each), Spark adds those."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    rows = measured.join(known, "doc_id").select("label", "x")
    d = len(STATISTICS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(1 + d + d * d, np.int64) for k in (0, 1)}
        for batch in batches:
            label = batch.column(0).to_numpy()
            x = np.rint(batch.column(1).flatten().to_numpy().reshape(-1, d) * 10**DIGITS).astype(np.int64)
            for k in sums:
                own = x[label == k]
                sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_pylist([{"label": k, "at": i, "v": v} for k, s in sums.items() for i, v in enumerate(s.tolist())], pa.schema([("label", pa.int32()), ("at", pa.int32()), ("v", pa.int64())]))

    found = rows.mapInArrow(add, "label int, at int, v long").groupBy("label", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    sums = {k: np.zeros(1 + d + d * d, object) for k in (0, 1)}
    for r in found:
        sums[r["label"]][r["at"]] = int(r["v"])
    return Discriminant({k: (s[0], s[1 : d + 1], s[d + 1 :].reshape(d, d)) for k, s in sums.items()}, shrinkage)


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, shrinkage: float = 0.05) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``. Statistics are computed once and stored."""
    measured = storage.written(measure(docs))
    model = fit(measured, labels, label, shrinkage)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(STATISTICS))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "x").mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")
