"""Quality by ordinal regression: one weight vector over hashed text, ordered thresholds between grades."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tok import binary, chunks, ids

#: Buckets of hashed byte trigrams; rated rows that a fit reads at most, taken by hash of doc_id.
BUCKETS, SAMPLE = 2048, 6000
#: Dense features beside them: shares of upper case, digits, punctuation and word bytes, log length, share of
#: distinct trigram buckets, share of words equal to one of the two words before, mean word length.
SHAPES = 8
#: Bytes of a text that are counted at a time, and rows of a block (their features are dense).
SLICE, ROWS = 1 << 20, 512


def _trigrams(b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each bucket of byte trigrams occurs in each row of a chunk."""
    n = len(offsets) - 1
    counts = np.zeros(n * BUCKETS, np.int64)
    for lo in range(0, len(b) - 2, SLICE):
        x = b[lo : lo + SLICE + 2].astype(np.uint32)
        code = ((x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]) * np.uint32(2654435761) >> np.uint32(32 - 11)
        row = np.searchsorted(offsets, np.arange(lo, lo + len(x)), side="right") - 1
        inside = row[:-2] == row[2:]
        counts += np.bincount(row[:-2][inside] * BUCKETS + code[inside], minlength=n * BUCKETS)
    return counts.reshape(n, BUCKETS)


def features(batch: pa.RecordBatch, name: str = "text") -> Iterator[np.ndarray]:
    """Feature rows of a batch, in order, a block for each chunk of text; short texts make blocks of ROWS rows."""
    kind = np.zeros(256, np.uint8)  # of a byte: 1 upper case, 2 digit, 3 punctuation
    kind[33:128], kind[97:123], kind[65:91], kind[48:58], kind[127] = 3, 0, 1, 2, 3
    for c in itertools.chain.from_iterable(chunks(batch.slice(lo, ROWS), name) for lo in range(0, batch.num_rows, ROWS)):
        n, size = c.hi - c.lo, np.diff(c.offsets)
        counts = _trigrams(c.data, c.offsets)
        of_kind = kind[c.data]
        share = lambda k: np.diff(np.searchsorted(np.flatnonzero(of_kind == k), c.offsets)) / np.maximum(size, 1)  # noqa: B023, E731
        words = np.diff(c.first)
        h = c.hashes()
        again = np.zeros(len(h), bool)
        again[1:] |= h[1:] == h[:-1]
        again[2:] |= h[2:] == h[:-2]
        owner = np.repeat(np.arange(n, dtype=np.int32), words)
        letters = np.bincount(owner, weights=c.ends - c.starts, minlength=n)
        shapes = [
            share(1), share(2), share(3),
            letters / np.maximum(size, 1), np.log1p(size) / 12, (counts > 0).sum(axis=1) / np.maximum(np.minimum(size, BUCKETS), 1),
            np.bincount(owner[again], minlength=n) / np.maximum(words, 1), letters / np.maximum(words, 1) / 12,
        ]
        x = np.sqrt(counts)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        yield np.hstack([x, np.stack(shapes, axis=1)]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(thresholds[k] - x @ weights)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and each threshold k; they fall with k."""
        return _sigmoid((x @ self.weights)[:, None] - self.thresholds[None, :])


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, ridge: float = 1e-4, rounds: int = 400) -> OrdinalModel:
    """Maximum likelihood by Adam on the whole batch. Grades without rows keep smoothed thresholds, and no rows at
    all give zero weights and even odds."""
    share = (np.bincount(grade, minlength=grades) + 0.5)[:grades]
    below = np.cumsum(share / share.sum())[:-1]
    start = np.log(below / (1 - below))
    if len(x) == 0:
        return OrdinalModel(np.zeros(BUCKETS + SHAPES, np.float32), start)
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    p = np.concatenate([np.zeros(x.shape[1]), start[:1], gaps])
    m, v, d = np.zeros_like(p), np.zeros_like(p), x.shape[1]
    y, n = grade.astype(int), len(grade)
    for t in range(1, rounds + 1):
        th = p[d] + np.concatenate([[0], np.cumsum(np.exp(p[d + 1 :]))])
        f = x @ p[:d].astype(np.float32)
        high = np.where(y < grades - 1, _sigmoid(th[np.minimum(y, grades - 2)] - f), 1.0)
        low = np.where(y > 0, _sigmoid(th[np.maximum(y - 1, 0)] - f), 0.0)
        mass = np.maximum(high - low, 1e-9)
        dh, dl = high * (1 - high) / mass, low * (1 - low) / mass
        g = np.zeros_like(p)
        g[:d] = x.T @ ((dh - dl) / n).astype(np.float32) + ridge * p[:d]
        gt = -np.bincount(np.minimum(y, grades - 2), weights=np.where(y < grades - 1, dh, 0), minlength=grades - 1)[: grades - 1] / n
        gt += np.bincount(np.maximum(y - 1, 0), weights=np.where(y > 0, dl, 0), minlength=grades - 1)[: grades - 1] / n
        g[d] = gt.sum()
        for k in range(grades - 2):
            g[d + 1 + k] = gt[k + 1 :].sum() * np.exp(p[d + 1 + k])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * (1 if t < rounds * 0.7 else 0.2)
    return OrdinalModel(p[:d].astype(np.float32), p[d] + np.concatenate([[0], np.cumsum(np.exp(p[d + 1 :]))]))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r.astype(np.float16).tobytes() for block in features(batch) for r in block]
        yield pa.RecordBatch.from_arrays([ids(batch, "grade"), binary(rows)], ["grade", "x"])


def fit(spark: SparkSession, docs: DataFrame, rated: DataFrame, grades: int, sample: int = SAMPLE) -> OrdinalModel:
    """Fit on up to ``sample`` rated documents (those with the smallest hash of doc_id). ``rated`` has doc_id and
    grade (0 to grades - 1; null and other grades are left out; of several the lowest counts). Of texts that share a doc_id
    the one with the smallest hash counts, so every run takes the same rows."""
    rated = rated.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, grades - 1)).groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` rows of 12 bytes
    rows = docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id")
    rows = rows.groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text")).mapInArrow(_feature_rows, "grade int, x binary").collect()
    x = np.stack([np.frombuffer(r["x"], dtype=np.float16) for r in rows]).astype(np.float32) if rows else np.zeros((0, BUCKETS + SHAPES), np.float32)
    return fit_ordinal(x, np.array([r["grade"] for r in rows], dtype=int), grades)


def _score(model: OrdinalModel) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = np.concatenate([model.tails(x) for x in features(batch)]) if batch.num_rows else np.zeros((0, len(model.thresholds)))
            flat = pa.array(tails.ravel().astype(np.float64))
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, tails.size + 1, tails.shape[1]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([ids(batch), pa.array(tails.sum(axis=1).astype(np.float64)), arrays], ["doc_id", "expected_grade", "tails"])

    return run


def grade_documents(docs: DataFrame, model: OrdinalModel, at_least: int = 1, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are not read): doc_id, expected_grade, tail (the
    probability of grade ``at_least`` or better), kept (tail >= threshold, so a tail at the threshold is kept). Null and
    empty texts have zero features and get the score of those; a null doc_id stays null. Texts count whole, however long. Equal
    texts get equal scores, and repeated rows stay. An empty table gives an empty result."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), "doc_id long, expected_grade double, tails array<double>")
    tail = F.col("tails")[at_least - 1]
    return rows.select("doc_id", "expected_grade", tail.alias("tail"), (tail >= threshold).alias("kept"))


def keep_documents(docs: DataFrame, model: OrdinalModel, at_least: int = 1, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose tail probability reaches the threshold, with all their columns, whatever they are called.
    Rows are treated as ``grade_documents`` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = np.concatenate([model.tails(x)[:, at_least - 1] for x in features(batch)]) >= threshold
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def ratings(labels: DataFrame) -> DataFrame:
    """Graded ratings of the labelled documents: 0 poor, 1 good but marked toxic, 2 good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"), "quality").where("quality is not null").drop("quality")
