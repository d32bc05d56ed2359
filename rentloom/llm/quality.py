"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold[k] - w x): one vector of weights over hashed text for all grades, and thresholds in
order. x holds, per hash bucket, the share of a text's words with a feature: the word itself, and its form (capitals,
punctuation, digits, length, whether it repeats the word before). The model is fitted on a bounded sample of rated
documents, the TRAIN_ROWS with the smallest hashes of their ids; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentloom.llm.common import buffer_of, lower_ascii, mix, packed, prefix_hash, quoted, slices, stretch_hash, unpacked, word_bounds

BUCKETS = 2048
TRAIN_ROWS = 4000
STEPS = 400
STRENGTH = 1e-4
KEEP_GRADE = 1
KEEP_TAIL = 0.5
U = np.uint64


def word_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket of the word, bucket of its form) of every word."""
    data, at = buffer_of(column)
    start, end, row = word_bounds(data, at)
    if not len(start):
        return row, row, row
    low = lower_ascii(data)
    word = stretch_hash(prefix_hash(low), start, end)

    def inside(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(mask, out=sums[1:])
        return sums[end] - sums[start]

    upper = inside(low != data)
    digit = inside((data >= 48) & (data <= 57))
    letter = inside(((low >= 97) & (low <= 122)) | (data >= 128))
    size = end - start
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    form = np.minimum(upper, 3)
    for part, most in ((size - letter - digit, 4), (digit, 3), (size // 3, 6), (same, 1)):
        form = form * (most + 1) + np.minimum(part, most)
    pick = lambda h: (h % U(BUCKETS)).astype(np.int64)
    return row, pick(mix(word + U(11))), pick(mix(form.astype(U) + U(1 << 40)))


def vectors(column: pa.Array) -> np.ndarray:
    """Rows x buckets, each row's shares of words; a text without words is all zeros."""
    row, word, form = word_features(column)
    n = len(column)
    counts = np.bincount(np.concatenate([row, row]) * BUCKETS + np.concatenate([word, form]), minlength=n * BUCKETS)
    words = np.maximum(np.bincount(row, minlength=n), 1)
    return (counts.reshape(n, BUCKETS) / words[:, None]).astype(np.float32)


@dataclass
class Ordinal:
    """Shared weights and ordered thresholds; grades are 0 to len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, P(grade >= k) for k = 1, 2, ...) of scores w x."""
        tails = 1 / (1 + np.exp(np.clip(self.thresholds[None] - score[:, None], -40, 40)))
        return tails.sum(1), tails


def fit(x: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = 0.05, strength: float = STRENGTH, in_place: bool = False) -> Ordinal:
    """Maximum likelihood by Adam. The gaps between thresholds are exponentials, which keeps them in order. In place, x is
    scaled where it is, so the driver holds it once."""
    k = int(y.max(initial=0))
    if k < 1:
        return Ordinal(np.zeros(x.shape[1]), np.zeros(0))
    mean = x.mean(0, dtype=float)
    spread = np.sqrt(np.maximum(np.array([float(c @ c) for c in x.T]) / len(x) - mean * mean, 0)) + 1e-3
    z = np.divide(x, spread.astype(np.float32), out=x if in_place else None)
    p = np.zeros(x.shape[1] + k)
    if k > 1:
        p[-k + 1 :] = -0.5
    m, v = np.zeros_like(p), np.zeros_like(p)
    weight = np.where(y == 0, 0.5 / max((y == 0).sum(), 1), 0.5 / max((y > 0).sum(), 1)) * len(y)
    lo_of, hi_of = np.maximum(y - 1, 0), np.minimum(y, k - 1)
    for step in range(1, steps + 1):
        w, cuts = p[:-k], np.cumsum(np.concatenate([p[-k : -k + 1 or None], np.exp(p[-k + 1 :]) if k > 1 else []]))
        s = (z @ w.astype(np.float32)).astype(float)
        sig = 1 / (1 + np.exp(np.clip(s[:, None] - cuts[None], -40, 40)))
        rows = np.arange(len(y))
        hi = np.where(y == k, 1.0, sig[rows, hi_of])
        lo = np.where(y == 0, 0.0, sig[rows, lo_of])
        prob = np.maximum(hi - lo, 1e-9)
        dhi, dlo = np.where(y == k, 0, hi * (1 - hi)) * weight / prob, np.where(y == 0, 0, lo * (1 - lo)) * weight / prob
        dcut = np.zeros(k)
        np.add.at(dcut, hi_of, -dhi)
        np.add.at(dcut, lo_of, dlo)
        grad = np.empty_like(p)
        grad[:-k] = ((dhi - dlo).astype(np.float32) @ z) / len(y) + strength * w
        tail = np.cumsum(dcut[::-1])[::-1] / len(y)
        grad[-k:] = tail
        if k > 1:
            grad[-k + 1 :] = tail[1:] * np.exp(p[-k + 1 :])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cuts = np.cumsum(np.concatenate([p[-k : -k + 1 or None], np.exp(p[-k + 1 :]) if k > 1 else []]))
    return Ordinal(p[:-k] / spread, cuts)


def rating() -> Column:
    """Grades of labels: 0 is junk, 1 is good prose that is toxic, 2 is good and clean; unrated is null."""
    return F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2))


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS) -> Ordinal:
    """Fit on the ``most`` rated documents with the smallest hashes of their ids. ratings: id, grade. Rows without an id
    or a grade are left out; an id that is rated twice counts once, with its lowest grade. Of documents that repeat an id,
    2 x ``most`` rows at most are fitted, those with the smallest ids as text."""
    rated = ratings.where(F.col("grade").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("grade").alias("grade"))
    chosen = rated.orderBy(F.xxhash64(id_col), id_col).limit(most)
    # Bounded by ``most`` rows.
    joined = docs.select(F.col(quoted(id_col)).alias(id_col), F.col(quoted(text_col)).alias("raw")).join(F.broadcast(chosen), id_col).select(id_col, "raw", "grade")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "raw"):
                x = vectors(part.column(1))
                # Only the buckets that a text fills are sent.
                full = [np.flatnonzero(v) for v in x]
                lists = [pa.array([k.astype(np.uint16).tobytes() for k in full], pa.binary()), pa.array([v[k].tobytes() for v, k in zip(x, full, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(2).cast(pa.int64()), *lists, part.column(0).cast(pa.string())], names=["grade", "k", "x", "id"])

    rows = joined.mapInArrow(task, "grade long, k binary, x binary, id string").orderBy("id", F.xxhash64("k", "x")).limit(2 * most).toArrow()
    if not len(rows):
        return Ordinal(np.zeros(BUCKETS), np.zeros(0))
    x, grade = np.zeros((len(rows), BUCKETS), np.float32), rows.column("grade").to_numpy()
    for r, (k, v) in enumerate(zip(rows.column("k"), rows.column("x"), strict=True)):
        x[r, np.frombuffer(k.as_py(), np.uint16)] = np.frombuffer(v.as_py(), np.float32)
    del rows
    return fit(x, grade, in_place=True)


def score(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text", keep_grade: int = KEEP_GRADE, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """The documents and expected_grade, tail (P(grade >= keep_grade)), keep, which take the place of columns that have
    these names already. A text without words scores as the zero vector does; without a model (no ratings) everything is
    kept, with tail 1."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The text is a field of the packed row, so it is not sent twice.
            both = pa.RecordBatch.from_arrays([batch.column(0), pc.struct_field(batch.column(0), [place])], names=["doc", "raw"])
            for part in slices(both, "raw"):
                row, word, form = word_features(part.column(1))
                n = len(part)
                sums = np.bincount(row, model.weights[word] + model.weights[form], minlength=n) / np.maximum(np.bincount(row, minlength=n), 1)
                expected, tails = model.grades(sums)
                tail = tails[:, keep_grade - 1] if keep_grade <= tails.shape[1] else np.ones(n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(expected), pa.array(tail), pa.array(tail >= keep_tail)], names=["doc", "expected_grade", "tail", "keep"])

    scored = T.StructType([T.StructField("doc", docs.schema), *(T.StructField(n, k) for n, k in (("expected_grade", T.DoubleType()), ("tail", T.DoubleType()), ("keep", T.BooleanType())))])
    place = docs.columns.index(text_col)
    rows = docs.select(packed(docs)).mapInArrow(task, scored)
    return rows.select(*unpacked(docs, added={c: F.col(c) for c in ("expected_grade", "tail", "keep")}))


def op1_quality_classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", rating().alias("grade"))
    return score(docs, train(docs, labels)).drop("text")
