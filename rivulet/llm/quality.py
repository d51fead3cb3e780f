"""Quality by regularised quadratic discriminant analysis.

Document statistics (shares of byte classes, word and line measures) are transformed by logs and logits. Each class has
its mean and a covariance shrunk towards the pooled one and towards a multiple of the identity; scores come from the
difference of the two Mahalanobis log densities, by Cholesky factors that are computed once and sent to the tasks. A
logistic curve, fitted on a histogram of the differences of labelled rows, turns it into a probability.

All labelled rows outside the held-out quarter count; only sums leave the tasks. Null and empty texts have the statistics
of no bytes and are scored like any other. Where a class has no labelled rows the score is the share of label 1 (0.5
without labels). Repeated rows stay; a document labelled twice counts twice; an empty table gives none. Other columns stay, but for
stats and score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import as_bytes, staged, table

GOOD_AT = 0.7
POOLED, IDENTITY = 0.3, 0.02  # shares of the pooled covariance and of the identity
HELD_OUT = 2
BINS = 400

_CLASS = np.zeros((256, 8))
for _i, _codes in enumerate((range(97, 123), range(65, 91), range(48, 58), (32,), (10,), (39, 44, 45, 46, 58, 59, 63), range(128, 256))):
    _CLASS[list(_codes), _i] = 1
_CLASS[_CLASS.sum(axis=1) == 0, 7] = 1  # other marks and control bytes
DIM = 17


def _logit(share: np.ndarray | float, weight: float = 0.002) -> np.ndarray | float:
    return np.log((share + weight) / (1 - share + weight))


def statistics(text: bytes) -> np.ndarray:
    """DIM transformed statistics."""
    n = max(1, len(text))
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS / n
    words, lines = text.split(), text.split(b"\n")
    many = Counter(words)
    w, distinct = len(words), len(many)
    ends = sum(not (x[-1:].isalnum() or x[-1] > 127) for x in words) / max(1, w)
    top = max(many.values(), default=0) / max(1, w)
    twice = sum(v for v in many.values() if v > 1 and v * 2 > 3) / max(1, w)
    single = sum(len(x) == 1 for x in words) / max(1, w)
    rows = Counter(lines)
    return np.r_[
        _logit(shares),
        np.log1p(len(text)),
        np.log1p(w),
        np.log((distinct + 1) / (w + 1)),
        _logit(ends),
        _logit(top),
        _logit(twice),
        _logit(single),
        np.log1p(sum(map(len, words)) / max(1, w)),
        _logit(1 - len(rows) / len(lines)),
    ]


@F.arrow_udf(T.BinaryType())
def statistics_of(text: pa.Array) -> pa.Array:
    """The statistics of each text, as bytes of doubles."""
    return pa.array([statistics(x).tobytes() for x in as_bytes(text)], pa.binary())


def measured(docs: DataFrame) -> DataFrame:
    """docs with the column stats, the statistics of their texts."""
    return docs.withColumn("stats", statistics_of("text"))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((2, 1 + DIM + DIM * DIM))
    for batch in batches:
        x = np.frombuffer(b"".join(batch.column("stats").to_pylist()), np.float64).reshape(-1, DIM)
        y = np.asarray(batch.column("quality")) != 0
        for c in (0, 1):
            own = x[y == c]
            sums[c] += np.r_[len(own), own.sum(axis=0), (own.T @ own).ravel()]
    for c in (0, 1):
        if sums[c, 0]:
            yield pa.record_batch([pa.array(np.full(sums.shape[1], c, np.int32)), pa.array(np.arange(sums.shape[1], dtype=np.int32)), pa.array(sums[c])], ["c", "i", "v"])


@dataclass
class Model:
    means: np.ndarray  # 2 x DIM
    whiten: np.ndarray  # 2 x DIM x DIM, inverses of the Cholesky factors
    logdet: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of label 1 less that of label 0."""
        of = [-0.5 * (((x - self.means[c]) @ self.whiten[c].T) ** 2).sum(axis=1) - self.logdet[c] for c in (0, 1)]
        return np.clip(of[1] - of[0], -100, 100)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.shift, -50, 50)))


def train(sums: np.ndarray) -> Model | float:
    """From the counts, sums and products of the two classes; a share where one of them is empty."""
    n = sums[:, 0]
    if min(n) < 1:
        return float(n[1] / n.sum()) if n.sum() else 0.5
    means = sums[:, 1 : 1 + DIM] / n[:, None]
    scatter = [sums[c, 1 + DIM :].reshape(DIM, DIM) - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / n.sum()
    factors = []
    for c in (0, 1):
        cov = (1 - POOLED) * scatter[c] / n[c] + POOLED * pooled
        factors.append(np.linalg.cholesky((1 - IDENTITY) * cov + (IDENTITY * np.trace(pooled) / DIM + 1e-9) * np.eye(DIM)))
    return Model(means, np.array([np.linalg.inv(f) for f in factors]), np.array([np.log(np.diag(f)).sum() for f in factors]))


def calibrated(model: Model, bins: np.ndarray, label: np.ndarray, count: np.ndarray) -> Model:
    """Slope and shift by Newton's method on (difference, label, count), lightly penalised."""
    a, b = 0.5, float(np.log((count[label == 1].sum() + 1) / (count[label == 0].sum() + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * bins + b, -50, 50)))
        r, w = count * (label - p), count * p * (1 - p)
        g = np.array([(r * bins).sum() - 0.1 * a, r.sum()])
        h = np.array([[(w * bins * bins).sum() + 0.1, (w * bins).sum()], [(w * bins).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(0.01, a + step[0]), b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return Model(model.means, model.whiten, model.logdet, a, b)


def fit(stats: DataFrame, labels: DataFrame) -> Model | float:
    """Fit on the rows of stats (doc_id, stats) that labels (doc_id, quality) names."""
    rows = stats.select(F.col("doc_id").cast("long").alias("doc_id"), "stats").join(labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")), "doc_id").select("stats", "quality")
    sums = np.zeros((2, 1 + DIM + DIM * DIM))
    for c, i, v in rows.mapInArrow(_moments, "c int, i int, v double").groupBy("c", "i").agg(F.sum("v")).collect():  # 2 * 307 rows
        sums[c, i] = v
    model = train(sums)
    if isinstance(model, float):
        return model

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("stats").to_pylist()), np.float64).reshape(-1, DIM)
            yield pa.record_batch([pa.array(np.round(model.difference(x) * BINS / 200).astype(np.int32)), batch.column("quality")], ["bin", "quality"])

    got = rows.mapInArrow(binned, "bin int, quality int").groupBy("bin", "quality").count().collect()  # 2 * (BINS + 1) rows at most
    bins, label, count = (np.array(x, float) for x in zip(*got, strict=True))
    return calibrated(model, bins * 200 / BINS, (label != 0).astype(float), count)


def score(stats: DataFrame, model: Model | float) -> DataFrame:
    """stats (stats, ...) with the column score in place of stats. Nothing is shuffled."""

    @F.arrow_udf(T.DoubleType())
    def run(column: pa.Array) -> pa.Array:
        x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, DIM)
        return pa.array(model.score(x) if isinstance(model, Model) else np.full(len(x), model), pa.float64())

    return stats.withColumn("score", run("stats")).drop("stats")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs; labels of held-out rows are not learned from."""
    stats = staged(measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"), "quality")
    scores = score(stats, fit(stats, labels.where(~held_out())))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD_AT).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
