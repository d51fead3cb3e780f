"""Toxicity by cumulative-link ordinal regression.

Features are the presence of words and of word beginnings (4 to 8 letters), hashed to 32 bits; those that are
STRONG_RATIO times as frequent in toxic documents, beyond chance, are kept. Grades: 0 where labels.toxic is 0; toxic
documents get 1 to 3 by thirds of the extent, how often words with a kept feature occur in the text. The model sees only
which features there are, not how often: a text that repeats one insult all over is severe, one that holds it once is not. One weight vector serves all grades, P(grade <= k) = sigmoid(threshold_k - w x); the output is
the expected grade, the likeliest one, P(grade >= 1), and toxic = 1 where that is TOXIC_AT or more.

The model is fitted on at most TRAIN_ROWS labelled documents that are there, the first by a hash of doc_id. Null and empty
texts have no features and get the score of none. Without labels of both kinds nothing is learned: p_toxic is 0, or 1 if
there are labels and all are toxic. Equal texts have equal scores; repeated rows stay; an empty table gives none. Very long
texts are read whole. Other columns stay, but for those with the names of the scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import only, pieces, staged, table

TRAIN_ROWS, FEATURES, GRADES, TOXIC_AT = 8000, 512, 4, 0.4
BEGINNINGS = (4, 5, 6, 7, 8)
LEAST_DOCS = 5
LEAST_Z, STRONG_RATIO = 5.0, 6.0
WORDS_KEPT = 120_000
SCORES = "expected_severity double, grade int, p_toxic double, toxic int"
_WORD = re.compile(r"[^\W\d_]+")


class _Ids(dict):
    """Feature ids of a word, as bytes."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        names = [word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]
        out = self[word] = b"".join(xxhash.xxh32_digest(x) for x in names)
        return out


_IDS = _Ids()


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature ids."""
    words = set(_WORD.findall((text or "").lower()))
    return np.unique(np.frombuffer(b"".join(map(_IDS.__getitem__, words)), ">u4").astype(np.uint32))


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """features() of a text, and how often each occurs."""
    many = Counter(_WORD.findall((text or "").lower()))
    raw = list(map(_IDS.__getitem__, many))
    ids, at = np.unique(np.frombuffer(b"".join(raw), ">u4").astype(np.uint32), return_inverse=True)
    times = np.repeat(list(many.values()), [len(x) // 4 for x in raw])
    return ids, np.bincount(at, times, len(ids)).astype(np.uint32)


@dataclass
class Model:
    ids: np.ndarray  # sorted
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def grades(self, score: np.ndarray) -> np.ndarray:
        """Probabilities of the grades, a row for each score."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))
        return np.diff(below, axis=1, prepend=0, append=1)

    def score(self, found: np.ndarray) -> float:
        if not len(self.ids):
            return 0.0
        at = np.minimum(np.searchsorted(self.ids, found), len(self.ids) - 1)
        return float(self.weights[at[self.ids[at] == found]].sum())


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int = GRADES, l2: float = 0.05, rounds: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model with least penalised loss, by Adam on all rows."""
    share = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / len(y), 0.01, 0.995)
    first = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(first), 0.05))
    p = np.r_[np.zeros(x.shape[1]), first[0], gaps]
    m, v, d = np.zeros_like(p), np.zeros_like(p), x.shape[1]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for t in range(1, rounds + 1):
        cuts = p[d] + np.r_[0, np.cumsum(np.exp(p[d + 1 :]))]
        s = x @ p[:d].astype(np.float32)
        upper = sigmoid(np.r_[cuts, np.inf][y] - s)
        lower = sigmoid(np.r_[-np.inf, cuts][y] - s)
        prob = np.maximum(upper - lower, 1e-9)
        of_s = upper + lower - 1
        of_cut = np.zeros(grades - 1)
        np.add.at(of_cut, np.minimum(y, grades - 2), np.where(y < grades - 1, upper * (1 - upper) / prob, 0))
        np.add.at(of_cut, np.maximum(y - 1, 0), np.where(y > 0, -lower * (1 - lower) / prob, 0))
        later = np.cumsum(of_cut[::-1])[::-1]
        g = np.r_[-(x.T @ of_s.astype(np.float32)) + l2 * p[:d], -later[0], -later[1:] * np.exp(p[d + 1 :])] / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:d], p[d] + np.r_[0, np.cumsum(np.exp(p[d + 1 :]))]


def train(ids: np.ndarray, rows: list[tuple[np.ndarray, int, int]]) -> Model:
    """From the kept feature ids (sorted) and (ids among them, toxic 0 or 1, extent) of labelled documents of both kinds."""
    place = {int(x): i for i, x in enumerate(ids)}
    x = np.zeros((len(rows), len(ids)), np.float32)
    for i, (found, *_) in enumerate(rows):
        x[i, [place[int(f)] for f in found]] = 1
    toxic, extent = np.array([t for _, t, _ in rows], bool), np.array([d for *_, d in rows])
    y = np.zeros(len(rows), int)
    y[toxic] = 1 + np.searchsorted(np.quantile(extent[toxic], [1 / 3, 2 / 3]), extent[toxic], "left")
    weights, cuts = fit_ordinal(x, y)
    return Model(ids, weights, cuts)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        only(_IDS)
        both = list(map(counted, batch.column("text").to_pylist()))
        raw = [pa.array([x[i].tobytes() for x in both], pa.binary()) for i in (0, 1)]
        yield pa.record_batch([*raw, batch.column("toxic")], ["ids", "times", "toxic"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "ids"):
        found = [np.frombuffer(x, np.uint32) for x in batch.column("ids").to_pylist()]
        toxic = np.repeat(np.asarray(batch.column("toxic")), [len(x) for x in found])
        if len(toxic):
            yield pa.record_batch([pa.array(np.concatenate(found).astype(np.int64)), pa.array(toxic, pa.int32())], ["id", "toxic"])


def strong(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """The (id, z) of counts (id, c1, c0) that toxic documents hold far more often, the FEATURES clearest."""
    p1, p0 = (F.col("c1") + 0.5) / (n1 + 1), (F.col("c0") + 0.5) / (n0 + 1)
    p = (F.col("c1") + F.col("c0") + 1) / (n1 + n0 + 2)
    z = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    clear = counts.where(F.col("c1") >= LEAST_DOCS).select("id", z.alias("z")).where((F.col("z") >= LEAST_Z) & (p1 / p0 >= STRONG_RATIO))
    return clear.orderBy(F.desc("z"), "id").limit(FEATURES)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled documents with the least hashes of doc_id, rows at most; texts with equal feature counts count once.

    Features are counted in Spark; the driver gets FEATURES of them and, for each training row, those it holds.
    """
    order = F.xxhash64("doc_id")
    label = (F.col("toxic") != 0).cast("int").alias("toxic")
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    chosen = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), label).distinct()
    chosen = chosen.join(there, "doc_id", "left_semi").orderBy(order, "doc_id", "toxic").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # rows * 12 bytes at most
    held = staged(texts.select("text", "toxic").mapInArrow(_featured, "ids binary, times binary, toxic int").distinct(), "toxicity")
    n = {r.toxic: r.n for r in held.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        at = -50.0 if 1 in n else 50.0
        return Model(np.empty(0, np.uint32), np.empty(0), at + np.arange(GRADES - 1.0))
    counts = held.select("ids", "toxic").mapInArrow(_exploded, "id long, toxic int").groupBy("id").agg(F.sum("toxic").alias("c1"), F.sum(1 - F.col("toxic")).alias("c0"))
    ids = np.array(sorted(r.id for r in strong(counts, n[1], n[0]).collect()), np.uint32)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, extent = [], []
            for x, t in zip(*(batch.column(c).to_pylist() for c in ("ids", "times")), strict=True):
                own = np.frombuffer(x, np.uint32)
                among = np.isin(own, ids, assume_unique=True)
                raw.append(own[among].tobytes())
                extent.append(int(np.frombuffer(t, np.uint32)[among].sum()))
            yield pa.record_batch([pa.array(raw, pa.binary()), batch.column("toxic"), pa.array(extent, pa.int64())], ["ids", "toxic", "extent"])

    got = sorted((bytes(r.ids), r.toxic, r.extent) for r in held.mapInArrow(kept, "ids binary, toxic int, extent long").collect())  # rows at most
    return train(ids, [(np.frombuffer(x, np.uint32), t, d) for x, t, d in got])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, ...) with the columns of SCORES (in place of any of these names). Nothing is shuffled."""

    @F.arrow_udf(SCORES)
    def run(texts: pa.Array) -> pa.Array:
        only(_IDS)
        p = model.grades(np.array([model.score(features(t)) for t in texts.to_pylist()]).reshape(-1))
        toxic = 1 - p[:, 0]
        out = [p @ np.arange(p.shape[1]), p.argmax(axis=1).astype(np.int32), toxic, (toxic >= TOXIC_AT).astype(np.int32)]
        return pa.StructArray.from_arrays(list(map(pa.array, out)), ["expected_severity", "grade", "p_toxic", "toxic"])

    names = [x.split()[0] for x in SCORES.split(", ")]
    return docs.drop(*names).withColumn("_scores", run("text")).select("*", "_scores.*").drop("_scores")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, table(spark, sf_dir, "labels")))
    return out.drop("text")
