"""Clusters around centroids by annulus search, in exact integers.

A vector lies as far from a centroid as their norms differ, at least. The centroids are sorted by norm; the one whose norm
is next to the vector's gives an upper bound u of the distance to the nearest, by an exact comparison, and only centroids
with norms in the annulus from |x| - u to |x| + u can be as near. Two binary searches find them (the annulus is widened by
more than rounding can take away, so that ties on its border stay in), and each is compared in integers; of equally near
ones the smaller number wins.

A round reads the vectors from the shared folder, where they are written once, and moves sums: a row for each centroid,
component and task. Sums are split into limbs of 40 bits, so that they neither overflow nor lose a bit whatever the
components are. Centroids (a fixed number of vectors) are all that driver and tasks exchange.

Vectors that are null, of another length, or hold null or non-finite components take no part (nor do those with scaled
components of LARGEST or more, which no float has). Repeated rows count as often as they come; of equal ids, the smaller vector comes first
as a start. With fewer vectors than centroids each starts one; without any the result is empty. A null vec_id is clustered
and starts no centroid unless too few others are there. A distance or sum over the range of long is null. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import pieces, staged, table

CENTROIDS, ROUNDS, DIM, SCALE = 8, 10, 64, 1024
PLAIN = 1 << 26  # components below: every product and sum of DIM squares fits a long
LARGEST = 1e150  # scaled components below: squared norms are doubles
LIMB = 40
LONGEST = (1 << 63) - 1
SUMS = "cluster int, component int, limb int, value long"


def eligible(embedding: str, dim: int) -> Column:
    """A vector of dim finite components."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < LARGEST))
    return F.coalesce((F.size(embedding) == dim) & finite, F.lit(False))


def whole(vectors: np.ndarray, dim: int) -> np.ndarray:
    """floor(SCALE * x) of doubles; Python integers where some are large."""
    scaled = np.floor(vectors.reshape(-1, dim) * SCALE)
    if np.abs(scaled).max(initial=0) < PLAIN:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled.tolist()], object).reshape(-1, dim)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


class Annuli:
    """Nearest of a few centroids, by norm first."""

    def __init__(self, centroids: list[list[int]]):
        large = max((abs(x) for c in centroids for x in c), default=0) >= PLAIN
        norms = [sum(x * x for x in c) ** 0.5 for c in centroids]
        self.order = np.argsort(np.array(norms), kind="stable")
        self.norms = np.array(norms)[self.order]
        self.centroids = np.array([centroids[i] for i in self.order], object if large else np.int64)

    def apart(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact squared distances of rows x to the centroids at these places of the order."""
        c = self.centroids[at]
        if x.dtype == object or c.dtype == object:
            d = x.astype(object) - c.astype(object)
            return (d * d).sum(axis=1)
        d = x - c
        return np.einsum("ij,ij->i", d, d)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the centroid, squared distance) of each row."""
        k = len(self.norms)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        right = np.clip(np.searchsorted(self.norms, norm), 0, k - 1)
        left = np.maximum(right - 1, 0)
        start = np.where(np.abs(self.norms[left] - norm) <= np.abs(self.norms[right] - norm), left, right)
        best = self.apart(x, start)
        cluster = self.order[start].copy()
        u = np.sqrt(best.astype(np.float64))
        slack = 1e-9 * (norm + u + self.norms[-1]) + 1e-9
        first, end = np.searchsorted(self.norms, norm - u - slack), np.searchsorted(self.norms, norm + u + slack, "right")
        for i in range(k):
            rows = np.flatnonzero((first <= i) & (i < end) & (start != i))
            if len(rows):
                own = self.order[i]
                d = self.apart(x[rows], np.full(len(rows), i))
                better = (d < best[rows]) | ((d == best[rows]) & (own < cluster[rows]))
                best[rows[better]], cluster[rows[better]] = d[better], own
        return cluster, best


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, value, i = (-1 if value < 0 else 1), abs(value), 0
    while value or not i:
        yield i, sign * (value & ((1 << LIMB) - 1))
        value, i = value >> LIMB, i + 1


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: floors of the means of their vectors; those without vectors stay."""
    k, dim = len(centroids), len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli, total, count = Annuli(centroids), np.zeros((k, dim), object), np.zeros(k, np.int64)
        for batch in pieces(batches, "embedding", 4096):
            x = whole(_vectors(batch.column("embedding")), dim)
            cluster, _ = annuli.nearest(x)
            for c in np.unique(cluster).tolist():
                own = x[cluster == c]
                total[c] += own.sum(axis=0).astype(object)
                count[c] += len(own)
        rows = [(c, j, i, v) for c in np.flatnonzero(count).tolist() for j, s in enumerate([*total[c].tolist(), int(count[c])]) for i, v in _limbs(int(s))]
        if rows:
            yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "component", "limb", "value"])

    got = np.zeros((k, dim + 1), object)
    for c, j, i, v in vectors.mapInArrow(sums, SUMS).groupBy("cluster", "component", "limb").agg(F.sum("value")).collect():  # centroids x components, few limbs
        got[c, j] += v << (LIMB * i)
    return [[int(s) // int(row[dim]) for s in row[:dim]] if row[dim] else old for row, old in zip(got, centroids, strict=True)]


def starts(vectors: DataFrame, k: int, seed: int, dim: int) -> list[list[int]]:
    """The vectors of the k smallest hashes of seed:vec_id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "embedding").limit(k).select("embedding").collect()  # k vectors
    return [[int(v) for v in whole(np.array(r.embedding, np.float64), dim)[0]] for r in rows]


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each vector that takes part, and the centroids."""
    part = vectors.where(eligible("embedding", dim)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    part = staged(part, "clusters")
    centroids = starts(part, k, seed, dim)
    schema = "vec_id long, cluster int, distance long"
    if not centroids:
        return part.sparkSession.createDataFrame([], schema), []
    for _ in range(rounds):
        centroids = moved(part, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = Annuli(centroids)
        for batch in pieces(batches, "embedding", 4096):
            cluster, apart = annuli.nearest(whole(_vectors(batch.column("embedding")), dim))
            fits = [v if v <= LONGEST else None for v in apart.tolist()]
            yield pa.record_batch([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(fits, pa.int64())], ["vec_id", "cluster", "distance"])

    return part.mapInArrow(assign, schema), centroids


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clusters(table(spark, sf_dir, "embeddings"))
    found = staged(found, "clusters")
    # whole: null as soon as one distance is, so that a sum never leaves a vector out
    total = lambda: F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    own = {c: s for c, s in found.groupBy("cluster").agg(total()).collect()}  # a row for each centroid
    every = None if not own or None in own.values() else int(sum(own.values()))
    fit = lambda v: int(v) if v is not None and v <= LONGEST else None
    rows = [(c, fit(v), fit(every), ",".join(map(str, centroids[c]))) for c, v in own.items()]
    per = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, components string")
    per = per.select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each centroid
