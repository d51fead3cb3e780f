"""Exact top-k inner products by norm buckets (after Teflioudi, Gemulla, Mykytiuk: LEMP, 2015).

Vectors are grouped by length into buckets, and buckets into slices of bounded size. The longest bucket is searched
first and gives each query a score that its k-th best cannot be below. For every other bucket that bound divided by
|query| * (longest vector of the bucket) is the local cosine threshold: above 1 the query never reaches the bucket.
Queries are put into blocks by how long a vector has to be for them, and only the pairs of a slice and a block in which
some query can reach the slice are searched; vectors move for these pairs alone. Inside one, low thresholds prune by
length (vectors are sorted by it, the scan stops where |query| |vector| < bound) and high ones by coordinates: the
products over the query's FOCUS largest coordinates, and Cauchy-Schwarz for the rest. What is left is verified by integer
products.

Each component x becomes floor(256 * x). Products are exact whatever their size: as doubles while |query| |vector| stays
below 2**53, as whole numbers of any length beyond. A score that a long cannot hold is reported as the nearest long (past
38 digits such scores tie). Vectors that are null or hold null, NaN or infinite components take no part; nor do rows
without an id. Repeated ids are candidates each; as a query an id counts once, with its least vector. A query is never its
own candidate (by id). Vectors of different dimensions have no product: each dimension is searched within itself. Ties go
to the smaller vec_id. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.llm.common import staged, table

K, EVERY, SCALE = 5, 50, 256
BUCKETS, SLICE, QUERIES = 16, 8192, 1024  # norm buckets; vectors and queries of one task
LEVELS = 8  # of the length that a query asks of a vector
GROUPS = 16  # slices are dealt to the blocks in so many groups
FOCUS, COORDINATE_AT = 16, 0.5  # coordinates looked at first, and the local threshold from which they prune
EXACT = 2.0**53  # doubles hold every whole number up to it
NEAR = 1e-6  # what bounds give way by, relatively: far more than doubles err
LONGEST, MOST = 1e150, 10**38 - 1  # lengths above count as it; scores beyond tie
HITS = "query_id long, vec_id long, score decimal(38,0)"


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, raw, dims, norms = [], [], [], []
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_numpy(zero_copy_only=False), strict=True):
            x = np.asarray(v, np.float64)
            if len(x) and np.isfinite(x).all():
                with np.errstate(over="ignore"):
                    q = np.clip(np.floor(SCALE * x), -LONGEST, LONGEST)
                ids.append(i)
                raw.append(q.tobytes())
                dims.append(len(q))
                norms.append(min(LONGEST, math.hypot(*q)))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64())], ["vec_id", "vector", "dim", "norm"])


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector, dim, norm) of the rows that take part; vector holds whole numbers as doubles."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id is not null and embedding is not null and not exists(embedding, x -> x is null)")
    return rows.mapInArrow(_quantised, "vec_id long, vector binary, dim int, norm double")


def _matrix(raw: pd.Series) -> np.ndarray:
    return np.vstack([np.frombuffer(x, np.float64) for x in raw])


def _products(v: np.ndarray, q: np.ndarray, largest: float) -> list[int]:
    """Exact inner products of the rows of v with q, none longer than largest."""
    if largest < EXACT:
        return (v @ q).astype(np.int64).tolist()
    whole = [int(x) for x in q.tolist()]
    return [max(-MOST, min(MOST, sum(int(a) * b for a, b in zip(row, whole, strict=True)))) for row in v.tolist()]


def search(queries: pd.DataFrame, found: pd.DataFrame, k: int) -> pd.DataFrame:
    """HITS of the k best candidates of each query in one slice."""
    found = found.sort_values(["norm", "vec_id"], ascending=[False, True])
    v, norm, ids = _matrix(found["vector"]), found["norm"].to_numpy(), found["vec_id"].to_numpy()
    out: list[tuple[int, int, Decimal]] = []
    for q_id, raw, q_norm, bound in zip(queries["vec_id"], queries["vector"], queries["norm"], queries["bound"], strict=True):
        q = np.frombuffer(raw, np.float64)
        n, largest = len(ids), q_norm * norm[0]
        least = bound - NEAR * (1 + abs(bound))
        if bound > 0:
            n = int(np.searchsorted(-norm * q_norm, -least, "right"))  # length pruning
        if not n:
            continue
        keep = np.arange(n)
        if largest < EXACT and bound >= COORDINATE_AT * largest and len(q) > FOCUS:
            focus = np.argpartition(-np.abs(q), FOCUS)[:FOCUS]
            part = v[:n, focus]
            rest_q = math.sqrt(max(0.0, q_norm**2 - float(q[focus] @ q[focus])))
            rest_v = np.sqrt(np.maximum(0, norm[:n] ** 2 - (part**2).sum(axis=1)))
            keep = np.flatnonzero(part @ q[focus] + rest_q * rest_v >= least)
        keep = keep[ids[keep] != q_id]
        scores = _products(v[keep], q, largest)
        best = sorted(zip((-s for s in scores), ids[keep].tolist(), strict=True))[:k] if largest >= EXACT else [(-scores[i], int(ids[keep[i]])) for i in np.lexsort((ids[keep], -np.array(scores, np.int64)))[:k]]
        out += [(q_id, i, Decimal(-less)) for less, i in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def _searched(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Rows of both with the same task (a slice and a block of queries), searched."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=["query_id", "vec_id", "score"])
        return search(left, right, k)

    return queries.groupBy("slice", "block").cogroup(found.groupBy("slice", "block")).applyInPandas(run, HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """hits with their rank, the k best of each query; every query holds k hits of a slice at most."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _above(edges: list[float], value: Column) -> Column:
    """How many of the edges value is above."""
    return sum(((value > e).cast("int") for e in edges), F.lit(0))


def top_k(vectors: DataFrame, query_if, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) that query_if picks, the k best others."""
    rows = staged(quantised(vectors), "topk")
    edges = sorted(set(rows.approxQuantile("norm", [i / BUCKETS for i in range(1, BUCKETS)], 0.01)))
    placed = rows.withColumn("bucket", F.lit(len(edges)) - _above(edges, F.col("norm")))  # 0 holds the longest
    sizes = placed.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / SLICE).cast("long").alias("slices"), F.max("norm").alias("longest"))
    first = sizes.groupBy("dim").agg(F.min("bucket").alias("first"))
    sizes = staged(sizes.join(first, "dim"), "topk")  # a row for each bucket and dimension
    found = placed.join(sizes.select("dim", "bucket", "slices", "first"), ["dim", "bucket"])
    found = found.withColumn("slice", F.xxhash64("dim", "bucket", F.pmod(F.xxhash64("vec_id", "vector"), "slices")))
    s = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))
    slices = sizes.select("dim", "bucket", "longest", "first", s.alias("s")).withColumn("slice", F.xxhash64("dim", "bucket", "s"))
    slices = slices.withColumn("group", F.pmod("slice", F.lit(GROUPS)))
    asked = rows.where(query_if).groupBy("vec_id").agg(F.min(F.struct("vector", "dim", "norm")).alias("q")).select("vec_id", "q.*")

    def phase(where: str, asked_now: DataFrame) -> DataFrame:
        """asked_now has bound and need, the length of a vector whose score can reach the bound (0: any)."""
        asked_now = staged(asked_now, "topk")
        levels = sorted(set(asked_now.approxQuantile("need", [i / LEVELS for i in range(1, LEVELS)], 0.05)))
        blocks = max(1, math.ceil(asked_now.count() / QUERIES / (len(levels) + 1)))
        block = F.xxhash64("dim", _above(levels, F.col("need")), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
        asked_now = asked_now.withColumn("block", block)
        least = asked_now.groupBy("dim", "block").agg(F.min("need").alias("need"))
        least = least.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GROUPS - 1).cast("long"))))
        meets = least.join(slices.where(where), ["dim", "group"]).where(F.col("longest") >= F.col("need") * (1 - NEAR))
        meets = staged(meets.select("slice", "block"), "topk")  # a row for each pair that is searched
        left = asked_now.join(meets, "block").select("slice", "block", "vec_id", "vector", "norm", "bound")
        right = found.where(where).join(meets, "slice").select("slice", "block", "vec_id", "vector", "norm")
        return _searched(left, right, k)

    none = asked.select("*", F.lit(float("-inf")).alias("bound"), F.lit(0.0).alias("need"))
    one = staged(phase("bucket = first", none), "topk")
    bounds = _ranked(one, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bound"))
    bound = F.coalesce("bound", F.lit(float("-inf")))
    need = F.when(bound > 0, (bound - NEAR * (1 + bound)) / F.greatest("norm", F.lit(1e-9))).otherwise(0.0)
    two = phase("bucket > first", asked.join(bounds, "vec_id", "left").select("vec_id", "vector", "dim", "norm", bound.alias("bound"), need.alias("need")))
    out = _ranked(one.unionByName(two), k)
    low, high = (F.lit(x).cast("decimal(38,0)") for x in (str(-(1 << 63)), str((1 << 63) - 1)))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.greatest(low, F.least(high, "score")).cast("long").alias("score"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), f"vec_id % {EVERY} = 0")
