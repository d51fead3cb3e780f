"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import suppress
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.session import scratch

#: Odd multipliers and shifts of a public 64-bit finaliser (splitmix64).
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_KEPT: list[dict] = []  # what operators remember in this worker; the last in use is the last


def only(cache: dict) -> None:
    """Called as a task begins to use a cache: workers are used by one operator after the other, and what the others
    remember goes back to the system."""
    if not _KEPT or _KEPT[-1] is not cache:
        others = [c for c in _KEPT if c is not cache]
        for c in others:
            c.clear()
        _KEPT[:] = [*others, cache]
        if others:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL("libc.so.6").malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows and, beyond one row, of fewer bytes, so that what a step makes of them stays small."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            n = min(rows, batch.num_rows - start)
            while n > 1 and batch.slice(start, n).nbytes > size:
                n //= 2
            yield batch.slice(start, n)
            start += n
    pa.default_memory_pool().release_unused()  # workers live on between tasks


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def least_labels(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of the edges (a, b): one row (id, comp) per node that an edge names, comp its least node.

    Each round labels every node with its least neighbour, jumps once along the labels and contracts the edges; the
    contracted edges are written to the shared folder. Only ids move; nothing is collected.
    """
    spark = edges.sparkSession
    left = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    levels: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("to"))
        hop = near.select(F.col("id").alias("to"), F.col("to").alias("far"))
        label = staged(near.join(hop, "to").select("id", F.col("far").alias("to")), name)
        levels.append(label)
        to = lambda c: label.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to"))
        left = left.join(to("a"), "a").join(to("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        left = staged(left.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    if not levels:
        return spark.createDataFrame([], "id long, comp long")
    step = lambda done, nxt: done.join(nxt.select(F.col("id").alias("to"), F.col("to").alias("far")), "to", "left").select("id", F.coalesce("far", "to").alias("to"))
    out = reduce(step, levels[1:], levels[0]).select("id", F.col("to").alias("comp"))
    return staged(out, name) if len(levels) > 1 else out
