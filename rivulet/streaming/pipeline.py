"""Change capture as a stream: micro-batches from files, deduplicated receipt, cursors, stateful compaction.

Offsets, batch numbers and state live in the stream's checkpoint; a batch that runs again writes the same folder again
(batch=N, overwritten), so the sinks hold each change once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Where the state of streams is kept.
STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 2) -> DataFrame:
    """Parquet files under a path as a stream, so many to a batch (admission control)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], every: str | None = None, mode: str = "append"):
    """Start the stream with each(batch, number); it ends when all files are read, or polls (every: an interval)."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def appender(out: str) -> Callable[[DataFrame, int], None]:
    """Sink of one folder for each batch."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return each


def outbox_writer(out: str, cursors: str, allowed: Column, keep: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Sink that writes what is allowed and keep() leaves, and two cursors: how far was read, and how far captured."""

    def each(batch: DataFrame, number: int) -> None:
        keep(batch.where(allowed)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        at = lambda cond: F.max(F.when(cond, F.struct("log_file", "log_pos")))
        totals = batch.agg(at(F.lit(True)).alias("read"), at(allowed).alias("captured"), F.count("*").alias("scanned"), F.count_if(allowed).alias("taken"))
        row = totals.select(F.lit(number).alias("number"), "read", "captured", "scanned", "taken")
        row.write.mode("overwrite").parquet(f"{cursors}/batch={number}")

    return each


def start_cursor(spark: SparkSession, cursors: str) -> DataFrame:
    """Where to go on: the read cursor, or the captured one if nothing was read."""
    rows = spark.read.parquet(cursors)
    return rows.agg(F.coalesce(F.max("read"), F.max("captured")).alias("at"), F.max("captured").alias("captured")).select("at.log_file", "at.log_pos", F.col("captured.log_pos").alias("captured_pos"))


def received(stream: DataFrame, uid: str = "event_uid", service: str = "service_id", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The stream without repeats of (service, uid) within the watermark; changes with a blank uid all pass."""
    own = F.when(F.trim(F.coalesce(uid, F.lit(""))) == "", F.concat(F.lit("row-"), F.col("id").cast("string"))).otherwise(F.col(uid))
    return stream.withColumn("_uid", own).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([service, "_uid"]).drop("_uid")


def compacted(stream: DataFrame) -> DataFrame:
    """The history of each key over all batches so far (a few values of state a key), a row whenever it changes: a streaming
    aggregation, so changes are folded before the shuffle and a key's state is read once a batch. Keys stay for good, so
    state is kept by the RocksDB store, outside of the heap."""
    stream.sparkSession.conf.set(STORE, ROCKSDB)
    ends = F.min_by("op", "id").alias("first_op"), F.max_by("op", "id").alias("last_op")
    return stream.groupBy("pk").agg(F.count("*").alias("events"), *ends, F.max("id").alias("last_id"))


def windowed(stream: DataFrame, time: str = "ts", size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Changes by operation in tumbling windows of event time."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, size), "op").agg(F.count("*").alias("events")).select("window.start", "op", "events")
