"""Streams run to their end, against the same work in one batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators import dedup, transport
from rivulet.plans.feed import CAPTURED, COPY_OFFSET, FEED, OUTBOX, captured, change_feed, outbox
from rivulet.session import scratch
from rivulet.streaming import pipeline, stateful


#: The most rows that a file of a stream is planned for; more make more files to a batch.
FILE_ROWS = 500_000


def _files(rows: DataFrame, batches: int = 4) -> tuple[str, DataFrame]:
    """The rows as files, and a stream of them in so many batches."""
    spark = rows.sparkSession
    path = scratch(spark, "stream-in")
    each = max(1, -(-rows.count() // (batches * FILE_ROWS)))
    rows.repartitionByRange(batches * each, "id").write.parquet(path)
    return path, pipeline.source(spark, path, rows.schema, each)


def _end(query) -> None:
    query.awaitTermination()


def stream_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured changes of a stream, with repeats inside each batch removed."""
    _, stream = _files(change_feed(spark, sf_dir))
    out, cursors = scratch(spark, "outbox"), scratch(spark, "cursors")
    signature = dedup.business_signature("id")
    keep = lambda b: dedup.exact_duplicates(b, signature).where("id = survivor_id").drop("signature", "survivor_id")
    _end(pipeline.run(stream, scratch(spark, "checkpoint"), pipeline.outbox_writer(out, cursors, F.col("id") % 11 != 0, keep)))
    return spark.read.parquet(out).select("id", "op", "pk")


def stream_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the stream's two cursors stand at its end; changes from id % 10 = 7 on are ruled out."""
    _, stream = _files(change_feed(spark, sf_dir))
    out, cursors = scratch(spark, "outbox"), scratch(spark, "cursors")
    _end(pipeline.run(stream, scratch(spark, "checkpoint"), pipeline.outbox_writer(out, cursors, F.col("id") % 10 < 7, lambda b: b)))
    return pipeline.start_cursor(spark, cursors)


def stream_receive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many changes arrive once, of a stream that holds repeats."""
    _, stream = _files(outbox(spark, sf_dir))
    out = scratch(spark, "inbox")
    _end(pipeline.run(pipeline.received(stream, late="1000 days"), scratch(spark, "checkpoint"), pipeline.appender(out)))
    return spark.read.parquet(out).groupBy("service_id").agg(F.count("*").alias("received"), F.countDistinct("event_uid").alias("uids"))


def stream_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's history, folded over the batches in state."""
    _, stream = _files(change_feed(spark, sf_dir))
    out = scratch(spark, "compacted")
    _end(pipeline.run(pipeline.compacted(stream), scratch(spark, "checkpoint"), pipeline.appender(out), mode="update"))
    rows = spark.read.parquet(out)
    return rows.groupBy("pk").agg(F.max_by(F.struct("events", "first_op", "last_op", "last_id"), "events").alias("r")).select("pk", "r.*")


def stream_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of failures: retries are counted, dead letters split off."""
    _, stream = _files(outbox(spark, sf_dir).where("status = 'failed'"))
    out = scratch(spark, "retries")
    n, status = transport.after_failure(F.col("retry_count"))
    _end(pipeline.run(stream.select("id", n.alias("retry_count"), status.alias("status")), scratch(spark, "checkpoint"), pipeline.appender(out)))
    return spark.read.parquet(out).groupBy("status").agg(F.count("*").alias("events"))


def _in_order(rows: DataFrame, part: Column, parts: int) -> DataFrame:
    """A stream of the rows, one part to a batch in the order of their numbers; files are taken by their time. All parts but
    the last have one number of files, which a batch takes: more than one where they are long."""
    spark = rows.sparkSession
    path = scratch(spark, "stream-in")
    counts = {r.part: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}  # a row for each part
    each = -(-max(counts.values()) // FILE_ROWS)
    if min(counts.get(k, 0) for k in range(parts - 1)) < 1000 * each:  # too few to be sure of a row in every file
        each = 1
    for k in range(parts):
        own = rows.where(part == k)
        (own.coalesce(1) if each == 1 else own.repartition(each)).write.mode("append").parquet(path)
        there = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
        if k < parts - 1 and there != each * (k + 1):
            raise RuntimeError(f"part {k} was written to {there - each * k} files, not {each}")
    return pipeline.source(spark, path, rows.schema, each)


def stream_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came of each key, once its history is closed by the watermark: repeats of a tenth of the changes come in later
    batches, and a change of the far future moves the watermark past the ends of all histories."""
    rows = captured(spark, sf_dir).select("id", "pk", "op", F.unhex(F.sha2(F.concat_ws("|", "op", "pk", "value", "ts"), 256)).alias("signature"), "ts")
    last = spark.createDataFrame([(-1, -999_999, "update", b"-")], "id long, pk long, op string, signature binary").withColumn("ts", F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))
    rows = rows.unionByName(last)
    part = F.when(F.col("id") == -1, 3).when(F.col("id") >= COPY_OFFSET, 2).otherwise((F.col("id") % 2).cast("int"))
    out = scratch(spark, "histories")
    query = pipeline.run(stateful.dated_histories(_in_order(rows, part, 4), late="60 days", keep=1000), scratch(spark, "checkpoint"), pipeline.appender(out))
    _end(query)
    kept = stateful.outcomes(spark.read.parquet(out)).select("pk", "events", "repeats", "outcome", "first_kept", "last_kept")
    most = spark.createDataFrame([(stateful.dropped(query),)], "dropped long")
    return kept.crossJoin(F.broadcast(most))  # one row


def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipt with the checksum gate and one passage for each uid; a tenth of the changes come after all others, most of
    them behind the watermark. How many were received, and how many the query counted as too late."""
    rows = outbox(spark, sf_dir).select("id", "service_id", "ts", F.col("id").cast("string").alias("event_uid"), F.to_json(F.struct("id", "op", "pk")).alias("payload"))
    rows = rows.withColumn("checksum", F.when(F.col("id") % 13 != 0, F.sha2("payload", 256)).otherwise("damaged"))
    again = rows.where("id % 4 = 0")
    early, late = rows.where("id % 10 <> 3").unionByName(again.where("id % 10 <> 3")), rows.where("id % 10 = 3")
    # a batch's late rows are told by the watermark that the batch before the last left
    both = early.withColumn("part", (F.col("id") % 2).cast("int")).unionByName(late.withColumn("part", F.lit(2)))
    out = scratch(spark, "inbox")
    query = pipeline.run(stateful.gated_once(_in_order(both, F.col("part"), 3), late="12 hours"), scratch(spark, "checkpoint"), pipeline.appender(out))
    _end(query)
    return spark.read.parquet(out).agg(F.count("*").alias("received"), F.countDistinct("id").alias("ids"), F.lit(stateful.dropped(query)).cast("long").alias("too_late"))


QUERIES = {f.__name__: f for f in (stream_outbox, stream_cursors, stream_receive, stream_compaction, stream_retry, stream_histories, stream_gate)}
ORACLE_SQL = {
    "stream_histories": f"""WITH {CAPTURED}, one AS (SELECT min(id) AS id, arg_min(pk, id) AS pk, arg_min(op, id) AS op, count(*) - 1 AS repeats FROM captured GROUP BY sha256(concat_ws('|', op, pk, value, ts))),
        h AS (SELECT pk, count(*) AS events, CAST(sum(repeats) AS BIGINT) AS repeats, arg_min(op, id) AS f, arg_max(op, id) AS l, min(id) AS first_id, max(id) AS last_id, max(id) FILTER (WHERE op = 'update') AS lu,
            count(*) FILTER (WHERE op = 'insert') AS i, count(*) FILTER (WHERE op = 'update') AS u, count(*) FILTER (WHERE op = 'delete') AS d FROM one GROUP BY pk),
        o AS (SELECT *, CASE WHEN events = 1 THEN 'single' WHEN f = 'insert' AND l = 'delete' THEN 'A' WHEN f = 'insert' AND d = 0 THEN 'B' WHEN i + d = 0 THEN 'C' WHEN l = 'delete' AND i = 0 THEN 'D' ELSE 'E' END AS outcome FROM h)
        SELECT pk, events, repeats, outcome, CASE WHEN outcome IN ('single', 'B') THEN first_id END AS first_kept, CASE outcome WHEN 'B' THEN lu WHEN 'A' THEN NULL ELSE last_id END AS last_kept, CAST(0 AS BIGINT) AS dropped FROM o""",
    "stream_gate": f"""WITH {OUTBOX}, w AS (SELECT max(ts) - INTERVAL 12 HOURS AS mark FROM outbox WHERE id % 10 <> 3 AND id % 13 <> 0 AND id % 2 = 0),
        c AS (SELECT id, id % 10 = 3 AND ts <= mark AS late FROM outbox, w WHERE id % 13 <> 0)
        SELECT count(*) FILTER (WHERE NOT late) AS received, count(*) FILTER (WHERE NOT late) AS ids, count(*) FILTER (WHERE late) AS too_late FROM c""",
    "stream_outbox": f"WITH {FEED} SELECT id, op, pk FROM feed WHERE id % 11 <> 0",
    "stream_cursors": f"""WITH {FEED} SELECT max_by(log_file, id) AS log_file, max_by(log_pos, id) AS log_pos, max_by(log_pos, id) FILTER (WHERE id % 10 < 7) AS captured_pos FROM feed""",
    "stream_receive": f"""WITH {OUTBOX} SELECT service_id, count(DISTINCT nullif(event_uid, '')) + count(*) FILTER (WHERE event_uid = '') AS received, count(DISTINCT event_uid) AS uids FROM outbox GROUP BY 1""",
    "stream_compaction": f"WITH {FEED} SELECT pk, count(*) AS events, min_by(op, id) AS first_op, max_by(op, id) AS last_op, max(id) AS last_id FROM feed GROUP BY 1",
    "stream_retry": f"WITH {OUTBOX} SELECT CASE WHEN retry_count + 1 >= 5 THEN 'dead' ELSE 'failed' END AS status, count(*) AS events FROM outbox WHERE status = 'failed' GROUP BY 1",
}
