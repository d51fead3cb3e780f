"""Queries on delivery end to end, sinks, schema changes, stops and late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import codec
from rivulet.operators import delivery, retention, snapshot, transport, versioned
from rivulet.plans.feed import FEED, OUTBOX, change_feed, events, outbox
from rivulet.queries_text import FILES, log_text, written
from rivulet.session import scratch
from rivulet.sources import changes, logtext
from rivulet.streaming import pipeline

WIRE = ("id", "batch_id", "op", "pk", "value")


def snapshot_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of customers: a dry run, a copy, an appended part, a truncation by suppliers' rows of the same columns."""
    source = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey as k", "c_name as name", "c_acctbal as balance")
    other = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey as k", "s_name as name")
    out = scratch(spark, "copy")
    steps = [("1 dry run", source, "append", None, True), ("2 copy", source, "recreate", None, False), ("3 append", source, "append", "k <= 10", False), ("4 truncate", other, "truncate", None, False)]
    rows = [(step, *snapshot.copied(rows, out, mode, like, dry).first()) for step, rows, mode, like, dry in steps]  # a row for each step
    return spark.createDataFrame(rows, "step string, status string, source_count long, target_count long")


def _archived(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Orders in a versioned table, and a path for their archive."""
    table, archive = scratch(spark, "orders"), scratch(spark, "archive")
    versioned.commit(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderdate"), table, "load")
    return table, archive


def _places(spark: SparkSession, table: str, archive: str) -> DataFrame:
    kept = versioned.read(spark, archive).select(F.concat(F.lit("run "), "run").alias("place"), "o_orderstatus")
    return kept.unionByName(versioned.read(spark, table).select(F.lit("table").alias("place"), "o_orderstatus")).groupBy("place", "o_orderstatus").agg(F.count("*").alias("orders"))


def archive_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders archived in two runs of different retention, the first of them repeated after both: where each order is in
    the end, and that none is lost."""
    table, archive = _archived(spark, sf_dir)
    date = F.col("o_orderdate").cast("timestamp_ntz")
    old = lambda before: lambda rows: rows.where(date < F.lit(before).cast("timestamp_ntz"))
    for run, before in (("1", "1994-01-01 00:00:00"), ("2", "1996-01-01 00:00:00"), ("1", "1994-01-01 00:00:00")):
        retention.moved(spark, table, archive, run, old(before), ["o_orderkey"])
    return _places(spark, table, archive)


def archive_capped_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by runs of a cap: each takes the 700 oldest orders of final status that are left."""
    table, archive = _archived(spark, sf_dir)
    oldest = lambda rows: retention.capped(rows.where("o_orderstatus = 'F'"), 700, "o_orderdate", "o_orderkey")
    for run in ("1", "2"):
        retention.moved(spark, table, archive, run, oldest, ["o_orderkey"])
    return _places(spark, table, archive)


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row log written as text files, read as a source in their order and parsed."""
    out = scratch(spark, "logs")
    written(log_text(spark, sf_dir), out, 6)
    found = logtext.row_events(logtext.lines(spark, out), FILES, {1: "id", 2: "k"})
    return found.select("event_no", "op", "table_name", "log_pos", F.try_element_at("after", F.lit("id")).alias("after_id"))


def _sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches on the wire; the payload of every seventh is damaged on the way."""
    return _damaged(delivery.payload(outbox(spark, sf_dir).select(*WIRE)))


def _damaged(batches: DataFrame) -> DataFrame:
    return batches.withColumn("payload", F.when(F.col("batch_id") % 7 == 3, F.concat("payload", F.lit("x"))).otherwise(F.col("payload")))


def deliver_and_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the wire to the source's batches: checksum gate, unpacking, strict apply against what is there (keys of even
    value), acknowledgement, and the status that the callback leaves."""
    feed = outbox(spark, sf_dir).select(*WIRE)
    batches = delivery.gated(_sent(spark, sf_dir)).withColumn("status", F.lit("sent"))
    inbox = delivery.unpacked(batches, feed.schema)
    there = feed.select("pk").where("pk % 2 = 0").distinct()
    done = delivery.applied_batch(there, inbox, "pk", missing_fails=True)
    told = delivery.acknowledged(batches, done)
    return delivery.after_callback(batches.select("batch_id", "status"), told).join(told, "batch_id").select("batch_id", "callback", "total", "applied", "bad", "status")


def deliver_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch arrives, and a third of them again: the checksum gate, then the inbox that takes each change once by
    (service, uid), then the apply in which an update or delete of nothing is no failure. Counts of what each batch's
    changes became, of the changes that were new."""
    columns = ("id", "service_id", "batch_id", "event_uid", "op", "pk", "value")
    feed = outbox(spark, sf_dir).select(*columns)
    batches = delivery.gated(_damaged(delivery.payload(feed)))
    rows = delivery.unpacked(batches.unionByName(batches.where("batch_id % 3 = 0")), feed.schema)
    known = feed.where("batch_id < 4").select("service_id", "event_uid")  # received long ago
    fresh = transport.receive(rows.where("trim(event_uid) <> ''"), known)
    done = delivery.applied_batch(feed.select("pk").where("pk % 2 = 0").distinct(), fresh, "pk")
    return done.groupBy("batch_id", F.coalesce("last_error", F.lit("applied")).alias("what")).agg(F.count("*").alias("changes"))


def apply_with_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = outbox(spark, sf_dir).select(*WIRE)
    done = delivery.applied_batch(feed.select("pk").where("pk % 2 = 0").distinct(), feed, "pk", repair=True)
    return done.groupBy("op", F.coalesce("last_error", F.lit("as it is")).alias("how")).agg(F.count("*").alias("changes"))


def payload_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and checksums of plain and base64 payloads."""
    rows = events(spark, sf_dir).select("event_id", codec.metrics(F.col("props"), codec.encoded(F.col("props"), "none")).alias("m"))
    return rows.select("event_id", "m.raw_bytes", "m.wire_bytes", "m.checksum")


def schema_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of three tables after a history of schema changes that the events spell out."""
    tables = changes.columns_by_ordinal(spark, {n: spark.read.parquet(f"{sf_dir}/{n}.parquet").schema for n in ("nation", "region", "supplier")}).select("table_name", "column_name")
    i = F.col("event_id")
    table = F.element_at(F.array(*map(F.lit, ("nation", "region", "supplier"))), (i % 3 + 1).cast("int"))
    column = F.concat(F.lit("c"), (i % 10).cast("string"))
    sql = F.concat(F.lit("ALTER TABLE "), table, F.when(i % 4 == 0, " DROP COLUMN ").otherwise(" ADD COLUMN "), column, F.when(i % 4 == 0, "").otherwise(" INT"))
    sql = F.when(i % 97 == 0, F.concat(F.lit("DROP TABLE "), table)).when(i % 97 == 1, F.concat(F.lit("CREATE TABLE "), table, F.lit(" (id INT)"))).otherwise(sql)
    found = logtext.ddl_events(events(spark, sf_dir).select(i.alias("id"), F.lit("shop").alias("current_database"), sql.alias("sql")))
    return snapshot.schema_after(tables, found)


def stop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    control = F.when(i % 13 == 0, "paused").when(i % 13 == 1, "stopped").otherwise("run")
    reason = delivery.stop_reason(i % 120, i % 700, i % 3000, control, 100, 500, 2500, i % 2 == 0)
    return events(spark, sf_dir).groupBy(F.coalesce(reason, F.lit("goes on")).alias("reason")).agg(F.count("*").alias("runs"))


def hard_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left of each table once one service starts again; other tables keep its rows, and rows of no service stay."""
    rows = outbox(spark, sf_dir).withColumn("service_id", F.when(F.col("id") % 31 != 0, F.col("service_id")))
    left = snapshot.reset({"outbox": rows, "inbox": rows, "audit": rows}, F.lit(2), ("outbox", "inbox"))
    out = None
    for name, df in left.items():
        one = df.groupBy("service_id").agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "service_id", "rows")
        out = one if out is None else out.unionByName(one)
    return out


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of a stream whose files come by time: what the watermark lets out, all in one pass."""
    feed = change_feed(spark, sf_dir)
    path, out = scratch(spark, "stream-in"), scratch(spark, "windows")
    feed.repartitionByRange(4, "ts").write.parquet(path)
    stream = pipeline.source(spark, path, feed.schema, 4)
    pipeline.run(pipeline.windowed(stream, size="1 day", late="2 hours"), scratch(spark, "checkpoint"), pipeline.appender(out)).awaitTermination()
    rows = spark.read.parquet(out)
    last = feed.agg(F.date_trunc("day", F.max("ts") - F.expr("INTERVAL 2 HOURS")).cast("timestamp").alias("last"))
    return rows.join(F.broadcast(last), F.col("start") < F.col("last")).select(F.col("start").cast("timestamp_ntz").alias("start"), "op", "events")


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of two runs appended to one table, as the lines of a report."""
    out = scratch(spark, "audit")
    rows = outbox(spark, sf_dir).where("status in ('failed', 'dead')").select("id", "service_id", "status")
    for run in ("1", "2"):
        snapshot.appended(rows.where(f"id % 2 = {int(run) - 1}"), out, run)
        snapshot.appended(rows, out, run)  # committed already
    again = versioned.read(spark, out)
    return snapshot.report_lines(again.select("id", "service_id", "status"), F.concat(F.lit("event "), F.col("id").cast("string")))


QUERIES = {f.__name__: f for f in (snapshot_copy, archive_two_runs, archive_capped_runs, log_files, deliver_and_ack, deliver_twice, apply_with_repair, payload_metrics, schema_apply, stop_reasons, hard_reset, stream_late, audit_report)}
# what is there before a change: the last insert or delete of its key, found by an as-of join
_STRICT = f"""{OUTBOX}, sent AS (SELECT id, batch_id, op, pk FROM {{rows}}),
    res AS (SELECT s.*, coalesce(w.op = 'insert', s.pk % 2 = 0) AS there
        FROM sent s ASOF LEFT JOIN (SELECT pk, id, op FROM sent WHERE op IN ('insert', 'delete')) w ON s.pk = w.pk AND s.id > w.id)"""
_ONCE = f"""WITH {OUTBOX}, arrived AS (SELECT * FROM outbox WHERE batch_id % 7 <> 3 AND event_uid <> ''),
    old AS (SELECT DISTINCT service_id, event_uid FROM outbox WHERE batch_id < 4),
    sent AS (SELECT min(id) AS id, arg_min(batch_id, id) AS batch_id, arg_min(op, id) AS op, arg_min(pk, id) AS pk FROM arrived a ANTI JOIN old USING (service_id, event_uid) GROUP BY service_id, event_uid),
    res AS (SELECT s.*, coalesce(w.op = 'insert', s.pk % 2 = 0) AS there
        FROM sent s ASOF LEFT JOIN (SELECT pk, id, op FROM sent WHERE op IN ('insert', 'delete')) w ON s.pk = w.pk AND s.id > w.id)"""
ORACLE_SQL = {
    "snapshot_copy": """SELECT '1 dry run' AS step, 'dry_run' AS status, count(*) AS source_count, CAST(0 AS BIGINT) AS target_count FROM customer UNION ALL SELECT '2 copy', 'copied', count(*), count(*) FROM customer
        UNION ALL SELECT '3 append', 'copied', count(*) FILTER (WHERE c_custkey <= 10), count(*) + count(*) FILTER (WHERE c_custkey <= 10) FROM customer UNION ALL SELECT '4 truncate', 'copied', count(*), count(*) FROM supplier""",
    "archive_two_runs": "SELECT CASE WHEN o_orderdate < TIMESTAMP '1994-01-01' THEN 'run 1' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'run 2' ELSE 'table' END AS place, o_orderstatus, count(*) AS orders FROM orders GROUP BY 1, 2",
    "archive_capped_runs": """WITH r AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) END AS n FROM orders)
        SELECT CASE WHEN n <= 700 THEN 'run 1' WHEN n <= 1400 THEN 'run 2' ELSE 'table' END AS place, o_orderstatus, count(*) AS orders FROM r GROUP BY 1, 2""",
    "log_files": f"WITH {FEED} SELECT row_number() OVER (ORDER BY id) AS event_no, op, table_name, log_pos, CASE WHEN op <> 'delete' THEN CAST(pk AS VARCHAR) END AS after_id FROM feed",
    "deliver_and_ack": f"""WITH {_STRICT.format(rows="outbox WHERE batch_id % 7 <> 3")}, b AS (SELECT batch_id, count(*) AS n FROM outbox GROUP BY 1),
        c AS (SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE (op = 'insert') <> there) AS applied FROM res GROUP BY 1),
        t AS (SELECT b.batch_id, CASE WHEN b.batch_id % 7 = 3 THEN 'refused' WHEN applied = total THEN 'applied' WHEN applied > 0 THEN 'partial' ELSE 'failed' END AS callback, coalesce(total, 0) AS total, coalesce(applied, 0) AS applied FROM b LEFT JOIN c USING (batch_id))
        SELECT batch_id, callback, total, applied, total - applied AS bad, CASE callback WHEN 'applied' THEN 'acked' WHEN 'partial' THEN 'sent' ELSE 'failed' END AS status FROM t""",
    "deliver_twice": f"""{_ONCE} SELECT batch_id, CASE WHEN op = 'insert' AND there THEN 'duplicate_key' WHEN op <> 'insert' AND NOT there THEN 'nothing_there' ELSE 'applied' END AS what, count(*) AS changes FROM res GROUP BY 1, 2""",
    "apply_with_repair": f"""WITH {OUTBOX}, res AS (SELECT *, coalesce((SELECT arg_max(o.op, o.id) <> 'delete' FROM outbox o WHERE o.pk = x.pk AND o.id < x.id), pk % 2 = 0) AS there FROM outbox x) SELECT op, CASE WHEN (op = 'insert') <> there THEN 'as it is' WHEN op = 'insert' THEN 'repaired_as_update' WHEN op = 'update' THEN 'repaired_as_insert' ELSE 'nothing_to_delete' END AS how, count(*) AS changes FROM res GROUP BY 1, 2""",
    "payload_metrics": "SELECT event_id, strlen(props) AS raw_bytes, strlen(base64(encode(props))) AS wire_bytes, sha256(props) AS checksum FROM events",
    "schema_apply": """WITH tabs AS (SELECT 'nation' AS table_name, column_name FROM (DESCRIBE nation) UNION ALL SELECT 'region', column_name FROM (DESCRIBE region) UNION ALL SELECT 'supplier', column_name FROM (DESCRIBE supplier)),
        e AS (SELECT event_id AS id, (['nation', 'region', 'supplier'])[CAST(event_id % 3 + 1 AS INTEGER)] AS table_name, 'c' || event_id % 10 AS column_name, event_id % 97 IN (0, 1) AS whole, event_id % 4 = 0 AS gone FROM events),
        w AS (SELECT table_name, max(id) AS since, arg_max(id % 97, id) = 0 AS dropped FROM e WHERE whole GROUP BY 1),
        h AS (SELECT table_name, column_name, -1 AS id, false AS gone FROM tabs UNION ALL SELECT table_name, column_name, id, gone FROM e WHERE NOT whole),
        l AS (SELECT h.table_name, h.column_name, arg_max(gone, id) AS gone FROM h LEFT JOIN w USING (table_name) WHERE since IS NULL OR (NOT dropped AND id > since) GROUP BY 1, 2)
        SELECT table_name, column_name FROM l WHERE NOT gone""",
    "stop_reasons": """SELECT CASE WHEN event_id % 13 = 0 THEN 'paused' WHEN event_id % 13 = 1 THEN 'stopped' WHEN event_id % 120 >= 100 THEN 'capture_limit_reached' WHEN event_id % 700 >= 500 THEN 'max_scanned_events_reached' WHEN event_id % 3000 >= 2500 THEN 'scan_window_limit_reached'
        WHEN event_id % 2 = 0 AND event_id % 700 = 0 THEN 'no_events_available' WHEN event_id % 2 = 0 THEN 'end_of_log' ELSE 'goes on' END AS reason, count(*) AS runs FROM events GROUP BY 1""",
    "hard_reset": f"WITH {OUTBOX} SELECT name, service_id, count(*) AS rows FROM (SELECT CASE WHEN id % 31 <> 0 THEN service_id END AS service_id FROM outbox), (VALUES ('outbox'), ('inbox'), ('audit')) AS v(name) WHERE name = 'audit' OR service_id IS DISTINCT FROM 2 GROUP BY 1, 2",
    "stream_late": f"WITH {FEED} SELECT date_trunc('day', ts)::TIMESTAMP AS start, op, count(*) AS events FROM feed WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts) - INTERVAL 2 HOURS) FROM feed) GROUP BY 1, 2",
    "audit_report": f"""WITH {OUTBOX} SELECT 'event ' || id || ' {{"id":' || id || ',"service_id":' || service_id || ',"status":"' || status || '"}}' AS line FROM outbox WHERE status IN ('failed', 'dead')""",
}
