"""Queries on shipping, receipt, delivery states and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators import dedup, transport
from rivulet.plans.feed import BATCHES, CAPTURED, INBOX, OUTBOX, batches, captured, change_feed, inbox, outbox

LIMIT = 20
NOW = "2024-01-20 00:00:00"
PRIORITY = "CASE WHEN event_family <> 'ddl' THEN 100 WHEN object_type = 'database' THEN 10 WHEN object_type = 'table' THEN 20 WHEN object_type IN ('column', 'index') THEN 30 ELSE 40 END"


def cdc_transport_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transport.transport_order(outbox(spark, sf_dir), LIMIT)
    return out.select("service_id", "id", F.col("priority").cast("int").alias("priority"), F.col("transport_order").cast("long").alias("transport_order"))


def cdc_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transport.batches(outbox(spark, sf_dir), LIMIT)
    return out.select("service_id", "batch_no", "event_count", "first_event_id", "last_event_id", F.array_join(F.col("event_ids").cast("array<string>"), ",").alias("members"), "checksum")


def cdc_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outbox(spark, sf_dir).withColumnRenamed("op", "operation")
    w = transport.wire(rows)
    return rows.select(w.alias("w")).select("w.id", "w.operation", "w.event_family", "w.engine", "w.transaction_id", "w.log_pos", "w.event_uid", F.sha2(F.concat_ws("|", "w.id", "w.operation", "w.object_type", "w.log_file"), 256).alias("digest"))


def cdc_receive_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outbox(spark, sf_dir)
    return transport.receive(rows.where("id % 3 <> 0"), rows.where("id % 10 = 0")).select("id", "service_id", "event_uid")


def cdc_inbox_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = outbox(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, "").otherwise("mysql").alias("engine"), F.when(F.col("id") % 3 != 0, F.col("event_family")).alias("event_family"))
    return transport.inbox_row(raw, "mariadb")


def cdc_batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.batch_rollup(inbox(spark, sf_dir), ["batch_id"])


def cdc_batch_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.batch_snapshot(batches(spark, sf_dir), outbox(spark, sf_dir)).drop("built_at", "sent_at")


def cdc_wait_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transport.wait_ack(transport.batch_snapshot(batches(spark, sf_dir), inbox(spark, sf_dir)))
    return out.select("batch_id", "service_id", "status", "total_count", "return_code")


def cdc_retry_deadletter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, status = transport.after_failure(F.col("retry_count"))
    return outbox(spark, sf_dir).where("status = 'failed'").select("id", n.alias("retry_count"), status.alias("status"))


def cdc_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transport.requeued(outbox(spark, sf_dir), batches(spark, sf_dir).where("status = 'failed'"))
    return out.select("id", "batch_id", "status")


def recovery_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("timestamp_ntz")
    rows = batches(spark, sf_dir).withColumn("acked_at", none).withColumn("created_at", none)
    return transport.recovery_guard(rows, NOW, cooldown=432_000).select("batch_id", "status", "reason_code", "remaining_seconds")


def _signature():
    return dedup.business_signature("database_name", "table_name", "op", "pk", "k", position=("log_file", "log_pos"))


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_feed(spark, sf_dir).withColumn("signature", _signature()).withColumn("ignored", F.col("id") % 37 == 0)
    rows = captured(spark, sf_dir).where("id % 5 <> 1").withColumn("log_pos", F.when(F.col("id") > 10_000_000, F.col("log_pos") - 64).otherwise(F.col("log_pos"))).withColumn("signature", _signature())
    return transport.reconciled(log, rows)


def cdc_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir).select("id", "status", "outbound_match_count", "first_outbound_event_id")


def cdc_reconcile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir).groupBy("status").agg(F.count("*").alias("items"))


def cdc_pending_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed changes of a table and service that a pending schema change could mend."""
    rows = outbox(spark, sf_dir)
    ddl = rows.where("event_family = 'ddl' and status = 'pending'").select("service_id", "database_name", "table_name").distinct()
    return rows.where("event_family = 'dml' and status = 'failed'").join(ddl, ["service_id", "database_name", "table_name"], "left_semi").select("id", "service_id")


QUERIES = {f.__name__: f for f in (cdc_transport_order, cdc_batches, cdc_wire, cdc_receive_idempotent, cdc_inbox_defaults, cdc_batch_rollup, cdc_batch_snapshot, cdc_wait_ack, cdc_retry_deadletter, cdc_requeue, recovery_guard, cdc_reconcile, cdc_reconcile_totals, cdc_pending_ddl)}

_STATUSES = ("pending", "batched", "sent", "acked", "applied", "failed", "dead")
_COUNTS = ", ".join(f"count(*) FILTER (WHERE e.status = '{n}') AS {n}_count" for n in _STATUSES)
_SNAPSHOT = "SELECT b.batch_id, b.service_id, b.status, b.first_event_id, b.last_event_id, b.event_count, b.retry_count, count(e.id) AS total_count, {counts} FROM batches b LEFT JOIN {events} e ON e.service_id = b.service_id AND e.id BETWEEN b.first_event_id AND b.last_event_id GROUP BY ALL"
_SIG = "sha256(concat_ws('|', database_name, table_name, op, CAST(pk AS VARCHAR), coalesce(CAST(k AS VARCHAR), '\\N'), log_file, CAST(log_pos AS VARCHAR)))"
_RECONCILED = f"""{CAPTURED}, log AS (SELECT id, {_SIG} AS signature, id % 37 = 0 AS ignored FROM feed),
    o AS (SELECT * REPLACE (CASE WHEN id > 10000000 THEN log_pos - 64 ELSE log_pos END AS log_pos) FROM captured WHERE id % 5 <> 1),
    f AS (SELECT {_SIG} AS signature, count(*) AS n, min(id) AS first FROM o GROUP BY 1),
    r AS (SELECT id, CASE WHEN ignored THEN 'ignored' WHEN n IS NULL THEN 'not_captured' WHEN n = 1 THEN 'captured' ELSE 'duplicate' END AS status,
        CASE WHEN ignored THEN 0 ELSE coalesce(n, 0) END AS outbound_match_count, CASE WHEN NOT ignored THEN first END AS first_outbound_event_id FROM log LEFT JOIN f USING (signature))"""
_ALIVE = f"""{OUTBOX}, incoming AS (SELECT * FROM outbox WHERE id % 3 <> 0), known AS (SELECT DISTINCT service_id, event_uid FROM outbox WHERE id % 10 = 0 AND event_uid <> '')"""
ORACLE_SQL = {
    "cdc_transport_order": f"""WITH {OUTBOX}, p AS (SELECT *, {PRIORITY} AS priority, row_number() OVER (PARTITION BY service_id ORDER BY id) AS n FROM outbox WHERE status = 'pending'),
        o AS (SELECT *, row_number() OVER (PARTITION BY service_id ORDER BY priority, id) AS transport_order FROM p WHERE n <= {10 * LIMIT})
        SELECT service_id, id, CAST(priority AS INTEGER) AS priority, transport_order FROM o WHERE transport_order <= {LIMIT}""",
    "cdc_batches": f"""WITH {OUTBOX}, n AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY service_id ORDER BY id) - 1) / {LIMIT}) AS BIGINT) AS batch_no FROM outbox WHERE status = 'pending')
        SELECT service_id, batch_no, count(*) AS event_count, min(id) AS first_event_id, max(id) AS last_event_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members,
            sha256(string_agg(concat_ws('|', CAST(id AS VARCHAR), op, CAST(pk AS VARCHAR), log_file, CAST(log_pos AS VARCHAR)), chr(10) ORDER BY id)) AS checksum FROM n GROUP BY 1, 2""",
    "cdc_wire": f"""WITH {OUTBOX} SELECT id, op AS operation, event_family, '' AS engine, '' AS transaction_id, log_pos, event_uid, sha256(concat_ws('|', CAST(id AS VARCHAR), op, object_type, log_file)) AS digest FROM outbox""",
    "cdc_receive_idempotent": f"""WITH {_ALIVE}, r AS (SELECT *, row_number() OVER (PARTITION BY service_id, event_uid ORDER BY id) AS n FROM incoming WHERE event_uid <> '')
        SELECT id, service_id, event_uid FROM r WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.service_id = r.service_id AND k.event_uid = r.event_uid)
        UNION ALL SELECT id, service_id, event_uid FROM incoming WHERE event_uid = ''""",
    "cdc_inbox_defaults": f"WITH {OUTBOX} SELECT id, CASE WHEN id % 2 = 0 THEN 'mariadb' ELSE 'mysql' END AS engine, CASE WHEN id % 3 <> 0 THEN event_family ELSE 'dml' END AS event_family FROM outbox",
    "cdc_batch_rollup": f"""WITH {INBOX}, g AS (SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE status = 'applied') AS applied, count(*) FILTER (WHERE status IN ('failed', 'dead')) AS bad,
            count(*) FILTER (WHERE status IN ('received', 'queued', 'applying')) AS open FROM inbox GROUP BY 1)
        SELECT *, CASE WHEN applied = total THEN 'applied' WHEN bad > 0 AND applied > 0 THEN 'partial' WHEN bad > 0 AND open = 0 THEN 'failed' ELSE '' END AS final_status FROM g""",
    "cdc_batch_snapshot": f"WITH {BATCHES} " + _SNAPSHOT.format(counts=_COUNTS, events="outbox"),
    "cdc_wait_ack": f"""WITH {BATCHES}, {INBOX.removeprefix(OUTBOX + ", ")}, s AS ({_SNAPSHOT.format(counts=_COUNTS, events="inbox")})
        SELECT batch_id, service_id, status, total_count, CASE WHEN total_count > 0 AND applied_count = total_count THEN 'WAIT_ACK_REMOTE_APPLIED'
            WHEN total_count > 0 AND failed_count + dead_count = total_count THEN 'WAIT_ACK_REMOTE_FAILED'
            WHEN total_count > 0 AND applied_count > 0 AND failed_count + dead_count > 0 THEN 'WAIT_ACK_REMOTE_PARTIAL'
            WHEN status = 'acked' OR acked_count > 0 THEN 'WAIT_ACK_ACKED_PENDING_APPLY' WHEN status = 'sent' OR sent_count > 0 THEN 'WAIT_ACK_PENDING_REMOTE_CALLBACK'
            WHEN status = 'failed' THEN 'WAIT_ACK_LOCAL_BATCH_FAILED' ELSE 'WAIT_ACK_UNEXPECTED_STATE' END AS return_code FROM s""",
    "cdc_retry_deadletter": f"WITH {OUTBOX} SELECT id, CAST(retry_count + 1 AS INTEGER) AS retry_count, CASE WHEN retry_count + 1 >= 5 THEN 'dead' ELSE 'failed' END AS status FROM outbox WHERE status = 'failed'",
    "cdc_requeue": f"""WITH {BATCHES} SELECT o.id, o.batch_id, CASE WHEN b.status = 'failed' AND o.status NOT IN ('acked', 'applied', 'dead') THEN 'pending' ELSE o.status END AS status
        FROM outbox o JOIN batches b USING (batch_id)""",
    "recovery_guard": f"""WITH {BATCHES}, e AS (SELECT *, date_sub('second', coalesce(sent_at, built_at), TIMESTAMP '{NOW}') AS elapsed FROM batches),
        c AS (SELECT *, CASE WHEN status <> 'failed' THEN 'NOT_FAILED' WHEN retry_count >= 3 THEN 'SOURCE_RETRY_MAX_ATTEMPTS_REACHED' WHEN elapsed < 432000 THEN 'SOURCE_RETRY_COOLDOWN_ACTIVE' ELSE 'SOURCE_RETRY_ALLOWED' END AS reason_code FROM e)
        SELECT batch_id, status, reason_code, CAST(CASE WHEN reason_code = 'SOURCE_RETRY_COOLDOWN_ACTIVE' THEN greatest(432000 - elapsed, 0) ELSE 0 END AS BIGINT) AS remaining_seconds FROM c""",
    "cdc_reconcile": f"WITH {_RECONCILED} SELECT * FROM r",
    "cdc_reconcile_totals": f"WITH {_RECONCILED} SELECT status, count(*) AS items FROM r GROUP BY 1",
    "cdc_pending_ddl": f"""WITH {OUTBOX} SELECT id, service_id FROM outbox o WHERE event_family = 'dml' AND status = 'failed' AND EXISTS (SELECT 1 FROM outbox d WHERE d.event_family = 'ddl'
        AND d.status = 'pending' AND d.service_id = o.service_id AND d.database_name = o.database_name AND d.table_name = o.table_name)""",
}
