"""Tables of the change-data pipeline, derived from the supplied Parquet tables; each as DataFrame and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cuts the event ids into log files, and the copies of a tenth of the events that stand for re-captured ones.
FILE_EVENTS, COPY_OFFSET = 2500, 10_000_000
STATUSES = ("pending", "batched", "sent", "acked", "applied", "failed", "dead")
INBOX_STATUSES = ("received", "applied", "applied", "applied", "failed", "dead")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def change_feed(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """A row for each change: id, op, database_name, table_name, log_file, log_pos, pk, value, k, ts; more: further columns
    of its event."""
    i = F.col("event_id")
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    pk = F.when(i % 97 == 0, -i - 1).otherwise(F.col("user_id") * 100000 + F.floor(i / 3) % 7)
    name = F.concat(F.lit("bin."), F.lpad((1 + F.floor(i / FILE_EVENTS)).cast("string"), 6, "0"))
    return events(spark, sf_dir).select(
        i.alias("id"),
        op.alias("op"),
        F.lit("shop").alias("database_name"),
        F.lit("accounts").alias("table_name"),
        name.alias("log_file"),
        (4 + (i % FILE_EVENTS) * 128).alias("log_pos"),
        pk.cast("long").alias("pk"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        *more,
    )


FEED = f"""feed AS (
    SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
        'shop' AS database_name, 'accounts' AS table_name,
        'bin.' || lpad(CAST(1 + CAST(floor(event_id / {FILE_EVENTS}) AS BIGINT) AS VARCHAR), 6, '0') AS log_file,
        4 + (event_id % {FILE_EVENTS}) * 128 AS log_pos,
        CASE WHEN event_id % 97 = 0 THEN -event_id - 1 ELSE user_id * 100000 + CAST(floor(event_id / 3) AS BIGINT) % 7 END AS pk,
        value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts
    FROM events)"""


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as captured: every tenth change twice, the copy at a later log position."""
    feed = change_feed(spark, sf_dir)
    again = feed.where("id % 10 = 0").withColumn("id", F.col("id") + COPY_OFFSET).withColumn("log_pos", F.col("log_pos") + 64)
    return feed.unionByName(again)


CAPTURED = f"""{FEED}, captured AS (
    SELECT * FROM feed UNION ALL
    SELECT id + {COPY_OFFSET}, op, database_name, table_name, log_file, log_pos + 64, pk, value, k, ts FROM feed WHERE id % 10 = 0)"""


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes on their way: service_id, batch_id (100 changes each), status, retry_count, event_uid, family and object."""
    i = F.col("id")
    ddl = i % 50 == 7
    kind = F.when(~ddl, "").when(i % 3 == 0, "database").when(i % 3 == 1, "table").otherwise("column")
    uid = F.when(i % 41 == 0, "").otherwise(F.concat(F.lit("u-"), F.floor(i / 2).cast("string")))
    return change_feed(spark, sf_dir).select(
        "*",
        (i % 4 + 1).alias("service_id"),
        F.floor(i / 100).cast("long").alias("batch_id"),
        F.element_at(F.array(*map(F.lit, STATUSES)), ((i * 7 + F.floor(i / 100)) % 7 + 1).cast("int")).alias("status"),
        (i % 6).cast("int").alias("retry_count"),
        uid.alias("event_uid"),
        F.when(ddl, "ddl").otherwise("dml").alias("event_family"),
        kind.alias("object_type"),
    )


_LIST = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + "]"
OUTBOX = f"""{FEED}, outbox AS (
    SELECT *, id % 4 + 1 AS service_id, CAST(floor(id / 100) AS BIGINT) AS batch_id,
        ({_LIST(STATUSES)})[CAST((id * 7 + CAST(floor(id / 100) AS BIGINT)) % 7 + 1 AS INTEGER)] AS status,
        CAST(id % 6 AS INTEGER) AS retry_count,
        CASE WHEN id % 41 = 0 THEN '' ELSE 'u-' || CAST(CAST(floor(id / 2) AS BIGINT) AS VARCHAR) END AS event_uid,
        CASE WHEN id % 50 = 7 THEN 'ddl' ELSE 'dml' END AS event_family,
        CASE WHEN id % 50 <> 7 THEN '' WHEN id % 3 = 0 THEN 'database' WHEN id % 3 = 1 THEN 'table' ELSE 'column' END AS object_type
    FROM feed)"""


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes as received: the outbox's, with statuses of the receiving side."""
    i = F.col("id")
    status = F.element_at(F.array(*map(F.lit, INBOX_STATUSES)), ((i * 5 + F.floor(i / 100) * 3 + F.floor(i / 700)) % 6 + 1).cast("int"))
    status = F.when(F.col("batch_id") % 5 == 0, "applied").when(F.col("batch_id") % 7 == 3, F.when(i % 2 == 0, "failed").otherwise("dead")).otherwise(status)
    return outbox(spark, sf_dir).withColumn("status", status)


INBOX = f"""{OUTBOX}, inbox AS (
    SELECT * REPLACE (CASE WHEN batch_id % 5 = 0 THEN 'applied' WHEN batch_id % 7 = 3 THEN CASE WHEN id % 2 = 0 THEN 'failed' ELSE 'dead' END
        ELSE ({_LIST(INBOX_STATUSES)})[CAST((id * 5 + CAST(floor(id / 100) AS BIGINT) * 3 + CAST(floor(id / 700) AS BIGINT)) % 6 + 1 AS INTEGER)] END AS status)
    FROM outbox)"""

BATCH_STATUSES = ("ready", "sent", "acked", "failed", "sent")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each hundred changes: batch_id, service_id, status, first_event_id, last_event_id, event_count, retry_count, built_at, sent_at."""
    grouped = outbox(spark, sf_dir).groupBy("batch_id").agg(F.min("id").alias("first_event_id"), F.max("id").alias("last_event_id"), F.count("*").alias("event_count"), F.min("ts").alias("built_at"))
    b = F.col("batch_id")
    return grouped.select(
        "batch_id",
        (b % 4 + 1).alias("service_id"),
        F.element_at(F.array(*map(F.lit, BATCH_STATUSES)), (b * 3 % 5 + 1).cast("int")).alias("status"),
        "first_event_id",
        "last_event_id",
        "event_count",
        (b % 5).cast("int").alias("retry_count"),
        "built_at",
        F.when(b % 3 != 0, F.col("built_at") + F.expr("INTERVAL 90 SECONDS")).alias("sent_at"),
    )


BATCHES = f"""{OUTBOX}, batches AS (
    SELECT batch_id, batch_id % 4 + 1 AS service_id, ({_LIST(BATCH_STATUSES)})[CAST(batch_id * 3 % 5 + 1 AS INTEGER)] AS status,
        min(id) AS first_event_id, max(id) AS last_event_id, count(*) AS event_count, CAST(batch_id % 5 AS INTEGER) AS retry_count,
        min(ts) AS built_at, CASE WHEN batch_id % 3 <> 0 THEN min(ts) + INTERVAL 90 SECONDS END AS sent_at
    FROM outbox GROUP BY batch_id)"""


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of 40 services over time: id, service_id, service_type, payload (JSON), lag_seconds, collected_at."""
    i = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, SERVICE_TYPES)), (i % 40 % 4 + 1).cast("int"))
    lag = (i * 7 % 61).cast("string")
    payload = (
        F.when(i % 11 == 0, F.lit('{"installed": false}'))
        .when(i % 11 == 1, F.lit('{"error": " broken pipe "}'))
        .when(i % 11 == 2, F.lit('{"running": false, "lag_seconds": 3}'))
        .when(i % 11 == 3, F.concat(F.lit('{"lag_seconds": "soon", "delay_seconds": '), lag, F.lit("}")))
        .when(i % 2 == 0, F.concat(F.lit('{"replication_lag_seconds": '), lag, F.lit(', "running": true}')))
        .otherwise(F.concat(F.lit('{"delay_seconds": '), lag, F.lit(', "message": "fine"}')))
    )
    return events(spark, sf_dir).select(i.alias("id"), (i % 40).alias("service_id"), kind.alias("service_type"), payload.alias("payload"), (i * 7 % 61).cast("int").alias("lag_seconds"), F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("collected_at"))


SERVICE_TYPES = ("mariadb", "mysql", "postgresql", "filesync")
STATUS_LOG = f"""status_log AS (
    SELECT event_id AS id, event_id % 40 AS service_id, ({_LIST(SERVICE_TYPES)})[CAST(event_id % 40 % 4 + 1 AS INTEGER)] AS service_type,
        CASE WHEN event_id % 11 = 0 THEN '{{"installed": false}}' WHEN event_id % 11 = 1 THEN '{{"error": " broken pipe "}}'
            WHEN event_id % 11 = 2 THEN '{{"running": false, "lag_seconds": 3}}'
            WHEN event_id % 11 = 3 THEN '{{"lag_seconds": "soon", "delay_seconds": ' || CAST(event_id * 7 % 61 AS VARCHAR) || '}}'
            WHEN event_id % 2 = 0 THEN '{{"replication_lag_seconds": ' || CAST(event_id * 7 % 61 AS VARCHAR) || ', "running": true}}'
            ELSE '{{"delay_seconds": ' || CAST(event_id * 7 % 61 AS VARCHAR) || ', "message": "fine"}}' END AS payload,
        CAST(event_id * 7 % 61 AS INTEGER) AS lag_seconds, date_trunc('hour', ts) AS collected_at
    FROM events)"""


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream positions over time: id, service_id, node_id (some null), direction, log_pos, updated_at."""
    i = F.col("event_id")
    direction = F.element_at(F.array(*map(F.lit, DIRECTIONS)), (i % 4 + 1).cast("int"))
    return events(spark, sf_dir).select(i.alias("id"), (i % 9).alias("service_id"), (i % 5 + 1).alias("node_id"), direction.alias("direction"), (i * 100).alias("log_pos"), F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("updated_at"))


DIRECTIONS = ("capture", "shipper", "receiver", "applier")
CHECKPOINTS = f"""checkpoints AS (
    SELECT event_id AS id, event_id % 9 AS service_id, event_id % 5 + 1 AS node_id, ({_LIST(DIRECTIONS)})[CAST(event_id % 4 + 1 AS INTEGER)] AS direction,
        event_id * 100 AS log_pos, date_trunc('hour', ts) AS updated_at
    FROM events)"""


#: Events to a log file of the services that the events' users stand for.
LOG_EVENTS = 200


def service_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log files of each service: service_id, idx, name, size."""
    idx = (1 + F.floor(F.col("event_id") / LOG_EVENTS)).cast("int")
    rows = events(spark, sf_dir).groupBy(F.col("user_id").alias("service_id"), idx.alias("idx")).agg((4 + 128 * F.count("*")).alias("size"))
    return rows.select("service_id", "idx", F.concat(F.lit("bin."), F.lpad(F.col("idx").cast("string"), 6, "0")).alias("name"), "size")


SERVICE_LOGS = f"""logs AS (
    SELECT user_id AS service_id, CAST(1 + event_id // {LOG_EVENTS} AS INTEGER) AS idx, 'bin.' || lpad(CAST(1 + event_id // {LOG_EVENTS} AS VARCHAR), 6, '0') AS name, 4 + 128 * count(*) AS size
    FROM events GROUP BY 1, 2, 3)"""


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each service's capture stands, and what its last run met: service_id, start_file, start_pos, master_file,
    master_pos, scanned, skipped, captured, max_files, max_bytes."""
    s = F.col("service_id")
    files = service_logs(spark, sf_dir).groupBy("service_id").agg(F.array_sort(F.collect_list(F.struct("idx", "name", "size"))).alias("f"))  # a service's files
    seen = events(spark, sf_dir).groupBy(F.col("user_id").alias("service_id")).agg(F.count("*").alias("scanned"), F.count_if(F.col("event_type") == "error").alias("skipped"))
    first, last = F.get("f", F.least((s % 3).cast("int"), F.size("f") - 1)), F.element_at("f", -1)
    return files.join(seen, "service_id").select(
        "service_id",
        first["name"].alias("start_file"),
        (4 + 100 * (s % 5)).alias("start_pos"),
        last["name"].alias("master_file"),
        F.greatest(last["size"] - 50 * (s % 3), F.lit(4)).alias("master_pos"),
        "scanned",
        "skipped",
        (F.col("scanned") - F.col("skipped")).alias("captured"),
        (1 + s % 4).cast("int").alias("max_files"),
        (500 * (s % 6)).alias("max_bytes"),
    )


CURSORS = """cursors AS (
    SELECT service_id, f[least(service_id % 3 + 1, len(f))].name AS start_file, 4 + 100 * (service_id % 5) AS start_pos, f[-1].name AS master_file, greatest(f[-1].size - 50 * (service_id % 3), 4) AS master_pos,
        scanned, skipped, scanned - skipped AS captured, CAST(1 + service_id % 4 AS INTEGER) AS max_files, 500 * (service_id % 6) AS max_bytes
    FROM (SELECT service_id, list({'name': name, 'size': size} ORDER BY idx) AS f FROM logs GROUP BY 1)
    JOIN (SELECT user_id AS service_id, count(*) AS scanned, count(*) FILTER (WHERE event_type = 'error') AS skipped FROM events GROUP BY 1) USING (service_id))"""


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service for each user: id, name, engine, node_id, company_name, client_name, is_enabled."""
    i = F.col("id")
    engine = F.element_at(F.array(*map(F.lit, SERVICE_TYPES[:3])), (i % 3 + 1).cast("int"))
    text = lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    rows = events(spark, sf_dir).select(F.col("user_id").alias("id")).distinct()
    return rows.select("id", text("svc", i).alias("name"), engine.alias("engine"), (1 + i % 4).alias("node_id"), text("co", i % 2).alias("company_name"), text("cl", i % 3).alias("client_name"), (i % 5 != 0).alias("is_enabled"))


SERVICES = f"""services AS (
    SELECT DISTINCT user_id AS id, 'svc' || user_id AS name, ({_LIST(SERVICE_TYPES[:3])})[CAST(user_id % 3 + 1 AS INTEGER)] AS engine, 1 + user_id % 4 AS node_id, 'co' || user_id % 2 AS company_name, 'cl' || user_id % 3 AS client_name, user_id % 5 <> 0 AS is_enabled
    FROM events)"""
