"""Queries on JSON changes, rewrites of tables, outcomes, joins and display columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import text
from rivulet.operators import outcomes, schema_audit, status, tables, transport
from rivulet.plans.catalog import DB_COLUMNS, DB_INDEXES, NODES, OPERATIONS
from rivulet.plans.feed import BATCHES, FEED, OUTBOX, SERVICES, STATUS_LOG, batches, change_feed, events, outbox, services, status_log
from rivulet.queries_status import ORACLE_SQL as STATUS_SQL
from rivulet.sources import changes

NOW = "2024-02-01 00:00:00"


def slot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = change_feed(spark, sf_dir)
    key, new = F.create_map(F.lit("id"), F.col("pk").cast("string")), F.create_map(F.lit("id"), F.col("pk").cast("string"), F.lit("k"), F.col("k").cast("string"))
    one = F.struct(F.upper("op").alias("kind"), F.col("table_name").alias("table"), F.when(F.col("op") != "insert", key).alias("oldkeys"), F.when(F.col("op") != "delete", new).alias("newtuple"))
    rows = feed.select("id", F.to_json(F.struct(F.col("log_pos").cast("string").alias("lsn"), F.array(one, one).alias("change"))).alias("message"))
    got = changes.slot_changes(rows, "shop")
    return got.select("id", F.col("change_no").cast("int").alias("change_no"), "database_name", "table_name", "operation", "log_pos", F.try_element_at("key", F.lit("id")).alias("key_id"), F.size("before").alias("before_n"), F.try_element_at("after", F.lit("k")).alias("after_k"))


def row_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = change_feed(spark, sf_dir)
    image = F.create_map(F.lit("id"), F.col("pk").cast("string"))
    kind = F.when(F.col("op") == "insert", "WriteRowsEvent").when(F.col("op") == "delete", "DeleteRowsEvent").otherwise("UpdateRowsEvent")
    own = F.when(F.col("op") == "update", F.struct(F.lit(None).cast("map<string,string>").alias("values"), image.alias("before_values"), image.alias("after_values"))).otherwise(F.struct(image.alias("values"), F.lit(None).cast("map<string,string>").alias("before_values"), F.lit(None).cast("map<string,string>").alias("after_values")))
    rows = feed.select("id", F.to_json(F.struct(kind.alias("type"), F.lit("shop").alias("database"), F.lit("accounts").alias("table"), F.array_repeat(own, 2).alias("rows"))).alias("event"))
    got = changes.row_changes(rows)
    return got.select("id", F.col("row_no").cast("int").alias("row_no"), "op", F.try_element_at("before", F.lit("id")).alias("before_id"), F.try_element_at("after", F.lit("id")).alias("after_id"))


def column_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("nation", "region", "supplier")
    return changes.columns_by_ordinal(spark, {n: spark.read.parquet(f"{sf_dir}/{n}.parquet").schema for n in names}).select("table_name", "ordinal", "column_name")


def customer_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after upserts that repeat keys."""
    old = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    new = change_feed(spark, sf_dir).where("pk > 0").select((F.col("pk") % 97).alias("c_custkey"), F.concat(F.lit("from "), F.col("id").cast("string")).alias("c_name"), "id")
    return tables.upserted(old, new, ["c_custkey"], "id")


def order_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are left of orders and line items once some orders go."""
    orders, items = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    left = tables.without(orders, orders.where("o_orderkey % 7 = 0"), "o_orderkey", {"items": (items, "l_orderkey")})
    return left["rows"].agg(F.lit("orders").alias("name"), F.count("*").alias("left")).unionByName(left["items"].agg(F.lit("lineitem").alias("name"), F.count("*").alias("left")))


def status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outbox(spark, sf_dir).withColumn("sent_at", F.lit(None).cast("timestamp_ntz"))
    chosen = F.col("id").between(100, 900) & ~F.col("status").isin("applied", "dead")
    return tables.with_status(rows, chosen, "sent", "sent_at", NOW).groupBy("status", "sent_at").agg(F.count("*").alias("events"))


def batch_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.in_flight(batches(spark, sf_dir))


def resume_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batches(spark, sf_dir)
    out = tables.resume_diagnosis(rows, transport.batch_snapshot(rows, outbox(spark, sf_dir)))
    return out.select("batch_id", "total_count", "failed_count", "open_batches", "would_build", "would_send")


def capture_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    reason = F.element_at(F.array(*map(F.lit, ("no_events_available", "capture_limit_reached", " Scan_Window_Limit_Reached ", "", "timeout"))), (i % 5 + 1).cast("int"))
    o = outcomes.capture_outcome(i % 31 == 0, reason, i % 3 - 1, i % 4 - 2, i % 2 == 0)
    return events(spark, sf_dir).select(o.alias("o")).groupBy("o.status", "o.code").agg(F.count("*").alias("runs"))


def transport_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    action = F.element_at(F.array(*map(F.lit, ("send_batch", "build_batch", "cycle"))), (i % 3 + 1).cast("int"))
    o = outcomes.transport_outcome(action, i % 5 != 0, i % 7 == 0, F.when(i % 2 == 0, "Failed"))
    return events(spark, sf_dir).select(o.alias("o")).groupBy("o.status", "o.code").agg(F.count("*").alias("runs"))


def repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.repair_plan(schema_audit.operation_statuses(OPERATIONS.of(spark, sf_dir), DB_COLUMNS.df(spark), DB_INDEXES.df(spark)))


def node_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services that touch node 2 as source or target, with their node (left join) and enabled reports (semi join)."""
    own = services(spark, sf_dir).select("id", "name", F.col("node_id").alias("source_node_id"), ((F.col("id") * 3) % 5).alias("target_node_id"))
    rows = status.touching(own, 2).join(NODES.df(spark).select(F.col("id").alias("target_node_id"), F.col("name").alias("target")), "target_node_id", "left")
    return rows.join(status_log(spark, sf_dir).select(F.col("service_id").alias("id")), "id", "left_semi").select("id", "name", "target")


def report_payload_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by the key of a node's payload that their kind of service reads; kinds without one are skipped."""
    known = F.create_map(*(F.lit(x) for k in ("postgresql", "mariadb", "filesync", "nginx") for x in (k, k)))
    rows = status_log(spark, sf_dir).withColumn("payload_key", F.try_element_at(known, F.col("service_type"))).where("payload_key is not null")
    return rows.groupBy("payload_key").agg(F.count("*").alias("reports"), F.max("id").alias("latest"))


def changed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the column names of both images, and those that only one has."""
    i = F.col("event_id")
    before, after = F.array(F.lit("id"), F.when(i % 2 == 0, "a").otherwise("b")), F.array(F.lit("id"), F.when(i % 3 == 0, "a").otherwise("c"))
    return events(spark, sf_dir).select("event_id", F.array_join(F.array_sort(F.array_union(before, after)), ",").alias("either"), F.array_join(F.array_except(before, after), ",").alias("gone"))


def lock_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.timestamp_diff("SECOND", F.col("ts").cast("timestamp_ntz"), F.lit(NOW).cast("timestamp_ntz")) % 200_000
    return events(spark, sf_dir).select("event_id", text.elapsed_label(age).alias("label"), text.preview(F.col("props"), 5).alias("head"), text.quoted(F.concat(F.col("event_type"), F.lit("`x"))).alias("quoted"), text.is_identifier(F.concat(F.when(F.col("event_id") % 2 == 0, "1").otherwise("_"), F.col("event_type"))).alias("is_name"))


def clean_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.create_map(F.encode("event_type", "UTF-8"), F.unhex(F.lit("61FF62")))
    return events(spark, sf_dir).select("event_id", text.clean_map(row).alias("m")).select("event_id", F.map_keys("m")[0].alias("key"), F.map_values("m")[0].alias("value"))


QUERIES = {f.__name__: f for f in (slot_changes, row_changes, column_catalog, customer_upsert, order_deletion, status_update, batch_in_flight, resume_diagnosis, capture_outcomes, transport_outcomes, repair_plan, node_services, report_payload_keys, changed_keys, lock_labels, clean_keys)}
_AGE = f"(date_sub('second', ts, TIMESTAMP '{NOW}') % 200000)"
_OPS = STATUS_SQL["op_status"].removesuffix(" SELECT * FROM ops")
_CODE = "CASE WHEN event_id % 31 = 0 THEN 'success/CAPTURE_INIT_ONLY' WHEN event_id % 5 = 0 THEN 'success/CAPTURE_NO_EVENTS' WHEN c > 0 AND s > 0 THEN 'warning/CAPTURE_WARNING' WHEN c > 0 AND event_id % 5 IN (1, 2) THEN 'success/CAPTURE_OK_PARTIAL' WHEN c > 0 THEN 'success/CAPTURE_OK' WHEN s > 0 THEN 'warning/CAPTURE_WARNING_SKIPPED_ONLY' WHEN event_id % 5 IN (1, 2) THEN 'success/CAPTURE_OK_PARTIAL' WHEN event_id % 2 = 0 THEN 'success/CAPTURE_OK' ELSE 'error/CAPTURE_ERROR' END"
_TCODE = "CASE WHEN event_id % 5 = 0 THEN 'error/TRANSPORT_' || upper(a) || '_ERROR' WHEN event_id % 7 = 0 THEN 'warning/TRANSPORT_' || upper(a) || '_SKIPPED' WHEN a = 'send_batch' AND event_id % 2 = 0 THEN 'warning/TRANSPORT_SEND_BATCH_FAILED_ACCEPTED' ELSE 'success/TRANSPORT_' || upper(a) || '_OK' END"
ORACLE_SQL = {
    "slot_changes": f"WITH {FEED} SELECT id, CAST(n AS INTEGER) AS change_no, 'shop' AS database_name, table_name, op AS operation, CAST(log_pos AS VARCHAR) AS log_pos, CASE WHEN op <> 'insert' THEN CAST(pk AS VARCHAR) END AS key_id, CASE WHEN op <> 'insert' THEN 1 ELSE 0 END AS before_n, CASE WHEN op <> 'delete' THEN CAST(k AS VARCHAR) END AS after_k FROM feed, range(2) AS r(n)",
    "row_changes": f"WITH {FEED} SELECT id, CAST(n AS INTEGER) AS row_no, op, CASE WHEN op <> 'insert' THEN CAST(pk AS VARCHAR) END AS before_id, CASE WHEN op <> 'delete' THEN CAST(pk AS VARCHAR) END AS after_id FROM feed, range(2) AS r(n)",
    "column_catalog": " UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST(row_number() OVER () AS INTEGER) AS ordinal, column_name FROM (DESCRIBE {t})" for t in ("nation", "region", "supplier")),
    "customer_upsert": f"""WITH {FEED}, n AS (SELECT pk % 97 AS c_custkey, 'from ' || max(id) AS c_name FROM feed WHERE pk > 0 GROUP BY 1) SELECT * FROM n UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n)""",
    "order_deletion": "SELECT 'orders' AS name, count(*) AS \"left\" FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0)",
    "status_update": f"WITH {OUTBOX}, u AS (SELECT id BETWEEN 100 AND 900 AND status NOT IN ('applied', 'dead') AS c, status FROM outbox) SELECT CASE WHEN c THEN 'sent' ELSE status END AS status, CASE WHEN c THEN TIMESTAMP '{NOW}' END AS sent_at, count(*) AS events FROM u GROUP BY 1, 2",
    "batch_in_flight": f"WITH {BATCHES} SELECT service_id, NOT bool_or(status IN ('ready', 'sent', 'acked', 'failed')) AS may_build, NOT bool_or(status IN ('sent', 'acked')) AS may_ship FROM batches GROUP BY 1",
    "resume_diagnosis": f"""WITH {BATCHES}, b AS (SELECT * FROM batches), s AS (SELECT b.*, (SELECT count(*) FROM outbox o WHERE o.service_id = b.service_id AND o.id BETWEEN b.first_event_id AND b.last_event_id) AS total_count,
            (SELECT count(*) FROM outbox o WHERE o.status = 'failed' AND o.service_id = b.service_id AND o.id BETWEEN b.first_event_id AND b.last_event_id) AS failed_count, (SELECT count(*) - 1 FROM b x WHERE x.service_id = b.service_id AND x.status IN ('ready', 'sent', 'acked', 'failed')) AS open_batches FROM b WHERE status = 'failed')
        SELECT batch_id, total_count, failed_count, open_batches, open_batches = 0 AS would_build, open_batches = 0 AND CASE WHEN failed_count > 0 THEN failed_count ELSE total_count END > 0 AS would_send FROM s""",
    "capture_outcomes": f"WITH e AS (SELECT event_id, event_id % 3 - 1 AS c, event_id % 4 - 2 AS s FROM events), o AS (SELECT {_CODE} AS o FROM e) SELECT split_part(o, '/', 1) AS status, split_part(o, '/', 2) AS code, count(*) AS runs FROM o GROUP BY 1, 2",
    "transport_outcomes": f"WITH e AS (SELECT event_id, (['send_batch', 'build_batch', 'cycle'])[CAST(event_id % 3 + 1 AS INTEGER)] AS a FROM events), o AS (SELECT {_TCODE} AS o FROM e) SELECT split_part(o, '/', 1) AS status, split_part(o, '/', 2) AS code, count(*) AS runs FROM o GROUP BY 1, 2",
    "repair_plan": f"{_OPS}, r AS (SELECT model, count(*) FILTER (WHERE op_type = 'AddField' AND status = 'missing') AS missing_fields, count(*) FILTER (WHERE op_type = 'AlterField' AND status = 'missing') AS missing_alterations, count(*) FILTER (WHERE op_type = 'AddIndex' AND status = 'missing') AS missing_indexes FROM ops GROUP BY 1) SELECT *, missing_fields = 0 AND missing_alterations = 0 AS can_fake FROM r",
    "node_services": f"WITH {SERVICES}, {NODES.cte}, {STATUS_LOG}, s AS (SELECT id, name, node_id AS source, id * 3 % 5 AS target FROM services) SELECT s.id, s.name, n.name AS target FROM s LEFT JOIN nodes n ON n.id = s.target WHERE (s.source = 2 OR s.target = 2) AND s.id IN (SELECT service_id FROM status_log)",
    "report_payload_keys": f"WITH {STATUS_LOG} SELECT service_type AS payload_key, count(*) AS reports, max(id) AS latest FROM status_log WHERE service_type <> 'mysql' GROUP BY 1",
    "changed_keys": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'a,id' ELSE 'a,c,id' END ELSE CASE WHEN event_id % 3 = 0 THEN 'a,b,id' ELSE 'b,c,id' END END AS either, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN '' ELSE 'a' END ELSE 'b' END AS gone FROM events",
    "lock_labels": f"""SELECT event_id, CASE WHEN {_AGE} // 60 < 60 THEN ({_AGE} // 60) || ' min' WHEN {_AGE} // 60 < 1440 THEN ({_AGE} // 3600) || 'h ' || ({_AGE} // 60 % 60) || 'min' ELSE ({_AGE} // 86400) || 'j' END AS label, left(props, 5) AS head, '`' || event_type || '``x`' AS quoted, event_id % 2 <> 0 AS is_name FROM events""",
    "clean_keys": "SELECT event_id, event_type AS key, 'a' || chr(65533) || 'b' AS value FROM events",
}
