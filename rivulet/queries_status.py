"""Queries on retention, settings, monitoring, failover plans and schema audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators import retention, schema_audit, settings, status
from rivulet.plans.catalog import ARCHIVE_RUNS, DB_COLUMNS, DB_INDEXES, DEFINITIONS, FAILOVERS, MODEL_COLUMNS, MODEL_INDEXES, NODE_STATUS, NODES, OPERATIONS, RELATIONS, SETTINGS, STATEMENTS, STEPS
from rivulet.plans.feed import BATCHES, INBOX, OUTBOX, SERVICES, STATUS_LOG, batches, events, inbox, outbox, services, status_log
from rivulet.plans.values import PerEvent
from rivulet.operators.ordered import latest

NOW, DAYS = "2024-01-25 00:00:00", 10
BEFORE = "TIMESTAMP '2024-01-15 00:00:00'"

#: A setting for each event.
EVENT_SETTINGS = PerEvent("settings", SETTINGS.schema, SETTINGS.rows)


def archive_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = retention.cutoff(NOW, DAYS)
    out = retention.candidates(outbox(spark, sf_dir), "outbound_finalized", "ts", before).select(F.lit("outbound").alias("mode"), "id")
    inb = retention.candidates(inbox(spark, sf_dir), "inbound_finalized", "ts", before).select(F.lit("inbound").alias("mode"), "id")
    bat = retention.candidates(batches(spark, sf_dir), "transport_batch_finalized", "built_at", before, inbox(spark, sf_dir)).select(F.lit("batch").alias("mode"), F.col("batch_id").alias("id"))
    plain = retention.candidates(events(spark, sf_dir), "simple", "ts", before).select(F.lit("simple").alias("mode"), F.col("event_id").alias("id"))
    return out.unionByName(inb).unionByName(bat).unionByName(plain)


def archive_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that a retention of 5 years leaves, by status."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    old = retention.candidates(orders, "simple", "o_orderdate", retention.cutoff("2000-01-01 00:00:00", 5 * 365))
    return orders.join(old.select("o_orderkey"), "o_orderkey", "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("orders"))


def archive_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.archive_due(services(spark, sf_dir), ARCHIVE_RUNS.df(spark), "2024-01-20 00:00:00")


def archive_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = retention.cutoff(NOW, DAYS)
    rows = retention.candidates(outbox(spark, sf_dir), "outbound_finalized", "ts", before)
    return rows.groupBy("service_id", "status").agg(F.count("*").alias("archived"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def settings_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings.resolved(services(spark, sf_dir), DEFINITIONS.df(spark), SETTINGS.df(spark), "2024-06-01 00:00:00")


def settings_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = settings.resolved(services(spark, sf_dir), DEFINITIONS.df(spark), SETTINGS.df(spark), "2024-06-01 00:00:00", ("service", "global"), checked=False)
    return out.select("service_id", "key", "source", "setting_id")


def validity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EVENT_SETTINGS.of(spark, sf_dir).select("id", settings.valid_at("2024-01-20 00:00:00").alias("valid"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.status_counts({"outbound": outbox(spark, sf_dir), "inbound": inbox(spark, sf_dir), "batch": batches(spark, sf_dir)})


def _locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches(spark, sf_dir).select((F.col("batch_id") % 3 == 0).alias("is_locked"))


def global_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.global_status(NODES.df(spark), services(spark, sf_dir), FAILOVERS.df(spark), _locks(spark, sf_dir))


def replication_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each service by its latest report."""
    rows = latest(status_log(spark, sf_dir).drop("lag_seconds"), ["service_id"], "id")
    p = F.col("payload")
    return rows.select("service_id", "service_type", status.replication_status(F.col("service_type"), p).alias("status"), status.lag_seconds(p).alias("lag_seconds"), status.last_error(p).alias("last_error"))


def replication_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = status_log(spark, sf_dir)
    return rows.groupBy("service_type", status.replication_status(F.col("service_type"), F.col("payload")).alias("status")).agg(F.count("*").alias("reports"))


def node_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NODE_STATUS.of(spark, sf_dir).select("node_id", status.node_status(F.col("payload")).alias("status"))


def _audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = events(spark, sf_dir), F.col("event_id")
    return e.where("event_id % 3 = 0").select(i.alias("id"), F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("created_at"), F.when(i % 2 == 0, "info").otherwise("error").alias("level"), "event_type", F.when(i % 5 != 0, F.concat(F.lit("n"), (i % 4).cast("string"))).alias("node"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("message"))


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = events(spark, sf_dir), F.col("event_id")
    return e.where("event_id % 3 = 1").select(i.alias("id"), F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("created_at"), F.lit("success").alias("status"), F.lit("node.ping").alias("action_name"), F.lit(None).cast("string").alias("node"), (i % 900).alias("duration_ms"))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.journal(_audits(spark, sf_dir), _actions(spark, sf_dir))


def console_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.console_summary(batches(spark, sf_dir))


def failover_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.failover_findings(STEPS.df(spark), NODES.df(spark))


def _model(spark: SparkSession) -> DataFrame:
    return MODEL_COLUMNS.df(spark)


def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_audit.column_diff(_model(spark), DB_COLUMNS.df(spark))


def index_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_audit.index_risks(_model(spark), MODEL_INDEXES.df(spark), DB_INDEXES.df(spark))


def impact_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = _model(spark).select("model", "table_name").distinct()
    return schema_audit.impact(models, schema_diff(spark, sf_dir), index_risk(spark, sf_dir), RELATIONS.df(spark))


def op_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_audit.operation_statuses(OPERATIONS.of(spark, sf_dir), DB_COLUMNS.df(spark), DB_INDEXES.df(spark))


def presim_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_audit.operation_summary(op_status(spark, sf_dir))


def ddl_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STATEMENTS.of(spark, sf_dir).groupBy(schema_audit.statement_kind(F.col("sql")).alias("kind")).agg(F.count("*").alias("statements"), F.count_if("ok").alias("succeeded"))


QUERIES = {f.__name__: f for f in (archive_candidates, archive_orders, archive_due, archive_totals, settings_resolve, settings_archive, validity_filter, status_counts, global_status, replication_status, replication_status_counts, node_health, journal, console_summary, failover_validate, schema_diff, index_risk, impact_score, op_status, presim_summary, ddl_classify)}

_TRUE = "('1', 'true', 'yes', 'y', 'on')"
_VALID = "(valid_from IS NULL OR CAST(valid_from AS TIMESTAMP) <= TIMESTAMP '{now}') AND (valid_until IS NULL OR CAST(valid_until AS TIMESTAMP) >= TIMESTAMP '{now}')"


def _decode(raw: str) -> str:
    return f"""CASE value_type WHEN 'integer' THEN coalesce(CAST(CASE WHEN regexp_full_match(trim({raw}), '[+-]?[0-9]+') THEN CAST(trim({raw}) AS BIGINT) END AS VARCHAR), '0')
        WHEN 'float' THEN coalesce(CAST(TRY_CAST({raw} AS DOUBLE) AS VARCHAR), '0.0') WHEN 'boolean' THEN CAST(lower(trim(coalesce({raw}, ''))) IN {_TRUE} AS VARCHAR) ELSE coalesce({raw}, '') END"""


def _resolved(scopes: tuple[str, ...], checked: bool) -> str:
    match = {"service": "v.service_id = s.id", "node": "v.node_id = s.node_id", "client": "v.client_name = s.client_name", "company": "v.company_name = s.company_name", "engine": "v.engine = s.engine", "global": "true"}
    hit = " OR ".join(f"(v.scope_type = '{k}' AND {match[k]})" for k in scopes)
    extra = f"AND {_VALID.format(now='2024-06-01 00:00:00')} AND v.engine IN ('all', s.engine)" if checked else ""
    rank = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(scopes))
    return f"""{SERVICES}, {DEFINITIONS.cte}, {SETTINGS.cte}, k AS (SELECT key, min(id) AS definition_id FROM definitions WHERE is_enabled GROUP BY 1), d AS (SELECT k.*, value_type, default_value FROM k JOIN definitions f ON f.id = k.definition_id),
        h AS (SELECT s.id AS service_id, v.definition_id, v.id AS setting_id, v.value_text, v.scope_type, row_number() OVER (PARTITION BY s.id, v.definition_id ORDER BY CASE v.scope_type {rank} END, v.priority, v.id) AS n FROM services s JOIN settings v ON v.is_enabled AND ({hit}) {extra}),
        r AS (SELECT s.id AS service_id, d.key, d.value_type, d.default_value, h.setting_id, h.value_text, h.scope_type FROM services s CROSS JOIN d LEFT JOIN h ON h.service_id = s.id AND h.definition_id = d.definition_id AND h.n = 1)"""


_SOURCE = "CASE WHEN setting_id IS NOT NULL THEN scope_type WHEN coalesce(default_value, '') <> '' THEN 'default' ELSE 'fallback' END AS source"
_J = lambda c, k: f"json_extract_string({c}, '$.{k}')"
_LAG = "coalesce(TRY_CAST(coalesce(" + ", ".join(_J("payload", k) for k in status.LAG_KEYS) + ") AS INTEGER), 0)"
_STATE = f"""CASE WHEN coalesce({_J("payload", "installed")}, 'true') = 'false' THEN 'unknown' WHEN trim(coalesce({_J("payload", "error")}, '')) <> '' OR coalesce({_J("payload", "running")}, 'true') = 'false' THEN 'error'
    WHEN service_type IN ('postgresql', 'mariadb', 'filesync') AND {_LAG} > 30 THEN 'lagging' ELSE 'ok' END"""
_ERROR = "coalesce(" + ", ".join(f"nullif(trim({_J('payload', k)}), '')" for k in status.ERROR_KEYS) + ", '')"
_KINDS = "('CharField', 'SlugField', 'URLField')"
_DIFF = f"""{MODEL_COLUMNS.cte}, {DB_COLUMNS.cte}, t AS (SELECT DISTINCT table_name FROM db_columns), w AS (SELECT DISTINCT table_name, column_name FROM model_columns WHERE column_name <> ''),
    diff AS (SELECT table_name, column_name, CASE WHEN table_name NOT IN (SELECT table_name FROM t) THEN 'table_missing' ELSE 'missing_in_db' END AS difference FROM w WHERE (table_name, column_name) NOT IN (SELECT (table_name, column_name) FROM db_columns)
        UNION ALL SELECT table_name, column_name, 'extra_in_db' FROM db_columns WHERE table_name IN (SELECT table_name FROM model_columns) AND (table_name, column_name) NOT IN (SELECT (table_name, column_name) FROM w))"""
_LONG = f"(kind IN {_KINDS} AND coalesce(max_length, 0) > 191)"
_RISK = f"""{DB_INDEXES.cte}, {MODEL_INDEXES.cte}, ic AS (SELECT DISTINCT table_name, unnest(string_split(columns_csv, ',')) AS column_name FROM db_indexes), mf AS (SELECT model, index_name, ltrim(unnest(string_split(fields_csv, ',')), '-') AS field FROM model_indexes),
    risks AS (SELECT model, 'risky_indexed' AS risk, field AS subject FROM model_columns WHERE is_indexed AND ({_LONG} OR kind = 'TextField') UNION ALL SELECT model, 'risky_unique', field FROM model_columns WHERE is_unique AND {_LONG}
        UNION ALL SELECT model, 'fk_without_index', field FROM model_columns m WHERE relation = 'FK' AND NOT EXISTS (SELECT 1 FROM ic WHERE ic.table_name = m.table_name AND ic.column_name = m.column_name)
        UNION ALL SELECT DISTINCT model, 'risky_composite', index_name FROM mf JOIN model_columns USING (model, field) WHERE {_LONG} OR kind = 'TextField')"""
_OPS = f"""{OPERATIONS.cte}, {DB_COLUMNS.cte}, {DB_INDEXES.cte}, x AS (SELECT o.*, EXISTS (SELECT 1 FROM db_columns c WHERE c.table_name = o.table_name) AS has_table, c.column_name IS NOT NULL AS has_column, c.size, c.null_ok, c.default_value AS db_default,
        EXISTS (SELECT 1 FROM db_indexes i WHERE i.table_name = o.table_name AND i.columns_csv = o.columns_csv) AS has_index, EXISTS (SELECT 1 FROM db_indexes i WHERE i.table_name = o.table_name AND i.columns_csv = o.column_name) AS alone
        FROM operations o LEFT JOIN db_columns c ON c.table_name = o.table_name AND c.column_name = o.column_name),
    f AS (SELECT id, op_type, model, CASE WHEN NOT has_table THEN 'table missing' WHEN op_type = 'AddField' AND NOT has_column THEN 'column missing' WHEN op_type = 'AlterField' THEN
        CASE WHEN NOT has_column THEN 'column missing: ' || column_name WHEN max_length > 0 AND size > 0 AND size <> max_length THEN 'length mismatch db=' || size || ' model=' || max_length
            WHEN is_null IS NOT NULL AND null_ok IS NOT NULL AND is_null <> null_ok THEN 'null mismatch db=' || CASE WHEN null_ok THEN 'True' ELSE 'False' END || ' model=' || CASE WHEN is_null THEN 'True' ELSE 'False' END
            WHEN default_value IS NOT NULL AND default_value IS DISTINCT FROM db_default THEN 'default mismatch db=' || coalesce(db_default, 'None') || ' model=' || default_value WHEN is_unique AND NOT alone THEN 'missing unique index' END
        WHEN op_type = 'AddIndex' AND NOT has_index THEN CASE WHEN is_safe THEN '' ELSE coalesce(nullif(reason, ''), 'unsafe index') END END AS fault FROM x),
    ops AS (SELECT id, op_type, model, CASE WHEN fault IS NULL THEN 'applied' ELSE 'missing' END AS status, coalesce(fault, '') AS reason FROM f)"""
_SQL = "upper(trim(sql))"
_KIND = f"CASE WHEN {_SQL} = '' THEN '' " + " ".join(f"WHEN starts_with({_SQL}, '{s}') THEN '{s.replace(' ', '_')}'" for s in schema_audit.STATEMENTS) + f" ELSE regexp_split_to_array({_SQL}, '\\s+')[1] END"
_FIND = "SELECT plan_id, step_no, '{level}' AS level, {message} AS message FROM s WHERE {cond}"
ORACLE_SQL = {
    "archive_candidates": f"""WITH {BATCHES}, {INBOX.removeprefix(OUTBOX + ", ")} SELECT 'outbound' AS mode, id FROM outbox WHERE ts < {BEFORE} AND status IN ('applied', 'dead') UNION ALL SELECT 'inbound', id FROM inbox WHERE ts < {BEFORE} AND status IN ('applied', 'dead')
        UNION ALL SELECT 'batch', batch_id FROM batches b WHERE built_at < {BEFORE} AND status IN ('acked', 'failed') AND NOT EXISTS (SELECT 1 FROM inbox i WHERE i.batch_id = b.batch_id AND i.status IN ('received', 'queued', 'applying'))
        UNION ALL SELECT 'simple', event_id FROM events WHERE ts < {BEFORE}""",
    "archive_orders": "SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 1825 DAYS GROUP BY 1",
    "archive_due": f"""WITH {SERVICES}, {ARCHIVE_RUNS.cte}, l AS (SELECT service_id, max(id) AS id FROM archive_runs WHERE status IN ('success', 'partial') GROUP BY 1), a AS (SELECT s.id AS service_id, l.id AS run, CAST(coalesce(finished_at, started_at) AS TIMESTAMP) AS ended FROM services s LEFT JOIN l ON l.service_id = s.id LEFT JOIN archive_runs r ON r.id = l.id),
        e AS (SELECT *, date_sub('second', ended, TIMESTAMP '2024-01-20 00:00:00') AS elapsed FROM a), c AS (SELECT *, CASE WHEN run IS NULL THEN 'no_previous_archive_run' WHEN ended IS NULL THEN 'previous_archive_run_without_datetime' WHEN elapsed < 86400 THEN 'archive_interval_not_reached' ELSE 'archive_interval_reached' END AS reason FROM e)
        SELECT service_id, reason <> 'archive_interval_not_reached' AS due, reason, CAST(CASE WHEN reason = 'archive_interval_not_reached' THEN 86400 - elapsed ELSE 0 END AS BIGINT) AS remaining_seconds FROM c""",
    "archive_totals": f"WITH {OUTBOX} SELECT service_id, status, count(*) AS archived, min(id) AS first_id, max(id) AS last_id FROM outbox WHERE ts < {BEFORE} AND status IN ('applied', 'dead') GROUP BY 1, 2",
    "settings_resolve": f"WITH {_resolved(settings.SCOPES, True)} SELECT service_id, key, CASE WHEN setting_id IS NOT NULL THEN {_decode('value_text')} WHEN coalesce(default_value, '') <> '' THEN {_decode('default_value')} END AS value, {_SOURCE}, setting_id FROM r",
    "settings_archive": f"WITH {_resolved(('service', 'global'), False)} SELECT service_id, key, {_SOURCE}, setting_id FROM r",
    "validity_filter": f"WITH {EVENT_SETTINGS.cte} SELECT id, {_VALID.format(now='2024-01-20 00:00:00')} AS valid FROM settings",
    "status_counts": f"WITH {BATCHES}, {INBOX.removeprefix(OUTBOX + ', ')} SELECT 'outbound' AS source, status, count(*) AS events FROM outbox GROUP BY 2 UNION ALL SELECT 'inbound', status, count(*) FROM inbox GROUP BY 2 UNION ALL SELECT 'batch', status, count(*) FROM batches GROUP BY 2",
    "global_status": f"""WITH {BATCHES}, {NODES.cte}, {SERVICES}, {FAILOVERS.cte} SELECT (SELECT count(*) FROM nodes) AS nodes_total, (SELECT count(*) FROM nodes WHERE is_enabled) AS nodes_enabled, (SELECT count(*) FROM nodes WHERE status = 'online') AS nodes_online,
        (SELECT count(*) FROM nodes WHERE status = 'offline') AS nodes_offline, (SELECT count(*) FROM nodes WHERE status = 'degraded') AS nodes_degraded, (SELECT count(*) FROM services) AS replication_total, (SELECT count(*) FROM services WHERE is_enabled) AS replication_enabled,
        (SELECT count(*) FROM failovers WHERE status IN ('ready', 'running')) AS active_failovers, (SELECT count(*) FROM batches WHERE batch_id % 3 = 0) AS locked_objects""",
    "replication_status": f"WITH {STATUS_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY service_id ORDER BY id DESC) AS n FROM status_log) SELECT service_id, service_type, {_STATE} AS status, {_LAG} AS lag_seconds, {_ERROR} AS last_error FROM r WHERE n = 1",
    "replication_status_counts": f"WITH {STATUS_LOG} SELECT service_type, {_STATE} AS status, count(*) AS reports FROM status_log GROUP BY 1, 2",
    "node_health": f"""WITH {NODE_STATUS.cte}, p AS (SELECT node_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM node_status), s AS (SELECT node_id, unnest(map_values(CAST(json_extract(j, '$.services') AS MAP(VARCHAR, MAP(VARCHAR, BOOLEAN))))) AS v FROM p WHERE json_extract(j, '$.services') IS NOT NULL)
        SELECT node_id, CASE WHEN j IS NULL OR EXISTS (SELECT 1 FROM s WHERE s.node_id = p.node_id AND coalesce(v['installed'], true) AND v['running'] = false) THEN 'degraded' ELSE 'online' END AS status FROM p""",
    "journal": """WITH a AS (SELECT 'audit' AS kind, event_id AS id, date_trunc('hour', ts) AS created_at, ' ' || CASE WHEN event_id % 2 = 0 THEN 'info' ELSE 'error' END || ' ' || event_type || ' on ' || CASE WHEN event_id % 5 <> 0 THEN 'n' || (event_id % 4) ELSE '-' END || ': user ' || user_id AS t FROM events WHERE event_id % 3 = 0 ORDER BY 3 DESC, 2 DESC LIMIT 10),
        b AS (SELECT 'action' AS kind, event_id AS id, date_trunc('hour', ts) AS created_at, ' success node.ping on - in ' || (event_id % 900) || ' ms' AS t FROM events WHERE event_id % 3 = 1 ORDER BY 3 DESC, 2 DESC LIMIT 10)
        SELECT kind, id, created_at, strftime(created_at, '%Y-%m-%d %H:%M:%S') || t AS line FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
    "console_summary": f"""WITH {BATCHES} SELECT service_id, count(*) FILTER (WHERE status = 'failed') AS failed_batches, count(*) FILTER (WHERE status = 'ready') AS ready_batches, count(*) FILTER (WHERE status = 'sent') AS sent_batches, count(*) FILTER (WHERE status = 'acked') AS acked_batches,
        count(*) FILTER (WHERE status IN ('failed', 'ready', 'sent', 'acked')) AS total_batches FROM batches GROUP BY ROLLUP (service_id)""",
    "failover_validate": f"""WITH {STEPS.cte}, {NODES.cte}, s AS (SELECT t.plan_id, t.step_no, trim(coalesce(t.action, '')) AS action, trim(coalesce(t.node, '')) AS node, t.params_ok, n.id AS known, n.is_enabled FROM steps t LEFT JOIN nodes n ON n.name = trim(t.node)) """
    + " UNION ALL ".join(
        _FIND.format(level=a, message=b, cond=c)
        for a, b, c in (
            ("error", "'the plan names no steps'", "step_no = 0"),
            ("error", "'no action is given'", "step_no > 0 AND action = ''"),
            ("error", "'no node is given'", "step_no > 0 AND node = ''"),
            ("error", "'node ''' || node || ''' is unknown'", "step_no > 0 AND node <> '' AND known IS NULL"),
            ("warning", "'node ''' || node || ''' is switched off'", "step_no > 0 AND NOT is_enabled"),
            ("error", "'parameters are no mapping'", "step_no > 0 AND NOT params_ok"),
            ("error", "'no such database action: ' || action", "starts_with(action, 'mariadb.') AND action NOT IN ('mariadb.stop_replica', 'mariadb.start_replica', 'mariadb.promote', 'mariadb.set_read_only')"),
        )
    ),
    "schema_diff": f"WITH {_DIFF} SELECT * FROM diff",
    "index_risk": f"WITH {MODEL_COLUMNS.cte}, {_RISK} SELECT * FROM risks",
    "impact_score": f"""WITH {_DIFF}, {_RISK}, {RELATIONS.cte}, m AS (SELECT DISTINCT model, table_name FROM model_columns), g AS (SELECT m.model, EXISTS (SELECT 1 FROM diff d WHERE d.table_name = m.table_name AND difference = 'table_missing') AS no_table,
            EXISTS (SELECT 1 FROM diff d WHERE d.table_name = m.table_name AND difference <> 'extra_in_db') AS no_column, EXISTS (SELECT 1 FROM risks r WHERE r.model = m.model AND risk = 'risky_indexed') AS a, EXISTS (SELECT 1 FROM risks r WHERE r.model = m.model AND risk = 'risky_unique') AS b,
            EXISTS (SELECT 1 FROM risks r WHERE r.model = m.model AND risk = 'risky_composite') AS c, (SELECT count(*) FROM relations r WHERE r.model = m.model) AS n, (SELECT count(*) FROM relations r WHERE r.model = m.model AND direction = 'FK') AS fk, (SELECT count(*) FROM relations r WHERE r.model = m.model AND direction NOT IN ('FK', 'M2M')) AS inb FROM m),
        s AS (SELECT *, 5 * no_table::INT + 4 * no_column::INT + 2 * a::INT + 2 * b::INT + 3 * c::INT + CASE WHEN n >= 8 THEN 2 ELSE 0 END AS score FROM g)
        SELECT model, CAST(score AS INTEGER) AS impact_score, CASE WHEN score >= 8 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS impact_level, CASE WHEN no_table OR no_column THEN 'CRITICAL' WHEN a OR b OR c OR fk >= 4 OR inb >= 6 OR n >= 10 OR score >= 8 THEN 'WARNING' ELSE 'OK' END AS severity FROM s""",
    "op_status": f"WITH {_OPS} SELECT * FROM ops",
    "presim_summary": f"WITH {_OPS} SELECT op_type, model, count(*) AS operations, count(*) FILTER (WHERE status = 'applied') AS applied, count(*) FILTER (WHERE status = 'missing') AS missing FROM ops GROUP BY 1, 2",
    "ddl_classify": f"WITH {STATEMENTS.cte} SELECT {_KIND} AS kind, count(*) AS statements, count(*) FILTER (WHERE ok) AS succeeded FROM statements GROUP BY 1",
}
