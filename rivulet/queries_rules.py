"""Queries on scope rules, name filters, capture plans and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators import bootstrap, capture, rules
from rivulet.plans.catalog import DISCOVERED, EXECUTIONS, ITEMS, OBJECTS, PLANS, RULES, SELECTIONS, TABLES
from rivulet.plans.feed import CURSORS, OUTBOX, SERVICE_LOGS, cursors, outbox, service_logs
from rivulet.plans.values import PerEvent

#: A table for each event.
EVENT_TABLES = PerEvent("catalog", TABLES.schema, TABLES.rows)


def scope_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = OBJECTS.of(spark, sf_dir)
    keys = ["engine", "database_name", "table_name"]
    return names.join(rules.scope_decisions(names, RULES.df(spark)), keys).select("id", "decision", "allowed", "rule_id")


def scope_rules_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = OBJECTS.of(spark, sf_dir)
    keys = ["engine", "database_name", "table_name"]
    return names.join(rules.scope_decisions(names, RULES.df(spark), strict_include=True), keys).select("id", "decision", "allowed")


def scope_rules_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.first_match_excludes(OBJECTS.of(spark, sf_dir).select("id", "database_name", "table_name"), RULES.df(spark), "mariadb")


def hard_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return OBJECTS.of(spark, sf_dir).select("id", rules.hard_excluded().alias("excluded"))


def name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = EVENT_TABLES.of(spark, sf_dir).where(rules.name_filter("database_name", F.lit("crm, shop ,hr"), F.lit("hr,"), F.lit("%o%")) & rules.name_filter("table_name", F.lit(""), F.lit("audit_log"), F.lit("orders%")))
    return rows.select("id", "database_name", "table_name")


def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rules.search(customers, "AUTO", "c_name", "c_mktsegment").select("c_custkey", "c_mktsegment")


def cdc_backlog_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.backlog(cursors(spark, sf_dir), service_logs(spark, sf_dir)).select("service_id", "backlog_bytes", "backlog_files")


def cdc_adaptive_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = capture.backlog(cursors(spark, sf_dir), service_logs(spark, sf_dir)).withColumn("backlog_bytes", F.col("backlog_bytes") * 300)
    return rows.select("service_id", capture.adaptive_events().alias("events"), capture.adaptive_files().alias("files"), capture.adaptive_bytes().alias("bytes"))


def cdc_scan_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = service_logs(spark, sf_dir)
    out = capture.scan_window(capture.backlog(cursors(spark, sf_dir), logs), logs)
    return out.select("service_id", "start_idx", "end_idx", "window_end_idx", "window_end_file", "window_end_pos", "empty_window")


def cdc_capture_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.counters(outbox(spark, sf_dir), F.col("id") % 11 == 0, F.col("id") % 7 == 0)


def bootstrap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("customer", "nation", "orders", "part", "supplier")
    out = None
    for n in names:
        one = spark.read.parquet(f"{sf_dir}/{n}.parquet").agg(F.lit(n).alias("table_name"), F.count("*").alias("row_count"))
        out = one if out is None else out.unionByName(one)
    return out


_CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


def table_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.checksum(spark.read.parquet(f"{sf_dir}/customer.parquet"), *_CUSTOMER)


def snapshot_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    other = rows.withColumn("c_name", F.when(F.col("c_custkey") == 7, "x").otherwise(F.col("c_name")))
    same = bootstrap.snapshot_verdict(rows, rows.orderBy(F.desc("c_custkey")), *_CUSTOMER).withColumn("case", F.lit("same"))
    return same.unionByName(bootstrap.snapshot_verdict(rows, other, *_CUSTOMER).withColumn("case", F.lit("changed"))).select("case", "source_count", "target_count", "verified")


def snapshot_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    other = rows.where("c_custkey % 10 <> 3").withColumn("c_name", F.when(F.col("c_custkey") % 10 == 4, "x").otherwise(F.col("c_name")))
    return bootstrap.differing_keys(rows.where("c_custkey % 10 <> 5"), other, "c_custkey", *_CUSTOMER)


def plan_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.work_items(PLANS.df(spark), SELECTIONS.df(spark).where("plan_id <> 1"), TABLES.df(spark))


def replay_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, items = EXECUTIONS.df(spark), ITEMS.df(spark)
    every = bootstrap.replay_items(runs, items).withColumn("mode", F.lit("last"))
    failed = bootstrap.replay_items(runs, items, True, True).withColumn("mode", F.lit("failed"))
    return every.unionByName(failed).select("mode", "plan_id", "execution_id", "id", "status")


def execution_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.execution_rollup(EXECUTIONS.df(spark), ITEMS.df(spark))


def selection_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = TABLES.df(spark).where("is_active and database_name in ('shop', 'tmp_work', 'hr')").select("database_name", "table_name")
    kept = rules.first_match_excludes(tables, RULES.df(spark), "mariadb").where("not excluded").select("database_name", "table_name")
    return bootstrap.synced_selections(kept, SELECTIONS.df(spark).where("plan_id = 1"))


def catalog_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.catalog_diff(DISCOVERED.df(spark), TABLES.df(spark).where("database_name <> 'hr'"))


QUERIES = {f.__name__: f for f in (scope_rules, scope_rules_strict, scope_rules_first_match, hard_exclude, name_filter, name_search, cdc_backlog_bytes, cdc_adaptive_limits, cdc_scan_window, cdc_capture_counters, bootstrap_counts, table_checksum, snapshot_verify, snapshot_differences, plan_expand, replay_items, execution_rollup, selection_sync, catalog_diff)}


def _fit(value: str, wanted: str, blank: str) -> str:
    v, w = f"trim(coalesce({value}, ''))", f"trim(coalesce({wanted}, ''))"
    return f"(CASE WHEN {w} = '' THEN {blank} WHEN r.match_mode = 'exact' THEN {v} = {w} WHEN r.match_mode = 'prefix' THEN starts_with({v}, {w}) WHEN r.match_mode = 'contains' THEN contains({v}, {w}) ELSE false END)"


_ENGINE = "(r.engine = 'all' OR r.engine = lower(trim(o.engine)) OR (r.engine IN ('mysql', 'mariadb') AND lower(trim(o.engine)) IN ('mysql', 'mariadb')))"
_FITS = f"({_fit('o.database_name', 'r.database_name', 'true')} AND (r.object_type = 'database' OR (r.object_type = 'table' AND {_fit('o.table_name', 'r.table_name', 'true')})))"
_FIRST = f"r.engine IN ('all', 'mariadb') AND ((r.object_type = 'database' AND {_fit('o.database_name', 'r.database_name', 'false')}) OR (r.object_type = 'table' AND (trim(r.database_name) = '' OR {_fit('o.database_name', 'r.database_name', 'false')}) AND {_fit('o.table_name', 'r.table_name', 'false')}))"
_SCOPE = f"""{OBJECTS.cte}, {RULES.cte}, m AS (SELECT o.id, r.id AS rule_id, r.priority, r.policy_mode, {_FITS} AS fits FROM objects o LEFT JOIN rules r ON r.is_enabled AND {_ENGINE}),
    d AS (SELECT id, first(rule_id ORDER BY priority, rule_id) FILTER (WHERE fits AND policy_mode = 'exclude') AS rule_id, coalesce(bool_or(fits AND policy_mode = 'include'), false) AS included, coalesce(bool_or(policy_mode = 'include'), false) AS has_include FROM m GROUP BY id)"""
_DECISION = "CASE WHEN rule_id IS NOT NULL THEN 'denied_by_exclude_rule' WHEN included THEN 'allowed_by_include_rule' {strict} ELSE 'allowed_by_default_no_include_rules' END"
_FIRST_CTE = "f AS (SELECT o.*, first(r.policy_mode ORDER BY r.priority, r.id) FILTER (WHERE r.id IS NOT NULL) AS mode, first(r.id ORDER BY r.priority, r.id) FILTER (WHERE r.id IS NOT NULL) AS rule_id FROM {rows} o LEFT JOIN rules r ON r.is_enabled AND {on} GROUP BY ALL)"
_LIST = lambda c: f"list_filter(list_transform(string_split({c}, ','), lambda x: trim(x)), lambda x: x <> '')"


def _named(name: str, include: str, exclude: str, like: str) -> str:
    return f"(len({_LIST(include)}) = 0 OR list_contains({_LIST(include)}, {name})) AND NOT list_contains({_LIST(exclude)}, {name}) AND (trim({like}) = '' OR {name} LIKE trim({like}))"


_BACKLOG = f"""{SERVICE_LOGS}, {CURSORS}, p AS (SELECT c.*, s.idx AS start_idx, m.idx AS end_idx FROM cursors c LEFT JOIN logs s ON s.service_id = c.service_id AND s.name = c.start_file LEFT JOIN logs m ON m.service_id = c.service_id AND m.name = c.master_file),
    b AS (SELECT p.*, CAST(coalesce((SELECT sum(greatest(CASE WHEN l.idx = start_idx AND l.idx = end_idx THEN master_pos - start_pos WHEN l.idx = start_idx THEN size - start_pos WHEN l.idx = end_idx THEN master_pos ELSE size END, 0)) FROM logs l WHERE l.service_id = p.service_id AND l.idx BETWEEN start_idx AND end_idx), 0) AS BIGINT) AS backlog_bytes,
        (SELECT count(*) FROM logs l WHERE l.service_id = p.service_id AND l.idx BETWEEN start_idx AND end_idx) AS backlog_files FROM p)"""
_DIGEST = "sha256(concat_ws('|', CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment))"
_SUM = lambda i: f"CAST(sum(CAST(('0x' || substr({_DIGEST}, {1 + 12 * i}, 12)) AS BIGINT)) AS VARCHAR)"
ORACLE_SQL = {
    "scope_rules": f"WITH {_SCOPE}, e AS (SELECT id, rule_id, {_DECISION.format(strict='')} AS decision FROM d) SELECT id, decision, starts_with(decision, 'allowed') AS allowed, rule_id FROM e",
    "scope_rules_strict": f"WITH {_SCOPE}, e AS (SELECT id, {_DECISION.format(strict=chr(10) + ' WHEN has_include THEN ' + repr('denied_because_include_rules_exist_but_no_match'))} AS decision FROM d) SELECT id, decision, starts_with(decision, 'allowed') AS allowed FROM e",
    "scope_rules_first_match": f"WITH {OBJECTS.cte}, {RULES.cte}, n AS (SELECT id, database_name, table_name FROM objects), {_FIRST_CTE.format(rows='n', on=_FIRST)} SELECT id, database_name, table_name, coalesce(mode = 'exclude', false) AS excluded, rule_id FROM f",
    "hard_exclude": f"WITH {OBJECTS.cte} SELECT id, starts_with(lower(trim(table_name)), 'cdc_') OR lower(trim(table_name)) IN ('django_migrations', 'django_content_type', 'auth_permission', 'django_admin_log') AS excluded FROM objects",
    "name_filter": f"WITH {EVENT_TABLES.cte} SELECT id, database_name, table_name FROM catalog WHERE database_name IN ('crm', 'shop') AND database_name LIKE '%o%' AND table_name LIKE 'orders%'",
    "name_search": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_name ILIKE '%auto%' OR c_mktsegment ILIKE '%auto%'",
    "cdc_backlog_bytes": f"WITH {_BACKLOG} SELECT service_id, backlog_bytes, backlog_files FROM b",
    "cdc_adaptive_limits": f"""WITH {_BACKLOG}, e AS (SELECT *, backlog_bytes * 300 AS bb, greatest(500, floor(backlog_bytes * 300 / 2048)) + greatest(backlog_files - 1, 0) * 1500 AS base, CASE WHEN scanned > 0 THEN skipped / scanned ELSE 0 END AS ratio FROM b),
        g AS (SELECT *, floor(base * CASE WHEN ratio >= 0.9 THEN 2.0 WHEN ratio >= 0.75 THEN 1.5 ELSE 1.0 END) AS one FROM e)
        SELECT service_id, CAST(least(greatest(floor(one * CASE WHEN captured <= 0 AND skipped > 0 THEN 1.5 ELSE 1.0 END), 500), 50000) AS BIGINT) AS events,
            CAST(least(greatest(backlog_files, 2), 12) AS BIGINT) AS files, CAST(least(greatest(bb, 67108864), 536870912) AS BIGINT) AS bytes FROM g""",
    "cdc_scan_window": f"""WITH {_BACKLOG}, w AS (SELECT *, least(end_idx, start_idx + greatest(max_files, 1) - 1) AS window_end_idx FROM b),
        x AS (SELECT w.*, l.name AS window_end_file, CASE WHEN start_idx = end_idx AND max_bytes > 0 THEN least(master_pos, start_pos + max_bytes) WHEN window_end_idx < end_idx THEN l.size ELSE master_pos END AS window_end_pos
            FROM w LEFT JOIN logs l ON l.service_id = w.service_id AND l.idx = w.window_end_idx)
        SELECT service_id, start_idx, end_idx, CAST(window_end_idx AS INTEGER) AS window_end_idx, window_end_file, window_end_pos, window_end_idx = start_idx AND window_end_pos <= start_pos AS empty_window FROM x""",
    "cdc_capture_counters": f"""WITH {OUTBOX} SELECT count(*) AS scanned, count(*) FILTER (WHERE id % 11 = 0) AS hard_skipped, count(*) FILTER (WHERE id % 11 <> 0 AND id % 7 = 0) AS rule_skipped, count(*) FILTER (WHERE id % 11 <> 0 AND id % 7 <> 0) AS captured,
        count(*) FILTER (WHERE id % 11 <> 0 AND id % 7 <> 0 AND event_family = 'dml') AS captured_dml, count(*) FILTER (WHERE id % 11 <> 0 AND id % 7 <> 0 AND event_family = 'ddl') AS captured_ddl FROM outbox""",
    "bootstrap_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in ("customer", "nation", "orders", "part", "supplier")),
    "table_checksum": f"SELECT count(*) AS row_count, concat_ws(':', {', '.join(map(_SUM, range(4)))}) AS checksum FROM customer",
    "snapshot_verify": "SELECT 'same' AS case, count(*) AS source_count, count(*) AS target_count, true AS verified FROM customer UNION ALL SELECT 'changed', count(*), count(*), false FROM customer",
    "snapshot_differences": "SELECT c_custkey, CASE c_custkey % 10 WHEN 3 THEN 'missing' WHEN 5 THEN 'extra' ELSE 'changed' END AS difference FROM customer WHERE c_custkey % 10 IN (3, 4, 5)",
    "plan_expand": f"""WITH {PLANS.cte}, {SELECTIONS.cte}, {TABLES.cte}, s AS (SELECT * FROM selections WHERE is_enabled AND plan_id <> 1),
        picked AS (SELECT plan_id, 'plan_selection' AS source, database_name, table_name, recreate_table, row_number() OVER (PARTITION BY plan_id ORDER BY execution_order, s.id) AS item_no FROM s JOIN plans p ON p.id = s.plan_id),
        a AS (SELECT p.id AS plan_id, 'plan_auto' AS source, c.database_name, c.table_name, recreate_table, table_limit, row_number() OVER (PARTITION BY p.id, c.database_name ORDER BY c.table_name) AS n FROM plans p, catalog c
            WHERE c.is_active AND p.id NOT IN (SELECT plan_id FROM s) AND (CASE WHEN source_database_name <> '' THEN c.database_name = source_database_name ELSE {_named("c.database_name", "database_include_csv", "database_exclude_csv", "database_like_pattern")} END)
            AND {_named("c.table_name", "(CASE WHEN scope_mode = 'tables' THEN include_tables_csv ELSE '' END)", "exclude_tables_csv", "like_filter")} AND NOT (auto_exclude_internal AND starts_with(c.table_name, 'cdc_')))
        SELECT * FROM picked UNION ALL SELECT plan_id, source, database_name, table_name, recreate_table, row_number() OVER (PARTITION BY plan_id ORDER BY database_name, table_name) FROM a WHERE table_limit <= 0 OR n <= table_limit""",
    "replay_items": f"""WITH {EXECUTIONS.cte}, {ITEMS.cte}, l AS (SELECT plan_id, max(id) AS execution_id FROM executions GROUP BY 1), f AS (SELECT plan_id, max(id) AS execution_id FROM executions WHERE status = 'failed' GROUP BY 1)
        SELECT 'last' AS mode, plan_id, execution_id, id, status FROM items JOIN l USING (execution_id) UNION ALL SELECT 'failed', plan_id, execution_id, id, status FROM items JOIN f USING (execution_id) WHERE status = 'failed'""",
    "execution_rollup": f"""WITH {EXECUTIONS.cte}, {ITEMS.cte} SELECT e.plan_id, e.status, i.execution_id, count(*) AS tables, count(DISTINCT database_name) AS databases, count(*) FILTER (WHERE i.status = 'success') AS succeeded, count(*) FILTER (WHERE i.status = 'failed') AS failed,
        CAST(sum(rows_copied) AS BIGINT) AS rows_copied, round(sum(duration), 3) AS duration, round(sum(rows_copied) / sum(duration), 2) AS rows_per_second FROM executions e JOIN items i ON i.execution_id = e.id GROUP BY e.plan_id, e.status, i.execution_id""",
    "selection_sync": f"""WITH {TABLES.cte}, {RULES.cte}, {SELECTIONS.cte}, t AS (SELECT database_name, table_name FROM catalog WHERE is_active AND database_name IN ('shop', 'tmp_work', 'hr')), {_FIRST_CTE.format(rows="t", on=_FIRST)},
        k AS (SELECT database_name, table_name, 100 + 10 * (row_number() OVER (ORDER BY database_name, table_name) - 1) AS d FROM f WHERE coalesce(mode = 'include', true)), s AS (SELECT * FROM selections WHERE plan_id = 1)
        SELECT k.database_name, k.table_name, true AS is_enabled, CAST(coalesce(nullif(execution_order, 0), d) AS BIGINT) AS execution_order, CASE WHEN s.id IS NULL THEN 'created' ELSE 'updated' END AS change FROM k LEFT JOIN s USING (database_name, table_name)
        UNION ALL SELECT database_name, table_name, false, CAST(execution_order AS BIGINT), CASE WHEN is_enabled THEN 'disabled' ELSE 'unchanged' END FROM s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.database_name = s.database_name AND k.table_name = s.table_name)""",
    "catalog_diff": f"""WITH {DISCOVERED.cte}, {TABLES.cte}, k AS (SELECT * FROM catalog WHERE database_name <> 'hr')
        SELECT coalesce(d.database_name, k.database_name) AS database_name, coalesce(d.table_name, k.table_name) AS table_name, CASE WHEN k.id IS NULL THEN 'create' WHEN d.table_name IS NOT NULL AND NOT is_active THEN 'activate' WHEN d.table_name IS NOT NULL THEN 'keep'
            WHEN is_active THEN 'deactivate' ELSE 'inactive' END AS action FROM discovered d FULL JOIN k ON d.database_name = k.database_name AND d.table_name = k.table_name""",
}
