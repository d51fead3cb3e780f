"""Small literal tables: rules, catalogs, plans, settings, topology, schemas."""

from __future__ import annotations

from rivulet.plans.values import PerEvent, Values

#: Names are decided on the supplied tables' names and some odd ones.
OBJECTS = PerEvent(
    "objects",
    "id long, engine string, database_name string, table_name string",
    [
        (1, "mariadb", "shop", "orders"), (2, "mariadb", "shop", "orders_old"), (3, "mysql", "shop", "customer"), (4, "postgresql", "shop", "customer"),
        (5, "mariadb", "tmp_work", "lineitem"), (6, "mariadb", "hr", "part_audit"), (7, "postgresql", "logs", "audit"), (8, " MariaDB ", " shop ", " nation "),
        (9, "mysql", "crm", "cdc_outbox"), (10, "mysql", "crm", " Django_Migrations "), (11, "mariadb", "crm", "region"), (12, "mariadb", "crm", ""), (13, "mysql", "hr", "django_sessions"),
    ],
)
RULES = Values(
    "rules",
    "id long, name string, is_enabled boolean, engine string, policy_mode string, object_type string, match_mode string, database_name string, table_name string, priority int",
    [
        (1, "keep shop", True, "mysql", "include", "database", "exact", "shop", "", 10),
        (2, "no old", True, "all", "exclude", "table", "contains", "", "_old", 20),
        (3, "no tmp", True, "all", "exclude", "database", "prefix", "tmp_", "", 5),
        (4, "off", False, "all", "exclude", "database", "exact", "hr", "", 1),
        (5, "no audit", True, "postgresql", "exclude", "table", "exact", "logs", "audit", 30),
        (6, "no audits", True, "mariadb", "exclude", "table", "contains", "hr", "audit", 30),
        (7, "odd kind", True, "all", "exclude", "schema", "exact", "crm", "", 2),
        (8, "keep crm region", True, "mariadb", "include", "table", "exact", "crm", "region", 40),
        (9, "no customer for pg", True, "postgresql", "exclude", "table", "exact", "shop", "customer", 15),
    ],
)
TABLES = Values(
    "catalog",
    "id long, service_id long, database_name string, table_name string, is_active boolean",
    [(i, 1, d, t, i % 9 != 0) for i, (d, t) in enumerate([(d, t) for d in ("crm", "hr", "shop", "tmp_work") for t in ("accounts", "audit_log", "customer", "lineitem", "orders", "orders_old", "cdc_outbox")], 1)],
)
DISCOVERED = Values("discovered", "database_name string, table_name string", [(d, t) for d in ("crm", "shop", "web") for t in ("accounts", "customer", "orders", "visits")])
PLANS = Values(
    "plans",
    "id long, name string, service_type string, scope_mode string, source_database_name string, database_include_csv string, database_exclude_csv string, database_like_pattern string, include_tables_csv string, exclude_tables_csv string, like_filter string, table_limit int, auto_exclude_internal boolean, recreate_table boolean",
    [
        (1, "all", "mariadb", "database", "", "", "tmp_work", "", "", "audit_log", "", 0, True, False),
        (2, "some", "mariadb", "tables", "shop", "", "", "", "orders, customer ,", "", "", 0, True, True),
        (3, "like", "mariadb", "pattern", "", "crm,shop", "", "%", "", "", "orders%", 1, False, False),
        (4, "picked", "mariadb", "tables", "", "", "", "", "", "", "", 0, True, False),
        (5, "h only", "mariadb", "database", "", "", "", "h_", "", "", "", 3, False, True),
    ],
)
SELECTIONS = Values(
    "selections",
    "id long, plan_id long, database_name string, table_name string, is_enabled boolean, execution_order int",
    [(1, 4, "shop", "orders", True, 120), (2, 4, "crm", "customer", True, 100), (3, 4, "hr", "accounts", False, 110), (4, 1, "shop", "orders", False, 500), (5, 1, "hr", "gone", True, 90)],
)
EXECUTIONS = Values("executions", "id long, plan_id long, status string", [(1, 1, "failed"), (2, 1, "success"), (3, 4, "failed"), (4, 4, "partial"), (5, 1, "failed"), (6, 1, "success")])
ITEMS = Values(
    "items",
    "id long, execution_id long, database_name string, table_name string, status string, rows_copied long, duration double",
    [(i, 1 + i % 6, ("crm", "hr", "shop")[i % 3], f"t{i % 7}", ("success", "failed", "success", "skipped")[i % 4], i * 1000, i / 4) for i in range(1, 41)],
)
ARCHIVE_RUNS = Values(
    "archive_runs",
    "id long, service_id long, status string, started_at string, finished_at string",
    [
        (1, 1, "success", "2024-01-10 00:00:00", "2024-01-10 01:00:00"), (2, 1, "failed", "2024-01-19 00:00:00", None), (3, 2, "partial", "2024-01-19 08:00:00", "2024-01-19 09:00:00"),
        (4, 3, "failed", "2024-01-01 00:00:00", None), (5, 4, "success", "2024-01-19 22:00:00", None), (6, 5, "success", None, None),
    ],
)
DEFINITIONS = Values(
    "definitions",
    "id long, key string, value_type string, default_value string, is_enabled boolean",
    [(1, "capture.limit", "integer", "100", True), (2, "capture.ratio", "float", "0.5", True), (3, "archive.on", "boolean", "yes", True), (4, "note", "string", None, True), (5, "capture.limit", "integer", "7", True), (6, "off", "string", "x", False), (7, "bad", "integer", "many", True)],
)
SETTINGS = Values(
    "settings",
    "id long, definition_id long, scope_type string, engine string, company_name string, client_name string, service_id long, node_id long, value_text string, priority int, is_enabled boolean, valid_from string, valid_until string",
    [
        (1, 1, "global", "all", None, None, None, None, "150", 10, True, None, None),
        (2, 1, "service", "all", None, None, 3, None, "999", 10, True, None, "2024-01-01 00:00:00"),
        (3, 1, "service", "all", None, None, 4, None, "400", 20, True, "2024-01-01 00:00:00", "2024-12-31 00:00:00"),
        (4, 1, "service", "all", None, None, 4, None, "401", 10, True, None, None),
        (5, 1, "node", "all", None, None, None, 2, "222", 10, True, None, None),
        (6, 1, "engine", "mysql", None, None, None, None, "333", 10, True, "2024-01-20 00:00:00", None),
        (7, 1, "company", "postgresql", "co0", None, None, None, "77", 10, True, None, None),
        (8, 2, "client", "all", None, "cl1", None, None, "0.25", 10, True, None, None),
        (9, 2, "global", "mariadb", None, None, None, None, "wrong", 10, True, None, None),
        (10, 3, "global", "all", None, None, None, None, " Off ", 10, False, None, None),
        (11, 4, "service", "all", None, None, 1, None, "hello", 10, True, "2025-01-01 00:00:00", None),
        (12, 3, "engine", "postgresql", None, None, None, None, "maybe", 10, True, None, None),
    ],
)
NODES = Values("nodes", "id long, name string, is_enabled boolean, status string", [(1, "alpha", True, "online"), (2, "beta", True, "degraded"), (3, "gamma", False, "offline"), (4, "delta", True, "online"), (5, "eps", False, "unknown")])
STEPS = Values(
    "steps",
    "plan_id long, step_no int, action string, node string, params_ok boolean",
    [
        (1, 1, "mariadb.stop_replica", "alpha", True), (1, 2, "mariadb.promote", " beta ", True), (2, 1, "", "alpha", True), (2, 2, "mariadb.restart", "gamma", True),
        (2, 3, "node.ping", "", False), (3, 1, "node.ping", "omega", True), (3, 2, "mariadb.set_read_only", "gamma", True), (4, 0, None, None, None),
    ],
)
FAILOVERS = Values("failovers", "id long, name string, status string", [(1, "good", "ready"), (2, "bad", "running"), (3, "half", "draft"), (4, "none", "ready")])
NODE_STATUS = PerEvent(
    "node_status",
    "node_id long, payload string",
    [
        (1, '{"services": {"mariadb": {"installed": true, "running": true}}}'), (2, '{"services": {"mariadb": {"running": false}, "pg": {"running": true}}}'), (3, "not json"),
        (4, '{"services": {"pg": {"installed": false, "running": false}}}'), (5, "{}"), (6, None),
    ],
)
MODEL_COLUMNS = Values(
    "model_columns",
    "model string, table_name string, field string, column_name string, kind string, max_length int, is_null boolean, is_unique boolean, is_indexed boolean, relation string",
    [
        ("order", "orders", "id", "o_orderkey", "BigAutoField", None, False, True, False, ""), ("order", "orders", "note", "o_note", "CharField", 255, True, False, True, ""),
        ("order", "orders", "customer", "o_custkey", "ForeignKey", None, False, False, True, "FK"), ("order", "orders", "status", "o_orderstatus", "CharField", 1, False, False, True, ""),
        ("part", "part", "id", "p_partkey", "BigAutoField", None, False, True, False, ""), ("part", "part", "name", "p_name", "CharField", 200, False, True, False, ""), ("part", "part", "brand", "p_brand", "SlugField", 50, True, False, True, ""),
        ("ghost", "ghost", "id", "id", "AutoField", None, False, True, False, ""), ("ghost", "ghost", "body", "body", "TextField", None, True, False, True, ""),
        ("nation", "nation", "id", "n_nationkey", "AutoField", None, False, True, False, ""), ("nation", "nation", "name", "n_name", "CharField", 25, False, False, False, ""), ("nation", "nation", "region", "n_regionkey", "ForeignKey", None, False, False, False, "FK"),
    ],
)
DB_COLUMNS = Values(
    "db_columns",
    "table_name string, column_name string, size int, null_ok boolean, default_value string",
    [
        ("orders", "o_orderkey", None, False, None), ("orders", "o_custkey", None, False, None), ("orders", "o_orderstatus", 1, True, "O"), ("orders", "o_extra", 10, True, None),
        ("part", "p_partkey", None, False, None), ("part", "p_name", 55, False, None), ("part", "p_brand", 50, True, None), ("nation", "n_nationkey", None, False, None), ("nation", "n_name", 25, False, None), ("nation", "n_regionkey", None, False, None),
    ],
)
DB_INDEXES = Values("db_indexes", "table_name string, index_name string, columns_csv string", [("orders", "pk_o", "o_orderkey"), ("orders", "ix_cust", "o_custkey,o_orderstatus"), ("part", "pk_p", "p_partkey"), ("part", "ux_name", "p_name"), ("nation", "pk_n", "n_nationkey")])
MODEL_INDEXES = Values("model_indexes", "model string, index_name string, fields_csv string", [("order", "ix1", "note,status"), ("order", "ix2", "status,customer"), ("ghost", "ix3", "-body"), ("part", "ix4", "name,brand")])
RELATIONS = Values("relations", "model string, direction string", [("order", d) for d in ("FK", "FK", "FK", "FK", "IN")] + [("nation", "IN")] * 7 + [("nation", "FK")] + [("part", "M2M"), ("part", "IN")])
OPERATIONS = PerEvent(
    "operations",
    "id long, op_type string, model string, table_name string, column_name string, columns_csv string, max_length int, is_null boolean, default_value string, is_unique boolean, is_safe boolean, reason string",
    [
        (1, "CreateModel", "order", "orders", None, None, None, None, None, False, True, ""), (2, "CreateModel", "ghost", "ghost", None, None, None, None, None, False, True, ""),
        (3, "AddField", "order", "orders", "o_note", None, None, None, None, False, True, ""), (4, "AddField", "part", "part", "p_brand", None, None, None, None, False, True, ""), (5, "AddField", "ghost", "ghost", "body", None, None, None, None, False, True, ""),
        (6, "AlterField", "part", "part", "p_name", None, 200, False, None, True, True, ""), (7, "AlterField", "part", "part", "p_brand", None, 50, True, None, False, True, ""), (8, "AlterField", "order", "orders", "o_orderstatus", None, 1, False, None, False, True, ""),
        (9, "AlterField", "order", "orders", "o_orderstatus", None, 1, True, "P", False, True, ""), (10, "AlterField", "nation", "nation", "n_name", None, 25, False, None, True, True, ""), (11, "AlterField", "nation", "nation", "n_none", None, None, None, None, False, True, ""),
        (12, "AddIndex", "order", "orders", None, "o_custkey,o_orderstatus", None, None, None, False, True, ""), (13, "AddIndex", "order", "orders", None, "o_custkey", None, None, None, False, False, "long key"), (14, "AddIndex", "ghost", "ghost", None, "body", None, None, None, False, True, ""),
        (15, "AddIndex", "nation", "nation", None, "n_name", None, None, None, False, False, ""),
    ],
)
STATEMENTS = PerEvent(
    "statements",
    "id long, sql string, ok boolean",
    [(i, s, i % 4 != 0) for i, s in enumerate(["CREATE TABLE t (a int)", " alter table t add b int", "drop table t;", "CREATE UNIQUE INDEX u ON t (a)", "create index i on t(a)", "DROP INDEX i", "insert into t values (1)", "Update t set a = 1", "DELETE FROM t", "select 1", "", "  ", "SAVEPOINT x", "create  table t (a int)", "PRAGMA y"], 1)],
)
DDL = PerEvent(
    "ddl",
    "id long, current_database string, sql string",
    [
        (1, "", "CREATE DATABASE IF NOT EXISTS `shop`;"), (2, "", "drop database shop"), (3, "", "CREATE TABLE `shop`.`orders` (id int)"), (4, "shop", "CREATE TABLE IF NOT EXISTS orders(id int)"),
        (5, "", "CREATE TABLE orders (id int)"), (6, "shop", "DROP TABLE IF EXISTS `orders` /* generated */"), (7, "", "drop table shop.orders"), (8, "shop", "CREATE UNIQUE INDEX ix ON orders (a, b)"),
        (9, "", "DROP INDEX ix ON shop.orders"), (10, "", "ALTER TABLE shop.orders ADD COLUMN c DECIMAL(10,2), DROP d, MODIFY `e` int"), (11, "shop", "alter table orders change a b varchar(20), ADD INDEX ix (a,b), drop primary key, ADD PRIMARY KEY (a)"),
        (12, "shop", "ALTER TABLE orders ENGINE=InnoDB"), (13, "shop", "ALTER TABLE orders RENAME TO x,, ADD f int"), (14, "shop", "INSERT INTO orders VALUES (1)"), (15, "shop", "  "), (16, "shop", "ALTER TABLE orders ADD UNIQUE KEY `uk` (a)"), (17, "shop", "drop index i on orders"),
    ],
)
SCALARS = PerEvent("scalars", "id long, raw string", [(i, v) for i, v in enumerate(["NULL", "null", "'O\\'B'", "'a\\\\b'", "1.5", "0", "1", "-17", "abc", "'NULL'", "''", "'", " 42 ", "1.2.3", "9223372036854775807", "''x''"], 1)])
