"""Queries on statements of the log, nested images, ids by content, and work on many tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import text
from rivulet.operators import capture, parallel, snapshot
from rivulet.operators.ordered import running_sum
from rivulet.plans.feed import CAPTURED, FEED, OUTBOX, captured, events, outbox
from rivulet.queries_apply import EVERY, statements
from rivulet.queries_text import log_text
from rivulet.session import scratch, staged
from rivulet.sources import changes, logtext

#: Every so many changes a statement follows in the log, and every so many events bring another column.
STATEMENT_EVERY, COLUMN_EVERY = 20, 700
TABLES = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


def mixed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log text with statements of several lines between the row events; texts in them hold the delimiter."""
    i = F.col("event_id")
    n = F.floor(i / STATEMENT_EVERY)
    text_of = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    alter = F.array(
        text_of("use `shop", n % 3, "`/*!*/;"),
        F.when(n % 4 == 0, text_of("CREATE TABLE `accounts", n, "` (")).otherwise("ALTER TABLE accounts"),
        F.when(n % 4 == 0, F.lit("  id INT,")).otherwise(text_of("  ADD COLUMN c", n, " VARCHAR(9) DEFAULT 'a/*!*/;")),
        F.when(n % 4 == 0, F.lit("  note VARCHAR(20) DEFAULT 'it''s; so')")).otherwise(text_of("# b',", "  DROP COLUMN d", n)),
        F.lit("/*!*/;"),
    )
    rows = events(spark, sf_dir).where(i % STATEMENT_EVERY == 0).select(i.alias("id"), F.posexplode(alter).alias("n", "line"))
    first = spark.createDataFrame([(-1, "DELIMITER /*!*/;")], "line_no long, line string")
    return log_text(spark, sf_dir).unionByName(rows.select((F.col("id") * 16 + 11 + F.col("n")).alias("line_no"), "line")).unionByName(first)


def log_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row events and schema changes of one log in one order."""
    log = staged(mixed_log(spark, sf_dir), "log")
    rows = logtext.row_events(log).select("line_no", F.lit(0).alias("clause_no"), F.lit("row").alias("family"), "database_name", "table_name", "op", F.lit("").alias("object_name"), "log_pos")
    found = staged(logtext.statements(log), "statements")
    ddl = logtext.ddl_events(found).select("line_no", "clause_no", F.lit("ddl").alias("family"), "database_name", "table_name", F.col("ddl_action").alias("op"), "object_name", "log_pos")
    return rows.unionByName(ddl)


def event_uids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by content of each change and of its batch of a hundred; a batch that is sent again keeps its ids."""
    rows = captured(spark, sf_dir)
    uid = text.name_uuid(F.concat_ws("|", F.lit("svc"), "log_file", "log_pos"))
    batch = F.floor(F.col("id") % 10_000_000 / 100)
    again = rows.unionByName(rows.where(batch % 5 == 0))
    out = again.select("id", uid.alias("event_uid"), text.name_uuid(F.concat(F.lit("batch|"), batch.cast("string"))).alias("batch_uid"))
    return out.groupBy("event_uid", "batch_uid").agg(F.min("id").alias("id"), F.count("*").alias("sent"))


def nested_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested images of the events with their ordinals named by the schema at each one's place: a column more for every
    700 events; ordinals that it does not have yet stay and are found."""
    i = F.col("event_id")
    image = F.concat(F.lit('{"UNKNOWN_COL0": '), i.cast("string"), F.lit(', "list": [{"UNKNOWN_COL1": ['), F.lit('{"UNKNOWN_COL2": "x,\\"UNKNOWN_COL1\\":"}, '), F.get_json_object("props", "$.k"), F.lit(']}, "UNKNOWN_COL0"], "deep": {"deeper": {"UNKNOWN_COL'), (i % 6).cast("string"), F.lit('": null}}}'))
    rows = events(spark, sf_dir).select(i.alias("id"), image.alias("image"), (i % COLUMN_EVERY == 0).cast("int").alias("more"))
    rows = running_sum(rows, F.col("more"), "id", "version")
    columns = F.transform(F.sequence(F.lit(0), F.least(F.lit(2) + F.col("version"), F.lit(5)).cast("int")), lambda n: F.concat(F.lit("name\\"), n.cast("string")))
    named = rows.withColumn("image", text.renamed_keys(F.col("image"), columns))
    return named.select("id", "image", text.unresolved(F.col("image")).alias("unresolved"))


def tables_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot copies of the supplied tables, two at a time; one of them fails by its filter, one finds no table."""
    root = scratch(spark, "copies")

    def copy(name: str):
        def job() -> int:
            source = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            return snapshot.copied(source, f"{root}/{name}", "recreate", "no_such_column = 1" if name == "part" else None).first().target_count

        return job

    out = parallel.run_all(spark, {n: copy(n) for n in (*TABLES, "no_such_table")})
    return out.select("name", "status", "rows", F.col("error").isNotNull().alias("told_why"))


def capture_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a capture, gathered while it wrote, and how many rows are there."""
    out = scratch(spark, "outbox")
    rows, seen = capture.observed(outbox(spark, sf_dir), F.col("id") % 11 == 0, F.col("id") % 7 == 0)
    rows.write.parquet(out)
    got = seen.get
    one = spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} long" for k in got))
    return one.crossJoin(spark.read.parquet(out).agg(F.count("*").alias("written")))  # a row each


def ddl_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would undo each schema change of the stream of row and schema changes."""
    found = logtext.ddl_events(staged(statements(spark, sf_dir), "statements").drop("table_name").withColumn("current_database", F.lit("shop")), parity=False)
    return snapshot.rollback_set(found).select("id", F.col("clause_no").cast("int").alias("clause_no"), "table_name", "object_type", "object_name", "undo")


def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplied tables as tables of a database of the session's catalog, listed with their columns and rows."""
    spark.sql("CREATE DATABASE IF NOT EXISTS rivulet_catalog")
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS rivulet_catalog.{name}")
        spark.sql(f"CREATE TABLE rivulet_catalog.{name} USING parquet LOCATION '{sf_dir}/{name}.parquet'")
    found = changes.catalog_tables(spark, "rivulet_catalog").select("table_name")
    counts = None
    for r in found.collect():  # a row for each table of the catalog
        own = spark.table(f"rivulet_catalog.{r.table_name}")
        one = own.agg(F.count("*").alias("rows")).select(F.lit(r.table_name).alias("table_name"), F.lit(len(own.columns)).cast("long").alias("columns"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts


QUERIES = {f.__name__: f for f in (log_statements, event_uids, nested_remap, tables_at_once, capture_observed, ddl_rollback, catalog_scan)}
_V5 = lambda name: f"""(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ('89ab')[(CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4) + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12)
    FROM (SELECT sha1(unhex('{text.URL_NAMESPACE}') || encode({name})) AS h))"""  # noqa: E731
_NAME = lambda n: f"(CASE WHEN {n} <= least(2 + version, 5) THEN 'name\\' || {n} ELSE 'UNKNOWN_COL' || {n} END)"
ORACLE_SQL = {
    "log_statements": f"""WITH {FEED}, s AS (SELECT id, CAST(floor(id / {STATEMENT_EVERY}) AS BIGINT) AS n, log_pos FROM feed WHERE id % {STATEMENT_EVERY} = 0)
        SELECT id * 16 + 2 AS line_no, 0 AS clause_no, 'row' AS family, database_name, table_name, op, '' AS object_name, log_pos FROM feed
        UNION ALL SELECT id * 16 + 12, 0, 'ddl', 'shop' || n % 3, 'accounts' || n, 'create', 'accounts' || n, log_pos FROM s WHERE n % 4 = 0
        UNION ALL SELECT id * 16 + 12, 0, 'ddl', 'shop' || n % 3, 'accounts', 'alter', 'c' || n, log_pos FROM s WHERE n % 4 <> 0
        UNION ALL SELECT id * 16 + 12, 1, 'ddl', 'shop' || n % 3, 'accounts', 'drop', 'd' || n, log_pos FROM s WHERE n % 4 <> 0""",
    "event_uids": f"""WITH {CAPTURED}, r AS (SELECT *, CAST(floor(id % 10000000 / 100) AS BIGINT) AS batch FROM captured)
        SELECT {_V5("'svc|' || log_file || '|' || log_pos")} AS event_uid, {_V5("'batch|' || batch")} AS batch_uid, min(id) AS id, sum(CASE WHEN batch % 5 = 0 THEN 2 ELSE 1 END)::BIGINT AS sent FROM r GROUP BY 1, 2""",
    "nested_remap": f"""WITH v AS (SELECT event_id AS id, event_id % 6 AS d, json_extract_string(props, '$.k') AS k, count(*) FILTER (WHERE event_id % {COLUMN_EVERY} = 0) OVER (ORDER BY event_id) AS version FROM events)
        SELECT id, '{{"deep":{{"deeper":{{"' || replace({_NAME("d")}, '\\', '\\\\') || '":null}}}},"list":[{{"' || replace({_NAME(1)}, '\\', '\\\\') || '":[{{"' || replace({_NAME(2)}, '\\', '\\\\') || '":"x,\\"UNKNOWN_COL1\\":"}},' || k || ']}},"UNKNOWN_COL0"],"' || replace({_NAME(0)}, '\\', '\\\\') || '":' || id || '}}' AS image,
            d > least(2 + version, 5) AS unresolved FROM v""",
    "tables_at_once": " UNION ALL ".join(f"SELECT '{n}' AS name, '{'failed' if n == 'part' else 'success'}' AS status, {'NULL::BIGINT' if n == 'part' else 'count(*)'} AS rows, {'true' if n == 'part' else 'false'} AS told_why" + ("" if n == "part" else f" FROM {n}") for n in TABLES) + " UNION ALL SELECT 'no_such_table', 'failed', NULL, true",
    "capture_observed": f"""WITH {OUTBOX} SELECT count(*) AS scanned, count(*) FILTER (WHERE id % 11 = 0) AS hard_skipped, count(*) FILTER (WHERE id % 11 <> 0 AND id % 7 = 0) AS rule_skipped, count(*) FILTER (WHERE id % 11 <> 0 AND id % 7 <> 0) AS captured,
        count(*) FILTER (WHERE id % 11 <> 0 AND id % 7 <> 0 AND event_family = 'dml') AS captured_dml, count(*) FILTER (WHERE id % 11 <> 0 AND id % 7 <> 0 AND event_family = 'ddl') AS captured_ddl, count(*) FILTER (WHERE id % 11 <> 0 AND id % 7 <> 0) AS written FROM outbox""",
    "ddl_rollback": f"""WITH d AS (SELECT event_id AS id, 't' || user_id % 5 AS table_name, CAST(floor(event_id / {EVERY}) AS BIGINT) AS n FROM events WHERE event_id % {EVERY} = {EVERY - 1})
        SELECT id, 0 AS clause_no, table_name, 'column' AS object_type, 'c' || (n + CASE n % 5 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 0 END) % 4 AS object_name, CASE WHEN n % 5 = 1 THEN 'impossible' ELSE 'review' END AS undo FROM d WHERE n % 5 < 3 OR (n % 5 = 3 AND n % 4 <> 3)
        UNION ALL SELECT id, 1, table_name, 'column', 'c' || (n + 2) % 4, 'impossible' FROM d WHERE n % 5 = 2
        UNION ALL SELECT id, 0, table_name, 'table', table_name, 'impossible' FROM d WHERE n % 5 = 3 AND n % 4 = 3
        UNION ALL SELECT id, 0, table_name, 'table', table_name, 'drop' FROM d WHERE n % 5 = 4 AND n % 3 = 1
        UNION ALL SELECT id, 0, table_name, 'index', 'ix', 'impossible' FROM d WHERE n % 5 = 4 AND n % 3 <> 1""",
    "catalog_scan": " UNION ALL ".join(f"SELECT '{n}' AS table_name, (SELECT count(*) FROM (DESCRIBE {n})) AS columns, (SELECT count(*) FROM {n}) AS rows" for n in TABLES),
}
