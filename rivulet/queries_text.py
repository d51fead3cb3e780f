"""Queries on log text, literals, JSON and payload codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import codec, text
from rivulet.plans.catalog import DDL, SCALARS
from rivulet.plans.feed import FEED, change_feed, events
from rivulet.sources import logtext

FILES = 1000
#: The most lines that a written file of the log is planned for.
FILE_LINES = 1_000_000


def log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as the text of a row log: 16 line numbers for each change."""
    q = lambda c: F.coalesce(F.concat(F.lit("'"), F.col(c).cast("string"), F.lit("'")), F.lit("NULL"))
    image = lambda: [F.concat(F.lit("###   @1="), F.col("pk").cast("string")), F.concat(F.lit("###   @2="), q("k"), F.lit(" /* INT meta */")), F.concat(F.lit("###   @3="), F.col("value").cast("decimal(20,4)").cast("string"))]
    head = F.when(F.col("op") == "insert", "### INSERT INTO `shop`.`accounts`").when(F.col("op") == "delete", "### DELETE FROM `shop`.`accounts`").otherwise("### UPDATE `shop`.`accounts`")
    before = F.when(F.col("op") != "insert", F.array(F.lit("### WHERE"), *image())).otherwise(F.array().cast("array<string>"))
    after = F.when(F.col("op") != "delete", F.array(F.lit("### SET"), *image())).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array(F.concat(F.lit("# at "), F.col("log_pos").cast("string")), F.lit("#240101 server id 1"), head), before, after)
    rows = change_feed(spark, sf_dir).select("id", F.posexplode(every).alias("n", "line"))
    return rows.select((F.col("id") * 16 + F.col("n")).alias("line_no"), "line")


def written(log: DataFrame, out: str, least: int) -> None:
    """Write the log as text files that hold its lines in order: at least so many, and more for a longer log, since a file
    is one task's to sort."""
    files = least * max(1, -(-log.count() // (least * FILE_LINES)))
    log.repartitionByRange(files, "line_no").sortWithinPartitions("line_no").select("line").write.text(out)


def binlog_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = logtext.row_events(log_text(spark, sf_dir), FILES, {1: "id", 2: "k"})
    get = lambda side, key: F.try_element_at(F.col(side), F.lit(key)).alias(f"{side}_{key.lower()}")
    return found.select("event_no", "op", "database_name", "table_name", "file_index", "log_pos", get("before", "id"), get("before", "k"), get("after", "id"), get("after", "k"), get("after", "UNKNOWN_COL2"))


def ddl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logtext.ddl_events(DDL.of(spark, sf_dir)).withColumn("clause_no", F.col("clause_no").cast("int"))


def ddl_parse_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logtext.ddl_events(DDL.of(spark, sf_dir), parity=False).where("object_type = 'index'")
    return rows.select("id", "table_name", "ddl_action", "object_name")


def scalar_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    return SCALARS.of(spark, sf_dir).select("id", text.scalar_kind(raw).alias("kind"), text.scalar(raw).alias("value"))


def canonical_json_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.sha2(text.canonical_json(F.concat(F.lit('{ "z" : '), F.col("user_id").cast("string"), F.lit(', "a":'), F.get_json_object("props", "$.k"), F.lit("}"))), 256).alias("digest"))


def key_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    row = (
        F.when(i % 4 == 0, F.create_map(F.lit("name"), F.lit("x"), F.lit("id"), i.cast("string")))
        .when(i % 4 == 1, F.create_map(F.lit("user_id"), F.lit("1"), F.lit("acct_ID"), F.lit("2")))
        .when(i % 4 == 2, F.create_map(F.lit("b"), F.lit(None).cast("string"), F.lit("a"), F.lit("v")))
        .otherwise(F.create_map(F.lit("b"), F.lit(None).cast("string")))
    )
    return events(spark, sf_dir).select("event_id", text.first_key(row).alias("key_column"))


def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events(spark, sf_dir).select("event_id", "props")
    for name, args in {"plain": ("none", "none"), "zlib": ("zlib", "none"), "xor": ("zlib", "xor", "secret"), "aes": ("none", "aes", "0123456789abcdef")}.items():
        out = out.withColumn(name, codec.decoded(codec.encoded(F.col("props"), *args), *args) == F.col("props"))
    return out.drop("props")


QUERIES = {f.__name__: f for f in (binlog_parse, ddl_parse, ddl_parse_safe, scalar_decode, canonical_json_sha, key_heuristic, codec_roundtrip)}

_DDL_WANT = [
    (1, "shop", "", "database", "create", "shop", 0), (2, "shop", "", "database", "drop", "shop", 0), (3, "shop", "orders", "table", "create", "orders", 0), (4, "shop", "orders", "table", "create", "orders", 0),
    (6, "shop", "orders", "table", "drop", "orders", 0), (7, "shop", "orders", "table", "drop", "orders", 0), (8, "shop", "orders", "index", "create", "ix", 0), (9, "shop", "orders", "index", "drop", "ix", 0),
    (10, "shop", "orders", "column", "alter", "c", 0), (10, "shop", "orders", "column", "drop", "d", 1), (10, "shop", "orders", "column", "alter", "e", 2),
    (11, "shop", "orders", "column", "alter", "b", 0), (11, "shop", "orders", "column", "alter", "INDEX", 1), (11, "shop", "orders", "column", "drop", "primary", 2), (11, "shop", "orders", "column", "alter", "PRIMARY", 3),
    (12, "shop", "orders", "table", "alter", "orders", 0), (13, "shop", "orders", "table", "alter", "orders", 0), (13, "shop", "orders", "column", "alter", "f", 1), (16, "shop", "orders", "column", "alter", "UNIQUE", 0), (17, "shop", "orders", "index", "drop", "i", 0),
]
_SAFE_WANT = [(8, "create", "ix"), (9, "drop", "ix"), (11, "create", "ix"), (11, "drop", "PRIMARY"), (11, "create", "PRIMARY"), (16, "create", "uk"), (17, "drop", "i")]
_SCALAR_WANT = [(1, "null", None), (2, "null", None), (3, "string", "O'B"), (4, "string", "a\\b"), (5, "float", "1.5"), (6, "int", "0"), (7, "int", "1"), (8, "int", "-17"), (9, "raw", "abc"), (10, "string", "NULL"), (11, "string", ""), (12, "raw", "'"), (13, "int", "42"), (14, "raw", "1.2.3"), (15, "int", "9223372036854775807"), (16, "string", "'x'")]
_lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
_values = lambda rows: ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in rows)
_placed = lambda table, rows: [(table.place(r[0]), *r[1:]) for r in rows]
_TXT = "CASE WHEN op {cond} THEN {v} END"
ORACLE_SQL = {
    "binlog_parse": f"""WITH {FEED}, d AS (SELECT *, CASE WHEN log_pos < lag(log_pos) OVER (ORDER BY id) THEN 1 ELSE 0 END AS dropped FROM feed)
        SELECT row_number() OVER (ORDER BY id) AS event_no, op, database_name, table_name, CAST(least(sum(dropped) OVER (ORDER BY id), {FILES - 1}) AS BIGINT) AS file_index, log_pos,
            CASE WHEN op <> 'insert' THEN CAST(pk AS VARCHAR) END AS before_id, CASE WHEN op <> 'insert' THEN CAST(k AS VARCHAR) END AS before_k, CASE WHEN op <> 'delete' THEN CAST(pk AS VARCHAR) END AS after_id,
            CASE WHEN op <> 'delete' THEN CAST(k AS VARCHAR) END AS after_k, CASE WHEN op <> 'delete' THEN CAST(CAST(value AS DECIMAL(20,4)) AS VARCHAR) END AS after_unknown_col2 FROM d""",
    "ddl_parse": f"SELECT event_id AS id, database_name, table_name, object_type, ddl_action, object_name, CAST(clause_no AS INTEGER) AS clause_no FROM events JOIN (VALUES {_values(_placed(DDL, _DDL_WANT))}) AS v(place, database_name, table_name, object_type, ddl_action, object_name, clause_no) ON event_id % {len(DDL.rows)} = place",
    "ddl_parse_safe": f"SELECT event_id AS id, 'orders' AS table_name, ddl_action, object_name FROM events JOIN (VALUES {_values(_placed(DDL, _SAFE_WANT))}) AS v(place, ddl_action, object_name) ON event_id % {len(DDL.rows)} = place",
    "scalar_decode": f"SELECT event_id AS id, kind, v.value FROM events JOIN (VALUES {_values(_placed(SCALARS, _SCALAR_WANT))}) AS v(place, kind, value) ON event_id % {len(SCALARS.rows)} = place",
    "canonical_json_sha": """SELECT event_id, sha256('{"a":' || json_extract_string(props, '$.k') || ',"z":' || user_id || '}') AS digest FROM events""",
    "key_heuristic": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'acct_ID' WHEN 2 THEN 'a' END AS key_column FROM events",
    "codec_roundtrip": "SELECT event_id, true AS plain, true AS zlib, true AS xor, true AS aes FROM events",
}
