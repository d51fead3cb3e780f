"""Changes as JSON: messages of a logical replication slot, and row events with several rows each; catalogs as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROW = "map<string,string>"
_SLOT = f"struct<lsn:string,change:array<struct<kind:string,table:string,oldkeys:{_ROW},keys:{_ROW},newtuple:{_ROW}>>>"
_EVENT = f"struct<type:string,database:string,table:string,rows:array<struct<values:{_ROW},before_values:{_ROW},after_values:{_ROW}>>>"


def slot_changes(messages: DataFrame, database: str, column: str = "message") -> DataFrame:
    """A row for each change of the messages: operation, table, position as text, key, before and after (maps)."""
    none = F.create_map().cast(_ROW)
    rows = messages.select(*(c for c in messages.columns if c != column), F.from_json(column, _SLOT).alias("m"))
    rows = rows.select("*", F.posexplode("m.change").alias("change_no", "c"))
    full = lambda *names: F.coalesce(*(F.when(F.size(F.col(f"c.{n}")) > 0, F.col(f"c.{n}")) for n in names), none)
    return rows.select(
        *(c for c in messages.columns if c != column),
        "change_no",
        F.lit("postgresql").alias("engine"),
        F.lit(database).alias("database_name"),
        F.coalesce("c.table", F.lit("")).alias("table_name"),
        F.lower(F.coalesce("c.kind", F.lit(""))).alias("operation"),
        F.coalesce("m.lsn", F.lit("")).alias("log_pos"),
        full("oldkeys", "keys").alias("key"),
        full("oldkeys").alias("before"),
        full("newtuple").alias("after"),
    )


def row_changes(events: DataFrame, column: str = "event") -> DataFrame:
    """A row for each row of the events (WriteRowsEvent, UpdateRowsEvent, DeleteRowsEvent): op, before and after."""
    none = F.create_map().cast(_ROW)
    rows = events.select(*(c for c in events.columns if c != column), F.from_json(column, _EVENT).alias("e"))
    rows = rows.select("*", F.posexplode("e.rows").alias("row_no", "r"))
    op = F.when(F.col("e.type") == "WriteRowsEvent", "insert").when(F.col("e.type") == "UpdateRowsEvent", "update").when(F.col("e.type") == "DeleteRowsEvent", "delete")
    before = F.when(op == "update", F.col("r.before_values")).when(op == "delete", F.col("r.values"))
    after = F.when(op == "update", F.col("r.after_values")).when(op == "insert", F.col("r.values"))
    out = rows.select(*(c for c in events.columns if c != column), "row_no", op.alias("op"), F.col("e.database").alias("database_name"), F.col("e.table").alias("table_name"), F.coalesce(before, none).alias("before"), F.coalesce(after, none).alias("after"))
    return out.where("op is not null")


def columns_by_ordinal(spark: SparkSession, tables: dict[str, T.StructType]) -> DataFrame:
    """(table_name, ordinal, column_name, kind) of the tables' columns, from 1."""
    rows = [(t, i, f.name, f.dataType.simpleString()) for t, s in sorted(tables.items()) for i, f in enumerate(s.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, kind string")


def catalog_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(database_name, table_name) of the session's catalog, in order."""
    rows = [(d.name, t.name) for d in spark.catalog.listDatabases() if database in (None, d.name) for t in spark.catalog.listTables(d.name) if not t.isTemporary]
    return spark.createDataFrame(sorted(rows), "database_name string, table_name string")
