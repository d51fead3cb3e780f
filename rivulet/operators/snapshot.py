"""Sinks: snapshot copies, archives and logs by run, schema changes, reports, resets.

Tables are versioned (rivulet.operators.versioned): what a sink writes replaces or extends a table by one atomic switch, and
a run that is repeated after it was committed changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rivulet.operators import versioned

MODES = ("append", "truncate", "recreate")


def copied(source: DataFrame, target: str, mode: str = "append", like: str | None = None, dry_run: bool = False, run: str | None = None) -> DataFrame:
    """Copy the source into the versioned table at target and return one row: status, source_count, target_count.

    append keeps what is there; truncate replaces the rows and keeps the table's columns (others of the source are left
    out, missing ones are null); recreate takes the source's columns too. The source may be read from the target. like:
    only rows for which it holds. A dry run writes nothing and counts what it would copy. run: a copy of this id that was
    committed before is not made again (already_copied). The copy is counted against the source before the switch.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode '{mode}'")
    spark = source.sparkSession
    rows = source.where(like) if like else source
    if dry_run:
        return rows.agg(F.lit("dry_run").alias("status"), F.count("*").alias("source_count"), F.lit(0).cast("long").alias("target_count"))
    before = versioned.version(spark, target)
    done = bool(before and run in before.runs)
    want = rows.count()
    if not done:
        schema = before.struct if before and mode != "recreate" else rows.schema

        def check(written: DataFrame) -> None:
            if (got := written.count()) != want:
                raise ValueError(f"{got} of {want} rows were written to {target}")

        versioned.commit(rows.select(fitted(rows, schema)), target, run, "append" if mode == "append" else "replace", check)
    counted = versioned.read(spark, target).agg(F.count("*").alias("target_count"))
    return counted.select(F.lit("already_copied" if done else "copied").alias("status"), F.lit(want).cast("long").alias("source_count"), "target_count")


def fitted(rows: DataFrame, schema: StructType) -> list[Column]:
    """The columns of a table's schema, from rows that may lack some."""
    return [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]


def appended(rows: DataFrame, table: str, run: str) -> DataFrame:
    """Append the rows, with the column run, to the versioned table, which is created if it is not there, and read that run
    back. A run that is in the table already is only read."""
    versioned.commit(rows.withColumn("run", F.lit(run)), table, run, "append")
    return run_rows(rows.sparkSession, table, run)


def run_rows(spark: SparkSession, table: str, run: str) -> DataFrame:
    """The rows of one run of a table of appended()."""
    return versioned.read(spark, table).where(F.col("run") == run).drop("run")


def as_text(rows: DataFrame) -> DataFrame:
    """rows with maps, arrays and structs as JSON text, as archives and reports hold them."""
    nested = {n for n, t in rows.dtypes if t.startswith(("map", "array", "struct"))}
    return rows.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in rows.columns))


def report_lines(rows: DataFrame, title: Column) -> DataFrame:
    """(line) of each row: its title and then its columns in JSON, the form of JSON and text reports."""
    return rows.select(F.concat(title, F.lit(" "), F.to_json(F.struct(*as_text(rows).columns))).alias("line"))


def schema_after(tables: DataFrame, changes: DataFrame, order: str = "id") -> DataFrame:
    """(table_name, column_name) after schema changes are applied to the columns (table_name, column_name) of tables.

    changes: (order, clause_no, table_name, object_type, ddl_action, object_name). The last change of a table and column
    decides; a table that is created or dropped forgets the columns it had before. A dropped table has no columns, and
    changes of it fail, until it is created again. Index changes leave columns alone.
    """
    at = F.struct(F.col(order).cast("long").alias("order"), F.col("clause_no").cast("long").alias("clause_no"))
    whole = changes.where(F.col("object_type") == "table").where(F.col("ddl_action").isin("create", "drop"))
    whole = whole.groupBy("table_name").agg(F.max(at).alias("since"), F.max_by("ddl_action", at).alias("last_whole"))
    first = tables.select("table_name", "column_name", F.lit(None).cast("struct<order: bigint, clause_no: bigint>").alias("at"), F.lit("alter").alias("ddl_action"))
    own = changes.where("object_type = 'column'").select("table_name", F.col("object_name").alias("column_name"), at.alias("at"), "ddl_action")
    rows = first.unionByName(own).join(whole, "table_name", "left")
    rows = rows.where(F.col("since").isNull() | ((F.col("last_whole") == "create") & (F.col("at") > F.col("since"))))
    least = F.struct(F.lit(-1).cast("long").alias("order"), F.lit(-1).cast("long").alias("clause_no"))
    last = rows.groupBy("table_name", "column_name").agg(F.max_by("ddl_action", F.coalesce("at", least)).alias("action"))
    return last.where("action <> 'drop'").select("table_name", "column_name")


def rollback_set(changes: DataFrame, order: str = "id") -> DataFrame:
    """What undoes schema changes, the last first: a create by a drop; drops and alterations cannot be undone from the
    log alone and are marked so."""
    undo = F.when(F.col("ddl_action") == "create", "drop").when((F.col("ddl_action") == "alter") & (F.col("object_type") == "column"), "review")
    return changes.select(order, "clause_no", "table_name", "object_type", "object_name", F.coalesce(undo, F.lit("impossible")).alias("undo"))


def reset(tables: dict[str, DataFrame], service: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """tables without a service's rows in those named; other tables, services and rows of no service stay."""
    return {n: t.where(~F.col("service_id").eqNullSafe(service)) if n in names else t for n, t in tables.items()}
