"""Snapshots: counts, checksums, plans, replays, selections, and catalog differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.ordered import execution_orders
from rivulet.operators.rules import INTERNAL_PREFIX, csv_names, name_filter


def row_text(*columns: str) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns))


def checksum(df: DataFrame, *columns: str) -> DataFrame:
    """row_count and checksum of all rows, whatever their order: sums of four 48-bit parts of each row's SHA-256.

    One pass with map-side sums; no sort and no collected list. Repeated rows count each.
    """
    digest = F.sha2(row_text(*columns), 256)
    part = lambda i: F.coalesce(F.sum(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    return df.agg(F.count("*").alias("row_count"), F.concat_ws(":", *map(part, range(4))).alias("checksum"))


def snapshot_verdict(source: DataFrame, target: DataFrame, *columns: str) -> DataFrame:
    """Counts and checksums of both, and whether they agree."""
    a = checksum(source, *columns).select(F.col("row_count").alias("source_count"), F.col("checksum").alias("source_checksum"))
    b = checksum(target, *columns).select(F.col("row_count").alias("target_count"), F.col("checksum").alias("target_checksum"))
    both = a.join(b, F.lit(True))  # one row each
    return both.withColumn("verified", (F.col("source_count") == F.col("target_count")) & (F.col("source_checksum") == F.col("target_checksum")))


def differing_keys(source: DataFrame, target: DataFrame, key: str, *columns: str) -> DataFrame:
    """Keys that only one side has or whose rows differ."""
    digest = lambda df, name: df.select(key, F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns)).alias(name))
    both = digest(source, "_a").join(digest(target, "_b"), key, "full")
    kind = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") != F.col("_b"), "changed")
    return both.select(key, kind.alias("difference")).where("difference is not null")


def work_items(plans: DataFrame, selections: DataFrame, catalog: DataFrame) -> DataFrame:
    """(plan_id, source, database_name, table_name, recreate_table, item_no): the enabled selections of a plan, or else
    the catalog's tables that its filters let through, at most table_limit of each database."""
    enabled = selections.where("is_enabled")
    picked = enabled.join(plans.select(F.col("id").alias("plan_id"), "recreate_table"), "plan_id").withColumn("source", F.lit("plan_selection"))
    order = F.row_number().over(Window.partitionBy("plan_id").orderBy("execution_order", "id"))
    picked = picked.select("plan_id", "source", "database_name", "table_name", "recreate_table", order.alias("item_no"))
    auto = plans.join(enabled.select(F.col("plan_id").alias("id")).distinct(), "id", "left_anti").withColumnRenamed("id", "plan_id")
    rows = auto.join(catalog.where("is_active").select("database_name", "table_name"), F.lit(True))  # plans times a catalog: both small
    own = F.col("source_database_name") != ""
    in_database = F.when(own, F.col("database_name") == F.col("source_database_name")).otherwise(name_filter("database_name", F.col("database_include_csv"), F.col("database_exclude_csv"), F.col("database_like_pattern")))
    include = F.when(F.col("scope_mode") == "tables", F.col("include_tables_csv")).otherwise("")
    in_tables = name_filter("table_name", include, F.col("exclude_tables_csv"), F.col("like_filter"))
    internal = F.col("auto_exclude_internal") & F.startswith("table_name", F.lit(INTERNAL_PREFIX))
    rows = rows.where(in_database & in_tables & ~internal)
    n = F.row_number().over(Window.partitionBy("plan_id", "database_name").orderBy("table_name"))
    rows = rows.withColumn("_n", n).where((F.col("table_limit") <= 0) | (F.col("_n") <= F.col("table_limit")))
    order = F.row_number().over(Window.partitionBy("plan_id").orderBy("database_name", "table_name"))
    rows = rows.select("plan_id", F.lit("plan_auto").alias("source"), "database_name", "table_name", "recreate_table", order.alias("item_no"))
    return picked.unionByName(rows).withColumn("item_no", F.col("item_no").cast("long"))


def replay_items(executions: DataFrame, items: DataFrame, failed_execution: bool = False, failed_items: bool = False) -> DataFrame:
    """Items of each plan's last (last failed) execution, all or the failed ones."""
    chosen = executions.where("status = 'failed'") if failed_execution else executions
    last = chosen.groupBy("plan_id").agg(F.max("id").alias("execution_id"))
    rows = items.join(last, "execution_id")
    return rows.where("status = 'failed'") if failed_items else rows


def execution_rollup(executions: DataFrame, items: DataFrame) -> DataFrame:
    """Totals of each execution."""
    grouped = items.groupBy("execution_id").agg(
        F.count("*").alias("tables"),
        F.countDistinct("database_name").alias("databases"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("rows_copied").alias("rows_copied"),
        F.round(F.sum("duration"), 3).alias("duration"),
        F.round(F.sum("rows_copied") / F.sum("duration"), 2).alias("rows_per_second"),
    )
    return executions.join(grouped, executions["id"] == grouped["execution_id"]).drop("id")


def synced_selections(candidates: DataFrame, existing: DataFrame, reset: bool = False) -> DataFrame:
    """What a plan's selections become: (database_name, table_name, is_enabled, execution_order, change).

    Candidates are created or kept enabled, with their order unless reset; the others are disabled.
    """
    keys = ["database_name", "table_name"]
    known = existing.select(*keys, "execution_order", F.col("is_enabled").alias("was_enabled"))
    rows = execution_orders(candidates, known, keys, keys, reset).join(known.select(*keys, "was_enabled"), keys, "left")
    rows = rows.select(*keys, F.lit(True).alias("is_enabled"), "execution_order", F.when(F.col("was_enabled").isNull(), "created").otherwise("updated").alias("change"))
    gone = known.join(candidates.select(*keys), keys, "left_anti")
    change = F.when(F.col("was_enabled"), "disabled").otherwise("unchanged")
    return rows.unionByName(gone.select(*keys, F.lit(False).alias("is_enabled"), F.col("execution_order").cast("long").alias("execution_order"), change.alias("change")))


def catalog_diff(discovered: DataFrame, known: DataFrame) -> DataFrame:
    """(database_name, table_name, action): create, activate, keep or deactivate."""
    keys = ["database_name", "table_name"]
    both = discovered.select(*keys, F.lit(True).alias("_found")).join(known.select(*keys, "is_active"), keys, "full")
    action = (
        F.when(F.col("is_active").isNull(), "create")
        .when(F.col("_found") & ~F.col("is_active"), "activate")
        .when(F.col("_found"), "keep")
        .when(F.col("is_active"), "deactivate")
        .otherwise("inactive")
    )
    return both.select(*keys, action.alias("action"))
