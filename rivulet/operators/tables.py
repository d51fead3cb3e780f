"""Writes to tables that know no MERGE, as rewrites: upsert, deletion with its dependants, status changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old with the rows of new in place of those with the same keys; of repeats in new the last by order."""
    if order:
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), order).alias("_row")).select("_row.*")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def without(rows: DataFrame, gone: DataFrame, key: str, dependants: dict[str, tuple[DataFrame, str]] | None = None) -> dict[str, DataFrame]:
    """What deletion leaves: rows, and each dependant (name: table, its foreign key) without the children of what goes."""
    ids = gone.select(key).distinct()
    out = {"rows": rows.join(ids, key, "left_anti")}
    for name, (table, foreign) in (dependants or {}).items():
        out[name] = table.join(ids.withColumnRenamed(key, foreign), foreign, "left_anti")
    return out


def with_status(rows: DataFrame, chosen: Column, status: str, at: str | None = None, now: str | None = None) -> DataFrame:
    """rows with another status (and time in column at) where chosen holds."""
    out = rows.withColumn("status", F.when(chosen, status).otherwise(F.col("status")))
    return out.withColumn(at, F.when(chosen, F.lit(now).cast("timestamp_ntz")).otherwise(F.col(at))) if at else out


def in_flight(batches: DataFrame, by: str = "service_id") -> DataFrame:
    """(service, may_build, may_ship): a service with an open batch builds none; one with a batch under way ships none."""
    open_, under_way = F.col("status").isin("ready", "sent", "acked", "failed"), F.col("status").isin("sent", "acked")
    return batches.groupBy(by).agg((~F.bool_or(open_)).alias("may_build"), (~F.bool_or(under_way)).alias("may_ship"))


def resume_diagnosis(batches: DataFrame, snapshot: DataFrame, by: str = "service_id") -> DataFrame:
    """For each failed batch what resuming it would do: other open batches of its service block building; without events
    nothing is sent. Counts of the open batches come from one aggregation."""
    open_ = batches.where(F.col("status").isin("ready", "sent", "acked", "failed")).groupBy(by).agg(F.count("*").alias("_open"))
    rows = snapshot.where("status = 'failed'").join(open_, by)
    rows = rows.withColumn("open_batches", F.col("_open") - 1).withColumn("would_build", F.col("open_batches") == 0)
    again = F.when(F.col("failed_count") > 0, F.col("failed_count")).otherwise(F.col("total_count"))
    return rows.withColumn("would_send", F.col("would_build") & (again > 0)).drop("_open")
