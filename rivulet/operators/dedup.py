"""Exact duplicates and compaction of each primary key's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def business_signature(*columns: str, position: tuple[str, ...] = ()) -> Column:
    """SHA-256 of the columns' texts, nulls marked; position columns make re-captured changes differ (safe mode)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in (*columns, *position)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def exact_duplicates(events: DataFrame, signature: Column, id_col: str = "id") -> DataFrame:
    """events with signature and survivor_id (the least id of its signature).

    The least ids come from an aggregation with map-side combining and return by an equality join, which adaptive
    execution splits where one signature holds very many events; a window would put them all into one task. The least ids
    are as many as there are signatures, so they are merged: a planner that takes them for small (it goes by the size of
    compressed files) would send them all through the driver as a broadcast.
    """
    own = events.withColumn("signature", signature)
    least = own.groupBy("signature").agg(F.min(id_col).alias("survivor_id")).hint("merge")
    return own.join(least, "signature").select(*events.columns, "signature", "survivor_id")


def key_histories(events: DataFrame, key: str = "pk", id_col: str = "id", op: str = "op") -> DataFrame:
    """One row per key: outcome of its history and the ids that survive, by one aggregation.

    single: keep it. A: insert ... delete: nothing survives. B: insert and then only inserts and updates: the first and
    the last update. C: only updates, D: updates and deletes that end with a delete, E: any other: the last.
    """
    is_ = lambda name: F.count_if(F.lower(op) == name)
    grouped = events.groupBy(key).agg(
        F.count("*").alias("n"),
        F.min_by(F.lower(op), id_col).alias("first_op"),
        F.max_by(F.lower(op), id_col).alias("last_op"),
        F.min(id_col).alias("first_id"),
        F.max(id_col).alias("last_id"),
        F.max(F.when(F.lower(op) == "update", F.col(id_col))).alias("last_update_id"),
        is_("insert").alias("inserts"),
        is_("update").alias("updates"),
        is_("delete").alias("deletes"),
    )
    n, first, last = F.col("n"), F.col("first_op"), F.col("last_op")
    outcome = (
        F.when(n == 1, "single")
        .when((first == "insert") & (last == "delete"), "A")
        .when((first == "insert") & (F.col("inserts") + F.col("updates") == n), "B")
        .when(F.col("updates") == n, "C")
        .when((last == "delete") & (F.col("updates") + F.col("deletes") == n), "D")
        .otherwise("E")
    )
    out = grouped.withColumn("outcome", outcome)
    first_kept = F.when(F.col("outcome").isin("single", "B"), F.col("first_id"))
    last_kept = F.when(F.col("outcome") == "B", F.col("last_update_id")).when(F.col("outcome") != "A", F.col("last_id"))
    survivor = F.when(F.col("outcome") == "A", 0).otherwise(F.coalesce(last_kept, first_kept))
    return out.withColumn("first_kept", first_kept).withColumn("last_kept", last_kept).withColumn("survivor_event_id", survivor.cast("long"))


def decisions(events: DataFrame, signature: Column, key: str = "pk", id_col: str = "id", op: str = "op") -> DataFrame:
    """decision_type and survivor_event_id of every event.

    Exact duplicates go first; only their survivors count for a key's history. A null key passes through as survivor.
    """
    marked = exact_duplicates(events, signature, id_col)
    alive = marked.where((F.col(id_col) == F.col("survivor_id")) & F.col(key).isNotNull())
    kept = key_histories(alive, key, id_col, op).select(key, "outcome", "first_kept", "last_kept", "survivor_event_id")
    joined = marked.join(kept, key, "left")
    survives = F.col(key).isNull() | F.coalesce((F.col(id_col) == F.col("first_kept")) | (F.col(id_col) == F.col("last_kept")), F.col(id_col) == F.col("last_kept"), F.lit(False))
    decision = (
        F.when(F.col(id_col) != F.col("survivor_id"), "exact_duplicate")
        .when(F.col("outcome") == "A", "neutralized")
        .when(survives, "survivor")
        .otherwise("collapsed")
    )
    return joined.withColumn("decision_type", decision).withColumn("survivor_event_id", F.coalesce("survivor_event_id", F.lit(0).cast("long")))


def undone(decided: DataFrame, status: str = "status") -> DataFrame:
    """The statuses after an undo: what deduplication had declared dead is pending again."""
    dead = F.col("decision_type").isin("exact_duplicate", "neutralized", "collapsed")
    return decided.withColumn("status", F.when(dead, "pending").otherwise(F.col(status)))
