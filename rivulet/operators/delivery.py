"""Receipt and application of batches end to end: checksum gate, idempotent inbox, strict apply, acknowledgement.

Each step is a DataFrame of the step before, so one plan covers a batch from the wire to what the source is told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.operators.apply import current_state
from rivulet.operators.ordered import carried
from rivulet.operators.transport import MAX_RETRIES, batch_rollup, checksum_ok, receive
from rivulet.session import staged

#: What a source is told of a batch, by what became of its changes.
CALLBACKS = {"applied": "applied", "partial": "partial", "failed": "failed"}
#: Reasons for which an apply loop or a capture stops.
STOPPED = ("paused", "stopped")


def payload(events: DataFrame, by: str = "batch_id", order: str = "id") -> DataFrame:
    """(by, payload, checksum, raw_bytes, event_count) of the changes of each batch; a batch holds few."""
    line = F.to_json(F.struct(*events.columns))
    rows = events.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return rows.select(by, text.alias("payload"), F.sha2(text, 256).alias("checksum"), F.octet_length(text).cast("long").alias("raw_bytes"), F.size("l").cast("long").alias("event_count"))


def gated(batches: DataFrame) -> DataFrame:
    """batches (payload, checksum) with accepted: the payload has the checksum that was sent with it."""
    return batches.withColumn("accepted", F.coalesce(checksum_ok(batches), F.lit(False)))


def unpacked(batches: DataFrame, schema, by: str = "batch_id") -> DataFrame:
    """A row for each change of the accepted batches."""
    line = F.explode(F.split("payload", "\n"))
    rows = batches.where("accepted and payload <> ''").select(F.col(by).alias("_batch"), line.alias("line"))
    return rows.select("_batch", F.from_json("line", schema).alias("e")).select(F.col("_batch").alias(by), *(f"e.{f.name}" for f in schema if f.name != by))


def applied_batch(target: DataFrame, inbox: DataFrame, key: str, order: str = "id", op: str = "op", repair: bool = False, missing_fails: bool = False) -> DataFrame:
    """inbox with status and last_error after an apply against target (key, ...), change by change of a key in order.

    Whether a key is there tells the last insert or delete of it before, else the target; updates leave that as it is,
    whether they hit a row or not. An insert of a key that is there fails as duplicate_key. An update or delete of one that
    is not changes nothing: it counts as applied (nothing_there), or with missing_fails fails as no_row. repair: such
    inserts become updates and such updates become inserts (both apply); a delete of nothing is done already.

    A key's history is carried through blocks, so a key that holds much of the inbox is not one task's. Blocks are counted,
    sampled and dealt, so the join that they are made of is written first.
    """
    known = staged(inbox.join(target.select(key, F.lit(True).alias("_known")).distinct(), key, "left"), "known")
    makes = F.when(F.col(op) == "insert", F.lit(True)).when(F.col(op) == "delete", F.lit(False))
    if repair:  # an update of what is not there inserts it
        makes = F.when(F.col(op) != "delete", F.lit(True)).otherwise(F.lit(False))
    known = carried(known, makes, order, "_before", (key,), inclusive=False)
    there = F.coalesce("_before", "_known", F.lit(False))
    twice, none = (F.col(op) == "insert") & there, (F.col(op) != "insert") & ~there
    if repair:
        done = F.when(twice, "repaired_as_update").when(none & (F.col(op) == "update"), "repaired_as_insert").when(none, "nothing_to_delete")
        return known.withColumn("last_error", done).withColumn("status", F.lit("applied")).drop("_known", "_before")
    error = F.when(twice, "duplicate_key").when(none, "no_row" if missing_fails else "nothing_there")
    fails = twice | none if missing_fails else twice
    return known.withColumn("last_error", error).withColumn("status", F.when(fails, "failed").otherwise("applied")).drop("_known", "_before")


def acknowledged(batches: DataFrame, inbox: DataFrame, by: str = "batch_id") -> DataFrame:
    """What the source is told of each batch: refused (checksum), received (none of it is final), applied, partial or
    failed, with the counts."""
    counts = batch_rollup(inbox, [by]).select(F.col(by), "total", "applied", "bad", "final_status")
    told = F.when(~F.col("accepted"), "refused").when(F.coalesce("final_status", F.lit("")) == "", "received").otherwise(F.col("final_status"))
    rows = batches.join(counts, by, "left")
    return rows.select(by, told.alias("callback"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "applied", "bad")))


def after_callback(batches: DataFrame, callbacks: DataFrame, by: str = "batch_id") -> DataFrame:
    """Status of the source's batches once told: acked when all of it was applied, failed when refused or failed, else
    as before."""
    rows = batches.join(callbacks.select(by, "callback"), by, "left")
    status = F.when(F.col("callback") == "applied", "acked").when(F.col("callback").isin("failed", "refused"), "failed").otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("callback")


def stop_reason(captured: Column, scanned: Column, bytes_read: Column, control: Column, most_captured: int, most_scanned: int, most_bytes: int, scope_end: Column) -> Column:
    """Why a capture stops: what it was told first, then limits, then the end of what there is; null: it goes on."""
    return (
        F.when(control.isin(*STOPPED), control)
        .when(captured >= most_captured, "capture_limit_reached")
        .when(scanned >= most_scanned, "max_scanned_events_reached")
        .when(bytes_read >= most_bytes, "scan_window_limit_reached")
        .when(scope_end & (scanned == 0), "no_events_available")
        .when(scope_end, "end_of_log")
    )


__all__ = ["CALLBACKS", "MAX_RETRIES", "acknowledged", "after_callback", "applied_batch", "current_state", "gated", "payload", "receive", "stop_reason", "unpacked"]
