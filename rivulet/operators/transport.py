"""Shipping of changes: order, batches, wire form, receipt, states after delivery, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.ordered import numbered

BATCH_LIMIT, MAX_RETRIES = 100, 5
OPEN, FINAL_BAD = ("received", "queued", "applying"), ("failed", "dead")
#: Shipping priority by kind of change.
PRIORITIES = {"database": 10, "table": 20, "column": 30, "index": 30}
OTHER_DDL, DML = 40, 100
#: Fields of a change on the wire, and what stands for a null.
WIRE = {
    "id": 0, "engine": "", "event_family": "dml", "database_name": "", "table_name": "", "operation": "", "object_type": "", "ddl_action": "", "object_name": "", "parent_object_name": "",
    "raw_sql": "", "event_uid": "", "transaction_id": "", "log_file": "", "log_pos": 0,
}


def priority(family: str = "event_family", kind: str = "object_type") -> Column:
    out = F.when(F.lower(family) != "ddl", DML)
    for name, rank in PRIORITIES.items():
        out = out.when(F.lower(kind) == name, rank)
    return out.otherwise(OTHER_DDL)


def transport_order(events: DataFrame, limit: int = BATCH_LIMIT, by: str = "service_id") -> DataFrame:
    """The next batch of each service with its order: of the lowest 10 * limit pending ids the limit first by (priority,
    id). Row-number limits are applied in the tasks before the shuffle."""
    pending = events.where(F.col("status") == "pending").withColumn("priority", priority())
    pool = pending.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("id"))).where(F.col("_n") <= 10 * limit)
    order = F.row_number().over(Window.partitionBy(by).orderBy("priority", "id"))
    return pool.withColumn("transport_order", order).where(F.col("transport_order") <= limit).drop("_n")


def wire(events: DataFrame) -> Column:
    """The change as a struct without nulls; fields that events lacks carry their defaults."""
    have = set(events.columns)
    return F.struct(*((F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)).alias(c) for c, d in WIRE.items()))


def batches(events: DataFrame, limit: int = BATCH_LIMIT, by: str = "service_id") -> DataFrame:
    """All pending changes as batches of limit consecutive ones of a service, with explicit membership.

    The checksum is the SHA-256 of the members' canonical lines; a batch holds at most limit of them.
    """
    rows = numbered(events.where(F.col("status") == "pending"), "id", "_n", (by,))
    rows = rows.withColumn("batch_no", F.floor((F.col("_n") - 1) / limit))
    line = F.concat_ws("|", "id", "op", F.coalesce(F.col("pk").cast("string"), F.lit("")), "log_file", "log_pos")
    lines = F.array_sort(F.collect_list(F.struct("id", line.alias("line"))))
    grouped = rows.groupBy(by, "batch_no").agg(F.count("*").alias("event_count"), F.min("id").alias("first_event_id"), F.max("id").alias("last_event_id"), lines.alias("_lines"))
    text = F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")
    return grouped.select(by, "batch_no", "event_count", "first_event_id", "last_event_id", F.transform("_lines", lambda x: x["id"]).alias("event_ids"), F.sha2(text, 256).alias("checksum"))


def checksum_ok(batch: DataFrame, payload: str = "payload", checksum: str = "checksum") -> Column:
    return F.sha2(F.col(payload), 256) == F.col(checksum)


def receive(incoming: DataFrame, known: DataFrame, uid: str = "event_uid", service: str = "service_id", order: str = "id") -> DataFrame:
    """The incoming changes that are new by (service, uid), the first of repeats; those with a blank uid are always new."""
    blank = F.coalesce(F.trim(uid), F.lit("")) == ""
    named = incoming.where(~blank)
    first = named.groupBy(service, uid).agg(F.min_by(F.struct(*named.columns), order).alias("_row")).select("_row.*")
    fresh = first.join(known.where(~blank).select(service, uid).distinct(), [service, uid], "left_anti")
    return fresh.select(*incoming.columns).unionByName(incoming.where(blank))


def inbox_row(raw: DataFrame, engine: str) -> DataFrame:
    """Defaults of a received change: engine falls back to the service's, family to dml."""
    filled = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)).alias(c)
    rest = [c for c in raw.columns if c not in ("engine", "event_family")]
    return raw.select(*rest, filled("engine", engine), filled("event_family", "dml"))


def batch_rollup(inbox: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """Counts and final_status of each batch: applied, partial, failed, or empty while it is not final."""
    is_ = lambda *names: F.count_if(F.col(status).isin(*names))
    grouped = inbox.groupBy(*by).agg(F.count("*").alias("total"), is_("applied").alias("applied"), is_(*FINAL_BAD).alias("bad"), is_(*OPEN).alias("open"))
    final = F.when(F.col("applied") == F.col("total"), "applied").when((F.col("bad") > 0) & (F.col("applied") > 0), "partial").when((F.col("bad") > 0) & (F.col("open") == 0), "failed").otherwise("")
    return grouped.withColumn("final_status", final)


def batch_snapshot(batches_: DataFrame, events: DataFrame, by: str = "service_id", batch: str = "batch_id") -> DataFrame:
    """Counts by status of the changes whose ids lie between a batch's first and last id, of its service.

    The range join is an equality join on id blocks of `width` that a batch touches; then the range is checked.
    """
    width = 1000
    blocks = F.explode(F.sequence(F.floor(F.col("first_event_id") / width), F.floor(F.col("last_event_id") / width)))
    left = batches_.withColumn("_b", blocks)
    right = events.select(by, F.col("id").alias("_id"), F.col("status").alias("_s"), F.floor(F.col("id") / width).alias("_b"))
    both = left.join(right, [by, "_b"]).where("_id between first_event_id and last_event_id")
    names = ("pending", "batched", "sent", "acked", "applied", "failed", "dead")
    counts = both.groupBy(batch).agg(F.count("*").alias("total_count"), *(F.count_if(F.col("_s") == n).alias(f"{n}_count") for n in names))
    keep = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total_count", *(f"{n}_count" for n in names))]
    return batches_.join(counts, batch, "left").select(*batches_.columns, *keep)


def wait_ack(snapshot: DataFrame, status: str = "status") -> DataFrame:
    """return_code of a sent batch, by what became of its changes."""
    c = lambda name: F.col(f"{name}_count")
    bad, some = c("failed") + c("dead"), c("total") > 0
    code = (
        F.when(some & (c("applied") == c("total")), "WAIT_ACK_REMOTE_APPLIED")
        .when(some & (bad == c("total")), "WAIT_ACK_REMOTE_FAILED")
        .when(some & (c("applied") > 0) & (bad > 0), "WAIT_ACK_REMOTE_PARTIAL")
        .when((F.col(status) == "acked") | (c("acked") > 0), "WAIT_ACK_ACKED_PENDING_APPLY")
        .when((F.col(status) == "sent") | (c("sent") > 0), "WAIT_ACK_PENDING_REMOTE_CALLBACK")
        .when(F.col(status) == "failed", "WAIT_ACK_LOCAL_BATCH_FAILED")
        .otherwise("WAIT_ACK_UNEXPECTED_STATE")
    )
    return snapshot.withColumn("return_code", code)


def after_failure(retries: Column, most: int = MAX_RETRIES) -> tuple[Column, Column]:
    """retry_count and status after one more failure: a dead letter at `most`."""
    n = F.coalesce(retries, F.lit(0)) + 1
    return n, F.when(n >= most, "dead").otherwise("failed")


def requeued(events: DataFrame, failed_batches: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Changes of failed batches are pending again unless they were acked, applied or are dead."""
    hit = failed_batches.select(batch, F.lit(True).alias("_hit")).distinct()
    again = F.col("_hit") & ~F.col("status").isin("acked", "applied", "dead")
    return events.join(hit, batch, "left").withColumn("status", F.when(again, "pending").otherwise(F.col("status"))).drop("_hit")


def recovery_guard(batch: DataFrame, now: str, enabled: bool = True, most: int = 3, cooldown: int = 30) -> DataFrame:
    """reason_code of an automatic resumption of a failed batch, and the seconds left of its cooldown."""
    at = F.coalesce("sent_at", "acked_at", "built_at", "created_at")
    elapsed = F.timestamp_diff("SECOND", at, F.lit(now).cast("timestamp_ntz"))
    code = (
        F.when(F.lower("status") != "failed", "NOT_FAILED")
        .when(F.lit(not enabled), "SOURCE_RETRY_DISABLED")
        .when(F.coalesce("retry_count", F.lit(0)) >= most, "SOURCE_RETRY_MAX_ATTEMPTS_REACHED")
        .when(elapsed < cooldown, "SOURCE_RETRY_COOLDOWN_ACTIVE")
        .otherwise("SOURCE_RETRY_ALLOWED")
    )
    left = F.when(F.col("reason_code") == "SOURCE_RETRY_COOLDOWN_ACTIVE", F.greatest(cooldown - elapsed, F.lit(0))).otherwise(0)
    return batch.withColumn("reason_code", code).withColumn("remaining_seconds", left.cast("long"))


def reconciled(log: DataFrame, outbox: DataFrame, signature: str = "signature") -> DataFrame:
    """status of each change of the log: ignored, or by how often the outbox has its signature."""
    found = outbox.groupBy(signature).agg(F.count("*").alias("_n"), F.min("id").alias("_first"))
    joined = log.join(found, signature, "left")
    n = F.when(F.col("ignored"), 0).otherwise(F.coalesce("_n", F.lit(0)))
    status = F.when(F.col("ignored"), "ignored").when(n == 0, "not_captured").when(n == 1, "captured").otherwise("duplicate")
    out = joined.withColumn("status", status).withColumn("outbound_match_count", n.cast("long"))
    return out.withColumn("first_outbound_event_id", F.when(n > 0, F.col("_first"))).drop("_n", "_first")
