"""What a run's counts mean: status and return code of captures and of transport actions; repair plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons for which a capture stops at a limit.
AT_LIMIT = ("capture_limit_reached", "max_scanned_events_reached", "scan_window_limit_reached")


def capture_outcome(initialized: Column, stop_reason: Column, captured: Column, skipped: Column, ok: Column) -> Column:
    """struct(status, code)."""
    out = lambda status, code: F.struct(F.lit(status).alias("status"), F.lit(code).alias("code"))
    reason = F.lower(F.trim(F.coalesce(stop_reason, F.lit(""))))
    limited = reason.isin(*AT_LIMIT)
    return (
        F.when(initialized, out("success", "CAPTURE_INIT_ONLY"))
        .when(reason == "no_events_available", out("success", "CAPTURE_NO_EVENTS"))
        .when((captured > 0) & (skipped > 0), out("warning", "CAPTURE_WARNING"))
        .when((captured > 0) & limited, out("success", "CAPTURE_OK_PARTIAL"))
        .when(captured > 0, out("success", "CAPTURE_OK"))
        .when(skipped > 0, out("warning", "CAPTURE_WARNING_SKIPPED_ONLY"))
        .when(limited, out("success", "CAPTURE_OK_PARTIAL"))
        .when(ok, out("success", "CAPTURE_OK"))
        .otherwise(out("error", "CAPTURE_ERROR"))
    )


def transport_outcome(action: Column, ok: Column, skipped: Column, batch_status: Column) -> Column:
    """struct(status, code)."""
    name = F.concat(F.lit("TRANSPORT_"), F.upper(action))
    refused = (action == "send_batch") & (F.lower(F.coalesce(batch_status, F.lit(""))) == "failed")
    status = F.when(~ok, "error").when(skipped | refused, "warning").otherwise("success")
    code = F.when(~ok, F.concat(name, F.lit("_ERROR"))).when(skipped, F.concat(name, F.lit("_SKIPPED"))).when(refused, "TRANSPORT_SEND_BATCH_FAILED_ACCEPTED").otherwise(F.concat(name, F.lit("_OK")))
    return F.struct(status.alias("status"), code.alias("code"))


def repair_plan(statuses: DataFrame) -> DataFrame:
    """(model, missing_fields, missing_alterations, missing_indexes, can_fake): a migration may be recorded as applied
    where all its fields and alterations are in place; tables and indexes do not stand against it."""
    n = lambda kind: F.count_if((F.col("op_type") == kind) & (F.col("status") == "missing"))
    out = statuses.groupBy("model").agg(n("AddField").alias("missing_fields"), n("AlterField").alias("missing_alterations"), n("AddIndex").alias("missing_indexes"))
    return out.withColumn("can_fake", (F.col("missing_fields") == 0) & (F.col("missing_alterations") == 0))
