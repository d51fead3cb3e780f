"""Archival: which rows may go, moving them, when a run is due, totals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators import versioned
from rivulet.operators.ordered import all_but_latest
from rivulet.operators.snapshot import appended, run_rows
from rivulet.operators.transport import OPEN

#: Modes of selection, and the statuses that are final in them.
FINAL = {"outbound_finalized": ("applied", "dead"), "inbound_finalized": ("applied", "dead"), "transport_batch_finalized": ("acked", "failed")}


def cutoff(now: str, days: int) -> Column:
    return F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))


def candidates(rows: DataFrame, mode: str, date: str, before: Column, inbox: DataFrame | None = None, batch: str = "batch_id", history: tuple[str, ...] = ("service_id", "node_id", "direction")) -> DataFrame:
    """Rows older than `before` that the mode lets go.

    simple: all. outbound_finalized, inbound_finalized: of final status. transport_batch_finalized: of final status and
    without open rows in the inbox. checkpoint_history: all but the newest of each group.
    """
    old = rows.where(F.col(date) < before)
    if mode == "simple":
        return old
    if mode == "checkpoint_history":
        return all_but_latest(old, list(history), date, "id")
    done = old.where(F.col("status").isin(*FINAL[mode]))
    if mode == "transport_batch_finalized" and inbox is not None:
        return done.join(inbox.where(F.col("status").isin(*OPEN)).select(batch).distinct(), batch, "left_anti")
    return done


def moved(spark: SparkSession, table: str, archive: str, run: str, choose: Callable[[DataFrame], DataFrame], key: Sequence[str], dry_run: bool = False) -> dict[str, int]:
    """Move the rows that choose() picks from a versioned table into the versioned archive table, as one run.

    The rows are committed to the archive first and leave the table by a second commit, both under the run's id. So a run
    repeated after success changes nothing, and one that broke off between the two is carried on: it takes the rows from
    the archive, does not choose again, and only rows that are there leave. key names the columns that tell rows apart; if
    a row that stays shares them with one that goes, nothing is moved. Returns how many rows are in the run and in the table; a dry
    run moves nothing and tells how many it would choose.
    """
    if dry_run:
        rows = versioned.read(spark, table)
        return {"moved": choose(rows).count(), "left": rows.count()}
    keys = list(key)
    at = versioned.version(spark, table)
    if not versioned.committed(spark, archive, run):
        rows = versioned.read(spark, table)
        chosen = choose(rows)
        twice = rows.join(chosen.select(*keys).distinct(), keys, "left_semi").count() - chosen.count()
        if twice:
            raise ValueError(f"{', '.join(keys)} does not tell the rows of {table} apart that are to be archived")
        appended(chosen, archive, run)
    gone = run_rows(spark, archive, run)
    if at is None or run not in at.runs:
        versioned.commit(versioned.read(spark, table).join(gone.select(*keys), keys, "left_anti"), table, run)
    return {"moved": gone.count(), "left": versioned.read(spark, table).count()}


def capped(chosen: DataFrame, most: int, *order: str) -> DataFrame:
    """The oldest rows of a run's cap (a limit of the run, the next one goes on)."""
    return chosen.orderBy(*order).limit(most)


def archive_due(services: DataFrame, runs: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """(service_id, due, reason, remaining_seconds) by each service's last run that succeeded at least in part."""
    ended = runs.where(F.col("status").isin("success", "partial"))
    last = ended.groupBy("service_id").agg(F.max_by(F.struct(F.coalesce("finished_at", "started_at").alias("at")), "id").alias("last"))
    rows = services.select(F.col("id").alias("service_id")).join(last, "service_id", "left")
    elapsed = F.timestamp_diff("SECOND", F.col("last.at").cast("timestamp_ntz"), F.lit(now).cast("timestamp_ntz"))
    need = hours * 3600
    reason = (
        F.when(F.col("last").isNull(), "no_previous_archive_run")
        .when(F.col("last.at").isNull(), "previous_archive_run_without_datetime")
        .when(elapsed < need, "archive_interval_not_reached")
        .otherwise("archive_interval_reached")
    )
    left = F.when(F.col("reason") == "archive_interval_not_reached", F.greatest(need - elapsed, F.lit(0))).otherwise(0).cast("long")
    return rows.withColumn("reason", reason).withColumn("due", F.col("reason") != "archive_interval_not_reached").withColumn("remaining_seconds", left).select("service_id", "due", "reason", "remaining_seconds")
