"""Planning of a capture run: backlog, adaptive limits, the window of log files to read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Floors and caps of the adaptive limits."""

    events_least: int = 500
    events_most: int = 50_000
    bytes_per_event: int = 2048
    file_weight: int = 1500
    files_least: int = 2
    files_most: int = 12
    bytes_least: int = 64 << 20
    bytes_most: int = 512 << 20


def _clamp(value: Column, least: int, most: int) -> Column:
    return F.least(F.greatest(value, F.lit(least)), F.lit(most))


def backlog(cursors: DataFrame, logs: DataFrame, by: str = "service_id") -> DataFrame:
    """cursors with start_idx, end_idx, backlog_files and backlog_bytes; unknown files give nulls and 0 bytes.

    Of the first file the bytes after the cursor count, of the last those before the master's position.
    """
    place = lambda c, out: logs.select(by, F.col("name").alias(c), F.col("idx").alias(out))
    rows = cursors.join(place("start_file", "start_idx"), [by, "start_file"], "left").join(place("master_file", "end_idx"), [by, "master_file"], "left")
    files = logs.select(by, "idx", "size")
    inside = rows.select(by, "start_idx", "end_idx", "start_pos", "master_pos").join(files, by).where("idx between start_idx and end_idx")
    first, last = F.col("idx") == F.col("start_idx"), F.col("idx") == F.col("end_idx")
    part = F.when(first & last, F.col("master_pos") - F.col("start_pos")).when(first, F.col("size") - F.col("start_pos")).when(last, F.col("master_pos")).otherwise(F.col("size"))
    sums = inside.groupBy(by).agg(F.sum(F.greatest(part, F.lit(0))).alias("backlog_bytes"), F.count("*").alias("backlog_files"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(sums, by, "left").select(*cursors.columns, "start_idx", "end_idx", zero("backlog_bytes"), zero("backlog_files"))


def adaptive_events(lim: Limits = Limits()) -> Column:
    """Events to scan next, from backlog_bytes, backlog_files and the last run's scanned, skipped and captured."""
    scanned, skipped = F.col("scanned"), F.col("skipped")
    base = F.greatest(F.lit(lim.events_least), F.floor(F.col("backlog_bytes") / lim.bytes_per_event)) + F.greatest(F.col("backlog_files") - 1, F.lit(0)) * lim.file_weight
    ratio = F.when(scanned > 0, skipped / scanned).otherwise(0.0)
    grown = F.floor(base * F.when(ratio >= 0.90, 2.0).when(ratio >= 0.75, 1.5).otherwise(1.0))
    grown = F.floor(grown * F.when((F.col("captured") <= 0) & (skipped > 0), 1.5).otherwise(1.0))
    return _clamp(grown, lim.events_least, lim.events_most).cast("long")


def adaptive_files(lim: Limits = Limits()) -> Column:
    return _clamp(F.col("backlog_files"), lim.files_least, lim.files_most).cast("long")


def adaptive_bytes(lim: Limits = Limits()) -> Column:
    return _clamp(F.col("backlog_bytes"), lim.bytes_least, lim.bytes_most).cast("long")


def scan_window(plans: DataFrame, logs: DataFrame, by: str = "service_id") -> DataFrame:
    """plans (backlog() with max_files and max_bytes) with window_end_idx, window_end_file, window_end_pos and empty_window."""
    end = F.least("end_idx", F.col("start_idx") + F.greatest("max_files", F.lit(1)) - 1)
    rows = plans.withColumn("window_end_idx", end)
    rows = rows.join(logs.select(by, F.col("idx").alias("window_end_idx"), F.col("name").alias("window_end_file"), F.col("size").alias("_size")), [by, "window_end_idx"], "left")
    one = F.col("start_idx") == F.col("end_idx")
    pos = F.when(one & (F.col("max_bytes") > 0), F.least("master_pos", F.col("start_pos") + F.col("max_bytes"))).when(F.col("window_end_idx") < F.col("end_idx"), F.col("_size")).otherwise(F.col("master_pos"))
    rows = rows.withColumn("window_end_pos", pos)
    empty = (F.col("window_end_idx") == F.col("start_idx")) & (F.col("window_end_pos") <= F.col("start_pos"))
    return rows.withColumn("empty_window", empty).drop("_size")


def _totals(hard: Column, ruled_out: Column) -> list[Column]:
    taken = ~hard & ~ruled_out
    count = lambda c, name: F.count_if(c).alias(name)
    family = F.col("event_family")
    return [F.count("*").alias("scanned"), count(hard, "hard_skipped"), count(~hard & ruled_out, "rule_skipped"), count(taken, "captured"), count(taken & (family == "dml"), "captured_dml"), count(taken & (family == "ddl"), "captured_ddl")]


def counters(events: DataFrame, hard: Column, ruled_out: Column) -> DataFrame:
    """One row of totals of a capture run."""
    return events.agg(*_totals(hard, ruled_out))


def observed(events: DataFrame, hard: Column, ruled_out: Column, name: str = "capture") -> tuple[DataFrame, Observation]:
    """(what is captured, the counters of the run): the counters are gathered by the pass that writes the captured rows, and
    are there once it has ended."""
    seen = Observation(name)
    return events.observe(seen, *_totals(hard, ruled_out)).where(~hard & ~ruled_out), seen
