"""Queries on the capture of a log that Spark writes from the events, read as a stream in runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.plans.feed import FEED
from rivulet.queries_text import FILES, log_text, written
from rivulet.session import scratch
from rivulet.sources import logtext
from rivulet.sources.logstream import files
from rivulet.streaming import capture, pipeline


def _written(spark: SparkSession, sf_dir: str) -> tuple[str, str, capture.Window]:
    """A folder of the log in five files or more, one for a capture, and its scan window of two fifths of the files."""
    out = scratch(spark, "log")
    written(log_text(spark, sf_dir), out, 5)
    return out, scratch(spark, "capture"), capture.Window(max_files=-(-2 * len(files(out)) // 5))


def captured_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of a log that is read two fifths of its files to a run, paused after the first run and resumed."""
    path, work, window = _written(spark, sf_dir)
    out, control = scratch(spark, "lines"), scratch(spark, "control")
    for state in (capture.RUN, capture.PAUSED, capture.RUN):
        capture.command(spark, control, state)
        capture.run_once(spark, path, work, pipeline.appender(out), window, control)
    capture.drain(spark, path, work, pipeline.appender(out), window, control, 9)
    lines = capture.captured(spark, out)
    starts = lines.groupBy("file").agg(F.max("position").alias("last"))
    before = F.coalesce(F.sum(F.col("last") + 1).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    placed = lines.join(F.broadcast(starts.select("file", before.alias("before"))), "file").select((F.col("before") + F.col("position")).alias("line_no"), "line")
    found = logtext.row_events(placed, FILES, {1: "id", 2: "k"})
    return found.select("event_no", "op", "log_pos", F.try_element_at("before", F.lit("id")).alias("before_id"), F.try_element_at("after", F.lit("k")).alias("after_k"))


def capture_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each of a capture's runs stopped, and that their lines add up: windows of two fifths of the files, a pause, an end, nothing."""
    path, work, window = _written(spark, sf_dir)
    out, control = scratch(spark, "lines"), scratch(spark, "control")
    once = lambda: capture.run_once(spark, path, work, pipeline.appender(out), window, control)
    runs = [once()]
    for state in (capture.PAUSED, capture.STOPPED):
        capture.command(spark, control, state)
        runs.append(once())
    capture.command(spark, control, capture.RUN)
    runs += [(r.reason, r.lines) for r in capture.drain(spark, path, work, pipeline.appender(out), window, control, 9).orderBy("run").collect()]  # a row for each run
    runs.append(once())
    rows = spark.createDataFrame([(n, *r) for n, r in enumerate(runs)], "run int, reason string, lines long")
    total = rows.agg(F.lit("all").alias("reason"), F.lit(None).cast("long").alias("runs"), F.sum("lines").alias("lines"))
    return rows.groupBy("reason").agg(F.count("*").alias("runs")).withColumn("lines", F.lit(None).cast("long")).unionByName(total)


QUERIES = {f.__name__: f for f in (captured_log, capture_runs)}
_LINES = "sum(CASE op WHEN 'update' THEN 11 ELSE 7 END)"
ORACLE_SQL = {
    "capture_runs": f"""WITH {FEED} SELECT reason, CAST(runs AS BIGINT) AS runs, CAST(NULL AS BIGINT) AS lines
        FROM (VALUES ('{capture.WINDOW}', 2), ('{capture.PAUSED}', 1), ('{capture.STOPPED}', 1), ('{capture.END}', 1), ('{capture.NOTHING}', 1)) AS v(reason, runs)
        UNION ALL SELECT 'all', NULL, CAST({_LINES} AS BIGINT) FROM feed""",
    "captured_log": f"""WITH {FEED} SELECT row_number() OVER (ORDER BY id) AS event_no, op, log_pos, CASE WHEN op <> 'insert' THEN CAST(pk AS VARCHAR) END AS before_id, CASE WHEN op <> 'delete' THEN CAST(k AS VARCHAR) END AS after_k FROM feed""",
}
