"""Capture of a log in runs, under control: each run reads one scan window, and says why it stopped.

A run is a stream of the log source from its checkpoint to the end of the window (availableNow). Between runs a control
table is read: paused holds the capture, stopped ends it, run lets it go on; so what was paused goes on where it was, on
the same checkpoint. drain() repeats runs while they are cut off by the window, as often as it may.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from rivulet.operators import versioned
from rivulet.sources.logstream import LogSource, files, noted

#: States of control, and why a run stopped.
RUN, PAUSED, STOPPED = "run", "paused", "stopped"
WINDOW, END, NOTHING = "scan_window_limit_reached", "end_of_log", "no_events_available"


@dataclass(frozen=True)
class Window:
    max_files: int = 1 << 30
    max_bytes: int = 1 << 62
    part_bytes: int = 8 << 20


class Progress(StreamingQueryListener):
    """What the runs of this session read, by the name of the query: rows, and how many batches had some."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        name, rows = event.progress.name, event.progress.numInputRows
        if name and rows:
            self.rows[name] = self.rows.get(name, 0) + rows
            self.batches[name] = self.batches.get(name, 0) + 1

    def onQueryTerminated(self, event) -> None:
        pass


def command(spark: SparkSession, control: str, state: str) -> None:
    """Tell the capture to run, pause or stop."""
    if state not in (RUN, PAUSED, STOPPED):
        raise ValueError(f"unknown state '{state}'")
    versioned.commit(spark.createDataFrame([(state,)], "state string"), control)


def told(spark: SparkSession, control: str) -> str:
    """What the control table says; run if there is none."""
    return versioned.read(spark, control).first().state if versioned.version(spark, control) else RUN


def lines(spark: SparkSession, path: str, work: str, window: Window = Window()) -> DataFrame:
    """The log as a stream of (file, position, line), a scan window to a run; work: a folder of the capture's own."""
    spark.dataSource.register(LogSource)
    options = {"path": path, "progress": f"{work}/progress", **{k: str(v) for k, v in vars(window).items()}}
    return spark.readStream.format(LogSource.name()).options(**options).load()


def run_once(spark: SparkSession, path: str, work: str, sink: Callable[[DataFrame, int], None], window: Window = Window(), control: str | None = None, name: str | None = None) -> tuple[str, int]:
    """(why it stopped, lines read) of one run; sink gets the batch and its number, which is the same if it runs again."""
    state = told(spark, control) if control else RUN
    if state != RUN:
        return state, 0
    _folder(spark, work)
    writer = lines(spark, path, work, window).writeStream.option("checkpointLocation", f"{work}/checkpoint").foreachBatch(sink).trigger(availableNow=True)
    query = (writer.queryName(name) if name else writer).start()
    query.awaitTermination()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    if not read:
        return NOTHING, 0
    return (END if noted(f"{work}/progress") == files(path)[-1] else WINDOW), read


def _folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


def drain(spark: SparkSession, path: str, work: str, sink: Callable[[DataFrame, int], None], window: Window = Window(), control: str | None = None, most_runs: int = 5, name: str | None = None) -> DataFrame:
    """Runs until the log's end, a pause or a stop, at most most_runs: a row (run, reason, lines) for each."""
    out = []
    for n in range(most_runs):
        reason, read = run_once(spark, path, work, sink, window, control, name)
        out.append((n, reason, read))
        if reason != WINDOW:
            break
    return spark.createDataFrame(out, "run int, reason string, lines long")


def captured(spark: SparkSession, out: str) -> DataFrame:
    """The lines that runs with appender() have written, in the log's order by (file_no, position)."""
    from rivulet.operators.ordered import log_index

    return spark.read.parquet(out).withColumn("file_no", log_index(F.regexp_replace("file", "[.](txt|log)$", "")))
