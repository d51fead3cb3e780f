"""Work on many tables at once: so many at a time, each in a pool of its own, a failure as a row instead of an end."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

OUTCOMES = "name string, status string, rows long, error string"


def run_all(spark: SparkSession, jobs: Mapping[str, Callable[[], int | None]], at_once: int = 2, stop_after: int | None = None) -> DataFrame:
    """(name, status, rows, error) of each job, in the order given: success with the rows that it reports, failed with the
    error's first line, or skipped, once stop_after jobs have failed.

    Jobs run in threads, at_once at a time, with this thread's local properties and a scheduler pool named after the job,
    so that under spark.scheduler.mode=FAIR a long one does not hold up the others.
    """
    failed: list[str] = []

    def one(name: str) -> tuple[str, str, Any, Any]:
        if stop_after is not None and len(failed) >= stop_after:
            return name, "skipped", None, None
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            return name, "success", jobs[name](), None
        except Exception as e:  # whatever a job dies of is its outcome
            failed.append(name)
            return name, "failed", None, (str(e).strip().splitlines() or [type(e).__name__])[0][:500]

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        got = list(pool.map(inheritable_thread_target(spark)(one), jobs))
    return spark.createDataFrame(got, OUTCOMES)
