"""Sessions, and shipping of this package to executors."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN: list[str] = []
_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a local one only if that is unset
    and all runs on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="rivulet-"))
        shared = _OWN[0]
    path = f"{shared.rstrip('/')}/rivulet/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete what scratch() has named so far; call it when results that read from there are written. Returns how many
    folders went."""
    gone = 0
    while _MADE:
        where = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))
    return gone


def session(app: str = "rivulet", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf overrides and extends."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp()
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "rivulet"), "zip", top, "rivulet"))


def shipping(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """query, with the package at hand on the workers."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    run.__name__ = getattr(query, "__name__", "query")
    return run
