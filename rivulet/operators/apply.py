"""Applying changes as a fold: the state that an ordered history leaves, without row-by-row updates.

Updates and inserts both write the row (an upsert); a delete removes it. Parquet tables know no MERGE, so a target is
rewritten: rows whose key the changes name leave by an anti-join, and the folded state joins by union.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_state(changes: DataFrame, key: str, order: str, op: str, columns: list[str]) -> DataFrame:
    """Full images: the last change of each key, unless it is a delete. One aggregation with map-side combining."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(op, *columns), order).alias("row"), F.max(order).alias("last_id"))
    return last.where(F.col(f"row.{op}") != "delete").select(key, "last_id", *(F.col(f"row.{c}").alias(c) for c in columns))


def partial_state(changes: DataFrame, key: str, order: str, op: str, columns: list[str]) -> DataFrame:
    """Partial images: each column's last present value since the key's last delete."""
    gone = changes.where(F.col(op) == "delete").groupBy(key).agg(F.max(order).alias("gone"))
    alive = changes.join(gone, key, "left").where(F.col("gone").isNull() | (F.col(order) > F.col("gone")))
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return alive.groupBy(key).agg(F.max(order).alias("last_id"), *latest)


def merged(target: DataFrame, changes: DataFrame, key: str, order: str, op: str) -> DataFrame:
    """target after the changes (full images over target's columns)."""
    columns = [c for c in target.columns if c != key]
    state = current_state(changes, key, order, op, columns).select(key, *columns)
    return target.join(changes.select(key).distinct(), key, "left_anti").unionByName(state)
