"""Queries on the order of changes: wagons, files, positions, latest rows, transport order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.operators import ordered
from rivulet.plans.feed import FEED, FILE_EVENTS, STATUS_LOG, change_feed, checkpoints, CHECKPOINTS, status_log

WAGON_MOST = 3
FILES = 3


def cdc_wagons(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = change_feed(spark, sf_dir)
    return ordered.wagons(feed, ["database_name", "table_name", "op"], WAGON_MOST).select("id", "wagon_key", "wagon_seq", "wagon_event_index")


def cdc_file_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.file_indexes(change_feed(spark, sf_dir), "log_pos", FILES, "id").select("id", "log_pos", "file_index")


def cdc_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence numbers of the rows of each operation."""
    return ordered.numbered(change_feed(spark, sf_dir), "id", "seq", ("op",)).select("id", "op", "seq")


def cdc_log_position_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes at or before a position; every 13th file name has no number."""
    feed = change_feed(spark, sf_dir)
    feed = feed.withColumn("log_file", F.when(F.col("id") % 13 == 0, "bin.old").otherwise(F.col("log_file")))
    feed = feed.withColumn("stop_file", F.lit("bin.000002")).withColumn("stop_pos", F.lit(4 + 128 * 500))
    return feed.select("id", ordered.log_index().alias("log_index"), ordered.at_or_before("log_file", "log_pos", "stop_file", "stop_pos").alias("at_or_before"))


def cdc_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last change of each file."""
    grouped = change_feed(spark, sf_dir).groupBy("log_file").agg(F.min_by("op", "id").alias("first_op"), F.max_by("op", "id").alias("last_op"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("events"))
    return grouped


def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.latest(status_log(spark, sf_dir), ["service_id"], "collected_at", "id").select("service_id", "id", "collected_at", "lag_seconds")


def checkpoint_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["service_id", "node_id", "direction"]
    return ordered.all_but_latest(checkpoints(spark, sf_dir), keys, "updated_at", "id").select("id", *keys)


def latest_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 20 statuses."""
    rows = status_log(spark, sf_dir).orderBy(F.desc("collected_at"), F.desc("id")).limit(20)
    return rows.select("id", "service_id", "collected_at")


def oldest_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest and the first change of each operation and file."""
    feed = change_feed(spark, sf_dir).where("op <> 'update'")
    first = F.row_number().over(Window.partitionBy("op", "log_file").orderBy("id"))
    return feed.withColumn("rn", first).where("rn <= 2").select("op", "log_file", F.col("rn").cast("long").alias("rn"), "id")


QUERIES = {
    "cdc_wagons": cdc_wagons,
    "cdc_file_rollover": cdc_file_rollover,
    "cdc_sequence": cdc_sequence,
    "cdc_log_position_order": cdc_log_position_order,
    "cdc_first_last": cdc_first_last,
    "latest_status": latest_status,
    "checkpoint_history": checkpoint_history,
    "latest_feed": latest_feed,
    "oldest_open": oldest_open,
}
_IDX = "coalesce(TRY_CAST(split_part(log_file, '.', -1) AS INTEGER), -1)"
ORACLE_SQL = {
    "cdc_wagons": f"""WITH {FEED}, k AS (SELECT *, concat_ws('|', database_name, table_name, op) AS wagon_key FROM feed),
        c AS (SELECT *, CASE WHEN lag(wagon_key) OVER (ORDER BY id) = wagon_key THEN 0 ELSE 1 END AS change FROM k),
        i AS (SELECT *, sum(change) OVER (ORDER BY id) AS island FROM c),
        n AS (SELECT *, (row_number() OVER (PARTITION BY island ORDER BY id) - 1) % {WAGON_MOST} + 1 AS wagon_event_index FROM i)
        SELECT id, wagon_key, CAST(sum(CASE WHEN wagon_event_index = 1 THEN 1 ELSE 0 END) OVER (ORDER BY id) AS BIGINT) AS wagon_seq,
            CAST(wagon_event_index AS BIGINT) AS wagon_event_index FROM n""",
    "cdc_file_rollover": f"""WITH {FEED}, d AS (SELECT *, CASE WHEN log_pos < lag(log_pos) OVER (ORDER BY id) THEN 1 ELSE 0 END AS dropped FROM feed)
        SELECT id, log_pos, CAST(least(sum(dropped) OVER (ORDER BY id), {FILES - 1}) AS BIGINT) AS file_index FROM d""",
    "cdc_sequence": f"WITH {FEED} SELECT id, op, row_number() OVER (PARTITION BY op ORDER BY id) AS seq FROM feed",
    "cdc_log_position_order": f"""WITH {FEED}, f AS (SELECT id, log_pos, CASE WHEN id % 13 = 0 THEN 'bin.old' ELSE log_file END AS log_file FROM feed)
        SELECT id, {_IDX} AS log_index, {_IDX} < 2 OR ({_IDX} = 2 AND log_pos <= 4 + 128 * 500) AS at_or_before FROM f""",
    "cdc_first_last": f"""WITH {FEED} SELECT log_file, min_by(op, id) AS first_op, max_by(op, id) AS last_op, min(id) AS first_id, max(id) AS last_id, count(*) AS events
        FROM feed GROUP BY log_file""",
    "latest_status": f"""WITH {STATUS_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY service_id ORDER BY collected_at DESC, id DESC) AS n FROM status_log)
        SELECT service_id, id, collected_at, lag_seconds FROM r WHERE n = 1""",
    "checkpoint_history": f"""WITH {CHECKPOINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY service_id, node_id, direction ORDER BY updated_at DESC, id DESC) AS n FROM checkpoints)
        SELECT id, service_id, node_id, direction FROM r WHERE n > 1""",
    "latest_feed": f"WITH {STATUS_LOG} SELECT id, service_id, collected_at FROM status_log ORDER BY collected_at DESC, id DESC LIMIT 20",
    "oldest_open": f"""WITH {FEED}, r AS (SELECT *, row_number() OVER (PARTITION BY op, log_file ORDER BY id) AS rn FROM feed WHERE op <> 'update')
        SELECT op, log_file, rn, id FROM r WHERE rn <= 2""",
}
