"""Queries on duplicates, compaction and the state that the changes leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators import dedup
from rivulet.operators.apply import current_state, partial_state
from rivulet.plans.feed import CAPTURED, FEED, captured, change_feed

_SIGNED = ("database_name", "table_name", "op", "pk", "k")
_SIG = "sha256(concat_ws('|', database_name, table_name, op, CAST(pk AS VARCHAR), coalesce(CAST(k AS VARCHAR), '\\N')))"


def _signature():
    return dedup.business_signature(*_SIGNED)


def cdc_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.exact_duplicates(captured(spark, sf_dir), _signature())
    return out.select("id", "signature", "survivor_id", (F.col("id") == F.col("survivor_id")).alias("survives"))


_MARKED = f"""{CAPTURED}, signed AS (SELECT *, {_SIG} AS signature FROM captured),
    marked AS (SELECT *, min(id) OVER (PARTITION BY signature) AS survivor_id FROM signed)"""
_HISTORY = f"""{_MARKED}, h AS (
        SELECT pk, count(*) AS n, min_by(op, id) AS f, max_by(op, id) AS l, min(id) AS first_id, max(id) AS last_id,
            max(id) FILTER (WHERE op = 'update') AS last_update_id, count(*) FILTER (WHERE op = 'insert') AS inserts,
            count(*) FILTER (WHERE op = 'update') AS updates, count(*) FILTER (WHERE op = 'delete') AS deletes
        FROM marked WHERE id = survivor_id GROUP BY pk),
    o AS (SELECT *, CASE WHEN n = 1 THEN 'single' WHEN f = 'insert' AND l = 'delete' THEN 'A'
            WHEN f = 'insert' AND inserts + updates = n THEN 'B' WHEN updates = n THEN 'C'
            WHEN l = 'delete' AND updates + deletes = n THEN 'D' ELSE 'E' END AS outcome FROM h),
    kept AS (SELECT *, CASE WHEN outcome IN ('single', 'B') THEN first_id END AS first_kept,
            CASE WHEN outcome = 'B' THEN last_update_id WHEN outcome <> 'A' THEN last_id END AS last_kept FROM o)"""
_SURVIVOR = "CASE WHEN outcome = 'A' THEN 0 ELSE coalesce(last_kept, first_kept) END"
_DECIDED = f"""{_HISTORY}, decided AS (
        SELECT m.id, m.pk, m.op, CASE WHEN m.id <> m.survivor_id THEN 'exact_duplicate' WHEN outcome = 'A' THEN 'neutralized'
            WHEN m.id IS NOT DISTINCT FROM first_kept OR m.id IS NOT DISTINCT FROM last_kept THEN 'survivor' ELSE 'collapsed' END AS decision_type,
            CAST({_SURVIVOR} AS BIGINT) AS survivor_event_id
        FROM marked m JOIN kept USING (pk))"""


def cdc_pk_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = dedup.exact_duplicates(captured(spark, sf_dir), _signature()).where("id = survivor_id")
    return dedup.key_histories(marked).select("pk", "n", "first_op", "last_op", "outcome", "survivor_event_id")


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.decisions(captured(spark, sf_dir), _signature())


def cdc_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("id", "pk", "op", "decision_type", "survivor_event_id")


def cdc_dedup_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).groupBy("decision_type").agg(F.count("*").alias("events"), F.countDistinct("pk").alias("keys"))


def cdc_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = F.when(F.col("decision_type") == "survivor", "pending").otherwise("dead")
    out = dedup.undone(_decided(spark, sf_dir).withColumn("status", dead))
    return out.groupBy("decision_type", "status").agg(F.count("*").alias("events"))


def cdc_dead_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead ids as a union of the sets of each kind, collapsed ones without neutralised ones."""
    decided = _decided(spark, sf_dir)
    of = lambda kind: decided.where(F.col("decision_type") == kind).select("id")
    return of("exact_duplicate").union(of("neutralized")).union(of("collapsed").subtract(of("neutralized"))).distinct()


def cdc_dedup_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe mode: only changes of one log position are duplicates."""
    signature = dedup.business_signature(*_SIGNED, position=("log_file", "log_pos"))
    return dedup.decisions(captured(spark, sf_dir), signature).groupBy("decision_type").agg(F.count("*").alias("events"))


_SAFE = _DECIDED.replace(_SIG, _SIG.replace("'\\N'))", "'\\N'), log_file, CAST(log_pos AS VARCHAR))"))


def cdc_apply_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_state(change_feed(spark, sf_dir), "pk", "id", "op", ["value", "k"])


def cdc_apply_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial images: only values above 50 carry value, only odd ids carry k."""
    feed = change_feed(spark, sf_dir)
    feed = feed.withColumn("value", F.when(F.col("value") > 50, F.col("value"))).withColumn("k", F.when(F.col("id") % 2 == 1, F.col("k")))
    return partial_state(feed, "pk", "id", "op", ["value", "k"])


QUERIES = {
    "cdc_exact_dedup": cdc_exact_dedup,
    "cdc_pk_compaction": cdc_pk_compaction,
    "cdc_decisions": cdc_decisions,
    "cdc_dedup_metrics": cdc_dedup_metrics,
    "cdc_undo": cdc_undo,
    "cdc_dead_ids": cdc_dead_ids,
    "cdc_dedup_safe": cdc_dedup_safe,
    "cdc_apply_state": cdc_apply_state,
    "cdc_apply_partial": cdc_apply_partial,
}
ORACLE_SQL = {
    "cdc_exact_dedup": f"WITH {_MARKED} SELECT id, signature, survivor_id, id = survivor_id AS survives FROM marked",
    "cdc_pk_compaction": f"WITH {_HISTORY} SELECT pk, n, f AS first_op, l AS last_op, outcome, CAST({_SURVIVOR} AS BIGINT) AS survivor_event_id FROM kept",
    "cdc_decisions": f"WITH {_DECIDED} SELECT * FROM decided",
    "cdc_dedup_metrics": f"WITH {_DECIDED} SELECT decision_type, count(*) AS events, count(DISTINCT pk) AS keys FROM decided GROUP BY 1",
    "cdc_undo": f"WITH {_DECIDED} SELECT decision_type, 'pending' AS status, count(*) AS events FROM decided GROUP BY 1",
    "cdc_dead_ids": f"WITH {_DECIDED} SELECT id FROM decided WHERE decision_type <> 'survivor'",
    "cdc_dedup_safe": f"WITH {_SAFE} SELECT decision_type, count(*) AS events FROM decided GROUP BY 1",
    "cdc_apply_state": f"""WITH {FEED}, l AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY id DESC) AS r FROM feed)
        SELECT pk, id AS last_id, value, k FROM l WHERE r = 1 AND op <> 'delete'""",
    "cdc_apply_partial": f"""WITH {FEED},
        d AS (SELECT *, max(CASE WHEN op = 'delete' THEN id END) OVER (PARTITION BY pk) AS gone FROM feed),
        alive AS (SELECT * FROM d WHERE gone IS NULL OR id > gone)
        SELECT pk, max(id) AS last_id, max_by(value, id) FILTER (WHERE value > 50) AS value, max_by(k, id) FILTER (WHERE id % 2 = 1 AND k IS NOT NULL) AS k
        FROM alive GROUP BY pk""",
}
