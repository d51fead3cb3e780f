"""Monitoring: states of replication, nodes, batches; journals; failover plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of service whose lag matters, and the lag (seconds) above which they lag.
LAGGING, LAG_ALARM = ("postgresql", "mariadb", "filesync"), 30
LAG_KEYS = ("replication_lag_seconds", "lag_seconds", "delay_seconds")
ERROR_KEYS = ("error", "last_error", "message")
#: Actions of a failover plan on the database.
PLAN_ACTIONS = ("mariadb.stop_replica", "mariadb.start_replica", "mariadb.promote", "mariadb.set_read_only")


def lag_seconds(payload: Column) -> Column:
    """The first lag that is given; 0 if it is no whole number."""
    raw = F.coalesce(*(F.get_json_object(payload, f"$.{k}") for k in LAG_KEYS))
    return F.coalesce(raw.try_cast("int"), F.lit(0))


def last_error(payload: Column) -> Column:
    texts = [F.nullif(F.trim(F.get_json_object(payload, f"$.{k}")), F.lit("")) for k in ERROR_KEYS]
    return F.coalesce(*texts, F.lit(""))


def replication_status(kind: Column, payload: Column) -> Column:
    installed = F.coalesce(F.get_json_object(payload, "$.installed"), F.lit("true")) != "false"
    running = F.coalesce(F.get_json_object(payload, "$.running"), F.lit("true")) != "false"
    error = F.trim(F.coalesce(F.get_json_object(payload, "$.error"), F.lit(""))) != ""
    lagging = kind.isin(*LAGGING) & (lag_seconds(payload) > LAG_ALARM)
    return F.when(~installed, "unknown").when(error | ~running, "error").when(lagging, "lagging").otherwise("ok")


def node_status(payload: Column) -> Column:
    """degraded: no readable status, or an installed service that does not run; else online."""
    kind = "struct<installed:boolean,running:boolean>"
    services = F.from_json(F.get_json_object(payload, "$.services"), f"map<string,{kind}>")
    down = F.exists(F.map_values(services), lambda s: F.coalesce(s["installed"], F.lit(True)) & (F.coalesce(s["running"], F.lit(True)) == F.lit(False)))
    readable = F.get_json_object(payload, "$").isNotNull()
    return F.when(~readable, "degraded").when(F.coalesce(down, F.lit(False)), "degraded").otherwise("online")


def status_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(source, status, events): one pass over each table."""
    out = None
    for name, df in tables.items():
        one = df.groupBy("status").agg(F.count("*").alias("events")).select(F.lit(name).alias("source"), "status", "events")
        out = one if out is None else out.unionByName(one)
    return out


def global_status(nodes: DataFrame, services: DataFrame, failovers: DataFrame, locks: DataFrame) -> DataFrame:
    """One row of counts."""
    is_ = lambda v: F.count_if(F.col("status") == v).alias(f"nodes_{v}")
    n = nodes.agg(F.count("*").alias("nodes_total"), F.count_if("is_enabled").alias("nodes_enabled"), is_("online"), is_("offline"), is_("degraded"))
    s = services.agg(F.count("*").alias("replication_total"), F.count_if("is_enabled").alias("replication_enabled"))
    f = failovers.agg(F.count_if(F.col("status").isin("ready", "running")).alias("active_failovers"))
    k = locks.agg(F.count_if("is_locked").alias("locked_objects"))
    return n.join(s, F.lit(True)).join(f, F.lit(True)).join(k, F.lit(True))  # one row each


def console_summary(batches: DataFrame) -> DataFrame:
    """Batches by state for each service, and a row of totals with a null service."""
    is_ = lambda v: F.count_if(F.col("status") == v).alias(f"{v}_batches")
    out = batches.rollup("service_id").agg(is_("failed"), is_("ready"), is_("sent"), is_("acked"))
    return out.withColumn("total_batches", F.col("failed_batches") + F.col("ready_batches") + F.col("sent_batches") + F.col("acked_batches"))


def journal(audits: DataFrame, actions: DataFrame, each: int = 10, most: int = 20) -> DataFrame:
    """(kind, created_at, line): the latest of both feeds, newest first."""
    at = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    node = F.coalesce("node", F.lit("-"))
    latest = lambda df: df.orderBy(F.desc("created_at"), F.desc("id")).limit(each)
    a = latest(audits).select(F.lit("audit").alias("kind"), "id", "created_at", F.concat(at, F.lit(" "), F.lower("level"), F.lit(" "), F.col("event_type"), F.lit(" on "), node, F.lit(": "), F.col("message")).alias("line"))
    b = latest(actions).select(F.lit("action").alias("kind"), "id", "created_at", F.concat(at, F.lit(" "), F.lower("status"), F.lit(" "), F.col("action_name"), F.lit(" on "), node, F.lit(" in "), F.col("duration_ms").cast("string"), F.lit(" ms")).alias("line"))
    return a.unionByName(b).orderBy(F.desc("created_at"), "kind", F.desc("id")).limit(most)


def failover_findings(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(plan_id, step_no, level, message) of each fault of a plan's steps; a plan without steps has one at step 0."""
    name, action = F.trim(F.coalesce("node", F.lit(""))), F.trim(F.coalesce("action", F.lit("")))
    rows = steps.withColumn("node", name).withColumn("action", action)
    rows = rows.join(nodes.select(F.col("name").alias("node"), F.col("is_enabled").alias("_enabled"), F.lit(True).alias("_known")).dropDuplicates(["node"]), "node", "left")
    real = F.col("step_no") > 0
    fault = lambda cond, level, text: F.when(cond, F.struct(F.lit(level).alias("level"), text.alias("message")))
    quoted = F.concat(F.lit("node '"), F.col("node"), F.lit("' "))
    found = F.array(
        fault(~real, "error", F.lit("the plan names no steps")),
        fault(real & (F.col("action") == ""), "error", F.lit("no action is given")),
        fault(real & (F.col("node") == ""), "error", F.lit("no node is given")),
        fault(real & (F.col("node") != "") & F.col("_known").isNull(), "error", F.concat(quoted, F.lit("is unknown"))),
        fault(real & (F.col("_enabled") == F.lit(False)), "warning", F.concat(quoted, F.lit("is switched off"))),
        fault(real & (F.col("params_ok") == F.lit(False)), "error", F.lit("parameters are no mapping")),
        fault(F.startswith("action", F.lit("mariadb.")) & ~F.col("action").isin(*PLAN_ACTIONS), "error", F.concat(F.lit("no such database action: "), F.col("action"))),
    )
    return rows.select("plan_id", "step_no", F.explode(F.array_compact(found)).alias("f")).select("plan_id", "step_no", "f.level", "f.message")


def touching(rows: DataFrame, node: int, source: str = "source_node_id", target: str = "target_node_id") -> DataFrame:
    """Rows whose source or target is the node."""
    return rows.where((F.col(source) == node) | (F.col(target) == node))
