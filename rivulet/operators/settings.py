"""Scoped settings: the most specific valid value of each definition for each service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scopes from the most specific, and the texts that mean true.
SCOPES = ("service", "node", "client", "company", "engine", "global")
TRUE = ("1", "true", "yes", "y", "on")


def valid_at(now: str, start: str = "valid_from", end: str = "valid_until") -> Column:
    """Whether the bounds, both inclusive and each optional, hold now."""
    at = F.lit(now).cast("timestamp_ntz")
    since, until = F.col(start).cast("timestamp_ntz"), F.col(end).cast("timestamp_ntz")
    return (since.isNull() | (since <= at)) & (until.isNull() | (until >= at))


def decoded(kind: Column, raw: Column, default: bool) -> Column:
    """The value as canonical text: numbers that cannot be read are 0; a blank default is none."""
    number = F.when(F.trim(raw).rlike("^[+-]?[0-9]+$"), F.trim(raw).try_cast("long").cast("string"))
    real = F.trim(raw).try_cast("double").cast("string")
    value = (
        F.when(kind == "integer", F.coalesce(number, F.lit("0")))
        .when(kind == "float", F.coalesce(real, F.lit("0.0")))
        .when(kind == "boolean", F.lower(F.trim(F.coalesce(raw, F.lit("")))).isin(*TRUE).cast("string"))
        .otherwise(F.coalesce(raw, F.lit("")))
    )
    return F.when(F.coalesce(raw, F.lit("")) != "", value) if default else value


def resolved(services: DataFrame, definitions: DataFrame, values: DataFrame, now: str, scopes: tuple[str, ...] = SCOPES, checked: bool = True) -> DataFrame:
    """(service_id, key, value, source, setting_id): first hit in the scopes' order, there by (priority, id); then the
    definition's default; null if there is none. Of definitions with one key the first enabled counts.

    checked=False: neither validity nor engine is looked at (the archive's variant, with scopes service and global).
    Services and settings are joined on the scope's own key, one equality join for each scope.
    """
    keys = definitions.where("is_enabled").groupBy("key").agg(F.min_by(F.struct("id", "value_type", "default_value"), "id").alias("d"))
    keys = keys.select("key", F.col("d.id").alias("definition_id"), "d.value_type", "d.default_value")
    on = {"service": ("id", "service_id"), "node": ("node_id", "node_id"), "client": ("client_name", "client_name"), "company": ("company_name", "company_name"), "engine": ("engine", "engine")}
    usable = values.where("is_enabled")
    if checked:
        usable = usable.where(valid_at(now))
    hits = None
    for rank, scope in enumerate(scopes):
        own = usable.where(F.col("scope_type") == scope).select(F.col("id").alias("setting_id"), "definition_id", "priority", "value_text", F.col("engine").alias("v_engine"), *([F.col(on[scope][1]).alias("v_key")] if scope in on else []))
        left = services.select(F.col("id").alias("service_id"), F.col("engine").alias("s_engine"), *([F.col(on[scope][0]).alias("s_key")] if scope in on else []))
        cond = F.col("s_key") == F.col("v_key") if scope in on else F.lit(True)  # global values: a few rows
        both = left.join(own, cond)
        if checked:
            both = both.where((F.col("v_engine") == "all") | (F.col("v_engine") == F.col("s_engine")))
        one = both.select("service_id", "definition_id", "setting_id", "value_text", F.struct(F.lit(rank).alias("rank"), "priority", "setting_id").alias("order"), F.lit(scope).alias("scope"))
        hits = one if hits is None else hits.unionByName(one)
    best = hits.groupBy("service_id", "definition_id").agg(F.min_by(F.struct("setting_id", "value_text", "scope"), "order").alias("hit"))
    rows = services.select(F.col("id").alias("service_id")).join(keys, F.lit(True))  # each service's every setting is the result
    rows = rows.join(best, ["service_id", "definition_id"], "left")
    kind = F.col("value_type")
    value = F.when(F.col("hit").isNotNull(), decoded(kind, F.col("hit.value_text"), False)).otherwise(decoded(kind, F.col("default_value"), True))
    source = F.when(F.col("hit").isNotNull(), F.col("hit.scope")).when(F.coalesce("default_value", F.lit("")) != "", "default").otherwise("fallback")
    return rows.select("service_id", "key", value.alias("value"), source.alias("source"), F.col("hit.setting_id").alias("setting_id"))
