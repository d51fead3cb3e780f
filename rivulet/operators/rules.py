"""Scope rules and name filters. Rules are a small table: up to MOST_RULES are broadcast, more are joined without a hint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES = 10_000
#: Engines that count as one family; names and the prefix of internal tables.
FAMILY = ("mysql", "mariadb")
INTERNAL_PREFIX = "cdc_"
INTERNAL = ("django_migrations", "django_content_type", "auth_permission", "django_admin_log")


def hard_excluded(table: str = "table_name", prefix: str = INTERNAL_PREFIX, names: tuple[str, ...] = INTERNAL) -> Column:
    """Whether a table is internal and never captured."""
    name = F.lower(F.trim(F.coalesce(F.col(table), F.lit(""))))
    return (name != "") & (F.startswith(name, F.lit(prefix)) | name.isin(*names))


def _fits(value: Column, wanted: Column, mode: Column, blank: bool) -> Column:
    """Whether a name fits a rule's; blank: what an empty rule name means."""
    value, wanted = F.trim(F.coalesce(value, F.lit(""))), F.trim(F.coalesce(wanted, F.lit("")))
    return F.when(wanted == "", F.lit(blank)).when(mode == "exact", value == wanted).when(mode == "prefix", F.startswith(value, wanted)).when(mode == "contains", F.contains(value, wanted)).otherwise(False)


def _joined(objects: DataFrame, rules: DataFrame, fits: Column) -> DataFrame:
    few = rules.limit(MOST_RULES + 1).count() <= MOST_RULES
    return objects.join(F.broadcast(rules) if few else rules, fits, "left")


def _ruled(rules: DataFrame) -> DataFrame:
    return rules.where("is_enabled").select(*(F.col(c).alias(f"r_{c}") for c in ("id", "engine", "policy_mode", "object_type", "match_mode", "database_name", "table_name", "priority")))


def scope_decisions(objects: DataFrame, rules: DataFrame, strict_include: bool = False) -> DataFrame:
    """decision, allowed and rule_id of each (engine, database_name, table_name).

    The first exclude rule by (priority, id) that matches denies. Without one the object is allowed, by an include rule
    if one matches. strict_include: where include rules exist for the engine, an object that none matches is denied.
    Names are decided once each: objects are made distinct first, so events join the few decisions instead of all rules.
    """
    names = objects.select("engine", "database_name", "table_name").distinct()
    engine, rule_engine = F.lower(F.trim("engine")), F.lower(F.trim("r_engine"))
    right_engine = (rule_engine == "all") | (rule_engine == engine) | (rule_engine.isin(*FAMILY) & engine.isin(*FAMILY))
    database = _fits(F.col("database_name"), F.col("r_database_name"), F.col("r_match_mode"), True)
    table = _fits(F.col("table_name"), F.col("r_table_name"), F.col("r_match_mode"), True)
    fits = right_engine & database & ((F.col("r_object_type") == "database") | ((F.col("r_object_type") == "table") & table))
    met = _joined(names, _ruled(rules), right_engine).withColumn("fits", F.coalesce(fits, F.lit(False)))
    exclude, include = F.col("r_policy_mode") == "exclude", F.col("r_policy_mode") == "include"
    out = met.groupBy("engine", "database_name", "table_name").agg(
        F.min_by("r_id", F.when(F.col("fits") & exclude, F.struct("r_priority", "r_id"))).alias("rule_id"),
        F.bool_or(F.col("fits") & include).alias("included"),
        F.bool_or(include).alias("has_include"),
    )
    unmet = F.coalesce(F.col("has_include"), F.lit(False)) if strict_include else F.lit(False)
    decision = (
        F.when(F.col("rule_id").isNotNull(), "denied_by_exclude_rule")
        .when(F.col("included"), "allowed_by_include_rule")
        .when(unmet, "denied_because_include_rules_exist_but_no_match")
        .otherwise("allowed_by_default_no_include_rules")
    )
    out = out.withColumn("decision", decision).withColumn("allowed", F.startswith("decision", F.lit("allowed")))
    return out.select("engine", "database_name", "table_name", "decision", "allowed", "rule_id")


def first_match_excludes(objects: DataFrame, rules: DataFrame, engine: str) -> DataFrame:
    """objects with excluded and rule_id: the first rule by (priority, id) that matches decides; an empty name in a
    rule matches nothing, and engines have no families."""
    on_database = _fits(F.col("database_name"), F.col("r_database_name"), F.col("r_match_mode"), False)
    any_database = F.trim(F.coalesce(F.col("r_database_name"), F.lit(""))) == ""
    on_table = _fits(F.col("table_name"), F.col("r_table_name"), F.col("r_match_mode"), False)
    fits = F.col("r_engine").isin("all", engine) & (((F.col("r_object_type") == "database") & on_database) | ((F.col("r_object_type") == "table") & (any_database | on_database) & on_table))
    keys = ["database_name", "table_name"]
    met = _joined(objects.select(*keys).distinct(), _ruled(rules), fits)
    first = met.groupBy(*keys).agg(F.min_by(F.struct("r_id", "r_policy_mode"), F.struct("r_priority", "r_id")).alias("r"))
    named = first.select(*(F.col(k).alias(f"_{k}") for k in keys), "r")
    out = objects.join(named, F.col("database_name").eqNullSafe(F.col("_database_name")) & F.col("table_name").eqNullSafe(F.col("_table_name")))
    return out.select(*objects.columns, F.coalesce(F.col("r.r_policy_mode") == "exclude", F.lit(False)).alias("excluded"), F.col("r.r_id").alias("rule_id"))


def csv_names(column: Column) -> Column:
    """The names of a comma-separated list, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def name_filter(name: str, include: Column, exclude: Column, like: Column) -> Column:
    """Whether a name is in the include list (if it has any), not in the exclude list, and like the pattern (if any)."""
    value, inc, exc = F.col(name), csv_names(include), csv_names(exclude)
    pattern = F.trim(F.coalesce(like, F.lit("")))
    return ((F.size(inc) == 0) | F.array_contains(inc, value)) & ~F.array_contains(exc, value) & ((pattern == "") | F.like(value, pattern))


def search(df: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows with the needle in one of the columns, in whatever case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(needle.lower()))
    return df.where(hit)

