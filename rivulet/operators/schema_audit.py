"""Audit of declared against actual schemas: differences, index risks, impact, operations applied, statement kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.operators.rules import csv_names

#: Text kinds whose indexes are limited in length, and the limit.
SHORT_KINDS, LONGEST = ("CharField", "SlugField", "URLField"), 191
#: Statements by their beginnings.
STATEMENTS = ("CREATE TABLE", "ALTER TABLE", "DROP TABLE", "CREATE UNIQUE INDEX", "CREATE INDEX", "DROP INDEX", "INSERT", "UPDATE", "DELETE")


def column_diff(model: DataFrame, actual: DataFrame) -> DataFrame:
    """(table_name, column_name, difference): table_missing, missing_in_db or extra_in_db."""
    want = model.where("column_name <> ''").select("table_name", "column_name").distinct().withColumn("_want", F.lit(True))
    have = actual.select("table_name", "column_name").distinct().withColumn("_have", F.lit(True))
    exists = actual.select("table_name").distinct().withColumn("_table", F.lit(True))
    audited = model.select("table_name").distinct()
    both = want.join(have, ["table_name", "column_name"], "full").join(audited, "table_name", "left_semi").join(exists, "table_name", "left")
    kind = F.when(F.col("_table").isNull(), "table_missing").when(F.col("_have").isNull(), "missing_in_db").when(F.col("_want").isNull(), "extra_in_db")
    return both.select("table_name", "column_name", kind.alias("difference")).where("difference is not null")


def _long(kind: str = "kind", length: str = "max_length") -> Column:
    return F.col(kind).isin(*SHORT_KINDS) & (F.coalesce(length, F.lit(0)) > LONGEST)


def index_risks(model: DataFrame, model_indexes: DataFrame, db_indexes: DataFrame) -> DataFrame:
    """(model, risk, subject): risky_indexed, risky_unique, fk_without_index, risky_composite."""
    indexed = db_indexes.select("table_name", F.explode(csv_names(F.col("columns_csv"))).alias("column_name")).distinct().withColumn("_indexed", F.lit(True))
    rows = model.join(indexed, ["table_name", "column_name"], "left")
    risk = F.array_compact(
        F.array(
            F.when(F.col("is_indexed") & (_long() | (F.col("kind") == "TextField")), "risky_indexed"),
            F.when(F.col("is_unique") & _long(), "risky_unique"),
            F.when((F.col("relation") == "FK") & (F.col("column_name") != "") & F.col("_indexed").isNull(), "fk_without_index"),
        )
    )
    own = rows.select("model", F.explode(risk).alias("risk"), F.col("field").alias("subject"))
    fields = model_indexes.select("model", "index_name", F.explode(csv_names(F.col("fields_csv"))).alias("field")).withColumn("field", F.ltrim("field", F.lit("-")))
    bad = fields.join(model, ["model", "field"]).where(_long() | (F.col("kind") == "TextField"))
    return own.unionByName(bad.select("model", F.lit("risky_composite").alias("risk"), F.col("index_name").alias("subject")).distinct())


def impact(models: DataFrame, diff: DataFrame, risks: DataFrame, relations: DataFrame) -> DataFrame:
    """Score, level and severity of each of the models (model, table_name)."""
    has = lambda c, v: F.count_if(F.col(c) == v) > 0
    d = diff.groupBy("table_name").agg(has("difference", "table_missing").alias("no_table"), (F.count_if(F.col("difference").isin("missing_in_db", "table_missing")) > 0).alias("no_column"))
    r = risks.groupBy("model").agg(*(has("risk", k).alias(k) for k in ("risky_indexed", "risky_unique", "risky_composite")))
    t = relations.groupBy("model").agg(F.count("*").alias("relations"), F.count_if(F.col("direction") == "FK").alias("outbound"), F.count_if(~F.col("direction").isin("FK", "M2M")).alias("inbound"))
    rows = models.join(d, "table_name", "left").join(r, "model", "left").join(t, "model", "left").na.fill(False).na.fill(0)
    points = {"no_table": 5, "no_column": 4, "risky_indexed": 2, "risky_unique": 2, "risky_composite": 3}
    score = F.when(F.col("relations") >= 8, 2).otherwise(0)
    for name, n in points.items():
        score = score + F.when(F.col(name), n).otherwise(0)
    dense = (F.col("outbound") >= 4) | (F.col("inbound") >= 6) | (F.col("relations") >= 10)
    level = F.when(F.col("impact_score") >= 8, "HIGH").when(F.col("impact_score") >= 4, "MEDIUM").otherwise("LOW")
    severity = F.when(F.col("no_table") | F.col("no_column"), "CRITICAL").when(F.col("risky_indexed") | F.col("risky_unique") | F.col("risky_composite") | dense | (F.col("impact_level") == "HIGH"), "WARNING").otherwise("OK")
    return rows.withColumn("impact_score", score).withColumn("impact_level", level).withColumn("severity", severity).select("model", "impact_score", "impact_level", "severity")


def operation_statuses(ops: DataFrame, columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """ops with status (applied or missing) and reason."""
    tables = columns.select("table_name").distinct().withColumn("_table", F.lit(True))
    own = columns.select("table_name", "column_name", F.lit(True).alias("_column"), F.col("size").alias("_size"), F.col("null_ok").alias("_null"), F.col("default_value").alias("_default"))
    exact = indexes.select("table_name", "columns_csv").distinct()
    rows = ops.join(tables, "table_name", "left").join(own, ["table_name", "column_name"], "left")
    rows = rows.join(exact.withColumn("_index", F.lit(True)), ["table_name", "columns_csv"], "left")
    alone = exact.select("table_name", F.col("columns_csv").alias("column_name"), F.lit(True).alias("_alone"))
    rows = rows.join(alone, ["table_name", "column_name"], "left")
    bool_text = lambda c: F.initcap(F.col(c).cast("string"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    mismatch = lambda what, a, b: F.concat(F.lit(f"{what} mismatch db="), a, F.lit(" model="), b)
    alter = (
        F.when(F.col("_column").isNull(), F.concat(F.lit("column missing: "), "column_name"))
        .when((F.coalesce("max_length", F.lit(0)) > 0) & (F.coalesce("_size", F.lit(0)) > 0) & (F.col("_size") != F.col("max_length")), mismatch("length", F.col("_size").cast("string"), F.col("max_length").cast("string")))
        .when(F.col("is_null").isNotNull() & F.col("_null").isNotNull() & (F.col("is_null") != F.col("_null")), mismatch("null", bool_text("_null"), bool_text("is_null")))
        .when(F.col("default_value").isNotNull() & ~F.col("default_value").eqNullSafe(F.col("_default")), mismatch("default", text("_default"), text("default_value")))
        .when(F.col("is_unique") & F.col("_alone").isNull(), "missing unique index")
    )
    kind = F.col("op_type")
    fault = (
        F.when(F.col("_table").isNull(), "table missing")
        .when((kind == "AddField") & F.col("_column").isNull(), "column missing")
        .when(kind == "AlterField", alter)
        .when((kind == "AddIndex") & F.col("_index").isNull(), F.when(F.col("is_safe"), "").otherwise(F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit("unsafe index"))))
    )
    return rows.select("id", "op_type", "model", F.when(fault.isNull(), "applied").otherwise("missing").alias("status"), F.coalesce(fault, F.lit("")).alias("reason"))


def operation_summary(statuses: DataFrame) -> DataFrame:
    """Counts of the operations of each kind and model."""
    is_ = lambda v: F.count_if(F.col("status") == v).alias(v)
    return statuses.groupBy("op_type", "model").agg(F.count("*").alias("operations"), is_("applied"), is_("missing"))


def statement_kind(sql: Column) -> Column:
    """The kind of a statement: one of the known beginnings with underscores, else its first word."""
    text = F.upper(F.trim(F.coalesce(sql, F.lit(""))))
    out = F.when(text == "", "")
    for start in STATEMENTS:
        out = out.when(F.startswith(text, F.lit(start)), start.replace(" ", "_"))
    return out.otherwise(F.split(text, "\\s+")[0])
