"""Apply of row changes and schema changes from one ordered stream: each row is judged by the schema at its position.

A table's schema is a timeline of intervals. It changes with each schema change of the table, and at two kinds of rows:

* the first row that meets no table: the table is bootstrapped, that is created with the source's columns and filled with
  the source's rows, and the row is applied to that;
* the first row with a column that the table lacks while column changes of the table are still to come: these, up to the
  next create or drop of the table, are applied at once (and not again when their turn comes), and then the row.

What still does not fit fails: schema_missing_column, or table_missing where there is no source.

Of the rows only few can change a schema: between two schema changes of a table, the first row of each set of columns. So
rows are reduced to these by an aggregation, a table's timeline is walked over that (a row for each schema change and set
of columns), and returns to the rows by an equality join on table and epoch, the number of its schema changes so far.
A drop of a table ends what its schema can depend on, so the stretches between drops are walked side by side, each in one
pass; only the number of lives before a stretch is summed up afterwards. Epochs and stretches are counted through blocks,
so neither a large table nor a key with much history is one task's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators import versioned
from rivulet.operators.delivery import applied_batch
from rivulet.operators.ordered import Blocks, running_sum
from rivulet.session import staged

INTERVALS = "table_name string, stretch long, epoch long, from_id long, there boolean, life long, columns array<string>, since array<long>, cause string, step int"
_DROPPED = "_dropped"  # the one column of a table that is dropped


class _Table:
    """The schema of one table as it goes along."""

    def __init__(self, columns: list[str] | None):
        self.columns = None if columns is None else dict.fromkeys(columns, -1)  # column: since when; None: no table
        self.life = 0

    def change(self, at: int, kind: str, action: str, name: str, columns: list[str]) -> None:
        if kind == "table" and action in ("create", "drop"):
            if action == "drop" or self.columns is None:
                self.columns, self.life = (None if action == "drop" else dict.fromkeys(columns, at)), self.life + 1
        elif kind == "column" and self.columns is not None:
            if action == "drop":
                self.columns.pop(name, None)
            else:
                self.columns.setdefault(name, at)


def _walk(history: pd.DataFrame) -> pd.DataFrame:
    """The intervals of one stretch of a table's timeline, from its schema changes and the first rows of each set of
    columns; lives are counted from the stretch's beginning. Each schema change is passed once, early or on its turn."""
    rows = sorted(history.itertuples(), key=lambda x: x.id)
    name, stretch = rows[0].table_name, rows[0].stretch
    columns = lambda k: next(([*x.columns] for x in rows if x.kind == k), None)
    table, source = _Table(columns("target")), columns("source")
    ddl = [([(c["object_type"], c["ddl_action"], c["object_name"]) for c in x.clauses], [*x.columns] if x.columns is not None else []) for x in rows if x.kind == "ddl"]
    whole = [any(k == "table" and a in ("create", "drop") for k, a, _ in clauses) for clauses, _ in ddl]
    stop = [len(ddl)] * (len(ddl) + 1)  # of each place the next schema change of the whole table
    for i in reversed(range(len(ddl))):
        stop[i] = i if whole[i] else stop[i + 1]
    turn = early = 0  # the schema change whose turn is next; those before early are applied
    out: list[tuple] = []

    def note(epoch: int, at: int, cause: str) -> None:
        own = table.columns
        out.append((name, stretch, epoch, at, own is not None, table.life, [*(own or {})], [*(own or {}).values()], cause, len(out)))

    def apply(i: int, at: int) -> None:
        clauses, made = ddl[i]
        for c in clauses:
            table.change(at, *c, made)

    if stretch == 0:
        note(0, -1, "start")
    for x in sorted((x for x in rows if x.kind in ("ddl", "shape")), key=lambda x: (x.id, x.kind)):
        if x.kind == "ddl":
            if turn >= early:
                apply(turn, x.id)
            turn += 1
            note(x.epoch, x.id, "ddl")
            continue
        if table.columns is None and source is not None:
            table.columns, table.life = dict.fromkeys(source, x.id), table.life + 1
            note(x.epoch, x.id, "bootstrap")
        if table.columns is not None and set(x.columns) - set(table.columns):
            pending = range(max(turn, early), stop[turn])
            for i in pending:
                apply(i, x.id)
            if pending:
                early = pending.stop
                note(x.epoch, x.id, "pending_ddl")
    return pd.DataFrame(out, columns=[f.split(" ")[0] for f in INTERVALS.split(", ")])


def judged(changes: DataFrame, ddl: DataFrame, target: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes with verdict, cause, life and since; the intervals of all tables).

    changes: id, table_name, op, pk, after (map; null for deletes). ddl: id, clause_no, table_name, object_type, ddl_action,
    object_name and columns (of a created table). target, source: (table_name, column_name) of the tables that are there
    and of those that can be bootstrapped. verdict: null if the row fits, else why not.
    """
    clause = F.struct("object_type", "ddl_action", "object_name")
    said = F.array_sort(F.collect_list(F.struct("clause_no", clause.alias("c"))))
    drops = F.min_by((F.col("object_type") == "table") & (F.col("ddl_action") == "drop"), "clause_no").cast("int")  # and what comes before does not matter
    marks = ddl.groupBy("table_name", "id").agg(F.transform(said, lambda x: x["c"]).alias("_clauses"), F.first("columns", ignorenulls=True).alias("_columns"), drops.alias("_drop"), F.lit(1).alias("_ddl"))
    placed = Blocks(changes.withColumn("_ddl", F.lit(0)).unionByName(marks, allowMissingColumns=True), "id", ("table_name",))
    placed = staged(placed.level(sums={"epoch": F.col("_ddl"), "stretch": F.col("_drop")}).done(), "epochs")
    rows = placed.where("_ddl = 0").select(*changes.columns, "epoch", "stretch")
    shape = F.when(F.col("op") == "delete", F.array().cast("array<string>")).otherwise(F.array_sort(F.map_keys("after")))
    shapes = rows.groupBy("table_name", "stretch", "epoch", shape.alias("columns")).agg(F.min("id").alias("id"))
    none = F.lit(None).cast("array<struct<object_type: string, ddl_action: string, object_name: string>>")
    names = lambda t, kind: t.groupBy("table_name").agg(F.collect_list("column_name").alias("columns")).select("table_name", F.lit(0).cast("long").alias("stretch"), F.lit(0).cast("long").alias("epoch"), F.lit(-1).cast("long").alias("id"), F.lit(kind).alias("kind"), none.alias("clauses"), "columns")
    events = shapes.select("table_name", "stretch", "epoch", "id", F.lit("shape").alias("kind"), none.alias("clauses"), "columns")
    events = events.unionByName(placed.where("_ddl = 1").select("table_name", "stretch", "epoch", "id", F.lit("ddl").alias("kind"), F.col("_clauses").alias("clauses"), F.col("_columns").alias("columns")))
    events = staged(events, "schema-events")
    sources = events.select("table_name", "stretch").distinct().join(names(source, "source").drop("stretch"), "table_name")
    events = events.unionByName(names(target, "target")).unionByName(sources)
    walked = staged(events.groupBy("table_name", "stretch").applyInPandas(_walk, INTERVALS), "walked")
    lives = running_sum(walked.groupBy("table_name", "stretch").agg(F.max("life").alias("_own")), F.col("_own"), "stretch", "_upto", ("table_name",))
    intervals = walked.join(lives, ["table_name", "stretch"]).withColumn("life", F.col("life") + F.col("_upto") - F.col("_own"))
    intervals = staged(intervals.select(*walked.columns), "intervals")
    in_epoch = intervals.groupBy("table_name", "epoch").agg(F.array_sort(F.collect_list(F.struct("step", "from_id", "life", "there", "columns", "cause"))).alias("_i"))
    rows = rows.join(in_epoch, ["table_name", "epoch"]).withColumn("_at", F.element_at(F.filter("_i", lambda i: i["from_id"] <= F.col("id")), -1))
    fits = F.size(F.array_except(F.when(F.col("op") == "delete", F.array().cast("array<string>")).otherwise(F.map_keys("after")), F.col("_at.columns"))) == 0
    verdict = F.when(~F.col("_at.there"), "table_missing").when(~fits, "schema_missing_column")
    cause = F.when(verdict.isNull() & (F.col("_at.from_id") == F.col("id")), F.col("_at.cause"))
    return rows.select(*changes.columns, verdict.alias("verdict"), cause.alias("cause"), F.col("_at.life").alias("life")), intervals


def final_columns(intervals: DataFrame) -> DataFrame:
    """(table_name, life, columns, since) at the end of each timeline whose table is there."""
    last = intervals.groupBy("table_name").agg(F.max_by(F.struct("there", "life", "columns", "since"), F.struct("epoch", "step")).alias("l"))
    return last.where("l.there").select("table_name", "l.life", "l.columns", "l.since")


def target_after(judged_rows: DataFrame, intervals: DataFrame, target: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((table_name, pk, row) of the tables after the changes, changes with status and last_error).

    target, source: (table_name, pk, row) as they were. Rows that fit are applied one after the other: an insert of a key
    that is there fails, an update or delete of none changes nothing. A column that was dropped and added again is null
    until it is written again. A row (a map) has the columns of its table that hold a value.
    """
    key = F.to_json(F.struct("table_name", "life", "pk"))
    ends = final_columns(intervals)
    # rows that a life of a table starts with: the target's in the first, the source's in those that a bootstrap began. Of
    # the many lives only the last one's rows are written out; before, it is enough to ask which keys of changes are there
    begun = intervals.where("cause = 'bootstrap'").select("table_name", "life", F.col("from_id").alias("id"))
    first = target.select("table_name", "pk", "row", F.lit(0).cast("long").alias("life"), F.lit(-1).cast("long").alias("id"))
    base = first.unionByName(source.select("table_name", "pk", "row").join(begun.join(ends, ["table_name", "life"], "left_semi"), "table_name"))
    fit = judged_rows.where("verdict is null").withColumn("_key", key)
    filled = fit.join(begun, ["table_name", "life"], "left_semi").join(source, ["table_name", "pk"], "left_semi")
    done = staged(applied_batch(first.select(key.alias("_key")).unionByName(filled.select("_key")), fit, "_key"), "done")
    effect = done.where("status = 'applied' and last_error is null")
    every = base.select("table_name", "life", "pk", "id", F.lit("insert").alias("op"), F.col("row").alias("after"), (2 * F.col("id")).alias("o"))
    every = every.unionByName(effect.select("table_name", "life", "pk", "id", "op", "after", (2 * F.col("id") + 1).alias("o")))  # the row after what it begins with
    every = every.join(ends, ["table_name", "life"])
    last = every.groupBy("table_name", "pk").agg(F.max_by("op", F.when(F.col("op") != "update", F.col("o"))).alias("last"), F.max(F.when(F.col("op") == "insert", F.col("o"))).alias("born"))
    alive = last.where("last = 'insert'").select("table_name", "pk", "born")
    cells = every.where("op <> 'delete'").select("table_name", "pk", "id", "o", "columns", "since", F.explode("after").alias("column", "value"))
    since = F.element_at(F.map_from_arrays("columns", "since"), F.col("column"))
    cells = cells.where(F.array_contains("columns", F.col("column"))).where(F.col("id") >= since).join(alive, ["table_name", "pk"]).where("o >= born")
    cells = cells.groupBy("table_name", "pk", "column").agg(F.max_by(F.struct("value"), "o").alias("v")).where("v.value is not null")
    held = cells.groupBy("table_name", "pk").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "v.value")))).alias("row"))
    none = F.create_map().cast("map<string,string>")
    rows = alive.select("table_name", "pk").join(held, ["table_name", "pk"], "left").withColumn("row", F.coalesce("row", none))
    bad = judged_rows.where("verdict is not null").select(*judged_rows.columns, F.lit("failed").alias("status"), F.col("verdict").alias("last_error"))
    return rows, done.select(*judged_rows.columns, "status", "last_error").unionByName(bad)


def checkpoint(spark: SparkSession, root: str) -> int:
    """The last id that was applied to the tables under root; -1 at first."""
    path = f"{root}/_checkpoint"
    return versioned.read(spark, path).agg(F.max("last_id")).first()[0] if versioned.version(spark, path) else -1


def _stored(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(table_name, pk, row) and (table_name, column_name) of the tables under root."""
    rows = spark.createDataFrame([], "table_name string, pk long, row map<string,string>")
    columns: list[tuple[str, str]] = []
    for name in sorted(versioned._names(spark, root)):
        if name.startswith("_") or _DROPPED in (table := versioned.read(spark, f"{root}/{name}")).columns:
            continue
        own = [c for c in table.columns if c != "_pk"]
        columns += [(name, c) for c in own]
        entries = F.filter(F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in own)), lambda e: e["v"].isNotNull()) if own else F.array().cast("array<struct<k: string, v: string>>")
        rows = rows.unionByName(table.select(F.lit(name).alias("table_name"), F.col("_pk").alias("pk"), F.map_from_entries(entries).alias("row")))
    return rows, spark.createDataFrame(columns, "table_name string, column_name string")


def apply_once(spark: SparkSession, root: str, changes: DataFrame, ddl: DataFrame, source: DataFrame, source_columns: DataFrame) -> DataFrame:
    """Apply what comes after the checkpoint to the versioned tables under root (one folder each, columns as text, _pk), move
    the checkpoint, and return the changes with status, last_error and cause.

    Every table is committed under the run's id, which is the last id, before the checkpoint is: a run that breaks off is
    repeated, finds the tables that it had done, and ends as if it had not. All is decided on the tables as of their last
    version of another run.
    """
    since = checkpoint(spark, root)
    changes, ddl = changes.where(F.col("id") > since), staged(ddl.where(F.col("id") > since), "ddl")
    last = changes.select("id").unionByName(ddl.select("id")).agg(F.max("id")).first()[0]
    if last is None:
        return changes.select("*", F.lit(None).cast("string").alias("cause"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("last_error"))
    run = f"to {last}"
    plan = f"{root}/_runs/{last}"
    if not versioned.version(spark, plan):  # what the run does is decided once
        rows, columns = _stored(spark, root)
        source = staged(source, "source")
        own, intervals = judged(changes, ddl, columns, source_columns)
        own = staged(own, "judged")
        after, told = target_after(own, intervals, rows, source)
        ends = final_columns(intervals).select("table_name", "columns")
        outcome = told.select("id", "table_name", "op", "pk", "cause", "status", "last_error")
        versioned.commit(outcome, f"{plan}-outcome", run)
        versioned.commit(intervals.select("table_name").distinct().join(ends, "table_name", "left"), f"{plan}-tables", run)
        versioned.commit(after, plan, run)
    after = versioned.read(spark, plan)
    for t in versioned.read(spark, f"{plan}-tables").collect():  # a row for each table of the catalog
        path = f"{root}/{t.table_name}"
        own = after.where(F.col("table_name") == t.table_name)
        if t.columns is not None:
            versioned.commit(own.select(F.col("pk").alias("_pk"), *(F.try_element_at("row", F.lit(c)).alias(c) for c in t.columns)), path, run)
        elif versioned.version(spark, path):
            versioned.commit(spark.createDataFrame([], f"{_DROPPED} int"), path, run)
    versioned.commit(spark.createDataFrame([(last,)], "last_id long"), f"{root}/_checkpoint", run, "append")
    return versioned.read(spark, f"{plan}-outcome")


def tables(spark: SparkSession, root: str) -> Iterator[tuple[str, DataFrame]]:
    """The tables under root."""
    for name in sorted(versioned._names(spark, root)):
        if not name.startswith("_") and _DROPPED not in (table := versioned.read(spark, f"{root}/{name}")).columns:
            yield name, table
