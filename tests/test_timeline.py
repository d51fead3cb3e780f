"""Rows and schema changes from one stream, applied to written tables."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rivulet import queries_apply
from rivulet.operators import delivery, timeline, versioned
from rivulet.session import scratch

CHANGES = "id long, table_name string, op string, pk long, after map<string,string>"
DDL = "id long, clause_no int, table_name string, object_type string, ddl_action string, object_name string, columns array<string>"


def add(i, column, action="alter", table="t"):
    return (i, 0, table, "column", action, column, None)


def row(i, op, pk, **after):
    return (i, "t", op, pk, after or None)


@pytest.fixture
def apply(spark):
    root = scratch(spark, "target")
    versioned.commit(spark.createDataFrame([(1, "1", "x")], "_pk long, id string, a string"), f"{root}/t", "load")

    def run(changes, ddl, source=(), columns=()):
        source = spark.createDataFrame([("t", pk, r) for pk, r in source], "table_name string, pk long, row map<string,string>")
        columns = spark.createDataFrame([("t", c) for c in columns], "table_name string, column_name string")
        told = timeline.apply_once(spark, root, spark.createDataFrame(changes, CHANGES), spark.createDataFrame(ddl, DDL), source, columns)
        out = {r.id: r.last_error or r.cause or r.status for r in told.collect()}
        table = dict(timeline.tables(spark, root)).get("t")
        return out, None if table is None else sorted(tuple(r) for r in table.collect()), table and table.columns

    run.root = root
    return run


def test_a_row_before_its_column_applies_what_is_pending(apply):
    told, rows, columns = apply([row(1, "insert", 2, id="2", b="y"), row(3, "update", 1, a="z"), row(4, "insert", 3, id="3", c="q")], [add(2, "b")])
    assert told == {1: "pending_ddl", 3: "applied", 4: "schema_missing_column"}
    assert columns == ["_pk", "id", "a", "b"] and rows == [(1, "1", "z", None), (2, "2", None, "y")]


def test_a_column_dropped_and_added_again_is_empty(apply):
    told, rows, _ = apply([row(3, "update", 1, id="1")], [add(1, "a", "drop"), add(2, "a")])
    assert told == {3: "applied"} and rows == [(1, "1", None)]


def test_a_missing_table_is_filled_from_its_source(apply):
    drop = (1, 0, "t", "table", "drop", "t", None)
    told, rows, columns = apply([row(2, "update", 7, v="new"), row(3, "insert", 8, id="8", v="w"), row(4, "delete", 9)], [drop], [(7, {"id": "7", "v": "old"}), (9, {"id": "9"})], ["id", "v"])
    assert told == {2: "bootstrap", 3: "applied", 4: "applied"}
    assert columns == ["_pk", "id", "v"] and rows == [(7, "7", "new"), (8, "8", "w")]
    again, rows, _ = apply([row(2, "delete", 7), row(5, "insert", 7, id="7")], [])
    assert again == {5: "duplicate_key"} and rows == [(7, "7", "new"), (8, "8", "w")]


def test_without_a_source_a_missing_table_fails_rows_until_it_is_created(apply):
    ddl = [(1, 0, "t", "table", "drop", "t", None), (3, 0, "t", "table", "create", "t", ["id"])]
    told, rows, columns = apply([row(2, "insert", 2, id="2"), row(4, "insert", 2, id="2")], ddl)
    assert told == {2: "table_missing", 4: "applied"} and (rows, columns) == ([(2, "2")], ["_pk", "id"])
    assert apply([], [(5, 0, "t", "table", "drop", "t", None)])[1] is None
    assert apply([row(6, "insert", 1, id="1")], [])[0] == {6: "table_missing"}


def test_a_run_that_broke_off_is_repeated(spark, apply, monkeypatch):
    changes = [row(1, "insert", 2, id="2"), row(2, "update", 1, a="n")]
    inner = versioned._switch
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(versioned, "_switch", lambda s, t, v: (_ for _ in ()).throw(RuntimeError("lost")) if t.endswith("_checkpoint") else inner(s, t, v))
        apply(changes, [])
    assert timeline.checkpoint(spark, apply.root) == -1
    told, rows, _ = apply(changes, [])
    assert told == {1: "applied", 2: "applied"} and rows == [(1, "1", "n"), (2, "2", None)]
    assert timeline.checkpoint(spark, apply.root) == 2


def test_a_walk_passes_each_schema_change_once():
    n = 20_000
    clause = [{"object_type": "column", "ddl_action": "alter", "object_name": "b"}]
    rows = [("t", 0, 0, -1, "target", None, ["id"])]
    rows += [("t", 0, i // 2 + 1, i, "ddl", clause, None) if i % 2 == 0 else ("t", 0, i // 2 + 1, i, "shape", None, ["id", "unknown"]) for i in range(2 * n)]
    began = time.process_time()
    out = timeline._walk(pd.DataFrame(rows, columns=["table_name", "stretch", "epoch", "id", "kind", "clauses", "columns"]))
    assert time.process_time() - began < 8
    assert out["cause"].value_counts().to_dict() == {"ddl": n, "start": 1, "pending_ddl": 1}


def test_many_lives_do_not_multiply_the_source(apply, monkeypatch):
    lives, keys, asked = 30, 20, []
    inner = timeline.applied_batch
    monkeypatch.setattr(timeline, "applied_batch", lambda target, *a, **k: asked.append(target.count()) or inner(target, *a, **k))
    ddl = [(10 * i, 0, "t", "table", "drop", "t", None) for i in range(lives)]
    changes = [row(10 * i + 1, "insert", i % 40, id="x") for i in range(lives)] + [row(10 * i + 2, "delete", i % 40) for i in range(lives)]
    told, rows, _ = apply(changes, ddl, [(pk, {"id": str(pk)}) for pk in range(keys)], ["id"])
    assert [told[10 * i + 1] for i in range(lives)] == ["duplicate_key" if i < keys else "bootstrap" for i in range(lives)]
    assert {told[10 * i + 2] for i in range(lives)} == {"applied"}
    assert rows == [(pk, str(pk)) for pk in range(keys)]
    assert asked[0] <= 1 + 2 * lives  # the target's row and the changes that meet a row of the source


def test_the_stream_reads_each_event_once(spark):
    for df in (df for n, df in enumerate(queries_apply.stream(spark, "/root/testdata/sf0.001")) if n in (0, 2)):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_an_inbox_is_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(i):
        seen.add(1)
        return i

    inbox = spark.range(200).select("id", counted(F.col("id") % 50).alias("k"), F.lit("insert").alias("op")).groupBy("k", "id").agg(F.max("op").alias("op"))
    done = delivery.applied_batch(spark.createDataFrame([(7,)], "k long"), inbox, "k")
    assert done.where("status = 'applied'").count() == 49
    assert seen.value == 200
