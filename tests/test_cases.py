"""Small literal cases of the change-data semantics."""

import os

import pytest
from pyspark.sql import functions as F

from rivulet.functions import codec, text
from rivulet.operators import dedup, snapshot, transport, versioned
from rivulet.operators.apply import current_state, merged, partial_state
from rivulet.session import scratch
from rivulet.sources import logtext


@pytest.mark.parametrize(
    "ops, want",
    [
        (["insert", "update", "delete"], ["neutralized"] * 3),
        (["insert", "update", "update"], ["survivor", "collapsed", "survivor"]),
        (["insert", "insert"], ["survivor", "collapsed"]),
        (["update", "update", "update"], ["collapsed", "collapsed", "survivor"]),
        (["update", "delete"], ["collapsed", "survivor"]),
        (["delete", "insert"], ["collapsed", "survivor"]),
        (["insert", "delete", "insert"], ["collapsed", "collapsed", "survivor"]),
        (["delete"], ["survivor"]),
    ],
)
def test_compaction(spark, ops, want):
    events = spark.createDataFrame([(i, op, 1, str(i)) for i, op in enumerate(ops)], "id long, op string, pk long, v string")
    got = dedup.decisions(events, dedup.business_signature("op", "v")).orderBy("id").collect()
    assert [r.decision_type for r in got] == want


def test_keyless_and_exact(spark):
    events = spark.createDataFrame([(1, "insert", None, "a"), (2, "insert", 5, "b"), (3, "insert", 5, "b")], "id long, op string, pk long, v string")
    got = {r.id: r.decision_type for r in dedup.decisions(events, dedup.business_signature("op", "pk", "v")).collect()}
    assert got == {1: "survivor", 2: "survivor", 3: "exact_duplicate"}


def test_transport_order(spark):
    rows = [(1, 1, "pending", "dml", ""), (2, 1, "pending", "ddl", "table"), (3, 1, "pending", "ddl", "database"), (4, 1, "pending", "ddl", "column"), (5, 1, "sent", "ddl", "database")]
    events = spark.createDataFrame(rows, "id long, service_id long, status string, event_family string, object_type string")
    assert [r.id for r in transport.transport_order(events).orderBy("transport_order").collect()] == [3, 2, 4, 1]


def test_apply_of_compacted_histories(spark):
    rows = [(1, 1, "insert", "a"), (2, 1, "update", "b"), (3, 2, "insert", "c"), (4, 2, "delete", None), (5, 3, "update", "d"), (6, 3, "update", "e")]
    events = spark.createDataFrame(rows, "id long, pk long, op string, v string")
    kept = dedup.decisions(events, dedup.business_signature("op", "pk", "v")).where("decision_type = 'survivor'")
    state = lambda df: sorted(map(tuple, current_state(df, "pk", "id", "op", ["v"]).collect()))
    assert state(events) == state(kept) == [(1, 2, "b"), (3, 6, "e")]
    target = spark.createDataFrame([(2, "old"), (9, "stays")], "pk long, v string")
    assert sorted(map(tuple, merged(target, events, "pk", "id", "op").collect())) == [(1, "b"), (3, "e"), (9, "stays")]
    partial = spark.createDataFrame([(1, 1, "insert", "a", None), (2, 1, "update", None, "x")], "id long, pk long, op string, v string, w string")
    assert [(r.v, r.w) for r in partial_state(partial, "pk", "id", "op", ["v", "w"]).collect()] == [("a", "x")]


def test_codecs_refuse_what_they_do_not_know(spark):
    for args in (("gzip", "none"), ("none", "rot13"), ("none", "xor", " ")):
        with pytest.raises(ValueError):
            codec.encoded(F.lit("x"), *args)


def test_clauses(spark):
    got = spark.range(1).select(text.clauses(F.lit("ADD c DECIMAL(10,2) DEFAULT (f(a,b),1), DROP d,, ")).alias("c")).first().c
    assert got == ["ADD c DECIMAL(10,2) DEFAULT (f(a,b),1)", "DROP d"]


def test_copies(spark):
    """Snapshot copies: append, truncate with the table's columns, recreate with the source's, dry run."""
    out = scratch(spark, "copy")
    rows = spark.range(10).selectExpr("id", "id * 2 as v")
    counts = lambda df: tuple(df.first())
    assert counts(snapshot.copied(rows, out, dry_run=True)) == ("dry_run", 10, 0)
    assert counts(snapshot.copied(rows, out)) == ("copied", 10, 10)
    assert counts(snapshot.copied(rows, out, like="id < 3")) == ("copied", 3, 13)
    other = spark.range(4).selectExpr("id", "'x' as w")
    assert counts(snapshot.copied(other, out, "truncate")) == ("copied", 4, 4) and versioned.read(spark, out).columns == ["id", "v"]
    assert counts(snapshot.copied(other, out, "recreate")) == ("copied", 4, 4) and versioned.read(spark, out).columns == ["id", "w"]
    with pytest.raises(ValueError):
        snapshot.copied(rows, out, "merge")


def test_schema_after_changes(spark):
    tables = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "c")], "table_name string, column_name string")
    rows = [(1, 0, "t", "column", "alter", "d"), (2, 0, "t", "column", "drop", "a"), (3, 0, "u", "table", "drop", "u"), (4, 0, "v", "table", "create", "v"), (5, 0, "v", "column", "alter", "x"), (6, 0, "t", "index", "create", "ix"), (7, 0, "t", "column", "alter", "a"), (7, 1, "t", "column", "drop", "b")]
    changes = spark.createDataFrame(rows, "id long, clause_no int, table_name string, object_type string, ddl_action string, object_name string")
    got = {tuple(r) for r in snapshot.schema_after(tables, changes).collect()}
    assert got == {("t", "a"), ("t", "d"), ("v", "x")}
    assert {(r.id, r.undo) for r in snapshot.rollback_set(changes).collect()} >= {(4, "drop"), (3, "impossible"), (1, "review")}


def test_log_lines_keep_their_order(spark):
    """Lines of several files of different sizes: numbered by file name and place in the file."""
    out = scratch(spark, "logs")
    want = []
    folder = out.removeprefix("file://")
    os.makedirs(folder)
    for name, n in (("bin.000001.txt", 50), ("bin.000002.txt", 40_000), ("bin.000003.txt", 3)):
        own = [f"{name} line {i}" for i in range(n)]
        want += own
        with open(f"{folder}/{name}", "w") as f:
            f.write("\n".join(own) + "\n")
    with_conf = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = [r.line for r in logtext.lines(spark, out).orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", with_conf)
    assert got == want
