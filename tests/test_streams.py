"""Streams in batches: what they fold, and how they are cut."""

import pandas as pd
from pyspark.sql import functions as F

from rivulet import queries_stream
from rivulet.operators import dedup
from rivulet.session import scratch
from rivulet.streaming import pipeline, stateful

ROWS = [(i, i % 7 if i % 3 else 1, ("insert", "update", "delete")[i * 5 % 3]) for i in range(200)]


def test_compaction_folds_batches_without_a_call_for_each_key(spark, monkeypatch):
    monkeypatch.setattr(queries_stream, "FILE_ROWS", 10)
    path, stream = queries_stream._files(spark.createDataFrame(ROWS, "id long, pk long, op string"))
    assert len(spark.read.parquet(path).inputFiles()) == 20
    folded = pipeline.compacted(stream)
    assert "InPandas" not in folded._jdf.queryExecution().analyzed().toString()
    out = scratch(spark, "compacted")
    query = pipeline.run(folded, scratch(spark, "checkpoint"), pipeline.appender(out), mode="update")
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 4
    got = spark.read.parquet(out).groupBy("pk").agg(F.max_by(F.struct("events", "first_op", "last_op", "last_id"), "events").alias("r")).select("pk", "r.*")
    of = {k: [r for r in ROWS if r[1] == k] for k in range(7)}
    assert sorted(tuple(r) for r in got.collect()) == [(k, len(h), h[0][2], h[-1][2], h[-1][0]) for k, h in of.items() if h]


def test_repeats_are_found_without_a_broadcast(spark):
    rows = spark.createDataFrame([(i, i % 150) for i in range(200)], "id long, v long")
    found = dedup.exact_duplicates(rows, dedup.business_signature("v"))
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    assert {r.id: r.survivor_id for r in found.collect()} == {i: i % 150 for i in range(200)}


class State:
    """A value or list of state that counts how often it is asked."""

    def __init__(self):
        self.held, self.calls = None, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name in ("get", "exists"):
                return self.held is not None if name == "exists" else self.held
            if name in ("update", "appendList"):
                self.held = args[0] if name == "update" else [*(self.held or []), *args[0]]
            if name == "containsKey":
                return False
            return []

        return call


class Handle(State):
    def __init__(self):
        super().__init__()
        self.made = []

    def getValueState(self, *_):
        self.made.append(State())
        return self.made[-1]

    getListState = getMapState = getValueState


def test_state_is_asked_once_for_a_key_and_batch():
    handle, own = Handle(), stateful._Histories(1000)
    own.init(handle)
    batch = lambda low: pd.DataFrame([(i, "update", f"s{i % 700}", i) for i in range(low, low + 500)], columns=["id", "op", "signature", "at"])
    for low in (0, 500):
        assert list(own.handleInputRows((1,), iter([batch(low)]), None)) == []
    assert own.history.get()[:7] == (700, 300, 0, "update", 699, "update", 699)
    assert handle.calls + sum(s.calls for s in handle.made) < 20


def test_long_parts_are_written_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(queries_stream, "FILE_ROWS", 2000)
    stream = queries_stream._in_order(spark.range(9000), F.when(F.col("id") == 0, 2).otherwise((F.col("id") % 2).cast("int")), 3)
    seen = []
    pipeline.run(stream, scratch(spark, "checkpoint"), lambda b, n: seen.append({r.p for r in b.select((F.col("id") % 2 + F.when(F.col("id") == 0, 2).otherwise(0)).alias("p")).distinct().collect()})).awaitTermination()
    assert seen == [{0}, {1}, {2}]


def test_histories_need_no_call_for_each_key(spark, monkeypatch):
    plans, run = [], pipeline.run
    monkeypatch.setattr(pipeline, "run", lambda stream, *args, **named: plans.append(stream._jdf.queryExecution().analyzed().toString()) or run(stream, *args, **named))
    queries_stream.stream_histories(spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and "TransformWithState" not in plans[0] and "UDF" not in plans[0]


def test_dated_histories_do_not_depend_on_how_the_stream_is_cut(spark):
    day, ops = 86_400, ("insert", "update", "delete")
    first = [(i, i % 9, ops[i // 9 % 3], day + i) for i in range(90)]
    again = [(i + 1000, k, op, at) for i, k, op, at in first if i % 4 == 0]
    after = [(i + 2000, k, op, at + day) for i, k, op, at in first if k < 4]
    late, end = [(i + 3000, 5, "insert", day + i) for i in range(3)], [(9999, -1, "update", 9 * day)]

    def closed(*parts):
        rows = [(i, k, op, f"{k} {op} {at}", at, n) for n, part in enumerate(parts) for i, k, op, at in part]
        df = spark.createDataFrame(rows, "id long, pk long, op string, signature string, s long, part int")
        stream = queries_stream._in_order(df.withColumn("ts", F.timestamp_seconds("s")), F.col("part"), len(parts))
        out = scratch(spark, "histories")
        query = pipeline.run(stateful.dated_histories(stream, late="10 minutes", keep=1000), scratch(spark, "checkpoint"), pipeline.appender(out))
        query.awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(out).select(*(c.split(" ")[0] for c in stateful.HISTORY.split(", "))).collect()), stateful.dropped(query)

    def folded(rows, repeats):
        for k in {r[1] for r in rows}:
            h = sorted(r for r in rows if r[1] == k)
            updates = [r[0] for r in h if r[2] == "update"]
            yield (k, len(h), sum(r[1] == k for r in repeats), h[0][0], h[0][2], h[-1][0], h[-1][2], updates[-1], *(sum(r[2] == op for r in h) for op in ops))

    want = sorted([*folded(first, again), *folded(after, [])])  # keys 0 to 3 have two histories each
    # late rows are told by the watermark that the batch before the last left
    assert closed(first, again, after[:20], after[20:], late, end) == (want, 3)
    assert closed(again[:5] + first[::2], first[1::2] + again[5:] + after, end) == (want, 0)
