"""Blocked sequence operators against plain loops, with blocks much smaller than the history."""

import random

import pytest
from pyspark.sql import functions as F

from rivulet.operators import ordered


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    ids = sorted(rng.sample(range(1, 4000), 300))
    return [(i, rng.choice("ab"), rng.choice([None, 1, 2, 7]), rng.choice([None, "x", "y"])) for i in ids]


def df(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, v int, s string")


@pytest.mark.parametrize("width", [1, 50, 10_000])
def test_running_sum_and_carried(spark, rows, width):
    got = ordered.running_sum(df(spark, rows), F.col("v"), "id", "total", ("g",), width)
    got = ordered.carried_all(got, {"last": F.col("s")}, "id", ("g",), width)
    got = ordered.carried(got, F.col("s"), "id", "before", ("g",), width, inclusive=False)
    out = {r.id: (r.total, r.last, r.before) for r in got.collect()}
    state = {"a": [0, None], "b": [0, None]}
    for i, g, v, s in rows:
        before = state[g][1]
        state[g][0] += v or 0
        state[g][1] = s or before
        assert out[i] == (state[g][0], state[g][1], before)


@pytest.mark.parametrize("width", [7, 10_000])
def test_wagons(spark, rows, width):
    got = {r.id: (r.wagon_seq, r.wagon_event_index) for r in ordered.wagons(df(spark, rows), ["g"], 2, width=width).collect()}
    seq, index, last = 0, 0, None
    for i, g, *_ in rows:
        if g != last or index == 2:
            seq, index = seq + 1, 0
        index, last = index + 1, g
        assert got[i] == (seq, index)


@pytest.mark.parametrize("width", [7, 10_000])
def test_file_indexes(spark, rows, width):
    got = {r.id: r.file_index for r in ordered.file_indexes(df(spark, rows), "v", 40, "id", width).collect()}
    index, last = 0, None
    for i, _, v, _ in rows:
        if v is not None:
            if last is not None and v < last:
                index += 1
            last = v
        assert got[i] == min(index, 39)


def test_latest_keeps_ties_apart(spark):
    rows = [(1, "a", 5, None), (2, "a", 5, None), (3, None, 1, None)]
    assert {r.id for r in ordered.latest(df(spark, rows), ["g"], "v", "id").collect()} == {2, 3}
    assert {r.id for r in ordered.all_but_latest(df(spark, rows), ["g"], "v", "id").collect()} == {1}


def test_long_histories_have_more_partitions(spark, rows, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 20)
    blocks = ordered.Blocks(df(spark, rows), "id")
    assert blocks.parts == 15
    blocks.level(sums={"n": F.lit(1)}, carries={"last": F.col("s")}).level(descents={"d": F.col("v")}, before={"m": F.col("n")})
    out = blocks.done()
    assert out.rdd.getNumPartitions() == 15
    last, d, v = None, 0, None
    for n, (r, (i, _, x, s)) in enumerate(zip(out.orderBy("id").collect(), rows, strict=True), 1):
        last, d, v = s or last, d + (x is not None and v is not None and x < v), v if x is None else x
        assert (r.id, r.n, r.last, r.d, r.m) == (i, n, last, d, n - 1 or None)


def test_blocks_of_a_long_history_do_not_meet_in_a_partition(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 10)
    blocks = ordered.Blocks(spark.range(600), "id").level(sums={"n": F.lit(1)})
    held = blocks.rows.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("_block").alias("b")).collect()
    assert blocks.parts == 60 and max(r.b for r in held) == 1
    assert blocks.done().where("n = id + 1").count() == 600
