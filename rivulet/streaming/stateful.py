"""State of keys over micro-batches: compaction of a key's pending history with timers, and receipt that counts what is late.

Where exact repeats have one time, dated_histories() does the compaction with streaming aggregations, which suit streams of
many keys. For repeats of any time, histories() (transformWithState) keeps a few numbers for each key with pending changes:
the first and the last change, the last update, counts by operation, and the hashes of the changes so far, which tell exact
repeats across batches. State is read and written once for a key and batch, not for each change, since every access is a
message to the JVM. A timer of event time closes the history, emits its outcome by the rules of dedup.key_histories() and
removes the state; what comes later begins a new one. So state is bounded by the keys that changed within the time allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rivulet.operators.transport import checksum_ok
from rivulet.streaming.pipeline import ROCKSDB, STORE

HISTORY = "pk long, events long, repeats long, first_id long, first_op string, last_id long, last_op string, last_update_id long, inserts long, updates long, deletes long"
_STATE = "events long, repeats long, first_id long, first_op string, last_id long, last_op string, last_update_id long, inserts long, updates long, deletes long, until long"


class _Histories(StatefulProcessor):
    """Rows (pk, id, op, signature, at) of one key."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history = handle.getValueState("history", _STATE)
        self.seen = handle.getListState("seen", "signature string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.history.get()
        h = list(old) if old is not None else [0, 0, None, None, None, None, None, 0, 0, 0, 0]
        seen = {s for (s,) in self.seen.get()} if old is not None else set()
        latest, fresh = 0, []
        for pdf in rows:
            for i, op, signature, at in sorted(zip(*(pdf[c].tolist() for c in ("id", "op", "signature", "at")))):
                latest = max(latest, at)
                if signature in seen:
                    h[1] += 1
                    continue
                seen.add(signature)
                fresh.append((signature,))
                h[0] += 1
                if h[2] is None or i < h[2]:
                    h[2], h[3] = i, op
                if h[4] is None or i > h[4]:
                    h[4], h[5] = i, op
                if op == "update":
                    h[6] = i if h[6] is None else max(h[6], i)
                h[7 + ("insert", "update", "delete").index(op)] += 1
        if fresh:
            self.seen.appendList(fresh)
        until = latest + self.keep_ms
        if until > h[10]:
            if old is not None:
                self.handle.deleteTimer(h[10])
            h[10] = until
            self.handle.registerTimer(until)
        self.history.update(tuple(h))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        h = self.history.get()
        names = [c.split(" ")[0] for c in HISTORY.split(", ")]
        yield pd.DataFrame([(key[0], *h[:10])], columns=names)
        self.history.clear()
        self.seen.clear()

    def close(self) -> None:
        pass


def histories(stream: DataFrame, time: str = "ts", late: str = "0 seconds", keep: int = 3_600_000) -> DataFrame:
    """HISTORY of each key whose last change is keep milliseconds behind the watermark: what came of it until then, without
    exact repeats (same signature, of any batch). stream: pk, id, op, signature, and the time. State of several variables
    needs the RocksDB store, which is set in the session."""
    stream.sparkSession.conf.set(STORE, ROCKSDB)
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    rows = rows.withColumn("at", F.unix_millis(time))
    return rows.groupBy("pk").transformWithStateInPandas(_Histories(keep), HISTORY, "append", "eventTime")


def dated_histories(stream: DataFrame, time: str = "ts", late: str = "0 seconds", keep: int = 3_600_000) -> DataFrame:
    """histories() of a stream whose exact repeats have their change's time, as those of captured changes do, without a
    call for each key: two streaming aggregations. The first folds the changes of one key, signature and time before the
    shuffle, keeps them until the watermark passes their time, and hands each on once. The second has a session of each
    key, which ends late and keep milliseconds after its last change: where a timer ends it if changes come one by one in
    the order of their times. So what a history holds does not depend on the order and the batches, but for rows behind
    the watermark; dropped() counts those after the fold. State is kept by the RocksDB store."""
    stream.sparkSession.conf.set(STORE, ROCKSDB)
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    once = rows.groupBy("pk", "signature", time).agg(F.min(F.struct("id", "op")).alias("r"), (F.count("*") - 1).alias("again"))
    is_ = lambda name: F.col("op") == name
    own = once.select("pk", time, "again", "r.id", "r.op").groupBy("pk", F.session_window(time, f"{late} {keep} milliseconds")).agg(
        F.count("*").alias("events"),
        F.sum("again").alias("repeats"),
        F.min(F.struct("id", "op")).alias("first"),
        F.max(F.struct("id", "op")).alias("last"),
        F.max(F.when(is_("update"), F.col("id"))).alias("last_update_id"),
        *(F.count_if(is_(name)).alias(f"{name}s") for name in ("insert", "update", "delete")),
    )
    ends = (F.col(f"{end}.{c}").alias(f"{end}_{c}") for end in ("first", "last") for c in ("id", "op"))
    return own.select("pk", "events", "repeats", *ends, "last_update_id", "inserts", "updates", "deletes")


def outcomes(histories: DataFrame) -> DataFrame:
    """Histories with outcome and survivors, as dedup.key_histories() has them."""
    n = F.col("events")
    outcome = (
        F.when(n == 1, "single")
        .when((F.col("first_op") == "insert") & (F.col("last_op") == "delete"), "A")
        .when((F.col("first_op") == "insert") & (F.col("inserts") + F.col("updates") == n), "B")
        .when(F.col("updates") == n, "C")
        .when((F.col("last_op") == "delete") & (F.col("updates") + F.col("deletes") == n), "D")
        .otherwise("E")
    )
    out = histories.withColumn("outcome", outcome)
    first_kept = F.when(F.col("outcome").isin("single", "B"), F.col("first_id"))
    last_kept = F.when(F.col("outcome") == "B", F.col("last_update_id")).when(F.col("outcome") != "A", F.col("last_id"))
    return out.withColumn("first_kept", first_kept).withColumn("last_kept", last_kept)


def gated_once(stream: DataFrame, uid: str = "event_uid", service: str = "service_id", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Changes whose payload has its checksum (payload, checksum), once for each (service, uid) within the watermark; those
    behind it are dropped, and counted in the query's progress (numRowsDroppedByWatermark)."""
    rows = stream.where(F.coalesce(checksum_ok(stream), F.lit(False))).withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([service, uid])


def dropped(query) -> int:
    """How many rows came too late for the state of a query that has ended."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def most_state(query) -> int:
    """The most rows of state that a query that has ended ever held."""
    return max((int(s["numRowsTotal"]) for p in query.recentProgress for s in p["stateOperators"]), default=0)
