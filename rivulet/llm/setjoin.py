"""Exact components of a Jaccard join, from signatures that linked sets are sure to share.

A bucket of one signature is never expanded into pairs. First each member is compared with the bucket's least id (a
star), which settles groups of near copies. What is still apart then is compared within each signature that holds sets
of different components, once for signatures with the same members: in runs of at most 2 * BLOCK sets, a hot signature
in blocks against blocks. That is done by sketches (below) and names the sets that can link at all with one of another
component; these few are compared in full, once, among those that signatures hold together. Signatures with the same
least id are dealt to one place (to several if they hold many sets), which names sets only where that joins what it has
not joined before. Every link between different components is found.

Before sets move, their sketches do: a set's size and the parity of its number of elements in each of so many buckets.
Buckets of unlike parity hold a difference at least, so a sketch never rules out a pair that links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import least_labels, pieces, shuffle_parts, staged

#: Sets of a signature that are one block, and partners compared with one copy of a set.
BLOCK, PARTNERS = 512, 256
#: Members of the signatures with one least id that one place gets, and ids that it remembers to be joined.
DEALT, JOINED = 5_000, 200_000
#: Up to so many ids (8 bytes each) are broadcast to pick rows; above that the rows are shuffled.
BROADCAST_IDS = 1_000_000
STARS = "sig long, lead long, rid long"


def pick(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """rows whose key is (left_anti: is not) in ids (distinct): a broadcast if the ids are counted and few, else a shuffle."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, key, how)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (sig, rid): a row (sig, least rid, rid) for each member of a signature that two or more have."""
    last, lead, single = None, 0, False
    for batch in batches:
        sig, rid = (np.asarray(batch.column(c)) for c in (0, 1))
        if not len(sig):
            continue
        new = np.r_[last is None or sig[0] != last, sig[1:] != sig[:-1]]
        leads = np.r_[lead, rid[new]][np.cumsum(new)]
        second = ~new & np.r_[single, new[:-1]]  # where a run proves to have two, its first member follows
        out = (np.r_[sig[~new], sig[second]], np.r_[leads[~new], leads[second]], np.r_[rid[~new], leads[second]])
        last, lead, single = sig[-1], leads[-1], bool(new[-1])
        yield pa.record_batch([pa.array(x, pa.int64()) for x in out], ["sig", "lead", "rid"])


def stars(sigs: DataFrame) -> DataFrame:
    """(sig, lead, rid) of every signature that two or more rows of sigs (sig, rid) have."""
    n = shuffle_parts(sigs.sparkSession)
    return sigs.select("sig", "rid").repartition(n, "sig").sortWithinPartitions("sig", "rid").mapInArrow(_stars, STARS)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def sketch(elems: np.ndarray) -> bytes:
    """The size of a set, and the parities of 2 ** i >= size buckets (64 at least)."""
    m = max(64, 1 << max(0, len(elems) - 1).bit_length())
    odd = np.bincount((elems & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.r_[np.array([len(elems)], np.uint64), np.packbits(odd.astype(np.uint8)).view(np.uint64)].tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The parities of fewer buckets, 64 to a word."""
    while len(bits) > words:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def _links(num: int, den: int) -> Callable:
    """Whether two sets, as bytes, link."""

    def links(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        small, large = sorted((len(x), len(y)))
        if small * den < num * large:
            return False
        n = common(x, y)
        return den * n >= num * (small + large - n)

    return links


def _may_link(num: int, den: int) -> Callable:
    """Whether two sets can link by their sketches."""

    def may(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        small, large = sorted((int(x[0]), int(y[0])))
        if small * den < num * large:
            return False
        words = min(len(x), len(y)) - 1
        least = int(np.bitwise_count(folded(x[1:], words) ^ folded(y[1:], words)).sum())
        return least * (den + num) <= (small + large) * (den - num)

    return may


def _check(links: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in pieces(batches, rows=2048):
            a, b, elems = (batch.column(c) for c in (0, 1, 2))
            salts = batch.column(3).to_pylist()
            left, right = [], []
            for x, y, salt, raw in zip(a.to_pylist(), b.to_pylist(), salts, elems.to_pylist(), strict=True):
                if y is None:
                    key, own = (x, salt), raw
                elif key == (x, salt) and links(own, raw):
                    left.append(x)
                    right.append(y)
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, links: Callable) -> DataFrame:
    """The pairs (a, b) whose sets, or sketches, (rid, elems) link. A set with many partners is copied once for each
    PARTNERS of them, so no task gets all partners of one set."""
    hot = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("salts")).where("salts > 1")
    few = hot.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS  # a row for PARTNERS pairs at least
    dealt = pairs.join(F.broadcast(hot) if few else hot, "a", "left")
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).alias("salt"))
    other = dealt.join(sets.select(F.col("rid").alias("b"), "elems"), "b").select("a", "b", "elems", "salt")
    own = dealt.select("a", "salt").distinct().join(sets.select(F.col("rid").alias("a"), "elems"), "a")
    rows = own.select("a", F.lit(None).cast("long").alias("b"), "elems", "salt").unionByName(other)
    n = shuffle_parts(pairs.sparkSession)
    rows = rows.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_check(links), "a long, b long")


def seated(rows: DataFrame, count: DataFrame) -> DataFrame:
    """Rows (deal, task, side, sig, rid) of rows (sig, rid) whose sig is in count (sig, n, deal): one for each run that they
    sit in. The members of a signature are one run, or are dealt into blocks, of which every two are a run. Runs of equal
    deal go to one place."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    dealt = rows.join(count.withColumn("blocks", blocks), "sig").withColumn("own", F.pmod(F.xxhash64("rid"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    task = F.when(F.col("blocks") == 1, F.col("sig")).otherwise(F.xxhash64("sig", F.least("own", "other"), F.greatest("own", "other")))
    deal = F.when(F.col("blocks") == 1, F.col("deal")).otherwise(task)
    return dealt.select(deal.alias("deal"), task.alias("task"), (F.col("own") > F.col("other")).cast("int").alias("side"), "sig", "rid")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each task, from batches sorted by it."""
    run: list[tuple] = []
    for batch in pieces(batches, rows=2048):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run and run[0][0] != row[0]:
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def _may(run: list[tuple], num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others) of the rows (task, side, rid, comp, sketch) of a run that can link and are of other components."""
    raw = [np.frombuffer(x[4], np.uint64) for x in run]
    words = min(map(len, raw)) - 1
    bits, size = np.vstack([folded(x[1:], words) for x in raw]), np.array([int(x[0]) for x in raw])
    side, comp = (np.array([x[i] for x in run]) for i in (1, 3))
    cross = side.any()
    for i in np.flatnonzero(side == 0).tolist():
        others = np.flatnonzero(side == 1) if cross else np.arange(i + 1, len(run))
        low, high = np.minimum(size[i], size[others]), np.maximum(size[i], size[others])
        others = others[(low * den >= num * high) & (comp[others] != comp[i])]
        if len(others):
            least = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
            others = others[least * (den + num) <= (size[others] + size[i]) * (den - num)]
        if len(others):
            yield i, others


def _top(root: dict[int, int], c: int) -> int:
    """The least id of c's tree in a forest (an id's parent by id)."""
    while root.setdefault(c, c) != c:
        root[c] = root[root[c]]
        c = root[c]
    return c


def _joins(root: dict[int, int], a: int, b: int) -> bool:
    """Join the trees of a and b; whether they were apart."""
    a, b = _top(root, a), _top(root, b)
    root[max(a, b)] = min(a, b)
    return a != b


def _partners(num: int, den: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (least, each) of a run's rows that can link, by their sketches, with one of another component; without
        pairs that those before hold together."""
        root: dict[int, int] = {}
        for rows in _runs(batches):
            if len(root) > JOINED:
                root.clear()
            met = np.zeros(len(rows), bool)
            for i, others in _may(rows, num, den):
                met[i] = True
                met[others] = True
            if met.any():
                own = [x[2] for x, m in zip(rows, met.tolist(), strict=True) if m]
                least = min(own)
                new = [x for x in own if _joins(root, least, x)]
                yield pa.record_batch([pa.array([least] * len(new), pa.int64()), pa.array(new, pa.int64())], ["a", "b"])

    return run


def _exhaustive(num: int, den: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of a run between what is still apart; a link joins components for the rest of the run."""
        for rows in _runs(batches):
            sets = [np.frombuffer(x[4], np.uint64) for x in rows]
            root: dict[int, int] = {}
            out = []
            for i, others in _may([(*x[:4], sketch(e)) for x, e in zip(rows, sets, strict=True)], num, den):
                for j in others.tolist():
                    if _top(root, rows[i][3]) != _top(root, rows[j][3]):
                        n = common(sets[i], sets[j])
                        if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                            _joins(root, rows[i][3], rows[j][3])
                            out.append((rows[i][2], rows[j][2]))
            if out:
                yield pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _by_task(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    n = shuffle_parts(rows.sparkSession)
    dealt = rows.select("task", "side", "rid", "comp", "elems", "deal").repartition(n, "deal")
    return dealt.sortWithinPartitions("task", "side", "rid").mapInArrow(run, schema)


def _once(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, deal) of the groups of rows (key, rid, comp) that hold different components; of groups with the same n
    members one. Groups with the same least rid have the same deal, or one of as many as their members need."""
    mark = lambda seed: F.sum(F.shiftright(F.xxhash64(F.lit(seed), "rid"), 20))  # noqa: E731  two sums of 44 bits a member
    each = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("rid").alias("first"), mark(1).alias("one"), mark(2).alias("two"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    once = each.where("low <> high").groupBy("n", "first", "one", "two").agg(F.min(key).alias(key))
    parts = once.groupBy("first").agg(F.ceil(F.sum("n") / DEALT).alias("parts"))
    deal = F.xxhash64("first", F.pmod(F.xxhash64(key), "parts")).alias("deal")
    return once.join(parts, "first").select(key, "n", deal)


def components(sigs: DataFrame, sketches_of: Callable[[DataFrame], DataFrame], sets_of: Callable[[DataFrame], DataFrame], num: int, den: int, name: str) -> DataFrame:
    """(id, comp) for every row that has a link; rows without one are absent.

    sigs: (sig, rid). sketches_of(ids), sets_of(ids): (rid, elems) of the given rid, elems a sketch or the sorted 64-bit
    elements.
    """
    multi = staged(stars(sigs), name)
    sketches = staged(sketches_of(staged(multi.select("rid").distinct(), name)), name)
    pairs = staged(multi.where("rid <> lead").select(F.col("lead").alias("a"), F.col("rid").alias("b")).distinct(), name)
    likely = staged(verified(pairs, sketches, _may_link(num, den)), name)
    ends = staged(likely.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), name)
    links = staged(verified(likely, sets_of(ends), _links(num, den)), name)
    comp = least_labels(links, name)
    named = multi.select("sig", "rid").join(comp.select(F.col("id").alias("rid"), "comp"), "rid", "left").select("sig", "rid", F.coalesce("comp", "rid").alias("comp"))
    open_ = staged(_once(named, "sig"), name)
    few = open_.count()
    if not few:
        return comp
    seats = seated(multi.select("sig", "rid"), F.broadcast(open_) if few <= BROADCAST_IDS else open_)
    seats = seats.join(comp.select(F.col("id").alias("rid"), "comp"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    may = staged(_by_task(seats.join(sketches, "rid"), _partners(num, den), "a long, b long").distinct(), name)
    if may.isEmpty():
        return comp
    # few rows are left; those that runs hold together are compared once, not in each run
    rows = least_labels(may, name).select(F.col("comp").alias("sig"), F.col("id").alias("rid"))
    again = seated(rows, rows.groupBy("sig").agg(F.count("*").alias("n"), F.first("sig").alias("deal")))
    again = again.join(comp.select(F.col("id").alias("rid"), "comp"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    more = staged(_by_task(again.join(sets_of(staged(rows.select("rid"), name)), "rid"), _exhaustive(num, den), "a long, b long"), name)
    if more.isEmpty():
        return comp
    return least_labels(links.unionByName(more), name)
