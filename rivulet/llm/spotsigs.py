"""Document fingerprints by SpotSigs (Theobald, Siddharth, Paepcke: SpotSigs, 2008).

A spot is a common word (ANCHORS) and the CHAIN content words that follow it, hashed to 32 bits; a text's fingerprint is
the sorted set of its spots, eight hex digits each. A text without spots has one signature of its whole word sequence,
so equal texts always have equal fingerprints and other texts hardly ever. The query compares each set with two others,
in full, since it reports every likeness.

similar() joins all sets: they are dealt into partitions by length, so that sets of some likeness lie in one partition or
in neighbours, and meet there only by their least spots (a likeness t leaves at most (1 - t) n of n spots unshared, so the
first n - ceil(t n) + 1 in a common order hold a shared one). Pairs are pruned by length and by sketches of their sets
before the exact Jaccard likeness is taken. Sets with the same spots are one class from the start.

Null text is empty; the empty text has the signature of no words. In neighbour order (descending doc_id) null ids come
last, and rows with the same id follow in the order of their texts. Rows with a null doc_id have no class. An empty table
gives no rows. Other columns are ignored. Very long texts are processed whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import mix, only, pieces, shuffle_parts, staged, table
from rivulet.llm.setjoin import components, pick, sketch

CHAIN = 2
LEAST_LIKENESS = 0.8
WORDS_KEPT = 200_000
#: Very common words of four languages.
ANCHORS = frozenset(
    """the of and a to in is it that was for on are with as at by be this from an or not but have has had which
    der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass
    de la le et les en un une du est que dans qui par pour au sur pas plus ne se ce il sont avec
    el y los las se del por con una su para al lo como más pero sus o este sí""".split()
)
COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_spots int, length_partition int"
_WORD = re.compile(r"\w+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class _Hash(dict):
    """Hash of a word; the lowest bit tells an anchor."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) & ~1 | (word in ANCHORS)
        return h


_HASH = _Hash()


def spots(text: str) -> np.ndarray:
    """Sorted distinct 32-bit spot signatures."""
    only(_HASH)
    words = _WORD.findall(text.lower())
    h = np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))
    anchor = (h & np.uint64(1)).astype(bool)
    content = h[~anchor]
    at = np.flatnonzero(anchor)
    first = at - np.arange(len(at))  # content words before each anchor
    ok = first + CHAIN <= len(content)
    at, first = at[ok], first[ok]
    if not len(at):
        return np.array([xxhash.xxh32_intdigest(" ".join(words))], np.uint32)
    sig = mix(h[at])
    for i in range(CHAIN):
        sig = mix(sig + content[first + i] * _ODD[i])
    return np.unique((sig >> np.uint64(32)).astype(np.uint32))


def fingerprint(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def parsed(text: str) -> np.ndarray:
    """The set of a fingerprint."""
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def length_partition(size: int, least: float = LEAST_LIKENESS) -> int:
    """Sets whose likeness is least or more lie in one partition or in neighbours."""
    return math.floor(math.log(max(1, size)) / -math.log(least))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness; 0.0 without counting where partitions or lengths show that it is below least."""
    small, large = sorted((len(a), len(b)))
    if least and (length_partition(large, least) - length_partition(small, least) > 1 or small < least * large):
        return 0.0
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    n = int(np.count_nonzero(both[1:] == both[:-1]))
    out = n / (small + large - n)
    return out if out >= least else 0.0


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sets = [spots(t or "") for t in batch.column("text").to_pylist()]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        yield pa.record_batch([batch.column("doc_id"), pa.array(list(map(len, sets)), pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "n_spots", "key"])


def _made(make: Callable[[int, np.ndarray], Iterator[tuple]], types: Sequence[pa.DataType], names: Sequence[str]) -> Callable:
    """What make(doc_id, spots) gives for each row (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = [row for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for row in make(d, spots(t or "").astype(np.uint64))]
            yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)

    return run


def similar(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_spots, class_id) of each row of docs (doc_id, text): class_id is the least doc_id that links of likeness
    num / den or more reach."""

    def signed(d: int, s: np.ndarray) -> Iterator[tuple]:
        band = length_partition(len(s), num / den)
        for b in (band, band + 1):  # a set meets those of its own partition and of the next
            yield from ((x, d) for x in mix(s[: len(s) - -(-num * len(s) // den) + 1] + (np.uint64(b + 1) << np.uint64(40))).view(np.int64).tolist())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    heads = staged(rows.mapInArrow(_classed, "doc_id long, n_spots long, key binary"), "spotsigs")
    full = heads.where("doc_id is not null")
    classes = staged(full.groupBy("n_spots", "key").agg(F.min("doc_id").alias("rid")), "spotsigs")
    of = lambda ids, make, types, schema: pick(rows, ids.select(F.col("rid").alias("doc_id")), "doc_id").mapInArrow(_made(make, types, [x.split()[0] for x in schema.split(", ")]), schema)
    ints, raw = [pa.int64(), pa.int64()], pa.binary()
    sigs = of(classes.select("rid").distinct(), signed, ints, "sig long, rid long")
    kept = lambda keep: lambda ids: of(ids, lambda d, s: [(d, keep(s))], [pa.int64(), raw], "rid long, elems binary")
    linked = components(sigs, kept(sketch), kept(np.ndarray.tobytes), num, den, "spotsigs")
    classes = classes.join(linked.select(F.col("id").alias("rid"), "comp"), "rid", "left").select("n_spots", "key", F.coalesce("comp", "rid").alias("comp"))
    own = full.join(classes, ["n_spots", "key"]).groupBy("doc_id").agg(F.min("comp").alias("comp"))
    return heads.select("doc_id", "n_spots").join(own, "doc_id", "left").select("doc_id", "n_spots", F.col("comp").alias("class_id"))


def neighbours(docs: DataFrame) -> DataFrame:
    """Rows (part, guest, k, doc_id, text) of docs, dealt into ranges of descending doc_id, one range to a partition and
    sorted in it. A range ends with a guest: a copy of the row that follows it, the first range's first after the last.
    """
    n = shuffle_parts(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    edges = sorted(set(rows.approxQuantile("k", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e >= F.col("k"))) if edges else F.lit(0)
    rows = rows.withColumn("part", part)
    heads = dict(rows.groupBy("part").agg(F.max("k")).collect())  # a row for each range
    used = sorted(heads)
    before = {p: used[i - 1] for i, p in enumerate(used)}
    lookup = lambda of, kind: F.array(*(F.lit(of.get(p)).cast(kind) for p in range(len(edges) + 1)))[F.col("part")]
    own, guest = F.struct(F.col("part"), F.lit(0).alias("guest")), F.struct(lookup(before, "int").alias("part"), F.lit(1).alias("guest"))
    seats = F.when(F.col("k") == lookup(heads, "long"), F.array(own, guest)).otherwise(F.array(own))
    rows = rows.select("k", "doc_id", "text", F.inline(seats))
    return rows.repartitionById(n, "part").sortWithinPartitions("guest", F.desc("k"), "text")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
    held, ended = None, False
    for batch in pieces(batches):
        out = []
        for doc_id, text, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "guest")), strict=True):
            if ended:
                break
            own = spots(text)
            if held:
                before, old, old_id = held
                half = len(old) // 2
                edited = old[: len(old) - half] + text[:half]
                changed = spots(edited)
                out.append((old_id, len(old), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(before), fingerprint(changed), likeness(before, changed), likeness(before, own), len(before), length_partition(len(before))))
            held, ended = (own, text, doc_id), bool(guest)
        yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbours(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "text", "guest").mapInArrow(_compared, COLUMNS)
