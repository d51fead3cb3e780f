"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti, Kaushik: Efficient exact set-similarity joins, 2006).

A document's set holds its distinct word n-grams. Sizes fall into bands [low, low / t] for the least likeness t; sets that
link lie in one band or in neighbours, and differ in at most k = 2 * high * (1 - t) / (1 + t) elements there (high: the
larger band's largest size). The hashed features are dealt into
n1 = floor(k / 2) + 1 + g parts, 1 + g of which have at most one difference, and each part into three subparts, two of
which then agree: every pair of subparts is a signature, so two sets that link share 1 + g of them. Two empty subparts say
nothing, and sets that are not alike would meet there; a set in which at most g parts hold two empty subparts leaves such
pairs out, since one of the 1 + g parts is left in which the subparts that agree are not both empty. g is what sets
of the band need in the mean and two deviations more. Sets of fewer than t / (1 - t)
elements can link only if they are equal, and equal sets are one class from the start.

Null and empty texts, and texts without words: an empty set, linked with nothing. Repeated doc_ids: their sets count
under one id. Rows whose doc_id is null take no part in links; their component_id is null. Other columns are ignored.
An empty table gives no rows. Very long texts are sets like any other; a text is cut into words where its set is needed
(for its key, its signatures, its sketch, its elements) instead of storing sets that are larger than the texts.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import as_bytes, mix, only, pieces, staged, table
from rivulet.llm.setjoin import components, pick, sketch

WORDS_KEPT = 150_000  # hashed words that a worker remembers
MOST_WORDS = 16  # of an n-gram
_ODD = mix(np.arange(1, MOST_WORDS + 1)) | np.uint64(1)


class _Hash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASH = _Hash()


_HIGHS: dict[tuple[int, int], list[int]] = {}  # by likeness: the largest size of each band
_COUNTS: dict[tuple[int, int, int], int] = {}  # subparts of a band


@dataclass(frozen=True)
class Likeness:
    """Sets of n-grams of so many words link if their Jaccard likeness is num / den or more."""

    num: int
    den: int
    words: int

    @property
    def least(self) -> int:
        """Smaller sets link only if they are equal."""
        return -(-self.num // (self.den - self.num))

    def shingles(self, text: bytes) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the n-grams: A-Z in lower case, words divided by ASCII white space; of fewer
        words the whole sequence is one."""
        only(_HASH)
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(h))
        out = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            out = mix(out + h[i : len(out) + i] * _ODD[i])
        if len(words) < self.words:
            out = mix(out + np.uint64(len(words)))
        return np.unique(out)

    def largest(self, band: int) -> int:
        highs = _HIGHS.setdefault((self.num, self.den), [])
        while len(highs) <= band:
            highs.append((highs[-1] + 1 if highs else self.least) * self.den // self.num)
        return highs[band]

    def band_of(self, size: int) -> int:
        """The band that holds size (least or more)."""
        self.largest(0)
        highs = _HIGHS[self.num, self.den]
        while highs[-1] < size:
            self.largest(len(highs))
        return bisect_left(highs, size)

    def spare(self, band: int) -> int:
        """g of a band: parts in which two subparts of its smallest sets are empty, in the mean and two deviations."""
        n, g = self.largest(band) * (self.den - self.num) // (self.den + self.num) + 1, 0
        smallest = self.least if band < 2 else self.largest(band - 2) + 1
        for _ in range(3):
            none = math.exp(-smallest / (3 * (n + g)))
            mean = (n + g) * none * none * (3 - 2 * none)
            g = math.ceil(mean + 2 * math.sqrt(mean))
        return g

    def subpart_count(self, band: int) -> int:
        """Three for each first-level part."""
        key = self.num, self.den, band
        if key not in _COUNTS:
            _COUNTS[key] = 3 * ((2 * self.largest(band) * (self.den - self.num) // (self.den + self.num) + 2) // 2 + self.spare(band))
        return _COUNTS[key]

    def subparts(self, elems: np.ndarray, band: int) -> np.ndarray:
        """For each of the 3 * n1 subparts a hash of its elements, the number of them (255 at most) in the low byte."""
        n = self.subpart_count(band)
        part = (mix(elems ^ _ODD[2]) % np.uint64(n)).astype(np.int64)
        total = np.zeros(n, np.uint64)
        np.add.at(total, part, elems * _ODD[0] ^ elems >> np.uint64(29))
        count = np.minimum(np.bincount(part, minlength=n), 255).astype(np.uint64)
        where = np.arange(n, dtype=np.uint64) * _ODD[1] + np.full(n, band + 1, np.uint64) * _ODD[2]
        return mix(total + where) & ~np.uint64(255) | count


#: What op8 asks for, and what near-duplicate stages take.
NINE_TENTHS, FOUR_FIFTHS = Likeness(90, 100, 3), Likeness(80, 100, 5)


def signatures(vector: np.ndarray, spare: int) -> np.ndarray:
    """The pairs among each three subparts, hashed; without pairs of empty ones if at most spare parts have such pairs."""
    v = vector.reshape(-1, 3)
    full = (v & np.uint64(255)) > 0
    drop = int((full.sum(axis=1) < 2).sum()) <= spare
    out = []
    for i, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        pair = mix(v[:, a] * _ODD[0] + v[:, b] * _ODD[1] + np.uint64(i))
        out.append(pair[full[:, a] | full[:, b]] if drop else pair)
    return np.concatenate(out)


def _heads(like: Likeness) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [like.shingles(text) for text in as_bytes(batch.column("text"))]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "n_shingles", "key"])

    return run


def _profile(like: Likeness, s: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The band of a set of like.least elements or more, and its subparts there and in the next band."""
    band = like.band_of(len(s))
    return band, like.subparts(s, band), like.subparts(s, band + 1)


def _signed(like: Likeness) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, rows=256):
            sigs, rids = [], []
            for rid, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                s = like.shingles(text)
                if len(s) >= like.least:
                    band, own, upper = _profile(like, s)
                    sig = np.concatenate((signatures(own, like.spare(band)), signatures(upper, like.spare(band + 1))))
                    sigs.append(sig.view(np.int64))
                    rids.append(np.full(len(sig), rid))
            if sigs:
                yield pa.record_batch([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(rids), pa.int64())], ["sig", "rid"])

    return run


def _sketches(like: Likeness) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            raw = [sketch(like.shingles(x)) for x in as_bytes(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(raw, pa.binary())], ["rid", "elems"])

    return run


def _sets(like: Likeness) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            raw = [like.shingles(x).tobytes() for x in as_bytes(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(raw, pa.binary())], ["rid", "elems"])

    return run


def ngram_jaccard_components(docs: DataFrame, like: Likeness = NINE_TENTHS) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    heads = staged(docs.mapInArrow(_heads(like), "doc_id long, n_shingles long, key binary"), "partenum")
    full = heads.where("n_shingles > 0 and doc_id is not null")
    classes = staged(full.groupBy("n_shingles", "key").agg(F.min("doc_id").alias("rid")), "partenum")
    reps = classes.where(F.col("n_shingles") >= like.least).select(F.col("rid").alias("doc_id")).distinct()
    of = lambda ids, run, schema: pick(docs, ids, "doc_id").mapInArrow(run(like), schema)
    named = lambda ids: ids.select(F.col("rid").alias("doc_id"))
    sigs = of(reps, _signed, "sig long, rid long")
    sets_of = lambda ids: of(named(ids), _sets, "rid long, elems binary")
    sketches_of = lambda ids: of(named(ids), _sketches, "rid long, elems binary")
    linked = components(sigs, sketches_of, sets_of, like.num, like.den, "partenum")
    # classes that share a document id (repeated ids) belong together as well
    classes = classes.join(linked.select(F.col("id").alias("rid"), "comp"), "rid", "left").select("n_shingles", "key", F.coalesce("comp", "rid").alias("comp"))
    known = heads.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "key").join(classes, ["n_shingles", "key"])
    by_id = known.groupBy("doc_id").agg(F.min("comp").alias("comp"))
    out = heads.select("doc_id", "n_shingles").join(by_id, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"))
