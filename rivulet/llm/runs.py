"""Periodic runs of words: a stretch that repeats with some period at least EXPONENT times, found by block matching.

For a period q take the power of two b with b <= q < 2b. A run of length 4q or more holds a block of b words that starts
at a multiple of b and comes again q words on, still inside the run. So for each scale b the aligned blocks of a text are
the keys of an Aho-Corasick automaton over integer sequences, the text is searched for all of them at once, and a block
met again at a distance from b to 2b - 1 is a seed, which is extended word by word to both sides, as far as the words keep
the distance. Nothing is estimated; three bounds only leave out what cannot belong to a run:

* In a run of period q every word but the last q comes again within q words. At scale b only stretches of 3b words or
  more, each of which comes again within 2b - 1 words, are cut into blocks and searched (with the 2b words after them).
* A block whose next 3b words lie in a known run of smaller period gives only multiples of that period.
* A run of length 4q is at least b words longer than its seed on one side, so the next words there must agree.

Seeds go by ascending distance; what lies inside a known run has its smaller period. A text's steps take the time of its
words for each scale it has repeats at; texts are handled one by one, without a shuffle.

Null text has no words. Texts without runs have an empty list. Repeated rows stay; an empty table gives none. Columns other
than doc_id and text are ignored. Texts of any length are processed whole, in one task each.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import as_bytes, pieces, table

EXPONENT, LEAST_WORDS = 4, 6
PROBES = 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

Run = tuple[int, int, int]
Change = Callable[[int | None, list[bytes]], list[bytes]]


def _agree(words: np.ndarray, i: int, j: int) -> int:
    """How many words from i on equal those from j > i on."""
    done, step, n = 0, 32, len(words)
    while j + done < n:
        m = min(step, n - j - done)
        differ = words[i + done : i + done + m] != words[j + done : j + done + m]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, step = done + m, step * 2
    return done


def _next_same(words: np.ndarray) -> np.ndarray:
    """Distance to the next place of the same word; more than the length if there is none."""
    order = np.argsort(words, kind="stable")
    out = np.full(len(words), 2 * len(words) + 2, np.int64)
    same = words[order[1:]] == words[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _stretches(gap: np.ndarray, b: int) -> Iterator[tuple[int, int]]:
    """Where 3b words or more come again within less than 2b words."""
    ends = np.r_[-1, np.flatnonzero(gap >= 2 * b), len(gap)]
    for k in np.flatnonzero(np.diff(ends) > 3 * b):
        yield int(ends[k]) + 1, int(ends[k + 1])


def _seeds(words: np.ndarray, low: int, high: int, b: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, start) of aligned blocks of words[low:high] that come again at a distance from b to 2b - 1."""
    n = len(words)
    starts = np.arange(-(-low // b) * b, high - b + 1, b)
    starts = starts[reach[starts] < np.minimum(n, starts + 3 * b)]
    text = tuple(words[low : min(n, high + 2 * b)].tolist())
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    known: dict[tuple[int, ...], int] = {}
    keys = np.array([known.setdefault(text[s - low : s - low + b], len(known)) for s in starts.tolist()], np.int64)
    if not known:
        return keys, keys
    for block, key in known.items():
        automaton.add_word(block, key)
    automaton.make_automaton()
    ends, found = np.array(list(automaton.iter(text)), np.int64).reshape(-1, 2).T
    places = np.sort(found * (n + 1) + ends + (low - b + 1))
    first = np.searchsorted(places, keys * (n + 1) + np.minimum(starts + b, n))
    many = np.searchsorted(places, keys * (n + 1) + np.minimum(starts + 2 * b, n)) - first
    s = np.repeat(starts, many)
    at = places[np.arange(many.sum()) + np.repeat(first - np.r_[0, np.cumsum(many)[:-1]], many)] % (n + 1)
    after, before = np.ones(len(s), bool), np.ones(len(s), bool)
    for t in range(min(b, PROBES)):
        after &= (at + b + t < n) & (words[np.minimum(at + b + t, n - 1)] == words[np.minimum(s + b + t, n - 1)])
        before &= (s > t) & (words[at - 1 - t] == words[s - 1 - t])
    s, d = s[after | before], (at - s)[after | before]
    order = np.lexsort((s, d))
    return d[order], s[order]


def find_runs(words: np.ndarray) -> list[Run]:
    """(start, length, period) of every run, in order; words are numbered."""
    n, out = len(words), []
    if n < LEAST_WORDS:
        return out
    gap, back = _next_same(words), words[::-1]
    reach = np.zeros(n + 1, np.int64)  # for each place, the furthest end of a known run that holds it
    b = 1
    while EXPONENT * b <= n:
        for low, high in _stretches(gap, b):
            last = (0, 0)
            for d, s in zip(*(x.tolist() for x in _seeds(words, low, high, b, reach)), strict=True):
                if last[0] == d and s + d + b <= last[1]:
                    continue  # inside what was extended just now
                end = s + d + b + _agree(words, s + b, s + d + b)
                start = s - _agree(back, n - s - d, n - s)
                last = (d, end)
                if end - start >= max(LEAST_WORDS, EXPONENT * d) and reach[start] < end:
                    out.append((start, end - start, d))
                    reach[start:end] = np.maximum(reach[start:end], end)
        b *= 2
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def kept(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    stay = np.ones(len(words), bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(stay).tolist()]


def periodic_runs(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """(doc_id, runs in order of start and period, text without what runs repeat), of each row; change, if any, is applied
    to a document's words first."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            runs, texts = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                words = text.split()  # at ASCII white space, as bytes split
                words = change(doc_id, words) if change else words
                own = find_runs(numbered(words))
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                texts.append(b" ".join(kept(words, own)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(runs, pa.list_(RUN)), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, SCHEMA)


def strongest(runs: str = "runs") -> Column:
    """The run of greatest exact length / period, the first of equals; null without runs."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))


def every_tenth_repeats(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's change: of every tenth id by crc32, words from some place on repeat those there. A null id has none."""
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), every_tenth_repeats).withColumn("best", strongest())
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
