"""Periodic runs against a plain version."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from rivulet.llm.runs import every_tenth_repeats, find_runs, kept, op11_periodic_runs, periodic_runs
from tests.llm.test_contracts import ODD, SMALL, docs, fuzzed

NOTHING = hashlib.sha256(b"").hexdigest()


def plain_runs(words):
    """Every period by itself, the smallest by trying all below it."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rng):
    words, k, mode = [], rng.choice([1, 2, 3, 5]), rng.randrange(4)
    n = rng.randrange(80)
    while len(words) < n:
        unit = [rng.randrange(k) for _ in range(rng.randrange(1, 12))] * (rng.randrange(1, 5) if mode == 2 else 1)
        words += (unit * rng.randrange(1, 7))[: rng.randrange(1, 60)] + ([rng.randrange(100, 200)] if mode == 3 and rng.random() < 0.5 else [])
    return words if mode else [rng.randrange(k) for _ in range(n)]


def test_random_words():
    rng, found = random.Random(1), 0
    for _ in range(3000):
        words = made(rng)
        got = find_runs(np.array(words, np.int64))
        assert got == plain_runs(words), words
        found += len(got)
    assert found > 1500


def test_runs_in_runs():
    words = (([0] * 8 + [1]) * 5 + [2]) * 4
    got = find_runs(np.array(words))
    assert got == plain_runs(words)
    assert {q for _, _, q in got} == {1, 9, 46} and kept([b"%d" % w for w in words], got) == [b"0"] + [b"1"] + [b"2"]


@pytest.mark.parametrize("words", [[0] * 500_000, [0, 1] * 200_000, list(range(1000)) * 100, list(range(300_000)), ([0] * 500 + [1]) * 100])
def test_long_texts(words):
    begun = time.time()
    got = find_runs(np.array(words, np.int64))
    assert time.time() - begun < 30
    assert (got == []) == (len(set(words)) == len(words))


def digests(doc_id, text):
    words = [w.encode() for w in (text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    left = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *row, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest())


def test_query_against_a_plain_version(spark, tmp_path):
    small = spark.read.parquet(f"{SMALL}/documents.parquet")
    repeats = ["a " * 50, "a b a b a b a b a", "x y z " * 9 + "x y q", ("p q r s t " * 8 + "u v ") * 6, "one two three four five six seven " * 4]
    rows = small.unionByName(docs(spark, ODD + repeats + fuzzed(200, 3), 1_000_000))
    rows = rows.unionByName(rows.where("doc_id % 7 = 0"))  # repeated rows
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    out = op11_periodic_runs(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    want = sorted((r.doc_id, *digests(r.doc_id, r.text)) for r in rows.collect() if len(r.text or "") < 20_000)
    lengths = {r.doc_id for r in rows.collect() if len(r.text or "") < 20_000}
    got = sorted((tuple(r) for r in out.collect() if r.doc_id in lengths), key=lambda r: (r[0], str(r)))
    assert got == sorted(want, key=lambda r: (r[0], str(r)))
    assert sum(r[1] > 0 for r in got) > 20


def test_odd_tables(spark):
    schema = "doc_id long, text string, runs string, collapsed string, best int"
    rows = [(None, "a a a a a a a"), (1, None), (1, None), (2, ""), (3, "b " * 6 + "c")]
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], schema), every_tenth_repeats).collect()), key=str)
    assert got == sorted([(None, [(0, 7, 1)], "a"), (1, [], ""), (1, [], ""), (2, [], ""), (3, [(0, 6, 1)], "b c")], key=str)
    assert periodic_runs(spark.createDataFrame([], schema)).collect() == []
