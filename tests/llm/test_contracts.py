"""The contract queries' operators against plain versions, on odd texts and on a small supplied table."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rivulet.llm import bytebpe, partenum, pii, quality, spotsigs, tokenfiles, topk
from rivulet.llm.common import scratch
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None,
    "",
    " ",
    "\n\t\x0b\x0c\r",
    "a",
    "A b",
    "it's don't I'M we'll they've he'd 'tis rock'n'roll",
    "<|endoftext|> and<|startoftext|>x <|endoftext|>",
    "İstanbul ﬁne Ⅷ é é İ̇ ß ẞ",
    "tab\x1csep\x1dgroup\x1eunit\x1f nel\x85ls nbsp ideo　zwsp​bom﻿",
    "名前は田中です。价格是 100 元! 12345 ①②③ ½",
    "x" * 3000,
    "ab" * 2500 + " " + "é" * 700,
    "!!!??? ... ,,, --- ___ a_b_c a-b-c \x01 mark\x01mark \x00nul",
    "mail a.b@c.de.fg, x@y and a@b..c @@ z@w.q",
    "ip 1.2.3.4 256.1.1.1 1.2.3.4.5 10.0.0.255 01.02.03.04",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 79927398713 5500005555555559",
    "phone +1 (555) 123-4567 +49.30.1234567 +1 2 +123456789012345678",
    "+1 555 123 4567 4111 1111 1111 1111 a@b.co 1.1.1.1",
    "the cat sat on the mat and the dog ran " * 40,
    "😀👩‍👩‍👧 emoji 🇩🇪 \U0010ffff",
]


def docs(spark, texts, start=0):
    rows = [(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def fuzzed(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    alphabet = ["a", "B", "z", "é", "ß", "İ", "'", "'s", "’", ".", ",", "-", "_", "@", "+", "1", "23", "456", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1f", "\x85", " ", " ", "​", "中", "あ", "😀", "\x01", "\x00", "<|endoftext|>", "the", "hello", "I'm", "<", "|", "é", "ﬁ", "½", "(", ")"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts_of(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_word_ids(spark):
    texts = [t or "" for t in ODD] + fuzzed(1500, 1)
    own = tokenfiles.ChunkEncoder(tokenfiles.public_tokenizers.path(tokenfiles.TOKENIZER))
    ids, sizes = own.encode(pa.array(texts))
    assert len(sizes) == len(texts)
    start = 0
    for t, n, want in zip(texts, sizes.tolist(), brute.word_ids(texts), strict=True):
        assert ids[start : start + n].tolist() + [1] == want, repr(t)
        start += n


def test_token_files(spark, small):
    rows = small.unionByName(docs(spark, ODD, 1_000_000))
    out = scratch(spark, "test")
    tokenfiles.write_token_files(rows, out, tokenfiles.public_tokenizers.path(tokenfiles.TOKENIZER))
    got = sorted(map(tuple, tokenfiles.read_token_files(spark, out).mapInArrow(tokenfiles._crc, "doc_id long, start long, n_tokens long, ids_crc32 long").collect()))
    own = texts_of(rows)
    ids = brute.word_ids([t or "" for _, t in own])
    want, start = [], 0
    for (d, _), x in zip(own, ids, strict=True):
        want.append((d, start, len(x), brute.crc(x)))
        start += len(x)
    assert got == want


def test_byte_bpe(spark, small):
    texts = [t or "" for t in ODD] + fuzzed(800, 2) + [t or "" for _, t in texts_of(small)]
    enc = brute.byte_encoding()
    path, pattern = bytebpe.public_tokenizers.path(bytebpe.RANKS), bytebpe.public_tokenizers.PATTERN
    got = bytebpe.decode(bytebpe.encode(docs(spark, texts), path, pattern), path, pattern).select("text", "ids", "decoded").collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == enc.encode_ordinary(r.text), repr(r.text[:80])
        assert bytes(r.decoded) == r.text.encode()


def test_byte_bpe_goes_through_the_tree(small):
    """Every match of two bytes or more is joined from halves; nothing is merged whole but windows that had to grow."""
    coder = bytebpe.ByteBPE(bytebpe.public_tokenizers.path(bytebpe.RANKS), bytebpe.public_tokenizers.PATTERN)
    enc = brute.byte_encoding()
    matches = {m for _, t in texts_of(small) for m in coder.find(t or "")}
    joined = longest = 0
    for m in matches:
        data, before, widest = m.encode(), coder.joins, []
        coder.nodes.clear()
        coder.merge = lambda x, below=bytebpe._NONE, w=widest: w.append((len(x), below)) or bytebpe.ByteBPE.merge(coder, x, below)
        ids = coder.tree(data)
        coder.merge = bytebpe.ByteBPE.merge.__get__(coder)
        assert coder.joins - before >= len(data) - 1 - len(data) // 2  # equal halves are one node
        joined += coder.joins > before
        longest += any(n == len(data) for n, below in widest if below == bytebpe._NONE and len(data) > 8)
        assert [*ids] == enc._core_bpe.encode_single_piece(data) or data in coder.ranks
    assert joined >= 0.99 * sum(len(m.encode()) > 1 for m in matches) and longest < 0.5 * len(matches)


def test_byte_bpe_generations(monkeypatch):
    """What a worker forgets it encodes again."""
    coder = bytebpe.ByteBPE(bytebpe.public_tokenizers.path(bytebpe.RANKS), bytebpe.public_tokenizers.PATTERN)
    enc = brute.byte_encoding()
    monkeypatch.setattr(bytebpe, "PIECES_KEPT", 40)
    for text in fuzzed(300, 6) + ["the same words and " * 9, "x" * 200_000]:
        assert np.frombuffer(coder.encode([text, text[:9]])[0], np.int32).tolist() == enc.encode_ordinary(text)


def test_pii_base(spark, small):
    rows = small.unionByName(docs(spark, ODD + fuzzed(600, 3), 1_000_000))
    text = dict(texts_of(rows))
    found = pii.find(rows).collect()
    assert len(found) == len(text)
    for r in found:
        want = [(a, no, b) for a, no, _, b in brute.base_spans(text[r.doc_id] or "")]
        assert sorted((s.start, s.kind_no, s.end) for s in r.base) == want, repr(text[r.doc_id])
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}


def near_copies(seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for n in (1, 2, 3, 8, 12, 13, 25, 40, 80, 200):
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(14):
            other = list(base)
            for _ in range(rng.randrange(0, 1 + max(1, n // 30))):
                other[rng.randrange(n)] = rng.choice(words)
            if rng.random() < 0.3:
                other += [rng.choice(words) for _ in range(rng.randrange(1 + n // 20))]
            out.append(rng.choice((" ", "\n", "  ")).join(other))
            base = other if rng.random() < 0.3 else base
    return out


@pytest.mark.parametrize("which", ["odd", "near", "table"])
def test_jaccard(spark, small, which):
    rows = {"odd": lambda: docs(spark, ODD + fuzzed(200, 4)), "near": lambda: docs(spark, near_copies()), "table": lambda: small}[which]()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.ngram_jaccard_components(rows).collect()}
    assert got == brute.jaccard_components(texts_of(rows))


@pytest.mark.parametrize("like", [partenum.NINE_TENTHS, partenum.FOUR_FIFTHS])
def test_jaccard_at_the_bound(spark, like):
    """Sets of every small size, and each with one and two shingles more: likeness exactly at and just below the bound."""
    texts = [" ".join(f"g{n}w{i}" for i in range(n + more)) for n in range(1, 24) for more in (0, 1, 2)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.ngram_jaccard_components(docs(spark, texts), like).collect()}
    assert got == brute.jaccard_components(list(enumerate(texts)), like.words, like.num)


def test_jaccard_large_group(spark):
    """A hot group: many chains of near copies under common signatures, more than a block holds."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(60)]
    texts = []
    for i in range(700):
        t = list(base)
        for j in range(i % 7):
            t[(j * 8 + i % 8) % 60] = f"x{i % 50}"
        texts.append(" ".join(t))
    rows = docs(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.ngram_jaccard_components(rows).collect()}
    assert got == brute.jaccard_components(texts_of(rows))


def test_jaccard_under_one_signature(spark, monkeypatch):
    """A passage that all texts share makes them meet under common signatures without being alike; links between them
    are found in small blocks, by no more than what shares a signature."""
    from rivulet.llm import setjoin

    monkeypatch.setattr(setjoin, "BLOCK", 16)
    monkeypatch.setattr(setjoin, "PARTNERS", 8)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(260):
        own = [f"o{i // 3}x{j}" for j in range(30)]
        for _ in range(i % 3):
            own[rng.randrange(30)] = f"z{i}"
        texts.append(" ".join(passage[: 60 - i % 2] + own))
    for like in (partenum.FOUR_FIFTHS, partenum.NINE_TENTHS):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.ngram_jaccard_components(docs(spark, texts), like).collect()}
        want = brute.jaccard_components(list(enumerate(texts)), like.words, like.num)
        assert got == want and len({c for _, c in want.values()}) > 50


def test_linked_sets_share_a_signature():
    """Also without the pairs of empty subparts: sets exactly at the bound, of every size."""
    rng = np.random.default_rng(5)
    for like in (partenum.FOUR_FIFTHS, partenum.NINE_TENTHS):
        for n in [*range(like.least, 120), 300, 999, 3000]:
            for _ in range(3):
                a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
                apart = 2 * n * (like.den - like.num) // (like.den + like.num)
                gone = int(rng.integers(0, apart + 1))
                b = np.unique(np.r_[rng.permutation(a)[gone:], rng.integers(0, 1 << 63, apart - gone).astype(np.uint64)])
                both = len(np.intersect1d(a, b))
                if like.den * both >= like.num * (len(a) + len(b) - both):
                    mine = []
                    for x in (a, b):
                        band, own, upper = partenum._profile(like, x)
                        mine.append(set(np.r_[partenum.signatures(own, like.spare(band)), partenum.signatures(upper, like.spare(band + 1))].tolist()))
                    assert mine[0] & mine[1], (like, n, gone)


def test_fingerprints(spark):
    texts = [*ODD, "the same text of it", "the same text of it"]
    rows = docs(spark, texts)
    got = {r.doc_id: r for r in spotsigs.neighbours(rows).select("doc_id", "text", "guest").mapInArrow(spotsigs._compared, spotsigs.COLUMNS).collect()}
    assert len(got) == len(texts)
    order = sorted(range(len(texts)), reverse=True)
    for i, d in enumerate(order):
        t, nxt = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        f = [set(spotsigs.parsed(x).tolist()) for x in (r.fingerprint, r.edited_fingerprint)]
        assert f[1] == set(spotsigs.spots(edited).tolist()) and f[0] == set(spotsigs.spots(t).tolist())
        plain = [brute.spot_set(x) for x in (t, edited, nxt)]
        assert len(f[0]) == len(plain[0]) and len(f[1]) == len(plain[1])
        for near, other in ((r.near_edited, plain[1]), (r.near_next, plain[2])):
            assert abs(near - len(plain[0] & other) / len(plain[0] | other)) < 1e-12
    assert got[len(texts) - 1].fingerprint == got[len(texts) - 2].fingerprint and got[len(texts) - 1].near_next == 1.0


@pytest.mark.parametrize("which", ["odd", "near", "table"])
def test_similar_fingerprints(spark, small, which):
    """Classes of the join by length partitions against all pairs."""
    rng = random.Random(2)
    words = "the of and to in is".split() + [f"w{i}" for i in range(60)]

    def near():
        for n in (3, 8, 20, 60, 200, 500):
            base = [rng.choice(words) for _ in range(n)]
            for _ in range(25):
                yield " ".join(base)
                for _ in range(rng.randrange(1 + n // 20)):
                    base = base[:]
                    base[rng.randrange(n)] = rng.choice(words)

    rows = {"odd": lambda: docs(spark, ODD), "near": lambda: docs(spark, list(near())), "table": lambda: small}[which]()
    got = {r.doc_id: (r.n_spots, r.class_id) for r in spotsigs.similar(rows).collect()}
    sets = {d: brute.spot_set(t or "") for d, t in texts_of(rows)}
    comp = brute.components(sets, 80, 100)
    assert got == {d: (len(s), comp[d]) for d, s in sets.items()}


def test_similar_odd_rows(spark):
    df = docs(spark, ["the cat sat here"] * 3).withColumn("key", F.lit("k")).withColumn("comp", F.lit(1))
    df = df.withColumn("doc_id", F.when(F.col("doc_id") == 0, None).otherwise(F.lit(4).cast("long")))
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in spotsigs.similar(df).collect()) == [(0, 0), (4, 4), (4, 4)]
    assert spotsigs.similar(df.where("false")).count() == 0


def test_token_lookup_prunes(spark):
    """Looked-up ids come back; the reader leaves out row groups by index, and ids that are not there by Bloom filter."""
    rows = spark.range(0, 60_000, 2).selectExpr("id as doc_id", "concat('text of ', id) as text")
    out, path = scratch(spark, "test"), tokenfiles.public_tokenizers.path(tokenfiles.TOKENIZER)
    tokenfiles.write_token_files(rows, out, path)

    def read(ids):
        df = tokenfiles.lookup(spark, out, ids)
        got = df.collect()
        return got, df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()

    want = brute.word_ids([f"text of {i}" for i in (4, 30_000, 59_998)])
    got, n = read([4, 30_000, 59_998])
    assert sorted((r.doc_id, list(r.ids)) for r in got) == list(zip((4, 30_000, 59_998), want, strict=True)) and n <= 3 * 1000
    got, n = read([5, 30_001, 40_001])  # between others: only the Bloom filters can tell
    assert got == [] and n == 0
    got, n = read([-3, 70_000])
    assert got == [] and n == 0
    import pyarrow.orc as orc

    files = [f for f in __import__("pathlib").Path(out.removeprefix("file://")).glob("*.orc")]
    assert sum(orc.ORCFile(f).nrows for f in files) == 30_000
    assert {orc.ORCFile(f).row_index_stride for f in files} == {1000} and {orc.ORCFile(f).compression for f in files} == {"ZSTD"}


def test_token_files_with_a_hot_id(spark):
    """Rows of one id are spread over ranges; starts follow one another all the same."""
    rows = docs(spark, [f"text {i}" for i in range(600)]).withColumn("doc_id", F.when(F.col("doc_id") < 400, 7).when(F.col("doc_id") < 500, None).otherwise(F.col("doc_id")))
    out = scratch(spark, "test")
    tokenfiles.write_token_files(rows, out, tokenfiles.public_tokenizers.path(tokenfiles.TOKENIZER))
    got = tokenfiles.read_token_files(spark, out).collect()
    got.sort(key=lambda r: r.start)
    assert len(got) == 600 and [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(600)]
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    assert spark.read.orc(out).where("doc_id = 7").select("part").distinct().count() > 1


def test_quality_against_a_plain_version(spark):
    """Moments, covariances and log densities by numpy's own functions."""
    d = "/root/testdata/sf0.001"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    x = np.array([quality.statistics((texts[i] or "").encode()) for i in labels if labels[i] is not None])
    y = np.array([q for q in labels.values() if q is not None])
    sums = np.array([np.r_[(y == c).sum(), x[y == c].sum(axis=0), (x[y == c].T @ x[y == c]).ravel()] for c in (0, 1)])
    model = quality.train(sums)
    within = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).mean() * within[c] for c in (0, 1))
    want = []
    for c in (0, 1):
        cov = (1 - quality.POOLED) * within[c] + quality.POOLED * pooled
        cov = (1 - quality.IDENTITY) * cov + (quality.IDENTITY * np.trace(pooled) / quality.DIM + 1e-9) * np.eye(quality.DIM)
        gap = x - x[y == c].mean(axis=0)
        want.append(-0.5 * np.einsum("ij,ij->i", gap, np.linalg.solve(cov, gap.T).T) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.difference(x), np.clip(want[1] - want[0], -100, 100), rtol=1e-6, atol=1e-6)


def test_fingerprints_one_row(spark):
    got = spotsigs.neighbours(docs(spark, ["the only one text here of all"])).select("doc_id", "text", "guest").mapInArrow(spotsigs._compared, spotsigs.COLUMNS).collect()
    assert len(got) == 1 and got[0].near_next == 1.0


def test_top_k(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1 + i % 5) for _ in range(24)]) for i in range(600)]
    rows += [(1000, None), (1050, [1.0, None] + [0.0] * 22), (1100, [float("nan")] * 24), (1150, [float("inf")] * 24), (1200, []), (1250, [0.0] * 24), (1300, rows[0][1]), (1350, rows[0][1]), (1400, [-1.0] * 24), (1451, [-1.0] * 24)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    want = brute.top_k([(r.vec_id, r.embedding) for r in df.collect()], 50, 5)
    assert {tuple(r) for r in topk.top_k(df, "vec_id % 50 = 0").collect()} == want


@pytest.mark.parametrize("size", [1e3, 1e6, 1e7, 1e15])
def test_top_k_is_exact_at_any_size(spark, size):
    """Scores past 2**53 and past a long: products of whole numbers, not of doubles."""
    rng = random.Random(int(math.log10(size)))
    rows = [(i, [rng.gauss(0, size) for _ in range(20)]) for i in range(160)] + [(160 + i, [rng.gauss(0, 1.0) for _ in range(20)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(df, "vec_id % 10 = 0").collect()} == brute.top_k(rows, 10, 5)


def test_top_k_of_the_longest_vectors(spark):
    """Past 38 digits scores tie; none is lost."""
    rows = [(i, [1e300, -1e300 if i % 2 else 1e300, float(i)]) for i in range(20)] + [(20, [0.0, 0.0, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 10 = 0").collect()
    assert sorted((r.query_id, r.rank) for r in got) == [(q, n) for q in (0, 10, 20) for n in range(1, 6)]
    assert {r.score for r in got if r.query_id == 0} == {(1 << 63) - 1} and {r.score for r in got if r.query_id == 20} == {0}


def test_top_k_over_many_slices(spark, monkeypatch):
    """Small slices and blocks, vectors of very different lengths, ties, and two dimensions."""
    monkeypatch.setattr(topk, "SLICE", 40)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = random.Random(8)
    rows = [(i, [rng.choice((-1.0, 0.0, 0.5, 1.0)) * 3.0 ** (i % 7) for _ in range(20 if i % 3 else 6)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.top_k(df, "vec_id % 10 = 0").collect()} == brute.top_k(rows, 10, 5)


def test_top_k_ties_and_repeats(spark):
    rows = [(5, [1.0, 1.0])] * 4 + [(10, [1.0, 1.0]), (10, [1.0, 1.0]), (0, [0.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("norm", F.lit("x"))
    got = [tuple(r) for r in topk.top_k(df, "vec_id % 10 = 0").orderBy("query_id", "rank").collect()]
    one = 2 * 256 * 256
    assert got == [(0, n, i, 0) for n, i in enumerate([5, 5, 5, 5, 10], 1)] + [(10, n, i, s) for n, (i, s) in enumerate([(5, one)] * 4 + [(0, 0)], 1)]


def test_quality_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = quality.quality_scores(spark.read.parquet(f"{d}/documents.parquet"), labels)
    both = out.join(labels, "doc_id").where("held_out and quality is not null").select("score", "predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in both) / len(both) > 0.9
    assert all(0 <= r.score <= 1 for r in both)


def test_empty_tables(spark):
    none = docs(spark, ["x"]).where("false")
    path, pattern = bytebpe.public_tokenizers.path(bytebpe.RANKS), bytebpe.public_tokenizers.PATTERN
    assert bytebpe.encode(none, path, pattern).count() == 0
    assert pii.find(none).count() == 0 and pii.masked(none).count() == 0
    assert partenum.ngram_jaccard_components(none).count() == 0
    assert spotsigs.neighbours(none).count() == 0
    out = scratch(spark, "test")
    tokenfiles.write_token_files(none, out, tokenfiles.public_tokenizers.path(tokenfiles.TOKENIZER))
    assert tokenfiles.read_token_files(spark, out).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 50 = 0").count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(none, labels).count() == 0


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, "a b c d the cat sat", 1, 2, 3), (5, "a b c d the cat sat", 1, 2, 3), (5, "a b c d the cat sat", 1, 2, 3), (5, None, None, None, None), (7, "x@y.zz +1 555 123 4567", 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, ids int, spans int").withColumn("hits", F.lit("h"))
    path, pattern = bytebpe.public_tokenizers.path(bytebpe.RANKS), bytebpe.public_tokenizers.PATTERN
    assert bytebpe.encode(df, path, pattern).count() == 5
    assert pii.find(df).count() == 5
    got = partenum.ngram_jaccard_components(df).collect()
    assert len(got) == 5 and {r.component_id for r in got if r.doc_id is None} == {None}
    assert spotsigs.neighbours(df).where("guest = 0").count() == 5
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(df, labels).count() == 5
