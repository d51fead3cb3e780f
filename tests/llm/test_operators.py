"""Packing, licence scan, discovered personal data and the pipeline's stages, on small tables."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as pipeline
from rivulet.llm import licences, packing, pii
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def test_pack_fills_and_downsizes():
    rng = np.random.default_rng(1)
    sizes = np.sort(np.minimum(rng.geometric(1 / 700, 5000), 8192))[::-1]
    bins, starts, final = packing.pack(sizes)
    used = np.bincount(bins, weights=sizes)
    assert (used <= final).all() and set(final.tolist()) <= set(packing.LENGTHS)
    order = np.lexsort((starts, bins))
    same = bins[order][1:] == bins[order][:-1]
    assert (starts[order][1:][same] == (starts + sizes)[order][:-1][same]).all()
    smaller = {c: max([0, *(x for x in packing.LENGTHS if x < c)]) for c in packing.LENGTHS}
    assert all(u > smaller[c] for u, c in zip(used, final, strict=True))  # no bin could be smaller
    assert sizes.sum() / final.sum() > 0.99


@pytest.mark.parametrize("seed", range(6))
def test_pack_against_a_plain_version(seed):
    rng = np.random.default_rng(seed)
    lengths = (8, 16, 32, 64)
    sizes = np.sort(np.minimum(rng.geometric(1 / (3 + 4 * seed), 150), 64))[::-1]
    cost = lambda c: 2 + c * (1 + c / 512)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(packing, "bin_cost", cost)
        bins, starts, final = packing.pack(sizes, lengths)
    want, capacity = brute.pack(sizes.tolist(), lengths, cost)
    assert [np.flatnonzero(bins == b).tolist() for b in range(len(final))] == want and final.tolist() == capacity
    assert all(starts[b[k]] == sizes[b[:k]].sum() for b in want for k in range(len(b)))


def test_mixed_lengths_cost_less():
    """Several lengths together cost no more than the largest alone, and all of them are opened where pieces differ."""
    rng = np.random.default_rng(2)
    for mean in (60, 300, 1500):
        sizes = np.sort(np.minimum(rng.geometric(1 / mean, 4000), 8192))[::-1]
        final = packing.pack(sizes)[2]
        alone = packing.pack(sizes, packing.LENGTHS[-1:])[2]
        assert sum(map(packing.bin_cost, final.tolist())) < sum(map(packing.bin_cost, alone.tolist()))
        assert len(set(final.tolist())) > 1


def test_equal_rows_are_dealt_evenly(spark):
    """One document's row, many times over: shards follow row numbers, not contents."""
    df = spark.range(4000).selectExpr("7L as doc_id", "20000L as n_tokens")
    got = packing.packed(df, shard_rows=1000).selectExpr("bin_id >> 32 as shard").groupBy("shard").count().collect()
    assert len(got) == 12 and max(r["count"] for r in got) < 1300


def test_packed_covers_every_row(spark):
    rows = [(1, 5), (1, 5), (None, 3), (2, 20_000), (3, 8192), (4, 8193), (5, 0)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = packing.packed(df, shard_rows=4).collect()
    total = defaultdict(int)
    for r in got:
        total[r.doc_id] += r.n_tokens
        assert r.bin_start + r.n_tokens <= r.capacity and r.n_tokens <= 8192
    assert dict(total) == {1: 10, None: 3, 2: 20_000, 3: 8192, 4: 8193, 5: 1}
    assert packing.packed(df.where("false")).count() == 0


def test_word_lengths(spark):
    got = {r.doc_id: r.n_tokens for r in packing.word_lengths(docs(spark, [None, "", " a  b\n", "x"])).collect()}
    assert got == {0: 1, 1: 1, 2: 3, 3: 2}


def test_licences(spark):
    plain = licences.TEMPLATES[0][1]
    texts = [
        f"Words before.\n{plain} And after.",
        "é\n" + plain.replace("under the", "under"),
        "Released under the BSD License.",
        plain.replace("2.0", "3.0"),
        f"{plain}\nfiller\n{plain}",
        "a licence for all of it",
        None,
        "",
    ]
    got = defaultdict(list)
    for r in licences.scan(docs(spark, texts)).collect():
        got[r.doc_id].append(r)
        assert texts[r.doc_id][r.start : r.end].startswith("Licensed") and r.saved > 0
    assert {k: [r.license for r in v] for k, v in got.items()} == {0: ["Apache-2.0"], 1: ["Apache-2.0"], 4: ["Apache-2.0"] * 2}
    assert (got[1][0].missing, got[1][0].extra, got[1][0].wording) == (1, 0, "-the")
    assert got[0][0].wording == ""


def test_licences_against_all_templates(spark):
    """Every sentence with a cue, judged without the compression ranking: same licence where only one template fits."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r.doc_id: r.text for r in rows.collect()}
    found = licences.scan(rows).collect()
    exact = {t: n for n, t in licences.TEMPLATES}
    hits = {(r.doc_id, r.start, r.license) for r in found}
    for d, t in text.items():
        for template, name in exact.items():
            for m in re.finditer(re.escape(template), t or ""):
                assert (d, m.start(), name) in hits


def test_unseen_identifiers(spark):
    known = [f"please call me +1 555 123 45{i:02d} now" for i in range(12)]
    unseen = "please call me 555-123-9999 now"
    other = ["it is one of the 12345678 things"] * 5 + ["some of the words of the text"] * 5
    texts = [*known, unseen, *other, None, ""]
    got = {r.doc_id: r for r in pii.find(docs(spark, texts)).collect()}
    at = unseen.index("555")
    assert [tuple(s) for s in got[12].spans] == [(at, 3, at + 12)] and not got[12].base
    assert all(not got[i].spans for i in range(13, len(texts)))
    assert [r.text for r in pii.masked(docs(spark, texts)).orderBy("doc_id").collect()][12] == "please call me [phone] now"


def masked(text):
    if text is None:
        return None
    for kind, pattern in brute.KINDS.items():
        out, last = [], 0
        for m in re.finditer(pattern, text):
            if any((a, b, k) == (m.start(), m.end(), kind) for a, _, k, b in brute.base_spans(text)):
                out += [text[last : m.start()], f"[{kind}]"]
                last = m.end()
        text = "".join([*out, text[last:]])
    return text


def test_stages(spark):
    docs_ = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r.doc_id: r.text for r in docs_.collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    read = lambda df: {r.doc_id: r for r in df.collect()}
    good = read(pipeline.quality_stage(spark, docs_, SMALL))
    assert all(good[d].text == text[d] for d in good)
    wrong = [d for d, r in labels.items() if r.quality is not None and (d in good) != (r.quality == 1)]
    assert len(wrong) <= 0.05 * len(labels)
    calm = read(pipeline.toxicity_stage(spark, docs_, SMALL))
    wrong = [d for d, r in labels.items() if r.toxic == 0 and d not in calm]
    assert len(wrong) <= 0.02 * len(labels)
    kept = read(pipeline.near_duplicate_stage(spark, docs_, SMALL))
    component = brute.jaccard_components(sorted(text.items()), 5, 80)
    assert set(kept) == {d for d, (_, c) in component.items() if c == d}
    clean = read(pipeline.pii_stage(spark, docs_, SMALL))
    assert {d: r.text for d, r in clean.items()} == {d: masked(t) for d, t in text.items()}
    assert all(r.n_chars == len(r.text or "") for r in clean.values())
    rows = pipeline.packing_stage(spark, docs_, SMALL).collect()
    lengths = {d: len(ids) for d, ids in zip(text, brute.word_ids([t or "" for t in text.values()]), strict=True)}
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.n_tokens
    assert got == lengths


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES[:4]])
def test_stages_on_empty_and_odd_tables(spark, stage):
    none = docs(spark, ["x"]).where("false")
    assert stage(spark, none, SMALL).columns == pipeline.COLUMNS and stage(spark, none, SMALL).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a plain text", "en", "s", 12)], DOCS)
    assert stage(spark, odd, SMALL).columns == pipeline.COLUMNS and stage(spark, odd, SMALL).count() <= 4
