"""Whole jobs: what stages and operators must not leave out."""

import difflib
import random
import re
import textwrap
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from rivulet.llm import licences, packing, partenum, pii, setjoin
from tests.llm import brute
from tests.llm.test_contracts import near_copies
from tests.llm.test_operators import SMALL, docs


def test_near_duplicate_stage_takes_four_fifths(spark):
    """Two substitutions far apart in 102 words: 88 of 108 five-word shingles, 94 of 106 three-word shingles."""
    words = [f"w{i}" for i in range(102)]
    other = ["x" if i in (30, 70) else w for i, w in enumerate(words)]
    kept = pipeline.near_duplicate_stage(spark, docs(spark, [" ".join(words), " ".join(other)]), SMALL).collect()
    assert [r.doc_id for r in kept] == [0]


def test_near_duplicate_stage_on_a_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    component = brute.jaccard_components(sorted((r.doc_id, r.text) for r in rows.collect()), 5, 80)
    kept = {r.doc_id for r in pipeline.near_duplicate_stage(spark, rows, SMALL).collect()}
    assert kept == {d for d, (_, c) in component.items() if c == d}


def test_four_fifths_components(spark):
    """Many near copies, and a group in which stars alone do not find every link."""
    rng = random.Random(3)
    base = [f"v{i}" for i in range(90)]
    chain = []
    for _ in range(60):
        base = list(base)
        base[rng.randrange(90)] = f"y{rng.randrange(40)}"
        chain.append(" ".join(base))
    rows = list(enumerate(near_copies() + chain))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.ngram_jaccard_components(docs(spark, [t for _, t in rows]), partenum.FOUR_FIFTHS).collect()}
    assert got == brute.jaccard_components(rows, 5, 80)


def test_sketches_rule_out_no_link():
    rng = np.random.default_rng(4)
    may, links = setjoin._may_link(80, 100), setjoin._links(80, 100)
    out = set()
    for _ in range(3000):
        n = int(rng.integers(4, 300))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.r_[rng.permutation(a)[int(rng.integers(0, 1 + n // 4)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 4))).astype(np.uint64)])
        can, do = may(setjoin.sketch(a), setjoin.sketch(b)), links(a.tobytes(), b.tobytes())
        assert can or not do
        out.add((can, do))
    assert {(True, True), (False, False)} <= out


def scanned(text):
    return [(a, b, name) for a, b, name, *_ in licences.Scanner(licences.TEMPLATES).found(text)]


@pytest.mark.parametrize("joined", [2, 200_000])
def test_runs_name_what_they_join_once(monkeypatch, joined):
    monkeypatch.setattr(setjoin, "JOINED", joined)
    rng = random.Random(5)
    groups = [rng.sample(range(10**6), 200) for _ in range(6)]
    sets = {10 * g + i: np.array(sorted(rng.sample(x, 195)), np.uint64) for g, x in enumerate(groups) for i in range(8)}
    runs = [sorted(rng.sample(sorted(sets), 20)) for _ in range(30)]
    rows = [(t, 0, r, r, setjoin.sketch(sets[r])) for t, run in enumerate(runs) for r in run]
    cols = [pa.array(c, pa.binary() if i == 4 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))]
    batch = pa.record_batch(cols, ["task", "side", "rid", "comp", "elems"])
    out = [p for b in setjoin._partners(80, 100)(iter([batch])) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    may = setjoin._may_link(80, 100)
    plain = [(a, b) for run in runs for a in run for b in run if a < b and may(setjoin.sketch(sets[a]), setjoin.sketch(sets[b]))]
    apart: dict[int, int] = {}
    many = sum(setjoin._joins(apart, a, b) for a, b in plain)
    got: dict[int, int] = {}
    assert sum(setjoin._joins(got, a, b) for a, b in out) >= many
    assert all(setjoin._top(got, a) == setjoin._top(got, b) for a, b in plain)
    if joined > len(sets):
        assert len(out) == len({b for _, b in out} | {a for a, _ in out}) - len({setjoin._top(got, x) for p in out for x in p})


def test_every_template_verbatim_and_wrapped():
    for name, template in licences.TEMPLATES:
        lines = textwrap.wrap(template, 70 if len(template) > 70 else 30)
        for text in (template, "\n".join(lines), "\n".join("# " + x for x in lines), "/*\n * " + "\n * ".join(lines) + "\n */"):
            for whole in (text, f"Copyright of someone.\n\n{text}\n\nOther words follow here."):
                got = scanned(whole)
                assert [x[2] for x in got] == [name], (name, whole, got)
                assert whole[got[0][0] : got[0][1]].split()[0] == template.split()[0] and got[0][1] >= whole.index(lines[-1].split()[-1])


def licence_windows(text, templates):
    """(first, end, licence, missing + extra) of every window of words that some template confirms, each against each."""
    spans = [m.span() for m in re.finditer(r"[^\W_]+", text)]
    words = [text[a:b].lower() for a, b in spans]
    out = []
    for name, template in templates:
        own = [w.lower() for w in re.findall(r"[^\W_]+", template)]
        most = len(own) // 4
        for i in range(len(words)):
            for j in range(i + len(own) - most, min(len(words), i + len(own) + most) + 1):
                gone, new = [], []
                for kind, a, b, c, d in difflib.SequenceMatcher(None, own, words[i:j], autojunk=False).get_opcodes():
                    if kind != "equal":
                        gone += own[a:b]
                        new += words[i:j][c:d]
                if max(len(gone), len(new)) <= most and not any(w in licences.MARKS or re.search(r"\d", w) for w in gone + new):
                    out.append((spans[i][0], spans[j - 1][1], name, len(gone) + len(new)))
    return out


def test_licences_against_every_window():
    """Near wordings, verbatim ones, ones too far off, in plain prose: what the scan reports is what comparing every window
    with every template finds."""
    rng = random.Random(12)
    few = [licences.TEMPLATES[i] for i in (0, 1, 3, 4, 7, 9, 19, 24, 27, 29)]
    filler = [w for _, t in few for w in re.findall(r"\w+", t) if not licences._mark(w.lower())] + ["lorem", "ipsum", "dolor"]
    counts = Counter()
    for n in range(120):
        name, template = rng.choice(few)
        words = template.split()
        for _ in range(rng.randrange(0, 2 + len(words) // 3)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [rng.choice(filler)] * rng.randrange(2)
            words = words or ["x"]
        sep = rng.choice((" ", "\n", "\n# "))
        text = " ".join(rng.choices(filler, k=rng.randrange(12))) + ".\n" + sep.join(words) + sep + " ".join(rng.choices(filler, k=rng.randrange(12)))
        every = licence_windows(text, few)
        got = [(a, b, x) for a, b, x, *_ in licences.Scanner(few).found(text)]
        for a, b, x in got:  # confirmed by the plain comparison as well
            assert any(x == y and i < b and j > a for i, j, y, _ in every), (text, got)
        fewest = {}
        for _, _, x, d in every:
            fewest[x] = min(d, fewest.get(x, d))
        counts["should"] += bool(every)
        counts["found"] += bool(every) and bool(got)
        counts["absent"] += not every
        counts["named"] += bool(got) and min(fewest, key=fewest.get) in {x for *_, x in got}
    assert counts["absent"] > 10 and counts["should"] > 40
    assert counts["found"] == counts["should"] and counts["named"] >= 0.95 * counts["found"], counts


def test_real_notices():
    """Notices as they stand in source files."""
    mit = "\n".join(" * " + x for x in textwrap.wrap(licences.TEMPLATES[6][1], 76))
    assert [x[2] for x in scanned("/*\n * Copyright (c) 2020 A. Author\n *\n" + mit + "\n */\nint main(void) { return 0; }")] == ["MIT"]
    for i, name in ((11, "GPL-3.0"), (17, "LGPL-3.0"), (26, "BSD-3-Clause"), (28, "ISC"), (30, "MPL-2.0"), (2, "Apache-2.0")):
        assert [x[2] for x in scanned("\n".join("// " + x for x in textwrap.wrap(licences.TEMPLATES[i][1], 76)))] == [name]
    both = licences.TEMPLATES[28][1] + "\n\n" + licences.TEMPLATES[6][1]
    assert [x[2] for x in sorted(scanned(both))] == ["ISC", "MIT"]


def test_licences_in_odd_tables(spark):
    """Null and empty texts, null and repeated ids, other columns, a very long text, an empty table."""
    plain = licences.TEMPLATES[0][1]
    rows = [(None, plain, "x"), (1, plain, "x"), (1, plain, "x"), (2, None, "x"), (3, "", "x"), (4, "the license of the software " * 200_000 + plain, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = licences.scan(df).collect()
    assert sorted((r.doc_id or 0, r.license) for r in got) == [(0, "Apache-2.0"), (1, "Apache-2.0"), (1, "Apache-2.0"), (4, "Apache-2.0")]
    assert licences.scan(df.where("false")).count() == 0


def test_other_versions_are_not_confirmed():
    for text in ("Licensed under the Apache License, Version 3.0.", "This work is licensed under the GNU General Public License, version 3.1.", "Licensed under CC BY 4.0-NC.", "Released under the BSD License."):
        assert scanned(text) == []


def test_templates_beyond_the_third_rank_are_tried():
    family = [(f"L{c}", f"This work is licensed under the common family public terms, letter {c}2 only.") for c in "abcdefg"]
    for name, template in family:
        assert [x[2] for x in licences.Scanner(family).found(template)] and [x for x in licences.Scanner(family).found(template)][0][2] == name


def test_packed_lengths_are_tokens(spark):
    texts = [None, "", "unbelievable antidisestablishmentarianism, twice", "aGVsbG8gd29ybGQ" * 3000]
    want = {i: len(ids) for i, ids in enumerate(brute.word_ids([t or "" for t in texts]))}
    assert want[3] > max(packing.LENGTHS)
    assert {r.doc_id: r.n_tokens for r in packing.token_lengths(docs(spark, texts)).collect()} == want
    got = Counter()
    for r in pipeline.packing_stage(spark, docs(spark, texts), SMALL).collect():
        got[r.doc_id] += r.n_tokens
        assert r.n_tokens <= max(packing.LENGTHS)
    assert got == want


def test_pii_contexts_are_of_the_whole_text(spark):
    """The two words before the word of an instance, whatever matched before and however long they are."""
    long = "x" * 90
    texts = ["account 2024 number 12345678", f"{long} b +1 555 123 4567", " \n one two\tthree:1.2.3.4,5.6.7.8 id 99999", "one 12345678", " a@b.co", "Two words a@b.co c@d.ee"]
    df = docs(spark, texts).select(F.col("doc_id").alias("row"), F.concat(*map(pii._found, pii.PATTERNS)).alias("hits"), pii._contexts().alias("contexts"))
    got = {(r.row, r.surface): r.pattern for r in pii._instances(df).collect()}
    assert got[0, "12345678"] == "2024 number"
    assert got[1, "+1 555 123 4567"] == f"{long} b"
    assert got[2, "1.2.3.4"] == got[2, "5.6.7.8"] == "one two" and got[2, "99999"] == "three:1.2.3.4,5.6.7.8 id"
    assert got[3, "12345678"] is None and got[4, "a@b.co"] is None
    assert got[5, "a@b.co"] == "two words" and got[5, "c@d.ee"] == "words a@b.co"


def test_pii_unseen_after_a_number(spark):
    known = [f"in 2024 please call +1 555 123 45{i:02d} now" for i in range(12)]
    texts = [*known, "in 2024 please call 555-123-9999 now", "of 7 call 2024 please call 555-123-8888 now"]
    got = {r.doc_id: len(r.spans) for r in pii.find(docs(spark, texts)).collect()}
    assert got[12] == got[13] == 1


def made_up_letters(seed: int) -> list[str]:
    """Texts in which some contexts are of one kind, some of two, and some of none."""
    rng = random.Random(seed)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kinds = [lambda: f"+1 555 {number(3)} {number(4)}", lambda: f"a{number(3)}@b.co", lambda: f"10.0.{rng.randrange(256)}.7", lambda: number(8), lambda: f"{number(3)}-{number(4)}", lambda: f"({number(6)})", lambda: "plain", lambda: f"u{number(5)}@host"]
    fronts = ["call me", "write to", "from host", "order number", "note (", "id no", "Call ME"]
    ids = ["77001122", "77001133", "me@site"]  # the same unseen ones in several contexts: rounds build on each other
    out = []
    for _ in range(90):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            front = rng.choice(fronts)
            liked = {"call me": 0, "Call ME": 0, "write to": 1, "from host": 2}.get(front)
            what = kinds[liked]() if liked is not None and rng.random() < 0.8 else rng.choice(kinds)()
            parts.append(f"{front}{rng.choice((' ', '', chr(10)))}{rng.choice(ids) if rng.random() < 0.2 else what}{rng.choice(('', ',', '.'))}")
        out.append(rng.choice((" ", "\n", " and ")).join(parts))
    return [*out, "", "77001122", "x 77001122", "1.2.3.4,5.6.7.8"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pii_discovery_against_a_plain_version(spark, seed):
    texts = made_up_letters(seed)
    want = brute.discovered(texts)
    got = {r.doc_id: r for r in pii.find(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = {tuple(s) for s in got[i].base}
        assert sorted((s.start, s.end, pii.KINDS[s.kind_no]) for s in got[i].spans if tuple(s) not in base) == want[i], t
    assert sum(map(len, want)) > 3
    masked = {r.doc_id: r.text for r in pii.masked(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        spans = [(a, b, k) for a, _, k, b in brute.base_spans(t)] + want[i]
        if len({x for a, b, _ in spans for x in range(a, b)}) == sum(b - a for a, b, _ in spans):  # none overlap
            for a, b, k in sorted(spans, reverse=True):
                t = f"{t[:a]}[{k}]{t[b:]}"
            assert masked[i] == t


def test_pii_masks_whole_words(spark):
    known = [f"please call me +1 555 123 45{i:02d} now" for i in range(12)]
    texts = [*known, "please call me 555123 and not 9995551234 or 555123x", "at 555123\n555123"]
    got = {r.doc_id: r.text for r in pii.masked(docs(spark, texts)).collect()}
    assert got[12] == "please call me [phone] and not 9995551234 or 555123x" and got[13] == "at [phone]\n[phone]"


def test_pii_counts_places_once(spark):
    """A seed glued to its context, and two in one word: unrelated numbers after the same words are left alone."""
    texts = [f"note (+1 555 123 45{i:02d}" for i in range(12)] + [f"note ( 202300{i:02d}" for i in range(15)] + [f"see the 1.1.1.{i},2.2.2.{i} or" for i in range(6)] + [f"see the 123456{i}8 or" for i in range(9)]
    assert all(len(r.spans) == len(r.base) for r in pii.find(docs(spark, texts)).collect())


def test_pii_without_a_broadcast(spark, monkeypatch):
    texts = made_up_letters(4)
    want = sorted((r.doc_id, str(r.spans)) for r in pii.find(docs(spark, texts)).collect())
    monkeypatch.setattr(pii, "BROADCAST_PATTERNS", 0)
    assert sorted((r.doc_id, str(r.spans)) for r in pii.find(docs(spark, texts)).collect()) == want


def test_bsd_family():
    """What all BSD licences share names the family only; clauses tell the members apart."""
    two = licences._BSD + licences._BSD_TWO
    three, four = two + licences._BSD_THREE, two + licences._BSD_ADVERTISING + licences._BSD_THREE.replace("3.", "4.")
    texts = {"BSD-4-Clause": four + licences._BSD_WARRANTY, "BSD-3-Clause": three + licences._BSD_WARRANTY, "BSD-2-Clause": two + licences._BSD_WARRANTY, "BSD": licences._BSD}
    for name, text in texts.items():
        assert [x[2] for x in scanned(f"Some words before it. {text} And after.")] == [name]
    assert [x[2] for x in scanned(two)] == ["BSD"]
