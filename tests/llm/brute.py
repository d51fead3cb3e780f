"""Plain versions of the operators' contracts, one document or pair at a time."""

from __future__ import annotations

import hashlib
import math
import operator
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from tiktoken.load import load_tiktoken_bpe
from tokenizers import Tokenizer

from rivulet.llm import spotsigs

EMPTY = hashlib.sha256(b"").hexdigest()
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, number of the kind, kind, end) in order."""
    out = []
    for no, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".") if x) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), no, kind, m.end()))
    return sorted(out)


def base_digest(text: str) -> tuple[list[int], str]:
    spans = base_spans(text)
    counts = [sum(s[1] == i for s in spans) for i in range(4)]
    return counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()


def shingle_set(text: str, n: int = 3) -> frozenset:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def jaccard_components(rows: list[tuple[int, str | None]], words: int = 3, percent: int = 90) -> dict[int, tuple[int, int]]:
    """doc_id to (size, least doc_id of its component)."""
    sets = [(d, shingle_set(t or "", words)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets}


def word_ids(texts: list[str]) -> list[list[int]]:
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [t.encode(x, add_special_tokens=False).ids + [1] for x in texts]


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def byte_encoding():
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def top_k(rows: list[tuple[int, list | None]], every: int, k: int) -> set[tuple[int, int, int, int]]:
    good = [(i, [math.floor(256.0 * x) for x in v]) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v))]
    out = set()
    for q, a in good:
        if q % every == 0:
            scores = sorted((-sum(map(operator.mul, a, b)), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out |= {(q, n + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(scores)}
    return out


SPACE = r"[\x20\x09-\x0D]+"


def discovered(texts: list[str], least_seeds: int = 3, confident: float = 0.6, accept: float = 0.6, least_size: int = 5) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) of the unseen identifiers of each text."""
    seeds, words, total = [], [], Counter()
    for row, text in enumerate(texts):
        base = base_spans(text)
        runs = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        low = [text[a:b].lower() for a, b in runs]
        total.update(f"{x} {y}" for x, y, _ in zip(low, low[1:], low[2:], strict=False))
        before = {i: f"{low[i - 2]} {low[i - 1]}" for i in range(2, len(low))}
        for a, _, kind, b in base:
            i = next(i for i, (x, y) in enumerate(runs) if x <= a < y)
            if i in before:
                seeds.append((kind, text[a:b], before[i], (row, i)))
        for i, (a, b) in enumerate(runs):
            surface = text[a:b]
            if len(surface) >= least_size and ("@" in surface or len(re.sub("[^0-9]", "", surface)) >= 4) and all(y <= a or x >= b for x, _, _, y in base) and i in before:
                words.append((surface, before[i], (row, i), (a, b)))
    accepted: dict[str, str] = {}
    while True:
        own = seeds + [(accepted[s], s, p, at) for s, p, at, _ in words if s in accepted]
        surfaces, places = defaultdict(set), defaultdict(set)
        for kind, surface, pattern, at in own:
            surfaces[kind, pattern].add(surface)
            places[kind, pattern].add(at)
        sure = {k: len(places[k]) / (total[k[1]] + 1) for k in places if len(surfaces[k]) >= least_seeds}
        fresh: dict[str, tuple[float, str]] = {}
        for surface in {s for s, *_ in words} - set(accepted):
            for kind in KINDS:
                ok = "@" in surface if kind == "email" else len(re.sub("[^0-9]", "", surface)) >= 6
                found = [c for p in {p for s, p, *_ in words if s == surface} if (c := sure.get((kind, p), 0)) >= confident]
                if ok and found:
                    score = 1 - math.prod(1 - c for c in found)
                    if score >= accept:
                        fresh[surface] = max(fresh.get(surface, (0, "")), (score, kind))
        if not fresh:
            break
        accepted |= {s: kind for s, (_, kind) in fresh.items()}
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for surface, _, (row, _), (a, b) in words:
        if surface in accepted:
            out[row].append((a, b, accepted[surface]))
    # words without two words before them are instances too
    for row, text in enumerate(texts):
        base = base_spans(text)
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
            if m[0] in accepted and (m.start(), m.end(), accepted[m[0]]) not in out[row] and all(y <= m.start() or x >= m.end() for x, _, _, y in base):
                out[row].append((m.start(), m.end(), accepted[m[0]]))
    return [sorted(x) for x in out]


def pack(sizes: list[int], lengths: tuple[int, ...], cost) -> tuple[list[list[int]], list[int]]:
    """Items (by number) of each bin and its final length; sizes descend."""
    bins, rooms, changed = [], [], []
    for i, size in enumerate(sizes):
        fits = [(room, -changed[b], b) for b, room in enumerate(rooms) if room >= size]
        if fits:
            b = min(fits)[2]
        else:
            best = None
            for c in sorted(lengths):
                if c >= size:
                    used = size
                    for other in sizes[i + 1 :]:
                        used += other if used + other <= c else 0
                    if best is None or cost(c) / used < best[0]:
                        best = cost(c) / used, c
            b = len(bins)
            bins.append([])
            rooms.append(best[1])
            changed.append(i)
        bins[b].append(i)
        rooms[b] -= size
        changed[b] = i
    return bins, [min(c for c in lengths if c >= sum(sizes[i] for i in b)) for b in bins]


def ordinal(x: np.ndarray, y: np.ndarray, weights: np.ndarray, cuts: np.ndarray, l2: float) -> float:
    """Penalised negative log likelihood of the cumulative-link model, row by row."""
    total = 0.5 * l2 * float(weights @ weights)
    for row, grade in zip(x, y, strict=True):
        s = float(row @ weights)
        below = [0.0, *(1 / (1 + math.exp(-(c - s))) for c in cuts), 1.0]
        total -= math.log(max(1e-12, below[grade + 1] - below[grade]))
    return total


#: As the fingerprint's definition: common words of four languages.
COMMON = set(spotsigs.ANCHORS)


def spot_set(text: str) -> frozenset:
    """Spots as tuples of words."""
    words = re.findall(r"\w+", text.lower())
    out = set()
    for i, w in enumerate(words):
        if w in COMMON:
            chain = [x for x in words[i + 1 :] if x not in COMMON][:2]
            if len(chain) == 2:
                out.add((w, *chain))
    return frozenset(out) or frozenset([" ".join(words)])


def components(sets: dict[int, frozenset], num: int, den: int) -> dict[int, int]:
    """The least id that links reach."""
    root = {d: d for d in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}
