"""Licence scan by conditional compression.

Templates are the notices, headers and short full texts of public licences. A window of a text is a candidate for a
template of L words if it could be confirmed: a confirmed block lacks at most m = L / 4 of the template's words and adds at
most as many, so at least L - 1 - 3 m of the template's word pairs stand in it unbroken, within L + m words. No other
filter is set: no block that could be confirmed is passed over for its words, and comment marks, line ends and full stops
do not end it. Inside the window difflib's matching blocks give the block with the fewest differences. Each candidate block is compressed alone and with every template as a zstandard raw
dictionary, white space and comment marks made one space; the templates are ranked by the bytes that they save, and the
first of them (down to those that save none) that the exact differences of wording confirm wins: the words of the
template that the block lacks and the words it adds, in order, letters and digits only. None of these may have a digit or
be in MARKS. Differences are those of difflib's matching blocks, too.

One row for each confirmed block, with code-point offsets in the whole text; several rows if a text repeats a licence.
Where blocks of several templates overlap the one that saves most bytes stays, of equals the one with fewer differences,
then the first template. Null and empty texts and an empty table give no rows. Repeated rows are scanned each, a null doc_id like any other. Very long
texts are scanned whole. Other columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from rivulet.llm.common import pieces, table

#: Opening statements, notices, headers and short full texts of public licences, by SPDX identifier.
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
_MIT_REST = ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_NOTICE = " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
_APACHE_REST = ' You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_ADVERTISING = " 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_BSD_THREE = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GNU_REST = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details. You should have received a copy of the GNU {} along with this program. If not, see <https://www.gnu.org/licenses/>."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + _APACHE_REST),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT_GRANT + "."),
    ("MIT", _MIT_GRANT + _MIT_REST),
    ("MIT", _MIT_GRANT + _MIT_REST + _MIT_NOTICE + _MIT_WARRANTY),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-3.0", _GNU.format(_GPL, 3)),
    ("GPL-2.0", _GNU.format(_GPL, 2)),
    ("LGPL-3.0", _GNU.format(_LGPL, 3)),
    ("AGPL-3.0", _GNU.format(_AGPL, 3)),
    ("GPL-3.0", _GNU.format(_GPL, 3) + _GNU_REST.format(_GPL, _GPL)),
    ("GPL-2.0", _GNU.format(_GPL, 2) + _GNU_REST.format(_GPL, _GPL)),
    ("LGPL-3.0", _GNU.format(_LGPL, 3) + _GNU_REST.format(_LGPL, _LGPL)),
    ("AGPL-3.0", _GNU.format(_AGPL, 3) + _GNU_REST.format(_AGPL, _AGPL)),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD", _BSD),  # the opening that all of them share: a family's name
    ("BSD-2-Clause", _BSD + _BSD_TWO + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD + _BSD_TWO + _BSD_THREE + _BSD_WARRANTY),
    ("ISC", _ISC),
    ("ISC", _ISC + _ISC_WARRANTY),
    ("MPL-2.0", _MPL),
    ("MPL-2.0", _MPL + " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSD", _BSD + _BSD_TWO),
    ("BSD-4-Clause", _BSD + _BSD_TWO + _BSD_ADVERTISING + _BSD_THREE.replace("3.", "4.") + _BSD_WARRANTY),
]
#: Words whose change makes another licence.
MARKS = frozenset("advertising apache mit gnu gpl lgpl agpl lesser affero bsd cc by nc sa nd mozilla mpl isc sharealike noncommercial".split())
MOST_DIFFERENT = 0.25
LEVEL = 3
WORDS_KEPT = 300_000
FOUND = "doc_id long, start long, end long, license string, saved double, missing int, extra int, wording string"
_WORD = re.compile(r"[^\W_]+")
_GAP = re.compile(r"(?:\s|(?<!\S)(?:[#*;%|]+|//+|--+|/\*+|\*+/|<!--|-->)(?!\S))+")  # white space and comment marks
# what is joined to the last word, as a further part of a version or name, and the marks that end a sentence
_JOINED = re.compile(r"(?:[._@+-]+[^\W_]+)*[.!?:]*")
_BEFORE = re.compile(r"[._@+-]+")


def _mark(word: str) -> bool:
    return word in MARKS or any(c.isdigit() for c in word)


class _Template:
    """A licence's text, its words, and what a confirmed block must hold."""

    def __init__(self, name: str, text: str):
        self.name, self.words = name, [w.lower() for w in _WORD.findall(text)]
        self.most = int(MOST_DIFFERENT * len(self.words))
        self.least_pairs = max(1, len(self.words) - 1 - 3 * self.most)
        raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False)
        self.marks = frozenset(filter(_mark, self.words))

    def wording(self, words: list[str]) -> tuple[list[str], list[str]] | None:
        """Words that a block lacks and adds, if these differences confirm it."""
        gone, new = [], []
        for kind, a, b, c, d in difflib.SequenceMatcher(None, self.words, words, autojunk=False).get_opcodes():
            if kind != "equal":
                gone += self.words[a:b]
                new += words[c:d]
        return None if max(len(gone), len(new)) > self.most or any(map(_mark, gone + new)) else (gone, new)


class Scanner:
    """Compressors, words and word pairs of the templates."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.each = [_Template(*t) for t in templates]
        names = sorted({w for t in self.each for w in t.words})
        self.number = {w: i + 1 for i, w in enumerate(names)}
        self.size = len(names) + 1
        self.own: dict[str, int] = {}  # numbers of words as they are written, 0 for those of no template
        rows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, t in enumerate(self.each):
            for j, (a, b) in enumerate(zip(t.words, t.words[1:], strict=False)):
                rows[self.number[a] * self.size + self.number[b]].append((i, j))
        self.places = rows  # pair to (template, place)
        self.known = np.zeros(self.size * self.size, bool)
        self.known[list(rows)] = True
        self.kept: dict[tuple[str, ...], list] = {}

    def numbers(self, words: list[str]) -> np.ndarray:
        own = self.own
        for w in set(words).difference(own):
            if len(own) > WORDS_KEPT:
                own.clear()
                return self.numbers(words)
            own[w] = self.number.get(w.lower(), 0)
        return np.fromiter(map(own.__getitem__, words), np.int64, len(words))

    def windows(self, number: np.ndarray) -> Iterator[tuple[int, int]]:
        """(template, first word) of the windows that hold enough of a template's word pairs, each start once."""
        at = np.flatnonzero(number[:-1] * number[1:])
        key = number[at] * self.size + number[at + 1]
        hit = self.known[key]
        seen: dict[int, list[int]] = defaultdict(list)  # where a template would start for the pair to be in place
        for p, k in zip(at[hit].tolist(), key[hit].tolist(), strict=True):
            for i, j in self.places[k]:
                seen[i].append(p - j)
        for i, starts in seen.items():
            t = self.each[i]
            # pairs of one block lie on starts that differ by 2 m at most; a start within m of an anchor is in its window
            start = np.sort(np.array(starts))
            enough = np.searchsorted(start, start + 2 * t.most, "right") - np.arange(len(start)) >= t.least_pairs
            last = None
            for s in start[enough].tolist():
                if last is None or s > last + t.most:
                    last = s
                    yield i, s

    def blocks(self, words: tuple[str, ...], i: int) -> list[tuple[int, int]]:
        """(first, end) among words of the blocks that template i may confirm."""
        key = (str(i), *words)
        if key not in self.kept:
            if len(self.kept) > 20_000:
                self.kept.clear()
            self.kept[key] = self._blocks(words, self.each[i])
        return self.kept[key]

    @staticmethod
    def _blocks(words: tuple[str, ...], t: _Template) -> list[tuple[int, int]]:
        there = set(words)
        lost = [w for w in t.words if w not in there]
        if len(lost) > t.most or any(map(_mark, lost)):  # more words are missing than may, or one that must not
            return []
        same = [m for m in difflib.SequenceMatcher(None, t.words, words, autojunk=False).get_matching_blocks() if m.size]
        met = np.cumsum([0] + [m.size for m in same])
        best = None
        # a word far from the others can match by chance: each way to leave such ends out is tried, the one with the
        # fewest differences is the block
        for a in range(len(same)):
            if same[a].a > t.most:
                break
            for b in range(len(same) - 1, a - 1, -1):
                if len(t.words) - same[b].a - same[b].size > t.most:
                    break
                first, end = same[a].b, same[b].b + same[b].size
                gone, new = len(t.words) - int(met[b + 1] - met[a]), end - first - int(met[b + 1] - met[a])
                if max(gone, new) <= t.most and (best is None or (gone + new, first) < best[:2]):
                    best = gone + new, first, end
        return [best[1:]] if best else []

    def judge(self, block: str) -> tuple | None:
        """(bytes saved, share saved, template, missing, extra, wording) of the first template, by bytes saved, that the
        differences of wording confirm."""
        words, data = [w.lower() for w in _WORD.findall(block)], _GAP.sub(" ", block).encode()
        alone = len(self.plain.compress(data))
        rank = sorted((len(t.packer.compress(data)) - alone, i) for i, t in enumerate(self.each))
        for less, i in rank:
            if less >= 0:
                break
            if got := self.each[i].wording(words):
                gone, new = got
                return -less, -less / alone, i, len(gone), len(new), " ".join([f"-{w}" for w in gone] + [f"+{w}" for w in new])
        return None

    def found(self, text: str) -> Iterator[tuple]:
        """(start, end, licence, share saved, missing, extra, wording) of each confirmed block of a text."""
        written = _WORD.findall(text)
        if len(written) < 2:
            return
        wanted = sorted(set(self.windows(self.numbers(written))))
        if not wanted:
            return
        spans, low = [m.span() for m in _WORD.finditer(text)], [w.lower() for w in written]
        candidates: dict[tuple[int, int], tuple] = {}
        for i, start in wanted:
            t = self.each[i]
            first, stop = max(0, start - t.most), start + len(t.words) + 3 * t.most
            for a, b in self.blocks(tuple(low[first:stop]), i):
                a, b = first + a, first + b
                while a and _BEFORE.fullmatch(text, spans[a - 1][1], spans[a][0]):  # words joined to it count
                    a -= 1
                span = spans[a][0], _JOINED.match(text, spans[b - 1][1]).end()
                if span not in candidates and (got := self.judge(text[slice(*span)])):
                    candidates[span] = got
        done: list[tuple[int, int]] = []
        # what saves most first; the same block saves alike in templates of one family, so exact wording comes next
        for (start, end), got in sorted(candidates.items(), key=lambda x: (-x[1][0], x[1][3] + x[1][4], x[1][2], x[0])):
            if all(end <= a or start >= b for a, b in done):
                done.append((start, end))
                yield start, end, self.each[got[2]].name, got[1], got[3], got[4], got[5]


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """FOUND for each confirmed block of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(templates)
        names = [x.split()[0] for x in FOUND.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
        for batch in pieces(batches):
            out = [(d, *got) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for got in own.found(t)]
            yield pa.record_batch([pa.array([x[i] for x in out], k) for i, k in enumerate(types)], names)

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
