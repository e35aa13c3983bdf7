"""License scans: winnowed fingerprints propose, banded alignment reports.

Templates are cut into words; hashes of runs of `k` words are winnowed (the least of each window of
`w`), and an inverted index leads from fingerprint to templates and places. Every run of k words of
a document is looked up; each document's hits are clustered by template and place, and a banded
local alignment of the template with the words around a cluster gives the matched share of the
template's words (coverage) and the matched span of the text. Any common run of k + w - 1 words
holds a fingerprint. k and w are at most those of the settings, and smaller for a template where
the edits that the coverage leaves room for can break it into shorter runs: with e edited words (words
changed, left out or put in) of n, one run of (n - e) / (e + 1) words stays, and holds a fingerprint.
So each text within that many edits of a template is aligned. Clusters around which too few of the
template's words stand for the coverage are not. Where more words than the band were put in or left
out, what aligns on either side is chained, over at most `gap` words of the text.

Clusters with more hits come first; a place inside a match of a template is not tried for it again. The
index is the templates' (a parameter of bounded size: notices, headers and whole licenses), not the
corpus's. Nulls and empty texts match nothing. Texts are scanned whole; each copy of a notice is
reported. Repeated rows give equal rows. Of overlapping matches, the one with most matched words stays.
"""

from __future__ import annotations

import functools
import pkgutil
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.common import hash_words, small_batches, split_words, windows

#: Public notices, headers and short licenses (fixed values).
NOTICES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT-notice": "Licensed under the MIT License.",
    "MIT-release": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means.",
}

#: Longer licenses, each in a file of license_texts.
WHOLE = ("Apache-2.0", "Artistic-1.0", "CC0-1.0", "GFDL-1.3", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")


@functools.cache
def templates() -> dict[str, str]:
    """All templates by name."""
    return NOTICES | {name: pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode() for name in WHOLE}


EDGE = "\"'()[]{}<>.,;:!?*#|&%$“”‘’«»"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Settings:
    k: int = 3
    w: int = 3
    coverage: float = 0.8
    band: int = 12
    gap: int = 400
    templates: dict = field(default_factory=templates)


def plain(word: str) -> str:
    return word.strip(EDGE).lower()


def hashes(flat: pa.Array) -> np.ndarray:
    """Hashes of words without case and outer punctuation."""
    if not len(flat):
        return np.empty(0, np.uint64)
    coded = flat.dictionary_encode()
    known = hash_words(pa.array([plain(w) for w in coded.dictionary.to_pylist()], pa.large_string()))
    return known[coded.indices.to_numpy()]


def unbroken(n: int, coverage: float) -> int:
    """Words of the longest run that stays of n words after all edits that leave the coverage."""
    e = next(e for e in range(n, -1, -1) if n - e >= coverage * n)
    return -(-(n - e) // (e + 1))


class Index:
    """places: for each length of runs, templates and places by fingerprint; known: the fingerprints."""

    def __init__(self, s: Settings) -> None:
        self.s, self.names = s, list(s.templates)
        self.words = [hashes(pa.array(WORD.findall(t), pa.large_string())) for t in s.templates.values()]
        self.counts = [np.unique(w, return_counts=True) for w in self.words]
        self.places: dict[int, dict[int, list]] = {}
        for t, words in enumerate(self.words):
            if not len(words):
                continue
            run = max(1, unbroken(len(words), s.coverage))
            k = min(s.k, run)
            w = min(s.w, run - k + 1)
            runs = windows(words, k)
            for i in sorted({i + int(runs[i : i + w].argmin()) for i in range(max(1, len(runs) - w + 1))}):
                self.places.setdefault(k, {}).setdefault(int(runs[i]), []).append((t, i))
        self.known = {k: np.array(sorted(p), np.uint64) for k, p in self.places.items()}

    def seeds(self, words: np.ndarray, doc: np.ndarray) -> dict[int, dict[int, list[int]]]:
        """For each document with hits, by template: the places of its words at which the template would begin."""
        out: dict[int, dict[int, list[int]]] = {}
        for k, places in self.places.items():
            runs = windows(words, k)
            hits = np.flatnonzero(np.isin(runs, self.known[k]))
            hits = hits[doc[hits] == doc[hits + k - 1]]
            for at, d, key in zip(hits.tolist(), doc[hits].tolist(), runs[hits].tolist(), strict=True):
                mine = out.setdefault(d, {})
                for t, i in places[key]:
                    mine.setdefault(t, []).append(at - i)
        return out


UNIT = 1 << 32  # scores in the high bits, matched words in the low ones: one comparison decides by both


def align(template: np.ndarray, words: np.ndarray, shift: int, band: int) -> tuple[int, int, int, int, int]:
    """Banded local alignment: matched words, their first and last place in the template, and in the words.

    A match scores 2; a mismatch, an insertion or a deletion costs 1. Column j of row i stands for
    word i + shift + j - band. A row is made of the one before by whole arrays; words put in are a
    running maximum along the row.
    """
    width, n = 2 * band + 1, len(words)
    columns = np.arange(width)
    slope = columns * UNIT
    value, row0, word0 = np.zeros(width, np.int64), np.full(width, -1), np.full(width, -1)
    best = (0, -1, -1, -1, -1)
    for i in range(len(template)):
        at = i + shift + columns - band
        if at[-1] < 0 or at[0] >= n:
            value, row0, word0 = np.zeros(width, np.int64), np.full(width, -1), np.full(width, -1)
            continue
        inside = (at >= 0) & (at < n)
        same = inside & (words[np.clip(at, 0, n - 1)] == template[i])
        new = value + np.where(same, 2 * UNIT + 1, -UNIT)
        fresh = (value <= 0) & same
        r, w = np.where(fresh, i, row0), np.where(fresh, at, word0)
        up = np.append(value[1:] - UNIT, -UNIT)
        better = up > new
        new, r, w = np.where(better, up, new), np.where(better, np.append(row0[1:], -1), r), np.where(better, np.append(word0[1:], -1), w)
        new = np.where(inside, new, -UNIT)
        run = np.maximum.accumulate(new + slope)
        source = np.maximum.accumulate(np.where(new + slope == run, columns, 0))
        new, r, w = run - slope, r[source], w[source]
        alive = (new > 0) & inside
        value, row0, word0 = np.where(alive, new, 0), np.where(alive, r, -1), np.where(alive, w, -1)
        j = int(value.argmax())
        if value[j] > best[0]:
            best = (int(value[j]), int(row0[j]), i, int(word0[j]), int(at[j]))
    return best[0] % UNIT, *best[1:]


def common(template: tuple[np.ndarray, np.ndarray], words: np.ndarray) -> int:
    """Words that a template, given as distinct words and their counts, has in common with some words: no alignment matches more."""
    known, counts = template
    at = np.searchsorted(known, words)
    at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == words)]
    return int(np.minimum(np.bincount(at, minlength=len(known)), counts).sum())


def chained(parts: list[tuple[int, int, int, int, int]], gap: int) -> tuple[int, int, int]:
    """Of parts (matched words, first and last in the template, first and last word), the chain in order in both with most
    matched words, over at most `gap` words of the text at a time: its matched words and span."""
    parts = sorted(parts, key=lambda p: (p[3], p[1]))
    best: list[tuple[int, int, int]] = []
    for i, (m, t0, t1, a, b) in enumerate(parts):
        mine = (m, a, b)
        for j, (n, u0, u1, first, last) in enumerate(parts[:i]):
            # where two parts run into each other, the words that both have count once
            twice = max(0, u1 - t0 + 1, last - a + 1)
            if u0 < t0 and u1 < t1 and first < a and last < b and a <= last + gap and 2 * twice < min(m, n):
                mine = max(mine, (m + best[j][0] - twice, best[j][1], b))
        best.append(mine)
    return max(best)


def matches(index: Index, words: np.ndarray, seeds: dict[int, list[int]]) -> list[tuple[int, float, int, int, int]]:
    """(template, coverage, matched words, first word, last word) of a document, by place."""
    s, found = index.s, []
    most = {t: common(index.counts[t], words) for t in seeds}  # what a template can match at all
    for t in sorted(seeds, key=lambda t: (-most[t], t)):
        template, n, shifts = index.words[t], len(index.words[t]), sorted(seeds[t])
        need = s.coverage * n
        if most[t] < need:
            continue
        band = min(s.band, max(2, n // 3))  # copies of a short notice may stand close together
        clusters: list[list[int]] = []
        for x in shifts:
            if clusters and x - clusters[-1][0] <= band:
                clusters[-1].append(x)
            else:
                clusters.append([x])
        mine, parts = [], []
        for c in sorted(clusters, key=len, reverse=True):
            shift = c[len(c) // 2]
            low, high = max(0, shift - band), shift + n + band
            if any(a <= shift + n // 2 <= b for _, a, b in mine) or any(a <= low and high <= b + 2 * band and m >= most[t] for m, _, a, b, _ in found):
                continue  # of overlapping matches, the one that is there would stay
            wide = s.gap if n > 4 * band else 0
            if common(index.counts[t], words[max(0, low - wide) : high + wide]) < need:
                continue  # all that could match
            m, t0, t1, a, b = align(template, words[low:high], shift - low, band)
            if m >= need:
                mine.append((m, low + a, low + b))
            elif m >= 2 * band:
                parts.append((m, t0, t1, low + a, low + b))
        while len(parts) > 1:
            m, a, b = chained(parts, s.gap)
            if m < need:
                break
            mine.append((m, a, b))
            parts = [p for p in parts if p[4] < a or p[3] > b]
        found += [(m, t, a, b, m / n) for m, a, b in mine]
    kept: list[tuple] = []
    for m, t, a, b, cover in sorted(found, key=lambda f: (-f[0], -f[4], f[1], f[2])):
        if all(b < x or a > y for _, _, x, y, _ in kept):
            kept.append((m, t, a, b, cover))
    return sorted(((t, cover, m, a, b) for m, t, a, b, cover in kept), key=lambda f: f[3])


SCHEMA = "doc_id {id}, license string, coverage double, matched_words long, start long, end long"


def scan(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, license, coverage, matched_words, start, end (code points) for each match in docs(doc_id, text)."""
    s = settings or Settings()
    schema = SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        index = Index(s)
        for batch in small_batches(batches, "text"):
            offsets, flat = split_words(batch.column("text"), lower=False)
            words = hashes(flat)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            rows, texts, ids = [], batch.column("text"), batch.column("doc_id")
            for d, seeds in sorted(index.seeds(words, doc).items()):
                first, last = int(offsets[d]), int(offsets[d + 1])
                found = matches(index, words[first:last], {t: [x - first for x in at] for t, at in seeds.items()})
                if found:
                    spans = [m.span() for m in WORD.finditer(texts[d].as_py())]
                    rows += [(ids[d].as_py(), index.names[t], cover, m, spans[a][0], spans[b][1]) for t, cover, m, a, b in found]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.schema.field("doc_id").type, pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
