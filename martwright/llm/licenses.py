"""Licence scans: winnowed template fingerprints, then banded sequence alignment.

Templates (short notices, opening and whole texts of common licences) are cut
into lower-case words; the hashes of their word k-grams are winnowed (of every w
neighbours the smallest stays, so every stretch of k + w - 1 words shared with a
template holds one that stayed) and go into an inverted index: hash -> places in
templates.  k and w follow from the template: a match that covers enough of it, with as
many words changed, missing or put in as may then be unmatched (two at least),
must hold one stretch of a certain length unbroken, and k + w - 1 is not longer
than that; short notices thus have all their pairs of words indexed.  The index
is bound by the template list and travels with the task.

A document's k-grams are looked up there; hits of a template whose implied
starts lie within a band of each other form a candidate.  The template is then
aligned with the words around it, in a band about that diagonal (match +2,
anything else -1, free ends), which tolerates changed, missing and inserted
words.  Coverage is the share of the template's words matched; matches covering
at least ``min_coverage`` are reported with their span in characters.

Documents are scanned where they lie: no shuffle, no group, whole texts.

Defined results: null and empty texts match nothing; a text repeating a notice
reports each place; of overlapping matches of one template the one that covers
more (then the first) stays; templates may overlap (a notice is part of a
longer one), but an inexact match inside another that holds more of its words
(a sibling's text) is left out; repeated rows report each; an empty table gives an empty
result; other columns take no part.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, whole_text

#: most words in a k-gram; most neighbours a fingerprint is chosen from; changes that any match may have
GRAM, WINDOW, CHANGES = 3, 3, 2
#: half width of the alignment band, in words (less for templates that are shorter)
BAND = 12
WORDS = re.compile(r"[0-9A-Za-z]+")

#: notices and opening texts of common licences (fixed values)
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in'
        " compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software"
        ' distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,'
        " either express or implied. See the License for the specific language governing permissions and limitations under"
        " the License.",
    "mit-notice": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation'
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
        " to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above"
        " copyright notice and this permission notice shall be included in all copies or substantial portions of the"
        " Software.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY"
        " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU"
        " General Public License for more details.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "all-rights-reserved-notice": "All rights reserved.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met: Redistributions of source code must retain the above copyright notice, this"
        " list of conditions and the following disclaimer.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL"
        " was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser"
        " General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at"
        " your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY"
        " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU"
        " Lesser General Public License for more details.",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero"
        " General Public License as published by the Free Software Foundation, either version 3 of the License, or (at"
        " your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY"
        " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU"
        " Affero General Public License for more details.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public"
        " License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "mit-whole": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        ' associated documentation files (the "Software"), to deal in the Software without restriction, including without'
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
        " The above copyright notice and this permission notice shall be included in all copies or substantial portions of"
        ' the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT'
        " NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO"
        " EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN"
        " ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR"
        " OTHER DEALINGS IN THE SOFTWARE.",
    "isc-whole": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE"
        ' SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL'
        " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,"
        " DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR"
        " PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION"
        " WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted"
        " provided that the following conditions are met: 1. Redistributions of source code must retain the above"
        " copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must"
        " reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"
        " and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND"
        ' CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED'
        " WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE"
        " COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR"
        " CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,"
        " DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,"
        " STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS"
        " SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be"
        " held liable for any damages arising from the use of this software. Permission is granted to anyone to use this"
        " software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject"
        " to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim"
        " that you wrote the original software. If you use this software in a product, an acknowledgment in the product"
        " documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as"
        " such, and must not be misrepresented as being the original software. 3. This notice may not be removed or"
        " altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "copyright": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any"
        " form or by any means without the prior written permission of the publisher.",
}


def gram_and_window(words: int, coverage: float) -> tuple[int, int]:
    """k and w for a template: the words matched at that coverage, broken by as many
    changes as words may be unmatched (``CHANGES`` at least), leave one stretch of
    k + w - 1 words or more unbroken."""
    matched = min(words, max(1, math.ceil(coverage * words - 1e-9)))
    stretch = -(-matched // (max(words - matched, CHANGES) + 1))
    k = min(GRAM, stretch)
    return k, min(WINDOW, stretch - k + 1)


class TemplateIndex:
    """Fingerprints of the templates for matches of at least ``coverage``."""

    def __init__(self, templates: Mapping[str, str], coverage: float = 0.8):
        self.names, self.words = [], []
        for name, text in templates.items():
            if w := [x.lower() for x in WORDS.findall(text)]:
                self.names.append(name)
                self.words.append(w)
        self.vocabulary = {w: i for i, w in enumerate(sorted({x for w in self.words for x in w}), 1)}
        self.ids = [np.array([self.vocabulary[x] for x in w], dtype=np.int64) for w in self.words]
        # an alignment that strays as many words as the template has scores nothing
        self.bands = [max(1, min(BAND, len(w) - 1)) for w in self.words]
        places: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, ids in enumerate(self.ids):
            k, w = gram_and_window(len(ids), coverage)
            for at, h in self._winnowed(ids, k, w):
                places.setdefault(k, defaultdict(list))[h].append((t, at))
        self.places = {k: (np.array(sorted(of), dtype=np.uint64), of) for k, of in places.items()}

    @staticmethod
    def grams(ids: np.ndarray, k: int) -> np.ndarray:
        """Mixed hash of each k-gram of word numbers."""
        with np.errstate(over="ignore"):
            h = np.zeros(max(len(ids) - k + 1, 0), dtype=np.uint64)
            for i in range(k):
                h = (h ^ ids[i:len(h) + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        return h

    def _winnowed(self, ids: np.ndarray, k: int, w: int) -> list[tuple[int, int]]:
        """Of every ``w`` neighbouring hashes the smallest (the last of equal ones)."""
        h = self.grams(ids, k).tolist()
        picked = {min(range(i, i + w), key=lambda j: (h[j], -j)) for i in range(len(h) - w + 1)}
        return [(j, h[j]) for j in sorted(picked)]

    def candidates(self, ids: np.ndarray) -> dict[int, list[int]]:
        """template -> starts (word positions) that its fingerprints in the text imply, merged within the band."""
        found = defaultdict(list)
        for k, (hashes, places) in self.places.items():
            h = self.grams(ids, k)
            spot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in np.flatnonzero(hashes[spot] == h).tolist():
                for t, at in places[int(h[i])]:
                    found[t].append(i - at)
        out = {}
        for t, starts in found.items():
            starts.sort()
            out[t] = [starts[0]]
            for s in starts[1:]:
                if s - out[t][-1] > self.bands[t]:
                    out[t].append(s)
        return out

    def align(self, t: int, ids: np.ndarray, start: int) -> tuple[int, int, int, int] | None:
        """Best local alignment of template ``t`` in the band about the diagonal
        ``start``: (words matched, score, first word, end word) of the text."""
        band = self.bands[t]
        lo, hi = max(0, start - band), min(len(ids), start + len(self.ids[t]) + band + band)
        text, tpl = ids[lo:hi].tolist(), self.ids[t].tolist()
        n, m = len(text), len(tpl)
        best = (0, 0, 0, 0)
        before: dict[int, tuple[int, int, int]] = {}          # column -> (score, matched, first word)
        for j in range(1, m + 1):
            row: dict[int, tuple[int, int, int]] = {}
            mid = start - lo + j
            for i in range(max(1, mid - band), min(n, mid + 2 * band) + 1):
                same = text[i - 1] == tpl[j - 1]
                s, k, f = before.get(i - 1, (0, 0, i - 1))
                cell = (s + 2, k + 1, f) if same else (s - 1, k, f)
                # of equal scores the one that matches more words
                if (up := before.get(i)) and (up[0] - 1, up[1]) > cell[:2]:
                    cell = (up[0] - 1, up[1], up[2])
                if (left := row.get(i - 1)) and (left[0] - 1, left[1]) > cell[:2]:
                    cell = (left[0] - 1, left[1], left[2])
                row[i] = cell if cell[:2] > (0, 0) else (0, 0, i)
                if row[i][:2] > (best[1], best[0]):
                    best = (row[i][1], row[i][0], row[i][2] + lo, i + lo)
            before = row
        return best if best[0] else None

    def scan(self, text: str, min_coverage: float) -> list[tuple[str, float, int, int, int, int]]:
        """(template, coverage, words matched, words of the span, first and end character) of each match."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in map(str.lower, WORDS.findall(text))], dtype=np.int64)
        wanted = self.candidates(ids)
        if not wanted:
            return []
        spans = [m.span() for m in WORDS.finditer(text)]
        out = []
        for t, starts in sorted(wanted.items()):
            size = len(self.ids[t])
            good = [a for s in starts if (a := self.align(t, ids, s)) and a[0] / size >= min_coverage]
            taken: list[tuple[int, int]] = []
            for k, _, a, b in sorted(set(good), key=lambda x: (-x[1], x[2], x[3])):
                if all(b <= c or a >= d for c, d in taken):
                    taken.append((a, b))
                    out.append((self.names[t], k / size, k, b - a, spans[a][0], spans[b - 1][1]))
        def better_read(x):
            """Inexact, and inside a match of another template that holds more of
            the words, or as many and is exact."""
            exact = lambda m: m[1] == 1 and m[3] == m[2]
            return not exact(x) and any(y[0] != x[0] and y[4] <= x[4] and x[5] <= y[5]
                                        and y[2] + exact(y) > x[2] for y in out)
        return sorted((x for x in out if not better_read(x)), key=lambda x: (x[4], x[5], x[0]))


def scan_licenses(df: DataFrame, templates: Mapping[str, str] | None = None, id_col: str = "doc_id",
                  text_col: str = "text", min_coverage: float = 0.8) -> DataFrame:
    """``id_col, license, coverage, matched_words, span_words, span_start,
    span_end, span_text``: one row per place where a template is matched."""
    given = dict(TEMPLATES if templates is None else templates)
    src = df.select(df[id_col].alias("_id"), whole_text(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(given, min_coverage)
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column("_text")):
                text = text.as_py()
                for r in index.scan(text, min_coverage) if index.names else []:
                    at.append(i)
                    rows.append((*r, text[r[4]:r[5]]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id").take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                names=["_id", "license", "coverage", "matched_words", "span_words", "span_start", "span_end", "span_text"])

    return map_arrow(src, run, f"_id {kind}, license string, coverage double, matched_words int, span_words int,"
                               " span_start int, span_end int, span_text string").withColumnRenamed("_id", id_col)
