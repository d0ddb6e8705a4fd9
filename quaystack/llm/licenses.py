"""License notices found by MinHash bands over overlapping windows.

Templates and texts are cut into words (lower-cased letters and digits) and
five-word shingles. A text is scanned by windows whose sizes double: a
template with T shingles is looked for in windows of 2 s shingles taken
every s, where s is the smallest power of two that is 1.5 T or more. An
occurrence may thus be half as long again as its template by inserted words
and still lies whole in some window, of which T is over a sixth. With a
share c of its shingles present, the Jaccard similarity of window and
template is at least c T / (2 s + (1 - c) T), over c / 6.2 for c = 0.8. Bands
of one row each are equal with that probability, so one of ``BANDS`` = 64
is with 1 - (1 - 0.129)^64 > 0.9998. Whatever a band retrieves is verified
by exact shingle containment of ``threshold`` or more, which alone decides.

A window can hold several occurrences: its hits are cut where the template
starts over, and what reaches the threshold by itself is one; in the rest,
hits count in any order. Of overlapping matches the one with the most
shingles of its template wins, so a longer notice wins over a short one that
it holds, also where the longer one was edited.

The template index is a fixed table of notices and travels to the tasks;
texts are scanned where they are read, without a shuffle, however many
documents share a notice.

Edge cases: a null or empty text, or one of fewer than five words, has no
match. A template of fewer than five words is one shingle of all its words.
Null ids, repeated rows and extra columns are of no concern: every row is
scanned by itself. Very long texts are scanned in slices that overlap by a
window.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from quaystack.llm.common import ready, texts

SHINGLE, THRESHOLD, BANDS = 5, 0.8, 64
_WORD = re.compile(r"[^\W_]+")

#: Notices and short licence bodies as they stand in files, by
#: SPDX identifier; several wordings of a licence have entries of their own.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not"
                         " use this file except in compliance with the License. You may obtain a copy"
                         " of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
                " software and associated documentation files (the \"Software\"), to deal in the"
                " Software without restriction, including without limitation the rights to use, copy,"
                " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the"
                  " terms of the GNU General Public License as published by the Free Software"
                  " Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are"
           " permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
           " without fee is hereby granted, provided that the above copyright notice and this"
           " permission notice appear in all copies.",
    "MIT-body": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this '
        'software and associated documentation files (the "Software"), to deal in the Software '
        'without restriction, including without limitation the rights to use, copy, modify, '
        'merge, publish, distribute, sublicense, and/or sell copies of the Software, and to '
        'permit persons to whom the Software is furnished to do so, subject to the following '
        'conditions: The above copyright notice and this permission notice shall be included in '
        'all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", '
        'WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        'WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN '
        'NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR '
        'OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT '
        'OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    "BSD-2-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are '
        'permitted provided that the following conditions are met: 1. Redistributions of source '
        'code must retain the above copyright notice, this list of conditions and the following '
        'disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, '
        'this list of conditions and the following disclaimer in the documentation and/or other '
        'materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT '
        'HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT '
        'NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR '
        'PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE '
        'FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES '
        '(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF '
        'USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF '
        'LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR '
        'OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE '
        'POSSIBILITY OF SUCH DAMAGE.'),
    "BSD-3-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are '
        'permitted provided that the following conditions are met: 1. Redistributions of source '
        'code must retain the above copyright notice, this list of conditions and the following '
        'disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, '
        'this list of conditions and the following disclaimer in the documentation and/or other '
        'materials provided with the distribution. 3. Neither the name of the copyright holder '
        'nor the names of its contributors may be used to endorse or promote products derived '
        'from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED '
        'BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
        'INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR '
        'A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR '
        'CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR '
        'CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR '
        'SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON '
        'ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING '
        'NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF '
        'ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    "ISC-body": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or '
        'without fee is hereby granted, provided that the above copyright notice and this '
        'permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR '
        'DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
        'OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, '
        'DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS '
        'OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS '
        'ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event "
        'will the authors be held liable for any damages arising from the use of this software. '
        'Permission is granted to anyone to use this software for any purpose, including '
        'commercial applications, and to alter it and redistribute it freely, subject to the '
        'following restrictions: 1. The origin of this software must not be misrepresented; you '
        'must not claim that you wrote the original software. If you use this software in a '
        'product, an acknowledgment in the product documentation would be appreciated but is not '
        'required. 2. Altered source versions must be plainly marked as such, and must not be '
        'misrepresented as being the original software. 3. This notice may not be removed or '
        'altered from any source distribution.'),
    "Unlicense": (
        'This is free and unencumbered software released into the public domain. Anyone is free '
        'to copy, modify, publish, use, compile, sell, or distribute this software, either in '
        'source code form or as a compiled binary, for any purpose, commercial or non-commercial, '
        'and by any means.'),
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this '
        'file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed '
        'to in writing, software distributed under the License is distributed on an "AS IS" '
        'BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the '
        'License for the specific language governing permissions and limitations under the '
        'License.'),
    "GPL-2.0-header": (
        'This program is free software; you can redistribute it and/or modify it under the terms '
        'of the GNU General Public License as published by the Free Software Foundation; either '
        'version 2 of the License, or (at your option) any later version.'),
    "LGPL-2.1-header": (
        'This library is free software; you can redistribute it and/or modify it under the terms '
        'of the GNU Lesser General Public License as published by the Free Software Foundation; '
        'either version 2.1 of the License, or (at your option) any later version.'),
    "AGPL-3.0-header": (
        'This program is free software: you can redistribute it and/or modify it under the terms '
        'of the GNU Affero General Public License as published by the Free Software Foundation, '
        'either version 3 of the License, or (at your option) any later version.'),
    "MPL-2.0-header": (
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If '
        'a copy of the MPL was not distributed with this file, You can obtain one at '
        'https://mozilla.org/MPL/2.0/.'),
    "EPL-2.0": (
        'This program and the accompanying materials are made available under the terms of the '
        'Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/'),
    "BSL-1.0": (
        'Distributed under the Boost Software License, Version 1.0. (See accompanying file '
        'LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)'),
    "CC0-1.0": (
        'To the extent possible under law, the author(s) have dedicated all copyright and related '
        'and neighboring rights to this software to the public domain worldwide. This software is '
        'distributed without any warranty.'),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}


class Match(NamedTuple):
    license: str
    start: int          # code points
    end: int            # exclusive
    containment: float


def _hashes(words: list[str]) -> np.ndarray:
    """One 64-bit hash a shingle; all words together if they are few."""
    if len(words) <= SHINGLE:
        grams = [" ".join(words)] if words else []
    else:
        grams = map(" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    return np.fromiter((xxhash.xxh64_intdigest(g) for g in grams), np.uint64)


def _mixed(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """(bands, shingles): the hashes under a bijection a band."""
    return hashes[None, :] * factors[:, None]


def _best_run(at: list[int], values: list[int], x: int, y: int,
              reach: int) -> tuple[int, int, int]:
    """Of the hits x to y - 1, the run over less than ``reach`` shingles with
    the most distinct values, the shortest of these: (values, first, last)."""
    inside: dict[int, int] = {}
    best, first = (0, 0, 0), x
    for last in range(x, y):
        inside[values[last]] = inside.get(values[last], 0) + 1
        while at[last] - at[first] >= reach or inside[values[first]] > 1:
            inside[values[first]] -= 1
            if not inside[values[first]]:
                del inside[values[first]]
            first += 1
        if (-len(inside), at[last] - at[first]) < (-best[0], at[best[2]] - at[best[1]]):
            best = (len(inside), first, last)
    return best


class Scanner:
    """The band index of a set of templates."""

    def __init__(self, notices: dict[str, str], threshold: float = THRESHOLD, bands: int = BANDS):
        self.threshold = threshold
        # Odd factors: multiplying by one permutes the 64-bit hashes.
        self.factors = np.random.default_rng(5).integers(1, 2**63, bands).astype(np.uint64) * 2 + 1
        self.names = list(notices)
        self.sets, self.words = [], []
        #: Where in its template each shingle stands, ascending.
        self.order: list[dict[int, list[int]]] = []
        by_size: dict[int, list[int]] = {}
        for i, text in enumerate(notices.values()):
            words = _WORD.findall(text.lower())
            hashes = np.unique(_hashes(words))
            self.sets.append(hashes)
            self.words.append(len(words))
            if len(hashes):
                by_size.setdefault(1 << (len(hashes) * 3 // 2 - 1).bit_length(), []).append(i)
            self.order.append({})
            for n, value in enumerate(_hashes(words).tolist()):
                self.order[-1].setdefault(value, []).append(n)
        # Templates of fewer words than a shingle are looked up by their words.
        self.short = {int(self.sets[i][0]): i for ids in by_size.values() for i in ids
                      if self.words[i] < SHINGLE}
        # By window size: (band, minimum) -> templates, and which low bits of a
        # minimum can be one.
        self.index: dict[int, tuple[dict[tuple[int, int], list[int]], np.ndarray]] = {}
        for size, ids in sorted(by_size.items()):
            bands_of: dict[tuple[int, int], list[int]] = {}
            for i in ids:
                if self.words[i] >= SHINGLE:
                    for band, value in enumerate(_mixed(self.sets[i], self.factors).min(axis=1).tolist()):
                        bands_of.setdefault((band, value), []).append(i)
            if bands_of:
                known = np.zeros(self.LOW + 1, dtype=bool)
                known[[value & self.LOW for _, value in bands_of]] = True
                self.index[size] = (bands_of, known)

    SLICE = 16_384  # shingles hashed at a time; a multiple of every window size
    LOW = 2**20 - 1

    def scan(self, text: str) -> list[Match]:
        low = text.lower()
        words = _WORD.findall(low) if len(low) == len(text) else [
            w.lower() for w in _WORD.findall(text)]
        found: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        self._scan_short(words, found)
        if len(words) >= SHINGLE:
            hashes = _hashes(words)
            reach = 2 * max(self.index, default=1)
            for at in range(0, len(hashes), self.SLICE):
                self._slice(hashes, at, min(len(hashes), at + self.SLICE + reach), found)
        if not any(found.values()):
            return []
        return self._matches(found, [m.span() for m in _WORD.finditer(text)])

    def _slice(self, hashes: np.ndarray, at: int, end: int, found: dict) -> None:
        """Windows of every size over one slice: minima of blocks of s
        shingles come from those of s / 2, a window is two neighbours."""
        least, size = _mixed(hashes[at:end], self.factors), 1
        while True:
            if size in self.index:
                bands_of, known = self.index[size]
                window = np.minimum(least, np.concatenate([least[:, 1:], least[:, -1:]], axis=1))
                for band, w in np.argwhere(known[window & np.uint64(self.LOW)]).tolist():
                    for i in bands_of.get((band, int(window[band, w])), ()):
                        start = at + w * size
                        if (i, start) not in found:
                            found[i, start] = self._verify(i, hashes, start, start + 2 * size)
            if size >= max(self.index, default=1):
                return
            if least.shape[1] % 2:
                least = np.concatenate([least, least[:, -1:]], axis=1)
            least, size = np.minimum(least[:, ::2], least[:, 1::2]), 2 * size

    def _verify(self, i: int, hashes: np.ndarray, a: int, b: int) -> list[tuple[int, int, float]]:
        """Runs of the template's shingles in a window that reach the
        threshold by themselves."""
        here = hashes[a:b]
        hits = np.flatnonzero(np.isin(here, self.sets[i]))
        need = self.threshold * len(self.sets[i])
        if not len(hits) or len(np.unique(here[hits])) < need:
            return []
        at, values = hits.tolist(), here[hits].tolist()
        reach = (b - a) // 2
        # Pieces in template order first, then what is left between those found.
        order = self.order[i]
        cuts, last = [0], -1
        for n, v in enumerate(values):
            places = order[v]
            k = bisect_right(places, last)
            if k == len(places):  # the template starts over
                cuts.append(n)
                k = 0
            last = places[k]
        cuts.append(len(at))
        found = []
        for x, y in zip(cuts, cuts[1:]):
            if y - x >= need:
                run = (len(set(values[x:y])), x, y - 1) if at[y - 1] - at[x] < reach else \
                    _best_run(at, values, x, y, reach)
                found += [run] * (run[0] >= need)
        todo, edge = [], 0
        for n, x, y in sorted(found, key=lambda r: r[1]):
            todo.append((edge, x))
            edge = y + 1
        todo.append((edge, len(at)))
        while todo:
            x, y = todo.pop()
            if y - x < need:
                continue
            run = _best_run(at, values, x, y, reach)
            if run[0] >= need:
                found.append(run)
                todo += [(x, run[1]), (run[2] + 1, y)]
        return [(a + at[x], a + at[y] + SHINGLE, n / len(self.sets[i])) for n, x, y in found]

    def _scan_short(self, lower: list[str], found: dict) -> None:
        for length in {self.words[i] for i in self.short.values()}:
            for at in range(len(lower) - length + 1):
                i = self.short.get(xxhash.xxh64_intdigest(" ".join(lower[at:at + length])))
                if i is not None and self.words[i] == length:
                    found[i, at] = [(at, at + length, 1.0)]

    def _matches(self, found: dict, words: list[tuple[int, int]]) -> list[Match]:
        """Verified finds; of overlapping ones that with the most shingles."""
        best = sorted({(i, *run) for (i, _), runs in found.items() for run in runs},
                      key=lambda m: (-m[3] * len(self.sets[m[0]]), -m[3], m[2] - m[1], m[1], m[0]))
        out: list[tuple[int, int, int, float]] = []
        ends: list[tuple[int, int]] = []  # taken, by start
        for m in best:
            place = bisect_left(ends, (m[1], m[2]))
            if (place and ends[place - 1][1] > m[1]) or (place < len(ends) and ends[place][0] < m[2]):
                continue
            ends.insert(place, (m[1], m[2]))
            out.append(m)
        return [Match(self.names[i], words[a][0], words[b - 1][1], share)
                for i, a, b, share in sorted(out, key=lambda m: (m[1], m[2], m[0]))]


_FIELDS = "license string, start int, end int, containment double"


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  notices: dict[str, str] | None = None,
                  threshold: float = THRESHOLD) -> DataFrame:
    """One row per match: id, license, start, end (code points), containment."""
    ready(df.sparkSession)
    rows, table = texts(df, id_col, text_col), dict(notices or NOTICES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(table, threshold)
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for match in scanner.scan(text):
                    at.append(i)
                    found.append(match)
            cols = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at, pa.int32())), pa.array(cols[0], pa.string()),
                 pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()),
                 pa.array(cols[3], pa.float64())],
                ["id", "license", "start", "end", "containment"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, {_FIELDS}").withColumnRenamed("id", id_col)
