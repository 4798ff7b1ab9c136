"""Licence scan: normalised text compared to licence templates by Dice coefficient over word bigrams.

Units are the whole text, its paragraphs (parted by blank lines) and its lines. Licences that no
unit has are looked for in windows: all stretches of a text's words, wherever they begin and end,
of as many bigrams as a template's can have. So a notice is found alone and inside other text,
over several paragraphs, within a line and wrapped over lines, whatever the line ends. Of a template's
windows that overlap the one of the highest coefficient counts, of several templates' the one that
has more bigrams in common with its template, then the higher coefficient. Normalising lower-cases A-Z and keeps words of letters,
digits and points inside numbers apart from all else. With a and b distinct bigrams, Dice is at
most 2 min(a, b) / (a + b); only templates within that bound are compared. A unit's template is
the one of the highest coefficient, the first in order on a tie.

The pruning is vectorised: a unit whose own bigrams that occur in any template are too few for the
threshold, at its size, has no template. The others are compared as sets of words, in full. A
window begins and ends with a bigram of its template, as others only lower its coefficient, and is
looked at only where enough such bigrams lie close together. A window that begins j bigrams later
has at most (1 + j / x) times the coefficient, where x is the least number of bigrams that a window
over the threshold and its template have together; beginnings that can't come to the threshold, or
above the best window that they overlap, are passed over.
"""

from __future__ import annotations

import importlib.resources
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomwright.llm import arrow, kernel

THRESHOLD = 0.8

#: Public licence texts and notices, by SPDX identifier; several may have one identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]

#: Whole texts, a file for each identifier, after the notices.
TEMPLATES += sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in (importlib.resources.files("loomwright.llm") / "license_texts").iterdir())

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    words = _WORD.findall(text.translate(_SMALL))
    return frozenset(zip(words, words[1:], strict=False))


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Matcher:
    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.threshold = threshold
        self.names = [n for n, _ in templates]
        self.sets = [bigrams(t) for _, t in templates]
        self.sizes = np.array([len(s) for s in self.sets])
        own = [np.unique(self.hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]) for _, t in templates]
        self.known = np.unique(np.concatenate(own))
        self.has = np.array([np.isin(self.known, x) for x in own])

    @staticmethod
    def hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bigram hashes, and the unit that each lies in."""
        w = kernel.Words(raw, bounds, kernel.ALNUM)
        unit = np.repeat(np.arange(len(bounds) - 1), np.diff(w.first))
        inner = np.flatnonzero(unit[1:] == unit[:-1])
        return kernel.mix(w.hash[inner] * np.uint64(kernel.BASE) + w.hash[inner + 1]), unit[inner]

    def best(self, text: str) -> tuple[float, int] | None:
        own = bigrams(text)
        n, found = len(own), None
        # 2 min(a, b) / (a + b) >= threshold
        reach = self.threshold / (2 - self.threshold)
        for i in np.flatnonzero((self.sizes * reach <= n) & (n * reach <= self.sizes)).tolist():
            d = dice(own, self.sets[i])
            if d >= self.threshold and (found is None or d > found[0]):
                found = d, i
        return found

    def candidates(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Units with enough distinct template bigrams for their size."""
        h, unit = self.hashes(raw, bounds)
        order = np.lexsort((h, unit))
        h, unit = h[order], unit[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (unit[1:] != unit[:-1])
        h, unit = h[new], unit[new]
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        n = len(bounds) - 1
        own, shared = np.bincount(unit, minlength=n), np.bincount(unit, self.known[at] == h, n)
        # of a template of b bigrams at most min(shared, b) are common, and 2 min(shared, b) / (own + b) grows until b = shared
        return np.flatnonzero((shared > 0) & (2 * shared >= self.threshold * (own + shared)))

    def windows(self, raw: np.ndarray, bounds: np.ndarray) -> list[tuple[int, float, int]]:
        """(text, coefficient, template) of the windows that count."""
        w = kernel.Words(raw, bounds, kernel.ALNUM)
        unit = np.repeat(np.arange(len(bounds) - 1), np.diff(w.first))
        inner = np.flatnonzero(unit[1:] == unit[:-1])
        h, unit = kernel.mix(w.hash[inner] * np.uint64(kernel.BASE) + w.hash[inner + 1]), unit[inner]
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        member = np.flatnonzero(self.known[at] == h)
        code = at[member]
        found: dict[int, list[tuple[float, int, int, int]]] = {}
        reach = self.threshold / (2 - self.threshold)
        for i, size in enumerate(self.sizes.tolist()):
            least, most = max(1, int(np.ceil(size * reach - 1e-9))), int(size / reach + 1e-9)
            places = member[self.has[i][code]]
            if size == 0 or len(places) < least:
                continue
            begin, end = places[: len(places) - least + 1], places[least - 1 :]
            x, after, top, own = (1 + reach) * size, -1, (0.0, -1), []
            for p in begin[(end - begin < most) & (unit[begin] == unit[end])].tolist():
                if p < after:
                    continue
                last = int(np.searchsorted(unit, unit[p], "right"))
                stretch = slice(p, min(p + 2 * most, last))
                bound, d, n, common = self.longest(h[stretch], self.has[i][at[stretch]] & (self.known[at[stretch]] == h[stretch]), size, most)
                if d >= self.threshold:
                    own.append((-d, p, p + n, common))
                    if p >= top[1] or d > top[0]:
                        top = d, p + n
                later = lambda least_d: p + min(most, int(x * max(0.0, least_d / bound - 1)))  # noqa: B023, E731
                after = min(last, max(later(self.threshold), min(later(top[0]), top[1])))
            for d, p, q, common in self.apart(sorted(own)):
                found.setdefault(int(unit[p]), []).append((-common, p, q, d, i))
        out = []
        for text, hits in found.items():
            for _, p, q, _, i in self.apart(sorted(hits, key=lambda x: (x[0], x[3], x[4]))):
                d = dice(bigrams(w.text(int(inner[p]), int(inner[q - 1]) + 2).decode()), self.sets[i])
                if d >= self.threshold:
                    out.append((text, d, i))
        return out

    @staticmethod
    def apart(hits: list[tuple]) -> list[tuple]:
        """Of (_, first, end, ...), best first, those that overlap none before them."""
        taken: list[tuple] = []
        for hit in hits:
            if all(hit[2] <= t[1] or t[2] <= hit[1] for t in taken):
                taken.append(hit)
        return taken

    def longest(self, h: np.ndarray, own: np.ndarray, size: int, most: int) -> tuple[float, float, int, int]:
        """The highest coefficient of the stretch's beginnings, that of those of at most `most` bigrams, the bigrams in the first one that has it and those in common."""
        new = np.zeros(len(h), bool)
        new[np.unique(h, return_index=True)[1]] = True
        both = np.cumsum(new & own)
        d = 2 * both / (np.cumsum(new) + size)
        k = int(np.argmax(d[:most]))
        return float(d.max()), float(d[k]), k + 1, int(both[k])


def units(raw: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Bounds of whole texts, of paragraphs and of lines; those of texts are bounds of all."""
    ends = np.flatnonzero(raw == 10)
    blank = ends[1:][np.diff(ends) == 1]
    return [bounds, np.unique(np.concatenate([bounds, blank])), np.unique(np.concatenate([bounds, ends]))]


def scan(df: DataFrame, text_col: str, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) and licenses: array of (license, dice), by license, the best coefficient of each.

    Cases: a null or empty text has no licence; units of fewer than two words have no bigrams
    and match nothing; a licence found in several units or windows counts once, and has the
    coefficient of its units if it is found in any; an empty table stays empty;
    if df has a column licenses already, the new name gets an underscore. Whole texts are read.
    """
    at, name = df.columns.index(text_col), arrow.fresh(df, "licenses")
    matcher = Matcher(templates or TEMPLATES, threshold)
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64())]))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for i, j, raw, bounds in kernel.slices(batch.column(at)):
            found: list[dict[str, float]] = [{} for _ in range(j - i)]
            for cut in units(raw, bounds):
                for u in matcher.candidates(raw, cut).tolist():
                    hit = matcher.best(raw[cut[u] : cut[u + 1]].tobytes().decode())
                    if hit:
                        row = found[int(np.searchsorted(bounds, cut[u], "right")) - 1]
                        row[matcher.names[hit[1]]] = max(hit[0], row.get(matcher.names[hit[1]], 0.0))
            extra: list[dict[str, float]] = [{} for _ in range(j - i)]
            for r, d, t in matcher.windows(raw, bounds):
                if (name := matcher.names[t]) not in found[r]:
                    extra[r][name] = max(d, extra[r].get(name, 0.0))
            found = [f | e for f, e in zip(found, extra, strict=True)]
            out += [[{"license": k, "dice": v} for k, v in sorted(f.items())] for f in found]
        return [pa.array(out, kind)]

    item = T.StructType([T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType())])
    return arrow.add_columns(df, run, [T.StructField(name, T.ArrayType(item))], keep)
