"""Operator 1: licence scan by Dice coefficient over word bigrams.

Text and templates are normalised the same way: ASCII lower case, every other
ASCII sign a space, words of letters, digits and bytes beyond ASCII. The whole
text and every run of consecutive lines are units; a unit matches a template
when the Dice coefficient 2|A n B| / (|A| + |B|) of their distinct bigrams is
``CUT`` or more. Two bounds, in whole numbers, prune without losing a match:

* size: Dice >= c needs c/(2-c) |B| <= |A| <= (2-c)/c |B|;
* shared bigrams: the lines of a run hold at most the sum of their own hits.

A text is looked at line by line only if it holds an *anchor* word. Each
template's anchors touch over a third of its bigrams, and a unit without them
would share too few to reach the cut (proved in ``anchors``).

Templates of one word have no bigram and are not allowed. Among matches the
highest Dice wins, ties to the earlier template, then the earlier and shorter run.

Defined cases: null, empty and short texts have no match (null licence, dice 0);
repeated rows and ids are each scanned; very long texts are scanned whole, in
time linear in their lines (a run visits only lines that add a bigram); an empty
table gives no rows; other columns are ignored. The template list travels with
the task; ``templates_from`` reads further ones, full licence texts say, from a
table that the caller names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CUT = 0.8
SLICE_BYTES = 8 << 20
FUNCTION_WORDS = {"a", "and", "any", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "under", "with", "you", "not", "are", "was"}

# Notices of public licences, as their stewards publish them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>",
    "unlicense-notice": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
}

_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def bigrams(ws: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(ws, ws[1:]))


def anchors(grams: set[tuple[bytes, bytes]], cut: float) -> set[bytes]:
    """Words that every unit of Dice >= ``cut`` with ``grams`` must share one of.

    With t bigrams, a of which hold an anchor: a unit without anchors shares s <= t - a
    bigrams and has at least s itself, so its Dice is at most 2(t-a) / (2t-a). That is
    below the cut exactly when a > 2t(1-cut) / (2-cut).
    """
    t = len(grams)
    exact = Fraction(str(cut))
    chosen: set[bytes] = set()
    counts = Counter(w for g in grams for w in set(g))
    ranked = sorted(counts, key=lambda w: (w.decode() in FUNCTION_WORDS, -counts[w], -len(w), w))
    for w in ranked:
        chosen.add(w)
        if sum(1 for g in grams if g[0] in chosen or g[1] in chosen) > 2 * t * (1 - exact) / (2 - exact):
            break
    return chosen


class Scanner:
    def __init__(self, templates: dict[str, str], cut: float = CUT):
        self.cut = cut
        self.names = list(templates)
        self.grams = [bigrams(words(t)) for t in templates.values()]
        if any(not g for g in self.grams):
            raise ValueError("a template needs two words at least")
        self.exact = Fraction(str(cut))
        most = (2 - self.exact) / self.exact
        self.low = [math.ceil(len(g) / most) for g in self.grams]
        self.high = [math.floor(len(g) * most) for g in self.grams]
        self.owners: dict[tuple[bytes, bytes], list[int]] = {}
        for i, g in enumerate(self.grams):
            for b in g:
                self.owners.setdefault(b, []).append(i)
        self.anchors = frozenset().union(*(anchors(g, cut) for g in self.grams))

    def _dice(self, own: set, i: int) -> float:
        return 2 * len(own & self.grams[i]) / (len(own) + len(self.grams[i]))

    def scan(self, text: str | None) -> tuple[list[tuple[str, float, int, int]], int]:
        """([(licence, dice, first line, last line)] per template that matches, its best unit), units compared.

        A run that starts at line ``a`` grows only at lines that hold a bigram it has not seen. Such
        lines are kept as a linked list while the start moves from the last line to the first: line z
        leaves it once the start reaches the latest earlier line from which all its bigrams are seen.
        A run thus visits no more lines than its size bound has bigrams, however often lines repeat.
        """
        if not text or self.anchors.isdisjoint(words(text)):
            return [], 0
        lines = [words(x) for x in text.split("\n")]
        n = len(lines)
        ends: list[set[tuple[bytes, bytes]]] = []  # bigrams that end in each line (the first may begin in an earlier one)
        leaves: list[list[int]] = [[] for _ in range(n)]  # the lines that leave when the start reaches this one
        begun: dict[tuple[bytes, bytes], int] = {}  # the latest line in which a bigram that ended by now begins
        useless: list[int] = []  # lines that end no bigram
        last, last_line = None, -1
        for z, ws in enumerate(lines):
            own = {b: z for b in zip(ws, ws[1:])}
            if last is not None and ws:
                own.setdefault((last, ws[0]), last_line)
            ends.append(set(own))
            if own:
                seen_from = min(begun.get(b, -1) for b in own)
                if seen_from >= 0:
                    leaves[seen_from].append(z)
                begun.update(own)
            else:
                useless.append(z)
            if ws:
                last, last_line = ws[-1], z
        hits = [Counter(i for b in own for i in self.owners.get(b, ())) for own in ends]
        # Linked both ways; place n is the end, and as place -1 the head.
        after, before = list(range(1, n + 1)) + [0], list(range(-1, n))

        def unlink(z: int) -> None:
            before[after[z]], after[before[z]] = before[z], after[z]

        for z in useless:
            unlink(z)
        # The next line with words: where the first line is one word, its bigram ends there.
        follows, nxt = [n] * n, n
        for a in range(n - 1, -1, -1):
            follows[a] = nxt
            if lines[a]:
                nxt = a
        best: dict[int, tuple[float, int, int]] = {}
        compared = 0
        p, q = self.exact.numerator, self.exact.denominator
        for a in range(n - 1, -1, -1):
            for z in leaves[a]:
                unlink(z)
            if not lines[a]:
                continue
            first = set(zip(lines[a], lines[a][1:]))
            nearest = after[a] if ends[a] else after[n]  # only the first line with words ends no bigram
            for i in {*hits[a], *(hits[follows[a]] if follows[a] < n else ())}:
                seen, upper, z = set(first), hits[a][i], a
                while len(seen) <= self.high[i]:
                    if len(seen) >= self.low[i] and 2 * q * upper >= p * (len(seen) + len(self.grams[i])):
                        compared += 1
                        d = self._dice(seen, i)
                        if d >= self.cut and (i not in best or (d, -a) > (best[i][0], -best[i][1])):  # the earlier start wins a tie
                            best[i] = (d, a, z)
                    z = nearest if z == a else after[z]
                    if z >= n:
                        break
                    seen |= ends[z]
                    upper += hits[z][i]
        whole = bigrams([w for ws in lines for w in ws])
        for i in range(len(self.grams)):
            if self.low[i] <= len(whole) <= self.high[i]:
                compared += 1
                d = self._dice(whole, i)
                if d >= self.cut and (i not in best or d > best[i][0]):
                    best[i] = (d, 0, n - 1)
        return [(self.names[i], d, a, z) for i, (d, a, z) in sorted(best.items())], compared


def templates_from(rows: DataFrame, most: int = 10_000) -> dict[str, str]:
    """Templates from a table (name string, text string) of at most ``most`` rows with two words or more."""
    found = rows.select("name", "text").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} templates")
    return {r["name"]: r["text"] for r in sorted(found, key=lambda r: r["name"]) if bigrams(words(r["text"] or ""))}


def scan(docs: DataFrame, templates: dict[str, str] | None = None, cut: float = CUT) -> DataFrame:
    """doc_id, licence (best match or null), dice, first_line, last_line, n_licences, licences for every row."""
    common.ship(docs.sparkSession)
    chosen = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, cut)
        for batch in (part for whole in batches for part in common.slices(whole, SLICE_BYTES)):
            names, dice, first, last, count, every = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found, _ = scanner.scan(text)
                top = max(found, key=lambda m: m[1], default=(None, 0.0, None, None))
                names.append(top[0])
                dice.append(top[1])
                first.append(top[2])
                last.append(top[3])
                count.append(len(found))
                every.append([m[0] for m in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(dice, pa.float64()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(count, pa.int32()), pa.array(every, pa.list_(pa.string()))],
                ["doc_id", "licence", "dice", "first_line", "last_line", "n_licences", "licences"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        common.tidy(run), "doc_id long, licence string, dice double, first_line int, last_line int, n_licences int, licences array<string>"
    )
