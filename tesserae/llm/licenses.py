"""License scans by patience alignment.

A text is held against each template. Where a text may hold one, at the places of the template's rarest words, a window is
aligned: common beginnings and ends first; then the words that are unique both to the window and to the template are
anchors, of which the longest increasing subsequence stays; the gaps between are aligned the same way, and gaps without
anchors by the longest common subsequence. A template's coverage is the share of its words that the best window aligns.

A template is left out early only if it can't reach the least coverage: too few of its words are in the text, or none of the
rarest ones, of which any alignment that covers enough must have one. Such windows take in the words around in proportion
to the template, so matches that lie scattered over a long text don't count.

Defined cases: a null or empty text has no words and no license; of templates covered alike, the longest is the best, then
the first by name; templates that lie in one another are all found; repeated rows are scanned one by one; an empty table gives
an empty result; other columns are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import ship

ship(__name__)

#: Percent of a template's words that must be aligned; words around a window, as a share of the template's and at least.
COVERAGE, SLACK, LEAST_SLACK = 85, 0.25, 3
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")

#: Public license texts and notices (fixed values). Copyright lines are left out, for they differ.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
        OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors
        may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
        OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsl-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
        and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
        execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to
        whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and
        this entire statement, including the above license grant, this restriction and the following disclaimer, must be
        included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such
        copies or derivative works are solely in the form of machine-executable object code generated by a source language
        processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO
        EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY,
        WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "cc-by-4.0-line": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
        OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
        OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
        THIS SOFTWARE.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software. THE
        SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
        OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-line": "Released under the MIT License.",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote
        the original software. If you use this software in a product, an acknowledgment in the product documentation would
        be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source
        distribution.""",
}


def read_templates(folder: str) -> dict[str, str]:
    """Templates by name from a folder of text files that the driver can read, such as a system's folder of common licenses:
    the long ones that aren't written out here."""
    return {p.name.removesuffix(".txt"): p.read_text(errors="replace") for p in sorted(Path(folder).iterdir()) if p.is_file()}


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence in which the second places rise; pairs come by the first place."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        if k == len(tails):
            tails.append(y)
            at.append(i)
        else:
            tails[k], at[k] = y, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with b's places as bits."""
    places: dict[str, int] = defaultdict(int)
    for i, w in enumerate(b):
        places[w] |= 1 << i
    row, full = (1 << len(b)) - 1, (1 << len(b)) - 1
    for w in a:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def aligned(a: list[str], b: list[str]) -> int:
    """How many words of b the patience alignment pairs with words of a."""
    total, stack = 0, [(a, b)]
    while stack:
        a, b = stack.pop()
        k, short = 0, min(len(a), len(b))
        while k < short and a[k] == b[k]:
            k += 1
        e = 0
        while e < short - k and a[-1 - e] == b[-1 - e]:
            e += 1
        total += k + e
        a, b = a[k : len(a) - e], b[k : len(b) - e]
        if not a or not b:
            continue
        in_a, in_b = Counter(a), Counter(b)
        where = {w: j for j, w in enumerate(b) if in_b[w] == 1}
        anchors = increasing([(i, where[w]) for i, w in enumerate(a) if in_a[w] == 1 and w in where])
        if not anchors:
            total += common(a, b)
            continue
        total += len(anchors)
        i, j = 0, 0
        for x, y in [*anchors, (len(a), len(b))]:
            stack.append((a[i:x], b[j:y]))
            i, j = x + 1, y + 1
    return total


class Template:
    def __init__(self, name: str, text: str, percent: int):
        self.name, self.words = name, words_of(text)
        self.places: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(self.words):
            self.places[w].append(i)
        self.needed = -(-percent * len(self.words) // 100)

    def best(self, words: list[str], places: dict[str, list[int]]) -> int:
        """The most words that a window of the text aligns, 0 if surely fewer than needed."""
        n = len(self.words)
        if sum(w in places for w in self.words) < self.needed:
            return 0
        # Any alignment that covers enough has one of these words, however it chooses.
        rare = sorted(range(n), key=lambda i: (len(places.get(self.words[i], ())), i))[: n - self.needed + 1]
        slack = max(LEAST_SLACK, int(n * SLACK))
        spans = sorted({(max(0, p - i - slack), p - i + n + slack) for i in rare for p in places.get(self.words[i], ())})
        # Windows of one length at most, so that a word found often doesn't make one of the whole text.
        most = 0
        until = -1
        for lo, hi in spans:
            if hi <= until:
                continue  # the last window holds all that an instance here could, with as many words inserted as slack
            window = words[lo : hi + slack]
            until = hi + slack
            if sum((Counter(window) & Counter(self.words)).values()) > most:
                most = max(most, aligned(window, self.words))
            if most == n:
                break
        return most if most >= self.needed else 0


def scanned(templates: dict[str, str], percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Template(k, v, percent) for k, v in sorted(templates.items())]
        vocabulary = {w for t in known for w in t.words}
        for batch in batches:
            counts, best, covered, found = [], [], [], []
            for text in batch.column("_text").to_pylist():
                words = words_of(text)
                counts.append(len(words))
                hits = []
                here = vocabulary.intersection(words)
                places: dict[str, list[int]] = {}
                for t in known:
                    if sum(w in here for w in t.words) < t.needed:
                        continue
                    if not places:
                        places = defaultdict(list)
                        for i, w in enumerate(words):
                            if w in here:
                                places[w].append(i)
                    if n := t.best(words, places):
                        hits.append((n / len(t.words), len(t.words), t.name))
                hits.sort(key=lambda h: (-h[0], -h[1], h[2]))
                best.append(hits[0][2] if hits else None)
                covered.append(hits[0][0] if hits else 0.0)
                found.append(sorted(h[2] for h in hits))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(counts, pa.int64()), pa.array(best, pa.string()), pa.array(covered, pa.float64()), pa.array(found, pa.list_(pa.string()))], ["_key", "n_words", "license", "coverage", "found"])

    return run


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", templates: dict[str, str] | None = None, percent: int = COVERAGE) -> DataFrame:
    """key, n_words, license (the best), its coverage, and all licenses found, joined by commas, of every row."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = f"_key {rows.schema['_key'].dataType.simpleString()}, n_words long, license string, coverage double, found array<string>"
    out = rows.mapInArrow(scanned(templates or TEMPLATES, percent), schema)
    return out.select(F.col("_key").alias(key), "n_words", "license", "coverage", F.array_join("found", ",").alias("licenses"))
