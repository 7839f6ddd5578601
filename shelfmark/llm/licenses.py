"""License scan by patience alignment.

Words that occur once in the text and once in the template anchor the alignment; the longest
increasing subsequence of the anchors is kept, and the gaps between them are aligned the same way,
where more words have become unique. The coverage of a template is the share of its words that are
matched.

Every text is aligned with a template as a whole, unless it has too few of the template's words for
any alignment to reach `coverage`: that count is exact, so no template whose whole-text alignment
reaches it is missed, however far its words are apart. Words that recur elsewhere in the text are no
anchors there, so windows around the template's rarest words are aligned too, and where a window
falls short of its longest common subsequence, every span in it that begins and ends with words of
the template and could do better: a verbatim notice is one of them. The best of all these alignments
is reported; of equal ones the first window, then the whole text. Notices can differ by a word: a
template whose span lies within that of a better covered one is reported too, as superseded.

Edge cases: null and empty texts match nothing; a notice that is repeated is found by its best
alignment only; very long texts are aligned whole; repeated rows are reported each; templates
without words are refused; an empty table gives an empty result; extra columns are ignored, whatever
they are called; the id keeps its column's name and type.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontam import words_of
from .shared import as_bytes, by_value, small_batches

by_value()

#: Short notices of widely used licenses, and whole texts or standard headers of others.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met"
    ),
    "BSD-3-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: 1. Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary "
        "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
        "the documentation and/or other materials provided with the distribution. 3. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT "
        "HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
        "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN "
        "ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-or-later-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU "
        "General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": "Released under the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
        "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR "
        "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize "
        "copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain."
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
        "be held liable for any damages arising from the use of this software. Permission is granted to anyone to "
        "use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; "
        "you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
RESULT = (
    "license string, coverage double, matched int, template_words int, start_word int, end_word int, "
    "start_char int, end_char int, superseded boolean"
)


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions (in a, in b), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        spot = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, spot[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in spot]
        chain = increasing(anchors)
        out += chain
        if chain:
            ends = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
            todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by their first, with increasing seconds."""
    tails: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        before.append(last[k - 1] if k else -1)
        if k == len(tails):
            tails.append(y)
            last.append(i)
        else:
            tails[k], last[k] = y, i
    out, at = [], last[-1] if last else -1
    while at >= 0:
        out.append(pairs[at])
        at = before[at]
    return out[::-1]


def in_common(state: int, mark: int) -> int:
    """One word more of the bit-parallel longest common subsequence; its length is the number of zero bits."""
    both = state & mark
    return (state + both) | (state - both)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = {name: words_of(text.encode()) for name, text in sorted(templates.items())}
        if not all(self.templates.values()):
            raise ValueError("a template needs words")
        self.counts = {name: Counter(words) for name, words in self.templates.items()}
        self.marks: dict[str, dict[bytes, int]] = {name: defaultdict(int) for name in self.templates}
        for name, words in self.templates.items():
            for j, w in enumerate(words):
                self.marks[name][w] |= 1 << j
        self.vocabulary = frozenset(w for words in self.templates.values() for w in words)

    def scan(self, words: list[bytes]) -> list[tuple]:
        """license, coverage, matched, template words, start and end word of each covered template."""
        present = self.vocabulary.intersection(words)
        out = []
        spots: dict[bytes, list[int]] | None = None
        for name, template in self.templates.items():
            size, count = len(template), self.counts[name]
            needed = math.ceil(self.coverage * size - 1e-9)
            if sum(n for w, n in count.items() if w in present) < needed:
                continue
            if spots is None:
                spots = defaultdict(list)
                for i, w in enumerate(words):
                    if w in present:
                        spots[w].append(i)
            # No alignment can match more of a word than both sides have.
            if sum(min(n, len(spots.get(w, ()))) for w, n in count.items()) < needed:
                continue
            best = self._best(words, template, needed, spots, self.marks[name])
            if len(best) < size:
                whole = patience(words, template)
                if len(whole) >= needed and len(whole) > len(best):
                    best = whole
            if best:
                matched = len(best)
                out.append((name, matched / size, matched, size, best[0][0], best[-1][0] + 1))
        return out

    @staticmethod
    def _best(words: list[bytes], template: list[bytes], needed: int, spots: dict, marks: dict) -> list[tuple[int, int]]:
        size = len(template)
        rare = sorted(range(size), key=lambda j: (len(spots.get(template[j], ())), j))[: size - needed + 1]
        # A matched passage may hold twice the template's words: room for words put in between.
        windows = sorted({(max(0, i - 2 * j - 2), i + 2 * (size - j) + 2) for j in rare for i in spots.get(template[j], ())})
        best: list[tuple[int, int]] = []
        none = (1 << size) - 1

        def align(lo: int, hi: int) -> None:
            nonlocal best
            found = patience(words[lo:hi], template)
            if len(found) >= needed and len(found) > len(best):
                best = [(i + lo, j) for i, j in found]

        known = [(i, marks[w]) for i, w in enumerate(words) if w in marks]
        places = [i for i, _ in known]
        # Windows overlap. Of each first word: the next word to add, and the state of the words before it.
        reached: dict[int, tuple[int, int]] = {}
        for lo, hi in windows:
            if len(best) == size:
                break
            begin, end = bisect_left(places, lo), bisect_left(places, hi)
            state = none
            for _, mark in known[begin:end]:
                state = in_common(state, mark)
            most = size - (state & none).bit_count()
            if most < needed or most <= len(best):
                continue
            align(lo, hi)
            for first in range(begin, end):
                at, state = reached.get(first, (first, none))
                while at < end and len(best) < most:
                    state = in_common(state, known[at][1]) & none
                    can = size - state.bit_count()
                    if can >= needed and can > len(best):
                        align(places[first], places[at] + 1)
                    at += 1
                reached[first] = at, state
        return best


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, id_col: str = "doc_id"
) -> DataFrame:
    """One row per document and template whose coverage reaches `coverage`."""
    small_batches(docs.sparkSession)
    scanner = Scanner(templates or TEMPLATES, coverage)
    schema = docs.select(F.col(id_col)).schema
    for field in docs.sparkSession.createDataFrame([], RESULT).schema:
        schema = schema.add(field)
    kinds = [pa.string(), pa.float64()] + [pa.int32()] * 6 + [pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, source = [], []
            for at, text in enumerate(as_bytes(batch.column(1))):
                words = words_of(text)
                found = scanner.scan(words)
                if found:
                    better = [any(g[1] > f[1] and g[4] <= f[4] and g[5] >= f[5] for g in found) for f in found]
                    places = [m.span() for m in WORD.finditer(text.decode().translate(_LOWER))]
                    rows += [(*f, places[f[4]][0], places[f[5] - 1][1], b) for f, b in zip(found, better, strict=True)]
                    source += [at] * len(found)
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source, pa.int64()))]
                + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=schema.names,
            )

    return docs.select(F.col(id_col), F.col("text")).mapInArrow(run, schema)
