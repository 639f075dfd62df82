"""License scans: winnowed template fingerprints, then banded alignment.

The inverted index holds, for each template, the least key of every window of
WINDOW consecutive runs of RUN words; any shared run of RUN + WINDOW - 1 words
contains an indexed key. Of templates under SHORT words all runs of SHORT_RUN
words are indexed. Every run of a document is looked up, so a hit names a
template and a diagonal; the words around it are aligned with the template in a
band about that diagonal, again and again without the words of earlier matches.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import batch_words, fold

RUN, WINDOW, BAND = 3, 2, 8
SHORT, SHORT_RUN = 16, 2
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT-notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC-notice": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}


def winnow(words: np.ndarray) -> list[tuple[int, int]]:
    """(key, position) of the least run in every window; the rightmost of equals."""
    if len(words) < RUN:
        return []
    runs = fold(words, RUN).tolist()
    out = set()
    for i in range(max(1, len(runs) - WINDOW + 1)):
        part = runs[i : i + WINDOW]
        out.add((min(part), i + len(part) - 1 - part[::-1].index(min(part))))
    return sorted(out)


def align(template: list[int], words: list[int], shift: int, band: int = BAND) -> tuple[int, int, int] | None:
    """Best local alignment within ``band`` of diagonal ``shift`` (document minus
    template place): (matched words, first word, end word), or None.

    Match 1, else -1; among equal scores the earliest end wins.
    """
    width = 2 * band + 1
    score, begin, hits = [0] * width, [0] * width, [0] * width
    best = (0, 0, 0, 0)
    for i, word in enumerate(template):
        new_s, new_b, new_h = [0] * width, [0] * width, [0] * width
        for d in range(width):
            j = i + shift + d - band
            if not 0 <= j < len(words):
                continue
            same = words[j] == word
            s, b, h = (score[d] + 1, begin[d], hits[d] + 1) if same else (score[d] - 1, begin[d], hits[d])
            if score[d] == 0:
                s, b, h = (1, j, 1) if same else (0, 0, 0)
            if d + 1 < width and score[d + 1] - 1 > s:
                s, b, h = score[d + 1] - 1, begin[d + 1], hits[d + 1]
            if d and new_s[d - 1] - 1 > s:
                s, b, h = new_s[d - 1] - 1, new_b[d - 1], new_h[d - 1]
            if s > 0:
                new_s[d], new_b[d], new_h[d] = s, b, h
                if s > best[0]:
                    best = (s, h, b, j + 1)
        score, begin, hits = new_s, new_b, new_h
    return best[1:] if best[0] else None


class Scanner:
    def __init__(self, templates: dict[str, str], least: float) -> None:
        self.names, self.least = list(templates), least
        words = batch_words(pa.array([templates[n] for n in self.names], pa.string()))
        self.words = [w.copy() for w in words]
        index = {RUN: defaultdict(list), SHORT_RUN: defaultdict(list)}
        for t, w in enumerate(self.words):
            if len(w) < SHORT:
                for at, key in enumerate(fold(w, SHORT_RUN).tolist() if len(w) >= SHORT_RUN else []):
                    index[SHORT_RUN][key].append((t, at))
            else:
                for key, at in winnow(w):
                    index[RUN][key].append((t, at))
        self.index = {n: (dict(x), np.array(sorted(x), np.uint64)) for n, x in index.items()}
        self.lists = [w.tolist() for w in self.words]

    def scan(self, words: np.ndarray) -> list[tuple[str, int, int, int, int]]:
        """(template, matched, template words, first word, end word), best first where spans overlap."""
        seeds = defaultdict(set)
        for n, (index, keys) in self.index.items():
            if len(words) < n or not len(keys):
                continue
            runs = fold(words, n)
            at = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
            for j in np.flatnonzero(keys[at] == runs).tolist():
                for t, i in index[int(runs[j])]:
                    seeds[t].add(j - i)
        if not seeds:
            return []
        found, flat = [], words.tolist()
        for t, shifts in seeds.items():
            left = flat
            for shift in sorted(shifts):
                while (got := align(self.lists[t], left, shift)) and got[0] >= self.least * len(self.lists[t]):
                    found.append((got[0], got[0] / len(self.lists[t]), t, *got[1:]))
                    if left is flat:
                        left = flat.copy()
                    left[got[1] : got[2]] = [None] * (got[2] - got[1])
        found.sort(key=lambda x: (-x[0], -x[1], x[2], x[3]))
        out: list[tuple] = []
        for m, _, t, b, e in found:
            if all(e <= x[3] or b >= x[4] for x in out):
                out.append((self.names[t], m, len(self.lists[t]), b, e))
        return sorted(out, key=lambda x: x[3])


SCHEMA = "doc_id long, license string, matched int, template_words int, coverage double, word_begin int, word_end int, char_begin int, char_end int"


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, least_coverage: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match of a template in a document.

    ``coverage``: matched words over the template's. Where matches overlap, the
    one with most matched words is kept (ties: greater coverage, earlier
    template). Null and empty texts have none; rows repeat as in ``df``, also with
    null ids; an empty table gives an empty one; other columns are not read. Very long
    texts are scanned whole, in pieces of a megabyte, and aligned only around hits. A
    map over the scan; the index travels with the code, as templates are few.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least_coverage)
        for batch in batches:
            rows = []
            for k, words in enumerate(batch_words(batch.column(1))):
                if got := scanner.scan(words):
                    places = [m.span() for m in WORD.finditer(batch.column(1)[k].as_py())]
                    doc = batch.column(0)[k].as_py()
                    rows += [(doc, name, m, n, m / n, b, e, places[b][0], places[e - 1][1]) for name, m, n, b, e in got]
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA).withColumnRenamed("doc_id", id_col)
