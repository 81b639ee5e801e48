"""Licence scans by patience alignment against notice templates."""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Share of a template's words that must match, and how many template lengths a region may span.
COVERAGE, SPREAD = 0.8, 1.5
#: Public licence texts (of the long licences, the notice that source files carry) and short notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause-third-condition": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
_BREAKS = bytes(i if chr(i).isalnum() and i < 128 or i >= 128 else 0x20 for i in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8").translate(_BREAKS).split()


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Matched places: anchors are words unique to both sides, their longest increasing run is kept,
    and the gaps between are aligned the same way; gaps without anchors match at their ends."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: i for i, w in enumerate(b[b0:b1], b0) if nb[w] == 1}
        pairs = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if na[w] == 1 and w in where]
        tails: list[int] = []  # patience: least last place of an increasing run of each length
        ends: list[int] = []
        back: list[int] = []
        for n, (_, j) in enumerate(pairs):
            k = bisect.bisect_left(tails, j)
            tails[k : k + 1] = [j]
            ends[k : k + 1] = [n]
            back.append(ends[k - 1] if k else -1)
        chain, n = [], ends[-1] if ends else -1
        while n >= 0:
            chain.append(pairs[n])
            n = back[n]
        if not chain:
            continue
        chain = chain[::-1]
        out += chain
        last_a, last_b = a0, b0
        for i, j in [*chain, (a1, b1)]:
            todo.append((last_a, i, last_b, j))
            last_a, last_b = i + 1, j + 1
    return sorted(out)


def common(masks: list[int], size: int) -> int:
    """Length of the longest common subsequence of a template of ``size`` words and a text, bit by bit; a mask tells a text word's places in the template.

    No alignment matches more words, so it tells cheaply where none can match enough."""
    whole = (1 << size) - 1
    free = whole
    for mask in masks:
        new = free & mask
        free = (free + new | free - new) & whole
    return size - free.bit_count()


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float, spread: float = SPREAD) -> None:
        self.spread = spread
        self.templates = [(k, words_of(v)) for k, v in templates.items()]
        self.templates = [(k, w, frozenset(w), max(1, int(np.ceil(coverage * len(w) - 1e-9)))) for k, w in self.templates if w]
        self.vocabulary = frozenset(x for _, w, _, _ in self.templates for x in w)
        self.bits = {k: {x: sum(1 << i for i, y in enumerate(w) if y == x) for x in own} for k, w, own, _ in self.templates}

    def find(self, words: list[bytes]) -> list[tuple[str, int, int, int]]:
        """(licence, first word, end word, matched words) of all regions that match well enough.

        A region's window is ``spread`` templates long; a window that holds fewer template words than the
        least coverage needs can't reach it, nor can one whose longest common subsequence with the template is shorter,
        so these tests lose nothing within windows of that length."""
        places = [i for i, w in enumerate(words) if w in self.vocabulary]
        out = []
        for name, template, own, need in self.templates:
            at = np.array([i for i in places if words[i] in own], dtype=np.int64)
            if len(at) < need:
                continue
            wide = int(len(template) * self.spread) + 2
            good = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < wide)
            if not len(good):
                continue
            bits = self.bits[name]
            masks = [bits[words[i]] for i in at.tolist()]
            # starts of dense windows, in groups of at most one window's length; a group that can't match enough is left as a whole, others are halved
            todo = np.split(good, np.flatnonzero(np.diff(at[good] // wide)) + 1)[::-1]
            taken = -1
            while todo:
                group = todo.pop()
                group = group[np.searchsorted(at[group], taken) :]
                if not len(group) or common(masks[group[0] : np.searchsorted(at, at[group[-1]] + wide)], len(template)) < need:
                    continue
                if len(group) > 1:
                    todo += [group[len(group) // 2 :], group[: len(group) // 2]]
                    continue
                low = int(at[group[0]])
                matched = align(words[low : low + wide], template)
                if len(matched) >= need:
                    taken = low + matched[-1][0] + 1
                    out.append((name, low + matched[0][0], taken, len(matched)))
        regions = {k: sorted(x for x in out if x[0] == k) for k in {x[0] for x in out}}  # those of one licence don't overlap
        size = {k: len(w) for k, w, _, _ in self.templates}

        def beaten(x: tuple[str, int, int, int]) -> bool:
            """Whether another licence matches most of the same words better."""
            name, start, end, matched = x
            for other, mine in regions.items():
                k = bisect.bisect_right(mine, start, key=lambda r: r[2]) if other != name else len(mine)
                while k < len(mine) and mine[k][1] < end:
                    _, s, e, m = mine[k]
                    if min(e, end) - max(s, start) >= COVERAGE * (end - start) and m * size[name] > matched * size[other]:
                        return True
                    k += 1
            return False

        return sorted((x for x in out if not beaten(x)), key=lambda x: (x[1], x[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, *, coverage: float = COVERAGE, spread: float = SPREAD) -> DataFrame:
    """``docs`` with licenses: an array of (license, start, end, matched, coverage), in words, by start.

    Coverage is the share of a template's words that the alignment matches, within a region of at most ``spread``
    template lengths: a licence interleaved with more text than that is not found. Null and empty texts hold no
    licence; every occurrence is listed, but of licences that match mostly the same words only the best; ties keep the order of names; an empty set of templates finds nothing. Repeated rows
    repeat, texts of any length are read whole, a column named licenses is replaced, a table without rows gives none.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, coverage, spread)
    sizes = {k: len(w) for k, w, _, _ in scanner.templates}
    out = docs.drop("licenses")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema])
    schema = schema.add("licenses", T.ArrayType(T.StructType.fromDDL("license string, start int, end int, matched int, coverage double")))
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("matched", pa.int32()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"license": k, "start": s, "end": e, "matched": m, "coverage": m / sizes[k]} for k, s, e, m in scanner.find(words_of(x.as_py()))] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "licenses"])

    return out.mapInArrow(run, schema)


def digest(frame: DataFrame) -> DataFrame:
    """doc_id, number of notices, their names in order, and the best coverage."""
    return frame.select(F.col("doc_id").cast("long").alias("doc_id"), F.size("licenses").cast("long").alias("n_notices"), F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("notices"), F.round(F.coalesce(F.array_max(F.transform("licenses", lambda x: x["coverage"])), F.lit(0.0)), 6).alias("coverage"))
