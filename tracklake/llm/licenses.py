"""License scans: MinHash over overlapping windows, then exact shingle containment.

A template is the set of its 5-word shingles (3-word ones, if it has under 5 words). Templates
are put in classes by number of shingles, S = 4, 8, 16, ...; a document is looked at in
windows of 2 S shingles that start every S, so a copy of a template of the class is always
whole in one window. Each window has BANDS MinHash values, each a band of its own; a window
that shares one with a template is a candidate. A copy that keeps the share `MATCH` of a
template with s > S / 2 shingles has a resemblance of at least MATCH * s / (2 S + (1 - MATCH) * s) > 0.19
with its window, found with probability 1 - 0.81 ** 64 > 0.999998; for the shortest (one
shingle of a window of 8) it is 1 - (7 / 8) ** 64 > 0.9998. Candidates are then checked exactly. A window
shares a MinHash value with a template only if it has the shingle that it comes from, so documents without any
shingle of any template aren't hashed.

Templates are full texts and notices of well-known licenses and SPDX tags; `library_table` takes more from a
table.

Edge cases: null and empty texts match nothing; repeated rows are scanned each on its own; texts
are scanned whole. Places are in words (runs of ASCII letters and digits and all of
non-ASCII, lower-cased), end exclusive. Each document's windows start at its own first word, so that a result doesn't
depend on its neighbours. Other columns aren't read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracklake.llm import textops as X

BANDS = 64
MATCH = 0.8
SMALLEST = 4

#: Short notices of well-known licenses, as they stand in documents and headers.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "bsd": "Released under the BSD License.",
    "bsd-source": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Full texts of short licenses and notices.
FULL_TEXTS = {
    "mit-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause-endorsement": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "isc-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense-full": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
}
#: SPDX identifiers that a tag may name.
SPDX = "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 MS-PL NCSA OFL-1.1 PostgreSQL Unlicense UPL-1.0 WTFPL Zlib".split()
TEMPLATES |= FULL_TEXTS | {f"spdx:{x}": f"SPDX-License-Identifier: {x}" for x in SPDX}


def library_table(table: DataFrame, name: str = "license", text: str = "text", most: int = 20_000) -> dict[str, str]:
    """Templates from a table of at most `most` rows; more raise, as all are sent to every task."""
    rows = table.where(f"`{name}` is not null and `{text}` is not null").select(name, text).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} license templates")
    return {r[0]: r[1] for r in rows}


_SEEDS = X.mix(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a slice, and the first word of each document."""
    low = X.lower_ascii(buf)
    start, end, firsts = X.word_spans(low, offsets, X.NOT_ALNUM)
    return X.span_hash(X.prefix_hash(low), start, end), firsts


class Library:
    """Templates by (shingle width, class)."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.names = sorted(templates)
        self.groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for k, name in enumerate(self.names):
            raw = np.frombuffer(templates[name].encode(), np.uint8)
            w, _ = words(raw, np.array([0, len(raw)]))
            width = 5 if len(w) >= 5 else 3
            grams = np.unique(X.combine(w, width))
            size = SMALLEST
            while size < len(grams):
                size *= 2
            self.groups.setdefault((width, size), []).append((k, grams))
        self.values = {g: np.array([[(grams * s).min() for _, grams in rows] for s in _SEEDS]) for g, rows in self.groups.items()}
        self.known = {w: np.unique(np.concatenate([x for g, rows in self.groups.items() if g[0] == w for _, x in rows])) for w in {g[0] for g in self.groups}}
        self.maybe = {}
        for w, x in self.known.items():  # by the first 20 bits
            self.maybe[w] = np.zeros(1 << 20, dtype=bool)
            self.maybe[w][(x >> np.uint64(44)).astype(np.int64)] = True
        self.hints = {}
        for g, v in self.values.items():  # per band, which top 14 bits any template's value has
            hint = np.zeros((BANDS, 1 << 14), dtype=bool)
            for b in range(BANDS):
                hint[b, (v[b] >> np.uint64(50)).astype(np.int64)] = True
            self.hints[g] = hint

    def has(self, width: int, grams: np.ndarray) -> np.ndarray:
        """Places of the shingles of any template."""
        at = np.flatnonzero(self.maybe[width][(grams >> np.uint64(44)).astype(np.int64)])
        return at[np.isin(grams[at], self.known[width])]


def scan_slice(buf: np.ndarray, offsets: np.ndarray, library: Library, match: float = MATCH) -> list[tuple[int, int, int, int]]:
    """(document, template, first word, end word) of the copies in a slice."""
    w, firsts = words(buf, offsets)
    none = np.uint64(2**64 - 1)
    out: set[tuple[int, int, int, int]] = set()
    for width in sorted({g[0] for g in library.groups}):
        grams = X.combine(w, width)
        inside = X.windows(firsts, width)[: len(grams)]
        at = library.has(width, grams) if len(grams) else np.empty(0, np.int64)
        at = at[inside[at]]
        if not len(at):
            continue
        sizes = sorted(s for k, s in library.groups if k == width)
        # documents that have a template's shingle, each from a multiple of the largest class on
        docs = np.unique(np.searchsorted(firsts, at, side="right") - 1)
        n = firsts[docs + 1] - firsts[docs] - width + 1
        room = (n // sizes[-1] + 1) * sizes[-1]
        base = np.concatenate([[0], np.cumsum(room)])
        source = np.full(base[-1], -1, dtype=np.int64)
        spot = np.repeat(base[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        source[spot] = np.repeat(firsts[docs] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        placed = np.where(source >= 0, grams[np.maximum(source, 0)], none)
        for band in range(BANDS):
            block = np.where(source >= 0, placed * _SEEDS[band], none).reshape(-1, SMALLEST).min(axis=1)
            size = SMALLEST
            while True:
                if (width, size) in library.groups:
                    least = np.minimum(block, np.concatenate([block[1:], [none]]))
                    near = np.flatnonzero(library.hints[width, size][band][(least >> np.uint64(50)).astype(np.int64)])
                    for k in near:
                        for t in np.flatnonzero(library.values[width, size][band] == least[k]):
                            index, wanted = library.groups[width, size][t]
                            d = int(np.searchsorted(base, int(k) * size, side="right")) - 1
                            low, high = int(k) * size, min(int(k + 2) * size, int(base[d] + n[d]))
                            found = _verify(placed, low, high, wanted, width, match)
                            if found:
                                out.add((int(docs[d]), index, found[0] - int(base[d]), found[1] - int(base[d])))
                size *= 2
                if size > sizes[-1]:
                    break
                block = block.reshape(-1, 2).min(axis=1)
    return sorted(out)


def _verify(grams: np.ndarray, low: int, high: int, wanted: np.ndarray, width: int, match: float) -> tuple[int, int] | None:
    """Exact containment of a template in a window of one document: first word and end of what it has of it."""
    hit = low + np.flatnonzero(np.isin(grams[low:high], wanted))
    if len(hit) and len(np.unique(grams[hit])) >= match * len(wanted):
        return int(hit[0]), int(hit[-1]) + width
    return None


def merge_copies(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(template, first word, end word), overlapping ones of a template made one."""
    out: list[list[int]] = []
    for t, s, e in sorted(found):
        if out and out[-1][0] == t and s < out[-1][2]:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([t, s, e])
    return [tuple(x) for x in out]


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, match: float = MATCH) -> DataFrame:
    """One row per document: id, n_copies, licenses (distinct names) and copies (name, first and end word)."""
    library = Library(TEMPLATES if templates is None else templates)
    kind = dict(docs.dtypes)[id_col]
    copy = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list[tuple[int, int, int]]] = [[] for _ in range(b.num_rows)]
            for s in X.slices(b.column(1)):
                for d, t, x, y in scan_slice(s.buf, s.offsets, library, match):
                    rows[s.row + d].append((t, x, y))
            rows = [merge_copies(r) for r in rows]
            found = [[{"license": library.names[t], "start": x, "end": y} for t, x, y in r] for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array([sorted({c["license"] for c in r}) for r in found], pa.list_(pa.string())), pa.array(found, pa.list_(copy))], names=["id", "n_copies", "licenses", "copies"])

    return docs.select(id_col, text).mapInArrow(run, f"id {kind}, n_copies long, licenses array<string>, copies array<struct<license:string,start:long,end:long>>").withColumnRenamed("id", id_col)
