"""License scan: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates and texts become words (ASCII letters folded, other bytes of non-ASCII characters kept), each word a hash, and
runs of k words a polynomial of their hashes. Of every w neighbouring runs the smallest hash is a fingerprint, so a match of
k + w - 1 words always shares one. Whole texts are winnowed, once with the fine setting (k, w) for templates of under LONG
words, once with the coarse one for the others. The inverted index maps a fingerprint to the templates and places that have it;
it is fixed and small, and goes out with the task.

Hits of one template with nearby diagonals are a candidate; a local alignment (match 2, difference -1, gap -1) in a band
around them gives the matched words, their share of the template, and the span in the text. Of overlapping spans of
one template the one with more matched words stays, then the earlier; different templates may share a span.

FINE keeps every pair of words: where a share of COVERAGE or more of a template's words is in place, fewer than half of
its pairs can be broken by changed or missing words, so short templates have no missed candidates. COARSE can miss matches
near the threshold whose changes are dealt evenly; the tests measure the recall against alignment at all places.

Null and empty texts have no matches. Rows that repeat or have a null id are scanned like others. Templates of under
LEAST words are refused. Further columns are kept by `scan`; its own take the place of columns with their names.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: (k, w) for templates of under LONG words and for the others; words of a template at least.
FINE, COARSE, LONG, LEAST = (2, 1), (3, 3), 24, 4
#: Words whose hashes a task's process remembers; all are forgotten when there are more.
REMEMBER = 500_000
#: Diagonals within which hits are one candidate, and by which a band exceeds them.
BAND = 8
COVERAGE = 0.7

# Notices by which public licenses are usually stated.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
    "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
    'or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS '
    "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
    "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
    "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
    "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution.",
}

# Whole public license texts (their common parts, put together below).
AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source "
    "code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
TEMPLATES |= {
    "mit-text": f"{TEMPLATES['mit']} {AS_IS}",
    "bsd-2-text": CONDITIONS + DISCLAIMER,
    "bsd-3-text": f"{CONDITIONS}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    f"without specific prior written permission. {DISCLAIMER}",
    "isc-text": f"{TEMPLATES['isc']} THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
    "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
    "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
    "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, "
    "an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented "
    "as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
    "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def fold(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Hashes(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= REMEMBER:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def winnowed(words: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints: the rightmost smallest hash of every w neighbouring runs of k words."""
    n = len(words) - k + 1
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    runs = np.zeros(n, np.uint64)
    for j in range(k):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    runs = (runs ^ runs >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    least, at = runs[: n - w + 1], np.arange(n - w + 1)
    first = at
    for j in range(1, w):
        other = runs[j : j + n - w + 1]
        at, least = np.where(other <= least, first + j, at), np.minimum(other, least)
    at = at[np.flatnonzero(np.diff(at, prepend=-1))] if w > 1 else at  # places never go back
    return at, runs[at]


class Index:
    def __init__(self, templates: dict[str, str]) -> None:
        self.words = {name: fold(text.encode()) for name, text in templates.items()}
        if short := [n for n, w in self.words.items() if len(w) < LEAST]:
            raise ValueError(f"templates of under {LEAST} words: {short}")
        self.hashes = Hashes()
        self.parts = []
        for setting in (FINE, COARSE):
            places: dict[int, list[tuple[str, int]]] = {}
            for name, words in self.words.items():
                if (len(words) < LONG) == (setting == FINE):
                    for at, h in zip(*(x.tolist() for x in winnowed(self.hashes.of(words), *setting))):
                        places.setdefault(h, []).append((name, at))
            self.parts.append((setting, np.array(sorted(places), np.uint64), places))

    def hits(self, words: list[bytes]) -> dict[str, list[tuple[int, int]]]:
        """Per template: (place in text, place in template) of shared fingerprints."""
        out: dict[str, list[tuple[int, int]]] = {}
        hashes = self.hashes.of(words)
        for setting, keys, places in self.parts:
            at, prints = winnowed(hashes, *setting)
            if not len(keys) or not len(at):
                continue
            known = keys[np.minimum(np.searchsorted(keys, prints), len(keys) - 1)] == prints
            for i, h in zip(at[known].tolist(), prints[known].tolist()):
                for name, place in places[h]:
                    out.setdefault(name, []).append((i, place))
        return out


@lru_cache(maxsize=4)
def index_of(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(templates))


def align(template: list[bytes], text: list[bytes], low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment with diagonals (place in text less place in template) from low to high: matched words, first, end."""
    width = high - low + 1
    none = (0, 0, 0)  # score, matched, first place in the text
    best, found = (0, 0), (0, 0, 0)
    above = [none] * width
    for i, word in enumerate(template):
        row, left = [], none
        for d in range(width):
            j = i + low + d
            if j < 0 or j >= len(text):
                row.append(none)
                left = none
                continue
            score, matched, first = above[d]
            if text[j] == word:
                cell = (score + 2, matched + 1, first if score else j)
            else:
                cell = (score - 1, matched, first)
            up = above[d + 1] if d + 1 < width else none
            for other in (up, left):
                if other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, other[1], other[2])
            if cell[0] <= 0:
                cell = none
            row.append(cell)
            left = cell
            if (cell[0], cell[1]) > best:
                best, found = (cell[0], cell[1]), (cell[1], cell[2], j + 1)
        above = row
    return found


def matches(index: Index, text: bytes | None, coverage: float = COVERAGE) -> list[tuple[str, int, float, int, int]]:
    """(template, matched words, share of the template, first word, end word), by first word and name."""
    words = fold(text or b"")
    out = []
    for name, hits in index.hits(words).items():
        template = index.words[name]
        spans: list[list[int]] = []
        for d in sorted(j - i for j, i in hits):
            if spans and d - spans[-1][1] <= BAND and d - spans[-1][0] <= len(template):
                spans[-1][1] = d
            else:
                spans.append([d, d])
        own = []
        for a, b in spans:
            # A span that is found splits its part of the text; copies before and behind it are looked for in the rest.
            parts = [(max(0, a - BAND), min(len(words), b + BAND + len(template)))]
            while parts:
                start, stop = parts.pop()
                if stop - start < coverage * len(template):
                    continue
                n, first, end = align(template, words[start:stop], a - BAND - start, b + BAND - start)
                if n >= coverage * len(template):
                    own.append((name, n, n / len(template), start + first, start + end))
                    parts += [(start, start + first), (start + end, stop)]
        begins: list[int] = []  # of the spans taken, which don't overlap, in order
        ends: list[int] = []
        for x in sorted(own, key=lambda x: (-x[1], x[3])):
            k = bisect.bisect_right(begins, x[3])
            if (not k or ends[k - 1] <= x[3]) and (k == len(begins) or x[4] <= begins[k]):
                begins.insert(k, x[3])
                ends.insert(k, x[4])
                out.append(x)
    return sorted(out, key=lambda x: (x[3], x[0]))


def code_points(text: bytes, ends: set[int]) -> dict[int, int]:
    """Code points before each of the places in a text, in one pass over it."""
    out, at, n = {}, 0, 0
    for end in sorted(ends):
        n += int(np.count_nonzero(np.frombuffer(text, np.int8, end - at, at) >= -64)) if end > at else 0  # all bytes but those that go on
        out[end], at = n, end
    return out


SCHEMA = "template string, n_matched int, coverage double, first_word int, end_word int, first_char int, end_char int"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """docs without text_col, one row for each match, with SCHEMA's columns."""
    given = tuple(templates.items())
    kept = [c for c in docs.columns if c != text_col and c.lower() not in COLUMNS]
    columns = [f"c{k}" for k in range(len(kept))]
    plain = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(kept, columns)], F.col(f"`{text_col}`").alias("text"))
    kinds = [pa.string(), pa.int32(), pa.float64(), *[pa.int32()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(given)
        for b in shared.cut(batches):
            rows, found = [], []
            for k, text in enumerate(shared.as_bytes(b.column(len(kept)))):
                if own := matches(index, text, coverage):
                    places = [m.span() for m in WORD.finditer(text.lower())]
                    chars = code_points(text, {n for *_, first, end in own for n in (places[first][0], places[end - 1][1])})
                    for name, n, share, first, end in own:
                        rows.append(k)
                        found.append((name, n, share, first, end, chars[places[first][0]], chars[places[end - 1][1]]))
            at = pa.array(rows, pa.int64())
            values = list(zip(*found)) or [()] * len(kinds)
            yield pa.record_batch([*(c.take(at) for c in b.columns[: len(kept)]), *(pa.array(v, t) for v, t in zip(values, kinds))], names=[*columns, *COLUMNS])

    schema = ", ".join([*(f"{c} {plain.schema[c].dataType.simpleString()}" for c in columns), SCHEMA])
    return plain.mapInArrow(run, schema).toDF(*kept, *COLUMNS)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(shared.table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("coverage", F.round("coverage", 6))
