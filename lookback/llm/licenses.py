"""License scans (operator 8): winnowed fingerprints of templates find candidates, banded alignment confirms them."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

# Notices and lines by which texts state their license.
_NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEMPLATES = {
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "cc0-1.0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause-line": "Licensed under the BSD 3-Clause License.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-line": "Released under the MIT License.",
    "mit-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
# whole texts: a notice with what stands behind it
TEMPLATES["mit"] = f"{TEMPLATES['mit-notice']} {_NO_WARRANTY}"
TEMPLATES["bsd-2-clause-text"] = f"{TEMPLATES['bsd-2-clause']} {_BSD_DISCLAIMER}"
TEMPLATES["bsd-3-clause-text"] = f"{TEMPLATES['bsd-2-clause']} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}"

#: Words of a fingerprint, consecutive fingerprints of a template of which winnowing keeps the least, width of the alignment
#: band to each side, and the part of a template that a match must cover. A place is found if it has any WORDS + WINDOW - 1
#: words of the template in a row; with a window of 1, which keeps every fingerprint, WORDS of them.
WORDS, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.7

TOKEN = re.compile(r"[a-z0-9]+")


def winnow(hashes: list[int], window: int = WINDOW) -> list[int]:
    """Places of the least of every `window` consecutive hashes, the last of equal ones; of fewer, of them all."""
    if not hashes:
        return []
    n = max(1, len(hashes) - window + 1)
    return sorted({min(range(i, min(i + window, len(hashes))), key=lambda k: (hashes[k], -k)) for i in range(n)})


class Index:
    """Templates' words as numbers from 1, and their winnowed fingerprints with template and place."""

    def __init__(self, templates: dict[str, str], window: int = WINDOW) -> None:
        self.names = sorted(templates)
        words = [TOKEN.findall(templates[n].lower()) for n in self.names]
        self.number = {w: k + 1 for k, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.templates = [[self.number[w] for w in ws] for ws in words]
        self.base = len(self.number) + 1
        if self.base**WORDS >= 1 << 62:
            raise ValueError("too many different words in the templates")
        postings = defaultdict(list)
        self.prints = []
        for t, ids in enumerate(self.templates):
            grams = [self.code(ids[i : i + WORDS]) for i in range(len(ids) - WORDS + 1)]
            kept = winnow([xxhash.xxh64_intdigest(str(g)) for g in grams], window)
            self.prints.append(len(kept))
            for i in kept:
                postings[grams[i]].append((t, i))
        self.codes = np.array(sorted(postings), np.int64)
        self.postings = [postings[c] for c in self.codes.tolist()]

    def code(self, ids) -> int:
        out = 0
        for x in ids:
            out = out * self.base + int(x)
        return out


def common(template: list[int], words: list[int], band: int = BAND) -> int:
    """Most words of a template that stand in words in order, by an alignment of both from end to end that is at most `band`
    places off the diagonals of their ends."""
    n = len(words)
    low, high = min(0, n - len(template)) - band, max(0, n - len(template)) + band
    row = [0] * (n + 1)
    for i, want in enumerate(template):
        first, last = max(1, i + 1 + low), min(n, i + 1 + high)
        if first > last:
            continue
        new, corner = row[:], row[first - 1]
        for j in range(first, last + 1):
            up = row[j]
            new[j] = corner + 1 if words[j - 1] == want else max(up, new[j - 1])
            corner = up
        # what is beyond the band has no better alignment than its edge
        row = new[: last + 1] + [max(new[last], x) for x in new[last + 1 :]]
    return row[-1]


def extend(template: list[int], words: list[int], band: int = BAND) -> tuple[int, int]:
    """Best alignment of a start of the template with a start of words: matched words, words taken. A match is 1, a difference or gap -1."""
    best, row = (0, 0, 0), {-1: (0, 0)}  # score, matched, taken; by the last word taken
    for j in range(min(len(words), band)):
        row[j] = (-1 - j, 0)
    for i, want in enumerate(template):
        new = {-1: (-1 - i, 0)} if i < band else {}
        for j in range(max(0, i - band), min(len(words), i + band + 1)):
            hit = words[j] == want
            options = [(row[j - 1][0] + (1 if hit else -1), row[j - 1][1] + hit)] if j - 1 in row else []
            options += [(r[0] - 1, r[1]) for r in (row.get(j), new.get(j - 1)) if r]
            if options:
                new[j] = max(options)
                if hit and new[j] > best[:2]:
                    best = (*new[j], j + 1)
        row = new
    return best[1:]


def chains(hits: list[tuple[int, int]], reach: int) -> list[list[tuple[int, int, int]]]:
    """Hits (word, template place) as chains of runs (word, template place, words): runs follow each other in both, at most
    reach words apart; the chains of most words first, then those with least between their runs. A run is in one chain."""
    open_, runs = {}, []
    for p, i in sorted(hits):
        k = open_.get(p - i)
        if k is not None and p <= runs[k][0] + runs[k][2]:
            runs[k][2] = p + WORDS - runs[k][0]
        else:
            open_[p - i] = len(runs)
            runs.append([p, i, WORDS])
    score, before, first = [], [], 0
    longest = max((r[2] for r in runs), default=0)
    for k, (p, i, n) in enumerate(runs):
        best, prior = (n, 0), -1
        while runs[first][0] + longest + reach < p:
            first += 1
        for j in range(first, k):
            q, h, m = runs[j]
            over = max(0, q + m - p, h + m - i)  # words that both runs have
            if q < p and h < i and over < n and p - q - m <= reach:
                option = (score[j][0] + n - over, score[j][1] - abs(p - q - (i - h)))
                if option > best:
                    best, prior = option, j
        score.append(best)
        before.append(prior)
    used, out = set(), []
    for k in sorted(range(len(runs)), key=lambda k: (-score[k][0], -score[k][1], k)):
        chain = []
        while k >= 0 and k not in used:
            used.add(k)
            chain.append(tuple(runs[k]))
            k = before[k]
        if chain:
            out.append(chain[::-1])
    return out


def along(template: list[int], ids: list[int], chain: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Matched words, first word and end of a chain with what is common between its runs and before and behind it."""
    p, i, _ = chain[0]
    room = len(template) + BAND
    matched, taken = extend(template[:i][::-1], ids[max(0, p - room) : p][::-1])
    first, at, place = p - taken, p, i
    for p, i, n in chain:
        over = max(0, at - p, place - i)
        p, i, n = p + over, i + over, n - over
        matched += common(template[place:i], ids[at:p]) + n
        at, place = p + n, i + n
    more, taken = extend(template[place:], ids[at : at + room])
    return matched + more, first, at + taken


def matches(index: Index, ids: np.ndarray, coverage: float) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, end) of every match in a document's word numbers, by place."""
    n = len(ids) - WORDS + 1
    if n < 1:
        return []
    code, known = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(WORDS):
        part = ids[k : k + n]
        code = code * index.base + part
        known &= part > 0
    at = np.flatnonzero(known)
    k = np.minimum(np.searchsorted(index.codes, code[at]), len(index.codes) - 1)
    at, k = at[index.codes[k] == code[at]], k[index.codes[k] == code[at]]
    hits = defaultdict(list)
    for place, p in zip(at.tolist(), k.tolist()):
        for t, i in index.postings[p]:
            hits[t].append((place, i))
    found = []
    words = ids.tolist() if hits else []
    for t, places in hits.items():
        template = index.templates[t]
        size, needed = len(template), Counter(template)
        for chain in chains(places, size):
            # no more words can match than the template and the chain's surroundings have in common in any order
            here = Counter(words[max(0, chain[0][0] - size - BAND) : sum(chain[-1][::2]) + size + BAND])
            if (here & needed).total() >= coverage * size:
                matched, first, end = along(template, words, chain)
                if matched >= coverage * size:
                    found.append((t, matched, first, end))
    # of overlapping matches the one with most words stays, then the one with most of its template
    found.sort(key=lambda m: (-m[1], -m[1] / len(index.templates[m[0]]), m[2], m[0]))
    kept: list[tuple[int, int, int, int]] = []
    for m in found:
        if all(m[3] <= k[2] or m[2] >= k[3] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m[2])


def read_templates(spark: SparkSession, path: str) -> dict[str, str]:
    """Templates from a folder of texts, named by their files; every worker holds all of them."""
    rows = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1).alias("name"))
    return {r["name"]: r["value"] for r in rows.collect()}


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, window: int = WINDOW) -> DataFrame:
    """A row for each place where a document has at least `coverage` of a template's words in order.

    A place is a chain of word runs in common with the template, with at most as many words between two as the template has;
    parts further apart are separate places. Fingerprints of three words are winnowed by `window`: a place is found if it has
    2 + window of the template's words in a row anywhere, so with a window of 1 every place that has three. Between and
    around runs, words are aligned within a band of BAND places around the diagonals.
    doc_id, license, matched_words, coverage (of the template), span_start and span_end (characters of the text). Words
    are runs of [a-z0-9] of the lower-cased text. Of overlapping matches only that of most words is reported: a notice, not
    the line it starts with. Texts that are null, empty or without a match give no row. Rows that repeat a
    doc_id are scanned each. Very long texts are scanned whole, one at a time. Without templates or documents the result is
    empty. Other columns are not read.
    """
    index = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates, window))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    names = ["doc_id", "license", "matched_words", "coverage", "span_start", "span_end"]

    def run(batches):
        ix = index.value
        get = ix.number.get
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # one character for each, so that places are those of the text
                low = (text or "").lower()
                low = low if len(low) == len(text or "") else "".join(c.lower()[:1] for c in text)
                words = TOKEN.findall(low)
                ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
                found = matches(ix, ids, coverage) if len(ix.codes) else []
                if found:
                    spans = [m.span() for m in TOKEN.finditer(low)]
                    for t, matched, first, end in found:
                        for column, value in zip(columns, (doc_id, ix.names[t], matched, matched / len(ix.templates[t]), spans[first][0], spans[min(end, len(spans)) - 1][1])):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, matched_words long, coverage double, span_start long, span_end long")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(shared.table(spark, sf_dir, "documents"))
