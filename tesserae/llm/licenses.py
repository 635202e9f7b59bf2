"""License scans: winnowed fingerprints pick candidates, banded alignment reports what is matched.

Templates and texts are lower-cased words without punctuation.  Of every
WINDOW hashes of GRAM words in a template the least is kept in an inverted
index; the same choice in a text makes any stretch of WINDOW + GRAM - 1
matching words meet.  Around each candidate's diagonal a banded alignment of
the words finds the longest common subsequence, from which coverage and spans
come.

A match must not hide a difference that makes another license: a template of
up to SHORT words matches only whole and in one piece, and a longer one only
if all of its telling words (TELLING, and words with digits, such as versions)
are matched and none was put in between.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from . import textkit as tk
from .decontamination import _SAME, _WORDY

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM, WINDOW = 3, 2
#: Share of a template's words that must be matched, in order, and the band's half width as a share of them.
COVER, BAND = 0.8, 0.25

#: Words of a template that counts as a short notice.
SHORT = 24
#: Words that tell licenses of one family apart.
TELLING = ("lesser", "library", "affero", "noncommercial", "nc", "nd", "sa", "noderivatives", "derivatives", "sharealike", "only", "zero", "not", "no")

#: Public license texts and notices by their identifiers.
TEXTS = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS '
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."
    ),
    "CC0-1.0": "Licensed under CC0 1.0.",
}

#: The parts of the two- and three-clause texts.
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_BSD_NAME = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: The notice of the GNU licenses, their names and versions; the variants and versions of Creative Commons.
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} "
    "Public License as published by the Free Software Foundation, either version {version} of the License, or (at your "
    "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
    "GNU {name} Public License for more details."
)
_GNU_KINDS = [("GPL", "General", "2"), ("GPL", "General", "3"), ("LGPL", "Lesser General", "2.1"), ("LGPL", "Lesser General", "3"), ("AGPL", "Affero General", "3")]
_CC_KINDS, _CC_VERSIONS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"), ("2.0", "2.5", "3.0", "4.0")


def templates() -> dict:
    """All templates by identifier: the texts, and the families made from their parts."""
    out = dict(TEXTS)
    out["BSD-2-Clause"], out["BSD-3-Clause"] = _BSD_START + _BSD_END, _BSD_START + _BSD_NAME + _BSD_END
    for short, name, version in _GNU_KINDS:
        spdx = f"{short}-{version if '.' in version else version + '.0'}"
        out[f"{spdx}-header"] = _GNU.format(name=name, version=version)
        out[spdx] = f"This work is licensed under the GNU {name} Public License, version {version}."
        out[f"{spdx}-notice"] = f"Licensed under the GNU {name} Public License, version {version}."
    for kind in _CC_KINDS:
        for version in _CC_VERSIONS:
            out[f"CC-{kind}-{version}"] = f"Licensed under CC {kind} {version}."
    return out


TEMPLATES = templates()


def split(data, at):
    """Word hashes with punctuation dropped, the words' byte spans, and each row's first word.

    Bytes that are neither letters nor digits separate words as space does.
    """
    plain = np.where(_WORDY[data], data, np.uint8(32))
    starts, ends, _, first = tk.words(plain, at)
    return tk.span_hashes(tk.LOWER[plain], starts, ends, _SAME), starts, ends, first


def fingerprints(words):
    """Hashes of GRAM words each and, of every WINDOW in a row, the place of the least (the last of equals)."""
    n = len(words) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for j in range(GRAM):
        grams += words[j : j + n] * np.uint64(pow(tk.STEP, j, 1 << 64))
    grams = tk.mix(grams)
    if n < WINDOW:
        return grams, np.array([int(np.argmin(grams))])
    view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    least = WINDOW - 1 - np.argmin(view[:, ::-1], axis=1)
    return grams, np.unique(np.arange(len(view)) + least)


def telling(data, words, starts, ends):
    """Which words tell licenses apart: those with a digit, and TELLING."""
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    raw = np.frombuffer(" ".join(TELLING).encode(), np.uint8)
    return (digits[ends] > digits[starts]) | np.isin(words, split(raw, np.array([0, len(raw)]))[0])


def index(templates: dict) -> dict:
    """The inverted index (hash, template, place) of all templates' fingerprints, their words, and which of them are telling."""
    names, words, marked = sorted(templates), [], []
    hashes, owner, place = [], [], []
    for k, name in enumerate(names):
        raw = np.frombuffer(templates[name].encode(), np.uint8)
        own, starts, ends, _ = split(raw, np.array([0, len(raw)]))
        words.append(own)
        marked.append(telling(raw, own, starts, ends))
        grams, kept = fingerprints(own)
        hashes.append(grams[kept])
        owner.append(np.full(len(kept), k))
        place.append(kept)
    hashes, owner, place = np.concatenate(hashes), np.concatenate(owner), np.concatenate(place)
    order = np.argsort(hashes, kind="stable")
    return {"names": names, "words": words, "telling": marked, "hash": hashes[order], "owner": owner[order], "place": place[order]}


def align(template, text, shift: int, band: int):
    """Longest common subsequence of two word lists with places at most ``band`` off the diagonal ``shift`` (text place
    minus template place): matched pairs of places, in order.  A row of the table is made at once."""
    n, m = len(template), len(text)
    width = 2 * band + 1
    best = np.zeros((n + 1, width + 1), np.int32)  # row i, column of text place i + shift - band + c
    padded = np.zeros(m + 2 * (n + width), template.dtype)
    real = np.zeros(len(padded), bool)
    edge = n + width
    padded[edge : edge + m], real[edge : edge + m] = text, True
    same = np.zeros((n, width), bool)
    for i in range(n - 1, -1, -1):
        low = min(max(edge + i + shift - band, 0), len(padded) - width)
        same[i] = (padded[low : low + width] == template[i]) & real[low : low + width]
        below = best[i + 1]
        row = np.where(same[i], 1 + below[:width], np.concatenate([[0], below[: width - 1]]))
        best[i, :width] = np.maximum.accumulate(row[::-1])[::-1]
    pairs, i, c = [], 0, 0
    while i < n and c < width:
        if not pairs and best[i, c + 1] == best[i, c]:
            c += 1  # the match begins as late as it can
        elif same[i, c]:
            pairs.append((i, i + shift - band + c))
            i += 1
        elif best[i, c + 1] >= (best[i + 1, c - 1] if c else 0):
            c += 1
        else:
            i, c = i + 1, c - 1
    return pairs


def matches(idx: dict, words, marked) -> list:
    """(template, coverage, first and end word) of every stretch of a text that holds a template; ``marked`` tells the text's telling words."""
    grams, kept = fingerprints(words)
    low = np.searchsorted(idx["hash"], grams[kept])
    high = np.searchsorted(idx["hash"], grams[kept], "right")
    seen = {}
    for p, a, b in zip(kept[high > low], low[high > low], high[high > low]):
        for k in range(a, b):
            seen.setdefault(int(idx["owner"][k]), []).append((int(p), int(p - idx["place"][k])))
    out = []
    for t, hits in seen.items():
        own = idx["words"][t]
        n = len(own)
        if n <= SHORT:
            for shift in sorted({shift for _, shift in hits}):
                if shift >= 0 and shift + n <= len(words) and (words[shift : shift + n] == own).all():
                    out.append((n, t, 1.0, shift, shift + n))
            continue
        band, done = max(2, int(BAND * n)), -1
        for p, shift in sorted(hits):
            if p < done:
                continue
            s, e = max(0, shift - band), min(len(words), shift + n + band)
            pairs = align(own, words[s:e], shift - s, band)
            if not pairs or len(pairs) < COVER * n:
                continue
            first, end = s + pairs[0][1], s + pairs[-1][1] + 1
            held = np.zeros(n, bool)
            held[[i for i, _ in pairs]] = True
            extra = marked[first:end].copy()
            extra[[s + j - first for _, j in pairs]] = False
            if (idx["telling"][t] & ~held).any() or extra.any():
                continue
            out.append((len(pairs), t, len(pairs) / n, first, end))
            done = end
    # Of templates that overlap in the text, the one with most matched words stays.
    kept = []
    for _, *found in sorted(out, key=lambda x: (-x[0], -x[2], idx["names"][x[1]], x[3])):
        if all(found[3] <= k[2] or found[2] >= k[3] for k in kept):
            kept.append(tuple(found))
    return sorted(kept, key=lambda k: k[2:])


def _scan(idx: dict):
    def run(batches):
        for batch in batches:
            rows, out = [], []
            for i, j, data, at in tk.chunks(batch.column(1)):
                words, starts, ends, first = split(data, at)
                # A text without any indexed run of words is passed over.
                n = len(words) - GRAM + 1
                if n <= 0:
                    continue
                grams = np.zeros(n, np.uint64)
                for k in range(GRAM):
                    grams += words[k : k + n] * np.uint64(pow(tk.STEP, k, 1 << 64))
                hit = np.flatnonzero(np.isin(tk.mix(grams), idx["hash"]))
                if not len(hit):
                    continue
                marked = telling(data, words, starts, ends)
                for r in np.unique(np.searchsorted(first, hit, "right") - 1):
                    f, g = first[r], first[r + 1]
                    text = data[at[r] : at[r + 1]]
                    for t, cover, s, e in matches(idx, words[f:g], marked[f:g]):
                        a, b = int(starts[f + s] - at[r]), int(ends[f + e - 1] - at[r])
                        # Offsets in code points: bytes that begin one.
                        a, b = (int(np.count_nonzero((text[:x] & 0xC0) != 0x80)) for x in (a, b))
                        rows.append(i + int(r))
                        out.append((idx["names"][t], cover, a, b))
            if rows:
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]],
                    ["doc_id", "license", "coverage", "start", "end"],
                )

    return run


def scan(docs: DataFrame, templates: dict | None = None) -> DataFrame:
    """(doc_id, license, coverage, start, end): license notices in every whole text, offsets in code points, end exclusive.

    A text may hold several; of templates that overlap in it, the one with most
    matched words is reported.  Texts of any length are read whole.
    Null and empty texts match nothing; repeated rows are each scanned; an
    empty table gives no rows; columns other than doc_id and text are left
    out.  The templates are this module's or the caller's, a few thousand
    words that every task holds.
    """
    idx = index(templates or TEMPLATES)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_scan(idx), "doc_id long, license string, coverage double, start long, end long")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
