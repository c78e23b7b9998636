"""License scans by patience alignment with the texts of known notices.

Texts are cut to lower-case words of letters and digits. Distinct notice words
are few, so a first look counts, for every text and notice, the notice's words
that occur anywhere in the text; only pairs that could still reach the least
coverage are aligned, which loses nothing. Every stretch of a notice's words is
covered to its end by overlapping windows of three and four times the notice's
length, a length apart, so that whatever spans up to three lengths lies whole
in one; and wherever as many words as a notice has hold enough of its words,
those are a window too, since copies one after the other hide each other in a
wider one. Windows whose words could not reach the least coverage in any order
are passed over, the others are aligned: words that are unique to both sides
anchor, the longest rising run of them stays, and gaps are aligned in turn.
Coverage is the share of the notice's words that align.

Defined results: a null text is empty and has no license; a text with several
notices reports the one with the highest coverage, then the longest, then the
first by name, and lists all; repeated rows each get a row; null ids stay null;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import slices, split_words
from .common import table
from .patience import align

#: Share of a notice's words that must align.
LEAST = 0.7
#: Up to so many words a notice is short: one word makes it another license's. All of its telling words must align, and
#: those that stand side by side must do so in the text.
SHORT = 20
# Words of short notices that do not tell one license from another.
PLAIN_WORDS = frozenset("a at by code copy dedicated domain file form following in is licence license licensed of public released source subject terms the this to under v version with work".split()) - {"by"}

# The notices, as their licenses word them.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT-short": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause-third": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}

_APART = np.ones(256, bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = False
_APART[128:] = False


def _words(first: int, data: np.ndarray, offsets: np.ndarray):
    return split_words(first, data, offsets, lower=True, space=_APART)


class Notices:
    """Notices as hashes of their words, and which distinct words each has."""

    def __init__(self, notices: dict[str, str], least: float):
        self.names = sorted(notices)
        texts = pa.array([notices[n] for n in self.names], pa.string())
        self.words = []
        for part in slices(texts):
            w = _words(*part)
            self.words += np.split(w.hash, w.bounds()[1:-1])
        # Of short notices, which words tell.
        self.telling = []
        for n, own in zip(self.names, self.words):
            parts = re.findall("[a-z0-9]+", notices[n].lower())
            self.telling.append([p not in PLAIN_WORDS for p in parts] if len(own) <= SHORT else [])
        self.vocabulary = np.unique(np.concatenate(self.words))
        self.has = np.array([np.isin(self.vocabulary, w) for w in self.words])
        # At most the words not found at all are missing from an alignment, however often they occur.
        self.often = np.array([[int((w == v).sum()) for v in self.vocabulary] for w in self.words])
        self.least = least

    def candidates(self, present: np.ndarray) -> np.ndarray:
        """(text, notice): whether enough of a notice's words occur in the text."""
        return present @ self.often.T >= self.least * self.often.sum(axis=1)


def _full(words: np.ndarray, often: np.ndarray, size: int, least: float) -> np.ndarray:
    """Starts of the runs of ``size`` words that hold enough of a notice's words, each counted as often as the notice has it.

    words are numbers of distinct notice words, or -1; often says how many of each the notice has.
    """
    hits = np.concatenate([[0], np.cumsum(words >= 0)])
    last = max(len(words) - size, 0)
    starts = np.flatnonzero(hits[np.minimum(np.arange(last + 1) + size, len(words))] - hits[: last + 1] >= least)
    out = []
    held, enough, at = np.zeros(len(often), np.int64), 0, -size
    for s in starts.tolist():
        if s - at >= size:
            held = np.bincount(words[s : s + size][words[s : s + size] >= 0], minlength=len(often))
            enough = int(np.minimum(held, often).sum())
        else:
            for w in words[at:s].tolist():
                if w >= 0:
                    enough -= int(held[w] <= often[w])
                    held[w] -= 1
            for w in words[at + size : s + size].tolist():
                if w >= 0:
                    enough += int(held[w] < often[w])
                    held[w] += 1
        at = s
        if enough >= least:
            out.append(s)
    return np.array(out, np.int64)


def _tells(telling: list[bool], pairs: list[tuple[int, int]]) -> bool:
    """Whether all telling words of a notice are among the aligned ones, and neighbours among them are neighbours."""
    place = {own: there for there, own in pairs}
    for i, tells in enumerate(telling):
        if tells and (i not in place or i and telling[i - 1] and place[i] != place[i - 1] + 1):
            return False
    return True


def _scan(notices: Notices, hashes: np.ndarray, k: int) -> tuple[float, int, int]:
    """Best (coverage, first word, last word) of notice k in a text; coverage is 0 if none reaches the least."""
    own = notices.words[k]
    size = len(own)
    distinct, often = np.unique(own, return_counts=True)
    at = np.minimum(np.searchsorted(distinct, hashes), len(distinct) - 1)
    words = np.where(distinct[at] == hashes, at, -1)
    near = np.flatnonzero(words >= 0)
    # Stretches: places where the notice's words lie less than a notice's length apart, cut also where one that
    # opens the notice comes again, so that a second copy does not make every word of the first ambiguous.
    opens = hashes[near] == own[0]
    far = np.diff(near) > size
    cuts = np.flatnonzero(far | opens[1:]) + 1
    least = notices.least * size - 1e-9
    spans = []
    for group in np.split(near, cuts):
        for a in range(int(group[0]), int(group[-1]) + 1, size):
            spans += [(a, min(a + 3 * size, len(hashes))), (a, min(a + 4 * size, len(hashes)))]
    spans += [(a, min(a + size, len(hashes))) for a in _full(words, often, size, least).tolist()]
    best = (0.0, -1, -1)
    for a, b in spans:
        inside = words[a:b][words[a:b] >= 0]
        if len(inside) < least or np.minimum(np.bincount(inside, minlength=len(often)), often).sum() < max(least, best[0] * size + 1e-9):
            continue
        pairs = align(hashes[a:b].tolist(), own.tolist())
        if not _tells(notices.telling[k], pairs):
            continue
        if pairs and len(pairs) / size > best[0]:
            best = (len(pairs) / size, a + pairs[0][0], a + pairs[-1][0])
    return best


def scan_licenses(docs: DataFrame, text: str = "text", id_col: str = "doc_id", notices: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, license (or null), coverage, first_word and last_word (from 0), and all notices found."""
    known = Notices(notices or NOTICES, least)
    frame = docs.select(docs[id_col].alias("doc_id"), docs[text].alias("_text"))
    kind = frame.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                words = _words(*part)
                docs = words.docs
                at = np.minimum(np.searchsorted(known.vocabulary, words.hash), len(known.vocabulary) - 1)
                hit = known.vocabulary[at] == words.hash
                present = np.zeros((docs, len(known.vocabulary)), np.int64)
                present[words.doc[hit], at[hit]] = 1
                found: list[list[tuple]] = [[] for _ in range(docs)]
                bounds = words.bounds()
                for d, k in zip(*np.nonzero(known.candidates(present))):
                    coverage, a, b = _scan(known, words.hash[bounds[d] : bounds[d + 1]], int(k))
                    if coverage >= known.least:
                        found[d].append((-coverage, -len(known.words[k]), known.names[k], a, b))
                best = [min(f) if f else None for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(words.first, docs),
                        pa.array([x[2] if x else None for x in best], pa.string()),
                        pa.array([-x[0] if x else 0.0 for x in best], pa.float64()),
                        pa.array([x[3] if x else None for x in best], pa.int64()),
                        pa.array([x[4] if x else None for x in best], pa.int64()),
                        pa.array([sorted(x[2] for x in f) for f in found], pa.list_(pa.string())),
                    ],
                    ["doc_id", "license", "coverage", "first_word", "last_word", "notices"],
                )

    return frame.mapInArrow(run, f"doc_id {kind}, license string, coverage double, first_word long, last_word long, notices array<string>")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).withColumn("notices", F.concat_ws(",", "notices"))
