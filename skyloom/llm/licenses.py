"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Texts and templates are words (lower-case runs of letters and digits) and SHINGLE-word shingles. Templates are assigned
to the smallest window length whose windows, a quarter of their length apart, are sure to contain the whole template.
A window and a template are compared by as many one-row bands (MinHash values) as make the chance of missing a template
that is contained to `containment` at most MISS. A window's minimum equals a template's only where the window contains
that shingle, so windows without any template shingle, nearly all, need no signature, and nothing is lost by that.
Retrieved templates are verified by the exact share of their shingles in the window. Templates that differ in a version or
a few words would pass for one another by that share alone, so a match must also have a shingle with each version number of
the template's name, and, for every template that holds nearly all of its shingles, one of those that this lacks.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyloom.llm import blocks as B
from skyloom.llm.substring_dedup import word_hashes

SHINGLE = 5
CONTAINMENT = 0.8
WINDOWS = (16, 32, 64, 128, 256, 512)
MISS = 1e-6
GROUP_BYTES = 4 << 20

# Wording of public licence notices.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-1.0": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "CC0-1.0-notice": "This work is licensed under a CC0 1.0 Universal Public Domain Dedication.",
}
CREATIVE_COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _kind, _words in CREATIVE_COMMONS.items():
    TEMPLATES[f"CC-{_kind}-4.0"] = f"This work is licensed under a Creative Commons {_words} 4.0 International License."
    TEMPLATES[f"CC-{_kind}-3.0"] = f"This work is licensed under a Creative Commons {_words} 3.0 Unported License."
    TEMPLATES[f"CC-{_kind}-4.0-notice"] = f"Licensed under CC {_kind} 4.0."
    TEMPLATES[f"CC-{_kind}-3.0-notice"] = f"Licensed under CC {_kind} 3.0."
# identifiers of two words and more: shorter ones make no shingle with "SPDX-License-Identifier"
for _id in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CC0-1.0", *(f"CC-{k}-4.0" for k in CREATIVE_COMMONS), *(f"{f}-{o}" for f in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for o in ("only", "or-later"))):
    TEMPLATES[f"{_id}-spdx"] = f"SPDX-License-Identifier: {_id}"

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def fold(text: bytes | None) -> bytes:
    return (text or b"").translate(_FOLD)


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    at = np.arange(max(0, len(words) - n + 1))
    return B.runs_hash(words, at, at + n, B.BASE2)


def bands_for(jaccard: float) -> int:
    """One-row bands with which a pair of this similarity is missed with a chance of at most MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-jaccard))


class Templates:
    def __init__(self, texts: dict[str, str], containment: float):
        self.names = list(texts)
        self.sets = [np.unique(shingles(word_hashes(fold(t.encode())))) for t in texts.values()]
        self.lengths = [len(fold(t.encode()).split()) for t in texts.values()]
        if short := [n for n, s in zip(self.names, self.sets) if not len(s)]:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
        self.family = [re.sub(r"-(notice|spdx)$", "", n) for n in self.names]
        self.needed = [self.telling(i, t, containment) for i, t in enumerate(texts.values())]
        self.known = np.unique(np.concatenate(self.sets))
        table = np.zeros(1 << 16, bool)
        table[self.known >> np.uint64(48)] = True
        self.table = table
        self.classes: dict[int, list[int]] = {}
        for i, n in enumerate(self.lengths):
            w = next((w for w in WINDOWS if n <= 3 * w // 4), None) or 4 * math.ceil(n / 3)
            self.classes.setdefault(w, []).append(i)
        self.index = {}
        for w, own in self.classes.items():
            least = min(math.ceil(containment * len(self.sets[i])) / (w - SHINGLE + 1 + len(self.sets[i])) for i in own)
            salts = B.mix(np.arange(1, bands_for(least) + 1, dtype=np.uint64))
            values = np.stack([self.signature(self.sets[i], salts) for i in own])
            self.index[w] = (salts, values, own)

    def telling(self, i: int, text: str, containment: float) -> list[np.ndarray]:
        """Sets of shingles of template i, each of which a match must have one of."""
        words, hashed = fold(text.encode()).split(), word_hashes(fold(text.encode()))
        own = shingles(hashed)
        out = []
        for version in {v for v in re.findall(r"-(\d+)\.\d+", self.names[i])}:
            at = [a for a in range(len(own)) if version.encode() in words[a : a + SHINGLE]]
            out += [own[at]] if at else []
        for j, other in enumerate(self.sets):
            rest = np.setdiff1d(self.sets[i], other)
            if j != i and len(rest) and len(self.sets[i]) - len(rest) >= containment * len(self.sets[i]):
                out.append(rest)
        return out

    @staticmethod
    def signature(own: np.ndarray, salts: np.ndarray) -> np.ndarray:
        return B.mix(own[None, :] ^ salts[:, None]).min(axis=1)

    def has(self, s: np.ndarray) -> np.ndarray:
        """Which shingles are any template's."""
        out = self.table[s >> np.uint64(48)]
        at = np.flatnonzero(out)
        out[at] = B.isin_sorted(s[at], self.known)
        return out

    def matches(self, s: np.ndarray, hit: np.ndarray, containment: float) -> list[tuple[str, int, int, float]]:
        """(name, first word, words, containment) in a text of shingles s, of which `hit` (positions) are templates'."""
        found: dict[int, list[tuple[int, int, float]]] = {}
        for w, (salts, values, own) in self.index.items():
            stride, span = w // 4, w - SHINGLE + 1
            last = np.unique(hit // stride)
            windows = np.unique(np.concatenate([np.maximum(0, last - k) for k in range(4)])) * stride
            for a in windows.tolist():
                part = s[a : a + span]
                if not len(part):
                    continue
                same = (self.signature(part, salts)[None, :] == values).any(axis=1)
                for j in np.flatnonzero(same).tolist():
                    i = own[j]
                    inside = np.flatnonzero(np.isin(part, self.sets[i]))
                    share = len(np.unique(part[inside])) / len(self.sets[i])
                    if share >= containment and all(np.isin(part[inside], n).any() for n in self.needed[i]):
                        found.setdefault(i, []).append((a + int(inside[0]), a + int(inside[-1]) + SHINGLE, share))
        out = []
        for i, spans in found.items():
            joined: list[list] = []
            for a, b, share in sorted(spans):  # windows that overlap tell of one notice
                if joined and a < joined[-1][1]:
                    joined[-1][1:] = [max(b, joined[-1][1]), max(share, joined[-1][2])]
                else:
                    joined.append([a, b, share])
            out += [(i, a, b - a, share) for a, b, share in joined]
        # a notice inside a longer text of the same licence is part of it
        inside = lambda m, o: o[1] <= m[1] and m[1] + m[2] <= o[1] + o[2] and o[2] > m[2] and self.family[o[0]] == self.family[m[0]]
        return sorted(((self.names[m[0]], *m[1:]) for m in out if not any(inside(m, o) for o in out)), key=lambda m: (m[1], m[0]))


def find_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """One row for each notice in each whole text: doc_id, license, start_word, n_words, containment.

    Occurrences of one template in one window, and spans that overlap, are one notice; so is a notice inside a longer text of
    the same licence. Null and empty texts, and texts of fewer words than a shingle,
    have none; nothing depends on other rows, so repeated rows and null ids need no rule; empty tables give empty
    results; other columns are not read. The templates are a small fixed table that goes to each task; there is no shuffle.
    """
    wanted = Templates(templates or TEMPLATES, containment)

    def of(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            rows, group, size = [], [], 0
            for i in range(len(ids)):
                t = fold(texts[i].as_py())
                group.append((ids[i], t))
                size += len(t)
                if size >= GROUP_BYTES or i + 1 == len(ids):
                    counts = [len(t.split()) for _, t in group]
                    s = shingles(word_hashes(b" ".join(t for _, t in group)))
                    hits = np.flatnonzero(wanted.has(s))
                    bounds = np.concatenate([[0], np.cumsum(counts)])
                    doc = np.searchsorted(bounds, hits, "right") - 1
                    ok = hits + SHINGLE <= bounds[doc + 1]
                    hits, doc = hits[ok], doc[ok]
                    for d in np.unique(doc).tolist():
                        a, b = bounds[d], bounds[d + 1]
                        rows += [(group[d][0], *m) for m in wanted.matches(s[a : b - SHINGLE + 1], hits[doc == d] - a, containment)]
                    group, size = [], 0
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "license", "start_word", "n_words", "containment"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(of, "doc_id long, license string, start_word long, n_words long, containment double")
