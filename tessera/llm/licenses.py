"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Windows have the length of the templates of a size class and begin at every shingle. A window of the template's length
with containment c has a similarity of at least c / (2 - c): 0.667 at 0.8. With 16 bands of 2 values the bands meet
with a probability of 1 - (1 - 0.667^2)^16 > 0.9999. What the bands retrieve is verified on the exact shingles.
A text shorter than a template is one window, if it can hold enough of the template's shingles; the bound is the same.
Only windows with as many shingles of any template as the least containment asks for are looked up: others can't match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, gram_hashes

SHINGLE, BANDS, ROWS = 5, 16, 2

# Public license notices and the opening or granting paragraphs of license texts.
TEMPLATES: dict[str, list[str]] = {
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    ],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "WTFPL": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "proprietary": ["All rights reserved."],
}

_RUN = re.compile(rb"[a-z0-9]+").findall
_A = np.random.default_rng(31).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _words(text: str) -> list[bytes]:
    """The words [a-z0-9]+ of the lower-cased text; bytes of other letters end a word."""
    return _RUN(text.lower().encode())


class Index:
    """Templates by size class (their number of words) and by band."""

    def __init__(self, templates: dict[str, list[str]], hashes: WordHashes):
        self.names, self.sets, self.sizes = [], [], []
        bands: dict[int, list[tuple[int, int]]] = {}
        for name, texts in templates.items():
            for text in texts:
                words = _words(text)
                n = len(words)
                grams = gram_hashes(hashes.of(words), min(SHINGLE, n))
                self.names.append(name)
                self.sets.append(np.unique(grams))
                self.sizes.append(n)
                bands.setdefault(n, []).extend((v, len(self.names) - 1) for v in band_values(_minima(grams[None, :]))[0].tolist())
        #: by size: sorted band values (a value holds its band's number) and the template of each
        self.bands = {n: (np.array([v for v, _ in sorted(b)], np.uint64), [t for _, t in sorted(b)]) for n, b in bands.items()}
        self.least = {n: min(len(s) for s, m in zip(self.sets, self.sizes) if m == n) for n in bands}
        self.known = {n: np.unique(np.concatenate([s for s, m in zip(self.sets, self.sizes) if m == n])) for n in bands}
        self.all = {k: np.unique(np.concatenate([s for s, m in zip(self.sets, self.sizes) if min(m, SHINGLE) == k])) for k in {min(m, SHINGLE) for m in self.sizes}}


def _minima(windows: np.ndarray) -> np.ndarray:
    """(windows, hash functions): least value of each window's shingles under each function."""
    return np.stack([(windows * a).min(axis=1) for a in _A], axis=1)


def band_values(minima: np.ndarray) -> np.ndarray:
    """(windows, BANDS): the values of a band mixed with its number."""
    parts = minima.reshape(len(minima), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        out = out * np.uint64(0x9E3779B97F4A7C15) ^ parts[:, :, r]
    return out


def scan(text: str | None, index: Index, hashes: WordHashes, least: float) -> list[tuple[str, int, int, float]]:
    """(license, first word, end word, containment) of the matches, by position.

    Of overlapping ones that with the most shingles of its template stays, and those of other licenses with as many.
    """
    words = _words(text) if text else []
    if not words:
        return []
    h = hashes.of(words)
    found = []
    grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k, known in index.all.items():
        g = gram_hashes(h, k)
        at = np.flatnonzero(known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g)  # places of template shingles
        if len(at):
            grams[k] = g, at
    for n, (values, owners) in index.bands.items():
        k = min(n, SHINGLE)
        need = max(1, int(np.ceil(least * index.least[n] - 1e-9)))
        if k not in grams or len(grams[k][1]) < need:
            continue
        g, at = grams[k]
        at = at[np.isin(g[at], index.known[n])]
        span = min(n, len(words)) - k + 1  # shingles in a window
        # windows with `need` template shingles: those that begin between the last of them less span and the first
        if len(at) < need or span < need:
            continue
        marks = np.zeros(len(g) - span + 2, np.int32)
        first, last = at[: len(at) - need + 1], at[need - 1 :]
        close = last - first < span
        np.add.at(marks, np.maximum(last[close] - span + 1, 0), 1)
        np.add.at(marks, np.minimum(first[close], len(g) - span) + 1, -1)
        starts = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        for lo in range(0, len(starts), 4096):
            part = starts[lo : lo + 4096]
            bands = band_values(_minima(np.lib.stride_tricks.sliding_window_view(g, span)[part]))
            place = np.searchsorted(values, bands)
            row, col = np.nonzero(values[np.minimum(place, len(values) - 1)] == bands)
            pairs = set()
            for r, p, v in zip(row.tolist(), place[row, col].tolist(), bands[row, col].tolist()):
                while p < len(values) and int(values[p]) == v:  # templates that share a band value lie side by side
                    pairs.add((r, owners[p]))
                    p += 1
            for r, t in pairs:
                start = int(part[r])
                both = len(np.intersect1d(index.sets[t], g[start : start + span]))
                c = both / len(index.sets[t])
                if c >= least:
                    found.append((both, c, start, start + span + k - 1, index.names[t]))
    out: list[tuple[int, float, int, int, str]] = []
    for m in sorted(found, key=lambda x: (-x[0], -x[1], x[2] - x[3], x[2], x[4])):
        over = [o for o in out if m[2] < o[3] and o[2] < m[3]]
        if all(o[4] != m[4] and o[0] == m[0] for o in over):
            out.append(m)
    return sorted(((name, lo, hi, c) for _, c, lo, hi, name in out), key=lambda x: (x[1], x[2], x[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_matches, licenses, matches), one for each row of docs.

    licenses: distinct names, sorted, comma-joined; matches: license:first:end by position, comma-joined, in words
    [a-z0-9]+ of the lower-cased text. Null and empty texts match nothing; repeated rows get the same result each.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        index = Index(templates, hashes)
        for batch in batches:
            found = [scan(t.as_py(), index, hashes, least) for t in batch.column(1)]
            cols = [
                batch.column(0),
                pa.array([len(f) for f in found], pa.int64()),
                pa.array([",".join(sorted({x[0] for x in f})) for f in found], pa.string()),
                pa.array([",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in f) for f in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "n_matches", "licenses", "matches"])

    narrow = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = narrow.schema[key].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{key}` {kind}, n_matches long, licenses string, matches string")
