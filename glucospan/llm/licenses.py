"""Licence notices in texts: winnowed fingerprints find candidates, banded alignment measures them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glucospan.llm import chars

#: Public licence notices, as their stewards publish them.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version. This library is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC0-1.0": (
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights "
        "to this software to the public domain worldwide. This software is distributed without any warranty."
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "https://www.boost.org/LICENSE_1_0.txt)"
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely"
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
}


@dataclass(frozen=True)
class Settings:
    """Any ``gram + window - 1`` words in common share a fingerprint; ``band`` words may be put in or left out in one
    place, in long templates one for every ``stretch`` words."""

    gram: int = 3
    window: int = 3
    band: int = 6
    stretch: int = 4
    coverage: float = 0.8


def winnowed(hashed: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Places of the least n-gram (the last among equals) of each run of ``window`` n-grams in one text."""
    chosen = np.zeros(len(hashed), bool)
    if not len(hashed):
        return np.flatnonzero(chosen)
    starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    lengths = np.diff(np.append(starts, len(text)))
    for begin, size in zip(starts[lengths < window], lengths[lengths < window]):
        part = hashed[begin : begin + size][::-1]
        chosen[begin + size - 1 - int(part.argmin())] = True
    n = len(hashed) - window + 1
    if n > 0:
        least, at = hashed[:n].copy(), np.arange(n)
        for step in range(1, window):
            low = hashed[step : step + n] <= least
            least[low] = hashed[step : step + n][low]
            at[low] = np.flatnonzero(low) + step
        inside = text[:n] == text[window - 1 :]
        chosen[at[inside]] = True
    return np.flatnonzero(chosen)


class Index:
    """Fingerprint -> the templates that have it, and where."""

    def __init__(self, templates: dict[str, str], s: Settings):
        self.names, self.s = list(templates), s
        w = chars.words([templates[name] for name in self.names])
        self.words = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        hashed, at = chars.windows_hash(w.hash, w.text, tuple(range(s.gram)))
        picked = winnowed(hashed, w.text[at], s.window)
        order = np.argsort(hashed[picked], kind="stable")
        self.hash = hashed[picked][order]
        self.template = w.text[at[picked]][order]
        self.place = (at[picked] - w.first[w.text[at[picked]]])[order]

    def hits(self, w: chars.Words) -> np.ndarray:
        """Rows (text, template, word where the template would begin), sorted."""
        hashed, at = chars.windows_hash(w.hash, w.text, tuple(range(self.s.gram)))
        picked = winnowed(hashed, w.text[at], self.s.window)
        keys, words = hashed[picked], at[picked]
        low, high = np.searchsorted(self.hash, keys), np.searchsorted(self.hash, keys, "right")
        many = high - low
        row = np.repeat(words, many)
        entry = np.repeat(high - np.cumsum(many), many) + np.arange(many.sum())
        found = np.column_stack([w.text[row], self.template[entry], row - w.first[w.text[row]] - self.place[entry]])
        return np.unique(found, axis=0) if len(found) else found

    def found(self, texts: list[str]) -> list[tuple[int, str, int, int, int, int, float]]:
        """(text, licence, begin, end, first word, matched words, coverage), the better of overlapping ones."""
        w = chars.words(texts)
        rows = []
        for text, template, low, high, band in self._chains(self.hits(w)):
            first = int(w.first[text])
            own = w.hash[first : int(w.first[text + 1])]
            matched, begin, end = aligned(self.words[template], own, low, high, band)
            coverage = matched / len(self.words[template])
            if matched and coverage >= self.s.coverage:
                span = int(w.begin[first + begin]), int(w.end[first + end])
                rows.append((text, self.names[template], *span, begin, matched, coverage))
        return _best(rows)

    def _chains(self, hits: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, template, first and last beginning, band): beginnings that can be of one notice.

        What is put into a notice moves the later beginnings on, by the band at a place. Two notices begin at least
        as far apart as the words that the coverage asks for, so a chain of beginnings is shorter than that; the same
        beginnings may stand in the chains of two notices.
        """
        at, n = 0, len(hits)
        while at < n:
            text, template, start = (int(x) for x in hits[at])
            size = len(self.words[template])
            band, stop = max(self.s.band, size // self.s.stretch), at + 1
            least = max(1, int(np.ceil(self.s.coverage * size)))
            while stop < n and tuple(hits[stop, :2]) == (text, template):
                if hits[stop, 2] - hits[stop - 1, 2] > band or hits[stop, 2] - start >= least:
                    break
                stop += 1
            yield text, template, start, int(hits[stop - 1, 2]), band
            at = stop


def aligned(template: np.ndarray, own: np.ndarray, low: int, high: int, band: int) -> tuple[int, int, int]:
    """Most words in common order, with the template beginning at ``low`` to ``high``, give or take the band.

    Returns the number and the first and last matched word of the text.
    """
    left = low - band
    width = high - low + 2 * band + 1
    # best[d]: (matches, first word, last word) on diagonal d after this template word; of equals the shorter span.
    best: list[tuple[int, int, int]] = [(0, 0, -1)] * width
    for i, word in enumerate(template):
        row: list[tuple[int, int, int]] = []
        for d in range(width):
            j = left + i + d
            here = best[d]
            if 0 <= j < len(own) and own[j] == word:
                count, first, _ = here
                here = (count + 1, first if count else j, j)
            if d + 1 < width:  # this template word is left out
                here = max(here, best[d + 1], key=lambda x: (x[0], x[1]))
            if d:  # the text has a word more
                here = max(here, row[-1], key=lambda x: (x[0], x[1]))
            row.append(here)
        best = row
    # Of equals the one nearest to where it should begin: the notices beside it have chains of their own.
    count, first, last = max(best, key=lambda x: (x[0], -max(low - x[1], x[1] - high, 0), x[1] - x[2]))
    return count, first, last


def _best(rows: list[tuple]) -> list[tuple]:
    """Of findings that overlap in a text the one with most matched words, then the best covered, then the first."""
    kept: list[tuple] = []
    taken: dict[int, list[tuple[int, int]]] = {}
    for row in sorted(rows, key=lambda r: (r[0], -r[5], -r[6], r[2], r[1])):
        spans = taken.setdefault(row[0], [])
        if all(row[3] <= a or row[2] >= b for a, b in spans):
            spans.append((row[2], row[3]))
            kept.append(row)
    return sorted(kept, key=lambda r: (r[0], r[2]))


def scan(df: DataFrame, key: str, text: str = "text", templates: dict[str, str] | None = None, settings: Settings = Settings()) -> DataFrame:
    """One row for each notice: the key, ``license``, ``begin`` and ``end`` in characters, ``matched`` words, ``coverage``.

    ``templates`` (name -> text, of five words or more to be found for sure) go to every task; the default is
    ``NOTICES``. Whole texts are searched; null and empty ones have no rows, and repeated rows give repeated findings.
    """
    known = dict(NOTICES if templates is None else templates)
    schema = T.StructType(
        [df.schema[key], T.StructField("license", T.StringType())]
        + [T.StructField(n, T.LongType()) for n in ("begin", "end", "matched")]
        + [T.StructField("coverage", T.DoubleType())]
    )

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(known, settings)
        for part in parts:
            for at, some in chars.chunks(part.column(1)):
                rows = index.found(some)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array([at + r[0] for r in rows], pa.int64())),
                        pa.array([r[1] for r in rows], pa.string()),
                        *(pa.array([r[i] for r in rows], pa.int64()) for i in (2, 3, 5)),
                        pa.array([r[6] for r in rows], pa.float64()),
                    ],
                    names=[f.name for f in schema],
                )

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(batches, schema)
