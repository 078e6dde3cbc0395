"""Licence notices in texts, by the Dice coefficient of word bigrams with templates.

Text and templates are normalised to lower-case words of letters and digits. A unit of text
is a window as long as the template that begins with one of its bigrams (shorter at the end
of a text). Size bounds prune first: a unit that is too short for a template, or has too few
of its bigrams, cannot reach the wanted coefficient; only the rest is counted exactly.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .decontaminate import bit_mask, look_up, plain_words

LEAST = 0.8

# Wording of common licence notices and short licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
            "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
            "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
            "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
            "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
            "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
            "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
            "materials provided with the distribution."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation; either version 2.1 of the License, "
                 "or (at your option) any later version."),
    ("LGPL-2.1", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation; either version 2.1 of the License, "
                 "or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                 "or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                 "or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                 "or (at your option) any later version."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
                        "International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
                        "International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("all-rights-reserved", "All rights reserved."),
)


class Library(NamedTuple):
    """Names, bigram ids and counts of the templates; ``holds[template, id]``: does it have the bigram."""

    names: list[str]
    grams: np.ndarray
    counts: list[Counter]
    sizes: np.ndarray
    holds: np.ndarray


def _bigrams(hashes: np.ndarray) -> np.ndarray:
    return T.mix64(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])


def library(templates=TEMPLATES) -> Library:
    """Templates of fewer than two words have no bigram and are an error."""
    found = []
    for _, text in templates:
        raw = text.encode()
        hashes, _ = plain_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        if len(hashes) < 2:
            raise ValueError(f"a template needs two words: {text!r}")
        found.append(_bigrams(hashes))
    grams = np.unique(np.concatenate(found))
    ids = [np.searchsorted(grams, f) for f in found]
    holds = np.zeros((len(ids), len(grams)), bool)
    for k, i in enumerate(ids):
        holds[k, i] = True
    return Library([n for n, _ in templates], grams, [Counter(i.tolist()) for i in ids],
                   np.array([len(i) for i in ids]), holds)


def scan(data: np.ndarray, offsets: np.ndarray, lib: Library, mask: np.ndarray,
         least: float = LEAST) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, template, first word, words, coefficient) of the notices: of units that overlap, the one with
    the best coefficient, the longest of equal ones."""
    hashes, counts = plain_words(data, offsets)
    if len(hashes) < 2:
        return
    ids = look_up(_bigrams(hashes), lib.grams, mask)
    own = np.repeat(np.arange(len(counts) - 1), np.diff(counts))
    ids[own[1:] != own[:-1]] = -1  # no bigram across texts
    at = np.flatnonzero(ids >= 0)
    units = []
    for k, size in enumerate(lib.sizes.tolist()):
        p = at[lib.holds[k, ids[at]]]
        if not len(p):
            continue
        end = np.minimum(p + size, counts[own[p] + 1] - 1)
        unit = end - p
        hits = np.searchsorted(p, end) - np.arange(len(p))
        # 2 * common / (unit + size) >= least; common is at most the shorter side and at most the hits
        fits = (unit * (2 - least) >= least * size) & (2 * hits >= least * (unit + size))
        for i in np.flatnonzero(fits).tolist():
            a, b = int(p[i]), int(end[i])
            window = ids[a:b]
            common = sum((Counter(window[window >= 0].tolist()) & lib.counts[k]).values())
            dice = 2 * common / (b - a + size)
            if dice >= least:
                units.append((-dice, a - b, a, b, k))
    starts, ends = [], []  # of the bigrams taken, in order
    for dice, _, a, b, k in sorted(units):
        i = bisect_right(starts, a)
        if (i and ends[i - 1] > a) or (i < len(starts) and starts[i] < b):
            continue
        starts.insert(i, a)
        ends.insert(i, b)
        text = int(own[a])
        yield text, k, a - int(counts[text]), b - a + 1, -dice


def notices(documents: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row per document and licence: doc_id, license, dice (the best), n_notices, first_word, n_words (of the first).

    Documents without a notice, null and empty texts and rows without doc_id have no rows;
    repeated rows of one doc_id count once; other columns are ignored; an empty table gives
    no rows. Texts are scanned whole. The templates are a fixed list and go to every task.
    """
    lib = library(templates)
    shared = documents.sparkSession.sparkContext.broadcast(lib)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = shared.value
        mask = bit_mask(lib.grams)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, _, data, offsets in T.slices(batch.column(1)):
                rows = [(ids[a + t], lib.names[k], w, n, d) for t, k, w, n, d in scan(data, offsets, lib, mask, least)]
                cols = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                                 ["doc_id", "license", "word", "words", "dice"])

    found = (documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
             .where("doc_id is not null and text is not null")
             .mapInArrow(run, "doc_id long, license string, word long, words long, dice double").distinct())
    return found.groupBy("doc_id", "license").agg(
        F.max("dice").alias("dice"), F.count_distinct("word").alias("n_notices"),
        F.min("word").alias("first_word"), F.min_by("words", "word").alias("n_words"))
