"""License scans (operator 2): conditional compression against license templates.

Candidate blocks are runs of lines with license wording (lines up to ``GAP``
lines apart belong together) and the words around them that a template can
reach.  In a block each template is aligned with the words that have it in order
with the fewest differences: the share of its words that are there must reach
``confirm``, words between them may be as many as it has, no word that names its
license may be missing, and none that makes another one of it (``lesser``,
``nc``) may be between.  Such a span has
at most twice the template's words, so a block of any length is gone through in
windows of four times its words, overlapping by half.  First each window, and
pieces of it where the text around hides the gain, is compressed alone and with
each template whose words are there as a zstandard raw dictionary.  The bytes
saved, as a share of what the template itself compresses to, rank windows and
templates; those that reach ``rank`` are aligned, from the largest share on.  A
span is compressed so again, must reach ``rank`` too, and its share ranks
templates with equal wording.

Documents without license wording are dropped by a JVM filter, and the rest are
scanned where they are read: no shuffle.

Defined results: null and empty texts have no blocks; repeated rows give
repeated results; a span is left out only where it overlaps one with fewer
differences for its template's length, or with as few of the same family; ties
go to the longer template, then by the share saved, then by name; other columns
are ignored.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = 2
#: Words of license notices; lines without one are no candidates.
WORDING = r"(?i)licen[sc]e|copyright|\bspdx\b|all rights reserved|public domain|permission is|without warrant|redistribut|creative commons|\bcc[ -]by|\bcc0\b"

#: Public notices and texts of common licenses, (family, SPDX name, text); # stands for a version or year.
TEMPLATES = [
    ("MIT", "MIT", "Released under the MIT License."),
    ("MIT", "MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache", "Apache-#", "Licensed under the Apache License, Version #."),
    ("Apache", "Apache-#", "Licensed under the Apache License, Version # (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache", "Apache-#", "Apache License Version # January # http://www.apache.org/licenses TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL", "GPL-#", "This work is licensed under the GNU General Public License, version #."),
    ("GPL", "GPL-#", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version # of the License, or (at your option) any later version."),
    ("GPL", "GPL-#", "GNU General Public License Version # June # Copyright (C) # Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL", "LGPL-#", "This work is licensed under the GNU Lesser General Public License, version #."),
    ("LGPL", "LGPL-#", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version # of the License, or (at your option) any later version."),
    ("LGPL", "LGPL-#", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version # of the License, or (at your option) any later version."),
    ("LGPL", "LGPL-#", "GNU Lesser General Public License Version # June # Copyright (C) # Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL", "AGPL-#", "This work is licensed under the GNU Affero General Public License, version #."),
    ("AGPL", "AGPL-#", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version # of the License, or (at your option) any later version."),
    ("AGPL", "AGPL-#", "GNU Affero General Public License Version # November # Copyright (C) # Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("BSD", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("Boost", "BSL-#", "Distributed under the Boost Software License, Version #."),
    ("Boost", "BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"),
    ("Unlicense", "Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("WTFPL", "WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("MPL", "MPL-#", "This Source Code Form is subject to the terms of the Mozilla Public License, v. #."),
    ("MPL", "MPL-#", "Licensed under the Mozilla Public License, version #."),
    ("EPL", "EPL-#", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v#."),
    ("EUPL", "EUPL-#", "Licensed under the EUPL, Version #."),
    ("Artistic", "Artistic-#", "This is free software; you can redistribute it and/or modify it under the terms of the Artistic License #."),
    ("CC0", "CC0-#", "Released into the public domain under CC0 #."),
    ("CC0", "CC0-#", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under the CC0 #."),
]
#: The terms of the Creative Commons licenses, short and long.
_TERMS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _short, _long in _TERMS.items():
    TEMPLATES += [(f"CC {_short}", f"CC-{_short}-#", text) for text in (f"Licensed under CC {_short} #.", f"This work is licensed under a Creative Commons {_long} # International License.", f"This work is licensed under the Creative Commons {_long} # License.")]
    if "-" in _short:
        TEMPLATES.append((f"CC {_short}", f"CC-{_short}-#", f"Licensed under CC {_short.replace('-', ' ')} #."))
#: SPDX identifiers; a tag line with one of them is a notice.
for _id in "MIT Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later BSD-2-Clause BSD-3-Clause ISC Zlib BSL-1.0 Unlicense WTFPL MPL-2.0 EPL-2.0 EUPL-1.2 Artistic-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-ND-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0".split():
    TEMPLATES.append((f"SPDX {_id}", _id, f"SPDX-License-Identifier: {_id}"))

#: Words that name a license: a template's own may not be missing.
NAMES = frozenset("mit apache gnu lesser library affero mozilla eclipse boost eupl artistic cc cc0 creative commons by".split()) | {x.lower() for x in (*_TERMS, *_TERMS.values())}
#: Words that make another license of one: none that a template lacks may be between its words.
QUALIFIERS = frozenset("lesser affero nc nd sa noncommercial non-commercial sharealike share-alike noderivatives noderivs".split()) | {x.lower() for x in (*_TERMS, *_TERMS.values()) if "-" in x}

_VERSION = re.compile(r"v?\d+(?:\.\d+)*")
_OUTER = ".,;:()\"'"
#: More than any count of words.
_FAR = 1 << 20


def bare(text: str) -> list[str]:
    """Lower-case words without outer punctuation."""
    return [w for w in (w.strip(_OUTER) for w in text.lower().split()) if w]


def words(text: str) -> list[str]:
    """As ``bare``, but versions become #."""
    return ["#" if _VERSION.fullmatch(w) else w for w in bare(text)]


def aligned(wanted: np.ndarray, own: np.ndarray, most_missing: int, needed: np.ndarray | None = None, cost: np.ndarray | None = None) -> list[tuple[int, int]] | None:
    """Pairs of equal words, in order, with the fewest words missing and added between them, then the fewest missing.

    At most ``most_missing`` words may be missing, none of the ``needed`` ones, and the words added may ``cost`` (1 each,
    if not told) no more than ``wanted`` has; None where there is no such alignment.
    """
    n = len(wanted)
    needed = np.zeros(n, bool) if needed is None else needed
    cost = np.ones(len(own), np.int64) if cost is None else cost
    passed = np.concatenate([[0], np.cumsum(cost)])
    # Least cost of words added, by words missing so far and words of ``own`` passed; an alignment begins anywhere.
    least = np.full((most_missing + 1, len(own) + 1), _FAR)
    least[0] = 0
    steps = [least]
    for word, must in zip(wanted, needed, strict=True):
        now = np.full_like(least, _FAR)
        if not must:
            now[1:] = least[:-1]
        hit = np.flatnonzero(own == word)
        now[:, hit + 1] = np.minimum(now[:, hit + 1], least[:, hit])
        least = np.minimum(np.minimum.accumulate(now - passed, axis=1) + passed, _FAR)
        steps.append(least)
    total = np.where(now <= n, now + np.arange(most_missing + 1)[:, None], _FAR)
    m, j = divmod(int(total.argmin()), len(own) + 1)
    if total[m, j] >= _FAR:
        return None
    pairs, i, value = [], n, int(now[m, j])
    while i:
        if j and own[j - 1] == wanted[i - 1] and steps[i - 1][m, j - 1] == value:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif m and not needed[i - 1] and steps[i - 1][m - 1, j] == value:
            i, m = i - 1, m - 1
        else:
            j, value = j - 1, value - int(cost[j - 1])
    return pairs[::-1]


class Scanner:
    def __init__(self, templates=None, rank: float = 0.25, confirm: float = 0.8, level: int = 3):
        self.rank, self.wording = rank, re.compile(WORDING)
        params = zstandard.ZstdCompressionParameters.from_level(level, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False)
        self.plain = zstandard.ZstdCompressor(compression_params=params)
        self.templates, self.numbers, coded = [], {}, []
        for family, name, text in templates or TEMPLATES:
            raw, wanted = text.encode(), words(text)
            given = zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            self.templates.append((family, name, wanted, given, len(self.plain.compress(raw))))
            # 0 is any word of no template.
            coded.append(np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in wanted]))
        #: Words as numbers, how often each is there, how many may be missing, and which may not; the numbers of words that refute.
        self.coded = [(c, np.bincount(c, minlength=len(self.numbers) + 1), max(m for m in range(len(c)) if len(c) - m >= confirm * len(c) - 1e-9 or not m), np.array([w in NAMES for w in t[2]])) for c, t in zip(coded, self.templates, strict=True)]
        for w in QUALIFIERS:
            self.numbers.setdefault(w, len(self.numbers) + 1)
        self.refuting = [np.array(sorted(self.numbers[w] for w in QUALIFIERS - set(t[2]))) for t in self.templates]
        self.reach = 2 * max((len(c) for c in coded), default=0)

    def blocks(self, text: str):
        """(words as written, their lines) of the runs of lines with license wording, with ``reach`` words before and after; runs that meet are one."""
        if not self.wording.search(text):
            return
        lines = text.split("\n")
        runs: list[list[int]] = []
        for i, line in enumerate(lines):
            if self.wording.search(line):
                if runs and i - runs[-1][1] <= GAP + 1:
                    runs[-1][1] = i
                else:
                    runs.append([i, i])
        written, at, begins = [], [], [0]
        for i, line in enumerate(lines):
            own = [w for w in line.split() if w.strip(_OUTER)]
            written += own
            at += [i] * len(own)
            begins.append(len(written))
        met: list[list[int]] = []
        for first, last in runs:
            a, b = max(0, begins[first] - self.reach), min(len(written), begins[last + 1] + self.reach)
            if met and a <= met[-1][1]:
                met[-1][1] = b
            else:
                met.append([a, b])
        for a, b in met:
            yield written[a:b], at[a:b]

    def saved(self, n: int, raw: bytes) -> float:
        """Bytes that the template as a dictionary saves, as a share of its own."""
        _, _, _, given, size = self.templates[n]
        return (len(self.plain.compress(raw)) - len(given.compress(raw))) / size

    def ranked(self, n: int, written: list[str], lo: int, hi: int) -> float:
        """The largest share that a template saves of a window, or, where that is too little, of pieces of it.

        Much text around a notice hides what the template saves of it, so pieces get shorter, down to the template's words.
        """
        size, best = hi - lo, -np.inf
        least = len(self.coded[n][0])
        while True:
            last = max(lo, hi - size)
            for at in (*range(lo, last, max(1, size // 12)), last):
                best = max(best, self.saved(n, " ".join(written[at : at + size]).encode("utf-8", "replace")))
                if best >= self.rank:
                    return best
            if size <= least:
                return best
            size = max(least, size * 3 // 4)

    def confirmed(self, written: list[str]):
        """(first word, end, name, version, share saved, share of words, missing, added) of the spans whose wording confirms a license."""
        own = [w.lower().strip(_OUTER) for w in written]
        plain = ["#" if _VERSION.fullmatch(w) else w for w in own]
        codes = np.array([self.numbers.get(w, 0) for w in plain], np.int64)
        heap: list[tuple] = []

        def enough(n: int, lo: int, hi: int) -> bool:
            """Whether enough of a template's words, and all that name its license, are between two words."""
            coded, counts, most_missing, needed = self.coded[n]
            there = np.bincount(codes[lo:hi], minlength=len(counts))[: len(counts)]
            return np.minimum(there, counts).sum() >= len(coded) - most_missing and bool(there[coded[needed]].all())

        def look(n: int, lo: int, hi: int):
            """The best span of a template between two words."""
            if not enough(n, lo, hi):
                return
            coded, _, most_missing, needed = self.coded[n]
            pairs = aligned(coded, codes[lo:hi], most_missing, needed, np.where(np.isin(codes[lo:hi], self.refuting[n]), len(coded) + 1, 1))
            if pairs is None:
                return
            pairs = [(i, lo + j) for i, j in pairs]
            first, end = pairs[0][1], pairs[-1][1] + 1
            saved = self.saved(n, " ".join(written[first:end]).encode("utf-8", "replace"))
            if saved < self.rank:
                look(n, lo, first)
                look(n, end, hi)
                return
            differ = len(coded) - len(pairs) + end - first - len(pairs)
            heapq.heappush(heap, (differ / len(coded), -len(pairs), -saved, self.templates[n][1], n, first, end, lo, hi, pairs))

        ranked: list[tuple] = []
        present = np.bincount(codes, minlength=len(self.numbers) + 1)
        for n, (coded, counts, most_missing, needed) in enumerate(self.coded):
            if not present[coded[needed]].all() or np.minimum(present[: len(counts)], counts).sum() < len(coded) - most_missing:
                continue
            there = np.concatenate([[0], np.cumsum(np.isin(codes, coded))])
            begins = np.arange(0, max(1, len(codes) - 2 * len(coded)), 2 * len(coded))
            ends = np.minimum(begins + 4 * len(coded), len(codes))
            for k in np.flatnonzero(there[ends] - there[begins] >= len(coded) - most_missing):
                lo, hi = int(begins[k]), int(ends[k])
                if enough(n, lo, hi) and (share := self.ranked(n, written, lo, hi)) >= self.rank:
                    ranked.append((-share, self.templates[n][1], n, lo, hi))
        for _, _, n, lo, hi in sorted(ranked):
            look(n, lo, hi)

        taken: list[list] = [[] for _ in written]
        while heap:
            differ, held, saved, name, n, first, end, lo, hi, pairs = heapq.heappop(heap)
            family, _, wanted, _, _ = self.templates[n]
            if all(d == differ and f != family for x in taken[first:end] for f, d in x):
                for x in taken[first:end]:
                    x.append((family, differ))
                there, matched = {i for i, _ in pairs}, {j for _, j in pairs}
                missing = [w for i, w in enumerate(wanted) if i not in there]
                version = next((own[j].lstrip("v") for i, j in pairs if wanted[i] == "#"), None)
                yield first, end, name, version, -saved, len(pairs) / len(wanted), missing, [plain[j] for j in range(first, end) if j not in matched]
            # What is free beside the spans that were taken.
            at = lo
            for j in range(lo, hi + 1):
                if j == hi or taken[j]:
                    if j > at:
                        look(n, at, j)
                    at = j + 1


_OUT = pa.schema([("first_line", pa.int64()), ("license", pa.string()), ("version", pa.string()), ("saved", pa.float64()), ("words_share", pa.float64()), ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string())), ("block", pa.string())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, rank: float = 0.25, confirm: float = 0.8) -> DataFrame:
    """One row for each span of words that confirms a license: id, ``first_line`` (where the span begins), ``license``, ``version``, ``saved``, ``words_share``, ``missing``, ``added``, ``block`` (the span as written)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        scanner = Scanner(templates, rank, confirm)
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1)):
                for written, lines in scanner.blocks(text.as_py() or ""):
                    for first, end, name, version, saved, share, missing, added in sorted(scanner.confirmed(written), key=lambda r: r[:3]):
                        at.append(i)
                        rows.append((lines[first], name.replace("#", version or "").rstrip("-"), version, saved, share, missing, added, " ".join(written[first:end])))
            columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_OUT)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], ["id", *_OUT.names])

    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(WORDING))
    out = wanted.mapInArrow(run, f"id {kind}, first_line long, license string, version string, saved double, words_share double, missing array<string>, added array<string>, block string")
    return out.withColumnRenamed("id", id_col)
