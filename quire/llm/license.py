"""License scans by conditional compression.

Sentences and lines with a licensing cue, joined where they stand close, are the candidate blocks. The words of each, with those
of its paragraph around it, are compressed by zstandard alone and with every template as a raw dictionary; templates are
ranked by how much smaller that makes them. From the first rank to the last, none left out, templates are confirmed by the
exact words that differ, in whatever stretches hold them. Of wordings of a license that fit alike, the one that saves most
bytes of its stretch counts; between licenses the words decide.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Usual wordings of public licenses' notices; <...> stands for any words.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright <holder>. All rights reserved."),
]
# Identifiers of the public license list.
IDENTIFIERS = "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 MPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 Unlicense".split()
TEMPLATES += [(x, f"SPDX-License-Identifier: {x}") for x in IDENTIFIERS]
GLUE = frozenset("the a an this is are of under and or in to by work".split())
CUE = re.compile(r"licen[sc]e|copyright|all rights reserved|permission|redistribut|public domain|creative commons|\bCC[ -]?(?:BY|0)|spdx|\bGPL", re.IGNORECASE)
_UNIT = re.compile(r"[^\n]*?(?:[.!?;](?=\s)|\n|$)")
_WORD = re.compile(r"[\w.+-]*\w")
_GAP = re.compile(r"\n[^\w\n]*(?=\n)")


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(re.sub(r"<[^>]*>", " ", text))]


def _located(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """The words of a part of the text with their start and end."""
    part = re.sub(r"<[^>]*>", lambda m: " " * len(m.group()), text[start:end])
    return [(m.group().lower(), start + m.start(), start + m.end()) for m in _WORD.finditer(part)]


def blocks(text: str, apart: int = 2) -> list[tuple[int, int]]:
    """Spans of candidate blocks: sentences or lines with a cue, joined when at most ``apart`` others lie between."""
    if not CUE.search(text):
        return []
    out: list[list[int]] = []
    for k, m in enumerate(m for m in _UNIT.finditer(text) if m.group().strip()):
        if CUE.search(m.group()):
            if out and k - out[-1][2] <= apart + 1:
                out[-1][1:] = [m.end(), k]
            else:
                out.append([m.start(), m.end(), k])
    trimmed = []
    for a, b, _ in out:
        body = text[a:b]
        trimmed.append((a + len(body) - len(body.lstrip()), a + len(body.rstrip())))
    return trimmed


def regions(text: str, spans: list[tuple[int, int]], reach: int) -> list[tuple[list[tuple[str, int, int]], list[int]]]:
    """Words and block numbers of the stretches to search: blocks with up to ``reach`` words of their paragraph before and
    after. Blocks that share such words share a stretch, so that a notice between them is found once."""
    out: list[tuple[list, list]] = []
    before: list = []
    for k, (start, end) in enumerate(spans):
        if k == 0:
            gaps = list(_GAP.finditer(text, 0, start))
            before = _located(text, gaps[-1].end() if gaps else 0, start)[-reach:]
        if before is not None:
            out.append((before, []))
        out[-1][0].extend(_located(text, start, end))
        out[-1][1].append(k)
        # What lies between two blocks: one stretch if it is short and without a blank line.
        until = spans[k + 1][0] if k + 1 < len(spans) else len(text)
        gaps = list(_GAP.finditer(text, end, until))
        between = _located(text, end, gaps[0].start() if gaps else until)
        if k + 1 < len(spans) and not gaps and len(between) <= 2 * reach:
            out[-1][0].extend(between)
            before = None
        else:
            out[-1][0].extend(between[:reach])
            before = _located(text, gaps[-1].end(), until)[-reach:] if gaps else between[-reach:]
    return out


class Scanner:
    """Judges texts; remembers the notices of up to ``most`` distinct stretches."""

    def __init__(self, templates: list[tuple[str, str]], differ: float = 0.1, most: int = 50_000):
        self.templates, self.differ, self.most = templates, differ, most
        plain = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        self.alone = zstandard.ZstdCompressor(compression_params=plain)
        self.words = [_words(t) for _, t in templates]
        self.given = [zstandard.ZstdCompressor(compression_params=plain, dict_data=zstandard.ZstdCompressionDict(" ".join(own).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for own in self.words]
        # A notice of the longest template has at most so many words before or after any of its own.
        self.reach = max(len(own) + int(max(1, differ * len(own))) for own in self.words)
        self.code = {w: i for i, w in enumerate(sorted({w for own in self.words for w in own}))}
        # A word with a digit tells versions apart; in a short notice every word but glue tells licenses apart.
        self.must = [{w for w in own if any(c.isdigit() for c in w) or len(own) < 20 and w not in GLUE} for own in self.words]
        self.known: dict[tuple, list] = {}

    def sizes(self, words: tuple[str, ...], k: int) -> tuple[int, int]:
        """Bytes of the words compressed alone and with a template given."""
        raw = " ".join(words).encode()
        return len(self.alone.compress(raw)), len(self.given[k].compress(raw))

    def ranked(self, words: tuple[str, ...]) -> list[int]:
        """All templates, the one that makes the words smallest first."""
        raw = " ".join(words).encode()
        size = [len(c.compress(raw)) for c in self.given]
        return sorted(range(len(size)), key=lambda k: (size[k], k))

    def places(self, words: tuple[str, ...], k: int) -> list[tuple[int, int, int]]:
        """(words that differ, first word, end) of the stretches of the words that hold the template within its tolerance,
        best first and none within another. Words that differ are those missing and those beyond the template."""
        want, own, n = self.words[k], set(words), len(words)
        room = max(1, self.differ * len(want))
        if self.must[k] - own or sum(w not in own for w in want) > room:
            return []
        # Edit distance without substitutions from the template to the stretch before each place that starts anywhere; a
        # state is differing * scale - first, so the least is the shortest of the best.
        ids, scale = np.array([self.code.get(w, -1) for w in words]), n + 1
        steps = np.arange(n + 1) * scale
        state = -np.arange(n + 1)
        for w in want:
            after = state + (1000 if w in self.must[k] and want.count(w) == 1 else 1) * scale
            hit = np.flatnonzero(ids == self.code[w])
            after[hit + 1] = np.minimum(after[hit + 1], state[hit])
            state = np.minimum.accumulate(after - steps) + steps
        differ = -(-state // scale)
        out: list[tuple[int, int, int]] = []
        for d, first, end in sorted((int(differ[j]), int(differ[j] * scale - state[j]), int(j)) for j in np.flatnonzero(differ <= room)):
            if first < end and not self.must[k] - set(words[first:end]) and all(end <= x or first >= y for _, x, y in out):
                out.append((d, first, end))
        return out

    def explained(self, d: int, first: int, end: int, k: int) -> int:
        """Words of the template in its stretch, less those that differ."""
        missing = (d - (end - first - len(self.words[k]))) // 2
        return len(self.words[k]) - missing - d

    def notices(self, words: tuple[str, ...]) -> list[tuple[int, int, int, int, int, int, int]]:
        """(words that differ, first word, end, template, its rank, bytes alone, bytes given the template) of the notices
        among the words, by rank."""
        if words in self.known:
            return self.known[words]
        found = [(d, first, end, k, n, *self.sizes(words[first:end], k)) for n, k in enumerate(self.ranked(words), 1) for d, first, end in self.places(words, k)]
        # A stretch gives way to one of another license that explains more words (template words found, less those that
        # differ) and holds most of it: an opening clause to the whole text, one license to a near one that fits better.
        sized = [(*x, self.explained(*x[:4])) for x in found]
        found = [x[:-1] for x in sized if not any(y[-1] > x[-1] and self.templates[y[3]][0] != self.templates[x[3]][0] and 2 * (min(x[2], y[2]) - max(x[1], y[1])) > x[2] - x[1] for y in sized)]
        if len(self.known) < self.most:
            self.known[words] = found
        return found

    def judge(self, text: str) -> list[tuple[int, int, int, str, int, float, int, int, int]]:
        """(block, start, end, license, template, reduction, missing, extra, rank) of the confirmed licenses of a text: of each
        block each license's best template: fewest words that differ, then most bytes saved. A notice belongs to the first
        block that it touches and widens it. The reduction is that of the words of the stretch that holds the template, the
        rank that of the template by compression of all the words searched."""
        spans = blocks(text)
        wide = [list(x) for x in spans]
        best: dict[tuple[int, str], tuple] = {}
        for located, inside in regions(text, spans, self.reach) if spans else []:
            for d, first, end, k, rank, alone, given in self.notices(tuple(w for w, _, _ in located)):
                a, b = located[first][1], located[end - 1][2]
                block = next((i for i in inside if a < spans[i][1] and b > spans[i][0]), None)
                if block is None:
                    continue
                wide[block] = [min(a, wide[block][0]), max(b, wide[block][1])]
                missing = (d - (end - first - len(self.words[k]))) // 2
                now = (d, given - alone, rank, -first, k, 1 - given / alone, missing, d - missing)
                key = block, self.templates[k][0]
                best[key] = min(best.get(key, now), now)
        ranked = sorted(best.items(), key=lambda x: (x[0][0], x[1][:2], x[0][1]))
        return [(block, *wide[block], name, k, gain, missing, extra, rank) for (block, name), (_, _, rank, _, k, gain, missing, extra) in ranked]


_FOUND = "doc_id long, block int, start long, length long, license string, template int, reduction double, words_missing int, words_extra int, exact boolean, rank int"


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """A row for each license confirmed in a block of each row of ``docs`` (doc_id, text): start and length of the
    block in characters, the license, its template's number, the reduction, the words that differ, whether none do, and the
    template's rank by compression (from 1; any rank is confirmed, so that none is lost).
    Null and empty texts, texts without a cue and an empty table give no rows; null and repeated doc_ids are scanned row by
    row; blocks may be as long as a text; of wordings of one license that fit alike the one that saves most bytes counts."""
    templates = templates or TEMPLATES

    def run(batches):
        scanner = Scanner(templates)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32())
        names = [c.split()[0] for c in _FOUND.split(", ")]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for b, start, end, name, k, gain, missing, extra, rank in scanner.judge(text):
                    rows.append((doc, b, start, end - start, name, k, round(gain, 6), missing, extra, missing + extra == 0, rank))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=names)

    # A cheap test in the scan leaves most texts out before Python.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.where(F.col("text").rlike("(?i)" + CUE.pattern)).mapInArrow(run, _FOUND)
