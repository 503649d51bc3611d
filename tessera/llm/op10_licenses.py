"""License scans by conditional compression.

A text is cut in units (lines, and sentences within lines). Units with a license cue, joined over gaps
of at most ``GAP`` units, are candidate blocks. Each block is compressed with zstandard alone and with
each template as raw-content dictionary; templates are ranked by the bytes that they save. What is
confirmed is up to the wording alone, however long the block: every template whose words are in the
block but for a tenth is compared with it word by word, around their longest common run. What stands before and after the template's words in the block doesn't count;
short statements must be whole and exact. All differences are reported.

A block has a row for each license: the words of a confirmed template are taken out of the block and
the rest is judged, until none is confirmed. Cues are completed from the templates, so that no unit of
theirs is without one.

Defined cases: null and empty texts have no block; a document has a row or more for each block, in
order; repeated rows are each scanned; an empty table gives an empty result; without templates no
block has a license; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

GAP, LEVEL = 3, 6
#: Of a block without a license, templates that save at least this share of the best one's savings are reported on.
CLOSE = 0.75
MOST_DIFFERENT = 0.1
#: Templates with fewer words are statements, which must be there word for word.
LONG = 30
#: Of a block without a license and without savings of this share of its compressed size, no template is reported.
LEAST_SAVING = 0.2

#: Names of licenses, by identifier.
NAMES = {
    "MIT": ("MIT License", "MIT license"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "ISC": ("ISC License",),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
}

#: Ways to state a license in a sentence.
STATEMENTS = ("Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This project is licensed under the terms of the {}.")

#: Texts and notices of licenses.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}

#: Cues of a license, in lower case.
CUES = ("licen", "cc0", "copyright", "permission is hereby", "permission to use", "redistribut", "warrant", "public domain", "free software", "spdx-", "creative commons", "cc by", "gpl", "shall be included in all copies")
_UNIT = re.compile(r"[^\n]+?(?:(?<=[.!?:;])(?=[ \t])|(?=\n)|\Z)")
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def default_templates() -> list[tuple[str, str]]:
    """(license, text) pairs: the long texts, and each name in each statement."""
    return [*TEXTS.items(), *[(key, s.format(n)) for key, names in NAMES.items() for n in names for s in STATEMENTS]]


def cues(templates: list[tuple[str, str]]) -> tuple[str, ...]:
    """``CUES``, and the first words of each unit of a template that has none of them, so that blocks hold whole templates."""
    out = list(CUES)
    for _, text in templates:
        for unit in _UNIT.findall(text.lower()):
            if _WORD.search(unit) and not any(c in unit for c in out):
                cue = " ".join(unit.split()[:4])
                out.append(cue if cue in unit else unit.strip())
    return tuple(out)


def blocks(text: str, cues: tuple[str, ...] | None = None) -> list[tuple[int, int]]:
    """(start, end) of the candidate blocks of a text, in characters; the cues are those of the default templates."""
    cues = _default_cues() if cues is None else cues
    low = text.lower()
    if len(low) != len(text):  # a letter whose small form is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    places = sorted(m for cue in cues if cue in low for m in _finds(low, cue))
    if not places:
        return []
    out: list[tuple[int, int]] = []
    at, gap, open_block, unit = 0, 0, None, None
    for unit in _UNIT.finditer(text):
        if not unit[0].strip():
            continue
        while at < len(places) and places[at] < unit.start():
            at += 1
        if at < len(places) and places[at] < unit.end():
            begin = unit.start() + len(unit[0]) - len(unit[0].lstrip())
            open_block, gap = ((open_block or (begin,))[0], unit.end()), 0
        elif open_block:
            gap += 1
            if gap > GAP:
                out.append(open_block)
                open_block = None
    if open_block:
        out.append(open_block)
    return out


@lru_cache(maxsize=1)
def _default_cues() -> tuple[str, ...]:
    return cues(default_templates())


def _finds(text: str, cue: str):
    at = text.find(cue)
    while at >= 0:
        yield at
        at = text.find(cue, at + 1)


def differences(template: list[str], block: list[str]) -> list[str]:
    """Word edits that turn the template into the part of the block that it covers."""
    codes = SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    while codes and codes[0][0] == "insert":
        codes = codes[1:]
    while codes and codes[-1][0] == "insert":
        codes = codes[:-1]
    return [f"{kind} {' '.join(template[a:b])} -> {' '.join(block[c:d])}" for kind, a, b, c, d in codes if kind != "equal"]


def _weight(edits: list[str]) -> int:
    return sum(max(len(s.split()) for s in e.split(" ", 1)[1].split("->")) for e in edits)


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]):
        import zstandard

        self.templates = [(key, text, _WORD.findall(text.lower())) for key, text in templates]
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.given = []
        for _, text in templates:
            data = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False))
        self.bags = [Counter(own) for _, _, own in self.templates]
        self.all_of = lru_cache(maxsize=20_000)(self._all_of)
        self.judge = self._judge
        self.cues = cues(templates)

    def savings(self, block: str) -> tuple[int, list[int]]:
        """Compressed size of a block, and the bytes that each template saves."""
        data = block.encode()
        alone = len(self.plain.compress(data))
        return alone, [alone - len(c.compress(data)) for c in self.given]

    def _compare(self, i: int, words: list[str], counts: Counter):
        """(differing words, edits, begin, end) of the words that the template covers, None if it isn't confirmed."""
        own = self.templates[i][2]
        n = len(own)
        if not n or n > len(words) + MOST_DIFFERENT * n:
            return None
        if n < LONG:
            if not self.bags[i].keys() <= counts.keys():
                return None
            first = own[0]
            at = next((k for k in range(len(words) - n + 1) if words[k] == first and words[k : k + n] == own), None)
            return None if at is None else (0, [], at, at + n)
        # words that aren't in the block at all differ in any alignment
        if sum((self.bags[i] - counts).values()) > MOST_DIFFERENT * n:
            return None
        place = SequenceMatcher(None, own, words, autojunk=False).find_longest_match()
        slack = int(MOST_DIFFERENT * n) + 1
        low = max(0, place.b - place.a - slack)
        part = words[low : place.b - place.a + n + slack]
        edits = differences(own, part)
        weight = _weight(edits)
        if weight > MOST_DIFFERENT * n:
            return None
        same = [m for m in SequenceMatcher(None, own, part, autojunk=False).get_matching_blocks() if m.size]
        return weight, edits, low + same[0].b, low + same[-1].b + same[-1].size

    def _winner(self, words: list[str], saved: list[int]):
        """The confirmed template that has the most words in the block and the fewest that differ."""
        found, counts = [], Counter(words)
        for i in range(len(self.templates)):
            if got := self._compare(i, words, counts):
                found.append((2 * got[0] - len(self.templates[i][2]), -saved[i], i, got))
        return min(found, key=lambda f: f[:3]) if found else None

    def _judge(self, block: str):
        """(license or None, template or None, saving, differing words, edits) of a block."""
        return self.all_of(block)[0]

    def _all_of(self, block: str):
        """One such row for each license of a block, in the order of confirmation; one without a license if there is none."""
        if not self.given:
            return [(None, None, 0.0, 0, ())]
        alone, saved = self.savings(block)
        words = _WORD.findall(block.lower())
        rest, out = words, []
        while won := self._winner(rest, saved):
            i, (weight, edits, begin, end) = won[2], won[3]
            out.append((self.templates[i][0], i, saved[i] / alone, weight, tuple(edits)))
            rest = [*rest[:begin], "\n", *rest[end:]]  # no word, so that what stood around isn't joined
        return out or [self._nearest(words, alone, saved)]

    def _nearest(self, words: list[str], alone: int, saved: list[int]):
        """The row of a block without a license: the closest of the templates that save most."""
        best = max(saved)
        if best / alone < LEAST_SAVING:
            return None, None, best / alone, 0, ()
        ranked = sorted((i for i, s in enumerate(saved) if s >= CLOSE * best), key=lambda i: (-saved[i], i))
        found = []
        for rank, i in enumerate(ranked):
            own = self.templates[i][2]
            edits = differences(own, words)
            found.append((_weight(edits) / max(len(own), 1), -len(own), rank, i, edits))
        _, _, _, i, edits = min(found)
        return None, i, saved[i] / alone, _weight(edits), tuple(edits)

    def scan(self, text: str):
        for start, end in blocks(text, self.cues):
            for row in self.all_of(text[start:end]):
                yield (start, end, *row)


def scan(documents: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """A row for each license of a candidate block: doc_id, block (from 0), start, length, license (one row with null if
    none is confirmed), template, saving, differing_words, edits, text."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    templates = default_templates() if templates is None else templates
    names = ["doc_id", "block", "start", "length", "license", "template", "saving", "differing_words", "edits", "text"]
    kinds = [None, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.string()), pa.string()]

    def run(batches):
        scanner = Scanner(templates)
        for b in batches:
            rows = []
            for i, text in enumerate(b.column("text").to_pylist()):
                if text:
                    numbers: dict[int, int] = {}
                    for start, end, key, template, share, n, edits in scanner.scan(text):
                        k = numbers.setdefault(start, len(numbers))
                        rows.append((i, k, start, end - start, key, template, share, n, list(edits), text[start:end]))
            if rows:
                columns = [b.column("doc_id").take(pa.array([r[0] for r in rows])), *[pa.array([r[c] for r in rows], kinds[c]) for c in range(1, len(names))]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, block int, start int, length int, license string, template int, saving double, differing_words int, edits array<string>, text string"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents")).filter("license is not null")
    return found.select("doc_id", "block", "start", "length", "license", "saving", "differing_words")
