"""License scans by conditional compression.

The words about each license word, enough on both sides to hold the longest template, are a candidate block; blocks that
overlap are one. Line ends and line lengths do not matter. In a block, every template is aligned wherever a run of
its words stands that a notice within the allowed share of differences must have (with d differences, one of at least
(n - d) / (d + 1) words). The words found are compressed alone and with the template as a raw zstandard dictionary, and
occurrences are ranked by the bytes that this saves. A winner is confirmed by its exact wording: it has the template's
words in order up to the allowed share of differences, and every word of the template with a digit (a version) is there.
Of confirmed occurrences that overlap the first by rank stays; no other is left out. The differing words are part of the result.

Only texts with a license word reach Python. Nothing is shuffled.

Defined results. Null and empty texts, and texts without a license word, have no finds. Words are compared without case
and punctuation. Ties go to fewer differences, then to the earlier template. Identical rows have the same finds. Columns
other than text pass through, but for n_candidates and licenses, which are replaced.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: License notices in common use (fixed values).
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "MIT-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-1.1": "Licensed under the Apache License, Version 1.1.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0-only-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-clause-1": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-clause-2": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-clause-3": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "All-rights-reserved": "All rights reserved.",
}
#: Identifiers that files are tagged with (fixed values).
TAGS = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
TEMPLATES |= {f"tag-{x}": f"SPDX-License-Identifier: {x}" for x in TAGS}
#: Words that make a line a candidate (fixed pattern).
TRIGGER = r"(?i)licen[cs]e|copyright|rights\s+reserved|permission|redistribut|public\s+domain|free\s+software|warrant"
DIFFERENCES = 0.2
#: The window of words that is aligned is a few words longer than the template.
MARGIN = 4

_TRIGGER = re.compile(TRIGGER, re.ASCII)
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words(text: str) -> list[str]:
    return [m.group().lower() for m in _WORD.finditer(text)]


@dataclass
class Find:
    """saved: bytes, and reduction: their share of the words compressed alone; start, end: its words in the block."""

    license: str
    saved: int
    reduction: float
    missing: list[str]
    extra: list[str]
    start: int
    end: int


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, level: int = 3):
        import zstandard

        self.plain = zstandard.ZstdCompressor(level=level)
        self.names = list(templates)
        self.words = {n: words(t) for n, t in templates.items()}
        self.versions = {n: {i for i, x in enumerate(w) if any(c.isdigit() for c in x)} for n, w in self.words.items()}
        self.primed = {
            n: zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for n, w in self.words.items()
        }

    def reduction(self, block: list[str], name: str) -> tuple[int, float]:
        """By how many bytes, and by how much of its size, the template shortens the compressed words."""
        data = " ".join(block).encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(data))
        saved = alone - len(self.primed[name].compress(data))
        return saved, saved / alone

    def occurrences(self, block: list[str], name: str) -> Iterator[tuple[int, int, list[str], list[str]]]:
        """start, end, and what the block lacks of the template and has within it besides, of every occurrence."""
        want = self.words[name]
        most = int(DIFFERENCES * len(want))
        least = -(-(len(want) - most) // (most + 1))
        there = set(block)
        if sum(w in there for w in want) < len(want) - most:
            return
        block = list(block)
        while True:
            longest = difflib.SequenceMatcher(None, want, block, autojunk=False).find_longest_match(0, len(want), 0, len(block))
            if longest.size < least:
                return
            low = max(0, longest.b - longest.a - most - MARGIN)
            part = block[low : longest.b - longest.a + len(want) + most + MARGIN]
            same = [m for m in difflib.SequenceMatcher(None, want, part, autojunk=False).get_matching_blocks() if m.size]
            start, end = same[0].b, same[-1].b + same[-1].size
            matched_a = {i for m in same for i in range(m.a, m.a + m.size)}
            matched_b = {i for m in same for i in range(m.b, m.b + m.size)}
            missing = [w for i, w in enumerate(want) if i not in matched_a]
            extra = [part[i] for i in range(start, end) if i not in matched_b]
            if len(missing) + len(extra) <= most and self.versions[name] <= matched_a:
                yield low + start, low + end, missing, extra
                block[low + start : low + end] = [""] * (end - start)
            else:
                block[longest.b] = ""

    def finds(self, block: list[str]) -> list[Find]:
        """The confirmed occurrences that do not overlap, by their place."""
        found = []
        for i, name in enumerate(self.names):
            for start, end, missing, extra in self.occurrences(block, name):
                saved, reduction = self.reduction(block[start:end], name)
                found.append((-saved, len(missing) + len(extra), i, Find(name, saved, reduction, missing, extra, start, end)))
        out: list[Find] = []
        for *_, find in sorted(found, key=lambda x: x[:3]):
            if all(find.end <= x.start or x.end <= find.start for x in out):
                out.append(find)
        return sorted(out, key=lambda x: x.start)

    def scan(self, block: str) -> Find | None:
        """The find that saves most."""
        return max(self.finds(words(block)), key=lambda x: x.saved, default=None)

    def scan_text(self, text: str) -> list[dict]:
        tokens = list(_WORD.finditer(text))
        starts = [m.start() for m in tokens]
        longest = max(map(len, self.words.values()))
        reach = longest + int(DIFFERENCES * longest) + MARGIN
        blocks: list[list[int]] = []
        for m in _TRIGGER.finditer(text):
            at = bisect.bisect_right(starts, m.start()) - 1
            low, high = max(0, at - reach), min(len(tokens), at + reach + 1)
            if blocks and low <= blocks[-1][1]:
                blocks[-1][1] = high
            else:
                blocks.append([low, high])
        out = []
        for low, high in blocks:
            for f in self.finds([m.group().lower() for m in tokens[low:high]]):
                first, last = tokens[low + f.start].start(), tokens[low + f.end - 1].start()
                line, lines = text.count("\n", 0, first), text.count("\n", first, last) + 1
                out.append({"line": line, "lines": lines, "license": f.license, "reduction": f.reduction, "missing": f.missing, "extra": f.extra})
        return out


_FIND = T.StructType(
    [
        T.StructField("line", T.IntegerType()),
        T.StructField("lines", T.IntegerType()),
        T.StructField("license", T.StringType()),
        T.StructField("reduction", T.DoubleType()),
        T.StructField("missing", T.ArrayType(T.StringType())),
        T.StructField("extra", T.ArrayType(T.StringType())),
    ]
)
_FIND_ARROW = pa.list_(pa.struct([("line", pa.int32()), ("lines", pa.int32()), ("license", pa.string()), ("reduction", pa.float64()), ("missing", pa.list_(pa.string())), ("extra", pa.list_(pa.string()))]))
_scanners: dict[tuple, Scanner] = {}


def _scan(templates: dict[str, str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tuple(templates.items())
        if key not in _scanners:
            _scanners[key] = Scanner(templates)
        scanner = _scanners[key]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            finds = [scanner.scan_text(t) if t else [] for t in texts]
            counts = [sum(_TRIGGER.search(x) is not None for x in t.split("\n")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(finds, _FIND_ARROW)], names=names)

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """docs but for text, n_candidates (lines), and licenses: first line, lines, template, reduction and differing words of each find."""
    few = F.when(F.col("text").rlike(TRIGGER), F.col("text"))
    rest = docs.drop("text", "n_candidates", "licenses")
    rows = docs.select(*rest.columns, few.alias("__text"))
    schema = T.StructType([*rest.schema.fields, T.StructField("n_candidates", T.LongType()), T.StructField("licenses", T.ArrayType(_FIND))])
    return rows.mapInArrow(_scan(templates or TEMPLATES, [f.name for f in schema]), schema)
