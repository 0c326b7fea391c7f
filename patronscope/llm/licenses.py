"""License scans by conditional compression.

Around each cue word of a text stands a candidate block. It is compressed plainly and with each
template as a raw zstandard dictionary; templates are ranked by the bytes that this saves, as a share
of the template's own compressed size, so that neither long blocks nor short templates lose. The
words of those that save enough are then looked for in the block, so that the exact differences in
wording confirm or refuse them.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# License notices as their stewards word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the "
    "terms of the GNU General Public License, version 2.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without "
    "modification, are permitted provided that the following conditions are met.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, "
    "v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All rights reserved": "All rights reserved.",
}
# License texts, or the longer notices that stand for them, as their stewards word them.
LONG_TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
    'software and associated documentation files (the "Software"), to deal in the Software without '
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of "
    'the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
    "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with "
    "or without fee is hereby granted, provided that the above copyright notice and this "
    'permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR '
    "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
    "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
    "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without "
    "modification, are permitted provided that the following conditions are met: 1. "
    "Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. 3. Neither the name of "
    "the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use '
    "this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
    'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
    "specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the "
    "terms of the GNU General Public License as published by the Free Software Foundation, either "
    "version 3 of the License, or (at your option) any later version.",
}
# Names of these licenses in a line "SPDX-License-Identifier: ...".
SPDX = {
    "Apache-2.0": ["Apache-2.0"],
    "MIT": ["MIT"],
    "ISC": ["ISC"],
    "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"],
    "LGPL-3.0": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "BSD-3-Clause": ["BSD-3-Clause"],
    "MPL-2.0": ["MPL-2.0"],
    "CC-BY-4.0": ["CC-BY-4.0"],
    "CC-BY-SA-4.0": ["CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["CC-BY-NC-4.0"],
    "CC0-1.0": ["CC0-1.0"],
    "Unlicense": ["Unlicense"],
}
CUES = (
    r"(?i)licen[sc]|copyright|all\W+rights\W+reserved|public\W+domain|creative\W+commons"
    r"|redistribut|permission\W+(?:is\W+hereby\W+granted|to\W+use)|\bcc[ -]?(?:by|0)|spdx"
)
# Share of a template's own size that must be saved, and of its words that may be missing.
LEAST_SAVED, MOST_MISSING = 0.2, 0.25
# Negative levels leave literals as they are, so that savings come from matches alone: in blocks of a
# few words the coding of literals gains or loses as much as a short template does.
LEVEL = -1
# A block reaches this many times its templates' length to both sides of a cue; a longer row of
# blocks is cut into overlapping pieces of so many reaches.
REACH, PIECE = 1.5, 16
_WORDS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_CUE = re.compile(CUES)


def wordings() -> list[tuple[str, str]]:
    """(license, template): the notices, the longer texts and the identifiers."""
    return [
        *TEMPLATES.items(),
        *LONG_TEMPLATES.items(),
        *((k, f"SPDX-License-Identifier: {v}") for k, names in SPDX.items() for v in names),
    ]


def candidate_blocks(cues: list[tuple[int, int]], length: int, reach: int) -> Iterator[tuple]:
    """(start, end) of blocks of a text of ``length`` around ``cues``; overlapping ones are joined.

    Pieces of long blocks overlap by more than twice the reach, so whatever lies within reach of a
    cue lies whole in one of them.
    """
    joined: list[list[int]] = []
    for a, b in cues:
        a, b = max(0, a - reach), min(length, b + reach)
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    for a, b in joined:
        while b - a > PIECE * reach:
            yield a, a + PIECE * reach
            a += (PIECE - 3) * reach
        yield a, b


class Template:
    """One wording of a license: its compressor, own size and words."""

    def __init__(self, name: str, text: str, level: int):
        plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        raw = zstandard.ZstdCompressionDict(
            text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )
        self.name, self.text = name, text
        self.words = _WORDS.findall(text.lower())
        self.size = len(plain.compress(text.encode()))
        self.with_text = zstandard.ZstdCompressor(
            level=level, dict_data=raw, write_content_size=False, write_dict_id=False
        )

    def saved(self, data: bytes, plain: int) -> float:
        return (plain - len(self.with_text.compress(data))) / self.size

    def differences(self, own: list[str]) -> tuple[int, list[str]]:
        """(missing words of the template, changes "was>now") where ``own`` agrees best with it."""
        wanted, n = self.words, len(self.words)
        match = difflib.SequenceMatcher(None, wanted, own, autojunk=False)
        best = match.find_longest_match()
        slack = n // 4 + 1
        low = max(0, best.b - best.a - slack)
        # Only words near the longest agreement count, not such as happen to stand far away.
        near = own[low : best.b + n - best.a + slack]
        codes = difflib.SequenceMatcher(None, wanted, near, autojunk=False).get_opcodes()
        missing, changed = 0, []
        for tag, a, b, c, d in codes:
            if tag in ("delete", "replace"):
                missing += b - a
            if tag == "equal" or b == 0 or a == n:
                # Words before the first and after the last one of the template belong to neither.
                continue
            if a == 0:
                c = max(c, d - b)
            elif b == n:
                d = min(d, c + b - a)
            changed.append(f"{' '.join(wanted[a:b])}>{' '.join(near[c:d])}")
        return missing, changed


class LicenseScanner:
    """Templates by the reach of their blocks."""

    def __init__(self, templates: list[tuple[str, str]], level: int = LEVEL):
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.by_reach: dict[int, list[Template]] = {}
        for name, text in templates:
            reach = 1 << (int(REACH * len(text)) - 1).bit_length()
            self.by_reach.setdefault(reach, []).append(Template(name, text, level))

    def scan(self, block: str, templates: list[Template]) -> list[dict]:
        """Confirmed licenses of a block: all whose wording is exact, else the nearest one.

        Templates that save too little aren't tried; ties go to the greater saving, then the name.
        """
        data = block.encode("utf-8", "replace")
        plain = len(self.plain.compress(data))
        ranked = [(t.saved(data, plain), t) for t in templates]
        ranked = sorted((x for x in ranked if x[0] >= LEAST_SAVED), key=lambda x: (-x[0], x[1].name))
        own = _WORDS.findall(block.lower()) if ranked else []
        found = []
        for saved, t in ranked:
            missing, changed = t.differences(own)
            if missing <= MOST_MISSING * len(t.words):
                found.append(
                    {"license": t.name, "saved": saved, "missing": missing, "changes": changed,
                     "words": len(t.words)}
                )
        exact = [f for f in found if not f["changes"]]
        return exact or sorted(found, key=lambda f: f["missing"] / f["words"])[:1]

    def scan_text(self, text: str) -> tuple[int, list[dict]]:
        """(number of joined short blocks, confirmed licenses) of a text, best first.

        An exact wording comes first and leaves out all inexact ones; then the one of most words,
        then the greatest saving.
        """
        cues = [m.span() for m in _CUE.finditer(text)]
        blocks = {
            reach: list(candidate_blocks(cues, len(text), reach)) for reach in self.by_reach
        }
        found = [
            f
            for reach, templates in self.by_reach.items()
            for a, b in blocks[reach]
            for f in self.scan(text[a:b], templates)
        ]
        found.sort(key=lambda f: (bool(f["changes"]), -f["words"], -f["saved"]))
        if found and not found[0]["changes"]:
            found = [f for f in found if not f["changes"]]
        return len(blocks[min(blocks)]), found


def scan_licenses(
    docs: DataFrame, templates: list[tuple[str, str]] | dict[str, str] | None = None
) -> DataFrame:
    """(doc_id, blocks, license, exact, saved, changes, licenses), one row per row of ``docs``.

    ``license`` is the confirmed one of exact wording, then of the most words; ``licenses`` names all
    exact ones, or the inexact ones if none is exact. Line breaks, comment marks and the text around
    a notice make no difference; ``saved`` is a share of the template's own compressed size. Whole
    texts of any length are scanned, long rows of blocks in overlapping pieces. Texts without a cue,
    null and empty ones have 0 blocks and null for the rest; their texts never leave the JVM.
    """
    if templates is None:
        templates = wordings()
    elif isinstance(templates, dict):
        templates = list(templates.items())
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, blocks int, license string, exact boolean, saved double,"
        " changes array<string>, licenses array<string>"
    )

    def run(batches):
        scanner = LicenseScanner(templates)
        for rows in batches:
            out = []
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                blocks, found = (0, []) if pd.isna(text) else scanner.scan_text(text)
                best = found[0] if found else None
                out.append(
                    (
                        doc_id,
                        blocks,
                        best and best["license"],
                        None if best is None else not best["changes"],
                        best and best["saved"],
                        best and best["changes"],
                        sorted({f["license"] for f in found}) if found else None,
                    )
                )
            yield pd.DataFrame(
                out,
                columns=["doc_id", "blocks", "license", "exact", "saved", "changes", "licenses"],
            ).astype({"exact": object, "saved": object})

    # One scan: texts without a cue are nulled before they would reach Python.
    cue = F.when(F.col("text").rlike(CUES), F.col("text")).alias("text")
    return docs.select("doc_id", cue).mapInPandas(run, schema)


def op3_licenses(spark, folder: str) -> DataFrame:
    """License found in every document."""
    return scan_licenses(spark.read.parquet(f"{folder}/documents.parquet"))
