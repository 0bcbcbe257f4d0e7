"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them.

Templates are cut into words; hashes of GRAM consecutive words are winnowed (the smallest of every WINNOW consecutive
hashes), and an inverted index leads from a fingerprint to templates and places. So a long template is a candidate wherever
GRAM + WINNOW - 1 of its words stand unchanged. A template of at most SHORT words is indexed under all runs of as many words as
must stand unchanged somewhere if the share LEAST of its words does, so no such match of it is missed.

Every place of a text is looked up, which finds what winnowing the text too would, and short texts as well. Each hit votes for
a diagonal (place in the text less place in the template) and is aligned to the template within BAND words of it (match 1,
other 0), on the words after the last match; the share of the template's words that align is its coverage, and the first and
last aligned word give the span. After a match the votes within its span are over; a diagonal within the band of one that did
not match is not tried again.

The templates are an argument of bounded size and are shipped to the tasks; the scan is row-local: no shuffle, one
pass over each whole text, memory bounded by the text. Work grows with the candidates, which are separate places of
the text, so a text of many licenses costs the sum of its licenses.

A null or empty text has no matches. Matches come by start, then template; of overlapping matches the one with more
aligned words stays, then the higher coverage, then the first name. Repeated rows are scanned each on its own. Empty tables give empty results.
Only the named id and text columns are read.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import map_rows, texts

GRAM, WINNOW, BAND, LEAST = 5, 4, 8, 0.8
#: Words up to which every run of a template is indexed, and not the winnowed ones of GRAM words alone.
SHORT = 24

#: Wording of public licenses and notices. The reader may pass others.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "MIT-line": "Released under the MIT License.",
    "All-rights-reserved": "All rights reserved.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
        "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
        "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and "
        "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software "
        "is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, "
        "including the above license grant, this restriction and the following disclaimer, must be included in all copies of the "
        "Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely "
        "in the form of machine-executable object code generated by a source language processor."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-cased words (letters and digits) and their places, in code points."""
    spans = [m.span() for m in _WORD.finditer(text)]
    return [text[a:b].lower() for a, b in spans], spans


def _hash(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words))


def winnow(hashes: list[int], width: int) -> list[int]:
    """Places of the smallest hash (the rightmost of equals) of every width consecutive ones; of all, if they are fewer."""
    kept: list[int] = []
    for at in range(max(1, len(hashes) - width + 1) if hashes else 0):
        best = min(range(at, min(len(hashes), at + width)), key=lambda i: (hashes[i], -i))
        if not kept or kept[-1] != best:
            kept.append(best)
    return kept


def sure_run(words: int, least: float) -> int:
    """Words that stand unchanged side by side somewhere if so large a share of a template's words does, wherever the others are."""
    lost = words - math.ceil(words * least - 1e-9)
    return -(-(words - lost) // (lost + 1))


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, width: int = WINNOW, least: float = LEAST):
        self.words = {name: words_of(text)[0] for name, text in sorted(templates.items())}
        self.places: dict[int, list[tuple[str, int]]] = defaultdict(list)
        self.first: dict[str, set[int]] = defaultdict(set)  # a fingerprint's first word -> lengths
        for name, words in self.words.items():
            short = len(words) <= SHORT
            n = min(gram, sure_run(len(words), least)) if short else gram
            if not words:
                continue
            hashes = [_hash(words[i : i + n]) for i in range(len(words) - n + 1)]
            for i in range(len(hashes)) if short else winnow(hashes, width):
                self.places[hashes[i]].append((name, i))
                self.first[words[i]].add(n)

    def votes(self, words: list[str]) -> dict[str, list[tuple[int, int]]]:
        """Per template (place in the text, diagonal) of each of its fingerprints that the text has, in the text's order."""
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        first, places = self.first, self.places
        for i, w in enumerate(words):
            if w in first:
                for n in first[w]:
                    if i + n <= len(words):
                        for name, j in places.get(_hash(words[i : i + n]), ()):
                            found[name].append((i, i - j))
        return found


def align(text: list[str], template: list[str], at: int, band: int, begin: int = 0) -> tuple[int, int, int]:
    """Most template words in order that the text has from `begin` on, within band words of the diagonal `at`: how many, first and last place in the text (or -1)."""
    width = 2 * band + 1
    score = [[0] * (width + 2) for _ in range(len(template) + 1)]
    for i, w in enumerate(template, 1):
        row, up = score[i], score[i - 1]
        for d in range(width):
            place = at + i - 1 + d - band
            best = max(up[d + 1], row[d - 1] if d else 0)  # the template's word, or the text's, is left out
            if begin <= place < len(text) and text[place] == w:
                best = max(best, up[d] + 1)
            row[d] = best
    i, d = len(template), max(range(width), key=lambda x: score[len(template)][x])
    matched, first, last = score[i][d], -1, -1
    while i and score[i][d]:
        place = at + i - 1 + d - band
        if begin <= place < len(text) and text[place] == template[i - 1] and score[i][d] == score[i - 1][d] + 1:
            first, last = place, place if last < 0 else last
            i -= 1
        elif score[i][d] == score[i - 1][d + 1]:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return matched, first, last


def _matches(words: list[str], template: list[str], votes: list[tuple[int, int]], band: int, least: float) -> Iterator[tuple[int, int, int]]:
    """(aligned words, first, last) of one template's matches, in the text's order and apart."""
    band = min(band, len(template) // 2)  # wider, a short template's words would be gathered from far apart
    begin, tried = 0, None
    for place, at in votes:
        if place < begin or tried is not None and abs(at - tried) <= band:
            continue
        matched, first, last = align(words, template, at, band, begin)
        if matched and matched >= least * len(template) - 1e-9:
            yield matched, first, last
            begin, tried = last + 1, None
        else:
            tried = at


def scan(text: str, index: Index, band: int = BAND, least: float = LEAST) -> list[tuple[str, int, int, float]]:
    """(template, start, end, coverage) of the matches; start and end in code points, end exclusive."""
    words, spans = words_of(text)
    found = []
    for name, votes in index.votes(words).items():
        template = index.words[name]
        found += [(-n, -n / len(template), name, first, last) for n, first, last in _matches(words, template, votes, band, least)]
    starts: list[int] = []
    kept: list[tuple] = []  # apart from one another, by start
    for m in sorted(found):
        at = bisect.bisect_right(starts, m[4])
        if not at or kept[at - 1][4] < m[3]:  # of those that begin before its end the last one ends before it
            starts.insert(at, m[3])
            kept.insert(at, m)
    return [(name, spans[a][0], spans[b][1], round(-share, 4)) for _, share, name, a, b in kept]


_MATCH = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, gram: int = GRAM, width: int = WINNOW, band: int = BAND, least: float = LEAST) -> DataFrame:
    """doc_id, matches array<struct<license,start,end,coverage>>; one row per input row."""
    templates = TEMPLATES if templates is None else templates

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        index = Index(templates, gram, width, least)
        names = ("license", "start", "end", "coverage")
        for key, text in rows:
            yield key, [dict(zip(names, m)) for m in scan(text, index, band, least)] if text else []

    return map_rows(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
        each,
        "doc_id long, matches array<struct<license:string,start:bigint,end:bigint,coverage:double>>",
        pa.schema([("doc_id", pa.int64()), ("matches", pa.list_(_MATCH))]),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(texts(spark, sf_dir, "documents"))
    shown = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"), F.format_number(m["coverage"], 4)))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), F.array_join(shown, ",").alias("licenses"))
