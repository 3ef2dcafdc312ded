"""License scans: which template compresses a block of text best, confirmed by the words in which they differ."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Identifiers of licenses and the names by which notices call them.
NAMES = (
    ("MIT", "MIT License"), ("ISC", "ISC License"), ("Zlib", "zlib License"), ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("Apache-2.0", "Apache License, Version 2.0"),
    ("MPL-2.0", "Mozilla Public License, v. 2.0"), ("EPL-2.0", "Eclipse Public License v2.0"), ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"), ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"), ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"), ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"), ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"), ("CC0-1.0", "CC0 1.0"), ("Unlicense", "The Unlicense"),
)
#: Creative Commons' own names.
COMMONS = (
    ("CC-BY-4.0", "Attribution"), ("CC-BY-SA-4.0", "Attribution-ShareAlike"), ("CC-BY-NC-4.0", "Attribution-NonCommercial"), ("CC-BY-ND-4.0", "Attribution-NoDerivatives"),
    ("CC-BY-NC-SA-4.0", "Attribution-NonCommercial-ShareAlike"), ("CC-BY-NC-ND-4.0", "Attribution-NonCommercial-NoDerivatives"),
)
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def _gnu(name: str, version: str) -> str:
    """The notice that goes into each file."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
    )


#: Usual wordings of notices and short licenses in full, by license.
WORDINGS = (
    ("MIT", _MIT + "."),
    ("MIT", _MIT + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3} {_BSD_END}"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", _gnu("General Public License", "2")),
    ("GPL-3.0", _gnu("General Public License", "3")),
    ("LGPL-2.1", _gnu("Lesser General Public License", "2.1")),
    ("LGPL-3.0", _gnu("Lesser General Public License", "3")),
    ("AGPL-3.0", _gnu("Affero General Public License", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
)
TEMPLATES = (
    *WORDINGS,
    *((i, f"{begin} {name}.") for i, name in NAMES for begin in ("Released under the", "Licensed under the", "This work is licensed under the", "Licensed under", "Distributed under the")),
    *((i, f"This work is licensed under a Creative Commons {name} 4.0 International License.") for i, name in COMMONS),
    *((i, f"SPDX-License-Identifier: {i}{end}") for i, _ in NAMES for end in (("", "-only", "-or-later") if "GPL" in i else ("",))),
)
CANDIDATE = re.compile(r"licen[cs]|copyright|permission (?:is|to)\b|redistribution and use|public\s+domain|rights reserved|free (?:software|and unencumbered)|\bMERCHANTABILITY\b|\bCC0\b|\bCC[ -]BY\b|creative\s+commons|unlicense", re.I)
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
#: Words of the longest template that counts as short.
SHORT = 16
VERSION = re.compile(r"v?([0-9]+(?:\.[0-9]+)*)")
#: Words that tell no two licenses apart, and words that deny what follows them in a sentence.
FILLERS = frozenset("a an as at by file in is its license licence of or our that the these this terms under version with work".split())
DENIALS = re.compile(r"(?:\b(?:not|never)|n['\u2019]t)(?:\s+[^\W_]+)?\s*[\"'\u2019(]*$", re.IGNORECASE)


@dataclass(frozen=True)
class Found:
    license: str
    template: int
    saved: int
    first: int  # of the block's words, the first and the end
    end: int
    missing: tuple[str, ...]
    extra: tuple[str, ...]


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def align(want: list[str], have: list[str], at: int, skipped: int, most: int) -> tuple[int, list[int], list[int]] | None:
    """(end, missing, extra) of the cheapest way to read want[skipped:] from place `at` of have on, with at most `most` words of either alone: places of want and of have. The first word read is want[skipped].

    States are met by what they have spent: each stands where its words agree no further, and goes on by leaving out a word of either side.
    """
    start = (skipped, at)
    reached: dict[tuple[int, int], tuple] = {start: (tuple(range(skipped)), ())}
    todo = {start}
    for _ in range(2 * most + 1):
        ends, after = [], {}
        for i, j in todo:
            missing, extra = reached[i, j]
            while i < len(want) and j < len(have) and want[i] == have[j]:
                i, j = i + 1, j + 1
            if i == len(want):
                ends.append((len(missing) + len(extra), j, missing, extra))
                continue
            if len(missing) < most:
                after.setdefault((i + 1, j), ((*missing, i), extra))
            if len(extra) < most and j < len(have):
                after.setdefault((i, j + 1), (missing, (*extra, j)))
        if ends:
            _, j, missing, extra = min(ends)
            return j, list(missing), list(extra)
        todo = after.keys() - reached.keys()
        reached |= {k: after[k] for k in todo}
        if not todo:
            return None
    return None


def version_of(word: str) -> str | None:
    """The number of a version (2, 2.0, v2.0: all 2), or None where word is none."""
    found = VERSION.fullmatch(word)
    return re.sub(r"(?:\.0)+$", "", found[1]) if found else None


class Scanner:
    def __init__(self, templates: Sequence[tuple[str, str]], most_missing: int) -> None:
        import zstandard

        self.templates = templates
        # a raw dictionary needs 8 bytes; a template is set among blanks, which tell nothing
        dicts = [zstandard.ZstdCompressionDict((" " * 8 + " ".join(words(t))).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, t in templates]
        self.plain = zstandard.ZstdCompressor(level=3)
        self.with_template = [zstandard.ZstdCompressor(level=3, dict_data=d) for d in dicts]
        self.wording = [words(t) for _, t in templates]
        self.most = [min(most_missing, len(w) // 8) for w in self.wording]
        # short templates are sought in short blocks: in a long one their few bytes are lost in what its own words save
        kinds = [[i for i, w in enumerate(self.wording) if (len(w) > SHORT) == long] for long in (False, True)]
        self.tiers = [(tuple(k), max(len(self.wording[i]) for i in k) + most_missing) for k in kinds if k]
        # neighbours in the short wordings of a license: a word between them changes its name
        self.names: dict[str, set[tuple[str, str]]] = {}
        for (name, _), w in zip(templates, self.wording):
            if len(w) <= SHORT:
                self.names.setdefault(name, set()).update(zip(w, w[1:]))
        self.judge = lru_cache(maxsize=20_000)(self._judge)

    def matches(self, i: int, have: tuple[str, ...], places: dict[str, list[int]]) -> Iterator[Found]:
        """Where the block has template i, but for its permitted differences; saved is not known yet."""
        want, most = self.wording[i], self.most[i]
        for skipped in range(most + 1):
            for at in places.get(want[skipped], ()):
                met = align(want, have, at, skipped, most)
                if met is not None:
                    end, missing, extra = met
                    name = self.templates[i][0]
                    if (missing or extra) and self.other(i, have[at : end + 1], [want[k] for k in missing], [k - at for k in extra]):
                        name = f"LicenseRef-other-{name}"
                    yield Found(name, i, 0, at, end, tuple(want[k] for k in missing), tuple(have[k] for k in extra))

    def other(self, i: int, notice: Sequence[str], missing: Sequence[str], extra: Sequence[int]) -> bool:
        """Whether the words in which a notice differs from template i make it that of another version or license.

        They do if the license's own version gives way to another or is nowhere, if a word of its name is nowhere, or
        if a word that is no filler stands between two neighbours of its name. notice has the word after it too, which may
        be the version in another form; extra are places of the notice.
        """
        name, want = self.templates[i][0], self.wording[i]
        own, names = set(words(name)), self.names.get(name, frozenset())
        version = version_of(name.rpartition("-")[2])
        replaced = any(version_of(notice[k]) not in (None, version) for k in extra)
        for w in set(missing):
            if version is not None and version_of(w) == version:
                if replaced or all(version_of(x) != version for x in notice):
                    return True
            elif w not in notice and w not in FILLERS and version_of(w) is None and (w in own or len(want) <= SHORT and any(w in pair for pair in names)):
                return True
        for k in extra:
            before = next((notice[j] for j in range(k - 1, -1, -1) if j not in extra), None)
            after = next((notice[j] for j in range(k + 1, len(notice)) if j not in extra), None)
            if notice[k] not in FILLERS and notice[k] not in own and (before, after) in names:
                return True
        return False

    def _judge(self, have: tuple[str, ...], among: tuple[int, ...]) -> tuple[Found, ...]:
        """What fits of these templates in a block. They are tried in order of the bytes that they save; the least ones too, as in a block of few bytes a template may save none and yet be there."""
        raw = " ".join(have).encode("utf-8", "surrogatepass")
        base = len(self.plain.compress(raw))
        ranked = sorted(((base - len(self.with_template[i].compress(raw)), -i) for i in among), reverse=True)
        places: dict[str, list[int]] = {}
        for k, w in enumerate(have):
            places.setdefault(w, []).append(k)
        met: list[Found] = []
        for saved, i in ranked:
            met.extend(replace(f, saved=saved) for f in self.matches(-i, have, places))
        return tuple(met)

    def chosen(self, met: list[Found]) -> list[Found]:
        """Of those that meet in the same words, the one with most words in common stays, then the one that saves most; in order."""
        met = sorted(met, key=lambda f: (2 * len(f.missing) + len(f.extra) - len(self.wording[f.template]), -f.saved, f.template, f.first))
        out: list[Found] = []
        for f in met:
            if all(f.end <= o.first or o.end <= f.first for o in out):
                out.append(f)
        return sorted(out, key=lambda f: f.first)

    def scan(self, text: str) -> Iterator[tuple[int, int, Found]]:
        """(first character, end, Found) of each notice. A block is what lies within the longest template's reach of a telling word; blocks that touch are one.

        A notice that differs from its template in a version or name is LicenseRef-other-<license>; one that its
        sentence denies ("not released under ...") is none, though its words are taken.
        """
        telling = [m.start() for m in CANDIDATE.finditer(text)]
        if not telling:
            return
        spans = [m.span() for m in WORD.finditer(text)]
        starts, met = [a for a, _ in spans], []
        for among, reach in self.tiers:
            blocks: list[list[int]] = []
            for at in telling:
                k = max(0, bisect_right(starts, at) - 1)
                lo, hi = max(0, k - reach), min(len(spans), k + reach + 1)
                if blocks and lo <= blocks[-1][1]:
                    blocks[-1][1] = hi
                else:
                    blocks.append([lo, hi])
            for lo, hi in blocks:
                have = tuple(text[a:b].lower() for a, b in spans[lo:hi])
                met.extend(replace(f, first=lo + f.first, end=lo + f.end) for f in self.judge(have, among))
        for f in self.chosen(met):
            first = spans[f.first][0]
            # four words at most lie in what is looked at, however long they are
            if DENIALS.search(text, spans[max(0, f.first - 4)][0], first):
                continue
            yield first, spans[f.end - 1][1], f


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: Sequence[tuple[str, str]] = TEMPLATES, most_missing: int = 3) -> DataFrame:
    """A row for each notice: id_col, start, end (its characters), license, exact, saved_bytes, missing, extra.

    Words are letters and digits in lower case, so line ends, comment marks and case don't matter. A block, all words
    that a template may reach from a telling word, is compressed alone and with each template as a raw zstandard
    dictionary; templates are ranked by the bytes that they save. One is confirmed where the block has its words in
    order, of which at most most_missing (and an eighth) are missing, with as many others between; exact is a match
    without either. If the words in which they differ are the license's version or within its name, license is
    LicenseRef-other-<license>; a notice that its sentence denies is none. A block gives all its
    notices that share no words. Equal blocks of a task are judged once. Null and
    empty texts have no notice; repeated rows give theirs each; other columns aren't read; an empty table gives none.
    """
    kind = dict(docs.dtypes)[id_col]

    def batches(it):
        scanner = Scanner(templates, most_missing)
        for b in it:
            at, rows = [], []
            for i, t in enumerate(b.column(1)):
                for lo, hi, f in scanner.scan(t.as_py() or ""):
                    at.append(i)
                    rows.append((lo, hi, f.license, not f.missing and not f.extra, f.saved, list(f.missing), list(f.extra)))
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], [id_col, "start", "end", "license", "exact", "saved_bytes", "missing", "extra"])

    return docs.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {kind}, start long, end long, license string, exact boolean, saved_bytes long, missing array<string>, extra array<string>")
